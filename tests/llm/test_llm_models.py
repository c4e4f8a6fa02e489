"""Language, toxicity and quality classifiers; the pipeline."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import llm_data as data
from siftwell.llm import language, pieces, quality, toxicity, training

SF = "/root/testdata/sf0.1"
GIVEN = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


def spoken(rng, lang, n):
    syllables = {"en": ["the", "tion", "ing", "wh", "er"], "de": ["sch", "ung", "keit", "ä", "ein"], "fr": ["eau", "é", "que", "oi", "è"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def language_rows(n=240):
    rng = random.Random(0)
    return [(i, spoken(rng, ("en", "de", "fr")[i % 3], rng.randrange(3, 120)), ("en", "de", "fr")[i % 3]) for i in range(n)]


def test_language_of_held_out_texts(spark):
    rows = language_rows() + [(900, None, "en"), (901, "12 -- 34", "de"), (902, "", None), (903, spoken(random.Random(1), "de", 20000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'mine' as language", "'mine' as label", "'mine' as rank", "'mine' as raw")
    model = language.language_model(docs)
    got = {r["doc_id"]: r["language"] for r in language.predict_language(docs, model).collect()}
    held = [i for i, _, _ in rows[:240] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95 and held
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]


def test_language_looks_at_the_whole_text():
    rng = random.Random(3)
    model = language.fit_language([(t.encode(), lang) for _, t, lang in language_rows()])
    text = spoken(rng, "en", 200) + " " + spoken(rng, "de", 2000)
    assert language._predict(model, pa.array([text])).to_pylist()[0]["lang_pred"] == "de"
    x, row, length = language.windows(np.frombuffer(b"a" * 600, np.uint8), np.array([0, 0, 600]))
    assert row.tolist() == [1, 1, 1] and length.tolist() == [256, 256, 88] and (x[2, 88:] == 0).all()


def test_convolution_by_tables_is_a_convolution():
    model = language.fit_language([(t.encode(), lang) for _, t, lang in language_rows(60)], epochs=1)
    x, _, _ = language.windows(np.frombuffer(spoken(random.Random(2), "fr", 60).encode(), np.uint8), np.array([0, 200]))
    want = [max(sum(float(t[k, x[0, i + k], f]) for k in range(w)) for i in range(language.WINDOW - w + 1)) for w, t in zip(language.WIDTHS, model.tables) for f in range(language.FILTERS)]
    assert model.pooled(x[:1])[0] == pytest.approx(np.maximum(np.array(want) + model.bias, 0), abs=1e-4)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.predict_language(docs, language.language_model(docs)).first()["language"]["lang_pred"] == "und"
    assert language.predict_language(docs.limit(0), language.language_model(docs.limit(0))).count() == 0


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def labelled(spark, column):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r["doc_id"]: r[column] for r in labels.collect()}


@GIVEN
def test_quality_of_held_out_texts(spark):
    docs, labels, known = labelled(spark, "quality")
    rows = quality.score_quality(docs, quality.quality_model(docs, labels)).select("doc_id", "quality_score").collect()
    rows = [(r["quality_score"], known[r["doc_id"]]) for r in rows if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    score, y = (np.array(x) for x in zip(*rows))
    assert auc(score, y) > 0.97 and ((score >= 0.5) == y).mean() > 0.96


@GIVEN
def test_toxicity_of_held_out_texts(spark):
    docs, labels, known = labelled(spark, "toxic")
    model = toxicity.toxicity_model(docs, labels)
    rows = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).select("doc_id", "toxicity").collect()
    rows = [(r["toxicity"], known[r["doc_id"]]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    score, y = (np.array(x) for x in zip(*rows))
    assert auc(score, y) > 0.93 and ((score >= 0.5) == y).mean() > 0.95


def test_gradients_of_the_recurrent_unit():
    rng = np.random.default_rng(0)
    x, u = rng.normal(size=(5, 3, 3 * toxicity.STATE)), rng.normal(size=(toxicity.STATE, 3 * toxicity.STATE))
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    dout = rng.normal(size=(5, 3, toxicity.STATE))
    keep = []
    toxicity.gru(x, mask, u, keep)
    dx, du = toxicity.gru_back(dout, keep, mask, u)
    for array, grad in ((x, dx), (u, du)):
        for _ in range(10):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old = array[at]
            values = []
            for d in (1e-5, -1e-5):
                array[at] = old + d
                values.append((toxicity.gru(x, mask, u) * dout).sum())
            array[at] = old
            assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-4)


def test_windows_overlap_and_cover():
    index, row = toxicity.window_index(np.array([0, 0, 5, 37, 137]))
    assert row.tolist() == [1, 2, 3, 3, 3, 3]
    for r, (a, b) in ((1, (0, 5)), (2, (5, 37)), (3, (37, 137))):
        assert set(index[row == r].ravel()) - {-1} == set(range(a, b))


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (4, 1, 1)], [(1, 0, 0), (4, 1, 1), (5, 1, 0), (7, None, None), (99, 1, 1)]])
def test_classifiers_with_few_labels(spark, labels):
    docs = data.documents(spark, data.EDGE[:7] + data.EDGE[8:], clash=True)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for rows, name in ((quality.score_quality(docs, quality.quality_model(docs, known)), "quality_score"), (toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, known)), "toxicity")):
        got = rows.collect()
        assert len(got) == 11 and all(0 <= r[name] <= 1 for r in got)
        assert rows.limit(0).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs = data.documents(spark, [(i, f"text {i} " * 2000) for i in range(200)])
    known = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    once, again = (training.labelled_sample(docs.repartition(k), known, ~training.held_out("doc_id", 3, 1), 50) for k in (2, 5))
    assert once == again and 0 < len(once) <= 50
    assert {t.decode() for t, _ in once} <= {f"text {i} " * 2000 for i in range(200)}


def pipeline_tables(spark, folder):
    rng = random.Random(9)
    good = lambda n: " ".join(spoken(rng, "en", 8).capitalize() + "." for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["$$$", "###", "|", "!!"]) + spoken(rng, "en", 1).upper() for _ in range(n))
    passage = spoken(rng, "de", 30)
    rows = [(i, good(20)) for i in range(60)] + [(100 + i, junk(150)) for i in range(40)]
    clean = dict(rows[:60])
    copy = clean[3]
    words = clean[5].split()
    near = " ".join(f"Q{k}." if k % 29 == 28 else w for k, w in enumerate(words))
    rows += [(200, copy), (201, near), (202, good(10) + " " + passage + " " + good(5)), (203, clean[7] + "\n" + good(20)), (204, None), (None, good(9))]
    labels = [(i, int(i < 100), 0) for i, _ in rows[:100]]
    data.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, clean


@pytest.mark.skipif(not os.path.exists(pieces.MODEL_FILE), reason="the tokenizer file is not here")
def test_pipeline_as_plain_steps(spark, tmp_path):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rows, clean = pipeline_tables(spark, str(tmp_path))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(clean) <= set(got)
    for i, t in clean.items():
        assert got[i] == library.encode(t)
    assert not {100 + i for i in range(40)} & set(got)  # junk
    assert 200 not in got and 202 not in got  # a copy, a benchmark passage
    assert got[None] == library.encode(rows[-1][1])
    assert got[203] == library.encode(rows[-3][1].split("\n")[1])  # a block that document 7 has


def test_pipeline_stages_keep_columns_and_take_anything(spark, tmp_path):
    pipeline_tables(spark, str(tmp_path))
    for docs in (data.documents(spark, data.EDGE, clash=True), data.documents(spark, [])):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns) >= {"doc_id", "ids"}
        docs.count()
