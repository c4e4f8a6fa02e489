"""Contamination, sharding, language model, pieces."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import llm_data as data
from siftwell.llm import arrays as ar
from siftwell.llm import kneser_ney, pieces, positional, sharding

sentencepiece = pytest.importorskip("sentencepiece")


def contaminated():
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz0"] + ["the", "of"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([3, 9, 10, 14, 30])))) for k in range(20)] + [(20, None), (21, ""), (22, "..."), (23, "solo"), (24, "a a a"), (25, items_text := "Éa the THE of the of")]
    rows = []
    for i in range(120):
        own = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(own) + 1)
            t = (items[rng.randrange(len(items))][1] or "").split()
            own[at:at] = t[rng.randrange(0, 2) :]
        rows.append((i, ", ".join(own).upper() if i % 4 == 0 else " ".join(own)))
    return rows + [(1000, "xx solo yy"), (1001, "a a a a"), (1002, items_text), (1003, "éa the the of the of")], items


def test_contamination_as_sliding_windows(spark):
    rows, items = contaminated()
    rows += [(i, t) for i, t in data.EDGE if i is not None and i not in (6,)][:0]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in positional.contamination(data.documents(spark, rows, clash=True), bench.selectExpr("*", "1 as wid", "2 as terms")).collect()}
    want = data.contamination(rows, items)
    assert set(got) == set(want) and any(h for _, h, _ in want.values())
    for i, (n, h, found) in want.items():
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, h, len(found), h > 0), i
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_contamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (None, "one two")], "item_id long, text string")
    got = positional.contamination(data.documents(spark, data.EDGE, clash=True), bench).collect()
    assert len(got) == len(data.EDGE)
    by = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got}
    assert by[1] == (0, 0, 0) and by[2] == (0, 0, 0) and by[5] == (4, 4, 1) and by[4] == (1, 0, 0)
    assert positional.contamination(data.documents(spark, []), bench).count() == 0
    clean = positional.contamination(data.documents(spark, data.EDGE), bench.limit(0)).collect()
    assert len(clean) == len(data.EDGE) and not any(r["contaminated"] for r in clean)


def test_proximity(spark):
    docs = data.documents(spark, [(1, "red x blue y green"), (2, "green blue red"), (3, "red one two three four five six blue green"), (4, "red blue")])
    windows = positional.test_windows(spark.createDataFrame([(1, "red blue green")], "item_id long, text string"))
    terms = windows.selectExpr("explode(terms) as w").selectExpr("w", "xxhash64(w) as h")
    index = positional.build_index(docs, terms)
    ids = {r["row"]: r["doc_id"] for r in index.filter("h is null").collect()}
    assert {ids[r["row"]] for r in positional.near_matches(index, windows, 5).collect()} == {1, 2}
    assert positional.phrase_matches(index, windows).count() == 0


def check_shards(rows, n, shards=8):
    assert len(rows) == n
    counts = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)]
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(c == list(range(len(c))) for c in counts)


def test_shards_are_even_and_keep_copies_together(spark):
    texts = [f"text {i % 300}" if i % 3 == 0 else f"lone {i}" for i in range(3000)] + ["hot text"] * 200
    rows = sharding.shard_documents(data.documents(spark, list(enumerate(texts)), clash=True)).collect()
    check_shards(rows, 3200)
    by = {}
    for r in rows:
        by.setdefault(r["text_crc32"], []).append(r["shard"])
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "rows"
    groups = [g for g in by.values() if len(g) > 1]
    assert sum(len(set(g)) > 1 for g in groups) <= 0.1 * len(groups)


def test_shards_of_one_group_larger_than_a_shard(spark):
    check_shards(sharding.shard_documents(data.documents(spark, [(i, "same" if i < 700 else f"t{i}") for i in range(1000)])).collect(), 1000)


def test_shards_edge_cases(spark):
    rows = sharding.shard_documents(data.documents(spark, data.EDGE, clash=True)).collect()
    check_shards(rows, len(data.EDGE))
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert sharding.shard_documents(data.documents(spark, [])).count() == 0


def test_links_of_any_kind_pull_documents_together(spark):
    vertices = spark.createDataFrame([(i,) for i in range(400)], "node long")
    links = spark.createDataFrame([(i, j, 1.0) for i in range(400) for j in (i // 4 * 4 + k for k in range(4)) if i != j], "src long, dst long, weight double")
    got = {r["node"]: r["shard"] for r in sharding.balance_shards(vertices, links, 4).collect()}
    cut = sum(got[i] != got[j] for i in range(400) for j in range(i // 4 * 4, i)) / 600
    assert cut < 0.5  # a random split cuts three quarters


def scored(spark, docs):
    from siftwell.llm import training

    held = training.held_out("doc_id", 10, 0)
    model = kneser_ney.fit_model(docs.filter(~held))
    return model, {r["doc_id"]: r for r in kneser_ney.score_texts(docs, model).collect()}


def test_language_model_as_the_formulas(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "a", "Bb", "cc", f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(0, 80)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n ")]
    model, got = scored(spark, data.documents(spark, rows, clash=True))
    for i, (n, known, total, base, score) in data.kneser_ney(rows).items():
        assert (got[i]["n_tokens"], got[i]["n_known"], model.n_tokens) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] == pytest.approx(score, rel=1e-9)
    assert sum(got[i]["score"] for i in got) > sum(got[i]["base_score"] for i in got)


def test_language_model_of_few_long_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(9000))) for i in range(3)]
    _, got = scored(spark, data.documents(spark, rows))
    for i, (_, _, _, base, score) in data.kneser_ney(rows).items():
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] == pytest.approx(score, rel=1e-9)


def test_language_model_edge_cases(spark):
    _, got = scored(spark, data.documents(spark, data.EDGE, clash=True))
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1 and got[7]["n_tokens"] == 30001
    model, got = scored(spark, data.documents(spark, []))
    assert not got and model.n_tokens == 0
    alone = kneser_ney.score_texts(data.documents(spark, [(1, "a b")]), model).first()
    assert (alone["n_tokens"], alone["n_known"], alone["score"], alone["base_score"]) == (3, 0, 0.0, 0.0)


MODEL = pytest.mark.skipif(not __import__("os").path.exists(pieces.MODEL_FILE), reason="the tokenizer file is not here")
HARD = ["", " ", "  a   b ", "\n\n x\n", "日本語のテキスト 😀 zoë", "a" * 500, "ab" * 3000 + " " * 40 + "end", "\t tab", "0123456789" * 30, "é" * 150, "The quick brown fox.", "x" * 97 + "y"]


@MODEL
def test_pieces_as_the_library():
    model, library = pieces.load_model(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    for lo, hi, offsets, raw in ar.text_slices(pa.array(HARD * 2), 700):
        ids, at = pieces.encode_slice(model, offsets, raw)
        texts = pieces.decode_slice(model, ids, at)
        for i in range(lo, hi):
            text, own = (HARD * 2)[i], ids[at[i - lo] : at[i - lo + 1]].tolist()
            assert own == library.encode(text) and texts[i - lo] == text == library.decode(own)


@MODEL
def test_pieces_in_spark(spark):
    docs = data.documents(spark, [(i, t) for i, t in enumerate(HARD)] + [(99, None)], clash=True)
    model = pieces.load_model()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    coded = docs.withColumn("coded", pieces.encoder(docs, model)("text"))
    back = coded.withColumn("back", pieces.decoder(docs, model)("coded")).collect()
    for r in back:
        assert r["back"] == r["text"] and (r["text"] is None or list(r["coded"]) == library.encode(r["text"]))
    found = {r["doc_id"]: r["d"] for r in docs.select("doc_id", pieces.digest(docs, model).alias("d")).collect()}
    for i, t in enumerate(HARD):
        ids = np.array(library.encode(t), "<i4")
        assert (found[i]["n_tokens"], found[i]["ids_crc32"], found[i]["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)
    assert found[99]["n_tokens"] == 0
    assert docs.limit(0).select(pieces.digest(docs, model)).count() == 0


def test_viterbi_finds_the_best_path():
    rng = random.Random(0)
    units = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "ca", "cab", "▁ab", "aa"]
    table = [("<unk>", 0.0, 2)] + [(p, -rng.uniform(1, 6), 1) for p in units]
    model = pieces.make_model(table, pieces.UNIGRAM)
    score = {p: s for p, s, _ in table[1:]}
    for n in range(1, 7):
        for letters in itertools.islice(itertools.product("abc", repeat=n), 0, None, 7):
            word = "▁" + "".join(letters)

            def best(s):
                return 0.0 if not s else max(score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score)

            raw = "".join(letters).encode()
            ids, _ = pieces.encode_slice(model, np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
            assert sum(table[i][1] for i in ids) == pytest.approx(best(word), abs=1e-4)
            assert pieces.decode_slice(model, ids, np.array([0, len(ids)])) == ["".join(letters)]
    ids, _ = pieces.encode_slice(model, np.array([0, 3]), np.frombuffer(b"azb", np.uint8))
    assert 0 in ids  # a character without a piece


def plain_viterbi(model, own, text):
    """(ids, score) by a search over the whole text; of equal paths the one whose last piece is longest."""
    text = (" " if model.dummy_prefix and text else "") + text
    missing = float(model.scores[model.key_ids].min() - 10)
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        found = []
        for n in range(1, min(end, model.longest) + 1):
            i = own.get(text[end - n : end])
            if i is not None or n == 1:
                found.append((best[end - n] + (float(model.scores[i]) if i is not None else missing), n, i))
        score, n, i = max(found, key=lambda f: f[:2])
        best.append(score)
        back.append((n, i))
    ids, end = [], len(text)
    while end:
        n, i = back[end]
        ids.append([i] if i is not None else [int(model.byte_ids[b]) for b in text[end - n : end].encode()])
        end -= n
    return [i for part in reversed(ids) for i in part], best[-1]


@MODEL
def test_viterbi_of_whole_texts(spark):
    model = pieces.load_model()
    sf = "/root/testdata/sf0.001/documents.parquet"
    texts = [r["text"] for r in spark.read.parquet(sf).limit(60).collect()] if __import__("os").path.exists(sf) else []
    texts += [t for _, t in data.EDGE[:7]] + ["日本語の文章は空白がない" * 40, "x" * 300 + "日本" + "qz" * 200, "\U0001F600" * 150, "a\nb  c\n\n d", None, ""]
    docs = data.documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["d"] for r in docs.select("doc_id", pieces.digest(docs, model).alias("d")).collect()}
    own = {model.pieces[i].decode(): i for i in model.key_ids.tolist()}
    for i, text in enumerate(texts):
        ids, score = plain_viterbi(model, own, (text or "").replace(chr(pieces.SPACE), " "))
        assert got[i]["n_viterbi"] == len(ids) and got[i]["viterbi_score"] == pytest.approx(score, abs=1e-3), i
        assert got[i]["viterbi_crc32"] == zlib.crc32(np.array(ids, np.int32).tobytes()), i
    assert len(got) == len(texts)


@MODEL
def test_long_words_are_cut_where_no_piece_reaches(monkeypatch):
    import sentencepiece

    model, library = pieces.load_model(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    for stretch in (pieces.STRETCH, 40):
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        for text in ("日本語の文章は空白がない" * 40, "abcdefgh" * 60 + "漢字" + "thethe" * 50, "\U0001F600é" * 200):
            raw = np.frombuffer(text.encode(), np.uint8)
            ids, _ = pieces.encode_slice(model, np.array([0, len(raw)]), raw)
            assert ids.tolist() == library.encode(text)
