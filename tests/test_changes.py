"""Updates in place: sharded documents, index segments, the store of vectors."""

import pytest
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators import embed, lexical, segments
from siftwell.operators.analyze import Analyzer
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import define_index, save_index
from siftwell.sources import documents as src

FIRST = [(i, f"title {i % 4}", " ".join(f"w{(i * k) % 23}" for k in range(1, 9)), "c") for i in range(1, 61)] + [(90, "empty", "", "c"), (91, "...", "!!!", "c")]
QUERIES = [(1, "w3 w5 title"), (2, "w7"), (3, "new words w1"), (4, "empty")]


def changed(rows, upserts, deletes):
    now = {r[0]: r for r in rows} | {r[0]: r for r in upserts}
    return [r for i, r in sorted(now.items()) if i not in deletes]


ROUNDS = [
    ([(3, "title x", "new words here", "c"), (70, "added", "w1 w2 w3 w3", "c"), (90, "not empty", "w5", "c")], [5, 6, 999]),
    ([(3, "title y", "w7 again new", "c"), (5, "back", "w7 w7", "c"), (71, "both", "w1", "c")], [70, 71, 91]),
    ([], list(range(1, 31))),
]


@pytest.fixture(scope="module")
def base(spark):
    docs = src.inline_documents(spark, FIRST).drop("embedding")
    index = save_index(docs, runtime.scratch_path(spark, "changes-base"), "changes_base", Analyzer(), term_buckets=2, shards=3)
    return docs, index


def frames(spark, upserts, deletes):
    kind = "id long, title string, content string, category string"
    new = src.derive_columns(spark.createDataFrame(upserts, kind)).select(*src.inline_documents(spark, FIRST[:1]).drop("embedding").columns)
    return new, spark.createDataFrame([(i,) for i in deletes], "id long")


def stats(index):
    return {r["term"]: (r["doc_freq"], round(r["idf"], 9)) for r in index.term_stats.collect()}, tuple(round(x, 9) for x in index.corpus_stats.select("n_docs", "n_tokens", "avg_len").first())


def test_segments_are_an_index_of_the_documents_as_they_are(spark, base):
    docs, index = base
    batch = QueryBatch.measure(spark.createDataFrame(QUERIES, "query_id long, query string"))
    home = runtime.scratch_path(spark, "changes")
    rows, table = FIRST, segments.write_sharded(docs, f"{home}/docs", 5)
    live = segments.open_segments(index, f"{home}/segments")
    assert live.segments == () and live.merged() is index
    for upserts, deletes in ROUNDS:
        new, gone = frames(spark, upserts, deletes)
        live = live.apply(table, new, gone)
        table = segments.update_documents(table, f"{home}/docs", 5, new, gone)
        rows = changed(rows, upserts, deletes)
        assert sorted((r["id"], r["title"], r["content"]) for r in table.collect()) == [r[:3] for r in rows]
        want = define_index(src.inline_documents(spark, rows), Analyzer(), term_buckets=2)
        for seen in (live, live.fold(), segments.open_segments(index, f"{home}/segments")):
            got = seen.merged()
            assert stats(got) == stats(want)
            assert sorted(map(tuple, got.postings.select("term", "doc_id", "tf", "doc_len").collect())) == sorted(map(tuple, want.postings.select("term", "doc_id", "tf", "doc_len").collect()))
        ranked = [sorted((r["query_id"], r["rank"], r["doc_id"]) for r in lexical.bm25_topk(lexical.match_scores(i, batch), 5).collect()) for i in (live.merged(), want)]
        assert ranked[0] == ranked[1]
    assert len(live.fold().segments) == 1


def test_scores_over_segments_leave_the_base_where_it_lies(spark, base, capsys):
    """What is shuffled by document is the changes; the buckets of the base serve as they are."""
    docs, index = base
    live = segments.open_segments(index, f"{runtime.scratch_path(spark, 'changes-plan')}/segments").apply(docs, *frames(spark, *ROUNDS[0]))
    batch = QueryBatch.measure(spark.createDataFrame(QUERIES, "query_id long, query string"))
    lexical.match_scores(live.merged(), batch).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and "Bucketed: true" in plan


def test_only_touched_shards_are_written(spark, base, tmp_path):
    docs, _ = base
    path = str(tmp_path / "docs")
    segments.write_sharded(docs, path, 8)
    files = lambda: {str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.parquet")}
    before = files()
    new, gone = frames(spark, [(3, "t", "c", "x")], [])
    touched = docs.filter("id = 3").select(segments.shard_of("id", 8)).first()[0]
    segments.update_documents(docs, path, 8, new, gone)
    changed_files = before ^ files()
    assert changed_files and all(f"/shard={touched}/" in f for f in changed_files)


def test_rows_that_stay_are_written_once(spark, base, tmp_path, monkeypatch):
    docs, _ = base
    path, aside, write = str(tmp_path / "docs"), [], runtime.write_scratch
    table = segments.write_sharded(docs, path, 4)
    monkeypatch.setattr(runtime, "write_scratch", lambda df, name: aside.append(write(df, name)) or aside[-1])
    new, gone = frames(spark, [(3, "t", "c", "x")], [4])
    table = segments.update_documents(table, path, 4, new, gone)
    assert table.count() == len(FIRST) - 1
    assert sum(df.count() for df in aside if "content" in df.columns) == 1


def test_an_emptied_shard(spark, base, tmp_path):
    docs, _ = base
    path = str(tmp_path / "docs")
    table = segments.write_sharded(docs, path, 64)
    one = table.first()["id"]
    new, gone = frames(spark, [], [one])
    left = segments.update_documents(table, path, 64, new, gone)
    assert sorted(r["id"] for r in left.collect()) == sorted({r[0] for r in FIRST} - {one})


def model(refused, calls):
    def run(texts):
        if any(r in t for t in texts for r in refused):
            raise ValueError("refused")
        return [[float(len(t)), float(t.count("w"))] for t in texts]
    return run


def test_embedding_continues_where_a_run_ended(spark, tmp_path):
    path = str(tmp_path / "vectors")
    docs = src.inline_documents(spark, FIRST).select("id", "full_text").unionByName(spark.createDataFrame([(500, None)], "id long, full_text string"))
    assert embed.stored_embeddings(docs, path).filter("embedding is not null").count() == 0
    n = len(FIRST)
    bad = sum("w22" in c for _, _, c, _ in FIRST)
    assert embed.resume_embeddings(docs, path, model(["w22"], []), share_rows=20) == {"wanted": n, "kept": n - bad, "failed": bad}
    assert embed.resume_embeddings(docs, path, model(["w22"], [])) == {"wanted": bad, "kept": 0, "failed": bad}
    changed_docs = docs.withColumn("full_text", F.when(F.col("id") == 1, "other").otherwise(F.col("full_text")))
    assert embed.resume_embeddings(changed_docs, path, model([], [])) == {"wanted": bad + 1, "kept": bad + 1, "failed": 0}
    assert embed.resume_embeddings(changed_docs, path, model([], [])) == {"wanted": 0, "kept": 0, "failed": 0}
    got = {r["doc_id"]: r["embedding"] for r in embed.stored_embeddings(changed_docs, path).collect()}
    assert got[1] == [5.0, 0.0] and got[500] is None and len(got) == n + 1 and sum(v is not None for v in got.values()) == n
    old = {r["doc_id"]: r["embedding"] for r in embed.stored_embeddings(docs, path).collect()}
    assert old[1] == [float(len("title 1 " + FIRST[0][2])), 8.0]
