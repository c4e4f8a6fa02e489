import pytest
from pyspark.sql import functions as F

from siftwell.plans import search
from siftwell.sources import documents as src

FILES = {
    "a-good.md": "---\ntitle: First: the one\ncategory: tip\n---\n\n  Body text here.\n",
    "b-plain.md": "---\ntitle: No category\n---\nBody",
    "c-twice.md": "---\ntitle: old\ntitle: new\ncategory:\n---\nBody --- with a marker",
    "d-noopen.md": "title: x\n---\nBody",
    "e-noclose.md": "---\ntitle: x\nBody",
    "f-notitle.md": "---\ncategory: tip\n---\nBody",
    "g-early.md": "---\ntitle: cut --- here\n---\nBody",
    "h-colon.md": "---\n: nothing\ntitle: t\n---\nBody",
    "README.md": "---\ntitle: skipped\n---\nBody",
    "ReadMe-too.md": "---\ntitle: skipped\n---\nBody",
    "notes.txt": "---\ntitle: skipped\n---\nBody",
}


@pytest.fixture()
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_folder_load(spark, folder):
    docs, bad = search.load_corpus(spark, folder)
    got = {r["source_file"]: r for r in docs.collect()}
    assert sorted(got) == ["a-good.md", "b-plain.md", "c-twice.md", "g-early.md", "h-colon.md"]
    a = got["a-good.md"]
    assert (a["title"], a["category"], a["content"]) == ("First: the one", "tip", "Body text here.")
    assert a["full_text"] == "First: the one Body text here." and a["word_count"] == 6
    assert got["b-plain.md"]["category"] == "general"
    assert (got["c-twice.md"]["title"], got["c-twice.md"]["category"]) == ("new", "general")
    assert got["c-twice.md"]["metadata"] == {"title": "new", "category": ""}
    assert got["g-early.md"]["title"] == "cut"
    assert got["g-early.md"]["content"] == "here\n---\nBody"
    assert [got[n]["id"] for n in sorted(got)] == [1, 2, 3, 4, 5]
    errors = {r["source_file"]: r["error"] for r in bad.collect()}
    assert errors == {
        "d-noopen.md": "missing front matter", "e-noclose.md": "missing closing marker", "f-notitle.md": "missing title",
    }


def test_packed_load_is_the_same(spark, folder, tmp_path):
    deep = tmp_path / "sub" / "deeper"
    deep.mkdir(parents=True)
    (deep / "z-late.md").write_text("---\ntitle: z\n---\ndeep")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.md").write_text(FILES["a-good.md"])
    (tmp_path / "sub" / "bytes.md").write_bytes(b"---\ntitle: b\n---\n\xff\xfe")
    docs, bad = search.load_corpus(spark, folder, packed=True)
    flat, flat_bad = search.load_corpus(spark, folder)
    rows = {r["source_file"]: (r["title"], r["category"], r["content"]) for r in docs.collect()}
    assert rows == {r["source_file"]: (r["title"], r["category"], r["content"]) for r in flat.collect()} | {
        "z-late.md": ("z", "general", "deep"), "bytes.md": ("b", "general", "\ufffd\ufffd")}
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, flat_bad.collect()))
    listed = src.list_markdown(spark, folder)
    assert {r["source_file"]: r["size"] for r in listed.collect()}["a-good.md"] == len(FILES["a-good.md"])
    assert src.read_packed(listed, split_bytes=src.OPEN_BYTES * 3).rdd.getNumPartitions() == 4


def test_written_files_come_back(spark, tmp_path):
    rows = [(f"f{i}.md", f"---\ntitle: t{i}\n---\nbody é {i}") for i in range(50)]
    src.write_markdown(spark.createDataFrame(rows, "source_file string, value string"), str(tmp_path / "out"), per_folder=20)
    back = src.read_packed(src.list_markdown(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert len([p for p in (tmp_path / "out").iterdir()]) == 3


def test_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "readme.md").write_text("x")
    with pytest.raises(ValueError, match="no documents"):
        search.load_corpus(spark, str(tmp_path))


def test_keys_are_consecutive_in_order_over_many_partitions(spark):
    rows = spark.range(1000).select(F.concat(F.lit("f"), F.hex((F.col("id") * 7919) % 1000)).alias("path")).repartition(13)
    got = src.assign_keys(rows, ["path"]).orderBy("path").collect()
    assert [r["id"] for r in got] == list(range(1, 1001))


def test_tables_round_trip(spark, docs, tmp_path):
    back = src.write_documents(docs, str(tmp_path / "docs"), "siftwell_test_docs", 3)
    assert back.count() == docs.count()
    assert sorted(back.columns) == sorted(docs.columns)
    results = docs.select(F.lit("bm25").alias("method"), F.col("id").alias("doc_id"))
    src.write_results(results, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("method = 'bm25'").count() == 15


def test_keyword_mass_of_the_stuffed_page(docs):
    mass = {r["id"]: r["n"] for r in src.count_words_of(docs, "database").collect()}
    assert max(mass, key=mass.get) == 11 and mass[11] == 12
