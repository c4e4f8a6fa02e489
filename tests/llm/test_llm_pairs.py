"""Jaccard join, vector forest, components, line dedup."""

import random

import numpy as np
import pytest

import llm_data as data
from siftwell.llm import arrays as ar
from siftwell.llm import forest, jaccard, lines
from siftwell.llm.components import connected_components


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    links += [(300 + rng.randrange(80), 300 + rng.randrange(80)) for _ in range(70)]
    ids = {x for p in links for x in p}
    want = {i: r for i, r in data.smallest_reachable(ids, links).items() if i != r}
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["One two  one", None, "", "two\tONE", "xone", "on e", "é E"]
    seen = {}
    for lo, hi, offsets, raw in ar.text_slices(pa.array(texts), 5):
        h, starts, ends, at = ar.words(ar.LOWER[raw], offsets)
        for i in range(lo, hi):
            own = data.words(texts[i])
            got = h[at[i - lo] : at[i - lo + 1]].tolist()
            assert len(got) == len(own)
            for w, x in zip(own, got):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_as_all_pairs(spark, seed):
    rows = data.near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(data.documents(spark, rows, clash=seed == 1)).collect()}
    want = data.jaccard(rows)
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 8


def test_jaccard_links_are_true(spark):
    rows = data.near_copies(3, groups=2, copies=40)
    documents, links, _ = jaccard.jaccard_links(data.documents(spark, rows))
    sets = {r["cls"]: r["n_shingles"] for r in documents.collect()}
    found = links.collect()
    assert found and all(100 * r["common"] >= 75 * r["joined"] and r["joined"] == sets[r["a"]] + sets[r["b"]] - r["common"] for r in found)


def test_jaccard_edge_cases(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(data.documents(spark, data.EDGE, clash=True)).collect()]
    assert len(got) == len(data.EDGE)
    by = {i: (n, c) for i, n, c in got if i is not None}
    assert by[1] == by[1] and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[5] == (1, 5) and by[6] == (1, 5) and by[8][1] == 7
    assert jaccard.jaccard_components(data.documents(spark, [])).count() == 0


def vectors(seed=0, n=300, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, dims))
    x = base[rng.integers(0, 30, n)] + rng.normal(scale=0.12, size=(n, dims))
    rows = [(int(i) * 2, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    bad = [[float("nan")] + [0.0] * (dims - 1), [0.0] * dims, [float("inf")] * dims, [None] + [1.0] * (dims - 1), None, []]
    rows += [(1001 + 2 * k, v) for k, v in enumerate(bad)] + [(5001, rows[0][1]), (5003, rows[0][1]), (5005, [3 * v for v in rows[1][1]])]
    return rows


def brute_links(rows):
    fine = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(fine)
    links = [(a, b) for a in ids for b in ids if a < b and fine[a] @ fine[b] >= 0.9]
    return links, data.smallest_reachable([i for i, _ in rows], links)


def test_vectors_in_one_leaf_are_exact(spark):
    rows = vectors()
    links, component = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "x")
    for c in ("node", "leaf", "h"):
        df = df.selectExpr("*", f"'mine' as {c}")
    got = {r["vec_id"]: r for r in forest.vector_links(df, leaf=1000).collect()}
    assert len(got) == len(rows) and len(links) > 300
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(i in p for p in links), component[i], component[i] == i)


def test_vectors_recall_through_the_trees(spark):
    rows = vectors(1, 1200)
    links, _ = brute_links(rows)
    got = forest.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=32).collect()
    share = sum(r["n_links"] for r in got) / (2 * len(links))
    assert 0.9 <= share <= 1


def test_vectors_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.vector_links(empty).count() == 0
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [0.0, 1.0]), (None, [0.0, 2.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in forest.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == [(7, 1, 7), (7, 1, 7), (9, 1, 9), (None, 1, 9)]


def test_blocks_of_a_large_leaf(spark, monkeypatch):
    rows = vectors(2, 200)
    links, component = brute_links(rows)
    monkeypatch.setattr(forest, "BLOCK", 40)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=1000).collect()}
    assert got == {i: (sum(i in p for p in links), component[i]) for i, _ in rows}


def test_patience_alignment():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        last = (-1, -1)
        for i, j, n in lines.patience(a, b):
            assert i > last[0] and j > last[1] and a[i : i + n] == b[j : j + n] and n
            last = (i + n - 1, j + n - 1)
        assert sum(n for *_, n in lines.patience(a, a)) == len(a)
    assert lines.patience([1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 5]) == [(0, 1, 3), (4, 4, 2)]


def sentences(rng, n):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(6, 12))).capitalize() + "." for _ in range(n)]


def test_lines_go_from_the_later_document(spark):
    rng = random.Random(5)
    passage = sentences(rng, 8)  # over 50 words
    head, clean = "A header that many documents have.", "\n".join(sentences(rng, 12))
    first = "\n".join([head, *sentences(rng, 3), " ".join(passage), *sentences(rng, 2)])
    later_lines, later_rest = sentences(rng, 4), sentences(rng, 3)
    later = "\n".join([head, *later_lines]) + " " + " ".join(passage) + " " + " ".join(later_rest)
    rows = [(1, first), (2, clean), (3, later), (4, first), (5, None), (6, ""), (None, first), (7, "Short."), (7, "Short.")]
    got = [(r["doc_id"], r["deduped"]) for r in lines.dedup_lines(data.documents(spark, rows, clash=True)).collect()]
    assert len(got) == len(rows)
    by = {i: d for i, d in got}
    assert by[1]["text"] == first and by[2]["text"] == clean and by[None]["text"] == first and by[5]["text"] is None and by[7]["text"] == "Short."
    assert by[3]["text"] == "\n".join([head, *later_lines]) + " " + " ".join(later_rest)
    assert by[3]["n_removed"] == 8 and by[3]["removed_words"] == sum(len(s.split()) for s in passage)
    assert by[4]["text"] == "" and by[4]["n_removed"] == by[4]["n_lines"]


def test_lines_whose_first_holders_differ_or_that_are_short(spark):
    rng = random.Random(6)
    block, more = sentences(rng, 4), sentences(rng, 3)
    verse = [f"{a} {b}." for a, b in zip("abcdefghijkl", "mnopqrstuvwx")]  # lines of two words
    holders = [(k, "\n".join([*sentences(rng, 2), s])) for k, s in enumerate(block)]  # each line is first in a document of its own
    rows = [*holders, (10, "\n".join([*sentences(rng, 2), *block])), (11, "\n".join([*block, *more])), (12, "\n".join(verse)), (13, "\n".join([*verse, more[0]])), (14, "\n".join(verse))]
    by = {r["doc_id"]: r["deduped"] for r in lines.dedup_lines(data.documents(spark, rows)).collect()}
    assert all(by[i]["text"] == dict(rows)[i] for i in (0, 1, 2, 3, 10, 12))
    assert by[11]["text"] == "\n".join(more) and by[13]["text"] == more[0] and by[14]["text"] == ""


def test_lines_repeated_or_moved(spark):
    rng = random.Random(7)
    passage, moved, x, y, z, u, v = (sentences(rng, 4) for _ in range(7))
    rows = [(1, [*u, *passage, *v]), (2, [*x, *passage, *y, *passage, *z]), (3, [*moved, *u]), (4, [*sentences(rng, 1), *u, *moved]), (5, [*passage, *passage])]
    by = {r["doc_id"]: r["deduped"] for r in lines.dedup_lines(data.documents(spark, [(i, "\n".join(t)) for i, t in rows])).collect()}
    assert by[1]["n_removed"] == 0 and by[2]["text"] == "\n".join([*x, *y, *z]) and by[3]["text"] == "\n".join(moved)
    assert by[4]["text"] == rows[3][1][0] and by[5]["text"] == ""


def test_lines_that_go_are_those_of_common_blocks(spark):
    rng = random.Random(8)
    vocabulary = [" ".join(f"w{k}x{i}" for i in range(rng.randrange(1, 12))) for k in range(5)]
    texts = [[rng.randrange(5) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    size = [len(w.split()) for w in vocabulary]
    want = {}
    for d, own in enumerate(texts):
        gone = set()
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(size[k] for k in own[i:j]) >= 20 and any(own[i:j] == other[p : p + j - i] for other in texts[:d] for p in range(len(other))):
                    gone |= set(range(i, j))
        want[d] = "\n".join(vocabulary[k] for i, k in enumerate(own) if i not in gone)
    docs = data.documents(spark, [(d, "\n".join(vocabulary[k] for k in own)) for d, own in enumerate(texts)])
    got = {r["doc_id"]: r["deduped"]["text"].strip() for r in lines.dedup_lines(docs).collect()}
    assert got == want and sum(want[d] != "\n".join(vocabulary[k] for k in own) for d, own in enumerate(texts)) > 3


def test_lines_edge_cases(spark):
    got = lines.dedup_lines(data.documents(spark, data.EDGE)).collect()
    assert sorted((str(r["doc_id"]), r["deduped"]["text"] is None) for r in got) == sorted((str(i), t is None) for i, t in data.EDGE)
    assert lines.dedup_lines(data.documents(spark, [])).count() == 0


def plain_shared(own, words, other, least):
    """Lines of a common block, by trying all pairs of places."""
    gone = [False] * len(own)
    for i in range(len(own)):
        for j in range(len(other)):
            n = 0
            while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                n += 1
            if sum(words[i : i + n]) >= least:
                gone[i : i + n] = [True] * n
    return gone


@pytest.mark.parametrize("kinds", [3, 8, 40])
def test_alignment_finds_every_common_block(kinds):
    rng = random.Random(kinds)
    for _ in range(300):
        own, other = ([rng.randrange(kinds) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        if rng.random() < 0.5:  # moved and repeated blocks
            i = rng.randrange(len(own))
            other = other + own[i:] + own[:i] + own[i:]
        size = {h: rng.randrange(1, 9) for h in range(kinds)}
        words, theirs = (np.array([size[h] for h in x]) for x in (own, other))
        got = lines.shared_lines(np.array(own), words, np.array(other), theirs, 12)
        assert got.tolist() == plain_shared(own, words, other, 12)


def test_without_an_alignment_nothing_goes(spark, monkeypatch):
    own = np.arange(10)
    words = np.full(10, 5)
    assert lines.shared_lines(own, words, own, words, 20).all()
    monkeypatch.setattr(lines, "patience", lambda a, b: [])
    assert not lines.shared_lines(own, words, own, words, 20).any()


@pytest.mark.parametrize("dims", [64, 768, 1536])
def test_leaves_do_not_grow_with_the_dimension(dims):
    rng = np.random.default_rng(dims)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(4000, dims)))
    away = rng.normal(size=(300, dims))
    away = unit(away - (away * x[:300]).sum(axis=1, keepdims=True) * x[:300])
    cosine = rng.uniform(0.90, 0.92, (300, 1))
    every = np.concatenate([x, cosine * x[:300] + np.sqrt(1 - cosine**2) * away])
    grown = forest.fit_forest(every, len(every), leaf=16)
    assert grown.depth >= 8
    row, leaf = grown.leaves(every)
    assert len(row) / len(every) <= 30
    order = np.argsort(row, kind="stable")
    at = np.searchsorted(row[order], np.arange(len(every) + 1))
    held = [set(leaf[order][a:b]) for a, b in zip(at[:-1], at[1:])]
    assert np.mean([bool(held[i] & held[4000 + i]) for i in range(300)]) >= 0.95


def test_vectors_of_another_length_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.vector_links(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
