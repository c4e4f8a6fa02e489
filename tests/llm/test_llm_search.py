"""Ranked search with shared sums, hard negatives by angle windows, page text; each against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm_data as data
from siftwell.llm import angles, pages, shared_terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# -- ranked search -------------------------------------------------------------


def term_list(text):
    return [data.lower(t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    lists = [(d, Counter(term_list(t))) for d, t in docs]
    lists = [(d, c) for d, c in lists if c]
    n_docs, total = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(w for _, c in lists for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in lists:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(term_list(text)) if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def a_search(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["é", "Ünï", "42", "日本"]
    say = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, say(rng.choice([1, 10, 60]))) for i in range(150)] + [(1000 + i, "w1 w2 w3") for i in range(60)]
    shared = [say(12) for _ in range(4)]
    items = [(i, rng.choice(shared) + " " + say(rng.choice([1, 6]))) for i in range(40)] + [(50, None), (51, ""), (52, "?!"), (53, "unknown"), (3, "w1"), (None, "w2 w2 W1")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed", [0, 1])
def test_search_as_a_plain_one(spark, seed):
    docs, items = a_search(seed)
    docs = docs + [(i, t) for i, t in data.EDGE]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("mine")).withColumn("key", F.lit(1))
    got = shared_terms.ranked_search(data.documents(spark, docs, clash=True), table, 10)
    assert collected(got) == plain_search(docs, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_search_in_blocks_and_slices_is_the_same(spark, monkeypatch):
    docs, items = a_search(2)
    monkeypatch.setattr(shared_terms, "HELD", 2000)
    found = shared_terms.ranked_search(data.documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 3, block_items=7, block_entries=60)
    assert collected(found) == plain_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    docs, items = a_search(3)
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert shared_terms.ranked_search(data.documents(spark, docs), none).collect() == []
    for rows in ([], [(1, None), (2, "...")]):
        found = shared_terms.ranked_search(data.documents(spark, rows), some)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_shared_sums_are_the_same_and_fewer():
    rng = np.random.default_rng(0)
    common = [rng.choice(60, 15, replace=False) for _ in range(3)]
    items = [np.unique(np.concatenate([common[i % 3], rng.choice(60, 4)])) for i in range(50)] + [np.array([7]), np.array([7])]
    sharing = shared_terms.share(items, 60)
    parts = rng.integers(0, 1 << 40, (60, 9))
    assert np.array_equal(sharing.totals(parts), np.stack([parts[s].sum(axis=0) for s in items]))
    assert len(sharing.left) > 10 and sharing.additions() < 0.4 * sum(len(s) - 1 for s in items)
    made = set(range(60))
    for level in sharing.levels:
        assert all({int(sharing.left[i - 60]), int(sharing.right[i - 60])} <= made for i in level)
        made |= set(map(int, level))
    assert made == set(range(60 + len(sharing.left)))


# -- hard negatives ------------------------------------------------------------


def plain_negatives(rows, anchor, scale=256, k=5):
    fine = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in fine if anchor(i)}:
        scored = [(-dot(v, w), j, other) for j, other, w in fine if j != i]
        for p, j, _ in sorted(x for x in scored if x[2] == lab)[:k]:
            near = sorted(x for x in scored if x[2] != lab and 80 * -p <= 100 * -x[0] <= 100 * -p)[:k]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(near, 1)]
    return sorted(out)


def negatives(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def labelled(seed, n=300, dims=12, spread=0.3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    x = base[rng.integers(0, 6, n)] + rng.normal(scale=spread, size=(n, dims))
    x[::3] = x[0]
    return [(int(i), int(rng.integers(0, 3)), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("seed", [0, 1])
def test_negatives_as_all_products(spark, seed, monkeypatch):
    monkeypatch.setattr(angles, "BLOCK_ROWS", 32)
    rows = labelled(seed) + [(400, None, [1.0] * 12), (500, 1, None), (600, 1, [float("nan")] * 12), (700, 1, [None] + [1.0] * 11), (None, 1, [1.0] * 12),
                             (800, 1, [0.0] * 12), (900, 1, [1.0, 2.0]), (1000, 2, []), (1001, 2, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("q", F.lit("mine")).withColumn("cell", F.lit(None))
    got = negatives(angles.hard_negatives(df, F.col("vec_id") % 20 == 0))
    assert got == plain_negatives(rows, lambda i: i % 20 == 0) and got


def test_negatives_in_blocks_of_anchors_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(angles, "ANCHOR_BYTES", 1000)
    rows = labelled(5, n=120)
    rows += [rows[20], (20, 2, rows[21][2]), (40, 1, rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert negatives(angles.hard_negatives(df, F.col("vec_id") % 20 == 0)) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(v) for v in rng.integers(-(2**40), 2**40, 3) // 2**11]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives(angles.hard_negatives(df, F.col("vec_id") % 10 == 0, scale=1))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0, scale=1)


def test_no_rows_and_no_anchors(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert angles.hard_negatives(spark.createDataFrame([], kind), F.col("vec_id") % 100 == 0).count() == 0
    assert angles.hard_negatives(spark.createDataFrame(labelled(1, 20), kind), F.col("vec_id") < 0).count() == 0


def test_score_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(4)
    q = np.floor(256 * np.concatenate([rng.normal(size=(5, 8))[rng.integers(0, 5, 200)] + rng.normal(scale=0.05, size=(200, 8)), np.zeros((2, 8)), rng.normal(size=(3, 8)) * 1e6]))
    norms = np.sqrt((q * q).sum(axis=1))
    at = angles._angles(q, norms, angles._spread_directions(q, 6))
    true = q @ q.T
    ruled_out = 0
    for i in range(len(q)):
        low, high = angles._bounds(at[i], norms[i], at, at, norms, norms)
        assert (low <= true[i]).all() and (true[i] <= high).all()
        low, high = angles._bounds(at[i], norms[i], at.min(axis=0), at.max(axis=0), norms.min(), norms.max())
        assert low <= true[i].min() and true[i].max() <= high
        ruled_out += (angles._bounds(at[i], norms[i], at, at, norms, norms)[1] < 0.5 * norms[i] * norms).sum()
    assert ruled_out > 0.2 * len(q) ** 2


# -- page text -----------------------------------------------------------------

PROSE = "Some words that make a paragraph, with a comma, and an end. "
NOISE = """<nav><ul><li><a href=/>Home</a></li><li><a href=/x>More, of, it</a></li></ul></nav><div class="ad">Buy, buy, buy, this thing today.</div>
<div id="cookie-notice"><p>We use cookies, many, many cookies, on this site, all the time.</p></div><aside><p>Aside, aside, aside, aside and aside.</p></aside>
<div class="sidebarRight"><p>Side text, that is, as long as prose, and longer, and longer still.</p></div>
<form action=/s><label>Search</label><input name=q><p>Find, what, you, look, for, here, in, the, form</p></form><footer>&copy; 2020, us</footer>"""
COMMENTS = '<section id="comments"><h3>Comments</h3>' + "".join(f'<article class="comment"><p>{PROSE * 4}</p></article>' for _ in range(6)) + "</section>"
PAGES = {
    "article": ("<html><head><title>T</title><style>p{}</style><script>var a='</p><p>x';</script></head><body>" + NOISE + "<article><h1>Head &amp; line</h1><p>One\n  two&nbsp;three.<p>Four <b>five<br>six</b>.</article>" + COMMENTS,
                "Head & line\nOne two three.\nFour five six."),
    "plain boxes": ('<body class="has-sidebar"><div id="header"><h2>Site</h2></div>' + NOISE + '<div class="wrap"><div class="post-content"><h1>T</h1>' + f"<p>{PROSE}</p><blockquote>{PROSE}</blockquote><ul><li>a</li><li>b, c</li></ul><table><tr><td>1<td>2</table><div class='ad-slot'>Ad</div><pre>x\n  y</pre>" + "</div></div>" + COMMENTS + "</body>",
                    "T\n" + "\n".join([PROSE.strip()] * 2) + "\na\nb, c\n1\n2\nx y"),
    "parts": ("<div><h1>Two parts</h1><div class=a><p>" + PROSE * 3 + "</p></div><div class=b><p>" + PROSE * 3 + "</p></div><p>" + PROSE + "</p><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div></div>" + NOISE,
              "Two parts\n" + "\n".join([(PROSE * 3).strip()] * 2 + [PROSE.strip()])),
    "header in article": ("<main><article><header><p>by me</p><h1>T</h1></header><p>Short.</p><footer>tags</footer><nav>next</nav></article></main>", "T\nShort."),
    "hidden": ("<article><p>Seen.</p><p style='display: none'>Not seen.</p><p hidden>Nor this.</p><div aria-hidden=true>Nor that.</div></article>", "Seen."),
    "only noise": (NOISE + "<div class='menu'><a href=1>x</a></div>", ""),
    "text alone": ("just text &lt;b&gt; 1 < 2 &#8364;", "just text <b> 1 < 2 €"),
    "broken": ("<p>a<p>b</div></b><div><i>c", "a\nb\nc"),
    "cut": ("<article><p>kept</p><a href='x", "kept"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    page, want = PAGES[name]
    assert pages.main_text(page) == want


def test_extract_keeps_rows_and_columns(spark):
    rows = [(i, f"http://x/{i % 3}", page) for i, (page, _) in enumerate(PAGES.values())] + [(None, None, None), (1, "u", None), (1, "u", "<p>again</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("score", F.lit(1))
    got = [(r["page_id"], r["url"], r["text"], r["score"]) for r in pages.extract_pages(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, u, pages.main_text(h), 1) for i, u, h in rows], key=repr)
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_time_grows_with_the_page():
    import time

    for part in ("<div>", "<b>", "<p>x", "<ul><li>x", "</div>", "<a href='", "<div><a>l</a>", "&lt", "<!--", "< "):
        start = time.perf_counter()
        pages.main_text("<article>" + part * 40_000)
        assert time.perf_counter() - start < 10, part
