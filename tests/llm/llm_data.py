"""Small tables and plain versions of the operators to compare with."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

# Names that operators use inside; a table may have them as columns of its own.
CLASHING = ["node", "label", "cls", "h", "row", "deduped", "quality_score", "gone", "ids", "rank", "_id", "fp", "tokens", "language", "toxicity", "score", "n"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, clash=False):
    """A documents table of (doc_id, text) rows, by turns with columns of clashing names."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        for c in CLASHING:
            df = df.withColumn(c, F.lit("mine"))
    return df


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "one two three four"), (6, "one two three four"),
        (7, LONG), (8, LONG + " end"), (None, "a text without an id and some words to go with it"), (9, "Ünïcode Wörter, 日本 und 😀 0123"), (10, "!!! ???")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def near_copies(seed=0, groups=12, copies=6, size=60):
    """(doc_id, text): copies of texts with a few words changed, exact copies, and a common passage."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(25), []
    for _ in range(groups):
        base = text(size)
        for k in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((passage if k == 1 else []) + own)
    rows += [text(40) + passage for _ in range(10)] + [rows[3], rows[3], ["x"], ["x"], text(3)]
    rng.shuffle(rows)
    return [(i * 3, " ".join(r).title() if i % 5 == 0 else " ".join(r)) for i, r in enumerate(rows)]


def smallest_reachable(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def jaccard(rows):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    component = smallest_reachable(ids, links)
    return {i: (len(sets[i]), component[i]) for i in ids}


def contamination(rows, items):
    """{doc_id: (n_words, n_hit, items)} by sliding every window over every text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(item))
    out = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def kneser_ney(rows, mod=10):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score, score)} straight from the formulas."""
    tokens = {i: words(t) + ["</s>"] for i, t in rows}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % mod]
    one, two = Counter(), Counter()
    for i in learn:
        one.update(tokens[i])
        two.update(zip(["<s>", *tokens[i]], tokens[i]))
    n, v = sum(one.values()), len(one)
    after, total, before = defaultdict(Counter), Counter(), Counter()
    for (a, b), c in two.items():
        after[a][min(c, 3)] += 1
        total[a] += c
        before[b] += 1

    def discounts(counts):
        k = Counter(counts)
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0.5
        d = [1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        return [0] + [min(max(x, 0.05), top) for x, top in zip(d, (1, 2, 3))]

    d2, d1 = discounts(two.values()), discounts(before.values())
    pairs, kinds = sum(before.values()), Counter(min(c, 3) for c in before.values())
    rest = sum(d1[k] * kinds[k] for k in (1, 2, 3)) / pairs if pairs else 1.0

    def p1(w):
        return max(before[w] - d1[min(before[w], 3)], 0) / max(1, pairs) + rest / (v + 1)

    def p2(a, w):
        if not total[a]:
            return p1(w)
        c = two[(a, w)]
        return max(c - d2[min(c, 3)], 0) / total[a] + sum(d2[k] * after[a][k] for k in (1, 2, 3)) / total[a] * p1(w)

    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out[i] = (len(t), sum(one[w] > 0 for w in t), n, base, sum(math.log10(p2(a, w)) for a, w in zip(["<s>", *t], t)))
    return out
