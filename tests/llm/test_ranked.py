import math
import re
from collections import Counter

import numpy as np
import pytest

from logsift.llm import queries as Q
from logsift.llm import ranked as R

from llm_data import SF_MID, SF_SMALL, nothing, odd, odd_rows  # noqa: F401
from oracle import compare

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    """Every document scored for every item; a row is known by its number in the ranking."""
    docs = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n, total = len(docs), sum(x for _, _, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c, size in docs:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out.update((item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k]))
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "id", "score").collect())


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_equals_sql(spark, sf):
    assert compare(spark, "op11", *Q.ENTRIES["op11_range_maximum"], sf)[1] == []


@pytest.mark.parametrize("limits", [{}, {"SEGMENT_DOCS": 7, "BEAM": 1}, {"SEGMENT_BYTES": 20_000, "SLICE_BYTES": 2000, "BEAM": 3}, {"VOCABULARY_BYTES": 0, "TEXT_BYTES": 50}, {"SEGMENT_POSTINGS": 300}])
def test_any_segments_slices_and_beams(spark, monkeypatch, limits):
    """Few words make many ties and near ties; some rows repeat."""
    draw = np.random.default_rng(7)
    text = lambda most: " ".join(f"W{x}" for x in draw.zipf(1.5, draw.integers(1, most)) % 60)
    docs = [(i, text(120)) for i in range(400)] + [(i, "w3 w4, w5") for i in range(500, 560)] + [(5, "w3 w4, w5"), (None, "W3 w4 w5"), (None, None), (900, "..."), (901, "Ünï w3-w3 \U0001f600w")]
    items = [(i, text(30)) for i in range(25)] + [(30, "w3 w4 w5"), (30, "W3 W4 w5 w5"), (31, None), (32, "unknown words"), (None, "w1 \U0001f600w"), (33, "")]
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    for k in (1, 10):
        assert found(R.ranked(d, q, k)) == brute(docs, items, k)


def test_intervals_are_pruned_and_bounds_hold():
    draw = np.random.default_rng(1)
    n = 3000
    lists = {f"t{t}".encode(): np.sort(draw.choice(n, size, replace=False)) for t, size in enumerate((2500, 900, 300, 40, 5))}
    lengths = draw.integers(5, 500, n)
    names = sorted(lists)
    seg = {"ids": list(range(n)), "lengths": lengths.tolist(), "terms": names, "df": [len(lists[t]) for t in names], "docs": np.concatenate([lists[t] for t in names]).astype("<i4").tobytes(), "tf": draw.integers(1, 20, sum(map(len, lists.values()))).astype("<i4").tobytes()}
    weights = {t: 1000 + 900 * i for i, t in enumerate(names)}
    index = R.Index(seg, weights, n, int(lengths.sum()))
    for _ in range(300):
        a, z = sorted(draw.integers(0, len(index.impact) + 1, 2).tolist())
        t = names[int(draw.integers(0, 5))]
        a, z = max(a, index.range[t][0]), min(z, index.range[t][1])
        at = index.best(np.array([[a]]), np.array([[z]]))[0, 0]
        assert at == (a + index.impact[a:z].argmax() if z > a else -1)
    whole = np.zeros(n, np.int64)
    for t in names:
        lo, hi = index.range[t]
        whole[index.doc[lo:hi]] += index.impact[lo:hi]
    want = sorted(((-int(s), d) for d, s in enumerate(whole) if s))[:10]
    visited = []
    bounds = index._bounds
    index._bounds = lambda lo, hi: visited.append(len(lo)) or bounds(lo, hi)
    assert [(-s, d) for s, d in index.search(names, 10, 0)] == want
    assert sum(visited) < 2 * n  # far fewer than the documents have intervals
    assert index.search(names, 10, -want[3][0]) == [(-s, d) for s, d in want if s <= want[3][0]]


def test_lengths_beyond_64_bits(spark):
    seg = {"ids": [1, 2], "lengths": [10**9, 1], "terms": [b"a"], "df": [2], "docs": np.array([0, 1], "<i4").tobytes(), "tf": np.array([5, 1], "<i4").tobytes()}
    index = R.Index(seg, {b"a": 7}, 10**11, 10**13)
    assert index.impact.tolist() == [7 * (5 * 10**9 // (5000 + 8 * (10 + 90 * 10**20 // 10**13))), 7 * (10**9 // (1000 + 8 * 10))]


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, None)], "item_id long, text string")
    assert found(R.ranked(odd, items, 10)) == brute([r[:2] for r in odd_rows()], [(1, "w1 w2 w3")], 10)
    assert R.ranked(nothing, items).collect() == [] and R.ranked(odd, items.limit(0)).collect() == []
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", None)], "doc_id string, text string")
    keyed = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [tuple(r) for r in R.ranked(named.unionByName(spark.createDataFrame([("z", "other")], named.schema)), keyed).orderBy("rank").select("item_id", "rank", "id").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_one_text_in_a_third_of_all_rows(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 1 THEN 'common words here' ELSE concat('w', id % 50, ' words ', id % 9) END AS text").repartition(4)
    items = [(1, "common words here"), (2, "w4 words 4")]
    got = R.ranked(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute([tuple(r) for r in docs.collect()], items, 10)
