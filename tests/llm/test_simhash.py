import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from logsift.llm import queries as Q
from logsift.llm import simhash as S
from logsift.llm.graph import components

from llm_data import SF_SMALL, nothing, odd, texts  # noqa: F401

UP = {c: c + 32 for c in range(65, 91)}


def brute_print(text, n=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UP)) if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    bits = (np.array(hs, np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return sum(1 << i for i, c in enumerate(bits.sum(axis=0).tolist()) if 2 * c > len(hs))


def brute_components(prints, max_bits=2):
    ids = sorted(prints, key=lambda i: (i is None, i))
    f = np.array([prints[i] for i in ids], np.uint64)
    label = list(range(len(ids)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= max_bits):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def test_query_equals_brute_force(spark, texts):
    prints = {i: brute_print(t) for i, t in texts}
    comp = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op3_simhash(spark, SF_SMALL).collect()}
    assert got == {i: ("%016x" % prints[i], comp[i]) for i in prints}


def test_code_covers():
    """Every 23-bit word has exactly one code word within the radius, and syndromes tell code words."""
    leaders = {}
    from itertools import combinations
    for n in range(4):
        for at in combinations(range(23), n):
            e = sum(1 << k for k in at)
            assert leaders.setdefault(S._remainder(e), e) == e
    assert len(leaders) == 2**11


@pytest.mark.parametrize("parts", [1, 9])
def test_links_find_all_near_pairs(spark, parts):
    draw = random.Random(parts)
    base = [draw.getrandbits(64) for _ in range(40)]
    points = set(base)
    for b in base:
        x = b
        for _ in range(12):
            x ^= sum(1 << draw.randrange(64) for _ in range(draw.randrange(1, 4)))
            points.add(x % 2**64)
    prints = {i: p for i, p in enumerate(sorted(points))}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in points}
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(parts)
    links = [(r.a, r.b) for r in S.links(df, 2).collect()]
    assert all(bin(signed[a] ^ signed[b]).count("1") >= 1 for a, b in links)
    ids = {p: i for i, p in prints.items()}
    label = brute_components(prints)
    parent = {i: i for i in prints}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(ids[signed[a]]), find(ids[signed[b]])
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in prints} == label


def test_dense_group_gives_no_pairs(spark):
    """All 2,081 fingerprints within two bits of one: links stay in proportion to fingerprints and anchors."""
    from itertools import combinations
    ball = [0] + [1 << i for i in range(63)] + [1 << i | 1 << j for i, j in combinations(range(63), 2)]
    df = spark.createDataFrame([(x,) for x in ball], "fp long")
    links = S.links(df, 2)
    n = links.count()
    assert n <= 70 * len(ball)
    assert {r.label for r in components(links).collect()} == {0}


def test_odd_rows(odd, nothing):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = lambda i: {(r.fp, r.component) for r in rows if r.id == i}
    assert of(5) == {next(iter(of(5)))} and of(5) <= of(6)
    assert {r.component for r in rows if r.id in (3, 4)} == {3}
    assert {r.fp for r in rows if r.id in (1, 2, 7, 8)} == {0} and {r.component for r in rows if r.fp == 0} == {1}
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len({(r.component, r.kept_key) for r in rows})
    assert S.near_duplicates(nothing).collect() == [] and S.one_of_each(nothing).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(7, 7), (3, 2), (200, 201), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_looked_up_links_equal_compared_ones(monkeypatch):
    draw = np.random.default_rng(6)
    for n, flips in ((1, 0), (40, 2), (400, 4), (700, 9)):
        centre = np.uint64(draw.integers(0, 1 << 63))
        masks = [sum(1 << int(k) for k in draw.choice(64, draw.integers(0, flips + 1), replace=False)) for _ in range(n)]
        fp = np.array([centre ^ np.uint64(m) for m in masks], np.uint64).view(np.int64)
        want = S._forest(fp, np.array([0]), np.array([n]), np.array([n]), 2)
        got = S._forest_by_lookup(fp, 2)
        assert (got == want).all()


def test_thousands_of_near_copies_at_one_anchor():
    """20,000 different fingerprints around one live at one anchor: their links are looked up, in time that follows their number."""
    draw = np.random.default_rng(2)
    near = {0x123456789ABCDEF}
    while len(near) < 20_000:
        near.add(0x123456789ABCDEF ^ sum(1 << int(k) for k in draw.choice(64, 4, replace=False)))
    fps = np.array(sorted(near), np.uint64).view(np.int64)
    began = time.time()
    batch = pa.RecordBatch.from_pydict({"anchor": np.zeros(len(fps), np.int64), "away": np.zeros(len(fps), np.int8), "fp": fps})
    out = pa.Table.from_batches(S._links(2)(iter([batch])))
    assert time.time() - began < 120 and 10_000 < out.num_rows < len(fps)
    few = fps[:3000]
    assert (S._forest_by_lookup(few, 2) == S._forest(few, np.array([0]), np.array([3000]), np.array([3000]), 2)).all()
