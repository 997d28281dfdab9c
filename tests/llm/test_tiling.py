import random

import pytest

from logsift.llm import queries as Q
from logsift.llm import tiling as G

from llm_data import SF_SMALL, nothing, odd, texts  # noqa: F401


def brute_tiles(a, b, n):
    """Greedy string tiling as published: over and over, all maximal matches of unmarked words, the longest are marked."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = n - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= n:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = mb[j : j + best] = [True] * best
                total += best


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_brute_force(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(draw.choice([2, 4, 40]))]
    item = draw.choices(words, k=draw.randrange(3, 30))
    pieces = [item[k : k + draw.randrange(2, 9)] for k in range(0, len(item), draw.randrange(3, 9))]
    draw.shuffle(pieces)
    doc = [w for p in pieces for w in [*p, *draw.choices(words + ["x", "y"], k=draw.randrange(3))]]
    index = G.build_index([(7, " ".join(item))], 3)
    i, j = G.seeds(index, " ".join(doc).encode())
    tiles = G.tile(G.maximal_matches(i, j, 3), 3)
    assert sum(n for _, _, n in tiles) == brute_tiles(doc, item, 3)
    assert all(doc[a : a + n] == item[b : b + n] for a, b, n in tiles)
    for k in (0, 1):
        used = [x for t in tiles for x in range(t[k], t[k] + t[2])]
        assert len(used) == len(set(used))


def test_query_equals_brute_force(spark, texts):
    bench = [(r.item_id, G.split_words(r.text.encode())) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = set()
    for d, t in texts:
        own = G.split_words((t or "").encode())
        grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        for i, w in bench:
            touched = {x for k in range(len(w) - 4) if tuple(w[k : k + 5]) in grams for x in range(k, k + 5)}
            if len(touched) >= 0.8 * len(w) and brute_tiles(own, w, 5) >= 0.8 * len(w):
                want.add((d, i))
    rows = Q.op10_tiling(spark, SF_SMALL).collect()
    assert want and {(r.doc_id, r.item_id) for r in rows} == want
    assert all(r.coverage == r.covered_words / r.item_words >= 0.8 for r in rows)


def test_reordered_passages_and_slices(spark):
    draw = random.Random(4)
    words = [f"t{i}" for i in range(5_000)]
    items = [(i, " ".join(draw.choices(words, k=40))) for i in range(30)]
    def turned(t):
        w = t.upper().split()
        return " ".join(w[20:] + ["BETWEEN"] + w[10:20] + ["!"] + w[:10])
    docs = [(i, " ".join(draw.choices(words, k=50)) + " " + turned(t) + ".") for i, t in items] + [(100 + i, " ".join(t.split()[:20])) for i, t in items]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 1_000):  # one slice, many slices
        got = G.contaminated(docs, bench, slice_bytes=size).collect()
        assert {(r.id, r.item_id) for r in got} == {(i, i) for i, _ in items}
        assert all(r.n_tiles == 3 and r.coverage == 1.0 for r in got)
    assert {r.doc_id for r in G.clean(docs, bench).collect()} == {100 + i for i, _ in items}


def test_odd_rows(spark, odd, nothing):
    long = next(r.text for r in odd.collect() if r.doc_id == 3)
    part = " ".join(long.split()[70_000:70_030])
    bench = spark.createDataFrame([(1, part), (1, part), (2, None), (3, ""), (4, "one two"), (None, "x y z u v")], "item_id long, text string")
    got = sorted((r.id, r.item_id) for r in G.contaminated(odd, bench).collect())
    assert got == [(3, 1), (3, 1), (4, 1), (4, 1)]
    assert G.clean(odd, bench).columns == odd.columns and G.clean(odd, bench).count() == odd.count() - 2
    assert G.contaminated(nothing, bench).collect() == [] and G.contaminated(odd, bench.limit(0)).collect() == []
    assert G.clean(nothing, bench).collect() == []


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 18])
def test_matches_do_not_depend_on_blocks_of_seeds(monkeypatch, block):
    monkeypatch.setattr(G, "SEEDS", block)
    for seed in range(15):
        draw = random.Random(seed)
        words = [f"w{i}" for i in range(draw.choice([1, 2, 5]))]
        items = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 30)))) for k in range(4)]
        doc = " ".join(draw.choices([*words, "x"], weights=[5] * len(words) + [1], k=draw.randrange(200))).encode()
        index = G.build_index(items, 3)
        i, j = G.seeds(index, doc)
        got = zip(*(x.tolist() for x in G.match_arrays(index, doc)), strict=True)
        assert sorted(got) == sorted(G.maximal_matches(i, j, 3))


def test_one_word_on_both_sides_holds_a_block_of_seeds(monkeypatch):
    """8,000 equal words against an item of 2,000: 16 million seeds, of which one block is held; the item is covered."""
    held = []
    blocks = G.seed_blocks
    monkeypatch.setattr(G, "seed_blocks", lambda *a: (held.append(len(i)) or (i, j) for i, j in blocks(*a)))
    index = G.build_index([(1, "same " * 2000)], 5)
    i, j, n = G.match_arrays(index, b"same " * 8000)
    assert sum(held) == 7996 * 1996 and max(held) < 2 * G.SEEDS
    assert len(n) == 7996 + 1996 - 1 and n.max() == 2000
    assert [x[2] for x in G.coverage(index, b"same " * 2500, 0.8)] == [2000]


def test_items_named_by_texts(spark, nothing):
    bench = spark.createDataFrame([("a", "one two three four five six"), (None, "seven eight nine ten eleven")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "seven eight nine ten eleven")], "doc_id long, text string")
    assert {(r.id, r.item_id) for r in G.contaminated(docs, bench).collect()} == {(1, "a"), (2, None)}
