from collections import Counter

import numpy as np
import pytest

from logsift.llm import kdtree as K
from logsift.llm import queries as Q

from llm_data import SF_MID, SF_SMALL
from oracle import compare


def brute(rows, k, is_query):
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))  # noqa: E731  scores end at 64 bits, and are ranked so
    out = Counter()
    for at, (i, q) in enumerate(rows):
        if is_query(i):
            scored = sorted((-cut(sum(a * b for a, b in zip(q, v, strict=True))), j) for own, (j, v) in enumerate(rows) if own != at and len(v) == len(q))
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k]))
    return out


def found(df):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_equals_sql(spark, sf):
    assert compare(spark, "op4", *Q.ENTRIES["op4_kd_tree"], sf)[1] == []


@pytest.mark.parametrize("shard_rows,block_rows", [(10_000, 256), (37, 5), (8, 1)])
def test_any_cut_into_shards_and_blocks(spark, shard_rows, block_rows):
    draw = np.random.default_rng(shard_rows)
    rows = [(i, draw.integers(-9, 9, 6).tolist()) for i in range(300)]
    rows += [(1000 + i, [1, 2, 3, 4, 5, 6]) for i in range(120)]  # one common vector: ties everywhere
    rows += [(2000 + i, [int(x) << 40 for x in draw.integers(-9, 9, 6)]) for i in range(10)]  # beyond doubles
    rows += [(3000, [1, 2]), (3050, [5, 5]), (3100, [7])]
    rows += [(50 * (i % 4), draw.integers(-9, 9, 6).tolist()) for i in range(40)] + [(100, [9] * 6)] * 7 + [(7, [9] * 6)] * 3  # ids and rows repeat
    df = spark.createDataFrame([(i, v, len(v), at) for at, (i, v) in enumerate(rows)], "id long, v array<long>, dim int, row long").repartition(3)
    got = found(K.top_k(df, df.filter("id % 50 = 0"), 5, shard_rows, block_rows))
    assert got == brute(rows, 5, lambda i: i % 50 == 0)


def test_bounds_hold():
    draw = np.random.default_rng(3)
    points = draw.integers(-100, 100, (1000, 8))
    tree = K.Tree(np.arange(1000), points, leaf=20)
    for q in draw.integers(-100, 100, (20, 8)):
        bound = tree.bounds(q)
        for (a, b), most, (left, _) in zip(tree.span, bound, tree.child, strict=True):
            assert (tree.points[a:b] @ q).max() <= most
            if left >= 0:
                assert b - a > 20
    assert len(tree.span) > 50


def test_propagated_bound_cuts_and_keeps_ties():
    points = np.array([[i] for i in range(100)])
    tree = K.Tree(np.arange(100), points, leaf=4)
    q = np.array([1])
    assert tree.search(-1, q, 3, -np.inf) == [(99, 99), (98, 98), (97, 97)]
    assert tree.search(-1, q, 3, 98.0) == [(99, 99), (98, 98)]
    assert tree.search(99, q, 3, 98.0) == [(98, 98)] and tree.search(-1, q, 3, 1000.0) == []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], "a"), (50, [0.5, nan], "b"), (100, None, "c"), (150, [], "d"), (200, [inf, 1.0], "e"), (250, [None, 1.0], "f"),
            (None, [1.0, 1.0], "g"), (1, [0.5, 0.25], "h"), (1, [0.5, 0.25], "h"), (2, [-0.001, 0.0], "i"), (2, [0.9, 0.9], "j"), (300, [3.0], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    v = K.quantise(df)
    good = [(0, (128, 64)), (1, (128, 64)), (1, (128, 64)), (2, (-1, 0)), (2, (230, 230)), (300, (768,))]
    assert Counter((r.id, tuple(r.v)) for r in v.collect()) == Counter(good)
    assert found(K.top_k(v, v.filter("id % 50 = 0"), 5)) == brute(good, 5, lambda i: i % 50 == 0)
    empty = K.quantise(df.limit(0))
    assert K.top_k(empty, empty).collect() == [] and K.top_k(v, empty).collect() == []


def test_repeated_ids_equal_sql(spark, tmp_path):
    """Rows that repeat an id with the same and with other vectors, queries among them, against SQL and brute force."""
    draw = np.random.default_rng(8)
    rows = [(int(i), draw.normal(size=4).astype("float32").tolist()) for i in np.r_[np.arange(200), draw.integers(0, 4, 60) * 50, [100] * 30]]
    rows += rows[:60]
    spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int").repartition(4).coalesce(1).write.parquet(f"{tmp_path}/sf")
    import glob
    import shutil
    shutil.copy(glob.glob(f"{tmp_path}/sf/*.parquet")[0], f"{tmp_path}/embeddings.parquet")
    assert compare(spark, "op4", *Q.ENTRIES["op4_kd_tree"], str(tmp_path))[1] == []
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    assert found(Q.op4_kd_tree(spark, str(tmp_path))) == brute(whole, 5, lambda i: i % 50 == 0)
