import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import phrases as P
from logsift.llm import queries as Q

from llm_data import SF_MID, SF_SMALL, nothing, odd, odd_rows  # noqa: F401
from oracle import compare

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count, max_words, top, contained=100):
    """(lang, text) -> the rows of ``collocations``, by counting everything in Python integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if a >= min_count}
    longer = {}
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer.get((lang, w[i : i + k]), 0), a)
    by = {}
    for (lang, w), a in often.items():
        if len(w) > 1 and 100 * longer.get((lang, w), 0) < contained * a:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in by.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top])}


def found(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_equals_sql(spark, sf):
    assert compare(spark, "op13", *Q.ENTRIES["op13_misra_gries"], sf)[1] == []


def test_low_thresholds_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "text").repartition(7)
    rows = [tuple(r) for r in docs.collect()]
    for least, longest, top, contained in ((3, 5, 500, 100), (2, 4, 10**6, 60), (5, 2, 50, 100)):
        want = brute(rows, least, longest, top, contained)
        assert len(want) > 100 and found(P.collocations(docs, least, longest, top, contained)) == want


class Shared:
    def __init__(self, value):
        self.value = value


def test_blocks_parts_and_small_bitmaps_change_nothing(spark, monkeypatch):
    """Blocks that cut pieces, few hash partitions, a bitmap with many false positives, words forgotten in between."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "text").repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] or "und" for r in rows], "text": [r[1] or "" for r in rows]})

    def passes():
        """Both passes in this process: what they counted, and the mass of the first."""
        packs = list(P._summaries(1, 5, 2, Shared([]))(iter([batch])))
        merged = sorted((dict(zip(b.schema.names, r)) for b in packs for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r["part"], r["kind"]))
        names = packs[0].schema.names
        kept = P._merge_summaries(4)(iter([pa.RecordBatch.from_pylist(merged[i : i + 7], schema=packs[0].schema) for i in range(0, len(merged), 7)]))
        table = np.zeros(1 << P.KEY_BITS - 32, bool)
        for b in kept:
            for keys in b.column("keys").to_pylist():
                table[(np.frombuffer(keys, "<u8") >> np.uint64(32)).astype(np.int64)] = True
        known = P.Survivors(P.KEY_BITS - 32, np.packbits(table, bitorder="little"))
        lists = sorted((r for b in P._count(5, 2, Shared([known] * 5))(iter([batch])) for r in b.to_pylist()), key=lambda r: r["part"])
        schema = pa.schema([("part", pa.int64()), *((c, pa.list_(k)) for c, k in P._FOUND.items())])
        counts = P._merge_counts(4)(iter([pa.RecordBatch.from_pylist(lists[i : i + 3], schema=schema) for i in range(0, len(lists), 3)]))
        assert names[0] == "part"
        return sum(sum(b.column("mass").to_pylist()) for b in packs), {(r["lang"], r["phrase"]): r["n"] for b in counts for r in b.to_pylist()}

    want, whole = found(P.collocations(docs, 4, 5, 300)), passes()
    for name, value in (("BLOCK", 1001), ("SLICE", 64), ("REMEMBERED", 50), ("BITMAP_BITS", 13), ("LEAST_PARTS", 4), ("SLACK", 1), ("MERGED_ROWS", 40)):
        monkeypatch.setattr(P, name, value)
    assert passes() == whole and len(whole[1]) > 1000
    assert found(P.collocations(docs, 4, 5, 300)) == want == brute(rows, 4, 5, 300)


def test_summaries_keep_every_frequent_key_however_they_merge():
    draw = np.random.default_rng(3)
    for seed in range(20):
        stream = np.concatenate([draw.zipf(1.2, 4000) % 3000, draw.integers(0, 10**6, 4000)]).astype(np.uint64)
        threshold = int(draw.integers(2, 60))
        true = Counter(stream.tolist())
        s = P.MisraGries(len(stream) // threshold + 1)
        for part in np.array_split(draw.permutation(stream), 7):
            k, c = np.unique(part, return_counts=True)
            s.add(k, c.astype(np.int64))
            s.merge()
            assert len(s.keys) <= s.capacity
        kept = set(s.at_least(threshold).tolist())
        assert {k for k, n in true.items() if n >= threshold} <= kept and s.taken < threshold
        assert all(true[k] - s.taken <= n <= true[k] for k, n in zip(s.keys.tolist(), s.counts.tolist(), strict=True))


def test_odd_rows(spark, odd, nothing):
    rows = [("en", r[1]) for r in odd_rows()]
    assert found(P.collocations(odd, 3, 5, 100)) == brute(rows, 3, 5, 100)
    assert P.collocations(nothing, 3, 5, 100).collect() == []
    mixed = spark.createDataFrame([(None, "A b. a b; A\tB"), ("und", "a b"), ("fr", "a b\x0bc"), ("fr", None)], "lang string, text string")
    assert found(P.collocations(mixed, 2)) == brute([tuple(r) for r in mixed.collect()], 2, 5, 2000)
    assert {(r.lang, r.n) for r in P.frequent_phrases(mixed, 2).filter("words = 0").collect()} == {("und", 8), ("fr", 3)}


def test_one_phrase_in_a_third_of_all_rows(spark):
    docs = spark.range(30_000).selectExpr("'en' AS lang", "concat(CASE WHEN id % 3 = 0 THEN 'the same few words again' ELSE concat('w', id, ' x', id) END, ' ', id % 7) AS text").repartition(8)
    assert found(P.collocations(docs, 50)) == brute([tuple(r) for r in docs.collect()], 50, 5, 2000)
