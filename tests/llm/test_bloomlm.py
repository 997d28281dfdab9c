import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import bloomlm as B
from logsift.llm import queries as Q
from logsift.llm.common import held_out

from llm_data import SF_SMALL, nothing, odd, texts  # noqa: F401

END, START = b" end", b" start"


class Exact:
    """The same model with dictionaries in place of the filter."""

    def __init__(self, texts):
        self.one, self.two, self.texts = Counter(), Counter(), len(texts)
        for t in texts:
            w = [*(t or "").encode().lower().split(), END]
            self.one.update(w)
            self.two.update(zip([START, *w], w, strict=False))
        self.follow = Counter(v for v, _ in self.two)
        self.n, self.v = sum(self.one.values()), len(self.one)

    def score(self, text):
        w = [*(text or "").encode().lower().split(), END]
        base = smooth = 0.0
        stand = lambda c: 0 if c == 0 else (3 * 2 ** (c.bit_length() - 1) - 1) / 2
        for v, x in zip([START, *w], w, strict=False):
            p = (self.one[x] + 1) / (self.n + self.v + 1)
            base += math.log10(p)
            seen = self.texts if v == START else self.one[v]
            if seen:
                both = min(stand(self.two[v, x]), self.one[x], seen)
                f = min(max(stand(self.follow[v]), 1), seen)
                p = (both + f * p) / (seen + f)
            smooth += math.log10(p)
        return len(w), sum(self.one[x] > 0 for x in w), base, smooth


def test_query_follows_the_contract(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    exact = Exact([t for i, t in texts if not held[i]])
    rows = {r.doc_id: r for r in Q.op7_bloom_lm(spark, SF_SMALL).collect()}
    assert len(rows) == len(texts)
    gain = off = 0.0
    for i, t in texts:
        n, known, base, smooth = exact.score(t)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, exact.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
        # absent bigrams that seem present raise a score; too high a number of following words may lower it
        assert abs(r.score - smooth) <= 0.3 * n
        off += abs(r.score - smooth)
        gain += (r.score - r.base_score) * held[i]
    assert gain > 0 and off / sum(r.n_tokens for r in rows.values()) < 0.05


@pytest.mark.parametrize("segment_bytes,most_bytes", [(1 << 30, 1 << 30), (50_000, 1 << 30), (50_000, 100_000)])
def test_segments_and_passes_give_the_same(spark, texts, segment_bytes, most_bytes):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = B.train(docs.filter(~held_out("doc_id", 7, 2)), segment_bytes=segment_bytes)
    assert (model.totals.segments > 5) == (segment_bytes < 1 << 30)
    assert (len(list(B.groups(model, most_bytes))) > 1) == (most_bytes < 1 << 30)
    exact = Exact([t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2])
    got = {r.id: r for r in B.score(docs, model, most_bytes).collect()}
    total = 0
    for i, t in texts:
        n, known, base, smooth = exact.score(t)
        assert (got[i].n_tokens, got[i].n_known) == (n, known) and got[i].base_score == pytest.approx(base, rel=1e-9)
        total += abs(got[i].score - smooth)
    assert total / sum(exact.score(t)[0] for _, t in texts) < 0.05


def test_filter_counts_are_never_low():
    draw = np.random.default_rng(0)
    key = np.unique(draw.integers(0, 1 << 63, 20_000).astype(np.uint64))
    count = draw.zipf(1.6, len(key)).clip(1, 1 << 30)
    bits = B.build_filter(key, B.level(count))
    group = B.Group(B.Totals(1, 0, 0, 0), np.ones(1, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64), bits, np.zeros(1, np.int64), np.array([8 * len(bits)]))
    none = np.zeros(len(key), np.int64)
    assert (group.probe(key, none) >= B.level(count)).all()
    assert (group.probe(key, none) == B.level(count)).mean() > 0.95
    other = B.mix(key + np.uint64(12345))
    assert (group.probe(other, none) > 0).mean() < 0.04


def test_levels():
    assert B.level(np.array([0, 1, 2, 3, 4, 7, 8, 1 << 40])).tolist() == [0, 1, 2, 2, 3, 3, 4, 41]
    assert B.value(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_odd_rows(odd, nothing):
    rows = B.score_held_out(odd).collect()
    exact = Exact([r.text for r in odd.collect() if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 != 2])
    want = sorted((str(r.doc_id), *exact.score(r.text)[:2]) for r in odd.collect())
    assert sorted((str(r.id), r.n_tokens, r.n_known) for r in rows) == want
    assert all(r.train_tokens == exact.n for r in rows)
    assert B.score_held_out(nothing).collect() == []
    untrained = B.score(odd, B.train(nothing)).collect()
    assert len(untrained) == len(rows) and all(r.n_known == 0 and r.score == r.base_score == 0 for r in untrained)


def test_counts_beyond_32_bits():
    many = (1 << 32) + 5
    t = B.tokens(b"the")
    order = np.argsort(t)
    totals = B.Totals(1, 3 * many, 2, many)
    bits = np.zeros(8, np.uint8)
    group = B.Group(totals, np.ones(1, bool), t[order], np.array([many, many + 1])[order], bits, np.zeros(1, np.int64), np.array([64]))
    none = B.Group(totals, np.zeros(1, bool), t[:0], np.zeros(0, np.int64), bits[:0], np.zeros(1, np.int64), np.zeros(1, np.int64))

    class Shared:
        def __init__(self, value):
            self.value = value

    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["the"]})
    base = sum(math.log10((c + 1) / (totals.n + totals.vocabulary + 1)) for c in (many, many + 1))
    first = B._pass(Shared(group), False)(iter([batch]))
    for rows in (B._pass(Shared(group), True)(iter([batch])), B._pass(Shared(none), True)(first)):
        (got,) = (r for b in rows for r in b.to_pylist())
        assert got["n_known"] == 2 and got["base_score"] == pytest.approx(base, rel=1e-12)
