"""Language-model scoring with a log-frequency Bloom filter.

A bigram seen c times is in the filter at levels 1 to 1 + floor(log2 c), so its quantised count is found by probing
level after level until one is missing. The numbers of different words that follow a word are kept the same way.
Smoothing is Witten-Bell's: P(w | v) = (c(v w) + T(v) P(w)) / (c(v) + T(v)) with P(w) = (c(w) + 1) / (N + V + 1), where T(v) counts
the different words after v. Word counts are exact, in sorted tables of 64-bit word hashes.

What is counted grows with the corpus and so does the number of segments that hold it. A segment's tables and
filter are built by one task from about ``SEGMENT_BYTES`` of text. Segments are broadcast in groups of at most
``BROADCAST_BYTES``; if there are more, documents are passed over once per group and carry what was found so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import arrow, held_out, remove_table, utf8_bodies, words

#: Text bytes behind one segment, bytes broadcast at a time, entries that a task gathers before it passes them on, and tokens
#: scored at a time.
SEGMENT_BYTES, BROADCAST_BYTES, GATHERED, AT_A_TIME = 16 << 20, 256 << 20, 1 << 21, 1 << 20
#: Filter bits for each (entry, level) and hash functions: 2 % of absent entries seem to be there.
BITS, HASHES = 8, 5

END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start"))  # no word holds a space
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def tokens(body: bytes) -> np.ndarray:
    """Hashes of a text's words and its end."""
    w = words(body)
    out = np.empty(len(w) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    out[-1] = END
    return out


def history(v: np.ndarray) -> np.ndarray:
    """32 bits of a word as a history."""
    return mix(v) >> np.uint64(32)


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram's key: its history in the high half, both words in the low half."""
    return (history(v) << np.uint64(32)) | (mix(v * _M2 + w) & _LOW)


def segment_of(key: np.ndarray, hot: np.ndarray, segments: int) -> np.ndarray:
    """The segment of bigram keys: that of their history, but a hot history's bigrams are spread over all segments."""
    v = key >> np.uint64(32)
    at = np.where(np.isin(v, hot), mix(key), mix(v)) if len(hot) else mix(v)
    return (at % np.uint64(segments)).astype(np.int64)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised counts: 0, or 1 + floor(log2 count)."""
    return np.frexp(np.asarray(count, np.float64))[1].astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range."""
    return np.where(q > 0, (3 * np.exp2(q - 1.0) - 1) / 2, 0.0)


def _positions(key: np.ndarray, q: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Where the hash functions put (key, level) in filters of ``bits`` bits (below 2^32)."""
    h = mix(key + q.astype(np.uint64) * _M1)
    step = mix(h ^ _M2) | np.uint64(1)
    for _ in range(HASHES):
        yield ((h >> np.uint64(32)) * bits) >> np.uint64(32)
        h = h + step


def build_filter(key: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A filter with each key at the levels 1 to q, as bytes of eight bits."""
    n = max(64, int(q.sum()) * BITS)
    flags = np.zeros(n, bool)
    for at in range(1, int(q.max(initial=0)) + 1):
        k = key[q >= at]
        for p in _positions(k, np.full(len(k), at), np.uint64(n)):
            flags[p] = True
    return np.packbits(flags)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal keys; keys come out sorted."""
    k = np.concatenate([*keys, np.zeros(0, np.uint64)])
    c = np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.add.reduceat(c, starts) if len(k) else c


def _varied(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; the first byte tells how many."""
    kind = next(t for t in ("u1", "<u2", "<u4", "<u8") if counts.max(initial=0) <= np.iinfo(t).max)
    return bytes([int(kind[-1])]) + counts.astype(kind).tobytes()


def _read_varied(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _gather(get: Callable, place: Callable) -> Callable:
    """Per task: counts the keys ``get(body)`` of all texts and emits them by segment, at most ``GATHERED`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        fresh: list[np.ndarray] = []
        n = 0

        def merged() -> None:
            nonlocal keys, counts, fresh
            if fresh:
                k, c = np.unique(np.concatenate(fresh), return_counts=True)
                keys, counts, fresh = [*keys, k], [*counts, c], []
            k, c = _merge(keys, counts)
            keys, counts = [k], [c]

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts, n
            if not keys or not len(keys[0]):
                return
            k, c = keys[0], counts[0]
            s = place(k)
            order = np.argsort(s, kind="stable")
            k, c, s = k[order], c[order], s[order]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            ends = np.r_[starts[1:], len(s)]
            for a in range(0, len(starts), 256):
                part = list(zip(starts[a : a + 256], ends[a : a + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(s[i]) for i, _ in part], pa.int64()), pa.array([k[i:j].tobytes() for i, j in part], pa.binary()), pa.array([_varied(c[i:j]) for i, j in part], pa.binary())], names=["segment", "keys", "counts"])
            keys, counts, n = [], [], 0

        for b in batches:
            for body in utf8_bodies(b.column("text")):
                fresh.append(got := get(body))
                n += len(got)
                if n >= GATHERED:
                    merged()
                    n = len(keys[0])
                    if n >= GATHERED // 2:
                        yield from emit()
        merged()
        yield from emit()

    return run


_CHUNKS = "segment long, keys binary, counts binary"


def _reduced(finish: Callable, names: list[str]) -> Callable:
    """Merges the chunks of each segment (rows sorted by segment) and emits what ``finish(keys, counts)`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, size = None, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if at is not None:
                row = finish(*_merge(keys, counts))
                yield pa.RecordBatch.from_pylist([{"segment": at, **dict(zip(names, row, strict=True))}])

        for b in batches:
            for s, k, c in zip(b.column("segment").to_pylist(), b.column("keys"), b.column("counts"), strict=True):
                if s != at:
                    yield from close()
                    at, keys, counts, size = s, [], [], 0
                keys.append(np.frombuffer(k.as_py(), "<u8"))
                counts.append(_read_varied(c.as_py()))
                size += len(keys[-1])
                if size >= 4 * GATHERED:
                    k1, c1 = _merge(keys, counts)
                    keys, counts, size = [k1], [c1], 0
        yield from close()

    return run


def _history_types(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories of sorted, different bigram keys, and how many bigrams each has."""
    v = keys >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    return v[starts], np.diff(np.r_[starts, len(v)])


_TYPE = np.uint64(0x5BD1E995)  # tells the key of a history's types from bigram keys


def _type_key(v: np.ndarray) -> np.ndarray:
    return mix(v + (_TYPE << np.uint64(32)))


@dataclass
class Totals:
    """What all documents are scored with, beside the segments."""

    segments: int
    n: int  # tokens
    vocabulary: int
    texts: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted histories with bigrams in all segments
    hot_types: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


@dataclass
class Model:
    """Tables of segments in the shared folder: (segment, words, counts) and (segment, bits)."""

    totals: Totals
    words: DataFrame
    filters: DataFrame


def train(docs: DataFrame, text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> Model:
    """Counts all rows of ``docs``. Null texts count as empty ones, which are one end; repeated rows count each time; an empty
    table gives a model under which every text has probability 1 (no token is known, and only one is left)."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, texts = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    segments = max(1, -(-(size or 0) // segment_bytes))
    none = np.zeros(0, np.uint64)

    def word_segment(k: np.ndarray) -> np.ndarray:
        return (mix(k) % np.uint64(segments)).astype(np.int64)

    chunks = arrow(rows, _gather(tokens, word_segment), _CHUNKS).repartition("segment").sortWithinPartitions("segment")
    table = lambda k, c: (k.tobytes(), _varied(c), len(k), int(c.sum()))
    table = materialize(arrow(chunks, _reduced(table, ["words", "counts", "n_words", "n_tokens"]), "segment long, words binary, counts binary, n_words long, n_tokens long"), "lm-words")
    vocabulary, n = (x or 0 for x in table.agg(F.sum("n_words"), F.sum("n_tokens")).first())

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column("words"), b.column("counts"), strict=True):
                many = np.frombuffer(k.as_py(), "<u8")[_read_varied(c.as_py()) > n / (2 * segments)]
                yield pa.RecordBatch.from_arrays([pa.array(many.view(np.int64))], names=["word"])

    # at most 2 * segments words are that frequent; the start is a history of every text
    often = [r.word for r in arrow(table.select("words", "counts"), frequent, "word long").collect()]
    hot = np.unique(history(np.r_[np.array(often, np.int64).view(np.uint64), START])) if segments > 1 else none

    def pairs(body: bytes) -> np.ndarray:
        t = tokens(body)
        return bigram(np.r_[START, t[:-1]], t)

    def filtered(k: np.ndarray, c: np.ndarray) -> tuple:
        v, types = _history_types(k)
        own = ~np.isin(v, hot)
        bits = build_filter(np.r_[k, _type_key(v[own])], np.r_[level(c), level(types[own])])
        return bits.tobytes(), v[~own].tobytes(), types[~own].astype("<i8").tobytes()

    chunks = arrow(rows, _gather(pairs, lambda k: segment_of(k, hot, segments)), _CHUNKS).repartition("segment").sortWithinPartitions("segment")
    filters = materialize(arrow(chunks, _reduced(filtered, ["bits", "hot", "hot_types"]), "segment long, bits binary, hot binary, hot_types binary"), "lm-filters")
    totals = Totals(segments, n, vocabulary, texts, hot, np.zeros(len(hot), np.int64))
    for r in filters.select("hot", "hot_types").toLocalIterator():
        np.add.at(totals.hot_types, np.searchsorted(hot, np.frombuffer(r.hot, "<u8")), np.frombuffer(r.hot_types, "<i8"))
    return Model(totals, table.select("segment", "words", "counts"), filters.select("segment", "bits"))


@dataclass
class Group:
    """The segments of one broadcast: tables and filters one after another."""

    totals: Totals
    has: np.ndarray  # of each segment, whether it is here
    words: np.ndarray  # sorted
    counts: np.ndarray
    bits: np.ndarray
    first: np.ndarray  # of each segment, its first bit and its number of bits
    size: np.ndarray

    def count(self, word: np.ndarray) -> np.ndarray:
        """Exact counts of words (0 for those of other segments)."""
        if not len(self.words):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.counts[at], 0).astype(np.int64)

    def probe(self, key: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Quantised counts: each key is probed at one level after another until one is missing."""
        q = np.zeros(len(key), np.uint8)
        live = np.flatnonzero(self.size[segment] > 0)
        at = 0
        while len(live):
            at += 1
            s, k = segment[live], key[live]
            first, size = self.first[s], self.size[s].astype(np.uint64)
            keep = np.arange(len(live))
            # each hash function sees only what the one before it has found
            h = mix(k + np.array([at], np.uint64) * _M1)
            step = mix(h ^ _M2) | np.uint64(1)
            for _ in range(HASHES):
                p = (((h[keep] >> np.uint64(32)) * size[keep]) >> np.uint64(32)).astype(np.int64) + first[keep]
                keep = keep[(self.bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1]
                h = h + step
            live = live[keep]
            q[live] = at
        return q

    def types(self, v: np.ndarray) -> np.ndarray:
        """Quantised numbers of different words after histories."""
        q = self.probe(_type_key(v), (mix(v) % np.uint64(self.totals.segments)).astype(np.int64))
        hot = self.totals.hot
        if len(hot):
            at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
            own = hot[at] == v
            q[own] = level(self.totals.hot_types[at[own]]) if self.has[0] else 0  # counted once: with the first group
        return q


def groups(model: Model, most_bytes: int = BROADCAST_BYTES) -> Iterator[Group]:
    """The segments in groups of at most ``most_bytes`` bytes (a group holds one segment at least, and a segment is bounded
    by ``SEGMENT_BYTES`` of text)."""
    sized = model.words.select("segment", (F.octet_length("words") * F.lit(1.5)).alias("bytes")).unionByName(model.filters.select("segment", F.octet_length("bits").cast("double").alias("bytes")))
    sizes = {r.segment: r.bytes for r in sized.groupBy("segment").agg(F.sum("bytes").alias("bytes")).collect()}
    todo, n = [], model.totals.segments
    for s in range(n):
        if todo and sum(sizes.get(x, 0) for x in todo) + sizes.get(s, 0) > most_bytes:
            yield _load(model, todo)
            todo = []
        todo.append(s)
    yield _load(model, todo)


def _load(model: Model, segments: list[int]) -> Group:
    n = model.totals.segments
    inside = F.col("segment").between(segments[0], segments[-1])
    has, first, size = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    has[segments] = True
    keys, counts, bits, at = [], [], [], 0
    for r in model.words.filter(inside).toLocalIterator():
        keys.append(np.frombuffer(r.words, "<u8"))
        counts.append(_read_varied(r.counts))
    for r in model.filters.filter(inside).toLocalIterator():
        first[r.segment], size[r.segment] = at, 8 * len(r.bits)
        bits.append(np.frombuffer(r.bits, np.uint8))
        at += 8 * len(r.bits)
    k = np.concatenate([*keys, np.zeros(0, np.uint64)])
    c = np.concatenate([*counts, np.zeros(0, np.int64)])
    c = c.astype(np.uint32 if c.max(initial=0) < 1 << 32 else np.int64)
    order = np.argsort(k)
    return Group(model.totals, has, k[order], c[order], np.concatenate([*bits, np.zeros(0, np.uint8)]), first, size)


def _found(group: Group, t: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens and what stands before them: counts of the tokens, levels of their bigrams, levels of the histories' types."""
    both, back = np.unique(np.r_[t, START], return_inverse=True)
    count, types = group.count(both), group.types(history(both))
    key = bigram(before, t)
    back = back.ravel()[:-1]
    of_before = np.r_[np.zeros(1, np.int64), back[:-1]]
    of_before[before == START] = np.searchsorted(both, START)
    return count[back], group.probe(key, segment_of(key, group.totals.hot, group.totals.segments)), types[of_before]


def log_probabilities(totals: Totals, t: np.ndarray, before: np.ndarray, count: np.ndarray, pair: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, smoothed) log10 probabilities of tokens. A bigram counts at most as often as either of its words."""
    base = (count + 1) / (totals.n + totals.vocabulary + 1)
    seen = np.r_[0, count[:-1]]
    seen[before == START] = totals.texts
    both = np.minimum(value(pair), np.minimum(count, seen))
    follow = np.minimum(np.maximum(value(types), 1), np.maximum(seen, 1))
    smooth = np.where(seen > 0, (both + follow * base) / (seen + follow), base)
    return np.log10(base), np.log10(smooth)


_STATE = np.dtype([("count", "<u8"), ("pair", "u1"), ("types", "u1")])


def _pass(shared, last: bool) -> Callable:
    """One group's pass: adds what its segments know of each token; with ``last`` the scores come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Group = shared.value

        def some(b: pa.RecordBatch, toks: list[np.ndarray]) -> pa.RecordBatch:
            t = np.concatenate(toks)
            ends = np.cumsum([len(x) for x in toks])
            starts = np.r_[0, ends[:-1]]
            before = np.r_[START, t[:-1]]
            before[starts] = START
            state = np.zeros(len(t), _STATE)
            state["count"], state["pair"], state["types"] = _found(group, t, before)
            if "state" in b.schema.names:
                old = np.concatenate([np.frombuffer(x.as_py(), _STATE) for x in b.column("state")])
                for c in _STATE.names:
                    state[c] += old[c]
            if not last:
                return b.drop_columns([c for c in ("state",) if c in b.schema.names]).append_column("state", pa.array([state[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()))
            count = state["count"].astype(np.int64)
            base, smooth = log_probabilities(group.totals, t, before, count, state["pair"].astype(np.int64), state["types"].astype(np.int64))
            total = lambda x: np.add.reduceat(x, starts)
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(np.r_[0, ends]).astype(np.int64)), pa.array(total((count > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(smooth))], names=["id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            toks, size, begin = [], 0, 0
            for r, body in enumerate(utf8_bodies(b.column("text"))):
                toks.append(tokens(body))
                size += len(toks[-1])
                if size >= AT_A_TIME:
                    yield some(b.slice(begin, r + 1 - begin), toks)
                    toks, size, begin = [], 0, r + 1
            if toks:
                yield some(b.slice(begin), toks)

    return run


def score(docs: DataFrame, model: Model, most_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row: tokens and known tokens of its text, and the log10 probabilities
    of the text by word counts alone and by the smoothed model. With several groups of segments there is a pass for each, and two
    passes' tables are on disk at most. A null text is an empty one, which is its end; repeated
    rows get the same scores; extra columns are ignored; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, share = rows.schema["id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast
    todo = groups(model, most_bytes)
    group, last = next(todo), None
    while (after := next(todo, None)) is not None:
        shared, path = share(group), scratch_path(docs.sparkSession, f"lm-pass-{uuid.uuid4().hex[:12]}")
        arrow(rows, _pass(shared, False), f"id {kind}, text string, state binary").write.parquet(path)
        shared.destroy()
        rows = docs.sparkSession.read.parquet(path)
        if last:  # what a pass has written takes the place of what the one before wrote
            remove_table(docs.sparkSession, last)
        group, last = after, path
    return arrow(rows, _pass(share(group), True), f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def score_held_out(docs: DataFrame, modulus: int = 7, remainder: int = 2, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``score`` of all documents under a model of those whose crc32(doc_id as text) modulo ``modulus`` is not ``remainder``, with
    held_out and train_tokens."""
    model = train(docs.filter(~held_out("doc_id", modulus, remainder)))
    return score(docs, model, most_bytes).withColumn("held_out", held_out("id", modulus, remainder)).withColumn("train_tokens", F.lit(model.totals.n).cast("long"))
