"""Phrase collocation mining: Misra-Gries summaries find every frequent n-gram, a second pass counts exactly.

Texts are cut at punctuation and line ends into pieces, pieces into words. A first pass over the documents hashes
n-grams, counts them inside each task and deals the counts to hash partitions. There a Misra-Gries
summary with more counters than the partition's mass divided by the threshold takes them up: summaries merge by adding
counters and lowering all by the first one that has no place, and what is taken off all in all stays below the threshold, so every
frequent n-gram keeps a counter. The keys that survive become a bitmap of fixed size. Words and pairs go
first, and longer n-grams take part only where all their pairs survived. The last pass counts the words of the survivors
themselves, so hashes that collide cost time, never exactness.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Starts of n-grams that a task counts at a time, bytes of a text that are split at a time, and words that it remembers.
BLOCK, SLICE, REMEMBERED = 1 << 21, 1 << 20, 1 << 20
#: A summary has this many times the counters that its mass needs, so that what it takes off is that part of the threshold and few keys
#: below it stay; the mass of a hash partition over the threshold is kept near this number by how many there are, at least so many.
SLACK, COUNTERS, LEAST_PARTS = 16, 1 << 16, 256
#: Rows of counts that are merged at a time.
MERGED_ROWS = 1 << 18
#: Bits of a key, and the largest bitmap of survivors in bits (32 MB); smaller ones have 256 bits for each of them.
KEY_BITS, BITMAP_BITS = 48, 28
UNDEFINED = "und"

_BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Numbers of the words of one language; a word's hash is seeded with the language. 0 is the break between pieces."""

    def __init__(self, lang: str, names: list[bytes], langs: list[str], hashes: list[int]):
        super().__init__({b"\n": 0, b"": -1})
        self.lang, self.names, self.langs, self.hashes = lang, names, langs, hashes
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        self.langs.append(self.lang)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return n


class Reader:
    """Word numbers of texts, block by block. Numbers hold inside a block; words are forgotten between blocks
    once there are many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names, self.langs, self.hashes = [b""], [""], [0]
        self.by_lang: dict[str, Words] = {}

    def ids(self, lang: str, body: bytes) -> np.ndarray:
        if lang not in self.by_lang:
            self.by_lang[lang] = Words(lang, self.names, self.langs, self.hashes)
        get, parts, at = self.by_lang[lang].__getitem__, [], 0
        body = body.lower().translate(_BREAKS)
        while at < len(body):
            end = len(body)
            if end - at > SLICE:
                cuts = [x for x in (body.find(b" ", at + SLICE), body.find(b"\n", at + SLICE)) if x >= 0]
                end = min(cuts, default=end)
            found = body[at:end].replace(b"\n", b" \n ").split(b" ")
            one = np.fromiter(map(get, found), np.int64, len(found))
            parts.append(one[one >= 0])
            at = end
        return np.concatenate([*parts, np.zeros(1, np.int64)])

    def blocks(self, batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[np.ndarray, int]]:
        """(word numbers, starts): n-grams that start at the first ``starts`` places are this block's; the
        numbers behind them are the words that they may go on with."""
        held, size = [], 0
        for b in batches:
            for lang, body in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                held.append(self.ids(lang, body.as_py()))
                size += len(held[-1])
                if size >= BLOCK:
                    yield from self._cut(np.concatenate(held), longest)
                    held, size = [], 0
                    if len(self.names) > REMEMBERED:
                        self.clear()
        if held:
            yield from self._cut(np.concatenate(held), longest)

    @staticmethod
    def _cut(ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
        for at in range(0, len(ids), BLOCK):
            yield ids[at : at + BLOCK + longest - 1], min(BLOCK, len(ids) - at)


def keys_of(h: np.ndarray, n: int) -> np.ndarray:
    """The keys of the hashes of n-grams of ``n`` words."""
    x = (h + np.uint64(n)) * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - KEY_BITS)


def grams(ids: np.ndarray, hashes: np.ndarray, upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, keys, whole) for n from 1: the key of the n words from each place, and if no break is among them."""
    word, is_word = hashes[ids], ids > 0
    h, whole = word, is_word
    for n in range(1, upto + 1):
        if n > 1:
            h = h[:-1] * _STEP + word[n - 1 :]
            whole = whole[:-1] & is_word[n - 1 :]
        yield n, keys_of(h, n), whole


class Survivors:
    """A bitmap over the leading bits of keys."""

    def __init__(self, bits: int, table: np.ndarray):
        self.shift, self.table = np.uint64(KEY_BITS - bits), table

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def alive(found: Iterator, survivors: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, keys, those still in question): a whole n-gram whose first and last n - 1 words are, and whose own key
    survived where ``survivors`` [n - 1] knows."""
    before = None
    for n, keys, whole in found:
        now = whole if before is None else whole & before[:-1] & before[1:]
        if n <= len(survivors) and survivors[n - 1] is not None:
            now = now.copy()
            at = np.flatnonzero(now)
            now[at] = survivors[n - 1](keys[at])
        before = now
        yield n, keys, now


def _summaries(first: int, last: int, part_bits: int, known) -> Callable:
    """First pass: per block and hash partition, its mass and its sorted keys with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shift = Reader(), np.uint64(KEY_BITS - part_bits)
        for ids, starts in reader.blocks(batches, last):
            took = [keys[:starts][now[:starts]] for n, keys, now in alive(grams(ids, np.array(reader.hashes, np.uint64), last), known.value) if n >= first]
            keys = np.sort(np.concatenate(took))
            if not len(keys):
                continue
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts, keys = np.diff(np.r_[at, len(keys)]), keys[at]
            part = (keys >> shift).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            mass = np.add.reduceat(counts, edge)
            low, high, counts = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), (keys >> np.uint64(32)).astype("<u2"), counts.astype("<u4")
            ends = np.r_[edge[1:], len(keys)]
            cut = lambda x: pa.array([None] * len(edge) + [x[a:z].tobytes() for a, z in zip(edge, ends, strict=True)], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(part[edge], 2)), pa.array(np.repeat([0, 1], len(edge)).astype(np.int32)), pa.array(np.r_[mass, 0 * mass]), cut(low), cut(high), cut(counts)], names=["part", "kind", "mass", "low", "high", "counts"])

    return run


class MisraGries:
    """A mergeable summary of weighted keys: at most ``capacity`` counters after each merge. ``taken`` is what the counters
    fall short of the true counts by at most; it is below mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.taken, self.waiting, self.size = capacity, 0, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(1 << 16, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(keys) > self.capacity:
            cut = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            stay = counts > cut
            keys, counts = keys[stay], counts[stay] - cut
            self.taken += int(cut)
        self.keys, self.counts, self.waiting, self.size = keys, counts, [], 0

    def at_least(self, threshold: int) -> np.ndarray:
        """Every key whose true count is ``threshold`` or more, and some others."""
        self.merge()
        return self.keys[self.counts + self.taken >= threshold]


def _merge_summaries(min_count: int) -> Callable:
    """The survivors of each hash partition. Its masses come first, so its capacity is known before its first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def done() -> pa.RecordBatch:
            keys = summary.at_least(min_count) if summary else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([keys.astype("<u8").tobytes()], pa.binary())], names=["part", "n", "keys"])

        for b in batches:
            for p, kind, m, low, high, counts in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "mass", "low", "high", "counts")), strict=True):
                if p != part:
                    if part is not None:
                        yield done()
                    part, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                else:
                    summary = summary or MisraGries(SLACK * mass // min_count + 1)
                    summary.add(np.frombuffer(low, "<u4") | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32), np.frombuffer(counts, "<u4").astype(np.int64))
        if part is not None:
            yield done()

    return run


def _slices(bits: int, part_bits: int) -> Callable:
    """The bytes of the bitmap that each hash partition's keys own, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, out = b.column("part").to_pylist(), []
            for part, keys in zip(parts, b.column("keys").to_pylist(), strict=True):
                own = np.zeros(1 << (bits - part_bits), bool)
                own[(np.frombuffer(keys, "<u8") >> np.uint64(KEY_BITS - bits)).astype(np.int64) - (part << (bits - part_bits))] = True
                out.append(zlib.compress(np.packbits(own, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(out, pa.binary())], names=["part", "bytes"])

    return run


def _survivors(rows: DataFrame, first: int, last: int, known: list, min_count: int, part_bits: int) -> Survivors:
    """The bitmap of the n-grams of ``first`` to ``last`` words that may occur ``min_count`` times. It reaches the driver as
    slices that make up its fixed size at most, whatever the corpus."""
    sc = rows.sparkSession.sparkContext
    packs = arrow(rows, _summaries(first, last, part_bits, sc.broadcast(known)), "part long, kind int, mass long, low binary, high binary, counts binary")
    ordered = packs.repartition("part").sortWithinPartitions("part", "kind")
    kept = materialize(arrow(ordered, _merge_summaries(min_count), "part long, n long, keys binary"), f"phrases-{first}-{last}")
    n = kept.agg(F.sum("n")).first()[0] or 0
    bits = max(part_bits + 3, min(BITMAP_BITS, int(256 * n).bit_length()))
    table, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (bits - part_bits - 3)
    for r in arrow(kept.filter("n > 0"), _slices(bits, part_bits), "part long, bytes binary").toLocalIterator():
        table[r.part * width : (r.part + 1) * width] = np.frombuffer(zlib.decompress(r.bytes), np.uint8)
    return Survivors(bits, table)


_FOUND = {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "n": pa.int64()}


def _count(upto: int, part_bits: int, known) -> Callable:
    """Second pass: the survivors' own words with their counts, a row of arrays per block and hash partition; a null phrase
    counts all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shift = Reader(), np.uint64(KEY_BITS - part_bits)
        for ids, starts in reader.blocks(batches, upto):
            names, langs, total = reader.names, reader.langs, len(reader.names)
            numbers, times = np.unique(ids[:starts], return_counts=True)
            sums: dict[str, int] = {}
            for i, k in zip(numbers.tolist(), times.tolist(), strict=True):
                if i:
                    sums[langs[i]] = sums.get(langs[i], 0) + k
            rank, parts, cols = ids, [np.zeros(len(sums), np.int64)], (list(sums), [None] * len(sums), [0] * len(sums), list(sums.values()))
            for n, keys, now in alive(grams(ids, np.array(reader.hashes, np.uint64), upto), known.value):
                at = np.flatnonzero(now[:starts])
                # equal n-grams: the same first n - 1 words, by their rank, and the same last one
                together = rank[at] * total + ids[at + n - 1] if n > 1 else ids[at]
                _, where, inverse, times = np.unique(together, return_index=True, return_inverse=True, return_counts=True)
                rank = np.full(len(ids), -1, np.int64)
                rank[at] = inverse
                parts.append((keys[at[where]] >> shift).astype(np.int64))
                place = ids[at[where][:, None] + np.arange(n)].tolist()
                for col, more in zip(cols, ((langs[p[0]] for p in place), (b" ".join([names[i] for i in p]) for p in place), [n] * len(place), times.tolist()), strict=True):
                    col.extend(more)
            part = np.concatenate(parts)
            order = np.argsort(part, kind="stable")
            part = part[order]
            edge = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]])
            if len(edge):
                cut, order = pa.array(np.r_[edge, len(part)].astype(np.int32)), pa.array(order)
                lists = [pa.ListArray.from_arrays(cut, pa.array(col, pa.binary() if name == "phrase" else kind).cast(kind).take(order)) for (name, kind), col in zip(_FOUND.items(), cols, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[edge]), *lists], names=["part", *_FOUND])

    return run


def _merge_counts(min_count: int) -> Callable:
    """The exact counts of each hash partition, which holds a few times its frequent n-grams at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows, least = None, [], 0, MERGED_ROWS

        def merge() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")])
            return t.rename_columns(["lang", "phrase", "words", "n"]).select(list(_FOUND))

        def done() -> Iterator[pa.RecordBatch]:
            t = merge()
            yield from t.filter(pc.or_(pc.equal(t["words"], 0), pc.greater_equal(t["n"], min_count))).combine_chunks().to_batches()

        for b in batches:
            parts = b.column("part").to_numpy()
            edge = np.flatnonzero(np.r_[len(parts) > 0, parts[1:] != parts[:-1]])
            for at, end in zip(edge.tolist(), [*edge[1:].tolist(), len(parts)], strict=True):
                if parts[at] != part:
                    if held:
                        yield from done()
                    part, held, rows, least = parts[at], [], 0, MERGED_ROWS
                held.append(pa.table([pc.list_flatten(b.column(c).slice(at, end - at)) for c in _FOUND], names=list(_FOUND)))
                rows += held[-1].num_rows
                if rows > least:
                    held = [merge()]
                    rows = held[0].num_rows
                    least = max(MERGED_ROWS, 2 * rows)
        if held:
            yield from done()

    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, n) of every phrase of one to ``max_words`` words that occurs at least ``min_count`` times in its language,
    and a row with a null phrase and 0 words for all words of the language.

    Null texts are empty and a null language is ``und``; rows that repeat count each time; one very long text is split and
    counted in slices; other columns are not read; an empty table gives an empty result."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDEFINED)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # at most a word in two bytes, and words and pairs (or the longer ones that are left) in each of the two rounds
    part_bits = (max(LEAST_PARTS, size // (min_count * COUNTERS)) - 1).bit_length()
    known = [_survivors(rows, 1, min(2, max_words), [], min_count, part_bits)] * min(2, max_words)
    if max_words > 2:
        known += [_survivors(rows, 3, max_words, known, min_count, part_bits)] * (max_words - 2)
    lists = "part long, " + ", ".join(f"{c} array<{k}>" for c, k in zip(_FOUND, ("string", "string", "int", "long"), strict=True))
    counted = arrow(rows, _count(max_words, part_bits, rows.sparkSession.sparkContext.broadcast(known)), lists)
    return arrow(counted.repartition("part").sortWithinPartitions("part"), _merge_counts(min_count), "lang string, phrase string, words int, n long")


def _floor_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(18,0)")
    up, down = whole(a) * F.lit(1000).cast("decimal(4,0)"), (whole(left) * whole(right)).cast("decimal(36,0)")
    return F.call_function("div", (up.cast("decimal(19,0)") * whole(n)).cast("decimal(38,0)"), down)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, contained: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more by the score of their
    worst cut, without those that lie inside a longer one that occurs at least ``contained`` percent as often.

    Ties: the smaller first part of equal cuts; more occurrences, then the phrase's bytes in the ranking. Odd inputs are as
    ``frequent_phrases`` says."""
    counts = materialize(frequent_phrases(docs, min_count, max_words, lang_col, text_col), "phrases")
    parts = counts.filter("words > 0").select("lang", "phrase", "n")
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(counts.filter("words = 0").select("lang", "n"), "lang")
    cuts = cuts.withColumn("score", _floor_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    worst = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    pieces = phrases.filter("words > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "words")
    pieces = pieces.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    pieces = pieces.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inside = pieces.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    left = worst.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(contained) * F.col("a")))
    ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
