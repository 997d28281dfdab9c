"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

A text is a chain of symbols, at first one per character. An agenda holds the adjacent pairs whose
concatenation is a piece, ordered by the piece's score and then from the left; the best pair is merged
and its new neighbours enter the agenda until it is empty. Symbols that are no piece become byte pieces.

A merge can only happen inside a run of characters whose neighbours stand side by side in some piece, so a
text is first cut where no piece spans: before a run of word marks, and around characters that no longer piece
holds. Runs are encoded on their own and remembered, in a table of bounded size. The agendas of all
new runs of a batch lie side by side in arrays, and each round takes the best pair of every run; a long run
has a heap for its agenda.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow

MARK = "▁"
_NONE = np.iinfo(np.int32).max
#: Runs remembered during a task, the longest of them in characters, and the characters of text encoded at a time.
MEMORY, REMEMBERED_CHARS, AT_A_TIME = 1 << 20, 32, 1 << 20

#: Rows whose results are held at a time.
ROWS = 2048

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class MergeVocabulary:
    """The pieces of a model file and what its settings say about texts.

    Supported are merge-type models with byte fallback that leave characters and white space as they are and put a
    word mark before a text; anything else raises ValueError rather than encode differently from the library."""

    def __init__(self, model: bytes) -> None:
        import struct

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("not a merge-type model with byte fallback and leading word marks")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("the model changes characters or white space")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined or unused pieces")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: v for v, i in self.bytes.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self._memory: dict[str, tuple[int, ...]] = {}  # runs
        self._words: dict[str, tuple[int, ...]] = {}  # words that stand after a single space, and line breaks with what follows
        self._cut = self._cutter()
        self._pairs()
        self._numbers = [str(i) for i in range(len(self.pieces))]
        # a byte below 128 is a character wherever it stands
        self._shown = [{NORMAL: p.replace(MARK, " "), UNKNOWN: " ⁇ ", CONTROL: ""}.get(k, chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else None) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]

    def _cutter(self) -> re.Pattern:
        long = [p for p in self.ids if len(p) > 1]
        if any(a != MARK and b == MARK for p in long for a, b in zip(p, p[1:], strict=False)):
            self._breaks = False
            return re.compile("(?s).+")  # a piece holds a mark after another character: no cuts
        self._breaks = not any("\n" in p for p in long)  # a line break is a run of its own
        joins = "".join(sorted({re.escape(c) for p in long for c in p} - {MARK}))
        return re.compile(f"(?s){MARK}*[{joins}]+|{MARK}+|.")

    def merge(self, run: str) -> list[int]:
        """Ids of a run of characters, with a heap as agenda."""
        ids, scores = self.ids, self.scores
        n = len(run)
        symbol: list[str] = list(run)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (i := ids.get(piece := symbol[left] + symbol[right])) is not None:
                heapq.heappush(agenda, (-scores[i], left, right, piece))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if after[left] != right or not symbol[left] or symbol[left] + symbol[right] != piece:
                continue  # one of the two has been merged meanwhile
            symbol[left], symbol[right] = piece, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[int] = []
        for s in symbol:
            if s:
                i = ids.get(s)
                out += [i] if i is not None else [self.bytes[v] for v in s.encode()]
        return out

    def _pairs(self) -> None:
        """The pairs of symbols that make a piece, sorted, each with the piece and its place in the order of scores. Symbols
        are pieces by id, then the characters of pieces that are none themselves, then one for any other character."""
        chars = sorted({c for p in self.ids if len(p) > 1 for c in p if c not in self.ids})
        symbols = self.ids | {c: len(self.pieces) + i for i, c in enumerate(chars)}
        self._n_symbols = len(self.pieces) + len(chars) + 1
        self._symbol_of = np.full(0x110000, self._n_symbols - 1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self._symbol_of[ord(c)] = i
        place = {x: i for i, x in enumerate(sorted(set(self.scores), reverse=True))}
        rows = [(left * self._n_symbols + right, i, place[self.scores[i]]) for p, i in self.ids.items() for k in range(1, len(p)) if (left := symbols.get(p[:k])) is not None and (right := symbols.get(p[k:])) is not None]
        table = np.array([*sorted(rows), (np.iinfo(np.int64).max, -1, _NONE)], np.int64)
        self._keys, self._made, self._rank = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

    def _offer(self, symbol: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where in the pair table the pairs (at, at + 1) stand; its end where they make no piece or cross a run's end."""
        key = symbol[at].astype(np.int64) * self._n_symbols + symbol[np.minimum(at + 1, len(symbol) - 1)]
        found = np.searchsorted(self._keys, key)
        found[(self._keys[found] != key) | last[at]] = len(self._keys) - 1
        return found

    def merge_all(self, runs: list[str]) -> list[tuple[int, ...]]:
        """Ids of many short runs. Their agendas lie side by side: each round merges the best pair of every run that has one
        and offers the pairs on both sides of what came of it."""
        symbol = self._symbol_of[np.frombuffer("".join(runs).encode("utf-32-le"), "<u4")]
        run = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        done_symbol, done_run = [], []
        last = np.r_[run[1:] != run[:-1], True]
        pair = self._offer(symbol, np.arange(len(symbol)), last)
        while len(symbol):
            rank = self._rank[pair]
            starts = np.flatnonzero(np.r_[True, last[:-1]])
            size = np.diff(np.r_[starts, len(symbol)])
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == _NONE, size)
            if over.any():
                done_symbol.append(symbol[over])
                done_run.append(run[over])
                keep = ~over
                symbol, run, last, pair, rank = symbol[keep], run[keep], last[keep], pair[keep], rank[keep]
                size, best = size[best != _NONE], best[best != _NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.r_[True, run[hit[1:]] != run[hit[:-1]]]]  # of equal scores the leftmost
            symbol[hit] = self._made[pair[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, run, last, pair = symbol[keep], run[keep], last[keep], pair[keep]
            at = hit - np.arange(len(hit))  # one symbol has gone for each hit before
            before = at[(at > 0) & (run[at - 1] == run[at])]
            again = np.r_[at, before - 1]
            pair[again] = self._offer(symbol, again, last)
        symbol, run = np.concatenate([*done_symbol, np.zeros(0, np.int32)]), np.concatenate([*done_run, np.zeros(0, np.int64)])
        order = np.argsort(run, kind="stable")
        symbol, ends = symbol[order], np.cumsum(np.bincount(run, minlength=len(runs)))
        plain = np.ones(len(runs), bool)
        plain[run[order][symbol >= len(self.pieces)]] = False
        flat, begin, out = symbol.tolist(), 0, []
        for r, end, ok in zip(runs, ends.tolist(), plain.tolist(), strict=True):
            out.append(tuple(flat[begin:end] if ok else self.merge(r)))
            begin = end
        return out

    def _learn(self, runs: set[str] | dict[str, str], into: dict[str, tuple[int, ...]]) -> None:
        """Remembers the ids of runs, under their names where they have any."""
        name = runs.__getitem__ if isinstance(runs, dict) else str
        new = [r for r in runs if name(r) not in into]
        into.update((name(r), tuple(self.merge(r))) for r in new if len(r) > REMEMBERED_CHARS)
        short = [r for r in new if len(r) <= REMEMBERED_CHARS]
        for k in range(0, len(short), 1 << 13):
            part = short[k : k + (1 << 13)]
            into.update(zip(map(name, part), self.merge_all(part), strict=True))

    def _by_words(self, text: str) -> list[str] | None:
        """A text as words with single spaces between them, each line break at the head of one; None for any other text."""
        if "  " in text or text[:1] == " " or text[-1:] == " " or MARK in text:
            return None
        if self._breaks and "\n" in text:
            return None if " \n" in text else text.replace("\n", " \n").split(" ")
        return text.split(" ")

    def _encode_some(self, texts: list[str]) -> tuple[list[list[str] | None], list[list[str] | None]]:
        """The words of each text, or else its runs; after this all of them are remembered."""
        memory, words, cut = self._memory, self._words, self._cut.findall
        if len(memory) > MEMORY:
            memory.clear()
        if len(words) > MEMORY:
            words.clear()
        split = [self._by_words(t) for t in texts]
        runs = [cut(MARK + t.replace(" ", MARK)) if ws is None else None for t, ws in zip(texts, split, strict=True)]
        new = set().union(*(ws for ws in split if ws)).difference(words)
        cuts = [(w, cut(w if w[:1] == "\n" and self._breaks else MARK + w)) for w in new]
        self._learn(set().union(*(rs for rs in runs if rs), *(rs for _, rs in cuts if len(rs) > 1)), memory)
        self._learn({rs[0]: w for w, rs in cuts if len(rs) == 1}, words)
        words.update((w, tuple(i for r in rs for i in memory[r])) for w, rs in cuts if len(rs) > 1)
        return split, runs

    def _ids(self, text: str, words: list[str] | None, runs: list[str] | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self._memory.__getitem__, runs) if words is None else map(self._words.__getitem__, words)))

    def _some(self, texts: Iterable[str]) -> Iterator[tuple[str, list[str] | None, list[str] | None]]:
        some, chars = [], 0
        for t in texts:
            some.append(t)
            chars += len(t)
            if chars >= AT_A_TIME:
                yield from zip(some, *self._encode_some(some), strict=True)
                some, chars = [], 0
        if some:
            yield from zip(some, *self._encode_some(some), strict=True)

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of texts, without begin or end ids; none for an empty text."""
        return (self._ids(*x) for x in self._some(texts))

    def round_trips(self, texts: Iterable[str]) -> Iterator[tuple[list[int], str, str]]:
        """Of each text the ids, these as decimal numbers joined by commas, and what they decode to."""
        for x in self._some(texts):
            ids = self._ids(*x)
            yield ids, self.numbers(ids), self.decode(ids)

    def forget(self) -> None:
        """Drops what is remembered: a worker process outlives its task and serves other stages."""
        self._memory.clear()
        self._words.clear()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids. Bytes that are not UTF-8 become U+FFFD one by one; the mark put before a text goes."""
        ids = list(ids)
        kinds, shown = self.kinds, self._shown
        first = next((k for k, i in enumerate(ids) if kinds[i] != CONTROL), len(ids))
        head = ""
        if first < len(ids) and kinds[ids[first]] == NORMAL and self.pieces[ids[first]][0] == MARK:
            head, first = shown[ids[first]][1:], first + 1
        rest = ids[first:]
        try:
            return head + "".join(map(shown.__getitem__, rest))
        except TypeError:  # other byte pieces show nothing by themselves
            pass
        out, raw = [head], bytearray()
        for i in rest:
            v = self.byte_of.get(i)
            if v is not None:
                raw.append(v)
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(shown[i])
        return "".join(out) + _utf8(bytes(raw))

    def numbers(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self._numbers.__getitem__, ids))


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is in no valid character becomes U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


_LOADED: dict[int, MergeVocabulary] = {}


def _vocabulary(model) -> MergeVocabulary:
    """The vocabulary of a broadcast model, built once per worker process."""
    key = hash(model.value)
    if key not in _LOADED:
        _LOADED[key] = MergeVocabulary(model.value)
    return _LOADED[key]


def load_model(spark: SparkSession, path: str):
    """A model file of the driver as a broadcast; workers need no copy of the file. Vocabulary files are a few MB at most;
    one over 64 MB is refused."""
    with open(path, "rb") as f:
        model = f.read((64 << 20) + 1)
    if len(model) > 64 << 20:
        raise ValueError(f"{path} is larger than a vocabulary can be")
    MergeVocabulary(model)  # raises here, not in a task, if it is not supported
    return spark.sparkContext.broadcast(model)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.make_valid_utf8(F.col(text_col)), F.lit("")).alias("text")), docs.schema[id_col].dataType.simpleString()


def _encoder(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model)
        for b in batches:
            ids = pa.array(v.encode_all(t.as_py() for t in b.column("text")), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])
        v.forget()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row. Null and empty texts have no ids; each row stands for itself, repeated ones too; extra columns
    are ignored."""
    rows, kind = _rows(docs, id_col, text_col)
    return arrow(rows, _encoder(load_model(docs.sparkSession, path)), f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of rows (id, ids); null ids give an empty text."""
    model = load_model(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([v.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["id", "text"])

    return arrow(encoded.select("id", "ids"), run, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _round_tripper(model, check_every: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small tuples and no cycles
        v = _vocabulary(model)
        library = None
        if check_every:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            counts, ids_sha, text_sha, same, kept = [], [], [], [], []
            texts = b.column("text")
            for k, (ids, decimal, decoded) in enumerate(v.round_trips(t.as_py() for t in texts)):
                agrees = None
                if check_every and k % check_every == 0:
                    agrees = library.encode(texts[k].as_py()) == ids and library.decode(ids) == decoded
                same.append(agrees)
                counts.append(len(ids))
                if with_ids:
                    kept.append(pa.array(ids, pa.int32()))
                ids_sha.append(_sha(decimal))
                text_sha.append(_sha(decoded))
            out = [b.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees"]
            if with_ids:
                flat = pa.concat_arrays([*kept, pa.array([], pa.int32())])
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(out, names=names + ["ids"] * with_ids)
        v.forget()
        gc.enable()

    return run


def round_trip(docs: DataFrame, path: str, check_every: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, library_agrees): digests of each row's ids, decimal and comma-joined, and of
    what they decode to; ``with_ids`` adds the ids themselves.

    Ids and texts are the agenda's. Every row is also given to the sentencepiece library, and ``library_agrees`` tells whether it has the same
    ids and decodes them to the same text; a row that is false keeps what the agenda made of it and stands out. Bytes that are not UTF-8
    count as U+FFFD. With another ``check_every`` only one row of so many in an Arrow
    batch is checked (none with 0); it is null for the other rows, which are encoded and decoded like these."""
    rows, kind = _rows(docs, id_col, text_col)
    run = _round_tripper(load_model(docs.sparkSession, path), check_every, with_ids)
    return arrow(rows, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean" + ", ids array<int>" * with_ids)
