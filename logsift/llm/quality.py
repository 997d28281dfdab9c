"""Quality classifier: Bradley-Terry pairwise ranking.

A document's worth is a linear score of features of its text. It is learnt from preference pairs, a document
labelled 1 being preferred to one labelled 0: the chance that it wins is the logistic function of the
difference of the two scores, and the weights minimise the logistic loss on feature differences. The threshold
is a quantile of the scores of all labelled documents that are not held out: that of the share of them labelled 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantile import exact_percentile
from ..session import materialize
from .common import arrow, held_out, utf8_bodies

#: Labelled rows that are learnt from at most (those with the smallest hashes of their ids), pairs in each step, steps,
#: and the weight decay. All documents are scored, whatever the bound.
SAMPLE, PAIRS, STEPS, DECAY = 12_000, 1_024, 400, 1e-3
#: Reported for a score at the threshold.
CUT = 0.7

_BIGRAMS, _FIGURES, _PRIOR = 256, 10, 100  # a short text's shares are drawn towards 0 as by _PRIOR more bytes
_CLASS = np.zeros(256, np.int64)  # kind of each byte: 0 other ASCII
for _kind, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:'\"?()-", b"!", b"#$%&*+=@^~", b"|<>[]{}\\/_`"), 1):
    _CLASS[list(_set)] = _kind
_CLASS[128:] = 10
_KINDS = 11
N_FEATURES = _KINDS + _KINDS + _FIGURES + _BIGRAMS


def features(body: bytes) -> np.ndarray:
    """Shares of kinds of bytes and of the last bytes of words, figures of words and lines, and hashed pairs of bytes."""
    out = np.zeros(N_FEATURES, np.float32)
    if not body:
        return out
    raw = np.frombuffer(body, np.uint8)
    kind = _CLASS[raw]
    out[:_KINDS] = np.bincount(kind, minlength=_KINDS) / len(raw)
    blank = (kind == 4) | (kind == 5)
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True])
    out[_KINDS : 2 * _KINDS] = np.bincount(kind[ends], minlength=_KINDS) / max(1, len(ends))
    words = body.split()
    lines = body.split(b"\n")
    if words:
        n, length = len(words), np.array([len(w) for w in words])
        # repeats of long words tell copied text from common words
        long = [w for w in words if len(w) >= 6]
        same = sum(map(bytes.__eq__, words, words[1:])) / n
        figures = (len(set(words)) / n, length.mean() / 10, length.std() / 10, sum(map(bytes.isupper, words)) / n, (len(long) - len(set(long))) / (len(long) + 10), same, float(same > 0.1), len(set(lines)) / len(lines), np.log1p(n) / 10, n / len(lines) / 100)
        out[2 * _KINDS : 2 * _KINDS + _FIGURES] = figures
    pair = (raw[:-1].astype(np.uint32) * 31 + raw[1:] * np.uint32(7)) % _BIGRAMS
    out[2 * _KINDS + _FIGURES :] = np.bincount(pair, minlength=_BIGRAMS) / (len(pair) + _PRIOR)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of feature rows, fed one by one so that they do not depend on the batch."""
        return np.array([float(((r - self.mean) / self.scale).dot(self.weights)) for r in x.astype(np.float64)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores in (0, 1), exactly ``CUT`` at the threshold."""
        z = np.clip(self.worth(x) - self.threshold, -500, 500) + np.log(CUT / (1 - CUT))
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, decay: float = DECAY) -> Model:
    """Bradley-Terry weights from feature rows and labels 0 / 1. With only one label there is no pair to learn from: all
    scores are then equal and at the threshold."""
    x = x.astype(np.float32)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = x.shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(n), np.ones(n), np.zeros(n), 0.0)
    mean, scale = x.mean(axis=0, dtype=np.float64).astype(np.float32), x.std(axis=0, dtype=np.float64).astype(np.float32)
    scale[scale < 1e-6] = 1.0
    z = (x - mean) / scale
    draw = np.random.default_rng(7)
    w, m, v = (np.zeros(n, np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
        loses = 1 / (1 + np.exp(np.clip(d @ w, -80, 80)))
        g = -(loses @ d) / pairs + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(mean, scale, w, 0.0)
    model.threshold = float(np.quantile(model.worth(x), len(bad) / len(y), method="midpoint"))
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(x) for x in utf8_bodies(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("hash"), pa.array(rows, pa.list_(pa.float32()))], names=["id", "label", "hash", "x"])


def _worths(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            x = np.array([features(t) for t in utf8_bodies(b.column("text"))], np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m.worth(x))], names=["id", "worth"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Fits on labelled rows that are not held out (crc32 of the id modulo 4 is not 2): the weights on those of at most ``sample``
    ids and labels, chosen by the hash of the id, and the threshold on all of them. Labels other than 0 and 1 and rows
    without an id do not count; an id labelled more than once is learnt with each of its labels. Rows of equal id, label and
    text are learnt from once, and the ``2 * sample`` rows with the smallest hashes where ids repeat; the threshold counts each row."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"), 4, 2)).distinct()
    few = marks.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    own = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("id").isNotNull() & ~held_out(F.col("id"), 4, 2))
    rows = own.join(F.broadcast(few), "id").select("id", "label", F.xxhash64("id", "text").alias("hash"), "text")  # sample bounds few
    made = arrow(rows, _featurise, f"id {docs.schema['doc_id'].dataType.simpleString()}, label int, hash long, x array<float>")
    got = made.dropDuplicates(["id", "label", "hash"]).orderBy("hash", "id", "label").limit(2 * sample).select("label", "x").toArrow()
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in got.column("x").chunks] or [np.zeros(0)]).astype(np.float32).reshape(-1, N_FEATURES)
    model = fit(x, np.array(got.column("label").to_pylist(), np.int64))
    if model.weights.any():
        shared = docs.sparkSession.sparkContext.broadcast(model)
        worths = arrow(own, _worths(shared), T.StructType([own.schema["id"], T.StructField("worth", T.DoubleType())]))
        all_ = materialize(worths.join(marks, "id").select("label", "worth"), "quality-worths")
        model.threshold = exact_percentile(all_, "worth", all_.agg(F.avg(1 - F.col("label"))).first()[0])
    return model


def _scorer(model, keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = b.column("row").field(b.column("row").type.get_field_index("text"))
            x = np.array([features(t) for t in utf8_bodies(texts)], np.float32).reshape(-1, N_FEATURES)
            kept = [b.column("row")] if keep else []
            yield pa.RecordBatch.from_arrays([b.column("id"), *kept, pa.array(m.score(x))], names=["id", *["row"] * keep, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """(id, score) of every row of ``docs``, learnt from ``labels`` (doc_id, quality); higher scores: label 1 is likelier.
    With ``keep`` also the struct ``row`` of all columns of ``docs``, whatever their names.

    Only the text counts. Null texts are scored as empty ones, which have all features zero; repeated rows get the
    same score; without labels of both kinds every score is ``CUT``; an empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep else ["text"])])
    rows = docs.select(F.col("doc_id").alias("id"), row.alias("row"))
    return arrow(rows, _scorer(model, keep), T.StructType([rows.schema["id"], *[rows.schema["row"]] * keep, T.StructField("score", T.DoubleType())]))


def good_only(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows scored below the threshold."""
    kept = score(docs, labels, sample, keep=True).filter(F.col("score") >= CUT)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
