"""Template mining (O-T1 … O-T3), set-based and order-independent.

1. ``signatures``: every line is cut to its shape (leading time dropped, white-space tokens,
   digit-bearing tokens → ``<*>``) and the shapes are counted. This is a JVM-side
   expression plus a partial aggregate, so a line repeated in a third of all rows
   collapses to one row per task before anything moves.
2. ``mine_templates``: shapes of one bucket (token count, first token) are clustered around
   leaders in a fixed order (support falling, then a hash): a shape follows the most similar leader
   when the share of equal positions is at least ``similarity``, else it is one. A cluster's
   template has ``<*>`` where its shapes differ. Leaders are not alike, and templates even less, so one
   pass is all. Buckets of up to ``SMALL`` shapes are clustered by the task that
   holds them, larger ones by joins over an inverted index (``leaders.py``), with the same result.
3. ``assign_templates``: lines join the (signature → template) table on the signature.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from ..functions.lines import once
from ..session import materialize, ship_package
from .leaders import BUCKET, PARAM, clusters, need, order_columns

#: Shapes of a bucket that one task clusters by itself, and leaders that are compared one by one.
SMALL, FEW = 1 << 16, 16
# A leading time (any supported form, optional fraction and zone) followed by blanks.
LEADING_TIME = (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
                r"|\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}|\d{13}|\d{10})\s+")


def signature_tokens(raw) -> F.Column:
    """Tokens of a line's shape: time prefix removed, split on white space, digits → <*>."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return once(once(F.regexp_replace(raw, LEADING_TIME, ""), _trimmed), _tokens)


def _tokens(body: F.Column) -> F.Column:
    parts = F.split(body, r"\s+")
    return F.when(body.rlike(r"\d"), F.transform(parts, lambda t: F.when(t.rlike(r"\d"), F.lit(PARAM)).otherwise(t))).otherwise(parts)


def _trimmed(x: F.Column) -> F.Column:
    """Without white space at both ends. A line end that is no white space to the pattern (U+0085, U+2028, U+2029) may
    follow what it takes off."""
    ends = x.contains("\u0085") | x.contains("\u2028") | x.contains("\u2029")
    return F.when(ends, F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.btrim(x, F.lit(" \t\n\x0b\f\r")))


def with_signature(lines: DataFrame, raw: str = "raw_log") -> DataFrame:
    toks = signature_tokens(raw)
    return (lines.withColumn("_tok", toks)
                 .withColumn("signature", F.array_join("_tok", " "))
                 .withColumn("n_tokens", F.size("_tok").cast("bigint"))
                 .withColumn("first_token", F.get("_tok", 0))
                 .drop("_tok"))


def signatures(lines: DataFrame, raw: str = "raw_log") -> DataFrame:
    """O-T1: distinct shapes with their support (partial aggregate, skew-safe)."""
    return _support(with_signature(lines, raw))


def _support(signed: DataFrame) -> DataFrame:
    return signed.groupBy("n_tokens", "first_token", "signature").agg(F.count(F.lit(1)).alias("support"))


def _merge_bucket(sigs: list[str], similarity: float) -> list[str]:
    """Leader clustering of one bucket's shapes (already in order); returns the template of every shape.

    Leaders are found by their features, the (position, token) pairs that a second shape of the bucket has: two shapes with
    ``need`` of them in common share one of the rarest ``size - need + 1`` of either, so a shape is compared only with the
    leaders that it meets under one of these."""
    toks = [s.split(" ") for s in sigs]
    n = len(toks[0])
    least = need(n, similarity)
    often = Counter(f for row in toks for f in enumerate(row))
    codes: dict[str, int] = {PARAM: 0}
    mat = np.array([[codes.setdefault(t, len(codes)) for t in row] for row in toks], dtype=np.int32) if len(sigs) > FEW else None
    met: dict[tuple, list[int]] = {}
    led: list[list[int]] = []  # the members of each leader, itself first
    for i, row in enumerate(toks):
        keys = sorted((often[f], f) for f in enumerate(row) if f[1] != PARAM)
        keys = [f for k, f in keys[:max(0, len(keys) - least + 1)] if k > 1]
        found = set().union(*(met.get(f, ()) for f in keys)) if least else range(len(led))
        best, most = -1, -1
        if len(found) <= FEW or mat is None:
            for k in sorted(found):
                equal = sum(map(eq, toks[led[k][0]], row)) - sum(a == b == PARAM for a, b in zip(toks[led[k][0]], row))
                if equal > most:
                    best, most = k, equal
        else:
            at = np.sort(np.fromiter(found, np.int64, len(found)))
            equal = ((mat[[led[k][0] for k in at.tolist()]] == mat[i]) & (mat[i] != 0)).sum(axis=1)
            best = int(np.argmax(equal))  # the first of those most alike
            best, most = int(at[best]), int(equal[best])
        if best >= 0 and most >= least:
            led[best].append(i)
            continue
        for f in keys:
            met.setdefault(f, []).append(len(led))
        led.append([i])
    out = list(sigs)
    for members in led:
        if len(members) > 1:
            text = " ".join(c[0] if len(set(c)) == 1 else PARAM for c in zip(*(toks[i] for i in members)))
            for i in members:
                out[i] = text
    return out


TEMPLATE_SCHEMA = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("first_token", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("support", T.LongType()),
    T.StructField("event_template", T.StringType()),
])


def _bucket_keys(pdf: pd.DataFrame) -> np.ndarray:
    return (pdf["n_tokens"].astype(str) + "\x00" + pdf["first_token"].fillna("")).to_numpy()


def _mine_sorted(batches, similarity: float):
    """Mine a partition whose rows are sorted by bucket and, inside it, in order.

    A bucket may span Arrow batches: its pieces are kept in a list and joined once when
    the bucket ends (no re-copying per batch). Finished buckets of a batch are emitted
    together; single-shape buckets (most of them) are their own template without a loop.
    """
    cols = [f.name for f in TEMPLATE_SCHEMA.fields]
    parts, pkey = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True)
        key = _bucket_keys(pdf)
        head = 0
        if pkey is not None:
            differs = key != pkey
            head = int(np.argmax(differs)) if differs.any() else len(pdf)
        if head:
            parts.append(pdf.iloc[:head])
        if head == len(pdf):
            continue  # the whole batch continues the open bucket
        out = []
        if parts:
            whole = pd.concat(parts, ignore_index=True)
            out.append(_mine_rows(whole, _bucket_keys(whole), similarity))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = int(starts[-1])
        if last > head:
            out.append(_mine_rows(pdf.iloc[head:last].reset_index(drop=True), key[head:last], similarity))
        parts, pkey = [pdf.iloc[last:]], key[-1]
        if out:  # a batch holding only the still-open bucket emits nothing yet
            yield pd.concat(out, ignore_index=True)[cols]
    if parts:
        whole = pd.concat(parts, ignore_index=True)
        yield _mine_rows(whole, _bucket_keys(whole), similarity)[cols]


def _mine_rows(pdf: pd.DataFrame, key: np.ndarray, similarity: float) -> pd.DataFrame:
    """Template of every row of one or more complete, contiguous buckets."""
    out = pdf["signature"].to_numpy(dtype=object).copy()
    if len(pdf):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(pdf)]
        sigs = pdf["signature"].tolist()
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 1:
                out[a:b] = _merge_bucket(sigs[a:b], similarity)
    pdf = pdf.copy()
    pdf["event_template"] = out
    return pdf


def mine_templates(sigs: DataFrame, similarity: float = DEFAULT.similarity, small: int = SMALL) -> DataFrame:
    """O-T2: (signature → event_template, event_id) for every distinct shape.

    ``event_id`` is a stable hash of the template text (first 16 hex digits of its MD5), so ids do not
    depend on arrival order or on which run mined them. The result does not depend on ``small`` either.
    """
    shapes = sigs.select(F.col("n_tokens").cast("long").alias("n_tokens"), "first_token", "signature", F.col("support").cast("long").alias("support"))
    shapes = materialize(shapes, "shapes")
    large = shapes.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small).select(*[F.col(c).alias(f"_{c}") for c in BUCKET])
    is_large = [shapes[c].eqNullSafe(large[f"_{c}"]) for c in BUCKET]
    if large.limit(1).count():
        mined = _merged(shapes.join(large, is_large, "left_anti"), similarity)
        wide = materialize(shapes.join(large, is_large, "left_semi"), "shapes-large")
        found = materialize(clusters(wide, similarity), "clusters")
        mined = mined.unionByName(wide.join(found, "signature").select(*[f.name for f in TEMPLATE_SCHEMA.fields]))
    else:
        mined = _merged(shapes, similarity)
    return mined.withColumn("event_id", event_id_of("event_template"))


def _merged(shapes: DataFrame, similarity: float) -> DataFrame:
    """Small buckets: each is clustered by the task that holds its sorted rows."""
    x = (shapes.select(*[f.name for f in TEMPLATE_SCHEMA.fields[:-1]])
               .repartition(*BUCKET)
               .sortWithinPartitions(*BUCKET, *order_columns()))
    ship_package(x.sparkSession)
    return x.mapInPandas(lambda it: _mine_sorted(it, similarity), TEMPLATE_SCHEMA)


def event_id_of(template) -> F.Column:
    t = F.col(template) if isinstance(template, str) else template
    return F.substring(F.md5(t), 1, 16)


def assign_templates(lines: DataFrame, templates: DataFrame, raw: str = "raw_log") -> DataFrame:
    """O-T3: every line gets event_id and event_template.

    Hash join on the signature; AQE turns it into a broadcast join when the mined table is
    small at run time and splits a hot signature's partition when it is not. A line whose
    shape is missing from ``templates`` keeps its own shape as template.
    """
    return _assigned(with_signature(lines, raw), templates)


def mine_and_assign(lines: DataFrame, similarity: float = DEFAULT.similarity, raw: str = "raw_log") -> tuple[DataFrame, DataFrame]:
    """O-T2 and O-T3 of the same lines: (lines with event_id and event_template, templates). The lines are cleaned and cut to
    their shapes once, into a table that mining and assigning both read."""
    signed = materialize(with_signature(lines, raw), "signed")
    templates = mine_templates(_support(signed), similarity).persist()  # one row per distinct shape, read by every later step
    return _assigned(signed, templates), templates


def _assigned(signed: DataFrame, templates: DataFrame) -> DataFrame:
    t = templates.select("signature", "event_template", "event_id")
    x = signed.join(t, "signature", "left")
    tmpl = F.coalesce(F.col("event_template"), F.col("signature"))
    return (x.withColumn("event_template", tmpl)
             .withColumn("event_id", F.coalesce(F.col("event_id"), event_id_of(tmpl)))
             .drop("n_tokens", "first_token"))
