"""Log-shaped views derived from the driver's tables.

The test tables carry no server logs, so raw lines are rendered from ``events`` by a
fixed rule (FIXTURES.md §3) and prose lines are taken from ``documents``. Both grow
with the tables they are read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import iso_text


def _s(c):
    return c.cast("string")


WORDS = ("amber", "birch", "cedar", "delta", "ember", "flint", "grove")
ZONES = ("north", "south", "east", "west", "core")


def _word(words, i):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


def log_lines(events: DataFrame) -> DataFrame:
    """(line_no, ts, server_id, raw_log) rendered from ``events`` (one line per event).

    What the operators need is in them: alphabetic words that vary (templates must merge),
    kinds of one length and first word that must not, things to mask, noise of three forms,
    lines without any time (every ninth, and those in brackets) and, among them, repeats.
    """
    eid, uid = F.col("event_id"), F.col("user_id")
    word, zone = _word(WORDS, eid), _word(ZONES, uid)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.col("event_type")
    bracket = (kind == "view") & (eid % 3 == 2)
    msg = (F.when(kind == "signup", join("INFO account opened for tenant ", word, " in zone ", zone, " by login: u", _s(uid)))
            .when(kind == "click", join("INFO request served by worker ", word, " from 10.1.2.", _s(eid % 250 + 1), " after ", _s(eid % 90), " ms total"))
            .when(kind == "purchase", join("WARN slow payment at gateway ", zone, " contact ops", _s(uid), "@example.com"))
            .when(bracket, join("[page view traced by ", word, "]"))
            .when((kind == "view") & (eid % 3 == 1), join("DEBUG cron says that a scheduled scan of ", zone, " ended"))
            .when(kind == "view", join("DEBUG health of service ", word, " on check ", _s(eid % 100)))
            .when(eid % 4 == 0, join("ERROR buffer of node ", word, " lost ", _s(100 + eid % 900), " frames"))
            .when(eid % 4 == 1, join("FATAL store ", zone, " refused a link from 172.16.0.", _s(uid % 200 + 1)))
            .when(eid % 4 == 2, join("CRITICAL unknown frame kind ", word, " seen at port ", _s(eid % 64)))
            .otherwise(join("SECURITY wrong key ", F.lit("k" * 32), _s(eid % 10), " sent for user: u", _s(uid))))
    timed = ~bracket & (eid % 9 != 0)
    return events.select(
        eid.alias("line_no"),
        F.col("ts"),
        F.concat(F.lit("server-"), _s(uid % 8)).alias("server_id"),
        F.when(timed, F.concat(iso_text("ts"), F.lit(" "), msg)).otherwise(msg).alias("raw_log"),
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_idx, source, line) with one row per '\\n'-separated line of a document."""
    return documents.select(
        "doc_id", "source",
        F.posexplode(F.split(F.col("text"), "\n")).alias("line_idx", "line"),
    ).select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), "source", "line")


def score_series(events: DataFrame, bucket: str = "6 hours") -> DataFrame:
    """Closed-form per-server score series (FIXTURES.md §3).

    (server, ts, n, e, score): ``e`` is the error share of a 6-hour bucket and ``score``
    ``tanh((mean_e - e) / stddev_pop_e)`` over the server's buckets, rounded to 6 places.
    The per-server mean/std is a window over the already aggregated buckets (no join).
    """
    w = (events
         .groupBy((F.col("user_id") % 8).alias("server"),
                  F.window("ts", bucket).start.alias("ts"))
         .agg(F.count(F.lit(1)).alias("n"),
              F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("e")))
    per_server = Window.partitionBy("server")
    mu = F.avg("e").over(per_server)
    sd = F.stddev_pop("e").over(per_server)
    return w.select("server", "ts", "n", "e", F.round(F.tanh((mu - F.col("e")) / sd), 6).alias("score"))


def score_frame(events: DataFrame, bucket: str = "6 hours") -> DataFrame:
    """``score_series`` in the shape the monitoring operators take.

    (server_id, window_id, ts, score, prediction, n_events, error_share); window_id is the
    bucket number since the epoch, so it orders the rows of a server like ts.
    """
    s = score_series(events, bucket)
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    width = int(interval_seconds(bucket))
    return s.select(
        F.concat(F.lit("server-"), F.col("server").cast("string")).alias("server_id"),
        (secs / width).cast("bigint").alias("window_id"),
        "ts", "score",
        F.when(F.col("score") < 0, -1).otherwise(1).alias("prediction"),
        F.col("n").alias("n_events"),
        F.col("e").alias("error_share"),
    )


def interval_seconds(interval: str) -> int:
    n, unit = interval.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(n) * mult
