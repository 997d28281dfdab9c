"""Column functions on raw log lines (O-P1 … O-P7).

All of them are plain Catalyst expressions (regexp_replace, rlike, try_to_timestamp),
so they stay inside whole-stage codegen and need no Python worker.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MASK_RULES, NOISE_PATTERNS

# White space as Python's str.strip() sees it (ASCII controls, NEL and Unicode separators).
_WS = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"
#: The same characters one by one, for trimming without a pattern.
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = f"[{_WS}]"
NON_WHITESPACE = f"[^{_WS}]"

# Time forms recognised in a line (fixed values).
T_FORM = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
SPACE_FORM = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
SLASH_FORM = r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}"
DIGIT_RUN = r"\d{10,13}"
# An epoch value is a stand-alone token of exactly 10 (seconds) or 13 (milliseconds) digits.
EPOCH_TOKEN = r"(^|\s)(\d{13}|\d{10})(\s|$)"

EPOCH0 = "1970-01-01 00:00:00"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c, fn) -> Column:
    """``fn`` of a column whose expression is evaluated once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(_c(c)), fn), 0)


def ts_lit(value) -> Column:
    """A timestamp_ntz literal (UTC wall clock) from a datetime, a string or a Column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def clean_line(c, ingest_ts) -> Column:
    """Strip, prefix a time when missing, mask: the processed form of a raw line."""
    return mask_sensitive(ensure_timestamp(strip_ws(c), ingest_ts))


def strip_ws(c) -> Column:
    """O-P1: strip Unicode white space at both ends."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def is_nonblank(c) -> Column:
    """O-P1 filter: not null and not empty after stripping (= holds a non-white-space char)."""
    return _c(c).rlike(NON_WHITESPACE)


def evaluate_once(df, **cols: Column):
    """Add or replace columns whose (expensive) expressions are filtered on later.

    Catalyst pushes a filter below a projection by substituting the column's expression,
    so a filter on a regex chain would evaluate the chain again in the filter. A one-row
    generator is a boundary for that rewrite: each expression runs once per row and later
    filters read its value. Everything stays in the JVM.
    """
    keep = [c for c in df.columns if c not in cols]
    packed = F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))
    out = df.select(*keep, F.inline(packed))
    order = [c for c in df.columns] + [n for n in cols if n not in df.columns]
    return out.select(*order)


# What stands before a mask rule's first character: it rules out most places at once and changes no match (a token is
# found at its run's start or nowhere).
_MASK_AHEAD = {"ip_address": r"(?=\d)", "token": r"(?<!\p{Alnum})"}
# What a line has that a mask rule applies to.
_MASK_NEEDS = {"email": lambda x: x.contains("@"), "username": lambda x: x.contains(":") & x.rlike("[rReEnN]:")}


def _replace(c: Column, pattern: str, repl: str, needs=None) -> Column:
    if needs is None:
        return F.regexp_replace(c, pattern, repl)
    return once(c, lambda x: F.when(needs(x), F.regexp_replace(x, pattern, repl)).otherwise(x))


def mask_sensitive(c) -> Column:
    """O-P2: IP, e-mail, token, user name, in this order."""
    out = _c(c)
    for name, pattern, repl in MASK_RULES:
        if name == "username":
            # Java's \w is ASCII unless (?U); user names may be non-ASCII
            pattern = "(?U)" + pattern
            repl = repl.replace("\\1", "$1")
        pattern = _MASK_AHEAD.get(name, "") + pattern
        out = _replace(out, pattern, repl, _MASK_NEEDS.get(name))
    return out


def has_timestamp(c) -> Column:
    """O-P3: any recognised time form anywhere in the line (long digit runs count)."""
    c = _c(c)
    return c.rlike(T_FORM) | c.rlike(SPACE_FORM) | c.rlike(SLASH_FORM) | c.rlike(DIGIT_RUN)


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def ensure_timestamp(c, ingest_ts) -> Column:
    """O-P3: prefix the ingest time (ISO, UTC) when the line carries no time."""
    return once(c, lambda x: F.when(has_timestamp(x), x).otherwise(F.concat(iso_text(ts_lit(ingest_ts)), F.lit(" "), x)))


def _parse(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def event_time(c, ingest_ts=None) -> Column:
    """O-P4: event time of a line as timestamp_ntz (UTC).

    First parseable of: ISO T form, space form, slash form (MM/dd/yyyy), epoch token
    (10 digits seconds, 13 digits milliseconds); else ``ingest_ts`` (null when not given).
    Invalid dates (month 13) are null, not errors.
    """
    c = _c(c)
    epoch = F.regexp_extract(c, EPOCH_TOKEN, 2)
    epoch0 = F.lit(EPOCH0).cast("timestamp_ntz")
    epoch_ts = (F.when(F.length(epoch) == 10,
                       F.timestamp_add("SECOND", epoch.cast("bigint"), epoch0))
                 .when(F.length(epoch) == 13,
                       F.timestamp_add("MILLISECOND", epoch.cast("bigint"), epoch0)))
    parts = [
        _parse(F.regexp_extract(c, T_FORM, 0), "yyyy-MM-dd'T'HH:mm:ss"),
        _parse(F.regexp_extract(c, SPACE_FORM, 0), "yyyy-MM-dd HH:mm:ss"),
        _parse(F.regexp_extract(c, SLASH_FORM, 0), "MM/dd/yyyy HH:mm:ss"),
        epoch_ts,
    ]
    if ingest_ts is not None:
        parts.append(ts_lit(ingest_ts))
    return F.coalesce(*parts)


# Every pattern's first character is tried first.
NOISE_REGEX = "(?i)(?=[" + "".join(sorted({re.escape(re.sub(r"^\^?\\?", "", p)[0]) for p in NOISE_PATTERNS})) + "])(?:" + "|".join(NOISE_PATTERNS) + ")"


def is_noise(c) -> Column:
    """O-P5: any noise pattern, case-insensitive."""
    return _c(c).rlike(NOISE_REGEX)


def is_error_line(c) -> Column:
    """O-P6: contains ERROR or FATAL (case-sensitive)."""
    c = _c(c)
    return c.contains("ERROR") | c.contains("FATAL")


def display_flag(c) -> Column:
    """O-P7: severity flag shown for a line."""
    c = _c(c)
    return c.contains("ERROR") | c.contains("Attack")


def display_time(c) -> Column:
    """O-P7: second blank-separated token (null when absent)."""
    return F.get(F.split(_c(c), " "), 1)


def display_message(c) -> Column:
    """O-P7: text after the first blank (the whole line when there is none)."""
    c = _c(c)
    return F.substr(c, F.instr(c, " ") + F.lit(1))
