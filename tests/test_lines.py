"""Golden rows for the line functions (FIXTURES.md §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logsift.functions import lines as L
from logsift.sources.text import parse_lenient

INGEST = dt.datetime(2024, 5, 6, 7, 8, 9)


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def col_values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize("line,expected", [
    ("login:   bob from 192.168.0.666", "login: [USER_MASKED] from [IP_MASKED]"),
    ("USERNAME:al ice", "USERNAME: [USER_MASKED] ice"),
    ("user: a.b@c.org", "user: [EMAIL_MASKED]"),
    ("1.2.3.4.5", "[IP_MASKED].5"),
    ("k=" + "a1" * 16 + " x", "k=[TOKEN_MASKED] x"),
    ("ß10.0.0.1", "ß10.0.0.1"),
    ("user: étienne", "user: [USER_MASKED]"),
])
def test_mask(spark, line, expected):
    assert col_values(one_col(spark, [line]), L.mask_sensitive("v")) == [expected]


def test_noise(spark):
    dropped = ["HEARTBEAT ok", "Health check passed", "cron job scheduled", "[anything]"]
    kept = ["[a] b", "check health", "cron done"]
    df = one_col(spark, dropped + kept)
    assert col_values(df.filter(~L.is_noise("v")), "v") == kept


def test_event_time(spark):
    cases = [
        ("2024-01-02T03:04:05 x", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02 03:04:05 x", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("01/02/2024 03:04:05 x", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("1704164645 x", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("1704164645123 x", dt.datetime(2024, 1, 2, 3, 4, 5, 123000)),
        ("x", INGEST),
        ("2024-13-02T03:04:05 x", INGEST),
        ("id 12345678901 x", INGEST),  # 11 digits is no epoch token
    ]
    df = one_col(spark, [c for c, _ in cases])
    assert col_values(df, L.event_time("v", INGEST)) == [e for _, e in cases]


def test_ensure_timestamp(spark):
    df = one_col(spark, ["no time here", "2024-01-02 03:04:05 has", "T 2024-01-02T03:04:05", "id 1234567890123"])
    out = col_values(df, L.ensure_timestamp("v", INGEST))
    assert out == ["2024-05-06T07:08:09 no time here", "2024-01-02 03:04:05 has", "T 2024-01-02T03:04:05",
                   "id 1234567890123"]


def test_strip_and_blank(spark):
    df = one_col(spark, ["\t a b  　", "   ", " ", None, "x"])
    assert col_values(df.filter(L.is_nonblank("v")), L.strip_ws("v")) == ["a b", "x"]


def test_display(spark):
    df = one_col(spark, ["2024-01-01T00:00:00 ERROR: boom", "nospace", "Attack detected"])
    rows = df.select(L.display_flag("v"), L.display_time("v"), L.display_message("v"), L.is_error_line("v")).collect()
    assert [tuple(r) for r in rows] == [
        (True, "ERROR:", "ERROR: boom", True),
        (False, None, "nospace", False),
        (True, "detected", "detected", False),
    ]


def test_lenient_csv(spark):
    df = one_col(spark, ["a,b,3,T,ts", "a,3,T", "a"], "value")
    rows = parse_lenient(df).select("raw_log", "event_id", "event_template", "ts_text").collect()
    assert [tuple(r) for r in rows] == [("a,b", "3", "T", "ts"), ("a", "3", "T", ""), ("a", "", "", "")]


def test_read_logs_exact_line_numbers(spark, tmp_path):
    from logsift.sources.text import read_logs
    lines_a = [f"2024-01-01T00:00:{i % 60:02d} line {i}" if i % 7 else "   " for i in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(lines_a) + "\n")
    (tmp_path / "b.log").write_text("x\n\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # several splits per file
    try:
        df = read_logs(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")], source="test")
        got = {(r["file"].rsplit("/", 1)[-1], r["line_no"]): r["raw_log"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("a.log", i): t for i, t in enumerate(lines_a) if t.strip()}
    want.update({("b.log", 0): "x", ("b.log", 2): "y"})
    assert got == want


def test_evaluate_once_equals_with_column(spark):
    df = one_col(spark, ["user: bob heartbeat", "  x 10.0.0.1 ", "", "[a]", "login: amy"])
    a = df.filter(L.is_nonblank("v")).withColumn("v", L.clean_line("v", INGEST)).filter(~L.is_noise("v"))
    b = L.evaluate_once(df.filter(L.is_nonblank("v")), v=L.clean_line("v", INGEST)).filter(~L.is_noise("v"))
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())
    # the noise filter reads the computed column; the regex chain is not copied into it
    plan = b._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [ln for ln in plan if ln.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("regexp_replace" in ln for ln in filters)
    plan_a = a._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("regexp_replace" in ln for ln in plan_a if ln.lstrip(" :+-").startswith("Filter"))


def test_read_logs_drops_undecodable_bytes(spark, tmp_path):
    from logsift.sources.text import read_logs
    (tmp_path / "c.log").write_bytes(b"ok\xff line\n\xfe\n  tail  \n")
    rows = read_logs(spark, str(tmp_path / "c.log")).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw_log"]) for r in rows] == [(0, "ok line"), (2, "tail")]


def test_quick_masks_and_trims_equal_the_plain_patterns(spark):
    """What rules a pattern out beforehand changes no result: every white-space character, line ends and near misses."""
    from logsift.config import MASK_RULES, NOISE_PATTERNS
    from logsift.operators import templates as TM

    some = ["a@b.co", "x a.b@c-d.org, y@z", "USER: bob", "login:é", "uſer: x", "time 10:20", "k" * 31, "_" + "k" * 40 + "é", "é" + "k" * 32, "10.1.2.3", "x10.1.2.3", "1.2.3",
            "heartbeat", "HEALTH of a check", "[x]", "a [x]", "kernel x log", "2024-01-02T03:04:05 a b", "x  1 y", "", " ", None]
    ends = [f"{a}x y{a}" for a in [*map(chr, range(1, 0x3010)), " \u2028", "\t\x85", "\n\u2029 "]]
    df = spark.createDataFrame([(t,) for t in [*some, *ends]], "t string")
    masked = F.col("t")
    for name, pattern, repl in MASK_RULES:
        masked = F.regexp_replace(masked, "(?U)" + pattern if name == "username" else pattern, repl.replace("\\1", "$1"))
    body = F.regexp_replace(F.regexp_replace("t", TM.LEADING_TIME, ""), r"^\s+|\s+$", "")
    tokens = F.transform(F.split(body, r"\s+"), lambda x: F.when(x.rlike(r"\d"), F.lit(TM.PARAM)).otherwise(x))
    pairs = [(L.mask_sensitive("t"), masked), (L.strip_ws("t"), F.regexp_replace("t", f"^{L.WHITESPACE}+|{L.WHITESPACE}+$", "")),
             (L.is_noise("t"), F.col("t").rlike("(?i)" + "|".join(NOISE_PATTERNS))), (TM.signature_tokens("t"), tokens)]
    for new, plain in pairs:
        assert df.filter(~new.eqNullSafe(plain)).collect() == []


def test_cleaning_names_the_line_once(spark):
    """The patterns of a line's cleaning stand once in the plan, however often their result is used."""
    x = spark.createDataFrame([("a",)], "raw string").select(L.clean_line("raw", dt.datetime(2024, 2, 1)).alias("c"))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("raw#") <= 2
