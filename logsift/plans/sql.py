"""DuckDB twins of the registered queries (the correctness oracle).

Each query string reads the driver's tables (``events``, ``documents`` …) directly and
re-derives the same views in SQL, so Spark and DuckDB start from identical inputs.
Timestamps are returned as text with microseconds and floats rounded to 6 places
(risk/health to 1), as the Spark side does.
"""

from __future__ import annotations

from ..config import LEVELS, MASK_RULES, NOISE_PATTERNS

WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
TS_FMT = "%Y-%m-%d %H:%M:%S.%f"
INGEST = "2024-02-01 00:00:00"
AS_OF = "2024-01-30 00:00:00"


def ts_text(c: str) -> str:
    return f"strftime({c}, '{TS_FMT}')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def mask(c: str) -> str:
    out = c
    for _, pattern, repl in MASK_RULES:
        p = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '{repl}', 'g')"
    return out


NOISE = "(?i)" + "|".join(NOISE_PATTERNS)


def has_timestamp(c: str) -> str:
    forms = (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}", r"\d{13}", r"\d{10}")
    return "regexp_matches(" + c + ", '" + "|".join(forms) + "')"


def ensure_timestamp(c: str, ingest: str = INGEST) -> str:
    return f"case when {has_timestamp(c)} then {c} else '{ingest.replace(' ', 'T')} ' || {c} end"


def is_noise(c: str) -> str:
    return f"regexp_matches({c}, '{NOISE}')"


def level(c: str, fallback: str = "NORMAL") -> str:
    arms = " ".join(f"when {c} <= {b} then '{n}'" for n, b in LEVELS)
    return f"case {arms} else '{fallback}' end"


def fmt3(c: str) -> str:
    return f"printf('%.3f', 0.0 + round({c} * 1000) / 1000)"


LEADING_TIME = (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
                r"|\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}|\d{13}|\d{10})\s+")


def sig_tokens(c: str) -> str:
    body = f"regexp_replace(regexp_replace({c}, '{LEADING_TIME}', ''), '^\\s+|\\s+$', '', 'g')"
    return (f"list_transform(string_split_regex({body}, '\\s+'), "
            f"lambda t: case when regexp_matches(t, '\\d') then '<*>' else t end)")


def event_time(c: str, ingest: str | None = INGEST) -> str:
    t = f"try_strptime(regexp_extract({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}', 0), '%Y-%m-%dT%H:%M:%S')"
    s = f"try_strptime(regexp_extract({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}', 0), '%Y-%m-%d %H:%M:%S')"
    sl = f"try_strptime(regexp_extract({c}, '\\d{{2}}/\\d{{2}}/\\d{{4}} \\d{{2}}:\\d{{2}}:\\d{{2}}', 0), '%m/%d/%Y %H:%M:%S')"
    e = f"regexp_extract({c}, '(^|\\s)(\\d{{13}}|\\d{{10}})(\\s|$)', 2)"
    ep = (f"case when length({e}) = 10 then make_timestamp(cast({e} as bigint) * 1000000) "
          f"when length({e}) = 13 then make_timestamp(cast({e} as bigint) * 1000) end")
    parts = [t, s, sl, ep] + ([f"timestamp '{ingest}'"] if ingest else [])
    return "coalesce(" + ", ".join(parts) + ")"


LOG_LINES = """rendered as (
  select event_id, ts, user_id, event_type,
    (['amber', 'birch', 'cedar', 'delta', 'ember', 'flint', 'grove'])[event_id % 7 + 1] as word,
    (['north', 'south', 'east', 'west', 'core'])[user_id % 5 + 1] as zone,
    case event_type when 'signup' then 'signup' when 'click' then 'click' when 'purchase' then 'purchase'
      when 'view' then 'view' || cast(event_id % 3 as varchar) else 'other' || cast(event_id % 4 as varchar) end as kind
  from events),
log_lines as (
  select event_id as line_no, ts, 'server-' || cast(user_id % 8 as varchar) as server_id,
    case when kind = 'view2' or event_id % 9 = 0 then '' else strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' end || case kind
      when 'signup' then 'INFO account opened for tenant ' || word || ' in zone ' || zone || ' by login: u' || cast(user_id as varchar)
      when 'click' then 'INFO request served by worker ' || word || ' from 10.1.2.' || cast(event_id % 250 + 1 as varchar)
        || ' after ' || cast(event_id % 90 as varchar) || ' ms total'
      when 'purchase' then 'WARN slow payment at gateway ' || zone || ' contact ops' || cast(user_id as varchar) || '@example.com'
      when 'view2' then '[page view traced by ' || word || ']'
      when 'view1' then 'DEBUG cron says that a scheduled scan of ' || zone || ' ended'
      when 'view0' then 'DEBUG health of service ' || word || ' on check ' || cast(event_id % 100 as varchar)
      when 'other0' then 'ERROR buffer of node ' || word || ' lost ' || cast(100 + event_id % 900 as varchar) || ' frames'
      when 'other1' then 'FATAL store ' || zone || ' refused a link from 172.16.0.' || cast(user_id % 200 + 1 as varchar)
      when 'other2' then 'CRITICAL unknown frame kind ' || word || ' seen at port ' || cast(event_id % 64 as varchar)
      else 'SECURITY wrong key ' || repeat('k', 32) || cast(event_id % 10 as varchar) || ' sent for user: u' || cast(user_id as varchar)
      end as raw_log,
    event_type, kind
  from rendered)"""

DOC_LINES = """doc_lines as (
  select doc_id, source, unnest(range(len(string_split(text, chr(10))))) as line_idx,
         unnest(string_split(text, chr(10))) as line
  from documents)"""

SCORES = """w6 as (
  select user_id % 8 as server, time_bucket(interval '6 hours', ts) as ts, count(*) as n,
         avg(cast(case when event_type = 'error' then 1 else 0 end as double)) as e
  from events group by 1, 2),
st6 as (select server, avg(e) as mu, stddev_pop(e) as sd from w6 group by 1),
score_series as (select server, ts, n, e, 0.0 + round(tanh((mu - e) / sd), 6) as score from w6 join st6 using (server)),
scores as (
  select 'server-' || cast(server as varchar) as server_id, cast(epoch_us(ts) // 21600000000 as bigint) as window_id,
         ts, score, case when score < 0 then -1 else 1 end as prediction, n as n_events, e as error_share
  from score_series)"""

# processed lines: masked, noise removed (the input of mining)
CLEAN = """clean as (
  select line_no, ts, server_id, kind, """ + mask("raw_log") + """ as raw_log from log_lines
  where not """ + is_noise(mask("raw_log")) + """)"""

SIGNED = """signed as (
  select *, array_to_string(tok, ' ') as signature, len(tok) as n_tokens, tok[1] as first_token
  from (select *, """ + sig_tokens("raw_log") + """ as tok from clean))"""

# The shapes of one kind of line share all but their varying words and merge into one template;
# kinds are unlike each other and do not. So a template has '<*>' wherever its kind's shapes differ.
MINED = """parts as (
  select distinct kind, pos, token from (
    select kind, generate_subscripts(tok, 1) as pos, unnest(tok) as token from signed)),
mined as (
  select kind, string_agg(token, ' ' order by pos) as event_template from (
    select kind, pos, case when count(*) = 1 then min(token) else '<*>' end as token from parts group by 1, 2) group by 1),
assigned as (
  select signed.*, event_template, substr(md5(event_template), 1, 16) as event_id from signed join mined using (kind))"""

# Lines as ingested: time ensured, masked, noise dropped, first of each (line, event) kept.
PROCESSED = """clean as (
  select line_no, ts, server_id, kind, n as raw_log from (
    select *, """ + mask(ensure_timestamp("raw_log")) + """ as n from log_lines)
  where not """ + is_noise("n") + """)"""

STRUCTURED = """structured as (
  select line_no, server_id, raw_log, event_id, event_template, """ + event_time("raw_log") + """ as ets from (
    select *, row_number() over (partition by raw_log, event_id order by line_no) as rn from assigned) where rn = 1)"""

MINUTE_COUNTS = """ev as (select 'server-' || cast(user_id % 8 as varchar) as server_id, ts, event_type as event_id from events),
t0 as (select min(ts) as t0 from ev),
win as (select ev.*, cast((epoch_us(ts) - epoch_us(t0)) // 60000000 as bigint) as window_id from ev, t0),
counts as (select server_id, window_id, event_id, count(*) as cnt from win group by 1, 2, 3)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def recursive_alerts(throttle: int, suppress: int) -> str:
    """A3 as a recursive CTE: one step per alerting row of a server, state = last emitted
    time and the suppression end of each level (no causes on this input)."""
    T, S = throttle * 1_000_000, suppress * 1_000_000
    lv = [n for n, _ in LEVELS]
    cols = ", ".join(f"e_{n.lower()}" for n in lv)
    first_ends = ", ".join(f"case when level = '{n}' then t + {S} end" for n in lv)
    cur_end = "(case k.level " + " ".join(f"when '{n}' then m.e_{n.lower()}" for n in lv) + " end)"
    thr = f"(m.last_emit is not null and k.t - m.last_emit < {T})"
    sup = f"(not {thr} and {cur_end} is not null and k.t <= {cur_end})"
    emit = f"(not {thr} and not {sup})"
    dec = f"case when {thr} then 'dropped' when {sup} then 'suppressed' else 'emitted' end"
    new_ends = ", ".join(
        f"case when {emit} and k.level = '{n}' then k.t + {S} else m.e_{n.lower()} end" for n in lv)
    return "with recursive " + SCORES + f""",
lv as (select server_id, window_id, ts, score, {level('score')} as level from scores),
k as (select *, row_number() over (partition by server_id order by ts, window_id) as rn, epoch_us(ts) as t
      from lv where level <> 'NORMAL'),
m(server_id, rn, t, level, decision, last_emit, {cols}) as (
  select server_id, rn, t, level, 'emitted', t, {first_ends} from k where rn = 1
  union all
  select k.server_id, k.rn, k.t, k.level, {dec}, case when {emit} then k.t else m.last_emit end, {new_ends}
  from m join k on k.server_id = m.server_id and k.rn = m.rn + 1),
alerts as (
  select k.server_id, k.window_id, k.ts, k.score, k.level, m.decision, m.decision = 'suppressed' as suppressed,
         case when m.decision = 'suppressed' then 'Anomaly detected on ' || k.server_id
              else '[' || k.level || '] Anomaly detected on ' || k.server_id || ' (score: ' || {fmt3('k.score')} || ')' end as message
  from m join k using (server_id, rn) where m.decision <> 'dropped')
"""
