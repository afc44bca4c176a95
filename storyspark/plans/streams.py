"""Registered streams over the events table. The SQL says what a batch over all events would."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as op
from ..streaming import timers
from .registry import query


def events(m):
    return op.event_stream(m.spark, m.sf_dir)


def micros(df, *columns):
    """Times as microseconds since 1970."""
    for c in columns:
        df = df.withColumn(c, F.unix_micros(c))
    return df


query("stream_windows", lambda m: micros(op.run(op.windowed(events(m), "1 hour"), "complete", "windows"), "start"),
    "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
query("stream_sliding", lambda m: micros(op.run(op.windowed(events(m), "1 hour", "30 minutes"), "complete", "sliding"), "start").drop("value"),
    "SELECT epoch_us(time_bucket(INTERVAL '30 minutes', ts)) - k * 1800000000 AS start, event_type, count(*) AS events FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
SESSIONS = """SELECT user_id, min(t) AS s, max(t) + 1800000000 AS e, count(*) AS n, arg_max(event_type, t) AS last FROM (SELECT *, sum(CASE WHEN t - p < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS g
              FROM (SELECT user_id, event_type, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, g"""
LATE = "1 hour"
#: What the watermark has passed when all events are there.
PASSED = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)"
HOUR = 3600
ORDERED = "SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, * EXCLUDE (user_id) FROM events"
QUIET, LONGEST = 6 * HOUR, 20 * HOUR
DUE = f"least(last + {QUIET}000000, first + {LONGEST}000000)"
FLUSH = f"{{'first': first, 'moment': {DUE}, 'n': n, 'why': CASE WHEN last + {QUIET}000000 <= {DUE} THEN 'quiet' ELSE 'longest' END}}"
query(
    "str_sync_debounce",
    lambda m: op.run(timers.debounced(events(m), "user_id", QUIET, LONGEST, LATE), "append", "debounce"),
    f"""WITH RECURSIVE e AS ({ORDERED}), u AS (SELECT user_id, max(i) AS most FROM e WHERE t <= {PASSED} GROUP BY user_id),
        f(user_id, i, first, last, n, x) AS (
            SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS STRUCT(first BIGINT, moment BIGINT, n BIGINT, why VARCHAR)) FROM u
            UNION ALL SELECT user_id, i, CASE WHEN due OR first IS NULL THEN t ELSE first END, t, CASE WHEN due THEN 1 ELSE n + 1 END, CASE WHEN due THEN {FLUSH} END
            FROM (SELECT f.user_id, e.i, first, last, n, t, coalesce({DUE} <= t, false) AS due FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1 WHERE t <= {PASSED}))
        SELECT user_id, x.first AS first, x.moment AS moment, x.n AS n, x.why AS why FROM (SELECT user_id, x FROM f UNION ALL SELECT user_id, {FLUSH} FROM f JOIN u USING (user_id) WHERE i = most AND {DUE} <= {PASSED}) WHERE x IS NOT NULL""",
)


def typed(m):
    """Events as what an editor sees: purchases end sentences, signups are other keys, the rest are entities of a note."""
    kind = F.when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "signup", "key").otherwise("entity")
    return events(m).select("user_id", "ts", "event_id", kind.alias("kind"), F.floor(F.col("value") / 100).cast("string").alias("note"), F.col("props").alias("entity"))


query(
    "str_session_flush",
    lambda m: op.run(timers.flushed(typed(m), "user_id", 12 * HOUR, LATE), "append", "sessions"),
    f"""WITH RECURSIVE e AS (SELECT user_id, t, i, CASE event_type WHEN 'purchase' THEN 'end' WHEN 'signup' THEN 'key' ELSE 'entity' END AS kind, CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS own, props AS entity FROM ({ORDERED}) WHERE t <= {PASSED}),
        u AS (SELECT user_id, max(i) AS most FROM e GROUP BY user_id),
        f(user_id, i, note, held, first, last, idle, other) AS (
            SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRUCT(note VARCHAR, first BIGINT, moment BIGINT, n BIGINT, why VARCHAR)), CAST(NULL AS STRUCT(note VARCHAR, first BIGINT, moment BIGINT, n BIGINT, why VARCHAR)) FROM u
            UNION ALL
            SELECT user_id, i, CASE WHEN kind = 'entity' THEN own ELSE note END, CASE kind WHEN 'entity' THEN list_distinct(list_append(CASE WHEN note IS DISTINCT FROM own THEN [] ELSE left_ END, entity)) WHEN 'end' THEN [] ELSE left_ END,
                   CASE WHEN kind = 'entity' AND (len(left_) = 0 OR note IS DISTINCT FROM own) THEN t ELSE first END, CASE WHEN kind = 'entity' OR len(left_) > 0 THEN t ELSE last END, gone,
                   CASE WHEN len(left_) > 0 AND kind = 'entity' AND note IS DISTINCT FROM own THEN {{'note': note, 'first': first, 'moment': t, 'n': len(left_), 'why': 'note'}} WHEN len(left_) > 0 AND kind = 'end' THEN {{'note': note, 'first': first, 'moment': t, 'n': len(left_), 'why': 'end'}} END
            FROM (SELECT f.user_id, e.i, e.t, e.kind, e.own, e.entity, f.note, f.first, f.last, CASE WHEN len(held) > 0 AND last + {12 * HOUR}000000 <= t THEN CAST([] AS VARCHAR[]) ELSE held END AS left_,
                         CASE WHEN len(held) > 0 AND last + {12 * HOUR}000000 <= t THEN {{'note': note, 'first': first, 'moment': last + {12 * HOUR}000000, 'n': len(held), 'why': 'idle'}} END AS gone FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
        SELECT user_id, x.note AS note, x.first AS first, x.moment AS moment, x.n AS n, x.why AS why FROM (SELECT user_id, idle AS x FROM f UNION ALL SELECT user_id, other FROM f
            UNION ALL SELECT user_id, {{'note': note, 'first': first, 'moment': last + {12 * HOUR}000000, 'n': len(held), 'why': 'idle'}} FROM f JOIN u USING (user_id) WHERE i = most AND len(held) > 0 AND last + {12 * HOUR}000000 <= {PASSED}) WHERE x IS NOT NULL""",
)
query("str_sessions", lambda m: micros(op.run(op.sessions(events(m)), "complete", "sessions"), "start", "end").select("user_id", "start", "end", "events"), f'SELECT user_id, s AS start, e AS "end", n AS events FROM ({SESSIONS})')
query("str_embed_queue", lambda m: micros(op.run(op.sessions(events(m)), "complete", "queue"), "end").select("user_id", "end", "last"), f'SELECT user_id, e AS "end", last FROM ({SESSIONS})')
query("str_dedup_context", lambda m: op.run(op.first_seen(events(m), "user_id", "event_type"), "append", "first").select("user_id", "event_type"), "SELECT DISTINCT user_id, event_type FROM events")
query("str_coordinate", lambda m: op.run(events(m).where("event_type = 'signup'"), "append", "coordinate").select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'signup'")
query("str_delta_scan", lambda m: op.run(op.changed_only(events(m)), "append", "delta"), "SELECT event_id, user_id, props FROM (SELECT *, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE props IS DISTINCT FROM p")
query("str_episode_append", lambda m: op.run(events(m).select("event_id", "user_id", "event_type"), "append", "log"), "SELECT event_id, user_id, event_type FROM events")
query("str_cooc_counter", lambda m: op.run(op.counted(events(m), "user_id", "event_type"), "complete", "pairs").select("user_id", "event_type", "n"), "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
query(
    "str_om_cursor",
    lambda m: op.run(op.over_threshold(events(m), 1000.0), "append", "cursor").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total")),
    """SELECT user_id, CAST(x.n AS BIGINT) AS n, round(x.total, 2) AS total FROM (SELECT user_id, list_reduce(list_prepend({'v': 0.0, 'n': 0, 'total': 0.0}, list({'v': value, 'n': 0, 'total': 0.0} ORDER BY ts, event_id)),
         lambda s, y: CASE WHEN s.v + y.v >= 1000 THEN {'v': 0.0, 'n': s.n + 1, 'total': s.total + round(s.v + y.v, 4)} ELSE {'v': s.v + y.v, 'n': s.n, 'total': s.total} END) AS x FROM events GROUP BY user_id) WHERE x.n > 0""",
)
query("str_chat_chunks", lambda m: op.run(op.joined_text(events(m)), "complete", "chunks"), "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS content FROM events GROUP BY user_id")
query("str_live_query", lambda m: op.run(op.counted(events(m), "event_type"), "complete", "live"), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type")
