"""Job streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.session import table
from biblion.streaming import jobs as J

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_tumbling(spark, d):
    return J.tumbling_counts(table(spark, d, "events"))


@query("SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_events FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def st_sliding(spark, d):
    return J.sliding_counts(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, sid""")
def st_sessions(spark, d):
    return J.sessions(table(spark, d, "events"))


_RUN = "SELECT user_id AS run_id, count(*) AS n_events, sum((event_type='signup')::INT)::BIGINT AS n_listed, sum((event_type='view')::INT)::BIGINT AS n_seen, sum((event_type='click')::INT)::BIGINT AS n_relevant, sum((event_type='purchase')::INT)::BIGINT AS n_saved, sum((event_type='error')::INT)::BIGINT AS n_errors FROM events GROUP BY 1"


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def win_latest_event(spark, d):
    return J.last_per_key(table(spark, d, "events"), "user_id").select("user_id", "event_id")


@query("SELECT event_id, strftime(CASE WHEN date_trunc('day', ts) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE > ts THEN date_trunc('day', ts) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE ELSE date_trunc('day', ts) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE + INTERVAL 1 DAY END, '%Y-%m-%d %H:%M:%S') AS next_run FROM events")
def fn_next_run(spark, d):
    return J.event_time(table(spark, d, "events")).select("event_id", F.date_format(J.next_run(F.col("ts"), 9, 30), "yyyy-MM-dd HH:mm:ss").alias("next_run"))
