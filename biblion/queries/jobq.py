"""Jobs and streams: logs, states, progress, schedules, late rows. Runs and logs are made of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.functions.text import days_since
from biblion.queries import kb
from biblion.session import table
from biblion.streaming import jobs as J

query = kb.Registry()
QUERIES, ORACLE = query.queries, query.oracle
_ST = ", ".join(repr(x) for x in J.STATUSES)
SOURCES = ["pubmed", "arxiv", "all", "crossref"]
STATES = ["running", "completed", "failed", "interrupted", "cancelled", "queued", "completed"]
_LOG = f"(SELECT user_id AS run_id, 'c' || (event_id % 37) AS uid, [{_ST}][(event_id * 7) % 10 + 1] AS status, event_type AS source, event_id AS seq FROM events)"
_LAST = f"(SELECT run_id, uid, arg_max(status, seq) AS status, arg_max(source, seq) AS source FROM {_LOG} GROUP BY 1, 2)"
_EV = "(SELECT user_id AS run_id, event_id + 1 AS id, CASE WHEN (props::JSON ->> '$.k')::BIGINT >= 95 THEN 'source_completed' ELSE 'progress' END AS event_type, event_type AS source FROM events)"
_RUNS = f"(SELECT user_id AS run_id, [{', '.join(repr(x) for x in SOURCES)}][user_id % 4 + 1] AS source, [{', '.join(repr(x) for x in STATES)}][user_id % 7 + 1] AS status, min(ts) AS requested_at, count(*) AS found, round(sum(value), 2) AS total FROM events GROUP BY user_id)"


def _pick(values: list[str], at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id"), F.concat(F.lit("c"), (F.col("event_id") % 37).cast("string")).alias("uid"), _pick(J.STATUSES, (F.col("event_id") * 7) % 10).alias("status"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"))


def events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.get_json_object("props", "$.k").cast("long") >= 95, "source_completed").otherwise("progress")
    return e.select(F.col("user_id").alias("run_id"), (F.col("event_id") + 1).alias("id"), kind.alias("event_type"), F.to_json(F.struct(F.col("event_type").alias("source"))).alias("payload"))


def runs(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("requested_at"), F.count(F.lit(1)).alias("found"), F.round(F.sum("value"), 2).alias("total"))
    return e.select("run_id", _pick(SOURCES, F.col("run_id") % 4).alias("source"), _pick(STATES, F.col("run_id") % 7).alias("status"), "requested_at", "found", "total")


@query(f"SELECT run_id, uid, status, status NOT IN ('listed', 'skipped_duplicate', 'skipped_cross_source') AS claims FROM {_LAST}")
def st_status_machine(spark, d):
    return J.last_status(log(spark, d)).select("run_id", "uid", "status", J.claims_key(F.col("status")).alias("claims"))


@query(f"SELECT l.run_id, l.uid, l.status FROM {_LAST} l WHERE l.status IN ('listed', 'deduped', 'relevant', 'processing') AND NOT EXISTS (SELECT 1 FROM {_EV} e WHERE e.run_id = l.run_id AND e.source = l.source AND e.event_type = 'source_completed')")
def st_checkpoint_resume(spark, d):
    """What resumed runs have left."""
    return J.resume_work(log(spark, d), events(spark, d)).select("run_id", "uid", "status")


@query(f"SELECT DISTINCT run_id, source FROM {_EV} WHERE event_type = 'source_completed'")
def st_completed_sources(spark, d):
    return J.completed_sources(events(spark, d))


_COUNT = ", ".join(f"count(CASE WHEN status IN ({', '.join(map(repr, kinds))}) THEN 1 END) AS {name}" for name, kinds in J.COUNTERS.items())


@query(f"SELECT run_id, {_COUNT} FROM {_LAST} GROUP BY 1")
def agg_job_counters(spark, d):
    return J.run_counters(log(spark, d))


@query(f"SELECT run_id, CASE WHEN errors > 0 AND saved = 0 AND fetched = 0 THEN 'failed' ELSE 'completed' END AS status FROM (SELECT run_id, {_COUNT} FROM {_LAST} GROUP BY 1)")
def st_finish_status(spark, d):
    r = J.run_counters(log(spark, d))
    return r.select("run_id", J.finish_status(F.col("errors"), F.col("saved"), F.col("fetched")).alias("status"))


@query(f"WITH o AS (SELECT run_id, id, event_type FROM {_EV} WHERE id % 3 <> 0), n AS (SELECT run_id, id, event_type FROM {_EV} WHERE id % 3 = 0) SELECT run_id, id, event_type FROM o UNION ALL SELECT n.run_id, coalesce(t.top, 0) + row_number() OVER (PARTITION BY n.run_id ORDER BY n.id), n.event_type FROM n LEFT JOIN (SELECT run_id, max(id) AS top FROM o GROUP BY 1) t ON t.run_id = n.run_id")
def st_event_log(spark, d):
    """Every third event comes in later and is numbered on."""
    e = events(spark, d)
    return J.append_events(e.where("id % 3 <> 0"), e.where("id % 3 = 0").withColumn("seq", F.col("id")))


@query(f"SELECT s AS source, arg_max(run_id, (requested_at, run_id)) AS run_id FROM (VALUES ('all'), ('pubmed'), ('arxiv'), ('crossref'), ('doaj')) v(s) LEFT JOIN {_RUNS} r ON r.status = 'running' AND r.run_id % 4 <> 2 AND (s = 'all' OR r.source IN (s, 'all')) GROUP BY 1")
def st_conflict(spark, d):
    """Which running job keeps a source from starting."""
    asked = spark.createDataFrame([("all",), ("pubmed",), ("arxiv",), ("crossref",), ("doaj",)], "source string")
    return J.conflicts(asked, runs(spark, d).where("run_id % 4 <> 2"))


@query(f"SELECT run_id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM {_RUNS}")
def st_recover(spark, d):
    return J.recover(runs(spark, d)).select("run_id", "status")


_ASK = "(SELECT run_id, CASE run_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'cancelled' ELSE 'failed' END AS t FROM {0} WHERE run_id % 5 <> 4)".replace("{0}", _RUNS)
_OK = "(t = 'queued' AND status = 'interrupted' OR t IN ('cancelled', 'failed') AND status IN ('queued', 'running'))"


@query(f"SELECT r.run_id, CASE WHEN {_OK} THEN t ELSE status END AS status, CASE WHEN t IS NULL THEN 'kept' WHEN {_OK} THEN 'moved' ELSE 'refused' END AS change FROM {_RUNS} r LEFT JOIN {_ASK} a ON a.run_id = r.run_id")
def job_resume(spark, d):
    """Runs asked to resume, to be cancelled or marked as failed: what their status allows."""
    r = runs(spark, d)
    to = F.when(F.col("run_id") % 3 == 0, "queued").when(F.col("run_id") % 3 == 1, "cancelled").otherwise("failed")
    return J.moved(r, r.where("run_id % 5 <> 4").select("run_id", to.alias("to")))


@query(f"SELECT r.run_id, r.status, CASE WHEN r.status <> 'cancelled' THEN u.n ELSE r.found END AS found FROM {_RUNS} r LEFT JOIN (SELECT user_id AS run_id, arg_max((props::JSON ->> '$.k')::BIGINT, event_id) AS n FROM events GROUP BY 1) u ON u.run_id = r.run_id")
def job_progress(spark, d):
    """The last report of a run overwrites its counters, unless it is cancelled."""
    u = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").cast("long").alias("found"), F.col("event_id").alias("seq"))
    return J.progressed(runs(spark, d), u, ["found"])


@query(f"SELECT run_id, requested_at::VARCHAR AS requested FROM (SELECT run_id, strftime(requested_at, '%Y-%m-%d %H:%M:%S') AS requested_at, row_number() OVER (ORDER BY requested_at DESC, run_id) AS r FROM {_RUNS}) WHERE r <= 50")
def srt_jobs(spark, d):
    top = runs(spark, d).orderBy(F.desc("requested_at"), "run_id").limit(50)
    return top.select("run_id", F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss").alias("requested"))


@query(f"SELECT run_id, source FROM (SELECT *, row_number() OVER (ORDER BY requested_at DESC, run_id) AS r FROM {_RUNS} WHERE status = 'interrupted')")
def job_interrupted(spark, d):
    return runs(spark, d).where("status = 'interrupted'").select("run_id", "source")


@query(f"SELECT r.run_id, r.source, e.id, e.event_type, row_number() OVER (PARTITION BY r.run_id ORDER BY e.id)::INTEGER AS position FROM {_RUNS} r JOIN {_EV} e ON e.run_id = r.run_id WHERE r.run_id % 10 = 0")
def job_detail(spark, d):
    """Runs with their events in order."""
    from biblion.operators.retrieval import top_per

    both = runs(spark, d).where("run_id % 10 = 0").select("run_id", "source").join(events(spark, d).select("run_id", "id", "event_type"), "run_id")
    return top_per(both, ["run_id"], [F.asc("id")], 1 << 30).withColumnRenamed("rank", "position")


@query(f"SELECT run_id, uid, status, row_number() OVER (PARTITION BY run_id ORDER BY seq)::INTEGER AS position FROM (SELECT run_id, uid, arg_max(status, seq) AS status, max(seq) AS seq FROM {_LOG} GROUP BY 1, 2)")
def job_candidates_load(spark, d):
    """A run's candidates in the order they were last touched, with the status that was put over the others."""
    from biblion.operators.retrieval import top_per

    return top_per(J.last_status(log(spark, d)), ["run_id"], [F.asc("seq")], 1 << 30).select("run_id", "uid", "status", F.col("rank").alias("position"))


@query("SELECT * FROM (VALUES ('arxiv_daily', '2026-05-20 06:30:00'), ('pmc_daily', '2026-05-21 05:00:00'), ('pubmed_daily', '2026-05-20 07:15:00'), ('all_sources_manual', NULL)) v(id, next_run)")
def job_schedule_status(spark, d):
    jobs = spark.createDataFrame([("arxiv_daily", 6, 30), ("pmc_daily", 5, 0), ("pubmed_daily", 7, 15), ("all_sources_manual", None, None)], "id string, hour int, minute int")
    s = J.schedule(jobs, F.to_timestamp(F.lit("2026-05-20 06:00:00")), True)
    return s.select("id", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("next_run"))


_MARKS = "(SELECT article_uid, id AS seq, CASE WHEN id % 11 = 0 THEN 9 ELSE 5 END AS n_chunks, chunk_index % 5 AS chunk FROM {chunk} WHERE article_uid IS NOT NULL)"


@query(f"WITH l AS (SELECT article_uid, arg_max(n_chunks, seq) AS n_chunks FROM {_MARKS} GROUP BY 1), s AS (SELECT m.article_uid, max(m.seq) AS reset FROM {_MARKS} m JOIN l USING (article_uid) WHERE m.n_chunks <> l.n_chunks GROUP BY 1) SELECT l.article_uid, l.n_chunks, count(DISTINCT m.chunk) AS done, count(DISTINCT m.chunk) >= l.n_chunks AS through FROM l JOIN {_MARKS} m ON m.article_uid = l.article_uid AND m.n_chunks = l.n_chunks LEFT JOIN s ON s.article_uid = l.article_uid WHERE s.reset IS NULL OR m.seq > s.reset GROUP BY 1, 2")
def st_chunk_progress(spark, d):
    c = kb.chunks(spark, d).where("article_uid is not null")
    marks = c.select("article_uid", F.col("id").alias("seq"), F.when(F.col("id") % 11 == 0, 9).otherwise(5).alias("n_chunks"), (F.col("chunk_index") % 5).alias("chunk"))
    return J.chunk_progress(marks)


@query("SELECT s.entity_id, s.stale OR s.entity_id IN (SELECT entity_id FROM {ment} WHERE chunk_id % 50 = 0) AS stale FROM {syn} s")
def st_staleness(spark, d):
    """Syntheses of entities that new text mentions are stale."""
    return J.stale_marks(kb.syntheses(spark, d).select("entity_id", "stale"), kb.mentions(spark, d).where("chunk_id % 50 = 0"))


@query("SELECT 'graph' AS kind, (r - 1) // 50 + 1 AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY uid) AS r FROM {art} WHERE byline_summary IS NULL) GROUP BY 2 UNION ALL SELECT 'wiki', (r - 1) // 20 + 1, count(*) FROM (SELECT row_number() OVER (ORDER BY entity_id) AS r FROM {syn} WHERE stale) GROUP BY 2")
def st_backfill_loop(spark, d):
    """Batches a backfill goes through: articles by fifty until none is left, then pages by twenty."""
    a = J.batches(kb.articles(spark, d).where("byline_summary is null"), "uid", 50, "graph")
    return a.unionByName(J.batches(kb.syntheses(spark, d).where("stale"), "entity_id", 20, "wiki"))


@query("SELECT uid, (SELECT count(*) FROM {art} WHERE uid IN (SELECT article_uid FROM {chunk} WHERE NOT embedded)) - 50 AS remaining FROM {art} WHERE uid IN (SELECT article_uid FROM {chunk} WHERE NOT embedded) ORDER BY uid LIMIT 50")
def st_backfill_embeddings(spark, d):
    """Fifty articles with chunks that have no vector, and how many remain."""
    open_ = kb.articles(spark, d).join(kb.chunks(spark, d).where("not embedded").select(F.col("article_uid").alias("uid")), "uid", "left_semi").select("uid")
    n = F.broadcast(open_.agg((F.count(F.lit(1)) - 50).alias("remaining")))
    return open_.orderBy("uid").limit(50).join(n)


@query("SELECT event_type AS source, strftime(day, '%Y-%m-%d') AS day, strftime(min(ts), '%H:%M:%S') AS at FROM (SELECT event_type, ts, ts::DATE AS day FROM events WHERE strftime(ts, '%H:%M') >= '09:30') GROUP BY 1, 2")
def st_tick_scheduler(spark, d):
    """The tick of each day that starts a source's job."""
    e = J.event_time(table(spark, d, "events")).select(F.col("event_type").alias("source"), "ts")
    f = J.fired(e, 9, 30)
    return f.select("source", F.col("day").cast("string").alias("day"), F.date_format("ts", "HH:mm:ss").alias("at"))


_DAYS = "CASE WHEN g IS NOT NULL THEN greatest(floor((epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00') - floor(epoch(g)))/86400),0)::BIGINT END"
_WS = "(SELECT id, max(try_strptime(last_gathered_at, '%Y-%m-%d %H:%M:%S') AT TIME ZONE 'UTC') AS g, min(cadence_days) AS cadence_days, min(lookback_days) AS lookback_days, max(cadence_auto) AS auto FROM workspaces GROUP BY id)"


def _gathered(spark, d):
    """Workspaces with the time they were gathered last, where it is written plainly."""
    at = F.try_to_timestamp("last_gathered_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    w = table(spark, d, "workspaces")
    return w.groupBy("id").agg(F.max(at).alias("gathered"), F.min("cadence_days").alias("cadence_days"), F.min("lookback_days").alias("lookback_days"), F.max("cadence_auto").alias("cadence_auto"))


@query(f"SELECT id, {_DAYS} AS days_since, CASE WHEN g IS NULL THEN lookback_days::BIGINT ELSE greatest(least({_DAYS} + 1, 3650), 1) END AS lookback FROM {_WS} WHERE cadence_days IS NOT NULL AND (g IS NULL OR {_DAYS} >= cadence_days)")
def flt_due_workspaces(spark, d):
    """Workspaces due by their cadence; those never gathered (or unreadable) look back as far as they are set to."""
    return J.due_workspaces(_gathered(spark, d), "gathered", F.to_timestamp(F.lit("2026-06-01 00:00:00")))


@query(f"SELECT id, CASE WHEN auto = 1 THEN 'auto' ELSE 'manual' END AS how, CASE WHEN g IS NULL THEN lookback_days::BIGINT ELSE greatest(least({_DAYS} + 1, 3650), 1) END AS lookback FROM {_WS} WHERE cadence_days IS NOT NULL AND (g IS NULL OR {_DAYS} >= cadence_days)")
def st_cadence(spark, d):
    return J.cadence(_gathered(spark, d), "gathered", F.to_timestamp(F.lit("2026-06-01 00:00:00")))


@query(f"SELECT id, {_DAYS} AS days FROM {_WS}")
def fn_days_since(spark, d):
    return _gathered(spark, d).select("id", days_since(F.col("gathered"), F.to_timestamp(F.lit("2026-06-01 00:00:00"))).alias("days"))


_ARR = "(SELECT CASE WHEN event_id % 10 = 0 THEN event_id + 700 ELSE event_id END AS seq, ts FROM events)"


@query(f"WITH b AS (SELECT seq // 250 AS batch, ts FROM {_ARR}), t AS (SELECT batch, max(ts) AS top FROM b GROUP BY 1), m AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3600 SECOND AS mark FROM t) SELECT b.batch::BIGINT AS batch, count(*) AS n, count(CASE WHEN b.ts < m.mark THEN 1 END) AS n_late FROM b JOIN m USING (batch) GROUP BY 1")
def st_late_data(spark, d):
    """Every tenth event comes in 700 places late: how many each micro-batch finds behind the watermark."""
    e = J.event_time(table(spark, d, "events"))
    seq = F.when(F.col("event_id") % 10 == 0, F.col("event_id") + 700).otherwise(F.col("event_id"))
    return J.late_rows(e.select(seq.alias("seq"), "ts"), 250, 3600)


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events)")
def st_dedup(spark, d):
    """Replays dropped."""
    return J.deduplicated(table(spark, d, "events"), ["user_id", "event_type", "props"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT prompt_name, arg_max(id, (created_at, id)) AS id FROM (SELECT DISTINCT id, prompt_name, created_at FROM prompt_traces WHERE created_at IS NOT NULL) GROUP BY 1")
def win_latest_trace(spark, d):
    t = table(spark, d, "prompt_traces").where("created_at is not null")
    return t.groupBy("prompt_name").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
