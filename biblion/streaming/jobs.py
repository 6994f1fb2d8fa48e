"""Streams and resumable jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import days_since
from biblion.operators.library import with_new_ids


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; times without zone are read as UTC by the session."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values per window and type; runs on batches and streams alike."""
    marked = event_time(events)
    if marked.isStreaming:
        marked = marked.withWatermark("ts", late)
    return (
        marked.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events", "total")
    )


def sliding_counts(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    marked = event_time(events)
    if marked.isStreaming:
        marked = marked.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_events"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    marked = event_time(events)
    if marked.isStreaming:
        marked = marked.withWatermark("ts", late)
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events")).select(
        "user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_events"
    )


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Replays dropped: within the watermark on a stream, altogether on a batch."""
    marked = event_time(events)
    return marked.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if marked.isStreaming else marked.dropDuplicates(keys)


def pending(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return candidates.join(done.select(*keys).distinct(), keys, "left_anti")


def resume_batches(stream: DataFrame, path: str, checkpoint_dir: str, keys: list[str]):
    """Append each micro-batch's rows whose keys aren't in ``path`` yet; a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = pending(fresh, spark.read.parquet(path), keys)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


# Statuses of a run's candidates; those that claim no key, and those after which nothing is left to do.
STATUSES = ["listed", "deduped", "skipped_duplicate", "skipped_cross_source", "relevant", "screened_out", "processing", "saved", "skipped_save", "failed"]
CLAIM_NOTHING = ["listed", "skipped_duplicate", "skipped_cross_source"]
SETTLED = ["skipped_duplicate", "skipped_cross_source", "screened_out", "saved", "skipped_save", "failed"]
# Counters of a run and the statuses that raise them.
COUNTERS = {
    "found": STATUSES, "screened": ["relevant", "screened_out", "processing", "saved", "skipped_save", "failed"], "relevant": ["relevant", "processing", "saved", "skipped_save", "failed"],
    "fetched": ["processing", "saved", "skipped_save"], "evaluated": ["saved", "skipped_save"], "saved": ["saved"], "embedded": ["saved"], "skipped": ["skipped_duplicate", "skipped_cross_source", "skipped_save"], "errors": ["failed"],
}
# Statuses from which a run may go on to another.
MOVES = {"queued": ["interrupted"], "cancelled": ["queued", "running"], "failed": ["queued", "running"], "completed": ["running"], "interrupted": ["running"]}


def claims_key(status: Column) -> Column:
    """Whether a candidate of this status counts as seen for those to come."""
    return status.isin(STATUSES) & ~status.isin(CLAIM_NOTHING)


def last_status(log: DataFrame) -> DataFrame:
    """The last status of each candidate (run_id, uid) of an append-only log (seq, status), unknown statuses left out."""
    known = log.where(F.col("status").isin(STATUSES))
    return known.groupBy("run_id", "uid").agg(F.max_by("status", "seq").alias("status"), F.max_by("source", "seq").alias("source"), F.max("seq").alias("seq"))


def completed_sources(events: DataFrame) -> DataFrame:
    """``run_id``, ``source`` of the events that say a source is through (event_type, payload as JSON)."""
    return events.where("event_type = 'source_completed'").select("run_id", F.get_json_object("payload", "$.source").alias("source")).where("source is not null").distinct()


def resume_work(log: DataFrame, events: DataFrame) -> DataFrame:
    """What a resumed run has left: candidates that aren't settled, of sources that aren't through."""
    return last_status(log).where(~F.col("status").isin(SETTLED)).join(completed_sources(events), ["run_id", "source"], "left_anti")


def run_counters(log: DataFrame) -> DataFrame:
    """The nine counters of each run, from the last status of its candidates."""
    count = lambda kinds: F.count(F.when(F.col("status").isin(kinds), 1))
    return last_status(log).groupBy("run_id").agg(*[count(kinds).alias(name) for name, kinds in COUNTERS.items()])


def finish_status(errors: Column, saved: Column, found: Column) -> Column:
    return F.when((errors > 0) & (saved == 0) & (found == 0), "failed").otherwise("completed")


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """The event log (run_id, id, event_type) with new events numbered on; old ones never change."""
    top = log.groupBy("run_id").agg(F.max("id").alias("top"))
    w = Window.partitionBy("run_id").orderBy("seq")
    added = new.join(top, "run_id", "left").select("run_id", (F.coalesce("top", F.lit(0)) + F.row_number().over(w)).alias("id"), "event_type")
    return log.select("run_id", "id", "event_type").unionByName(added)


def conflicts(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """The running job that keeps an asked source from starting: of the same source or of all; ``all`` waits for any. The latest of several."""
    running = runs.where("status = 'running'").select("run_id", F.col("source").alias("other"), "requested_at")
    kept = asked.join(F.broadcast(running.groupBy("other").agg(F.max(F.struct("requested_at", "run_id")).alias("v"))), (F.col("source") == "all") | (F.col("other") == F.col("source")) | (F.col("other") == "all"), "left")
    return kept.groupBy("source").agg(F.max("v")["run_id"].alias("run_id"))


def moved(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Runs after transitions (run_id, to) were asked: those their status allows are made, the others refused."""
    allowed = F.create_map(*[x for to, sources in MOVES.items() for x in (F.lit(to), F.array(*map(F.lit, sources)))])
    ok = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("to")), F.col("status")), F.lit(False))
    out = runs.join(asked, "run_id", "left")
    return out.select("run_id", F.when(ok, F.col("to")).otherwise(F.col("status")).alias("status"), F.when(F.col("to").isNull(), "kept").when(ok, "moved").otherwise("refused").alias("change"))


def progressed(runs: DataFrame, updates: DataFrame, counters: list[str]) -> DataFrame:
    """Counters overwritten by the last update (seq) of each run, unless the run is cancelled."""
    last = updates.groupBy("run_id").agg(F.max_by(F.struct(*counters), "seq").alias("v"))
    take = F.col("v").isNotNull() & (F.col("status") != "cancelled")
    return runs.join(last, "run_id", "left").select("run_id", "status", *[F.when(take, F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) for c in counters])


def chunk_progress(marks: DataFrame) -> DataFrame:
    """Per article: its chunks, how many are done, whether it is through.

    ``marks`` (article_uid, seq, n_chunks, chunk) says that a chunk was done while the
    article had so many. When that number changes what was done before counts no more;
    a chunk marked twice counts once.
    """
    last = marks.groupBy("article_uid").agg(F.max_by("n_chunks", "seq").alias("n_chunks"))
    since = marks.join(last.withColumnRenamed("n_chunks", "now"), "article_uid").withColumn("stale", F.col("n_chunks") != F.col("now"))
    reset = since.where("stale").groupBy("article_uid").agg(F.max("seq").alias("reset"))
    valid = since.where(~F.col("stale")).join(reset, "article_uid", "left").where("reset is null or seq > reset")
    done = valid.groupBy("article_uid").agg(F.count_distinct("chunk").alias("done"))
    return last.join(done, "article_uid").withColumn("through", F.col("done") >= F.col("n_chunks"))


def batches(work: DataFrame, order: str, size: int, kind: str) -> DataFrame:
    """``kind``, ``batch`` (from 1), ``n``: how a loop takes the work until none is left."""
    numbered = with_new_ids(work.select(order), "__no", order)
    return numbered.groupBy((F.floor((F.col("__no") - 1) / size) + 1).alias("batch")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "batch", "n")


def fired(ticks: DataFrame, hour: int, minute: int) -> DataFrame:
    """The tick that starts a day's job of a source (ts, source): the first at or after hh:mm, once a day."""
    due = F.date_format("ts", "HH:mm") >= f"{hour:02d}:{minute:02d}"
    return ticks.where(due).groupBy("source", F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts"))


def cadence(workspaces: DataFrame, gathered: str, as_of: Column) -> DataFrame:
    """``id``, ``how``: workspaces to gather, by themselves (cadence_auto) or on demand, once each."""
    due = due_workspaces(workspaces.dropDuplicates(["id"]), gathered, as_of)
    return due.join(workspaces.select("id", "cadence_auto").groupBy("id").agg(F.max("cadence_auto").alias("auto")), "id").select("id", F.when(F.col("auto") == 1, "auto").otherwise("manual").alias("how"), "lookback")


def late_rows(arrivals: DataFrame, size: int, late_seconds: int) -> DataFrame:
    """``batch``, ``n``, ``n_late``: arrivals (seq, ts) in micro-batches of ``size``; a row is late if it is older than the watermark.

    The watermark is the greatest time of all batches before less the allowed lateness,
    as the streaming engine keeps it. Batches are summed first, so that the running
    maximum goes over one row a batch.
    """
    by = arrivals.withColumn("batch", F.floor(F.col("seq") / size))
    top = by.groupBy("batch").agg(F.max("ts").alias("top"))
    mark = top.select("batch", (F.max("top").over(Window.partitionBy(F.lit(0)).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)) - F.expr(f"interval {late_seconds} seconds")).alias("mark"))
    return by.join(F.broadcast(mark), "batch").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ts") < F.col("mark"), 1)).alias("n_late"))


def schedule(jobs: DataFrame, as_of: Column, enabled: bool) -> DataFrame:
    """Jobs (id, hour, minute; manual ones without) and when they run next."""
    today = F.date_trunc("day", as_of) + F.make_dt_interval(F.lit(0), F.col("hour"), F.col("minute"), F.lit(0))
    following = F.when(today > as_of, today).otherwise(today + F.expr("interval 1 day"))
    return jobs.select("id", F.when(F.lit(enabled) & F.col("hour").isNotNull(), following).alias("next_run"))


def due_workspaces(workspaces: DataFrame, gathered: str, as_of: Column) -> DataFrame:
    """Workspaces due for gathering and their look-back: the days since plus one (1 to 3650), else their own setting."""
    days = days_since(F.col(gathered), as_of)
    due = F.col("cadence_days").isNotNull() & (days.isNull() | (days >= F.col("cadence_days")))
    return workspaces.where(due).select(
        "id", days.alias("days_since"), F.when(days.isNull(), F.col("lookback_days").cast("long")).otherwise(F.greatest(F.least(days + 1, F.lit(3650)), F.lit(1))).alias("lookback")
    )


def recover(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def stale_marks(syntheses: DataFrame, touched: DataFrame) -> DataFrame:
    t = touched.select("entity_id").distinct().withColumn("hit", F.lit(True))
    return syntheses.join(t, "entity_id", "left").withColumn("stale", F.coalesce("hit", F.coalesce("stale", F.lit(False)))).drop("hit")


def next_run(as_of: Column, hour: int, minute: int) -> Column:
    today = F.date_trunc("day", as_of) + F.expr(f"make_interval(0,0,0,0,{hour},{minute},0)")
    return F.when(today > as_of, today).otherwise(today + F.expr("interval 1 day"))


def last_per_key(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
