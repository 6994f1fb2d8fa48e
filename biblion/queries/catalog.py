"""Articles, traces, prompts and workspaces: filters, pages and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.operators.retrieval import top_per
from biblion.session import table
from biblion.streaming.jobs import due_workspaces

AS_OF = "2026-06-01"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_ONCE = "(SELECT uid, any_value(category) AS category, any_value(reg_date) AS reg_date, any_value(title) AS title, any_value(abstract_text) AS abstract_text, any_value(workspace_id) AS workspace_id, any_value(journal) AS journal, any_value(doi) AS doi, any_value(has_embeddings) AS has_embeddings, max(evaluated_at) AS evaluated_at FROM haie_rev GROUP BY uid)"


def _once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "haie_rev").groupBy("uid").agg(
        *[F.any_value(c).alias(c) for c in ("category", "reg_date", "title", "abstract_text", "workspace_id", "journal", "doi", "has_embeddings")], F.max("evaluated_at").alias("evaluated_at")
    )


@query(f"SELECT uid, title FROM {_ONCE} WHERE reg_date >= '2025-01-01' AND reg_date <= '2026-12-31' AND lower(category) = 'pubmed' AND (lower(coalesce(title,'')) LIKE '%alert%' OR lower(coalesce(abstract_text,'')) LIKE '%alert%')")
def flt_articles(spark, d):
    a = _once(spark, d)
    found = F.lower(F.coalesce("title", F.lit(""))).contains("alert") | F.lower(F.coalesce("abstract_text", F.lit(""))).contains("alert")
    return a.where(F.col("reg_date").between("2025-01-01", "2026-12-31") & (F.lower("category") == "pubmed") & found).select("uid", "title")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE reg_date >= '2026-05-25') AS this_week, count(evaluated_at) AS evaluated, count(*) - count(evaluated_at) AS pending FROM {_ONCE}")
def agg_article_stats(spark, d):
    return _once(spark, d).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("reg_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 7).cast("string"), 1)).alias("this_week"),
        F.count("evaluated_at").alias("evaluated"), (F.count(F.lit(1)) - F.count("evaluated_at")).alias("pending"),
    )


@query(f"SELECT strftime(d, '%Y-%m-%d') AS day, count(a.uid) AS n FROM (SELECT unnest(generate_series(DATE '2026-05-03', DATE '2026-06-01', INTERVAL 1 DAY)) AS d) LEFT JOIN {_ONCE} a ON a.reg_date = strftime(d, '%Y-%m-%d') GROUP BY 1")
def agg_daily_counts(spark, d):
    days = spark.range(30).select(F.date_sub(F.lit(AS_OF).cast("date"), F.col("id").cast("int")).cast("string").alias("day"))
    n = _once(spark, d).groupBy(F.col("reg_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT uid, reg_date FROM {_ONCE} ORDER BY coalesce(reg_date,'') DESC, uid LIMIT 25 OFFSET 25")
def srt_articles_page(spark, d):
    return _once(spark, d).orderBy(F.coalesce("reg_date", F.lit("")).desc(), "uid").offset(25).limit(25).select("uid", "reg_date")


@query(f"SELECT uid, title FROM {_ONCE} WHERE reg_date >= '2026-05-02' ORDER BY reg_date DESC, uid LIMIT 20")
def srt_recent(spark, d):
    return _once(spark, d).where(F.col("reg_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 30).cast("string")).orderBy(F.desc("reg_date"), "uid").limit(20).select("uid", "title")


_TR = "(SELECT DISTINCT id, prompt_name, prompt_version, model, tokens_input, tokens_output, tokens_total, latency_ms, cost_usd, success, article_uid, created_at FROM prompt_traces)"


def _traces(spark, d):
    cols = "id prompt_name prompt_version model tokens_input tokens_output tokens_total latency_ms cost_usd success article_uid created_at".split()
    return table(spark, d, "prompt_traces").select(*cols).distinct()


@query(f"SELECT prompt_name, count(*) AS n, sum(CASE WHEN coalesce(success,0)=1 THEN 1 ELSE 0 END)::BIGINT AS successes, sum(CASE WHEN coalesce(success,0)=1 THEN 0 ELSE 1 END)::BIGINT AS failures, round(avg(latency_ms),4) AS avg_latency, sum(coalesce(tokens_total,0))::BIGINT AS tokens, round(sum(coalesce(cost_usd,0))/100,6) AS cost FROM {_TR} GROUP BY 1")
def agg_trace_summary(spark, d):
    ok = (F.coalesce("success", F.lit(0)) == 1).cast("long")
    return _traces(spark, d).groupBy("prompt_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok).alias("successes"), F.sum(1 - ok).alias("failures"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"),
        F.sum(F.coalesce("tokens_total", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))) / 100, 6).alias("cost"),
    )


@query(f"SELECT id, prompt_name FROM {_TR} WHERE model = 'hosted-large' AND success = 1 ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50")
def srt_traces_page(spark, d):
    return _traces(spark, d).where("model = 'hosted-large' and success = 1").orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(50).select("id", "prompt_name")


@query(f"SELECT id, CASE WHEN tokens_input IS NOT NULL AND tokens_output IS NOT NULL THEN tokens_input + tokens_output ELSE coalesce(tokens_input, tokens_output) END AS total FROM {_TR}")
def tr_record(spark, d):
    return _traces(spark, d).select("id", F.when(F.col("tokens_input").isNotNull() & F.col("tokens_output").isNotNull(), F.col("tokens_input") + F.col("tokens_output")).otherwise(F.coalesce("tokens_input", "tokens_output")).alias("total"))


@query("SELECT coalesce(max(prompt_version),0)+1 AS next_version, prompt_name FROM prompt_traces GROUP BY prompt_name")
def agg_max_version(spark, d):
    return table(spark, d, "prompt_traces").groupBy("prompt_name").agg((F.coalesce(F.max("prompt_version"), F.lit(0)) + 1).cast("long").alias("next_version"))


_CH = "(SELECT DISTINCT id, article_uid, chunk_index, chunk_type, token_count, embedded_at FROM article_chunks)"


def _chunks(spark, d):
    return table(spark, d, "article_chunks").select("id", "article_uid", "chunk_index", "chunk_type", "token_count", "embedded_at").distinct()


@query(f"SELECT count(*) AS n_chunks, count(DISTINCT article_uid) AS n_articles, sum(CASE WHEN embedded_at IS NOT NULL THEN coalesce(token_count,0) ELSE 0 END)::BIGINT AS tokens, round(count(*)/count(DISTINCT article_uid),6) AS per_article FROM {_CH}")
def agg_library_stats(spark, d):
    return _chunks(spark, d).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("article_uid").alias("n_articles"),
        F.sum(F.when(F.col("embedded_at").isNotNull(), F.coalesce("token_count", F.lit(0))).otherwise(0)).alias("tokens"),
        F.round(F.coalesce(F.try_divide(F.count(F.lit(1)), F.count_distinct("article_uid")), F.lit(0.0)), 6).alias("per_article"),
    )


@query(f"SELECT article_uid, chunk_index, id, embedded_at IS NOT NULL AS has_embedding, row_number() OVER (PARTITION BY article_uid ORDER BY chunk_index, id) AS position FROM {_CH}")
def lib_chunks(spark, d):
    ranked = top_per(_chunks(spark, d), ["article_uid"], [F.asc("chunk_index"), F.asc("id")], 1 << 30)
    return ranked.select("article_uid", "chunk_index", "id", F.col("embedded_at").isNotNull().alias("has_embedding"), F.col("rank").cast("long").alias("position"))


@query(f"SELECT chunk_type, count(DISTINCT article_uid) AS n_articles FROM {_CH} GROUP BY 1 HAVING count(DISTINCT article_uid) >= 3")
def agg_distinct_articles(spark, d):
    return _chunks(spark, d).groupBy("chunk_type").agg(F.count_distinct("article_uid").alias("n_articles")).where("n_articles >= 3")


@query(f"SELECT a.uid FROM {_ONCE} a WHERE NOT EXISTS (SELECT 1 FROM article_chunks c WHERE c.article_uid = a.uid)")
def join_anti_unchunked(spark, d):
    return _once(spark, d).select("uid").join(table(spark, d, "article_chunks").select(F.col("article_uid").alias("uid")), "uid", "left_anti")


@query(f"SELECT a.uid FROM {_ONCE} a WHERE a.uid IN (SELECT article_uid FROM prompt_traces WHERE success = 0)")
def join_semi_in(spark, d):
    return _once(spark, d).select("uid").join(table(spark, d, "prompt_traces").where("success = 0").select(F.col("article_uid").alias("uid")), "uid", "left_semi")


@query("SELECT DISTINCT article_uid FROM article_chunks WHERE chunk_type = 'methods' INTERSECT SELECT DISTINCT article_uid FROM article_chunks WHERE chunk_type = 'results'")
def set_intersect_articles(spark, d):
    c = table(spark, d, "article_chunks").select("article_uid", "chunk_type")
    return c.where("chunk_type = 'methods'").select("article_uid").intersect(c.where("chunk_type = 'results'").select("article_uid"))


@query("SELECT a.uid, w.slug FROM (SELECT uid, any_value(workspace_id) AS workspace_id FROM haie_rev GROUP BY uid) a LEFT JOIN (SELECT id, any_value(slug) AS slug FROM workspaces GROUP BY id) w ON w.id = a.workspace_id")
def join_left_workspace(spark, d):
    w = table(spark, d, "workspaces").groupBy(F.col("id").alias("workspace_id")).agg(F.any_value("slug").alias("slug"))
    a = table(spark, d, "haie_rev").groupBy("uid").agg(F.any_value("workspace_id").alias("workspace_id"))
    return a.join(w, "workspace_id", "left").select("uid", "slug")
