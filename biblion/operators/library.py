"""Updates of articles, texts, edges, syntheses, caches, prompts and workspaces, as plans from old rows to new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import present, workspace_slug
from biblion.operators.ingest import duplicate_target

# Public columns of an article, and those an editor may change.
PUBLIC = (
    "uid url category reg_date title first_author authors pub_date journal doi abstract_text ai_tech clinical_domain primary_issue secondary_issues "
    "key_stakeholders byline_summary content_type evaluated_at has_embeddings workspace_id created_at updated_at"
).split()
EDITABLE = "title first_author authors pub_date journal doi url category abstract_text ai_tech clinical_domain primary_issue secondary_issues key_stakeholders byline_summary".split()


def save_articles(articles: DataFrame, candidates: DataFrame, fields: list[str]) -> DataFrame:
    """Articles after the candidates (uid, fields, evaluated) were saved: ``uid``, fields and ``change``.

    A candidate that repeats an article under another uid, by DOI or else by title,
    enriches that one if it is evaluated and is skipped if not; of several the one with
    the greatest uid counts. All others are inserted.
    """
    named = candidates.withColumnRenamed("uid", "uid_")
    target = duplicate_target(named, articles, key="uid_").select("uid_", F.col("uid").alias("target"))
    c = named.join(target, "uid_", "left")
    new = c.where("target is null").select(F.col("uid_").alias("uid"), F.lit("inserted").alias("change"), *[present(F.col(f)).alias(f) for f in fields])
    given = F.struct("uid_", *[present(F.col(f)).alias(f) for f in fields])
    best = c.where("target is not null and evaluated").groupBy("target").agg(F.max(given).alias("v"))
    old = articles.join(best, F.col("uid") == F.col("target"), "left").select(
        "uid", F.when(F.col("v").isNull(), "kept").otherwise("updated").alias("change"), *[F.coalesce(F.col(f"v.{f}"), F.col(f)).alias(f) for f in fields]
    )
    return old.unionByName(new)


def update_text(old: DataFrame, new: DataFrame) -> DataFrame:
    """Texts (uid, full_text, content_type, error) after new ones (uid, full_text, content_type, marked) came in.

    Fetched text always replaces, an abstract only fills a blank; the error is cleared
    by fetched text; ``marked`` rows are marked.
    """
    n = new.select("uid", *[F.col(c).alias(f"n_{c}") for c in ("full_text", "content_type", "marked")])
    has, whole = present(F.col("n_full_text")).isNotNull(), F.coalesce(F.col("n_content_type") != "abstract_only", F.lit(False))
    take = has & (whole | present(F.col("full_text")).isNull())
    pick = lambda c: F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    error = F.when(~(F.col("n_full_text").isNotNull() & whole), F.col("error")).alias("error")
    return old.join(n, "uid", "left").select("uid", pick("full_text"), pick("content_type"), error, F.coalesce("n_marked", F.lit(False)).alias("marked"))


def default_content(articles: DataFrame, abstract: str, summary: str, kind: str) -> DataFrame:
    """``full_text``, ``content_type`` and ``status`` where nothing was fetched."""
    stored = F.coalesce(F.col(kind).isin("pdf", "pdf_stored"), F.lit(False)) & present(F.col(abstract)).isNull()
    return articles.withColumns({
        "full_text": F.coalesce(present(F.col(abstract)), F.col(summary)), kind: F.coalesce(kind, F.lit("abstract_only")), "status": F.when(stored, "needs_reextract").otherwise("extracted")
    })


def with_new_ids(rows: DataFrame, name: str, order: str, sign: int = 1, buckets: int = 512) -> DataFrame:
    """Ids 1, 2, ... in the order of a key (times ``sign``), without a task that holds all rows.

    The rows are range-partitioned; a partition's first id follows from the counts of
    those before it.
    """
    ranged = rows.repartitionByRange(buckets, order).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return ranged.join(F.broadcast(before.drop("__n")), "__p").withColumn(name, (F.col("__before") + inside) * sign).drop("__p", "__before")


def upsert_edges(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges after relations (src, tgt, rel_type) were seen: each adds 1 to its edge's weight."""
    keys = ["src", "tgt", "rel_type"]
    new = seen.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return edges.select(*keys, "weight").unionByName(new).groupBy(*keys).agg(F.sum("weight").alias("weight"))


def put_cache(cache: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A cache with new rows over the old ones of their keys; the greatest ``seq`` counts."""
    rest = [c for c in cache.columns if c not in keys]
    return cache.unionByName(new.select(*cache.columns)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("v")).select(*keys, "v.*")


def upsert_syntheses(syntheses: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Syntheses after new ones (entity_id, fields): version 1 or the next, never stale."""
    n = new.select("entity_id", *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("is_new"))
    both = syntheses.join(n, "entity_id", "full_outer")
    is_new = F.coalesce("is_new", F.lit(False))
    return both.select(
        "entity_id", *[F.when(is_new, F.col(f"n_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(is_new, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(is_new, False).otherwise(F.col("stale")).alias("stale"),
    )


def reextracted(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Articles whose text was read again: new text, and the marks of what was made of the old one reset."""
    t = texts.select("uid", F.col("full_text").alias("n_text"), F.lit(True).alias("again"))
    again = F.coalesce("again", F.lit(False))
    reset = {c: F.when(again, False).otherwise(F.col(c)) for c in ("has_embeddings", "has_kg")}
    return articles.join(t, "uid", "left").withColumns({"replaced": F.col("n_text").isNotNull(), "full_text": F.coalesce("n_text", "full_text"), **reset}).drop("n_text", "again")


def migrate_scores(articles: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the old form without their score columns, and those as a backup.

    Where a row had a score it was evaluated when it was registered; a blank text takes
    the title's place.
    """
    scores = [c for c in articles.columns if c.startswith(prefix)]
    scored = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in scores], F.lit(0)) > 0
    new = articles.withColumns({"full_text": F.coalesce(present(F.col("abstract_text")), F.col("title")), "evaluated_at": F.when(scored, F.col("reg_date"))})
    return new.drop(*scores), articles.select("uid", *scores)


def activated(workspaces: DataFrame, chosen: DataFrame) -> DataFrame:
    """``id``, ``is_active``: the chosen one (a single row) alone; the first where none is chosen."""
    first = workspaces.agg(F.min("id").alias("first"))
    pick = chosen.join(first).select(F.coalesce("chosen", "first").alias("chosen"))
    return workspaces.join(F.broadcast(pick)).select("id", (F.col("id") == F.col("chosen")).alias("is_active"))


def backfill_workspace(rows: DataFrame, workspaces: DataFrame) -> DataFrame:
    first = F.broadcast(workspaces.agg(F.min("id").alias("__first")))
    return rows.join(first).withColumn("workspace_id", F.coalesce("workspace_id", "__first")).drop("__first")


def created_workspaces(workspaces: DataFrame) -> DataFrame:
    """Workspaces with a short name of their own (``-2`` and so on where several have one), their file and a look-back of a day at least."""
    base = workspace_slug(F.col("name"))
    no = F.row_number().over(Window.partitionBy("__base").orderBy("id"))
    slug = F.concat("__base", F.when(F.col("__no") > 1, F.concat(F.lit("-"), F.col("__no").cast("string"))).otherwise(""))
    out = workspaces.withColumn("__base", base).withColumn("__no", no).withColumn("slug", slug)
    return out.withColumns({"file": F.concat(F.lit("ws_"), "slug", F.lit(".db")), "lookback_days": F.greatest(F.coalesce("lookback_days", F.lit(30)), F.lit(1))}).drop("__base", "__no")


def partial_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows with what the new ones of their key give; NULL leaves the old value."""
    given = [c for c in new.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in given])
    return old.join(n, key, "left").select(*[F.coalesce(f"n_{c}", c).alias(c) if c in given else F.col(c) for c in old.columns])


def public_columns(articles: DataFrame) -> DataFrame:
    return articles.select(*[c for c in PUBLIC if c in articles.columns])


def edited(articles: DataFrame, edits: DataFrame) -> DataFrame:
    """Articles after edits (uid, changes: map of field to text): fields an editor may change take the text, others are ignored."""
    out = articles.join(edits.select("uid", "changes"), "uid", "left")
    return out.select(*[F.coalesce(F.try_element_at("changes", F.lit(c)), F.col(c)).alias(c) if c in EDITABLE else F.col(c) for c in articles.columns])


def marked(rows: DataFrame, done: DataFrame, key: str, name: str) -> DataFrame:
    d = done.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(d, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def backfill_candidates(articles: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """What is still to be done, the latest first."""
    return articles.join(done, "uid", "left_anti").orderBy(F.desc_nulls_last("reg_date"), "uid").limit(limit)


def prompt_stats(traces: DataFrame) -> DataFrame:
    """Per prompt: its greatest version (1 at least), runs, and when and by which trace it ran last."""
    stamp: Column = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    return traces.groupBy("prompt_name").agg(
        F.max(F.coalesce("prompt_version", F.lit(1))).cast("long").alias("version"), F.count(F.lit(1)).alias("runs"), F.coalesce(F.max(stamp), F.lit("")).alias("last_run"),
        F.max_by("id", F.when(F.col("created_at").isNotNull(), F.struct("created_at", "id"))).alias("last_id"),
    )


def seeded_versions(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Versions and a first one of each prompt that has none."""
    new = files.join(versions.select("prompt_name").distinct(), "prompt_name", "left_anti").select("prompt_name", F.lit(1).cast("long").alias("version"))
    return versions.select("prompt_name", "version").unionByName(new)
