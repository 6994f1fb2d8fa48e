"""Entity resolution in waves: exact names, aliases, vectors of the same type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import cosine

HIGH, LOW, VERIFY = 0.90, 0.80, 0.82


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def resolve_exact(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mention_id``, ``entity_id``, ``how``: by canonical name, else by alias; the least id of several."""
    m = mentions.select("mention_id", name_key(F.col("name")).alias("k"))
    names = entities.select(name_key(F.col("canonical_name")).alias("k"), "id").groupBy("k").agg(F.min("id").alias("by_name"))
    alias = entities.select(F.explode("aliases").alias("a"), "id").select(name_key(F.col("a")).alias("k"), "id").groupBy("k").agg(F.min("id").alias("by_alias"))
    hit = m.join(names, "k", "left").join(alias, "k", "left")
    return hit.where("by_name is not null or by_alias is not null").select(
        "mention_id", F.coalesce("by_name", "by_alias").alias("entity_id"), F.when(F.col("by_name").isNotNull(), "name").otherwise("alias").alias("how")
    )


def resolve_vectors(new: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """Candidates among known vectors of the same type: ``vec_id``, ``entity_id``, ``similarity``, ``rank``, ``verdict``.

    At 0.90 and more the best one is the entity (``same``); from 0.80 up to five are to
    be verified (``ambiguous``). Vectors of a type meet through an equi-join on the type
    and a bucket of the known side's hash, so a hot type spreads over tasks.
    """
    buckets = 16
    n = new.select("vec_id", F.upper(F.trim("type")).alias("type"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b"))
    k = known.select(F.col("vec_id").alias("entity_id"), F.upper(F.trim("type")).alias("type"), F.col("embedding").alias("e"), F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).cast("int").alias("b"))
    sim = n.join(k, ["type", "b"]).select("vec_id", "entity_id", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("similarity")).where(F.col("similarity") >= LOW)
    w = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "entity_id")
    ranked = sim.withColumn("rank", F.row_number().over(w))
    best = F.max("similarity").over(Window.partitionBy("vec_id"))
    out = ranked.withColumn("best", best).withColumn("verdict", F.when(F.col("best") >= HIGH, "same").otherwise("ambiguous"))
    return out.where((F.col("rank") == 1) | ((F.col("verdict") == "ambiguous") & (F.col("rank") <= most))).drop("best")


def register_mentions(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities with counts raised by their mentions and new spellings among their aliases (whatever the case, once)."""
    seen = resolved.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.trim("name"))).alias("spelt"))
    joined = entities.join(seen.withColumnRenamed("entity_id", "id"), "id", "left")
    have = F.array_union(F.array(F.lower(F.trim("canonical_name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    fresh = F.filter(F.coalesce("spelt", F.array().cast("array<string>")), lambda x: ~F.array_contains(have, F.lower(x)))
    return joined.select(
        "id", "canonical_name", (F.coalesce("mention_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("mention_count"),
        F.concat(F.coalesce("aliases", F.array().cast("array<string>")), fresh).alias("aliases"),
    )
