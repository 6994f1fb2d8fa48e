"""Problem 4: mixed timestamp formats and time zones, brought to one form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.functions.timestamps import add_normal_form, known_zones


def normalise_timestamps(
    df: DataFrame, value: str, zone: str | None = None, date_order: str | None = None, output: str = "norm_value"
) -> DataFrame:
    """Add ``output``, the normal form of the text column ``value``.

    ``zone`` and ``date_order`` name columns with the writer's IANA zone and the
    order (MDY or DMY) of all-figure slash dates. NULL, blank and unreadable values
    give NULL; rows and other columns are untouched, repeated rows stay repeated.
    A column already called ``output`` is replaced.
    """
    zones = known_zones(df.sparkSession)
    null = F.lit(None).cast("string")
    return add_normal_form(
        df, output, F.col(value), F.col(zone) if zone else null, F.col(date_order) if date_order else null, zones
    )


def with_source_defaults(df: DataFrame, source_zones: DataFrame, uid: str = "uid") -> DataFrame:
    """Add ``src_zone`` and ``src_date_order`` of the text before ``:`` in ``uid``.

    ``source_zones`` is a fixed lookup of a few rows, hence the broadcast. Sources it
    lacks get NULL; a source listed twice counts with its smallest entry.
    """
    lookup = source_zones.groupBy(F.col("source").alias("_src")).agg(
        F.min("zone").alias("src_zone"), F.min("date_order").alias("src_date_order")
    )
    keyed = df.withColumn("_src", F.substring_index(F.col(uid), ":", 1))
    return keyed.join(F.broadcast(lookup), "_src", "left").drop("_src")


def timestamp_findings(articles: DataFrame, workspaces: DataFrame, source_zones: DataFrame) -> DataFrame:
    """Readable values of both tables that differ from their normal form, once per record."""
    a = with_source_defaults(articles.select("uid", "pub_date").where("pub_date is not null"), source_zones)
    a = normalise_timestamps(a, "pub_date", "src_zone", "src_date_order").select(
        F.lit("haie_rev").alias("src_table"), F.col("uid").alias("rec_key"), F.col("pub_date").alias("_raw"), "norm_value"
    )
    w = workspaces.select("id", "last_gathered_at", "writer_zone").where("last_gathered_at is not null")
    w = normalise_timestamps(w, "last_gathered_at", "writer_zone").select(
        F.lit("workspaces").alias("src_table"), F.col("id").cast("string").alias("rec_key"),
        F.col("last_gathered_at").alias("_raw"), "norm_value",
    )
    changed = F.when(F.col("rec_key").isNotNull() & (F.col("norm_value") != F.col("_raw")), F.col("norm_value"))
    # A generator, not a filter: a filter on the result would be pushed below the cascade and run it twice.
    return (
        a.unionByName(w)
        .select("src_table", "rec_key", F.explode(F.array_compact(F.array(changed))).alias("norm_value"))
        .distinct()
    )
