"""Queries of the general record-cleaning operators (problems 4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from biblion.operators.packed import ARTICLE_FIELDS, explode_packed
from biblion.operators.timestamps import timestamp_findings
from biblion.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamp_findings(
        table(spark, sf_dir, "haie_rev"), table(spark, sf_dir, "workspaces"), table(spark, sf_dir, "source_zones")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "haie_rev"), "uid", ARTICLE_FIELDS, min_values=2)


QUERIES = {"p4_found": p4_found, "p7_found": p7_found}
ORACLE: dict[str, str] = {}
