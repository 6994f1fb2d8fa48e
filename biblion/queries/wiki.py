"""Wiki pages of entities and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.operators import wiki as W
from biblion.queries.catalog import _ONCE, _once
from biblion.queries.graph import _ENT, entities
from biblion.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT id, CASE WHEN {_SLUG.format('canonical_name')} = '' THEN 'entity-' || id || '.md' ELSE id || '-' || {_SLUG.format('canonical_name')} || '.md' END AS file FROM {_ENT}")
def wiki_filenames(spark, d):
    return entities(spark, d).select("id", W.entity_filename(F.col("id"), F.col("canonical_name")).alias("file"))


@query(f"SELECT 'sources/' || {_SLUG.format('uid')} || '.md' AS path, '# ' || regexp_replace(coalesce(nullif(trim(title),''), uid), '([\\[\\]])', '\\\\\\1', 'g') || coalesce(chr(10) || chr(10) || nullif(concat_ws(chr(10), '- Journal: ' || nullif(trim(journal),''), '- DOI: ' || nullif(trim(doi),'')), ''), '') || chr(10) AS body FROM {_ONCE}")
def wiki_render_source(spark, d):
    none = F.lit(None).cast("string")
    a = _once(spark, d).select("uid", "title", "journal", "doi", none.alias("authors"), none.alias("pub_date"), none.alias("url"), none.alias("byline_summary"))
    return W.source_pages(a)


@query()
def wiki_render_entity(spark, d):
    none = F.lit(None).cast("string")
    e = table(spark, d, "kg_entities").groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("canonical_name", "entity_type", "description", "aliases")])
    return W.entity_pages(e.withColumn("summary", none).withColumn("synthesis", none))


@query()
def wiki_render_index(spark, d):
    e = entities(spark, d).select("id", "canonical_name", F.coalesce("mention_count", F.lit(0)).alias("n_sources"), F.lit(False).alias("stale"))
    return W.index_page(e)


@query("SELECT uid, row_number() OVER (PARTITION BY reg_date ORDER BY title, uid)::INTEGER AS rank FROM " + _ONCE + " WHERE reg_date IS NOT NULL")
def wiki_daily_sources(spark, d):
    from biblion.operators.retrieval import top_per

    return top_per(_once(spark, d).where("reg_date is not null"), ["reg_date"], [F.asc_nulls_last("title"), F.asc("uid")], 200).select("uid", "rank")
