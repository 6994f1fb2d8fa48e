"""A small knowledge base out of the domain tables: articles, chunks, entities, mentions, edges, syntheses.

Mentions and edges follow from chunk ids by arithmetic, so the same tables can be
stated in SQL (``SQL``): every chunk mentions three entities, and its first two are
linked by a relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.operators import graph as G
from biblion.session import table

#: The workspace the queries look at.
WORKSPACE = 1
RELATIONS = ["Developed   By", "uses", "supports", "causes", "Funded by"]


class Registry:
    """Queries and their SQL; ``{art}`` and so on in SQL stand for the tables of this module."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = fill(sql)
            return f

        return add


def fill(sql: str) -> str:
    while any("{" + k + "}" in sql for k in SQL):
        for k, v in SQL.items():
            sql = sql.replace("{" + k + "}", v)
    return sql


ART_TEXT = ["title", "first_author", "authors", "journal", "doi", "pub_date", "reg_date", "url", "category", "abstract_text", "content_type", "byline_summary"]


def articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "haie_rev")
    return a.groupBy("uid").agg(*[F.min(c).alias(c) for c in ART_TEXT], F.min("workspace_id").alias("workspace_id"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "article_chunks")
    text = ["article_uid", "chunk_type", "content", "source_section"]
    return c.groupBy("id").agg(*[F.min(x).alias(x) for x in text], *[F.min(x).alias(x) for x in ("chunk_index", "token_count", "source_page")], F.min("embedded_at").isNotNull().alias("embedded"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "kg_entities")
    return e.groupBy("id").agg(
        F.min("canonical_name").alias("name"), F.min(F.upper(F.trim("entity_type"))).alias("kind"), F.min("description").alias("description"), F.any_value("aliases").alias("aliases"), F.max("mention_count").alias("mention_count")
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "kg_entities").agg(F.max("id").alias("n"))
    c = chunks(spark, d).select("id", "article_uid", "chunk_index", "content", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    at = F.pmod(F.col("id") * 7 + F.col("k") * 13, F.col("n")) + 1
    return c.join(F.broadcast(n)).select((F.col("id") * 3 + F.col("k")).alias("mention_id"), F.col("id").alias("chunk_id"), "article_uid", "chunk_index", "k", at.alias("entity_id"), F.left("content", F.lit(120)).alias("context"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Relations seen in chunks: ``src``, ``tgt``, ``rel_type``, ``seq``, ``article``, ``description``."""
    n = table(spark, d, "kg_entities").agg(F.max("id").alias("n"))
    at = lambda k: F.pmod(F.col("id") * 7 + k * 13, F.col("n")) + 1
    rel = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("id") % 5 + 1).cast("int"))
    said = F.when(F.col("id") % 4 != 0, F.concat(F.lit("seen in "), F.coalesce("source_section", F.lit("the text"))))
    seen = chunks(spark, d).join(F.broadcast(n)).select(at(0).alias("src"), at(1).alias("tgt"), rel.alias("rel_type"), F.col("id").alias("seq"), F.col("article_uid").alias("article"), said.alias("description"))
    return seen.where("src % 5 <> 3 and tgt % 5 <> 3")  # every fifth entity stands alone


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges in normal form with their weight."""
    seen = G.canonical_relations(observations(spark, d))
    return seen.groupBy("src", "tgt", "rel_type").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def syntheses(spark: SparkSession, d: str) -> DataFrame:
    n = mentions(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("article_uid").alias("n_articles"))
    e = entities(spark, d).where("id % 3 = 0").join(n, "id", "left")
    text = F.coalesce("description", F.lit(""))
    return e.select(
        F.col("id").alias("entity_id"), text.alias("summary"), F.concat_ws(" ", text, text, "name").alias("synthesis"), F.coalesce("n_articles", F.lit(0)).alias("n_articles"), (F.col("id") % 6 == 0).alias("stale"), F.lit(1).alias("version")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunk vectors: vector n belongs to chunk n + 1."""
    return table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("chunk_id"), "embedding", F.col("label").cast("string").alias("label"))


SQL = {
    "art": "(SELECT uid, " + ", ".join(f"min({c}) AS {c}" for c in ART_TEXT) + ", min(workspace_id) AS workspace_id FROM haie_rev GROUP BY uid)",
    "chunk": "(SELECT id, min(article_uid) AS article_uid, min(chunk_type) AS chunk_type, min(content) AS content, min(source_section) AS source_section, min(chunk_index) AS chunk_index, min(token_count) AS token_count, min(source_page) AS source_page, min(embedded_at) IS NOT NULL AS embedded FROM article_chunks GROUP BY id)",
    "ent": "(SELECT id, min(canonical_name) AS name, min(upper(trim(entity_type))) AS kind, min(description) AS description, any_value(aliases) AS aliases, max(mention_count) AS mention_count FROM kg_entities GROUP BY id)",
    "n": "(SELECT max(id) FROM kg_entities)",
    "ment": "(SELECT c.id * 3 + k AS mention_id, c.id AS chunk_id, c.article_uid, c.chunk_index, k, (c.id * 7 + k * 13) % {n} + 1 AS entity_id, left(c.content, 120) AS context FROM {chunk} c CROSS JOIN (VALUES (0), (1), (2)) v(k))",
    "obs": "(SELECT (id * 7) % {n} + 1 AS src, (id * 7 + 13) % {n} + 1 AS tgt, ['Developed   By', 'uses', 'supports', 'causes', 'Funded by'][id % 5 + 1] AS rel_type, id AS seq, article_uid AS article, CASE WHEN id % 4 <> 0 THEN 'seen in ' || coalesce(source_section, 'the text') END AS description FROM {chunk} WHERE ((id * 7) % {n} + 1) % 5 <> 3 AND ((id * 7 + 13) % {n} + 1) % 5 <> 3)",
    "canon": "(SELECT CASE WHEN rel_type IN ('Developed   By', 'Funded by') THEN tgt ELSE src END AS src, CASE WHEN rel_type IN ('Developed   By', 'Funded by') THEN src ELSE tgt END AS tgt, CASE rel_type WHEN 'Developed   By' THEN 'develops' WHEN 'Funded by' THEN 'funds' ELSE rel_type END AS rel_type, seq, article, description FROM {obs})",
    "edge": "(SELECT src, tgt, rel_type, count(*)::DOUBLE AS weight FROM {canon} GROUP BY ALL)",
    "syn": "(SELECT e.id AS entity_id, coalesce(description, '') AS summary, concat_ws(' ', coalesce(description, ''), coalesce(description, ''), name) AS synthesis, coalesce(n_articles, 0) AS n_articles, e.id % 6 = 0 AS stale, 1 AS version FROM {ent} e LEFT JOIN (SELECT entity_id AS id, count(DISTINCT article_uid) AS n_articles FROM {ment} GROUP BY 1) m USING (id) WHERE e.id % 3 = 0)",
    "scope": f"(SELECT DISTINCT entity_id AS id FROM {{ment}} m JOIN {{art}} a ON a.uid = m.article_uid WHERE a.workspace_id = {WORKSPACE})",
    "sedge": "(SELECT * FROM {edge} WHERE src IN (SELECT id FROM {scope}) AND tgt IN (SELECT id FROM {scope}))",
    "deg": "(SELECT node AS id, count(*) AS degree FROM (SELECT src AS node FROM {sedge} UNION ALL SELECT tgt FROM {sedge}) GROUP BY 1)",
    "vec": "(SELECT vec_id + 1 AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label::VARCHAR AS label FROM embeddings)",
    "wiki": "upper(coalesce(kind, '')) <> 'PERSON' AND lower(trim(name)) NOT IN (" + ", ".join(repr(x) for x in G.METADATA_NAMES) + ") AND NOT regexp_matches(lower(trim(name)), '^([12][0-9]{3}|pmc[0-9].*|pubmed[0-9].*|pmid[0-9].*|volume [0-9].*|issue [0-9].*|doi:.*|license:.*)$')",
}
