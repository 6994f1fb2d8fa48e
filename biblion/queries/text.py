"""Text functions and extraction over the domain tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.session import table
from biblion.sources.extract import extract_sections

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str):
    return table(spark, d, "documents").select("doc_id", "title", "text")


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(len(ws) - 1, 0), 390)) AS st FROM w WHERE len(ws) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS chunk_index, least(450, len(ws) - st) AS n_words FROM s WHERE st = 0 OR st - 390 + 450 < len(ws) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY st) <= 12""")
def fn_chunk_kg(spark, d):
    c = _docs(spark, d).where("text is not null").select("doc_id", F.posexplode(T.word_windows(F.col("text"))).alias("chunk_index", "chunk"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size(F.split("chunk", " ")).cast("long").alias("n_words"))


@query("SELECT DISTINCT id, CASE WHEN source_section IS NULL THEN 'body' WHEN contains(lower(source_section),'abstract') THEN 'abstract' WHEN regexp_matches(lower(source_section),'introduction|background') THEN 'introduction' WHEN contains(lower(source_section),'method') THEN 'methods' WHEN contains(lower(source_section),'result') THEN 'results' WHEN contains(lower(source_section),'discussion') THEN 'discussion' WHEN contains(lower(source_section),'conclusion') THEN 'conclusion' WHEN regexp_matches(lower(source_section),'reference|bibliography') THEN 'references' ELSE 'body' END AS kind FROM article_chunks")
def fn_chunk_type(spark, d):
    return table(spark, d, "article_chunks").select("id", T.chunk_type(F.col("source_section")).alias("kind")).distinct()


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def fn_slug_wiki(spark, d):
    return _docs(spark, d).select("doc_id", T.wiki_slug(F.col("title")).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS short FROM documents")
def fn_truncate(spark, d):
    return _docs(spark, d).select("doc_id", T.truncated(F.col("text"), 80).alias("short"))


@query(r"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(title, '<[^>]*(>|$)', '', 'g'), '\s+', ' ', 'g')), '\.+$', '') AS clean FROM documents")
def fn_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("title")).alias("clean"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def fn_sha256(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def fn_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query()
def fn_extract_dispatch(spark, d):
    """Documents as pages: those with tags are read as HTML, all others as plain text."""
    kind = F.when(F.col("text").rlike("(?i)<html|<body"), "html").otherwise("text")
    return extract_sections(_docs(spark, d).withColumn("kind", kind), "doc_id", "text", "kind").select("key", "full_text", F.size("sections").alias("n_sections"))


@query()
def fn_count_tokens_all(spark, d):
    """Words of any script and single marks of every document (no SQL: word classes of the two engines differ; a test counts them)."""
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.unicode_word_tokens(F.col("text"))).cast("long").alias("n_tokens"))
