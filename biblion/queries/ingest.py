"""Candidate ingestion: keys, merging, deduplication, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import ingest as I
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


def _cand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_candidate").groupBy("cand_uid").agg(*[F.any_value(c).alias(c) for c in ("source", "title", "summary", "first_author", "authors", "pub_date", "journal", "doi", "url")])


def _art(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "haie_rev").groupBy("uid").agg(*[F.any_value(c).alias(c) for c in ("title", "doi", "journal", "pub_date", "content_type", "abstract_text")])


_C = "(SELECT cand_uid, any_value(source) AS source, any_value(title) AS title, any_value(summary) AS summary, any_value(first_author) AS first_author, any_value(authors) AS authors, any_value(pub_date) AS pub_date, any_value(journal) AS journal, any_value(doi) AS doi, any_value(url) AS url FROM article_candidate GROUP BY 1)"
_A = "(SELECT uid, any_value(title) AS title, any_value(doi) AS doi, any_value(journal) AS journal, any_value(pub_date) AS pub_date FROM haie_rev GROUP BY 1)"
_DOI = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '^(?:https?://|dx\.doi\.org/|www\.doi\.org/|doi\.org/|doi:|\s)+', ''), '[.,]+$', ''))"
_FORM = "regexp_replace(replace(replace(replace(replace(replace(lower({0}), 'large language model', 'llm'), 'large-language-model', 'llm'), 'chat bot', 'chatbot'), 'chat-bot', 'chatbot'), 'self-management', 'self management'), '[^a-z0-9]', ' ', 'g')"
_TITLE = f"array_to_string(list_filter(string_split_regex({_FORM}, ' +'), lambda w: w <> '' AND w <> 'preprint'), ' ')"


@query(f"SELECT cand_uid, {_DOI.format('doi')} AS doi_key FROM {_C}")
def fn_normalize_doi(spark, d):
    return _cand(spark, d).select("cand_uid", T.normalize_doi(F.col("doi")).alias("doi_key"))


@query(f"SELECT cand_uid, {_TITLE.format('title')} AS title_key FROM {_C}")
def fn_dup_title(spark, d):
    return _cand(spark, d).select("cand_uid", T.duplicate_title(F.col("title")).alias("title_key"))


@query(f"SELECT cand_uid, array_to_string(list_sort(list_distinct(list_filter(string_split_regex({_FORM.format('title')}, ' +'), lambda w: length(w) >= 3))), ' ') AS tokens FROM {_C}")
def fn_tokenize(spark, d):
    return _cand(spark, d).select("cand_uid", F.array_join(T.search_tokens(F.col("title")), " ").alias("tokens"))


@query(f"SELECT cand_uid, array_to_string(list_sort(list_distinct(list_filter(string_split_regex({_FORM.format('title')}, ' +'), lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(repr(w) for w in T.QUERY_STOPWORDS)}], w)))), ' ') AS tokens FROM {_C}")
def fn_focused_tokens(spark, d):
    return _cand(spark, d).select("cand_uid", F.array_join(T.focused_tokens(F.col("title")), " ").alias("tokens"))


@query(f"SELECT cand_uid, CASE WHEN nullif(trim(doi),'') IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN nullif(trim(summary),'') IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN nullif(trim(pub_date),'') IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN nullif(trim(authors),'') IS NOT NULL THEN 1 ELSE 0 END AS richness FROM {_C}")
def fn_richness(spark, d):
    return _cand(spark, d).select("cand_uid", I.richness().alias("richness"))


@query(f"SELECT DISTINCT c.cand_uid FROM {_C} c JOIN {_A} a ON nullif({_DOI.format('c.doi')}, '') = {_DOI.format('a.doi')} UNION SELECT DISTINCT c.cand_uid FROM {_C} c JOIN {_A} a ON nullif({_TITLE.format('c.title')}, '') = {_TITLE.format('a.title')}")
def join_known_dups(spark, d):
    return I.known_duplicates(_cand(spark, d), _art(spark, d))


@query(f"""WITH a AS (SELECT uid, nullif({_DOI.format('doi')}, '') AS dk, nullif({_TITLE.format('title')}, '') AS tk FROM {_A}), c AS (SELECT cand_uid, nullif({_DOI.format('doi')}, '') AS dk, nullif({_TITLE.format('title')}, '') AS tk FROM {_C}),
x AS (SELECT dk, min(uid) AS u FROM a WHERE dk IS NOT NULL GROUP BY 1), y AS (SELECT tk, min(uid) AS u FROM a WHERE tk IS NOT NULL GROUP BY 1)
SELECT c.cand_uid, coalesce(x.u, y.u) AS uid FROM c LEFT JOIN x ON x.dk = c.dk LEFT JOIN y ON y.tk = c.tk WHERE coalesce(x.u, y.u) IS NOT NULL""")
def join_dup_lookup(spark, d):
    return I.duplicate_target(_cand(spark, d), _art(spark, d))


@query(f"SELECT cand_uid FROM {_C} WHERE regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[0]}') AND regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[1]}') AND regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[2]}')")
def flt_scope_phrases(spark, d):
    return _cand(spark, d).where(I.in_scope(F.col("title"), F.col("summary"))).select("cand_uid")


@query(f"SELECT cand_uid, CASE source {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in T.SOURCE_LABELS.items())} END AS label FROM {_C}")
def fn_source_label(spark, d):
    return _cand(spark, d).select("cand_uid", T.source_label(F.col("source")).alias("label"))


@query("SELECT strftime(greatest(e - INTERVAL 29 DAY, DATE '2026-03-01'), '%Y-%m-%d') AS window_start, strftime(e, '%Y-%m-%d') AS window_end FROM (SELECT unnest(generate_series(DATE '2026-05-20', DATE '2026-03-01', INTERVAL '-30' DAY)) AS e)")
def src_rxiv_windows(spark, d):
    w = spark.range(1).select(F.explode(I.listing_windows(F.lit("2026-03-01").cast("date"), F.lit("2026-05-20").cast("date"))).alias("w"))
    return w.select(F.col("w.start").cast("string").alias("window_start"), F.col("w.end").cast("string").alias("window_end"))
