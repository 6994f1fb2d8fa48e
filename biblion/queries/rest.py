"""What is left of the inventory: files and pages written, feeds cut down, settings, answer formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import generation as N
from biblion.operators import ingest as I
from biblion.operators import settings as O
from biblion.operators import wiki as W
from biblion.queries import kb
from biblion.queries.intake import _C, _CLEAN, _DAY, _oai, candidates
from biblion.sources import connectors as S
from biblion.sources.extract import order_fragments

query = kb.Registry()
QUERIES, ORACLE = query.queries, query.oracle
_c = F.col


@query("SELECT uid, regexp_replace(uid, '[^A-Za-z0-9._-]', '_', 'g') || '-' || left(sha256(abstract_text), 16) || '.pdf' AS file FROM {art} WHERE abstract_text IS NOT NULL")
def sink_pdf(spark, d):
    """Names of stored files: the key made safe and the start of the content's digest."""
    a = kb.articles(spark, d).where("abstract_text is not null")
    return a.select("uid", T.pdf_filename(_c("uid"), _c("abstract_text")).alias("file"))


_FEED = [("Authors: Anna Lo Abstract: We saw it. Comments: none", "We saw it."), ("Just a text.", "Just a text."), ("Authors: Anna Lo Subjects: x", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {repr(b) if b else 'NULL'})" for a, b in _FEED) + ") v(description, summary)")
def fn_rss_summary(spark, d):
    """The abstract of a feed's description, else the whole, unless it has labels."""
    return spark.createDataFrame([(a,) for a, _ in _FEED], "description string").select("description", T.feed_summary(_c("description")).alias("summary"))


@query(f"SELECT cand_uid FROM {_C} WHERE ({_DAY} IS NULL OR {_DAY} BETWEEN '2024-01-01' AND '2025-12-31') AND regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[0]}') AND regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[1]}') AND regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[2]}')")
def src_arxiv_rss_filter(spark, d):
    """A feed's records of the window and of the default scope."""
    c = candidates(spark, d).where(I.in_window(_c("pub_date"), F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date")))
    return I.profile_filter(c, []).select("cand_uid")


@query(f"SELECT 'arxiv:' || trim(source_id) AS uid, CASE WHEN length(source_id) % 4 = 0 THEN 2 ELSE 1 END AS n FROM {_C} WHERE {_CLEAN.replace('{0}', 'title')} IS NOT NULL AND nullif(trim(source_id), '') IS NOT NULL")
def src_arxiv_oai_set(spark, d):
    """Pages of a harvest as one list; what stands on two pages (here: every record of a length) is one record."""
    first = S.list_source("arxiv", _oai(spark, d))
    second = first.where(F.length("source_id") % 4 == 0)
    return S.merged_lists([first, second]).select("uid", _c("n_records").cast("int").alias("n"))


@query("SELECT e.kind AS gap, string_agg('- ' || name || ' (confidence ' || printf('%.2f', (id % 100) / 100.0) || ')', chr(10) ORDER BY id) AS issues FROM {ent} e WHERE id % 10 = 0 GROUP BY 1")
def kg_gap_bridge(spark, d):
    """Issues of gaps as the text a service is asked with."""
    e = kb.entities(spark, d).where("id % 10 = 0").select(_c("kind").alias("gap"), "id", _c("name").alias("issue"), ((F.col("id") % 100) / 100).alias("confidence"))
    return N.gap_text(e, "gap", "id")


_SRC = "regexp_replace(regexp_replace(lower(uid), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT 'daily/' || reg_date || '.md' AS path, '# ' || reg_date || chr(10) || chr(10) || string_agg('- [' || regexp_replace(coalesce(nullif(trim(title), ''), uid), '([\\[\\]])', '\\\\\\1', 'g') || '](../sources/' || {_SRC} || '.md)', chr(10) ORDER BY title, uid) || chr(10) AS body FROM {{art}} WHERE reg_date IS NOT NULL GROUP BY reg_date")
def wiki_render_daily(spark, d):
    """A page for each day with the articles registered on it."""
    return W.daily_pages(kb.articles(spark, d))


@query("SELECT * FROM (VALUES (false, '{\"type\":\"json_schema\",\"json_schema\":{\"name\":\"answer\",\"schema\":{\"type\":\"object\"}}}'), (true, '{\"type\":\"json_object\"}')) v(compatible, format)")
def pr_json_schema_format(spark, d):
    """How a service is asked for JSON: by a schema, or as an object where it knows no schemas."""
    rows = [(c, N.response_format({"type": "object"}, c)) for c in (False, True)]
    return spark.createDataFrame(rows, "compatible boolean, format string")


@query("SELECT * FROM (VALUES ('language', 'de'), ('api_key', 'abcd...wxyz'), ('limit', '50')) v(name, value)")
def ops_settings(spark, d):
    """Settings: defaults, what a file says over them, keys masked."""
    loaded = O.load('﻿{"language": "de", "api_key": "abcd1234wxyz", "unknown": 1}', {"language": "en", "limit": 50, "api_key": ""})
    return spark.createDataFrame(sorted((k, str(v)) for k, v in O.shown(loaded).items()), "name string, value string")


@query("SELECT * FROM (VALUES (1, 'A title across both columns' || chr(10) || 'left one' || chr(10) || 'left two' || chr(10) || 'right one' || chr(10) || 'right two')) v(page, text)")
def fn_pdf_order(spark, d):
    """Fragments of a page of two columns in reading order."""
    rows = [(1, 320.0, 560.0, 600.0, 612.0, 10.0, "right one"), (1, 50.0, 290.0, 600.0, 612.0, 10.0, "left one"), (1, 50.0, 290.0, 580.0, 612.0, 10.0, "left two"), (1, 320.0, 560.0, 580.0, 612.0, 10.0, "right two"), (1, 50.0, 560.0, 700.0, 612.0, 14.0, "A title across both columns")]
    return order_fragments(spark.createDataFrame(rows, "page int, x double, x_end double, y double, page_width double, font_size double, text string")).select("page", F.trim("text").alias("text"))
