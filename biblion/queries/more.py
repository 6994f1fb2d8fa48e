"""Further text, graph and update operators of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import graph as G
from biblion.operators import ingest as I
from biblion.operators.retrieval import top_per
from biblion.queries.graph import _EDGES, _ENT, edges, entities
from biblion.queries.ingest import _C, _FORM, _cand
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


@query(f"SELECT cand_uid, {_FORM.format(chr(39) + chr(39) + ' || concat_ws(' + repr(' ') + ', title, summary, journal)')} AS form FROM {_C}")
def fn_candidate_text(spark, d):
    return _cand(spark, d).select("cand_uid", I.candidate_text().alias("form"))


@query(f"SELECT cand_uid, coalesce(nullif(trim(string_split_regex(authors, '[,;]')[1]), ''), 'Unknown') AS first FROM {_C}")
def fn_first_author_list(spark, d):
    return _cand(spark, d).select("cand_uid", T.first_author(F.col("authors")).alias("first"))


@query(f"SELECT cand_uid FROM {_C} WHERE regexp_matches({_FORM.format('title')}, 'alert|triage') AND (contains({_FORM.format('title')}, 'alert')::INT + contains({_FORM.format('title')}, 'sepsis')::INT) >= 2 OR (contains({_FORM.format('title')}, 'triage')::INT + contains({_FORM.format('title')}, 'stroke')::INT) >= 2")
def flt_candidate_terms(spark, d):
    """Two groups of query words: sepsis and alert, or triage and stroke."""
    group = lambda *w: F.struct(F.array(*map(F.lit, w)).alias("tokens"), F.array(*map(F.lit, w)).alias("anchors"), F.array().cast("array<string>").alias("domains"), F.array().cast("array<string>").alias("tech"))
    title = T.search_form(F.col("title"))
    return _cand(spark, d).where(I.matches_groups(title, title, F.array(group("sepsis", "alert"), group("triage", "stroke")))).select("cand_uid")


@query(f"SELECT id, CASE upper(entity_type) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in G.TYPE_COLOURS.items())} ELSE '#8296a5' END AS colour FROM {_ENT}")
def fn_node_color(spark, d):
    colours = F.create_map(*[F.lit(x) for kv in G.TYPE_COLOURS.items() for x in kv])
    return entities(spark, d).select("id", F.coalesce(F.try_element_at(colours, F.upper("entity_type")), F.lit("#8296a5")).alias("colour"))


@query(f"WITH g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_EDGES} UNION ALL SELECT tgt FROM {_EDGES}) GROUP BY 1) SELECT node, round(4.5 + 8 * sqrt(degree / greatest((SELECT max(degree) FROM g), 1)), 6) AS radius FROM g")
def fn_node_radius(spark, d):
    g = G.degrees(edges(spark, d))
    return g.join(F.broadcast(g.agg(F.max("degree").alias("most"))), F.lit(True)).select("node", F.round(T.node_radius(F.col("degree"), F.col("most")), 6).alias("radius"))
