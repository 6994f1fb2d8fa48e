"""The entity graph. Suppliers and parts are its nodes, line items its observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.functions.text import name_similarity
from biblion.operators import graph as G
from biblion.operators.retrieval import top_per
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


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Edges seen: supplier to part, the relation by return flag, the order as article."""
    rel = F.when(F.col("l_returnflag") == "R", "Used  By").when(F.col("l_returnflag") == "A", "supports").otherwise("develops")
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("tgt"), rel.alias("rel_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_orderkey").alias("article"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("description"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("src", "tgt", "rel_type").agg(F.count(F.lit(1)).cast("double").alias("weight"))


_OBS = "(SELECT l_suppkey AS src, l_partkey + 1000000 AS tgt, CASE l_returnflag WHEN 'R' THEN 'Used  By' WHEN 'A' THEN 'supports' ELSE 'develops' END AS rel_type, l_orderkey * 10 + l_linenumber AS seq, l_orderkey AS article, 'line ' || l_linenumber::VARCHAR AS description FROM lineitem)"
_EDGES = f"(SELECT src, tgt, rel_type, count(*)::DOUBLE AS weight FROM {_OBS} GROUP BY 1, 2, 3)"


@query(f"SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_EDGES} UNION ALL SELECT tgt FROM {_EDGES}) GROUP BY 1")
def agg_degree(spark, d):
    return G.degrees(edges(spark, d))


@query(f"SELECT rel_type, count(*) AS n FROM {_EDGES} GROUP BY 1 ORDER BY n DESC, rel_type LIMIT 10")
def agg_reltype_hist(spark, d):
    return edges(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_type").limit(10)


@query(f"SELECT node, other, rank FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::INTEGER AS rank FROM (SELECT node, other, sum(weight) AS weight FROM (SELECT src AS node, tgt AS other, weight FROM {_EDGES} UNION ALL SELECT tgt, src, weight FROM {_EDGES}) GROUP BY 1, 2)) WHERE rank <= 5")
def join_neighbor_case(spark, d):
    n = G.both_ways(edges(spark, d)).groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    return top_per(n, ["node"], [F.desc("weight"), F.asc("other")], 5).select("node", "other", "rank")


@query("SELECT p_partkey + 1000000 AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_anti_not_exists(spark, d):
    nodes = table(spark, d, "part").select((F.col("p_partkey") + 1_000_000).alias("node"))
    strong = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("tgt"))
    return G.isolated(nodes, strong)


@query(f"SELECT p_partkey + 1000000 AS node, p_name AS name, coalesce(g.degree, 0) AS degree FROM part LEFT JOIN (SELECT tgt AS node, count(*) AS degree FROM {_EDGES} GROUP BY 1) g ON g.node = p_partkey + 1000000")
def join_left_degrees(spark, d):
    nodes = table(spark, d, "part").select((F.col("p_partkey") + 1_000_000).alias("node"), F.col("p_name").alias("name"))
    return nodes.join(G.degrees(edges(spark, d)), "node", "left").select("node", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"SELECT e.src, e.tgt, s.s_name AS src_name, p.p_name AS tgt_name, e.weight FROM {_EDGES} e JOIN supplier s ON s.s_suppkey = e.src JOIN part p ON p.p_partkey + 1000000 = e.tgt ORDER BY e.weight DESC, e.src, e.tgt, e.rel_type LIMIT 40")
def join_edge_endpoints(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("src_name"))
    p = table(spark, d, "part").select((F.col("p_partkey") + 1_000_000).alias("tgt"), F.col("p_name").alias("tgt_name"))
    top = edges(spark, d).orderBy(F.desc("weight"), "src", "tgt", "rel_type").limit(40)
    return top.join(s, "src").join(p, "tgt").select("src", "tgt", "src_name", "tgt_name", "weight")


_TOP = f"(SELECT node, degree, degree AS mentions FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_EDGES} UNION ALL SELECT tgt FROM {_EDGES}) GROUP BY 1) ORDER BY degree DESC, node LIMIT 80)"


def _view(spark, d):
    return G.degrees(edges(spark, d)).orderBy(F.desc("degree"), "node").limit(80).withColumn("mentions", F.col("degree"))


@query(f"SELECT node, round(cos(2*pi()*(r-1)/n - pi()/2)*0.9, 6) + 0.0 AS x, round(sin(2*pi()*(r-1)/n - pi()/2)*0.9, 6) + 0.0 AS y FROM (SELECT node, row_number() OVER (ORDER BY node) AS r, count(*) OVER () AS n FROM {_TOP})")
def fn_layout_circle(spark, d):
    return G.circle_layout(_view(spark, d)).select("node", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query(f"WITH k AS (SELECT node, row_number() OVER (ORDER BY degree DESC, mentions DESC, node) - 1 AS r, count(*) OVER () - 1 AS m FROM {_TOP}), z AS (SELECT node, r, CASE WHEN r = 0 THEN 0.0::DOUBLE ELSE 0.14::DOUBLE + 0.82::DOUBLE * sqrt(r / m) END AS q FROM k) SELECT node, round(q * cos(r * 2.399963229728653::DOUBLE), 6) AS x, round(q * sin(r * 2.399963229728653::DOUBLE), 6) AS y FROM z")
def fn_layout_rings(spark, d):
    return G.ring_layout(_view(spark, d)).select("node", "x", "y")


@query()
def fn_layout_force(spark, d):
    return G.force_layout(_view(spark, d), edges(spark, d))


_ENT = "(SELECT id, any_value(canonical_name) AS canonical_name, any_value(entity_type) AS entity_type, any_value(aliases) AS aliases, max(mention_count) AS mention_count FROM kg_entities GROUP BY id)"


def entities(spark, d):
    return table(spark, d, "kg_entities").groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("canonical_name", "entity_type", "aliases")], F.max("mention_count").alias("mention_count"))


@query(f"""SELECT id, match FROM (SELECT id, CASE WHEN lower(canonical_name) = 'university' THEN 0 WHEN lower(canonical_name) LIKE 'university%' THEN 1 ELSE 2 END AS match, mention_count, canonical_name FROM {_ENT} WHERE lower(canonical_name) LIKE '%university%') ORDER BY match, mention_count DESC NULLS LAST, canonical_name, id LIMIT 12""")
def srt_entity_match(spark, d):
    n = F.lower("canonical_name")
    match = F.when(n == "university", 0).when(n.startswith("university"), 1).otherwise(2)
    return entities(spark, d).where(n.contains("university")).withColumn("match", match).orderBy("match", F.desc_nulls_last("mention_count"), "canonical_name", "id").limit(12).select("id", "match")


@query(f"SELECT id FROM {_ENT} WHERE upper(coalesce(entity_type,'')) <> 'PERSON' AND lower(trim(canonical_name)) NOT IN ({', '.join(repr(x) for x in G.METADATA_NAMES)}) AND NOT regexp_matches(lower(trim(canonical_name)), '^([12][0-9]{{3}}|pmc[0-9].*|pubmed[0-9].*|pmid[0-9].*|volume [0-9].*|issue [0-9].*|doi:.*|license:.*)$')")
def flt_wiki_entity(spark, d):
    return entities(spark, d).where(G.wiki_entity(F.col("canonical_name"), F.col("entity_type"))).select("id")


@query(f"SELECT id FROM {_ENT} WHERE length(trim(canonical_name)) BETWEEN 2 AND 120 AND regexp_matches(canonical_name, '\\p{{L}}') AND lower(trim(canonical_name)) NOT IN ({', '.join(repr(x) for x in G.METADATA_NAMES)})")
def flt_entity_name(spark, d):
    return entities(spark, d).where(G.reasonable_name(F.col("canonical_name")) & ~G.metadata_entity(F.col("canonical_name"))).select("id")


@query(f"SELECT canonical_name FROM {_ENT} ORDER BY length(canonical_name) DESC, canonical_name LIMIT 50")
def srt_wiki_links(spark, d):
    return entities(spark, d).orderBy(F.desc(F.length("canonical_name")), "canonical_name").limit(50).select("canonical_name")


@query(f"SELECT id, CASE WHEN q = n THEN 1.0 WHEN starts_with(n, q) THEN 0.95 WHEN contains(n, q) THEN 0.85 WHEN list_contains(a, q) THEN 0.9 WHEN len(list_filter(a, lambda x: contains(x, q))) > 0 THEN 0.8 END::DOUBLE AS similarity FROM (SELECT id, 'univ' AS q, lower(trim(canonical_name)) AS n, list_transform(coalesce(aliases, []), lambda x: lower(trim(x))) AS a FROM {_ENT})")
def fn_name_similarity(spark, d):
    return entities(spark, d).select("id", name_similarity(F.lit("univ"), F.col("canonical_name"), F.col("aliases")).alias("similarity"))


@query("SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS n_articles FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3")
def kg_synthesis_candidates(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.count_distinct("l_orderkey").alias("n_articles")).where("n_articles >= 3")
