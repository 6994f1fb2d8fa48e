"""Reads of the knowledge graph: scope, statistics, neighbours, views, contexts, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import graph as G
from biblion.operators import retrieval as R
from biblion.queries import kb
from biblion.queries.kb import WORKSPACE

query = kb.Registry()
QUERIES, ORACLE = query.queries, query.oracle


def scope(spark, d):
    return G.workspace_entities(kb.mentions(spark, d), kb.articles(spark, d), WORKSPACE)


def scoped_edges(spark, d):
    return G.scoped_edges(kb.edges(spark, d), scope(spark, d))


@query("SELECT id FROM {scope}")
def flt_ws_entity_scope(spark, d):
    return scope(spark, d)


_META = ", ".join(repr(x) for x in G.METADATA_NAMES)
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_DATED = f"(strlen({{0}}) <= 40 AND regexp_matches({{0}}, '{_MONTHS}') AND len(list_filter(string_split_regex({{0}}, '[^0-9a-z]'), lambda t: regexp_full_match(t, '[0-9]{{{{4}}}}') AND t BETWEEN '1900' AND '2100')) > 0 AND len(list_filter(string_split_regex({{0}}, '[^0-9a-z]'), lambda t: regexp_full_match(t, '0?[1-9]|[12][0-9]|3[01]'))) > 0)"
_BAD = f"({{0}} = '' OR {{0}} IN ({_META}) OR (regexp_full_match({{0}}, '[0-9]{{{{4}}}}') AND {{0}} BETWEEN '1900' AND '2100') OR {_DATED} OR regexp_matches({{0}}, '^(pmc|pubmed|pmid)[0-9]*$|^(doi:|license:|volume |issue )'))"


def _bad(column: str) -> str:
    return _BAD.format(f"lower(trim({column}))").replace("{{", "{").replace("}}", "}").replace("{{", "{").replace("}}", "}")


_NAMES = "(SELECT id, name FROM {ent} UNION ALL SELECT -a, x FROM (VALUES (1, '12 March 2021'), (2, 'PMC12345'), (3, '2024'), (4, 'Volume 3'), (5, ' Journal '), (6, 'May 2020'), (7, 'doi:10.5/x'), (8, 'march')) v(a, x))"


def _odd_names(spark, d):
    odd = ["12 March 2021", "PMC12345", "2024", "Volume 3", " Journal ", "May 2020", "doi:10.5/x", "march"]
    return kb.entities(spark, d).select("id", "name").unionByName(spark.createDataFrame([(-i - 1, x) for i, x in enumerate(odd)], "id long, name string"))


@query(f"SELECT id, {_bad('name')} AS is_metadata FROM {_NAMES}")
def flt_metadata_entity(spark, d):
    return _odd_names(spark, d).select("id", G.metadata_entity(F.col("name")).alias("is_metadata"))


@query(f"SELECT id, {_DATED.format('lower(trim(name))').replace('{{', '{').replace('}}', '}')} AS is_date FROM {_NAMES}")
def flt_pub_date_literal(spark, d):
    return _odd_names(spark, d).select("id", G.date_literal(F.col("name")).alias("is_date"))


_EXTRACT = f"""WITH x AS (SELECT m.chunk_id, m.k, e.name, e.kind, CASE WHEN (m.chunk_id + k) % 7 = 0 THEN 'too short' ELSE e.description END AS description FROM {{ment}} m JOIN {{ent}} e ON e.id = m.entity_id),
ok AS (SELECT DISTINCT chunk_id, trim(name) AS name FROM x WHERE length(trim(name)) BETWEEN 2 AND 120 AND regexp_matches(name, '\\p{{L}}') AND NOT {_bad('name')} AND coalesce(trim(kind), '') <> '' AND length(trim(coalesce(description, ''))) >= 15),
r AS (SELECT a.chunk_id, trim(a.name) AS source, trim(b.name) AS target FROM x a JOIN x b ON a.chunk_id = b.chunk_id AND b.k = a.k + 1 UNION ALL SELECT chunk_id, trim(name), 'Nobody mentioned' FROM x WHERE k = 0)
SELECT i.id AS chunk_id, (SELECT count(*) FROM ok WHERE ok.chunk_id = i.id) AS n_entities, (SELECT count(*) FROM r WHERE r.chunk_id = i.id AND EXISTS (SELECT 1 FROM ok WHERE ok.chunk_id = r.chunk_id AND ok.name = r.source) AND EXISTS (SELECT 1 FROM ok WHERE ok.chunk_id = r.chunk_id AND ok.name = r.target)) AS n_relations FROM {{chunk}} i"""


@query(_EXTRACT)
def flt_extraction(spark, d):
    """What a model extracted of each chunk, checked: entities that are none are dropped, then relations that lost an end."""
    m = kb.mentions(spark, d).join(kb.entities(spark, d).select(F.col("id").alias("entity_id"), "name", "kind", "description"), "entity_id")
    said = F.when((F.col("chunk_id") + F.col("k")) % 7 == 0, "too short").otherwise(F.col("description"))
    row = F.struct("k", "name", F.col("kind").alias("entity_type"), said.alias("description"))
    e = m.groupBy("chunk_id").agg(F.array_sort(F.collect_list(row)).alias("entities"))  # three a chunk
    at = lambda i: F.get("entities", F.lit(i))["name"]
    rel = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    e = e.withColumn("relations", F.array(rel(at(0), at(1)), rel(at(1), at(2)), rel(at(0), F.lit("Nobody mentioned"))))
    out = e.select("chunk_id", G.valid_extraction(F.col("entities"), F.col("relations")).alias("x"))
    return out.select("chunk_id", F.size("x.entities").cast("long").alias("n_entities"), F.size("x.relations").cast("long").alias("n_relations"))


@query("SELECT entity_id FROM {syn} WHERE trim(summary) <> '' AND length(trim(synthesis)) >= 80")
def flt_synthesis_valid(spark, d):
    return kb.syntheses(spark, d).where(G.valid_synthesis(F.col("summary"), F.col("synthesis"))).select("entity_id")


@query("SELECT 'nodes' AS part, count(*) AS n FROM {ent} WHERE id IN (SELECT id FROM {scope}) UNION ALL SELECT 'edges', count(*) FROM {sedge} UNION ALL SELECT coalesce(kind, 'UNKNOWN'), count(*) FROM {ent} WHERE id IN (SELECT id FROM {scope}) GROUP BY 1")
def agg_kg_stats(spark, d):
    nodes = kb.entities(spark, d).join(scope(spark, d), "id", "left_semi")
    return G.graph_stats(nodes, scoped_edges(spark, d))


@query("SELECT count(*) AS total, sum(CASE WHEN uid IN (SELECT article_uid FROM {chunk}) THEN 1 ELSE 0 END)::BIGINT AS done, greatest(count(*) - sum(CASE WHEN uid IN (SELECT article_uid FROM {chunk}) THEN 1 ELSE 0 END), 0)::BIGINT AS remaining FROM {art}")
def agg_kg_progress(spark, d):
    """Articles and how many of them are done (have chunks)."""
    done = kb.chunks(spark, d).select(F.col("article_uid").alias("uid")).distinct().withColumn("done", F.lit(True))
    return G.progress(kb.articles(spark, d).join(done, "uid", "left"), F.col("done"))


@query("SELECT workspace_id, count(*) AS total, sum(CASE WHEN byline_summary IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS done, (count(*) - count(byline_summary))::BIGINT AS remaining FROM {art} GROUP BY 1")
def agg_backfill_overview(spark, d):
    return G.progress(kb.articles(spark, d), F.col("byline_summary").isNotNull(), "workspace_id")


@query("SELECT (SELECT count(*) FROM {scope}) AS n_entities, (SELECT count(*) FROM {sedge}) AS n_relations, (SELECT count(*) FROM {syn} WHERE entity_id IN (SELECT id FROM {scope})) AS n_syntheses")
def agg_ws_kg_counts(spark, d):
    s = scope(spark, d)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    syn = kb.syntheses(spark, d).join(s.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")
    return one(s, "n_entities").join(one(scoped_edges(spark, d), "n_relations")).join(one(syn, "n_syntheses"))


_FOLD = "(SELECT src, tgt, rel_type, sum(n)::DOUBLE AS weight, string_agg(article, '|' ORDER BY first_seq) AS articles FROM (SELECT src, tgt, rel_type, article, count(*) AS n, min(seq) AS first_seq FROM {0} GROUP BY ALL) GROUP BY ALL)"


@query(f"SELECT f.src, f.tgt, f.rel_type, f.weight, f.articles, d.description FROM {_FOLD.replace('{0}', '{obs}')} f LEFT JOIN (SELECT src, tgt, rel_type, arg_min(description, seq) AS description FROM {{obs}} WHERE trim(coalesce(description, '')) <> '' GROUP BY ALL) d USING (src, tgt, rel_type)")
def agg_edge_weight(spark, d):
    """Edges as seen: how often, in which articles (in order of arrival), and the first description that says something."""
    e = G.fold_edges(kb.observations(spark, d))
    return e.select("src", "tgt", "rel_type", "weight", F.array_join("articles", "|").alias("articles"), "description")


@query("SELECT src, tgt, rel_type, count(*)::DOUBLE AS weight, string_agg(DISTINCT article, '|' ORDER BY article) AS articles FROM {canon} GROUP BY ALL")
def agg_edge_canonical_merge(spark, d):
    """Edges whose relations turn out alike in normal form are one."""
    o = kb.observations(spark, d)
    e = o.select("src", "tgt", "rel_type", F.lit(None).cast("double").alias("weight"), F.array("article").alias("articles"), "description", F.col("seq").alias("id"))
    return G.merge_edges(e).select("src", "tgt", "rel_type", "weight", F.array_join("articles", "|").alias("articles"))


@query("SELECT id, rel_type, CASE WHEN rel_type IN ('Developed   By', 'Funded by') THEN tgt ELSE src END AS src FROM (SELECT seq AS id, * FROM {obs})")
def fn_canon_rel(spark, d):
    o = kb.observations(spark, d).select(F.col("seq").alias("id"), "src", "tgt", "rel_type", F.col("rel_type").alias("said"))
    return G.canonical_relations(o).select("id", F.col("said").alias("rel_type"), "src")


@query("SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {edge} UNION ALL SELECT tgt FROM {edge}) GROUP BY 1")
def set_union_all_degree(spark, d):
    return G.degrees(kb.edges(spark, d))


@query("SELECT id FROM {ent} WHERE id NOT IN (SELECT src FROM {edge} UNION SELECT tgt FROM {edge})")
def set_not_in_ids(spark, d):
    return G.isolated(kb.entities(spark, d).withColumnRenamed("id", "node"), kb.edges(spark, d)).select(F.col("node").alias("id"))


@query("SELECT e.id, e.name, s.summary, coalesce(s.stale, true) AS stale FROM {ent} e LEFT JOIN {syn} s ON s.entity_id = e.id")
def join_left_synthesis(spark, d):
    s = kb.syntheses(spark, d).select(F.col("entity_id").alias("id"), "summary", "stale")
    return kb.entities(spark, d).join(s, "id", "left").select("id", "name", "summary", F.coalesce("stale", F.lit(True)).alias("stale"))


@query("SELECT entity_id, mention_id, article_uid, title FROM (SELECT m.entity_id, m.mention_id, m.article_uid, a.title, row_number() OVER (PARTITION BY m.entity_id ORDER BY m.mention_id DESC) AS r FROM {ment} m JOIN {art} a ON a.uid = m.article_uid) WHERE r <= 20")
def join_mentions_articles(spark, d):
    """The latest twenty mentions of every entity with their articles."""
    return G.latest_mentions(kb.mentions(spark, d), kb.articles(spark, d), 20).select("entity_id", "mention_id", "article_uid", "title")


@query("SELECT m.mention_id, c.id AS chunk_id, c.source_section FROM {ment} m LEFT JOIN {chunk} c ON c.article_uid = m.article_uid AND c.chunk_index = m.chunk_index AND c.embedded")
def join_left_chunk_composite(spark, d):
    """Mentions and the embedded chunk at their place in the article, if there is one."""
    c = kb.chunks(spark, d).where("embedded").select("article_uid", "chunk_index", F.col("id").alias("chunk_id"), "source_section")
    return kb.mentions(spark, d).drop("chunk_id").join(c, ["article_uid", "chunk_index"], "left").select("mention_id", "chunk_id", "source_section")


@query("SELECT e.id FROM {ent} e LEFT JOIN {syn} s ON s.entity_id = e.id WHERE s.entity_id IS NULL OR s.stale")
def join_left_null_or_stale(spark, d):
    return G.to_compile(kb.entities(spark, d), kb.syntheses(spark, d)).select("id")


_LOOK = "(VALUES ('belgavird university'), ('privacy'), ('an'), ('nobody at all'))"


@query(f"SELECT q, id, rank FROM (SELECT q, e.id, CASE WHEN lower(name) = q THEN 1 WHEN contains(lower(name), q) THEN 2 ELSE 3 END AS rank, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN lower(name) = q THEN 1 WHEN contains(lower(name), q) THEN 2 ELSE 3 END, coalesce(mention_count, 0) DESC, e.id) AS r FROM {_LOOK} v(q) JOIN {{ent}} e ON contains(lower(name), q) OR len(list_filter(coalesce(aliases, []), lambda x: contains(lower(x), q))) > 0) WHERE r = 1")
def srt_entity_lookup(spark, d):
    """The one entity a name stands for: by its whole name, else by a part of it, else by an alias; the most mentioned."""
    asked = spark.createDataFrame([("belgavird university",), ("privacy",), ("an",), ("nobody at all",)], "q string")
    return G.looked_up(asked, kb.entities(spark, d)).select("q", "id", "rank")


@query("SELECT src, tgt, rel_type, weight FROM {edge} ORDER BY weight DESC, src, tgt, rel_type LIMIT 40")
def srt_edges(spark, d):
    return kb.edges(spark, d).orderBy(F.desc("weight"), "src", "tgt", "rel_type").limit(40)


@query("SELECT entity_id, uid, chunk_index FROM (SELECT entity_id, uid, chunk_index, row_number() OVER (PARTITION BY entity_id ORDER BY reg_date DESC NULLS LAST, uid, chunk_index) AS r FROM (SELECT DISTINCT m.entity_id, a.uid, m.chunk_index, a.reg_date FROM {ment} m JOIN {art} a ON a.uid = m.article_uid)) WHERE r <= 8")
def srt_sources(spark, d):
    return G.latest_sources(kb.mentions(spark, d), kb.articles(spark, d), 8).select("entity_id", "uid", "chunk_index")


@query("SELECT s.entity_id, s.n_articles, s.stale FROM {syn} s JOIN {ent} e ON e.id = s.entity_id WHERE s.n_articles >= 3 AND {wiki} ORDER BY s.stale DESC, s.n_articles DESC, coalesce(e.mention_count, 0) DESC, s.entity_id LIMIT 100")
def srt_syntheses(spark, d):
    return G.listed_syntheses(kb.syntheses(spark, d), kb.entities(spark, d), 100).select("entity_id", "n_articles", "stale")


_PRIORITY = "CASE kind " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(G.TYPE_ORDER)) + " ELSE 8 END"


@query(f"SELECT e.id, m.n_articles, {_PRIORITY} AS priority FROM {{ent}} e JOIN (SELECT entity_id AS id, count(DISTINCT article_uid) AS n_articles FROM {{ment}} GROUP BY 1 HAVING count(DISTINCT article_uid) >= 3) m USING (id) WHERE {{wiki}} ORDER BY m.n_articles DESC, priority, coalesce(mention_count, 0) DESC, name, e.id LIMIT 50")
def srt_synth_candidates(spark, d):
    """Entities to be described: those of most articles first, then by type, mentions and name."""
    return G.synthesis_candidates(kb.entities(spark, d), kb.mentions(spark, d), 50).select("id", "n_articles", "priority")


@query(f"""WITH me AS (SELECT id, name, mention_count, CASE WHEN lower(name) = 'privacy' THEN 0 WHEN starts_with(lower(name), 'privacy') THEN 1 ELSE 2 END AS fit FROM {{ent}} WHERE contains(lower(name), 'privacy') OR len(list_filter(coalesce(aliases, []), lambda x: contains(lower(x), 'privacy'))) > 0 ORDER BY fit, coalesce(mention_count, 0) DESC, name, id LIMIT 12),
ed AS (SELECT src, tgt, rel_type, weight FROM {{edge}} WHERE src IN (SELECT id FROM me) OR tgt IN (SELECT id FROM me) ORDER BY weight DESC, src, tgt, rel_type LIMIT 40),
so AS (SELECT uid, chunk_index, title, row_number() OVER (ORDER BY reg_date DESC NULLS LAST, uid, chunk_index) AS r FROM (SELECT DISTINCT a.uid, m.chunk_index, a.title, a.reg_date FROM {{ment}} m JOIN {{art}} a ON a.uid = m.article_uid WHERE m.entity_id IN (SELECT id FROM me)) QUALIFY r <= 8)
SELECT 'entity' AS part, id::VARCHAR AS a, name AS b, '' AS c FROM me UNION ALL SELECT 'edge', src::VARCHAR, tgt::VARCHAR, rel_type FROM ed UNION ALL SELECT 'source', uid, chunk_index::VARCHAR, coalesce(title, '') FROM so UNION ALL SELECT 'context', '', '', coalesce(string_agg(coalesce(title, ''), chr(10) || chr(10) ORDER BY r), '') FROM so WHERE r <= 5""")
def q_kg_query(spark, d):
    """Twelve entities that fit, forty of their edges, eight sources, and the context of the first five."""
    return G.graph_answer("privacy", kb.entities(spark, d), kb.edges(spark, d), kb.mentions(spark, d), kb.articles(spark, d))


@query("""WITH b AS (SELECT id, name FROM {ent} WHERE contains(lower(name), 'privacy') ORDER BY CASE WHEN lower(name) = 'privacy' THEN 1 ELSE 2 END, coalesce(mention_count, 0) DESC, id LIMIT 1),
n AS (SELECT other, rel_type, weight FROM (SELECT src AS node, tgt AS other, rel_type, weight FROM {edge} UNION ALL SELECT tgt, src, rel_type, weight FROM {edge}) WHERE node IN (SELECT id FROM b))
SELECT b.id AS entity_id, n.other, e.name AS other_name, n.rel_type, n.weight, s.summary FROM b JOIN n ON true JOIN {ent} e ON e.id = n.other LEFT JOIN {syn} s ON s.entity_id = b.id ORDER BY n.weight DESC, n.other, n.rel_type LIMIT 50""")
def q_kg_entity(spark, d):
    """The entity a name stands for, its strongest fifty neighbours and its synthesis."""
    asked = spark.createDataFrame([("privacy",)], "q string")
    best = G.looked_up(asked, kb.entities(spark, d)).where("rank <= 2").select(F.col("id").alias("node"))
    n = G.both_ways(kb.edges(spark, d)).join(F.broadcast(best), "node")
    names = kb.entities(spark, d).select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    s = kb.syntheses(spark, d).select(F.col("entity_id").alias("node"), "summary")
    return n.join(names, "other").join(s, "node", "left").orderBy(F.desc("weight"), "other", "rel_type").limit(50).select(F.col("node").alias("entity_id"), "other", "other_name", "rel_type", "weight", "summary")


@query("SELECT m.article_uid, m.entity_id, e.name, e.kind, count(*) AS n, min(m.chunk_index) AS first_chunk FROM {ment} m JOIN {ent} e ON e.id = m.entity_id GROUP BY ALL")
def q_kg_article_entities(spark, d):
    m = kb.mentions(spark, d).groupBy("article_uid", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("first_chunk"))
    return m.join(kb.entities(spark, d).select(F.col("id").alias("entity_id"), "name", "kind"), "entity_id").select("article_uid", "entity_id", "name", "kind", "n", "first_chunk")


@query("""SELECT 'top' AS part, '- ' || name || ' [' || coalesce(kind, 'UNKNOWN') || ']: ' || coalesce(summary, description, '') AS line FROM (SELECT e.*, s.summary FROM {ent} e LEFT JOIN {syn} s ON s.entity_id = e.id WHERE e.id IN (SELECT id FROM {scope}) ORDER BY coalesce(mention_count, 0) DESC, e.id LIMIT 30)
UNION ALL SELECT 'type', '- ' || coalesce(kind, 'UNKNOWN') || ': ' || count(*) FROM {ent} WHERE id IN (SELECT id FROM {scope}) GROUP BY kind
UNION ALL SELECT 'relation', line FROM (SELECT '- ' || rel_type || ': ' || count(*) AS line FROM {sedge} GROUP BY rel_type ORDER BY count(*) DESC, rel_type LIMIT 10)
UNION ALL SELECT 'isolated', line FROM (SELECT '- ' || name AS line FROM {ent} WHERE id IN (SELECT id FROM {scope}) AND id NOT IN (SELECT src FROM {edge} UNION SELECT tgt FROM {edge}) ORDER BY id LIMIT 10)""")
def q_gaps(spark, d):
    """What a search for gaps is told of a workspace: top entities, types, relations, isolated entities."""
    return G.gap_lines(kb.entities(spark, d).join(scope(spark, d), "id", "left_semi"), kb.edges(spark, d), scoped_edges(spark, d), kb.syntheses(spark, d))


@query("""WITH k AS (SELECT m.entity_id, m.mention_id, strlen('### From "' || coalesce(a.title, 'Unknown Article') || '" (' || coalesce(a.first_author, 'Unknown') || ')' || chr(10) || coalesce(m.context, '(no context)') || chr(10) || chr(10)) AS size, row_number() OVER (PARTITION BY m.entity_id ORDER BY m.mention_id DESC) AS r FROM {ment} m JOIN {art} a ON a.uid = m.article_uid),
u AS (SELECT *, sum(size) OVER (PARTITION BY entity_id ORDER BY r) AS used FROM k WHERE r <= 20)
SELECT entity_id, mention_id, used::BIGINT AS used FROM u WHERE used <= 1500""")
def q_synth_context(spark, d):
    """Of the latest twenty mentions of an entity what fits 1,500 bytes."""
    last = G.latest_mentions(kb.mentions(spark, d), kb.articles(spark, d), 20)
    return R.budget(last, ["entity_id"], [F.asc("rank")], F.octet_length(G.mention_entry()), 1500).select("entity_id", "mention_id", F.col("used").cast("long").alias("used"))


@query("""WITH top AS (SELECT src, tgt, rel_type FROM {edge} ORDER BY weight DESC, src, tgt, rel_type LIMIT 20),
sh AS (SELECT DISTINCT t.src, t.tgt, t.rel_type, x.article_uid FROM top t JOIN {ment} x ON x.entity_id = t.src JOIN {ment} y ON y.entity_id = t.tgt AND y.article_uid = x.article_uid),
c AS (SELECT sh.src, sh.tgt, sh.rel_type, '### From "' || coalesce(a.title, 'Unknown Article') || '" (' || coalesce(a.first_author, 'Unknown') || ')' || chr(10) || coalesce(m.context, '(no context)') || chr(10) || chr(10) AS entry, max(m.mention_id) AS last FROM sh JOIN {ment} m ON m.article_uid = sh.article_uid AND m.entity_id IN (sh.src, sh.tgt) JOIN {art} a ON a.uid = sh.article_uid GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY src, tgt, rel_type ORDER BY last DESC) AS r FROM c), u AS (SELECT *, sum(strlen(entry)) OVER (PARTITION BY src, tgt, rel_type ORDER BY r) AS used FROM r WHERE r <= 10)
SELECT src, tgt, rel_type, string_agg(entry, '' ORDER BY r) AS contexts FROM u WHERE used <= 4000 GROUP BY ALL""")
def q_rel_evidence(spark, d):
    """What the articles that mention both ends say, for the twenty strongest edges: ten contexts, 4,000 bytes."""
    top = kb.edges(spark, d).orderBy(F.desc("weight"), "src", "tgt", "rel_type").limit(20).select("src", "tgt", "rel_type")
    return G.shared_contexts(top, kb.mentions(spark, d), kb.articles(spark, d), 10, 4000)


@query("SELECT src, tgt, rel_type, rank FROM (SELECT src, tgt, rel_type, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, src, tgt, rel_type)::INTEGER AS rank, entity FROM (SELECT src AS entity, * FROM {edge} UNION ALL SELECT tgt, * FROM {edge} WHERE src <> tgt) WHERE src % 5 <> 0) WHERE rank <= 5")
def kg_evidence_candidates(spark, d):
    """Of each entity the five strongest edges that have no evidence yet (here: those of every fifth entity have)."""
    e = kb.edges(spark, d).withColumn("evidence", F.when(F.col("src") % 5 == 0, "known"))
    return G.evidence_candidates(e, 5).select("src", "tgt", "rel_type", "rank")


_CAND = "(SELECT r.src, r.tgt, r.rel_type, r.weight, a.name AS src_name, b.name AS tgt_name FROM {sedge} r JOIN {ent} a ON a.id = r.src JOIN {ent} b ON b.id = r.tgt WHERE coalesce((SELECT degree FROM {deg} d WHERE d.id = r.src), 0) >= 1 AND a.kind IN ('PERSON', 'CONCEPT', 'ORGANIZATION', 'TECHNOLOGY') AND b.kind IN ('PERSON', 'CONCEPT', 'ORGANIZATION', 'TECHNOLOGY') ORDER BY r.weight DESC, a.name, b.name, r.rel_type LIMIT 200)"


@query(f"SELECT src, tgt, rel_type, weight FROM {_CAND}")
def q_kg_graph(spark, d):
    """A view large enough for all its candidate edges: of a workspace, by type, of nodes with an edge."""
    view = G.graph_view(kb.entities(spark, d), scoped_edges(spark, d), limit=2000, min_degree=1, kinds=["PERSON", "CONCEPT", "ORGANIZATION", "TECHNOLOGY"], scan=200)
    return view[1].select("src", "tgt", "rel_type", "weight")


@query(f"SELECT id FROM (SELECT e.id, row_number() OVER (ORDER BY coalesce(mention_count, 0) DESC, coalesce(g.degree, 0) DESC, name, e.id) AS r FROM {{ent}} e LEFT JOIN {{deg}} g ON g.id = e.id WHERE e.id IN (SELECT id FROM {{scope}}) AND {{wiki}} AND e.id NOT IN (SELECT src FROM {{sedge}} UNION SELECT tgt FROM {{sedge}})) WHERE r <= 25")
def graph_extra_nodes(spark, d):
    """Nodes that fill a view up: those without an edge in it, the most mentioned first."""
    e, s = scoped_edges(spark, d), scope(spark, d)
    taken = e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct()
    return G.extra_nodes(kb.entities(spark, d).join(s, "id", "left_semi"), G.degrees(e), taken, 25).select("id")


@query("SELECT e.id, name, coalesce(kind, 'UNKNOWN') AS label, coalesce(g.degree, 0) AS degree, coalesce(mention_count, 0) AS mention_count FROM {ent} e LEFT JOIN {deg} g ON g.id = e.id WHERE e.id IN (SELECT id FROM {scope})")
def graph_node_props(spark, d):
    n = kb.entities(spark, d).join(scope(spark, d), "id", "left_semi")
    return G.node_properties(n, G.degrees(scoped_edges(spark, d))).select("id", F.col("node.name").alias("name"), F.get("node.labels", F.lit(0)).alias("label"), F.col("node.properties.degree").alias("degree"), F.col("node.properties.mention_count").alias("mention_count"))


@query("SELECT * FROM (VALUES ('force', 'force'), ('spring', 'force'), ('circle', 'circle'), ('circular', 'circle'), ('radial', 'ring'), ('ring', 'ring'), ('', 'force'), ('no such', 'force')) v(asked, mode)")
def graph_layout_mode(spark, d):
    asked = ["force", "spring", "circle", "circular", "radial", "ring", "", "no such"]
    return spark.createDataFrame([(x, G.layout_mode(x)) for x in asked], "asked string, mode string")


@query("WITH k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM (SELECT id FROM {ent} WHERE id IN (SELECT id FROM {scope}) ORDER BY id LIMIT 100)) SELECT id, round(cos(r * 2.399963229728653::DOUBLE) * sqrt((r + 0.5::DOUBLE) / n), 6) AS x, round(sin(r * 2.399963229728653::DOUBLE) * sqrt((r + 0.5::DOUBLE) / n), 6) AS y FROM k")
def graph_layout_seed(spark, d):
    """Where a spring layout starts: on a spiral."""
    nodes = scope(spark, d).orderBy("id").limit(100).withColumnRenamed("id", "node")
    return G.spiral(nodes).select(F.col("node").alias("id"), "x", "y")


@query("SELECT entity_id, id, rank FROM (SELECT m.entity_id, e.id, row_number() OVER (PARTITION BY m.entity_id ORDER BY CASE WHEN e.id = m.entity_id THEN 0 ELSE 1 END, e.id)::INTEGER AS rank FROM (SELECT DISTINCT entity_id FROM {ment} WHERE entity_id % 10 = 0) m JOIN {ent} e ON e.kind = (SELECT kind FROM {ent} x WHERE x.id = m.entity_id)) WHERE rank <= 3")
def win_candidate_rank(spark, d):
    """Candidates an entity may be merged with: of its type, itself first, then by id, three at most."""
    e = kb.entities(spark, d).select("id", "kind")
    asked = kb.mentions(spark, d).where("entity_id % 10 = 0").select("entity_id").distinct().join(e.withColumnRenamed("id", "entity_id"), "entity_id")
    both = asked.join(e, "kind")
    return R.top_per(both, ["entity_id"], [F.asc(F.when(F.col("id") == F.col("entity_id"), 0).otherwise(1)), F.asc("id")], 3).select("entity_id", "id", "rank")


@query("SELECT id, degree, rank FROM (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id)::INTEGER AS rank FROM {deg}) WHERE rank <= 50")
def win_degree_rank(spark, d):
    g = G.degrees(scoped_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(50)
    return R.numbered(g, [F.desc("degree"), F.asc("node")], "rank").select(F.col("node").alias("id"), "degree", "rank")


@query("SELECT e.id, e.name, s.synthesis, s.summary, s.n_articles FROM {syn} s JOIN {ent} e ON e.id = s.entity_id WHERE e.id = (SELECT max(entity_id) FROM {syn})")
def wiki_entity_row(spark, d):
    """One entity's page: synthesis and entity."""
    last = kb.syntheses(spark, d).orderBy(F.desc("entity_id")).limit(1)
    return last.join(kb.entities(spark, d).select(F.col("id").alias("entity_id"), "name"), "entity_id").select(F.col("entity_id").alias("id"), "name", "synthesis", "summary", "n_articles")


@query("SELECT s.entity_id, s.summary FROM {syn} s JOIN {ent} e ON e.id = s.entity_id WHERE lower(e.name) = 'privacy' OR len(list_filter(coalesce(e.aliases, []), lambda x: contains(lower(x), 'an'))) > 0 ORDER BY CASE WHEN lower(e.name) = 'privacy' THEN 0 ELSE 1 END, coalesce(e.mention_count, 0) DESC, e.id LIMIT 1")
def kg_get_synthesis(spark, d):
    """The synthesis a name stands for: by the whole name, else by an alias; of several the most mentioned entity's."""
    e = kb.entities(spark, d)
    exact, alias = F.lower("name") == "privacy", F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(x).contains("an"))
    s = kb.syntheses(spark, d).join(e.withColumnRenamed("id", "entity_id").where(exact | alias), "entity_id")
    return s.orderBy(F.when(F.lower("name") == "privacy", 0).otherwise(1), F.desc(F.coalesce("mention_count", F.lit(0))), "entity_id").limit(1).select("entity_id", "summary")


@query("SELECT s.entity_id, s.n_articles, e.name FROM {syn} s JOIN {ent} e ON e.id = s.entity_id WHERE NOT s.stale AND s.n_articles >= 3 AND {wiki} ORDER BY s.n_articles DESC, e.name, e.id LIMIT 500")
def wiki_index(spark, d):
    fresh = kb.syntheses(spark, d).where("not stale and n_articles >= 3").join(kb.entities(spark, d).withColumnRenamed("id", "entity_id"), "entity_id")
    return fresh.where(G.wiki_entity(F.col("name"), F.col("kind"))).orderBy(F.desc("n_articles"), "name", "entity_id").limit(500).select("entity_id", "n_articles", "name")


@query("SELECT uid, row_number() OVER (ORDER BY pub_date DESC NULLS LAST, reg_date DESC NULLS LAST, title NULLS LAST, uid)::INTEGER AS position FROM {art} ORDER BY position LIMIT 200")
def wiki_all_sources(spark, d):
    """Articles in the order of their pages, a page of 200."""
    order = [F.desc_nulls_last("pub_date"), F.desc_nulls_last("reg_date"), F.asc_nulls_last("title"), F.asc("uid")]
    return R.numbered(kb.articles(spark, d).orderBy(*order).limit(200), order, "position").select("uid", "position")


@query("SELECT id, CASE WHEN trim(coalesce(primary_question, '')) = '' THEN '(not set)' ELSE trim(primary_question) END AS question, coalesce(lookback_days::VARCHAR, '(not set)') AS lookback FROM (SELECT id, min(primary_question) AS primary_question, min(lookback_days) AS lookback_days FROM workspaces GROUP BY id)")
def kg_prompt_vars(spark, d):
    from biblion.session import table

    w = table(spark, d, "workspaces").groupBy("id").agg(F.min("primary_question").alias("primary_question"), F.min("lookback_days").alias("lookback_days"))
    return w.select("id", T.or_not_set(F.col("primary_question")).alias("question"), T.or_not_set(F.col("lookback_days").cast("string")).alias("lookback"))


@query("SELECT uid, coalesce(nullif(trim(abstract_text), ''), nullif(trim(byline_summary), ''), nullif(trim(title), '')) AS text FROM {art}")
def fn_kg_text(spark, d):
    """What the graph is extracted from: the text, else the summary, else the title."""
    return kb.articles(spark, d).select("uid", T.first_present("abstract_text", "byline_summary", "title").alias("text"))
