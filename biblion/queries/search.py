"""Retrieval end to end: chunks in tokens, hits joined to chunks and articles, fused and raised lists, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import graph as G
from biblion.operators import retrieval as R
from biblion.queries import kb
from biblion.session import table

query = kb.Registry()
QUERIES, ORACLE = query.queries, query.oracle
#: Searches (query_id, text); the vector of a search is that of chunk 1 + 100 x its id.
SEARCHES = [(1, "alert fatigue equity"), (2, "consent dashboard trust"), (3, "readmission score stroke"), (4, "privacy of patient diaries")]
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in SEARCHES)
_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def bm25_sql(docs: str, key: str, text: str, searches: str, limit: int) -> str:
    """CTEs ``kw``: top ``limit`` of ``docs`` for each search by BM25."""
    terms = _TERMS.replace("{0}", text)
    return f"""
d AS (SELECT {key} AS k, {terms} AS ts FROM {docs} WHERE {text} IS NOT NULL),
l AS (SELECT k, len(ts) AS dl FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM d) GROUP BY 1, 2),
a AS (SELECT DISTINCT query_id, unnest({_TERMS.replace('{0}', 'query')}) AS term FROM {searches}),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
x AS (SELECT a.query_id, p.k, round(sum(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))), 6) AS score FROM a JOIN p USING (term) JOIN f USING (term) JOIN l ON l.k = p.k CROSS JOIN s GROUP BY 1, 2),
kw AS (SELECT query_id, k, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) AS rank FROM x) WHERE rank <= {limit})"""


_SEARCH = f"q AS (SELECT * FROM (VALUES {_VALUES}) v(query_id, query))"
_KNN = """
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT q.query_id, b.chunk_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM q JOIN {vec} a ON a.chunk_id = 1 + 100 * q.query_id CROSS JOIN {vec} b)) WHERE rank <= 30)"""


def searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id int, query string")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    v = kb.vectors(spark, d)
    return searches(spark).join(v, F.col("chunk_id") == 1 + 100 * F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"))


def _near(spark: SparkSession, d: str, limit: int = 30) -> DataFrame:
    return R.knn(kb.vectors(spark, d), _asked(spark, d), "chunk_id", "embedding", limit)


def _words(spark: SparkSession, d: str, limit: int = 30) -> DataFrame:
    return R.bm25(kb.chunks(spark, d).withColumnRenamed("id", "chunk_id"), searches(spark), "chunk_id", "content", limit)


@query(r"""WITH t AS (SELECT id, regexp_extract_all(content, '\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])|\s+') AS ts FROM {chunk} WHERE content IS NOT NULL),
w AS (SELECT id, ts, unnest(generate_series(0, greatest(len(ts) - 1, 0), 112)) AS st FROM t WHERE len(ts) > 0),
k AS (SELECT id, st, array_to_string(ts[st + 1 : st + 128], '') AS c FROM w WHERE st = 0 OR st - 112 + 128 < len(ts)),
u AS (SELECT id, st, CASE WHEN strlen(c) < 20 THEN c WHEN contains(c, '.') AND length(c) - instr(reverse(c), '.') + 1 > length(c) / 2 THEN trim(left(c, length(c) - instr(reverse(c), '.') + 1)) WHEN contains(c, '?') AND length(c) - instr(reverse(c), '?') + 1 > length(c) / 2 THEN trim(left(c, length(c) - instr(reverse(c), '?') + 1)) WHEN contains(c, '!') AND length(c) - instr(reverse(c), '!') + 1 > length(c) / 2 THEN trim(left(c, length(c) - instr(reverse(c), '!') + 1)) ELSE trim(c) END AS content FROM k)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY st) - 1 AS chunk_index, content, len(regexp_extract_all(content, '\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])|\s+')) AS n_tokens FROM u WHERE trim(content) <> ''""")
def fn_chunk_tokens(spark, d):
    """Chunks of 128 tokens that overlap by 16, each cut back to its last sentence (texts of the chunk table)."""
    c = kb.chunks(spark, d).where("content is not null").select("id", F.posexplode(T.token_windows(F.col("content"), 128, 16)).alias("chunk_index", "content"))
    return c.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.size(T.pieces(F.col("content"))).cast("long").alias("n_tokens"))


@query("""WITH x AS (SELECT uid, min(full_text) AS full_text, any_value(sections) AS sections FROM extracted_text GROUP BY uid),
s AS (SELECT uid, 0 AS pos, NULL AS title, full_text AS content FROM x WHERE coalesce(len(sections), 0) = 0 UNION ALL
SELECT uid, pos, sec.title, sec.content FROM (SELECT uid, unnest(sections) AS sec, unnest(generate_series(1, len(sections))) AS pos FROM x WHERE len(sections) > 0)),
t AS (SELECT uid, pos, title, regexp_extract_all(content, '\\s*(?:[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_])|\\s+') AS ts FROM s WHERE content IS NOT NULL),
w AS (SELECT uid, pos, title, ts, unnest(generate_series(0, greatest(len(ts) - 1, 0), 448)) AS st FROM t WHERE len(ts) > 0)
SELECT uid, least(count(*), 100) AS n_chunks, count(DISTINCT pos) AS n_sections FROM w WHERE st = 0 OR st - 448 + 512 < len(ts) GROUP BY uid""")
def fn_chunk_sections(spark, d):
    """Chunks of whole articles (512 tokens, 64 shared): section by section, at most 100 an article."""
    x = table(spark, d, "extracted_text").groupBy("uid").agg(F.min("full_text").alias("full_text"), F.any_value("sections").alias("sections"))
    c = R.chunk_articles(x)
    return c.groupBy("uid").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("section_no").alias("n_sections"))


@query(f"WITH {_SEARCH}, {_KNN} SELECT nn.query_id, nn.chunk_id, nn.similarity, nn.rank::INTEGER AS rank, c.article_uid, coalesce(c.chunk_type, 'body') AS chunk_type, c.source_section, a.title, a.first_author, a.pub_date, a.url FROM nn JOIN {{chunk}} c ON c.id = nn.chunk_id JOIN {{art}} a ON a.uid = c.article_uid WHERE nn.rank <= 10")
def join_hits_chunk_article(spark, d):
    hits = R.hydrated(_near(spark, d, 10), kb.chunks(spark, d), kb.articles(spark, d))
    return hits.select("query_id", "chunk_id", "similarity", "rank", "article_uid", "chunk_type", "source_section", "title", "first_author", "pub_date", "url")


_FUSED = f"WITH {_SEARCH}, {_KNN}, {bm25_sql('{chunk}', 'id', 'content', 'q', 30)}, two AS (SELECT query_id, chunk_id, rank FROM nn UNION ALL SELECT query_id, k, rank FROM kw), fz AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_lists FROM two GROUP BY 1, 2), fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM fz) WHERE rank <= 10)"


def fused(spark: SparkSession, d: str, limit: int = 10) -> DataFrame:
    near = _near(spark, d).select("query_id", "chunk_id", "rank", F.lit("vectors").alias("list_id"))
    words = _words(spark, d).select("query_id", "chunk_id", "rank", F.lit("words").alias("list_id"))
    return R.reciprocal_rank_fusion(near.unionByName(words), ["query_id"], "list_id", "chunk_id", 60, limit)


@query(_FUSED + " SELECT fr.query_id, fr.chunk_id, fr.score, fr.n_lists, fr.rank, c.article_uid, a.title FROM fr JOIN {chunk} c ON c.id = fr.chunk_id JOIN {art} a ON a.uid = c.article_uid")
def q_hybrid(spark, d):
    """Vectors and words, thirty of each, fused by rank; the best ten with their chunks and articles."""
    hits = R.hydrated(fused(spark, d), kb.chunks(spark, d), kb.articles(spark, d))
    return hits.select("query_id", "chunk_id", "score", "n_lists", "rank", "article_uid", "title")


@query(_FUSED + " SELECT fr.query_id, fr.chunk_id, fr.score, fr.n_lists, fr.rank, c.article_uid, a.title FROM fr JOIN {chunk} c ON c.id = fr.chunk_id JOIN {art} a ON a.uid = c.article_uid")
def q_hybrid_rerank(spark, d):
    """The reranking mode ranks as the fused one does."""
    return q_hybrid(spark, d)


@query(_FUSED + " SELECT fr.query_id, fr.chunk_id, c.content, fr.rank FROM fr JOIN {chunk} c ON c.id = fr.chunk_id WHERE c.embedded")
def join_fetch_by_ids(spark, d):
    """Rows fetched by their ids keep the fused order; ids that are gone (here: never embedded) are dropped."""
    kept = kb.chunks(spark, d).where("embedded").select(F.col("id").alias("chunk_id"), "content")
    return R.fetched(fused(spark, d).select("query_id", "chunk_id", "rank"), kept, "chunk_id").select("query_id", "chunk_id", "content", "rank")


@query(f"WITH {_SEARCH}, v AS (SELECT query_id, query || chr(10) || chr(10) || p AS query FROM q JOIN (SELECT row_number() OVER (ORDER BY doc_id) AS query_id, text AS p FROM (SELECT doc_id, text FROM documents WHERE source = 'hyde_passage' ORDER BY doc_id LIMIT 3)) h USING (query_id) UNION ALL SELECT query_id, query FROM q WHERE query_id = 4), {bm25_sql('{chunk}', 'id', 'content', 'v', 10)} SELECT query_id, k AS chunk_id, score, rank::INTEGER AS rank FROM kw")
def q_hyde(spark, d):
    """Searches widened by a passage written for them; the one that got none is asked as it stands."""
    docs = table(spark, d, "documents").where("source = 'hyde_passage'").orderBy("doc_id").limit(3)
    passages = R.numbered(docs, [F.asc("doc_id")], "query_id").select(F.col("query_id").cast("int").alias("query_id"), F.col("text").alias("passage"))
    asked = R.widened(searches(spark), passages)
    return R.bm25(kb.chunks(spark, d).withColumnRenamed("id", "chunk_id"), asked, "chunk_id", "content", 10)


@query("WITH d AS (SELECT id, " + _TERMS.replace("{0}", "content") + " AS ts FROM {chunk} WHERE content IS NOT NULL) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(ts) AS term FROM d) GROUP BY 1")
def q_rebuild_fts(spark, d):
    """The full-text index built anew: documents and occurrences of every term."""
    p = R.postings(kb.chunks(spark, d), "id", "content")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_RELATED = f"""WITH {_SEARCH}, {_KNN},
kwd AS (SELECT DISTINCT query_id, unnest({_TERMS.replace('{0}', 'query')}) AS term FROM q),
me AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(mention_count, 0) DESC, id) AS r FROM (SELECT DISTINCT query_id, e.id, e.mention_count FROM kwd JOIN {{ent}} e ON length(term) > 3 AND contains(lower(e.name), term))) WHERE r <= 5),
ra AS (SELECT DISTINCT query_id, article_uid FROM me JOIN {{ment}} m ON m.entity_id = me.id),
h AS (SELECT nn.query_id, nn.chunk_id, nn.similarity, ra.article_uid IS NOT NULL AS boosted FROM nn JOIN {{chunk}} c ON c.id = nn.chunk_id LEFT JOIN ra ON ra.query_id = nn.query_id AND ra.article_uid = c.article_uid WHERE nn.rank <= 20)"""


def _related(spark: SparkSession, d: str) -> DataFrame:
    """``query_id``, ``article_uid``: articles that mention one of the five entities a search's words fit best."""
    return R.related_articles(searches(spark), kb.entities(spark, d), kb.mentions(spark, d))


@query(_RELATED + " SELECT query_id, chunk_id, score, boosted, rank FROM (SELECT query_id, chunk_id, round(CASE WHEN boosted THEN similarity * 1.2 ELSE similarity END, 6) AS score, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, round(CASE WHEN boosted THEN similarity * 1.2 ELSE similarity END, 6) DESC, chunk_id)::INTEGER AS rank FROM h) WHERE rank <= 10")
def q_graph(spark, d):
    """Hits from articles that mention the entities a search names are raised and come first."""
    hits = _near(spark, d, 20).join(kb.chunks(spark, d).select(F.col("id").alias("chunk_id"), "article_uid"), "chunk_id")
    return R.raised(hits, _related(spark, d), "chunk_id", "similarity", 1.2, first=True, limit=10).select("query_id", "chunk_id", F.col("similarity").alias("score"), "boosted", "rank")


@query(_RELATED + " SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, round(CASE WHEN boosted THEN similarity * 2.0 ELSE similarity END, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN boosted THEN similarity * 2.0 ELSE similarity END, 6) DESC, chunk_id)::INTEGER AS rank FROM h) WHERE rank <= 10")
def q_graph_boost_simple(spark, d):
    hits = _near(spark, d, 20).join(kb.chunks(spark, d).select(F.col("id").alias("chunk_id"), "article_uid"), "chunk_id")
    return R.raised(hits, _related(spark, d), "chunk_id", "similarity", 2.0, first=False, limit=10).select("query_id", "chunk_id", F.col("similarity").alias("score"), "rank")


@query(f"WITH {_SEARCH}, sd AS (SELECT entity_id, synthesis || ' ' || summary AS body FROM {{syn}}), {bm25_sql('sd', 'entity_id', 'body', 'q', 100)} SELECT query_id, k AS entity_id, e.name, s.n_articles, s.stale, score FROM kw JOIN {{ent}} e ON e.id = kw.k JOIN {{syn}} s ON s.entity_id = kw.k WHERE s.n_articles >= 3 AND {{wiki}} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) <= 10")
def q_syntheses_search(spark, d):
    """Syntheses that fit, of entities with a wiki page and three articles or more."""
    return R.search_syntheses(searches(spark), kb.syntheses(spark, d), kb.entities(spark, d), 10).select("query_id", "entity_id", "name", "n_articles", "stale", "score")


@query(f"WITH {_SEARCH}, {_KNN} SELECT query_id, chunk_id, similarity, rank::INTEGER AS rank FROM nn WHERE rank <= 10")
def srt_knn(spark, d):
    return _near(spark, d, 10)


@query(f"WITH {_SEARCH}, {bm25_sql('{chunk}', 'id', 'content', 'q', 10)} SELECT query_id, k AS chunk_id, score, rank::INTEGER AS rank FROM kw")
def srt_bm25(spark, d):
    return _words(spark, d, 10)


@query(f"WITH {_SEARCH}, {_KNN} SELECT query_id, chunk_id, round(1 - (1 - similarity), 6) AS similarity FROM nn")
def fn_sim_from_distance(spark, d):
    near = _near(spark, d).withColumn("distance", 1 - F.col("similarity"))
    return near.select("query_id", "chunk_id", F.round(T.similarity_of(F.col("distance")), 6).alias("similarity"))


@query(_FUSED + " SELECT query_id, string_agg('[' || r || '] ' || coalesce(nullif(trim(first_author), ''), 'Unknown') || ': ' || content, chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT fr.query_id, a.first_author, c.content, row_number() OVER (PARTITION BY fr.query_id ORDER BY fr.rank) AS r FROM fr JOIN {chunk} c ON c.id = fr.chunk_id JOIN {art} a ON a.uid = c.article_uid) WHERE r <= 5 GROUP BY 1")
def win_list_order(spark, d):
    """The five best hits as one numbered text."""
    hits = R.hydrated(fused(spark, d), kb.chunks(spark, d), kb.articles(spark, d))
    return R.numbered_context(hits, "query_id", "rank", 5)


@query("""WITH c AS (SELECT article_uid, id, row_number() OVER (PARTITION BY article_uid ORDER BY chunk_index, id) AS position, sum(coalesce(token_count, 0)) OVER (PARTITION BY article_uid ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM {chunk}) SELECT article_uid, id, used FROM c WHERE used <= 400 OR position = 1""")
def win_token_budget(spark, d):
    size = F.coalesce("token_count", F.lit(0))
    return R.budget(kb.chunks(spark, d), ["article_uid"], [F.asc("chunk_index"), F.asc("id")], size, 400, keep_first=True).select("article_uid", "id", F.col("used").cast("long").alias("used"))


@query("SELECT uid, array_to_string(list_slice(ts, 1, 3), ', ') || CASE WHEN len(ts) > 3 THEN ', +' || (len(ts) - 3)::VARCHAR || ' more' ELSE '' END AS shown FROM (SELECT uid, " + _TERMS.replace("{0}", "title") + " AS ts FROM {art} WHERE title IS NOT NULL)")
def fn_context_text(spark, d):
    """The first terms of a list and how many more there are."""
    return kb.articles(spark, d).where("title is not null").select("uid", T.query_preview(R.terms(F.col("title")), 3).alias("shown"))


@query(f"WITH n AS (SELECT (v.chunk_id * 7) % {{n}} + 1 AS entity_id, v.v, v.label FROM {{vec}} v) SELECT e.id, count(*) AS n_vectors FROM {{ent}} e JOIN n ON n.entity_id = e.id AND lower(e.kind) = lower(CASE WHEN n.label::INTEGER % 2 = 0 THEN e.kind ELSE 'CONCEPT' END) GROUP BY 1")
def join_entity_vec(spark, d):
    """Entities with the vectors of their type, whatever the case of the type."""
    n = table(spark, d, "kg_entities").agg(F.max("id").alias("n"))
    v = kb.vectors(spark, d).join(F.broadcast(n)).select((F.pmod(F.col("chunk_id") * 7, F.col("n")) + 1).alias("id"), "label")
    e = kb.entities(spark, d)
    v = v.join(e.select("id", F.col("kind").alias("own")), "id").select("id", F.when(F.col("label").cast("int") % 2 == 0, F.lower("own")).otherwise("Concept").alias("type"))
    return G.with_vectors(e, v).groupBy("id").agg(F.count(F.lit(1)).alias("n_vectors"))
