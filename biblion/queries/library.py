"""Retrieval over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.functions.text import chunk_reference, cosine, match_query
from biblion.operators import retrieval as R
from biblion.operators.resolution import resolve_vectors
from biblion.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Searches of the registered queries: (query_id, query).
SEARCHES = [(1, "alert fatigue equity"), (2, "consent dashboard"), (3, "readmission score stroke"), (4, "privacy of patient diaries")]
#: Vectors asked for: each whose id is divisible by 100.
ASKED = "vec_id % 100 = 0"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id int, query string")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


_TERM = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in SEARCHES)
_BM25 = f"""
WITH q AS (SELECT * FROM (VALUES {_VALUES}) v(query_id, query)),
d AS (SELECT doc_id, {_TERM.format('text')} AS ts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, len(ts) AS dl FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY 1, 2),
a AS (SELECT DISTINCT query_id, unnest({_TERM.format('query')}) AS term FROM q),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
x AS (SELECT a.query_id, p.doc_id, round(sum(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))), 6) AS score
  FROM a JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc_id = p.doc_id CROSS JOIN s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x)
"""


@query(_BM25 + "SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def q_keyword(spark, d):
    return R.bm25(_docs(spark, d), _searches(spark), "doc_id", "text", 10)


_COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"
_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_KNN = f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS.format('a.v', 'b.v')}, 6) AS similarity FROM {_V} a, {_V} b WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
"""


def _asked(spark, d):
    v = table(spark, d, "embeddings").where(ASKED)
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(_KNN + "SELECT query_id, vec_id, similarity, rank::INTEGER AS rank FROM k WHERE rank <= 10")
def q_semantic(spark, d):
    return R.knn(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "embedding", 10)


def _two_lists(spark, d):
    """Vector hits and label hits of each asked vector as two ranked lists."""
    near = R.knn(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "embedding", 30).select("query_id", "vec_id", "rank", F.lit("semantic").alias("list_id"))
    e = table(spark, d, "embeddings").select("vec_id", "label")
    asked = e.where(ASKED).select(F.col("vec_id").alias("query_id"), "label")
    same = R.top_per(e.join(F.broadcast(asked), "label"), ["query_id"], [F.asc("vec_id")], 30).select("query_id", "vec_id", "rank", F.lit("label").alias("list_id"))
    return near.unionByName(same)


_LISTS = _KNN + f""", two AS (SELECT query_id, vec_id, rank, 'semantic' AS list_id FROM k WHERE rank <= 30 UNION ALL
SELECT query_id, vec_id, rank, 'label' FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0) WHERE rank <= 30),
fz AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE/(60+rank)), 9) AS score, count(DISTINCT list_id) AS n_lists FROM two GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fz)
"""


@query(_BM25 + ", fz AS (SELECT doc_id, round(sum(1.0::DOUBLE/(60+rank)), 9) AS score, count(*) AS n_lists FROM r WHERE rank <= 30 GROUP BY 1) SELECT doc_id, score, n_lists FROM fz ORDER BY score DESC, doc_id LIMIT 10")
def q_multi_query(spark, d):
    """Variants of one question fused: the searches are the variants."""
    ranked = R.bm25(_docs(spark, d), _searches(spark), "doc_id", "text", 30).withColumn("one", F.lit(1))
    return R.reciprocal_rank_fusion(ranked, ["one"], "query_id", "doc_id", 60, 10).select("doc_id", "score", "n_lists")


@query(_BM25 + """, c AS (SELECT r.query_id, r.doc_id, r.rank, strlen(d.text) // 4 AS size FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= 5),
u AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM c)
SELECT query_id, doc_id, rank::INTEGER AS rank, used::BIGINT AS used FROM u WHERE used <= 600 OR rank = 1""")
def q_context(spark, d):
    """Numbered context of the best hits within a budget of tokens (bytes by four); the first always fits."""
    hits = R.bm25(_docs(spark, d), _searches(spark), "doc_id", "text", 5)
    sized = hits.join(_docs(spark, d), "doc_id").withColumn("size", F.floor(F.octet_length("text") / 4))
    return R.budget(sized, ["query_id"], [F.asc("rank")], F.col("size"), 600, keep_first=True).select("query_id", "doc_id", "rank", F.col("used").cast("long").alias("used"))


@query("""SELECT article_uid, id, used FROM (SELECT article_uid, id, chunk_index, sum(strlen(content)) OVER (PARTITION BY article_uid ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM (SELECT DISTINCT article_uid, id, chunk_index, content FROM article_chunks)) WHERE used <= 6000""")
def win_char_budget(spark, d):
    c = table(spark, d, "article_chunks").select("article_uid", "id", "chunk_index", "content").distinct()
    return R.budget(c, ["article_uid"], [F.asc("chunk_index"), F.asc("id")], F.octet_length("content"), 6000).select("article_uid", "id", F.col("used").cast("long").alias("used"))


@query(_LISTS + "SELECT query_id, count(*) AS n, round(sum(score), 6) AS total FROM fz GROUP BY 1")
def win_rrf(spark, d):
    fused = R.reciprocal_rank_fusion(_two_lists(spark, d), ["query_id"], "list_id", "vec_id", 60, 1 << 30)
    return fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query(f"SELECT a.vec_id, round({_COS.format('a.v', 'b.v')}, 6) AS similarity FROM {_V} a JOIN {_V} b ON b.vec_id = a.vec_id + 1")
def fn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT DISTINCT id, coalesce('Page ' || source_page::VARCHAR, 'Section: ' || nullif(trim(source_section), ''), chunk_type) AS reference FROM article_chunks")
def fn_chunk_ref(spark, d):
    return table(spark, d, "article_chunks").select("id", chunk_reference(F.col("source_page"), F.col("source_section"), F.col("chunk_type")).alias("reference")).distinct()
