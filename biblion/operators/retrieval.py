"""Retrieval: BM25, exact vector search, rank fusion, boosts and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from biblion.functions.text import chunk_type, present, token_windows
from biblion.operators.graph import wiki_entity
from biblion.session import checkpoint

K1, B = 1.2, 0.75
#: Terms that may be asked for at once.
MOST_TERMS = 10_000


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term``, key, ``tf`` and ``dl`` (the document's length in terms)."""
    words = docs.where(F.col(text).isNotNull()).select(key, terms(F.col(text)).alias("t"))
    return words.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, limit: int = 10) -> DataFrame:
    """Top documents per query: ``query_id``, key, ``score``, ``rank``.

    ``queries`` (query_id, query) are few, so their terms travel to the documents (at
    most ``MOST_TERMS``): one pass over the corpus counts each document's length and
    its asked terms, and only rows of documents that hold one are shuffled. The number
    of documents and their mean length come from the same pass. Ties go to the lesser
    key; NULL texts and queries match nothing; inverse frequencies of 0 and less count
    as 1e-6.
    """
    asked = queries.where("query is not null").select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    wanted = sorted(r.term for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect())
    if len(wanted) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms asked at once: ask in blocks")
    words = terms(F.col(text))
    held = F.filter(words, lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>")
    counted = checkpoint(docs.where(F.col(text).isNotNull()).select(key, F.size(words).alias("dl"), held.alias("held")))
    totals = counted.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    hits = counted.where(F.size("held") > 0).select(key, "dl", F.explode("held").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighted = df.join(F.broadcast(totals)).select("term", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(weighted), "term").join(F.broadcast(asked), "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    return top_per(scored, ["query_id"], [F.desc("score"), F.asc(key)], limit)


def top_per(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank`` from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, limit: int = 10, block: int = 2000) -> DataFrame:
    """Exact nearest vectors of every query: ``query_id``, key, ``similarity``, ``rank``.

    A stated set of query vectors (query_id, query_vector) is scored against all rows in
    one pass: a batch of rows times the queries, keeping the best ``limit`` of a batch
    for each query, so that few rows are shuffled. Up to ``block`` queries travel to the
    workers at once; more are asked block by block, and each block reads the rows anew.
    Vectors of another length than a query's, empty ones and zeros have similarity 0;
    ties go to the lesser key.
    """
    asked = queries.select("query_id", "query_vector").where("query_vector is not null")
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
    n = asked.count()
    if n == 0:
        return rows.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), key, F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")).limit(0)
    kind = queries.schema["query_id"].dataType.simpleString()
    out = None
    for at in range(0, n, block):
        some = asked.orderBy("query_id").offset(at).limit(block).collect()  # at most ``block`` vectors
        part = rows.mapInArrow(_scorer([r.query_id for r in some], [r.query_vector for r in some], to_arrow_type(queries.schema["query_id"].dataType), key, limit), f"query_id {kind}, `{key}` long, similarity double")
        out = part if out is None else out.unionByName(part)
    return top_per(out, ["query_id"], [F.desc("similarity"), F.asc(key)], limit)


def _scorer(ids: list, wanted: list, kind: pa.DataType, key: str, limit: int):
    """Best rows of every batch for each query, in double precision."""

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 1.2e-7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(v) for v in wanted])
        by_length = {n: (np.flatnonzero(lengths == n), unit(np.array([v for v in wanted if len(v) == n], np.float64).reshape(-1, n))) for n in set(lengths.tolist())}
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(1)
            sizes = np.asarray(pa.compute.list_value_length(held))
            sim = np.zeros((len(ids), batch.num_rows))
            for n, (at, q) in by_length.items():
                rows = np.flatnonzero(sizes == n)
                if n and len(rows):
                    flat = held.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    sim[np.ix_(at, rows)] = q @ unit(flat.reshape(-1, n)).T
            sim = np.round(sim, 6) + 0.0
            keys = batch.column(0).to_numpy()
            order = np.lexsort((np.broadcast_to(keys, sim.shape), -sim), axis=1)[:, :limit]
            flat = order.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids, object), order.shape[1]).tolist(), kind), pa.array(keys[flat], pa.int64()), pa.array(np.take_along_axis(sim, order, 1).reshape(-1))],
                names=["query_id", key, "similarity"],
            )

    return run


def reciprocal_rank_fusion(ranked: DataFrame, by: list[str], list_id: str, key: str, k: int = 60, limit: int = 10) -> DataFrame:
    """Fuse ranked lists (``rank`` from 1): score = sum of 1/(k + rank); ties go to the lesser key."""
    fused = ranked.groupBy(*by, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count_distinct(list_id).alias("n_lists"))
    return top_per(fused, by, [F.desc("score"), F.asc(key)], limit)


def budget(df: DataFrame, by: list[str], order: list[Column], size: Column, most: int, keep_first: bool = False) -> DataFrame:
    """The longest prefix of each group whose sizes add up to ``most`` at most."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("used", F.sum(size).over(run)).withColumn("position", F.row_number().over(w))
    fits = F.col("used") <= most
    return out.where(fits | (F.col("position") == 1) if keep_first else fits)


def graph_boost(hits: DataFrame, related: DataFrame, key: str, score: str, factor: float = 1.2, first: bool = True) -> DataFrame:
    """Raise hits on related rows by ``factor``; with ``first`` they also precede all others."""
    marks = related.select(key).distinct().withColumn("boosted", F.lit(True))
    out = hits.join(marks, key, "left").withColumn("boosted", F.coalesce("boosted", F.lit(False)))
    out = out.withColumn(score, F.when(F.col("boosted"), F.round(F.col(score) * factor, 6)).otherwise(F.col(score)))
    return top_per(out.drop("rank"), ["query_id"], [*([F.desc("boosted")] if first else []), F.desc(score), F.asc(key)], 1 << 30)


def hydrated(hits: DataFrame, chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Hits (``chunk_id``) with their chunk's and article's columns; hits whose chunk or article is gone are dropped."""
    c = chunks.select(F.col("id").alias("chunk_id"), "article_uid", F.coalesce("chunk_type", F.lit("body")).alias("chunk_type"), F.coalesce("content", F.lit("")).alias("content"), "source_page", "source_section")
    a = articles.select(F.col("uid").alias("article_uid"), "title", "first_author", "pub_date", "url")
    return hits.join(c, "chunk_id").join(a, "article_uid")


def fetched(ranked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the ranked keys in their order (``rank``); keys without a row are dropped."""
    return ranked.join(rows, key)


def numbered(df: DataFrame, order: list[Column], name: str = "no") -> DataFrame:
    """Numbers from 1 for a bounded list (a page, the head of a ranking)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def widened(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Queries followed by the passage written for them (query_id, passage); those without one stay as they are."""
    text = F.when(present(F.col("passage")).isNotNull(), F.concat("query", F.lit("\n\n"), "passage")).otherwise(F.col("query"))
    return queries.join(passages.select("query_id", "passage"), "query_id", "left").select("query_id", text.alias("query"))


def related_articles(queries: DataFrame, entities: DataFrame, mentions: DataFrame, most: int = 5) -> DataFrame:
    """``query_id``, ``article_uid``: articles that mention one of the ``most`` entities whose names hold a word of the query.

    Words of three letters or fewer name nothing. Queries are few and travel to the
    entities; of those that fit the most mentioned count, the lesser id on ties.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).where(F.length("term") > 3)
    fit = entities.join(F.broadcast(words), F.lower("name").contains(F.col("term"))).select("query_id", F.col("id").alias("entity_id"), "mention_count").distinct()
    best = top_per(fit, ["query_id"], [F.desc(F.coalesce("mention_count", F.lit(0))), F.asc("entity_id")], most)
    return mentions.join(F.broadcast(best.select("query_id", "entity_id")), "entity_id").select("query_id", "article_uid").distinct()


def raised(hits: DataFrame, related: DataFrame, key: str, score: str, factor: float, first: bool, limit: int) -> DataFrame:
    """Hits of related articles (query_id, article_uid) raised by ``factor``; with ``first`` they precede all others."""
    marks = related.withColumn("boosted", F.lit(True))
    out = hits.drop("rank").join(marks, ["query_id", "article_uid"], "left").withColumn("boosted", F.coalesce("boosted", F.lit(False)))
    out = out.withColumn(score, F.round(F.when(F.col("boosted"), F.col(score) * factor).otherwise(F.col(score)), 6))
    return top_per(out, ["query_id"], [*([F.desc("boosted")] if first else []), F.desc(score), F.asc(key)], limit)


def search_syntheses(queries: DataFrame, syntheses: DataFrame, entities: DataFrame, limit: int, fetch: int = 100, least: int = 3) -> DataFrame:
    """Syntheses by their words: the best ``fetch`` of each query, of which those of wiki entities with ``least`` articles are kept."""
    body = syntheses.select("entity_id", F.concat_ws(" ", "synthesis", "summary").alias("body"))
    found = bm25(body, queries, "entity_id", "body", fetch)
    e = entities.where(wiki_entity(F.col("name"), F.col("kind"))).select(F.col("id").alias("entity_id"), "name", "kind")
    known = syntheses.where(F.coalesce("n_articles", F.lit(0)) >= least).select("entity_id", "n_articles", "stale", "summary")
    return top_per(found.drop("rank").join(e, "entity_id").join(known, "entity_id"), ["query_id"], [F.desc("score"), F.asc("entity_id")], limit)


def numbered_context(hits: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first hits of each group as one text: ``[1] author: content``, a blank line between."""
    head = top_per(hits.withColumnRenamed(order, "__order"), [by], [F.asc("__order")], most)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(present(F.col("first_author")), F.lit("Unknown")), F.lit(": "), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))  # at most ``most``
    return head.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("context"))


def chunk_articles(texts: DataFrame, size: int = 512, shared: int = 64, most: int = 100) -> DataFrame:
    """Chunks of articles (uid, full_text, sections): section by section, else the whole text as section 0; ``most`` an article."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("full_text").alias("content")))
    has = F.coalesce(F.size("sections"), F.lit(0)) > 0
    parts = texts.select("uid", has.alias("has"), F.posexplode(F.when(has, F.transform("sections", lambda s: F.struct(s["title"].alias("title"), s["content"].alias("content")))).otherwise(whole)).alias("pos", "part"))
    cut = parts.where("part.content is not null").select(
        "uid", F.when(F.col("has"), F.col("pos") + 1).otherwise(0).alias("section_no"), F.col("part.title").alias("source_section"), F.posexplode(token_windows(F.col("part.content"), size, shared)).alias("at", "content")
    )
    w = Window.partitionBy("uid").orderBy("section_no", "at")
    return cut.withColumn("chunk_index", F.row_number().over(w) - 1).where(F.col("chunk_index") < most).withColumn("chunk_type", chunk_type(F.col("source_section"))).drop("at")


def toggled(column: str, descending: bool) -> list[Column]:
    """The order of a page by one of its columns; blanks come last either way."""
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)]
