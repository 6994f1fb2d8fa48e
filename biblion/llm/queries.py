"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblion.llm import matching, mixing, names, packing, pairs, residue, scans, splitting
from biblion.session import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.template_residue(table(spark, sf_dir, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each source without residue."""
    kept = residue.without_residue(table(spark, sf_dir, "documents"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def _scanned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name).select("uid", "full_text") for name in ("article_input", "extracted_text")}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(_scanned(spark, sf_dir))[0]


def p1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair_texts(_scanned(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "prompt_traces"), table(spark, sf_dir, "documents"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "split_limits")
    chunks = splitting.split_items(table(spark, sf_dir, "article_chunks"), "id", "content", "source_section", limits, "article_chunks")
    articles = splitting.split_items(table(spark, sf_dir, "article_input"), "uid", "full_text", None, limits, "article_input")
    return chunks.unionByName(articles)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(p3_pieces(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(table(spark, sf_dir, "kg_entities"), table(spark, sf_dir, "haie_rev"))


def p6_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_records(table(spark, sf_dir, "article_candidate"), table(spark, sf_dir, "haie_rev"), table(spark, sf_dir, "source_zones"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_match(spark, sf_dir).select("cand_uid", "uid")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_pack(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: items, their characters without overlaps, and pieces above the limit (none)."""
    limits = table(spark, sf_dir, "split_limits").select("item_table", "max_chars")
    pieces = p3_pieces(spark, sf_dir).join(F.broadcast(limits), "item_table")
    before = F.lag("end").over(Window.partitionBy("item_table", "item_key").orderBy("piece_no"))
    own = pieces.withColumn("own", F.col("end") - F.coalesce(before, F.lit(0)))
    per_item = own.groupBy("item_table", "item_key").agg(F.sum("own").alias("n"), F.sum((F.length("content") > F.col("max_chars")).cast("long")).alias("over"))
    return per_item.groupBy("item_table").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_chars"), F.sum("over").alias("n_over"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: documents placed, containers above their capacity (none), documents cut that would have fitted (none)."""
    caps = F.broadcast(table(spark, sf_dir, "pack_capacity").groupBy("container_kind").agg(F.max("capacity_tokens").alias("cap")))
    placed = p8_pack(spark, sf_dir).join(caps, "container_kind")
    docs = placed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max("cap").alias("cap"))
    full = placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.max("cap").alias("cap"))
    a = docs.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= F.col("cap"))).cast("long")).alias("n_cut"))
    return a.join(full.groupBy("container_kind").agg(F.sum((F.col("n") > F.col("cap")).cast("long")).alias("n_over")), "container_kind")


def p9_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its target, and whether a document was taken more often than it may be (never)."""
    mixed, _ = mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    most = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    targets = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats")
    return targets.join(most, "source", "left").select("source", F.round("target_share", 6).alias("target_share"), (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("too_often"))


QUERIES = {
    "p3_totals": p3_totals,
    "p8_totals": p8_totals,
    "p9_totals": p9_totals,
    "p1_found": p1_found,
    "p1_repair": p1_repair,
    "p2_found": p2_found,
    "p3_pieces": p3_pieces,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_match": p6_match,
    "p6_found": p6_found,
    "p8_pack": p8_pack,
    "p8_report": p8_report,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_clean": p10_clean,
}
ORACLE: dict[str, str] = {
    "p3_totals": "SELECT item_table, count(*) AS n_items, sum(n)::BIGINT AS n_chars, 0::BIGINT AS n_over FROM (SELECT 'article_chunks' AS item_table, length(max(content)) AS n FROM article_chunks WHERE content IS NOT NULL AND id IS NOT NULL GROUP BY id UNION ALL SELECT 'article_input', length(max(full_text)) FROM article_input WHERE full_text IS NOT NULL AND uid IS NOT NULL GROUP BY uid) GROUP BY 1",
    "p8_totals": "SELECT container_kind, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_docs, 0::BIGINT AS n_cut, 0::BIGINT AS n_over FROM pack_capacity",
    "p9_totals": "SELECT source, round(target_share, 6) AS target_share, false AS too_often FROM mix_targets",
}
