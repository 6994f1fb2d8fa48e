"""Problem 9: mixing sources to target shares by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish time is the
source's tokens up to and with it, divided by the source's share; the mix is all copies
in order of finish time up to the budget, so every source keeps its share in every
prefix of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblion.llm.tokens import with_token_counts
from biblion.session import checkpoint


def _shares(targets: DataFrame) -> DataFrame:
    return targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats")
    )


def cut_time(shares: list[tuple[float, float]], budget: float | None) -> float:
    """Virtual time at which the mix ends; ``shares`` holds (share, most tokens) of every source.

    Without budget: when the first source has given all it may, so that all shares
    hold. With one: when the sources have given ``budget`` tokens together, those that
    run dry earlier staying at their most.
    """
    alive = [(most / share, share, most) for share, most in shares if most > 0]
    if not alive:
        return 0.0
    if budget is None:
        return min(end for end, _, _ in alive)
    given, rate, at = 0.0, sum(share for _, share, _ in alive), 0.0
    for end, share, _ in sorted(alive):
        if given + (end - at) * rate >= budget:
            return at + (budget - given) / rate
        given += (end - at) * rate
        rate -= share
        at = end
    return at


def mix_sources(
    docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, tokenizer: str | None = None, buckets: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``source``, ``doc_id``, ``copy`` (from 0), ``n_tokens``, ``finish_time``, range
    partitioned and sorted by finish time. Report: one row per listed source with its
    target share, documents, tokens there are, tokens taken, actual share and repeats
    begun.

    Without ``budget`` the mix is the largest in which every listed source that has
    documents keeps its share (shares of sources without documents go to the others in
    proportion, and their actual share is 0). Sources that aren't listed, NULL sources,
    and texts without tokens take no part. A source listed twice counts with its
    largest entries.
    """
    listed = F.broadcast(_shares(targets))
    own = docs.join(listed, "source", "left_semi")
    sized = with_token_counts(own, ["doc_id", "source"], tokenizer=tokenizer).where("n_tokens > 0")
    # The shuffle: a hash of the id; equal ids are told apart by their order alone.
    drawn = F.xxhash64(F.col("doc_id"), F.lit(seed))
    sized = checkpoint(sized.withColumn("draw", drawn).withColumn("bucket", F.pmod(drawn, F.lit(buckets)).cast("int")))

    # Prefix sums in two steps, so that no task holds a source: whole buckets first.
    totals = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    stock = sized.groupBy("source").agg(F.sum("n_tokens").alias("stock"), F.count(F.lit(1)).alias("n_docs"))
    supply = _shares(targets).join(stock, "source", "left").fillna({"stock": 0, "n_docs": 0})
    rows = supply.collect()  # a row per listed source
    end = cut_time([(r.target_share, float(r.stock * r.max_repeats)) for r in rows], budget)

    queued = (
        sized.join(offsets, ["source", "bucket"])
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
        .join(F.broadcast(supply), "source")
    )
    needed = F.least(F.col("max_repeats"), F.ceil(F.lit(end) * F.col("target_share") / F.col("stock")))
    copies = F.sequence(F.lit(0).cast("long"), F.greatest(needed - 1, F.lit(0)).cast("long"))
    mix = (
        queued.select("source", "doc_id", "n_tokens", "upto", "stock", "target_share", F.explode(copies).alias("copy"))
        .withColumn("finish_time", (F.col("copy") * F.col("stock") + F.col("upto")) / F.col("target_share"))
        .where(F.col("finish_time") <= F.lit(end) * (1 + 1e-12))
        .select("source", "doc_id", "copy", "n_tokens", "finish_time")
    )
    taken = mix.groupBy("source").agg(F.sum("n_tokens").alias("taken"), F.max("copy").alias("last"))
    whole = taken.agg(F.sum("taken").alias("whole"))
    report = supply.join(taken, "source", "left").join(F.broadcast(whole), F.lit(True), "left").select(
        "source", "target_share", "max_repeats", "n_docs", F.col("stock").alias("tokens_there"),
        F.coalesce("taken", F.lit(0)).alias("tokens_taken"),
        F.round(F.coalesce(F.try_divide("taken", "whole"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce(F.col("last") + 1, F.lit(0)).alias("repeats_begun"),
    )
    return mix.repartitionByRange("finish_time").sortWithinPartitions("finish_time", "source", "doc_id", "copy"), report
