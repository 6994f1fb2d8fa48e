"""Problem 8: filling containers of fixed capacity by bulk-synchronous best fit.

Documents are ranked by size across the cluster; a size is an integer of at most the
capacity, so the ranked documents are runs of equal sizes, and gaps are runs of equal
gaps. One round takes a run of documents, largest first, sweeps to the successor among
the gaps (the smallest gap that takes it), settles who gets which container by rank,
and puts the smaller gaps back. The rounds see runs only: their number is bounded by
the capacity, not by the corpus, which lets the whole sweep run on the size histogram.
Each document then finds its container from its rank by arithmetic on its run. The
result equals best-fit decreasing on single documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblion.llm.tokens import with_token_counts
from biblion.session import checkpoint


#: Runs a plan may have; it has a few for each size, and sizes are bounded by the capacity.
MOST_RUNS = 4_000_000


@dataclass
class Placement:
    """``n`` documents of one size, from rank ``first``, ``per`` to a container from ``container`` on."""

    size: int
    first: int
    n: int
    per: int
    container: int
    filled: int


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[Placement]:
    """Best-fit decreasing on runs: ``histogram`` maps a size (1..capacity) to its number of documents."""
    gaps: list[int] = []
    stock: dict[int, list[list[int]]] = {}
    out: list[Placement] = []
    opened = 0

    def put(gap: int, start: int, count: int) -> None:
        if gap <= 0 or count <= 0:
            return
        if gap not in stock:
            bisect.insort(gaps, gap)
            stock[gap] = []
        stock[gap].append([start, count])

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                gap, start, room = capacity, opened, -(-left // (capacity // size))
                opened += room
            else:
                gap = gaps[at]
                start, room = stock[gap].pop()
                if not stock[gap]:
                    del stock[gap]
                    gaps.pop(at)
            per = gap // size
            full, rest = min(room, left // per), 0
            if full < room and left > full * per:
                rest = left - full * per
            if full:
                out.append(Placement(size, rank, full * per, per, start, capacity - gap))
                put(gap - per * size, start, full)
            if rest:
                out.append(Placement(size, rank + full * per, rest, per, start + full, capacity - gap))
                put(gap - rest * size, start + full, 1)
            used = full + (1 if rest else 0)
            put(gap, start + used, room - used)
            rank += full * per + rest
            left -= full * per + rest
    return out


def _ranked(items: DataFrame, keys: list[str], order: str, buckets: int = 512) -> DataFrame:
    """Rank from 0 within ``keys`` without a task that holds a whole key.

    Items are spread over hash buckets; a bucket's offset is the sum of those before it.
    """
    spread = items.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    counts = spread.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__b").orderBy(order, "piece_no")
    return (
        spread.join(offsets, [*keys, "__b"])
        .withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__b", "__before")
    )


def pack_documents(docs: DataFrame, capacities: DataFrame, tokenizer: str | None = None, max_capacity: int = 1 << 20) -> DataFrame:
    """Place every document into containers of each kind.

    One row per document or piece: ``container_kind``, ``container_id`` (from 0 per
    kind), ``doc_id``, ``piece_no``, ``n_tokens``, ``token_start`` (in the document) and
    ``container_offset``. Only a document larger than the capacity is cut, into full
    containers and a rest. NULL and empty texts have no tokens and take no place;
    repeated ids are separate documents and each is placed. Kinds with a NULL or
    non-positive capacity are left out. A capacity above ``max_capacity`` is an error,
    and so is a plan of more than ``MOST_RUNS`` runs: these bound what is broadcast.
    """
    sizes = checkpoint(with_token_counts(docs, ["doc_id"], tokenizer=tokenizer).where("n_tokens > 0"))
    kinds = capacities.where(F.col("capacity_tokens") > 0)
    kinds = kinds.groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    caps = {r.container_kind: r.capacity for r in kinds.collect()}  # a fixed table of a few kinds
    if any(c > max_capacity for c in caps.values()):
        raise ValueError(f"a container of more than {max_capacity} tokens: raise max_capacity")

    # Histogram over sizes; whole containers of oversized documents need no search.
    per_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("cap")) for k, c in sorted(caps.items())])
    if not caps:
        per_kind = F.expr("cast(array() as array<struct<kind:string,cap:bigint>>)")
    items = sizes.select("doc_id", "n_tokens", F.explode(per_kind).alias("k")).select(
        "doc_id", "n_tokens", F.col("k.kind").alias("kind"), F.col("k.cap").alias("cap")
    )
    pieces = items.select(
        "kind", "cap", "doc_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0).cast("long"), ((F.col("n_tokens") - 1) / F.col("cap")).cast("long")),
                lambda i: F.struct((i * F.col("cap")).alias("start"), F.least(F.col("cap"), F.col("n_tokens") - i * F.col("cap")).alias("size")),
            )
        ).alias("piece_no", "p"),
    ).select("kind", "doc_id", "piece_no", F.col("p.start").alias("token_start"), F.col("p.size").alias("size"))
    histogram: dict[str, dict[int, int]] = {k: {} for k in caps}
    for r in pieces.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # at most capacity rows a kind
        histogram[r.kind][r["size"]] = r.n
    plans = {k: best_fit_runs(histogram[k], c) for k, c in caps.items()}
    if sum(map(len, plans.values())) > MOST_RUNS:
        raise ValueError(f"a plan of more than {MOST_RUNS} runs")
    table = {
        k: tuple(np.array([getattr(p, f) for p in sorted(v, key=lambda p: (p.size, p.first))], np.int64) for f in ("size", "first", "per", "container", "filled"))
        for k, v in plans.items()
    }
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array(batch.column("kind").to_pylist(), object)
            size = batch.column("size").to_numpy()
            rank = batch.column("rank").to_numpy()
            where, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k, (sizes_, first, per, start, filled) in shared.value.items():
                mine = kind == k
                if not mine.any():
                    continue
                s, r = size[mine], rank[mine]
                step = np.int64(1) << np.int64(40)
                at = np.searchsorted(sizes_ * step + first, s * step + r, side="right") - 1
                i = r - first[at]
                where[mine] = start[at] + i // per[at]
                offset[mine] = filled[at] + (i % per[at]) * s
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), pa.array(where), batch.column("doc_id"), batch.column("piece_no"), batch.column("size"), batch.column("token_start"), pa.array(offset)],
                names=["container_kind", "container_id", "doc_id", "piece_no", "n_tokens", "token_start", "container_offset"],
            )

    ranked = _ranked(pieces, ["kind", "size"], "doc_id").select("kind", "doc_id", "piece_no", "token_start", "size", "rank")
    return ranked.mapInArrow(
        place,
        "container_kind string, container_id long, doc_id long, piece_no int, n_tokens long, token_start long, container_offset long",
    )


def packing_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per kind: containers used, their fill, and the fewest that any packing needs."""
    used = placed.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.max("container_id").alias("last"), F.sum("n_tokens").alias("n_tokens")
    )
    cap = capacities.groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    n = F.col("last") + 1
    return used.join(F.broadcast(cap), "container_kind").select(
        "container_kind", "capacity_tokens", "n_pieces", n.alias("n_containers"), "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest_containers"),
        F.round(F.col("n_tokens") / (n * F.col("capacity_tokens")), 6).alias("fill"),
    )
