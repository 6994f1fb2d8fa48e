"""MinHash signatures and verified near-duplicate classes of short texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.llm.components import components
from biblion.session import checkpoint

#: Words of a shingle, the similarity asked for, and the signature's shape.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 4
_SEEDS = np.random.default_rng(7).integers(1, 2**61, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``width`` words; a shorter text is one shingle."""
    words = text.split()
    runs = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in runs), np.uint64, len(runs))


def runs(text: str, width: int = SHINGLE) -> frozenset[tuple[str, ...]]:
    """The runs of ``width`` words themselves, as ``shingles`` has their hashes."""
    words = text.split()
    return frozenset(zip(*(words[i:] for i in range(width)))) if len(words) >= width else frozenset([tuple(words)])


def band_keys(texts: list[str], at_once: int = 200) -> list[list[int]]:
    """The keys of the bands of each text; the minima of ``at_once`` texts are taken together."""
    out = []
    for i in range(0, len(texts), at_once):
        sets = [shingles(t) for t in texts[i : i + at_once]]
        h = np.concatenate(sets)[:, None]
        mixed = (h * _SEEDS[0] + _SEEDS[1]) ^ ((h * _SEEDS[1]) >> np.uint64(29))
        starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
        rows, width = np.minimum.reduceat(mixed, starts, axis=0), 8 * ROWS
        for row in (x.tobytes() for x in rows):
            out.append([xxhash.xxh64_intdigest(row[k * width : (k + 1) * width], seed=k) - 2**63 for k in range(BANDS)])
    return out


def jaccard(a: str, b: str) -> float:
    x, y = set(shingles(a).tolist()), set(shingles(b).tolist())
    return len(x & y) / len(x | y)


def classes(texts: DataFrame, leaders: int = 64) -> DataFrame:
    """Classes of distinct texts: ``text``, ``rep``.

    ``texts`` has one column ``text`` of distinct strings. In every bucket up to
    ``leaders`` texts lead, the least of each hash class; texts similar to a leader by
    the exact shingle sets take its class, the others go on without them until each has
    led or joined. No pairs of a bucket are listed: a hot bucket costs its size times
    the leaders of a round, and a round settles ``leaders`` unlike texts or more.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [(t, k) for t, keys_ in zip(names, band_keys(names), strict=True) for k in keys_]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], names=["text", "band"]
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(10_000)(runs)

        def similar(x: frozenset, y: frozenset) -> bool:
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                return False  # what both share is at most the smaller one
            shared = len(x & y)
            return shared / (len(x) + len(y) - shared) >= SIMILARITY

        for batch in batches:
            leads = []
            for text, heads in zip(batch.column("text").to_pylist(), batch.column("heads").to_pylist(), strict=True):
                mine = known(text)
                leads.append(next((x for x in heads if x == text or similar(known(x), mine)), None))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("band"), pa.array(leads, pa.string())], names=["text", "band", "lead"])

    banded = texts.mapInArrow(keys, "text string, band long")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    open_rows = checkpoint(banded.join(shared, "band", "left_semi"))
    links: DataFrame | None = None
    while not open_rows.isEmpty():
        least = open_rows.groupBy("band", F.pmod(F.xxhash64("text"), F.lit(leaders)).alias("salt")).agg(F.min("text").alias("head"))
        heads = least.groupBy("band").agg(F.sort_array(F.collect_list("head")).alias("heads"))  # at most ``leaders`` a band
        checked = checkpoint(open_rows.join(heads, "band").select("text", "band", "heads").mapInArrow(verify, "text string, band long, lead string"))
        found = checked.where("lead is not null and text <> lead").select("text", "lead").distinct()
        links = found if links is None else links.unionByName(found)
        open_rows = checked.where("lead is null").select("text", "band")
    if links is None:
        return texts.select("text", F.col("text").alias("rep"))
    # A leader of one bucket can follow in another: classes are what the links join, to the end.
    tied = checkpoint(links.select("text", "lead").distinct())
    parts = components(tied.select(F.xxhash64("text").alias("a"), F.xxhash64("lead").alias("b")))
    named = tied.select("text").union(tied.select("lead")).distinct().withColumn("node", F.xxhash64("text")).join(parts, "node").select("text", "label")
    reps = named.groupBy("label").agg(F.min("text").alias("rep"))
    joined = named.join(reps, "label").select("text", "rep")
    return texts.join(joined, "text", "left").select("text", F.coalesce("rep", "text").alias("rep"))
