"""Problem 6: matching records of the same works across sources without keys.

Records, their attributes (author, year, month, DOI) and title tokens form a graph.
Random walks over it, record - token - record - token - record, are the sentences a
skip-gram model is trained on; a token's vector joins the trained direction with one of
its letter trigrams, so misspelt words stay near, and a record's vector is the weighted
mean of its tokens', less the mean of all records. Several hyperplane tables block the
vectors; a candidate also looks into the blocks beside its own that its vector misses
least. Pairs that meet are verified by 512 hyperplanes, compared exactly, field by
field, and decided by a score of cosine and fields that is calibrated by logistic
regression on pairs that the DOIs decide; the weight of the DOIs is fitted on pairs the
other fields decide.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblion.llm.names import edit_distance, folded
from biblion.operators.timestamps import normalise_timestamps, with_source_defaults
from biblion.session import checkpoint

#: Length of the spelt and of the trained part of a vector, and the trained part's share of its length.
SPELT, TRAINED, TRAINED_SHARE = 192, 32, 0.3
#: Records of a token at which its trained part has half its share.
WELL_TRAINED = 20.0
#: Buckets of nodes that have a trained vector, and of tokens that are counted: they bound what is collected and broadcast.
NODES, COUNTS = 1 << 15, 1 << 19
#: Records a walk goes on to (one walk starts at each record), and walks a task of the training reads.
STEPS, WALKS_A_TASK = 3, 250_000
#: Hyperplane tables, the blocks of each that a candidate looks into, listed records a block holds on average, hyperplanes of
#: the verification and how many of them may differ.
TABLES, PROBES, FILL, SIGNS, DIFFER = 6, 6, 500, 512, 158
#: Weight of a token's rarity, at most (1 in 400 records), and the share of it that a token of one record has: it ties none by
#: itself, being mistyped or cut short as often as not.
RAREST, ALONE = 6.0, 0.5
#: Further weight of names, years and months, and DOIs; a DOI that is missing or wrong must not hide the rest.
KINDS = {"@": 1.2, "#": 0.3, "!": 0.35}
#: Pairs the calibration is fitted on, at most.
CALIBRATION_PAIRS = 20_000

# Wording that makes a record another work than the one it is about, and wording that doesn't.
OTHER_WORK = {
    "correction": r"^(?:author )?(?:correction|corrigendum|erratum|errata)(?: to| for)?\b", "reply": r"^(?:authors? )?(?:reply|response|rejoinder)(?: to)?\b(?= |$)", "comment": r"^(?:comment(?:ary)?|letter|editorial) (?:on|regarding|re)\b", "review": r"^(?:peer|book|open|referee) ?review(?:er)? (?:of|report)\b|^review of\b",
    "retraction": r"^(?:retraction|withdrawn|expression of concern)\b", "update": r"\b(?:a|an|the)? ?(?:\w+ year )?(?:update|follow up)$|\bupdated\b", "revisited": r"\brevisited$", "part": r"\b(?:part|pt|volume) (?:[2-9]|ii+|iv|two|three)\b|\b(?:ii|iii|iv)$",
}
NO_MATTER = r"^(?:(?:research|original|review|full|regular) (?:article|paper)|preprint|article|c[a-z] [a-z]{2}|version \d|v\d|early (?:access|view)|accepted manuscript)\b"
BAD_DOI = r"^(?:10\.\d{4,9}/)?(?:none|null|na|unknown|tbd|pending|x+|0+)?$"

# Titles in normal form are ASCII, so these are compiled once by ``re``; a title without any of the hints is of no other kind.
_OTHER_WORK = {kind: re.compile(pattern) for kind, pattern in OTHER_WORK.items()}
_HINT = re.compile(r"correct|corrig|errat|reply|respon|rejoin|comment|letter|editorial|review|retract|withdrawn|expression|update|follow up|revisited|\b(?:part|pt|volume) |\b(?:iii?|iv)$")
_NO_MATTER, _SIGNS, _BLANKS = re.compile(NO_MATTER), re.compile(r"[^a-z0-9]+"), re.compile(r"\s+")
_MARKUP, _BRACKET = regex.compile(r"</?\w+>"), regex.compile(r"^\s*\[[^\]]{1,20}\]\s*")
_DOI_START, _DOI_VERSION, _BAD_DOI = regex.compile(r"^(?:https?://|dx\.|www\.|doi\.org/|doi:?\s*)+"), regex.compile(r"(?:\.|/)?v\d+$"), regex.compile(BAD_DOI)
_HYPHEN, _NAME = regex.compile(r"(?<=\p{L})-(?=\p{L})"), re.compile(r"[a-z]{3,}")


def _plain(text: str) -> str:
    return text.lower() if text.isascii() else folded(text)


def doi_form(doi: str | None) -> str:
    text = unquote((doi or "").strip()).lower()
    text = _DOI_START.sub("", text).strip().rstrip(".,;")
    text = _DOI_VERSION.sub("", text)
    return "" if not text.startswith("10.") or _BAD_DOI.match(text) else text


def title_form(title: str | None) -> tuple[str, str]:
    """Title in normal form and the kind of other work its wording tells (or empty)."""
    text = title or ""
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    text = text.replace("&amp;", " and ").replace("&", " and ")
    text = _BRACKET.sub(" ", text)
    text = _SIGNS.sub(" ", _plain(text).replace("…", " ")).strip()
    text = _NO_MATTER.sub("", text).strip()
    if _HINT.search(text):
        for kind, pattern in _OTHER_WORK.items():
            m = pattern.search(text)
            if m and m.span() != (0, len(text)):
                return _BLANKS.sub(" ", text[: m.start()] + " " + text[m.end() :]).strip(), kind
    return text, ""


def author_words(name: str | None) -> list[str]:
    return [w for w in _NAME.findall(_plain(_HYPHEN.sub("", name) if name and "-" in name else name or "")) if w not in ("prof", "phd", "mph")]


def _day(norm: str | None) -> tuple[float, int]:
    """Day number and precision in days of a normal-form date; (nan, 0) if there is none."""
    if not norm:
        return math.nan, 0
    y, m, d = int(norm[:4]), norm[5:7], norm[8:10]
    if not m:
        return y * 365.25 + 182, 183
    return y * 365.25 + (int(m) - 1) * 30.44 + (int(d) if d else 15), 1 if d else 16


def tokens_of(title: str, author: list[str], date: str | None, doi: str) -> list[str]:
    out = title.split()
    out += [f"@{w}" for w in author]
    if date:
        out.append(f"#{date[:4]}")
        if len(date) >= 7:
            out.append(f"#{date[:7]}")
    if doi:
        out.append(f"!{doi}")
    return out


def _prepare(df: DataFrame, key: str, side: str, source_zones: DataFrame) -> DataFrame:
    """``side``, ``key``, ``title``, ``marker``, ``author``, ``date``, ``doi``, ``sig`` of each record, once."""
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(
        F.max(F.struct("title", "first_author", "pub_date", "doi")).alias("v")
    ).select("key", "v.*")
    dated = normalise_timestamps(with_source_defaults(once, source_zones, "key"), "pub_date", "src_zone", "src_date_order", "__date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, a, doi, date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                title, marker = title_form(t)
                author, doi_, day = " ".join(author_words(a)), doi_form(doi), (date or "")[:10]
                sig = xxhash.xxh64_intdigest("|".join([side, title, marker, author, day, doi_])) - 2**63
                rows.append((k, title, marker, author, day, doi_, sig))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:6]), pa.array(cols[6], pa.int64())], names=["key", "title", "marker", "author", "date", "doi", "sig"])

    out = dated.select("key", "title", "first_author", "doi", "__date").mapInArrow(
        run, "key string, title string, marker string, author string, date string, doi string, sig long"
    )
    return out.withColumn("side", F.lit(side))


def node_bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token, seed=42) % NODES  # Spark's xxhash64


def count_bucket(token: str) -> int:
    return xxhash.xxh32_intdigest(token, seed=2) % COUNTS


def walks(records: DataFrame, seed: int = 5) -> DataFrame:
    """Random walks over ``records`` (sig, tokens), one from each, as sentences: column ``words``, the buckets of the nodes passed.

    A step goes from a record over one of its tokens, drawn by hash, to the record next
    in the token's hashed order, and the walk goes on from there. Only the postings of
    tokens that more than a ten-thousandth of all postings share are split, by hash, so
    that no task holds a hot token; rare ones, which tie records of one work, are whole.
    """
    posts = records.select("sig", F.explode("tokens").alias("token"))
    n = F.count(F.lit(1))
    total = records.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0
    least = max(1000, total // 10_000)
    hot = posts.groupBy("token").agg(n.alias("n")).where(F.col("n") > least)  # at most 10,000 rows
    part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("sig", F.lit(seed)), F.ceil(F.col("n") / least))).otherwise(0)
    spread = posts.join(F.broadcast(hot), "token", "left").select("sig", "token", part.alias("part"))
    order = Window.partitionBy("token", "part").orderBy(F.xxhash64("sig", F.lit(seed)), "sig")
    first = F.first("sig").over(order)  # the order is a ring
    steps = spread.withColumn("to", F.coalesce(F.lead("sig").over(order), first)).where("`to` <> sig")
    bucket = lambda t: F.xxhash64(t).bitwiseAND(F.lit(NODES - 1)).cast("int")  # noqa: E731  ``node_bucket``
    # One way out of each record for every step of a walk.
    ways = [F.max_by(F.struct(bucket(F.col("token")).alias("token"), "to"), F.xxhash64("token", "sig", F.lit(seed + i))).alias(f"way{i}") for i in range(STEPS)]
    moves = steps.groupBy("sig").agg(*ways)
    # Six tokens of a record, drawn by hash, stand around it in a sentence.
    mixed = F.array_sort(F.transform("tokens", lambda t: F.struct(F.xxhash64(t, "sig").alias("h"), t.alias("t"))))
    near = F.transform(F.slice(mixed, 1, 6), lambda x: bucket(x["t"]))
    told = checkpoint(records.join(moves, "sig", "left").select("sig", near.alias("near"), *[f"way{i}" for i in range(STEPS)]))
    at = told.select(F.col("near").alias("words"), F.col("way0").alias("way"))
    for i in range(1, STEPS + 1):
        onward = told.select(F.col("sig").alias("at"), "near", F.col(f"way{i}" if i < STEPS else "way0").alias("onward"))
        at = at.withColumn("at", F.col("way.to")).join(onward, "at", "left").select(
            F.concat("words", F.array_compact(F.array("way.token")), F.coalesce("near", F.array().cast("array<int>"))).alias("words"), F.col("onward").alias("way")
        )
    return at.select(F.col("words").cast("array<string>").alias("words"))


def fit_vectors(records: DataFrame, seed: int = 5) -> np.ndarray:
    """Skip-gram vectors of all buckets of nodes (zeros where no walk went)."""
    out = np.zeros((NODES, TRAINED), np.float32)
    # All walks in one order, so that every run fits the same vectors: models of further tasks are averaged, the last digits aside.
    sentences = checkpoint(walks(records.select("sig", "tokens"), seed).repartition(1).sortWithinPartitions("words"))
    n = sentences.count()
    if not n:
        return out
    model = Word2Vec(vectorSize=TRAINED, windowSize=5, minCount=1, maxIter=1, numPartitions=-(-n // WALKS_A_TASK), seed=seed, inputCol="words", outputCol="v", maxSentenceLength=100)
    got = model.fit(sentences).getVectors().select(F.col("word").cast("int").alias("at"), vector_to_array("vector", "float32").alias("v")).toArrow()
    flat = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, TRAINED)
    flat = flat - flat.mean(axis=0)  # what all nodes have in common tells nothing
    out[got.column("at").to_numpy()] = flat / (np.linalg.norm(flat, axis=1, keepdims=True) + 1e-9)
    return out


def count_tokens(records: DataFrame) -> np.ndarray:
    """Records of each bucket of tokens; at most ``COUNTS`` rows are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = np.unique(np.array([count_bucket(t) for t in batch.column(0).flatten().to_pylist()] if batch.num_rows else [], np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["at", "n"])

    got = records.select("tokens").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTS, np.float32)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _fixed(text: str) -> np.ndarray:
    """A fixed random direction."""
    v = np.random.default_rng(xxhash.xxh64_intdigest(text)).standard_normal(SPELT).astype(np.float32)
    return v / np.linalg.norm(v)


class Vectors:
    """Weighted vectors of tokens, each made once in a worker."""

    def __init__(self, trained: np.ndarray, counts: np.ndarray, n: int):
        self.trained, self.counts, self.n = trained, counts, n
        self.made: dict[str, np.ndarray] = {}
        self.grams: dict[str, np.ndarray] = {}

    def spelt(self, t: str) -> np.ndarray:
        """The direction of a token's spelling: years and months are whole, words and names the sum of their trigrams."""
        if t[0] in "#!":
            return _fixed(t)
        kind, word = ("@", t[1:]) if t[0] == "@" else ("", t)
        padded, total = f"^{word}$", np.zeros(SPELT, np.float32)
        for i in range(len(padded) - 2):
            g = f"{kind}~{padded[i : i + 3]}"
            v = self.grams.get(g)
            if v is None:
                if len(self.grams) > 200_000:
                    self.grams.clear()
                v = self.grams[g] = _fixed(g)
            total += v
        return total / (np.linalg.norm(total) + 1e-9)

    def token(self, t: str) -> np.ndarray:
        v = self.made.get(t)
        if v is None:
            if len(self.made) > 200_000:
                self.made.clear()
            # The trained direction says what a token is like, the spelling which it is; few walks teach little.
            n = max(1.0, float(self.counts[count_bucket(t)]))
            v = np.concatenate([self.spelt(t), TRAINED_SHARE * n / (n + WELL_TRAINED) * self.trained[node_bucket(t)]])
            weight = min(math.log(1 + self.n / n), RAREST) * (ALONE if n < 2 else 1.0)
            v = self.made[t] = v * weight * KINDS.get(t[0], 1.0)
        return v

    def record(self, tokens: list[str]) -> np.ndarray:
        total = np.add.reduce([self.token(t) for t in tokens])
        norm = np.linalg.norm(total)
        return total / norm if norm else total


def planes(bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((max(SIGNS, TABLES * bits), SPELT + TRAINED)).astype(np.float32)


#: Which of the bits that a vector misses least are turned for each block looked into.
_TURNS = [(), (0,), (1,), (2,), (0, 1), (3,), (0, 2), (4,)]


def block_keys(vectors: np.ndarray, bits: int, seed: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (records x tables * probes) and the signs of the verification (records x 2 longs)."""
    side = vectors @ planes(bits, seed).T
    signs = np.packbits(side[:, :SIGNS] > 0, axis=1).reshape(len(side), -1).view(np.int64) if len(side) else np.zeros((0, SIGNS // 64), np.int64)
    margin = side[:, : TABLES * bits].reshape(len(side), TABLES, bits)
    powers = (1 << np.arange(bits)).astype(np.int64)
    own = (margin > 0) @ powers
    nearest = powers[np.argsort(np.abs(margin), axis=2)[:, :, :5]]
    turns = [x for x in _TURNS[:probes] if all(i < bits for i in x)]
    keys = np.stack([own ^ sum((nearest[:, :, i] for i in turn), np.zeros_like(own)) for turn in turns], axis=2)
    return (keys + (np.arange(TABLES, dtype=np.int64) << bits)[None, :, None]).reshape(len(side), -1), signs


_letters = lru_cache(100_000)(frozenset)


@lru_cache(100_000)
def _edits(a: str, b: str) -> int:
    """Edits between two words, 3 for more than two."""
    # Each letter that the other word lacks takes an edit of its own.
    x, y = _letters(a), _letters(b)
    return 3 if len(x - y) > 2 or len(y - x) > 2 else edit_distance(a, b, 2)


def title_likeness(a: str, b: str) -> float:
    """Share of words with a counterpart within one edit (two in long words), by length; 1 for a title cut short.

    At most 0.8 if a word is replaced by another: no misspelling or beginning of any word left.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = a.split(), b.split()
    short, long_ = (x, y) if len(x) <= len(y) else (y, x)
    if len(short) >= 5 and long_[: len(short) - 1] == short[:-1] and long_[len(short) - 1].startswith(short[-1]):
        return 0.97
    left = list(long_)
    hit, without = 0.0, []
    for w in short:
        best = None
        for i, v in enumerate(left):
            if w == v:
                best = i
                break
            if best is None and len(w) > 3 and abs(len(w) - len(v)) <= 2 and _edits(w, v) <= (1 if len(w) < 8 else 2):
                best = i
        if best is not None:
            hit += len(left.pop(best))
        elif len(w) > 3:
            without.append(w)
    replaced = any(not any(v.startswith(w) or _edits(w, v) <= 2 for v in left) for w in without)
    return min(2 * hit / (sum(map(len, short)) + sum(map(len, long_)) - 0.0001), 0.8 if replaced else 1.0)


def compare(a: dict, b: dict) -> tuple[float, int, int, int]:
    """Title likeness, author (1 agrees, -1 differs, 0 unknown), date (2 same, 1 near, 0 unknown, -1 far), DOI (1, -1, 0)."""
    title = title_likeness(a["title"], b["title"])
    x, y = a["author"].split(), b["author"].split()
    author = 0
    if x and y:
        author = 1 if any(_edits(v, w) <= (1 if min(len(v), len(w)) < 8 else 2) for v in x for w in y if len(v) > 3 or v == w) else -1
        if author == 1 and len(x) > 1 and len(y) > 1:
            agree = sum(any(_edits(v, w) <= (1 if min(len(v), len(w)) < 8 else 2) for w in y) for v in x)
            if agree == 1 and not any(v.startswith(w[:3]) or w.startswith(v[:3]) for v in x for w in y if v != w):
                longest = max(x, key=len)
                author = 1 if any(_edits(longest, w) <= 2 for w in y) else -1
    (d, p), (e, q) = _day(a["date"]), _day(b["date"])
    date = 0
    if p and q:
        gap = abs(d - e)
        date = 2 if gap <= max(p, q) + 1 else 1 if gap <= 400 + max(p, q) else -1
    doi = 0 if not a["doi"] or not b["doi"] else 1 if a["doi"] == b["doi"] else -1
    if doi == -1 and ("/pre." in a["doi"] or "/pre." in b["doi"] or a["doi"].startswith(b["doi"]) or b["doi"].startswith(a["doi"])):
        doi = 0  # a posting's DOI is its own, and one cut short tells nothing
    return title, author, date, doi


def same_work(marks: bool, title: float, author: int, date: int, doi: int, generic: bool) -> bool:
    """The decision on exact evidence; ``marks`` tells that both titles are of one kind of work."""
    if not marks or title < 0.6:
        return False
    if doi == 1:
        return author >= 0 and (title >= 0.7 or author == 1) or title >= 0.9 and date >= 1
    if generic:
        # An early posting is near in date; on one date the DOIs may differ, as for other titles.
        return author == 1 and title >= 0.9 and (date == 2 or date == 1 and doi == 0)
    if title < 0.82:
        return False
    if author == 1:
        return date >= 1 or date == 0 and title >= 0.9 and doi == 0
    if author == 0:
        return date == 2 and (doi == 0 or title >= 0.97)
    return False


def is_generic(n_title: int, n_listed: int, share: float) -> bool:
    return n_title >= max(3, share * n_listed)


def comparable():
    """Pairs ``a``, ``b`` of the sigs ``c``, ``l`` that ``compare`` could keep, told without Python: no pair that it keeps is lost.

    Titles need a quarter of the words of the shorter one, unless the DOIs agree; dates
    too far apart or authors without any near word part all pairs but those of one DOI
    and a sixteenth of those of two. An edit between neighbours counts as two here.
    """
    doi, other = F.col("a.doi"), F.col("b.doi")
    alike = F.size(F.array_intersect("a.words", "b.words")) >= 0.25 * F.least(F.size("a.words"), F.size("b.words"))
    far = (F.col("a.within") > 0) & (F.col("b.within") > 0) & (F.abs(F.col("a.day") - F.col("b.day")) > 400 + F.greatest("a.within", "b.within"))

    def near(v, w):
        d = F.levenshtein(v, w, 4)
        return (v == w) | (F.length(v) > 3) & (d >= 0) & ((d <= 2) | (F.least(F.length(v), F.length(w)) >= 8))

    x, y = F.split("a.author", " "), F.split("b.author", " ")
    apart = (F.col("a.author") != "") & (F.col("b.author") != "") & ~F.exists(x, lambda v: F.exists(y, lambda w: near(v, w)))
    drawn = (doi != "") & (other != "") & (F.col("c").bitwiseXOR(F.col("l")).bitwiseAND(F.lit(15)) == 0)
    return (alike | (doi == other)) & ((doi == other) & (doi != "") | drawn | ~(far | apart))


#: What is compared of a record.
DETAILS = ("title", "marker", "author", "date", "doi")
#: Evidence besides the DOI: the rule on exact evidence, then fields and cosine; and where their weights start from.
EVIDENCE = ("rule", "cosine", "title", "agrees", "differs", "same_day", "far", "generic")
START = np.array([-5.0, 9.0, 1.0, 1.0, 0.5, -1.5, 0.5, -1.0, -0.5])
START_DOI = {1: 3.0, -1: -1.0}


def meeting_pairs(records: DataFrame, shared, seed: int) -> DataFrame:
    """Pairs ``c``, ``l`` of candidate and listed record that meet in a block and are near by the verification."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Vectors(*shared.value)
        for batch in batches:
            rows = [space.record(t).astype(np.float16).tobytes() for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("side"), pa.array(rows, pa.binary())], names=["sig", "side", "vector"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(SPELT + TRAINED)
        for batch in batches:
            n += batch.num_rows
            if batch.num_rows:
                sums += _matrix(batch.column(0)).sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["n", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(n, x) for batch in batches for n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([sum(n for n, _ in rows)], pa.int64()), pa.array([np.sum([x for _, x in rows], axis=0).tolist()], pa.list_(pa.float64()))], names=["n", "sums"])

    made = checkpoint(records.select("sig", "side", "tokens").mapInArrow(embed, "sig long, side string, vector binary"))
    parts = made.select("vector").mapInArrow(total, "n long, sums array<double>").repartition(8).mapInArrow(added, "n long, sums array<double>").collect()  # eight rows
    centre = (np.sum([r.sums for r in parts], axis=0) / max(1, sum(r.n for r in parts))).astype(np.float32) if parts else np.zeros(SPELT + TRAINED, np.float32)
    n_listed = made.where("side = 'l'").count()
    bits = min(32, max(1, round(math.log2(max(1, n_listed) / FILL))))

    longs = [f"s{i}" for i in range(SIGNS // 64)]

    def keys(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks, signs = block_keys(_matrix(batch.column("vector")) - centre, bits, seed, probes)
                width = blocks.shape[1] if len(blocks) else 1
                cols = [blocks.reshape(-1), *(np.repeat(x, width) for x in (batch.column("sig").to_numpy(), *signs.T))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["block", "sig", *longs])

        return run

    schema = "block long, sig long, " + ", ".join(f"{x} long" for x in longs)
    c = made.where("side = 'c'").mapInArrow(keys(PROBES), schema).alias("c")
    l = made.where("side = 'l'").mapInArrow(keys(1), schema).alias("l")
    differ = sum((F.bit_count(F.col(f"c.{x}").bitwiseXOR(F.col(f"l.{x}"))) for x in longs), F.lit(0))
    met = c.join(l.hint("merge"), (F.col("c.block") == F.col("l.block")) & (differ <= DIFFER))
    return met.select(F.col("c.sig").alias("c"), F.col("l.sig").alias("l")).distinct()


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float16).reshape(-1, SPELT + TRAINED).astype(np.float32)


def match_records(candidates: DataFrame, listed: DataFrame, source_zones: DataFrame, generic_share: float = 0.002, seed: int = 5, least: float = 0.5) -> DataFrame:
    """Pairs for one work: ``cand_uid``, ``uid``, ``confidence`` (``least`` to 1).

    Judged from title, first author, publication date and DOI. Records that agree in
    all of these are compared once and their pairs listed at the end. Titles of at most
    four words, or that are listed three times or more and make up ``generic_share`` of
    the distinct listed records (so at any size of the table), need author and a near
    date. NULL fields are unknown, NULL keys are left out, repeated keys count once,
    records without any field match nothing.
    """
    both = _prepare(candidates, "cand_uid", "c", source_zones).unionByName(_prepare(listed, "uid", "l", source_zones))
    both = checkpoint(both)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, a, d, o = (batch.column(x).to_pylist() for x in ("title", "author", "date", "doi"))
            toks = [tokens_of(*x) for x in zip(t, [y.split() for y in a], d, o, strict=True)]
            days = [_day(x) for x in d]
            yield (
                batch.append_column("tokens", pa.array(toks, pa.list_(pa.string())))
                .append_column("words", pa.array([[xxhash.xxh64_intdigest(w) - 2**63 for w in set(x.split())] for x in t], pa.list_(pa.int64())))
                .append_column("day", pa.array([x for x, _ in days], pa.float64())).append_column("within", pa.array([x for _, x in days], pa.int32()))
            )

    distinct = both.select("sig", "side", *DETAILS).distinct()
    details = ", ".join(f"{x} string" for x in DETAILS)
    records = checkpoint(distinct.mapInArrow(tokenise, f"sig long, side string, {details}, tokens array<string>, words array<long>, day double, within int").where("size(tokens) > 0"))
    shared = records.sparkSession.sparkContext.broadcast((fit_vectors(records, seed), count_tokens(records), records.count()))
    n_listed = records.where("side = 'l'").count()
    generic = records.where("side = 'l'").groupBy("title").agg(F.count(F.lit(1)).alias("n_title"))
    met = meeting_pairs(records, shared, seed)
    seen = (*DETAILS, "words", "day", "within")
    of = lambda side, name: records.where(f"side = '{side}'").select(F.col("sig").alias(side), F.struct(*seen).alias(name))
    theirs = records.where("side = 'l'").join(generic, "title").select(F.col("sig").alias("l"), F.struct(*seen, "n_title").alias("b"))
    # Years far apart and no common DOI: another work; one in sixteen of those whose DOIs differ is kept for the calibration.
    year = lambda x: F.substring(f"{x}.date", 1, 4).try_cast("int")
    near = F.coalesce(F.abs(year("a") - year("b")) <= 2, F.lit(True)) | (F.col("a.doi") == F.col("b.doi")) | (F.pmod(F.xxhash64("c", "l"), F.lit(16)) == 0)
    paired = met.join(of("c", "a"), "c").join(theirs, "l").where((F.col("a.marker") == F.col("b.marker")) & near & comparable()).select(
        "c", "l", *[F.struct(*[F.col(f"{x}.{y}") for y in (*DETAILS, *more)]).alias(x) for x, more in (("a", ()), ("b", ("n_title",)))]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Vectors(*shared.value)
        vector = lru_cache(20_000)(lambda title, author, date, doi: space.record(tokens_of(title, author.split(), date, doi)))
        names = ["c", "l", "doi", "rule", *EVIDENCE[1:]]
        for batch in batches:
            out: list[tuple] = []
            for c, l, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                x, y = set(a["title"].split()), set(b["title"].split())
                if len(x & y) < 0.25 * min(len(x), len(y)) and a["doi"] != b["doi"]:
                    continue  # a title is the same work's with a quarter of its words intact
                _, author, date, doi = compare({**a, "title": ""}, {**b, "title": ""})
                if doi != 1 and (author < 0 or date < 0) and (doi == 0 or (c ^ l) % 16):
                    continue  # no title makes these one work, and a few are enough for the calibration
                title = title_likeness(a["title"], b["title"])
                if title < 0.5 and doi != 1:
                    continue
                plain = len(b["title"].split()) <= 4 or is_generic(b["n_title"], n_listed, generic_share)
                u, v = (vector(r["title"], r["author"], r["date"], r["doi"]) for r in (a, b))
                rule = same_work(True, title, author, date, doi, plain)
                out.append((c, l, doi, float(rule), float(u @ v), title, float(author == 1), float(author == -1), float(date == 2), float(date == -1), float(plain)))
            data = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * len(EVIDENCE)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types, strict=True)], names=names)

    judged = checkpoint(paired.mapInArrow(judge, "c long, l long, doi int, " + ", ".join(f"{x} double" for x in EVIDENCE)))
    weights, by_doi = calibrated(judged)
    z = F.lit(float(weights[0])) + sum((F.lit(float(w)) * F.col(x) for x, w in zip(EVIDENCE, weights[1:], strict=True)), F.lit(0.0))
    z = z + F.when(F.col("doi") == 1, by_doi[1]).when(F.col("doi") == -1, by_doi[-1]).otherwise(0.0)
    scored = judged.select("c", "l", F.round(1 / (1 + F.exp(-z)), 6).alias("confidence")).where(F.col("confidence") >= least)
    keys = both.select("key", "sig", "side")
    return (
        scored.join(keys.where("side = 'c'").select(F.col("key").alias("cand_uid"), F.col("sig").alias("c")), "c")
        .join(keys.where("side = 'l'").select(F.col("key").alias("uid"), F.col("sig").alias("l")), "l")
        .groupBy("cand_uid", "uid")
        .agg(F.max("confidence").alias("confidence"))
    )


def calibrated(judged: DataFrame, most: int = CALIBRATION_PAIRS) -> tuple[np.ndarray, dict[int, float]]:
    """Weights of the evidence (intercept first) and of equal and unlike DOIs, each fitted on ``most`` pairs drawn by hash.

    The evidence is fitted on pairs that the DOIs decide, the DOIs on pairs of which the
    evidence leaves no doubt. Where there are few such pairs the weights stay near those
    they start from.
    """
    draw = F.xxhash64("c", "l")
    known = judged.where("doi <> 0").orderBy(draw).limit(most).select("doi", *EVIDENCE).toPandas()
    w = calibrate(known[list(EVIDENCE)].to_numpy(float), (known["doi"] == 1).to_numpy(float), START)
    some = judged.orderBy(F.xxhash64("c", "l", F.lit(1))).limit(most).select("doi", *EVIDENCE).toPandas()
    p = 1 / (1 + np.exp(-np.clip(w[0] + some[list(EVIDENCE)].to_numpy(float) @ w[1:], -30, 30)))
    same, other = some["doi"][p > 0.95], some["doi"][p < 0.05]
    # Counts that speak for the starting weights as ten pairs of either kind would.
    by_doi = {}
    for kind, start in START_DOI.items():
        prior = 10 * math.exp(start) / (1 + math.exp(start))
        by_doi[kind] = math.log(((same == kind).sum() + prior) / (len(same) + 10)) - math.log(((other == kind).sum() + 10 - prior) / (len(other) + 10))
    return w, by_doi


def calibrate(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to ``start`` (else 0) by a ridge; intercept first."""
    one = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, x.shape[1] + 1))
    start = np.zeros(one.shape[1]) if start is None else start

    def loss(w: np.ndarray) -> float:
        z = one @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * ridge * np.sum((w - start) ** 2))

    w, best = start.copy(), loss(start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        grad = one.T @ (y - p) - ridge * (w - start)
        hess = (one * (p * (1 - p))[:, None]).T @ one + ridge * np.eye(one.shape[1])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(w + size * step) > best:
            size /= 2  # a full step can overshoot
        if size <= 1e-4:
            break
        w = w + size * step
        best = loss(w)
    return w
