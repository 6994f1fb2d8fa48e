"""Problem 1: noise in text from scanned pages.

Lines of a scanned text are sorted into body, headings, table rows and page furniture
by their length against the page's width, by position at page edges, and by a corpus
statistic: how often lines of the same wording interrupt a sentence. Broken words are
joined if the corpus has the joined word rather than the compound. Misread words are
found in SQL by anagram hashes: the hash is a sum over characters, so a confusion of
characters shifts it by a fixed difference, and one equi-join of rare words' shifted
hashes with frequent words' hashes yields the candidates, checked letter by letter and
ranked by frequency.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblion.session import checkpoint

# Fixed values: (what the scanner reads, what stands there).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("o", "e"), ("e", "o"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("l", "i"), ("i", "l"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("q", "g"), ("g", "q"), ("v", "y"), ("u", "v"), ("v", "u"), ("t", "l"), ("l", "t"), ("r", "n"),
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("0", "o"), ("5", "s"), ("$", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("3", "e"), ("4", "a"), ("7", "t"), ("@", "a"), ("†", "t"), ("‡", "t"), ("+", "t"), ("€", "e"), ("£", "e"), ("¢", "c"), ("(", "c"), ("¡", "i"), ("ß", "b"), ("6", "g"),
    ("m", "rn"), ("rn", "m"), ("m", "in"), ("in", "m"), ("m", "ni"), ("ni", "m"), ("m", "nn"), ("nn", "m"), ("iii", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("ii", "n"), ("li", "h"), ("h", "li"), ("lı", "h"), ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("ln", "m"), ("fi", "ﬁ"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("tl", "d"), ("ci", "a"), ("a", "ci"), ("o", "ci"), ("k", "lc"), ("lc", "k"),
]
HYPHENS = "-‐‑¬­"
#: A word is frequent against a rare one at this ratio, and from this count on.
RATIO, LEAST = 8, 8
#: A word with a sign or figure amid its letters needs no more than this ratio and count on the other side: the sign speaks against it.
SIGN_RATIO, SIGN_LEAST = 1, 2
#: So many of the most frequent words that aren't misread travel to the workers, which leave them out of what is looked up by a
#: join; the number changes how much is joined, never the result.
COMMON_WORDS = 40_000

_TOKEN_EDGE = "\"'“”‘’«»()[]{}.,;:?/*_"
_ROMAN = regex.compile(r"^[ivxlc]+$", regex.I)
_PAGE = regex.compile(r"^(?:(?:page|p\.?|pg\.?|seite|- |– |— |\[|\|)\s*)?([\dOolIS]{1,5}|[ivxlc]{1,7})(?:\s*(?:of|/)\s*[\dOolIS]{1,5})?\s*(?:-|–|—|\]|\|)?$", regex.I)
_TABLE = regex.compile(r"^[\dOolIS.,%±()/–-]+(?:\s{2,}[\dOolIS.,%±()/–-]+)*$")
_TERMINAL = regex.compile(r"[.!:…][\"'”’)\]]*$")
#: Lines that only furniture has: a number set apart from the wording, or authors and title.
_RUNNING = regex.compile(r"^[\dOolI]{1,5}\s{2,}\S|\S\s{2,}[\dOolI]{1,5}$|\bet al\. / ")
#: A sign or a figure amid letters.
SIGNED = r"[@†‡$|€£¢!¡+(0-9]"
_FOLD = str.maketrans({"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "$": "s", "@": "a", "†": "t", "c": "e", "8": "b", "9": "g", "q": "g"})
_EDGE_NUMBERS, _NO_LETTERS = re.compile(r"^\s*\d+\s+|\s+\d+\s*$"), re.compile(r"[^a-z]+")
_GAP, _NUMBERED, _COPYRIGHT = re.compile(r"\S\s{2,}\S"), re.compile(r"^\d+\s{2,}|\s{2,}\d+$"), re.compile(r"^(?:©|\(c\))", re.I)
_NOTICE = regex.compile(r"(?:©|\(c\)|\bvol\.|\bno\.\s*\d|et al\. /|\bdoi\b|https?://|\bissn\b)", regex.I)


def tokens(line: str) -> list[str]:
    """Words of a line in lower case, without punctuation around them."""
    return [t for t in (w.strip(_TOKEN_EDGE).lower() for w in line.split()) if t]


def fold(line: str) -> str:
    """A line's wording whatever the case, the digits and the usual confusions."""
    return _NO_LETTERS.sub(" ", _EDGE_NUMBERS.sub(" ", line.lower()).translate(_FOLD)).strip()


class Line:
    __slots__ = ("no", "text", "kind", "ff", "fold")

    def __init__(self, no: int, text: str):
        self.no, self.ff = no, "\f" in text
        self.text = text.replace("\f", "").strip()
        self.kind = "blank" if not self.text else "body"


def page_width(lines: list[str]) -> int:
    sizes = sorted(len(x) for x in lines if x.strip())
    return sizes[int(0.95 * (len(sizes) - 1))] if sizes else 0


def is_scanned(text: str) -> bool:
    """Whether a text is broken into lines of a page's width."""
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    width = page_width(lines)
    if len(full) < 6 or not 30 <= width <= 140:
        return False
    return sum(len(x) >= 0.6 * width for x in full) >= 0.5 * len(full) and max(map(len, full)) <= 1.6 * width


def sort_lines(text: str) -> list[Line]:
    """Lines with their kind: blank, body, number, table or short (headings and furniture)."""
    lines = [Line(i, x) for i, x in enumerate(text.split("\n"))]
    width = page_width([x.text for x in lines])
    for x in lines:
        x.fold = fold(x.text) if x.text else ""
    seen = Counter(x.fold for x in lines if x.text)
    n = len(lines)

    def numeric(i: int) -> bool:
        return 0 <= i < n and bool(lines[i].text) and bool(_TABLE.match(lines[i].text))

    # The first word of the next full line: had it fitted, a running line would have taken it.
    following, word = [""] * n, ""
    for i in range(n - 1, -1, -1):
        following[i] = word
        t = lines[i].text
        if (len(t) >= 0.6 * width or t and _TERMINAL.search(t) and t[:1].islower()) and not _NOTICE.search(lines[i].text):
            word = lines[i].text.split()[0]

    for i, x in enumerate(lines):
        if x.kind == "blank":
            continue
        t = x.text
        if numeric(i) and (numeric(i - 1) or numeric(i + 1) or _GAP.search(t)):
            x.kind = "table"
        elif _PAGE.match(t) and (any(c.isdigit() for c in t) or _ROMAN.match(t) or not t.isalpha()):
            x.kind = "number"
        elif not _TERMINAL.search(t) and t[-1] not in HYPHENS + ",;":
            words = t.split()
            # A misread word can be long: what would still have fitted decides.
            early = len(t) <= width - 20
            caps = sum(w[:1].isupper() for w in words) >= 0.6 * len(words)
            near = any(not (0 <= j < n) or lines[j].kind == "blank" or lines[j].ff or x.ff for j in (i - 1, i + 1))
            early_end = len(t) + 1 + len(following[i]) < width
            again = seen[x.fold] > 1 and early_end
            marked = bool(_NOTICE.search(t)) or again or bool(_NUMBERED.search(t))
            if early or len(t) <= width - 2 and (caps and len(words) > 1 or marked) or near and len(t) <= width - 10 and early_end:
                x.kind = "short"
        elif _NOTICE.search(t) and len(t) <= width - 10 and _COPYRIGHT.match(t):
            x.kind = "short"
    return lines


def _records(src: str, uid: str, text: str, common: frozenset[str]) -> list[tuple]:
    """(src, uid, line, record, key, first, second, interrupts, edge) of a scanned text."""
    lines = sort_lines(text)
    body = [x for x in lines if x.kind == "body"]
    if not body:
        return []
    out: list[tuple] = []
    first, last = body[0].no, body[-1].no
    before: Line | None = None
    after: dict[int, Line] = {}
    nxt: Line | None = None
    for x in reversed(lines):
        if nxt:
            after[x.no] = nxt
        if x.kind == "body":
            nxt = x
    counts = Counter(x.fold for x in lines if x.kind == "short")
    opened: dict[int, str] = {}
    for i, x in enumerate(lines):
        follow = after.get(x.no)
        if x.kind == "number":
            out.append((src, uid, x.no, "number", "", "", "", False, True))
        elif x.kind == "short":
            cut = bool(before and follow and (not _TERMINAL.search(before.text) and not before.text.endswith("?") or follow.text[:1].islower()))
            beside = any(0 <= j < len(lines) and (lines[j].kind == "number" or lines[j].ff) for j in (i - 1, i + 1)) or x.ff
            plain = bool(_RUNNING.search(x.text))
            edge = plain or x.no < first or x.no > last or beside or counts[x.fold] > 1
            out.append((src, uid, x.no, "short", x.fold, "", "", cut, edge))
        elif x.kind == "body":
            end = x.text[-1]
            if end in HYPHENS and follow and len(x.text) > 1:
                left = x.text.split()[-1].rstrip(HYPHENS)
                right = follow.text.split()[0]
                a, b = left.strip(_TOKEN_EDGE).lower(), right.rstrip(_TOKEN_EDGE).lower()
                if a and b:
                    out.append((src, uid, x.no, "hyphen", a + b, f"{a}-{b}", "soft" if end != "-" else "plain", False, False))
                    opened[follow.no] = b
            before = x
        if x.kind in ("body", "short") and x.text:
            words = x.text.split()
            if x.kind == "body" and x.text[-1] in HYPHENS:
                words = words[:-1]
            if x.no in opened:
                words = words[1:]
            for w in words:
                t = w.strip(_TOKEN_EDGE).lower()
                if t and t not in common and any(map(str.isalpha, t)):
                    out.append((src, uid, x.no, "word", t, x.kind, "", False, False))
    return out


_RECORD = "src_table string, uid string, line_no int, record string, key string, first string, second string, interrupts boolean, edge boolean"


def confusion_table(spark: SparkSession) -> DataFrame:
    """Fixed table of confusions with the difference each makes to the anagram hash."""
    df = spark.createDataFrame(sorted(set(CONFUSIONS)), "wrong string, correct string")
    return df.withColumn("delta", anagram_hash(F.col("wrong")) - anagram_hash(F.col("correct")))


def anagram_hash(word):
    """Sum of the fifth powers of a word's character codes (codes folded below 1009 to stay within 64 bits)."""
    return F.aggregate(
        F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(F.pow(F.ascii(c) % 1009, F.lit(5)).cast("long"), F.lit(0))
    )


def vocabulary(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` over all texts; words at a broken line end are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                lines = text.split("\n")
                skip = False
                for line in lines:
                    words = line.split()
                    if not words:
                        continue
                    broken = words[-1][-1] in HYPHENS
                    found.update(t for w in words[1 if skip else 0 : len(words) - broken] if (t := w.strip(_TOKEN_EDGE).lower()) and any(map(str.isalpha, t)))
                    skip = broken
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"]
            )

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corrections(words: DataFrame) -> DataFrame:
    """``wrong``, ``right``: rare words and the frequent variant they are read from, the most frequent of several."""
    hashed = words.where(F.length("word") >= 3).withColumn("h", anagram_hash(F.col("word")))
    table = F.broadcast(confusion_table(words.sparkSession))
    rare = hashed.join(table, F.expr("instr(word, wrong) > 0")).select(
        F.col("word").alias("bad"), F.col("n").alias("n_bad"), "wrong", "correct", (F.col("h") - F.col("delta")).alias("h")
    )
    usual = (F.col("n_good") >= LEAST) & (F.col("n_good") >= RATIO * F.col("n_bad"))
    signed = F.col("bad").rlike(SIGNED) & ~F.col("good").rlike(SIGNED) & (F.col("n_good") >= SIGN_RATIO * F.col("n_bad"))
    frequent = hashed.where(F.col("n") >= SIGN_LEAST).select(F.col("word").alias("good"), F.col("n").alias("n_good"), "h")
    # Same hash means same letters but for the confusion; the place has to be right as well.
    places = F.filter(F.sequence(F.lit(1), F.length("bad")), lambda i: F.col("bad").substr(i, F.length("wrong")) == F.col("wrong"))
    mended = F.transform(
        places,
        lambda i: F.concat(F.col("bad").substr(F.lit(1), i - 1), F.col("correct"), F.col("bad").substr(i + F.length("wrong"), F.length("bad"))),
    )
    best = Window.partitionBy("bad").orderBy(F.desc("n_good"), "good")
    return (
        rare.join(frequent, "h")
        .where((usual | signed) & F.array_contains(mended, F.col("good")))
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select(F.col("bad").alias("wrong"), F.col("good").alias("right"))
    )


def _texts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables, each key once (of differing texts the greatest)."""
    out = None
    for name, df in tables.items():
        one = (
            df.where("uid is not null and full_text is not null")
            .groupBy(F.col("uid").cast("string").alias("uid"))
            .agg(F.max("full_text").alias("full_text"))
            .select(F.lit(name).alias("src_table"), "uid", "full_text")
        )
        out = one if out is None else out.unionByName(one)
    return out


def scan_noise(tables: dict[str, DataFrame], min_docs: int = 4, share: float = 0.25, edge_share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Noise of scanned texts and the corrections of misread words.

    ``tables`` maps a name to rows with ``uid`` and ``full_text``. Noise: ``src_table``,
    ``uid``, ``line_no`` (from 0), ``noise_kind``, one row each. NULL texts and keys are
    left out; texts that aren't broken at a page's width have no noise.

    Short lines are furniture if lines of their wording interrupt a sentence in at least
    ``share`` of ``min_docs`` or more texts, or stand at page edges in ``edge_share`` of them, or, where the wording is seen less often, if
    they interrupt one themselves or stand at a page's edge.
    """
    texts = checkpoint(_texts(tables))
    words = checkpoint(vocabulary(texts.select("full_text")))
    fixes = checkpoint(corrections(words))
    top = words.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).join(fixes.select(F.col("wrong").alias("word")), "word", "left_anti")
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(r.word for r in top.select("word").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for src, uid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_scanned(text):
                    rows += _records(src, uid, text, common)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])

    rec = checkpoint(texts.mapInArrow(run, _RECORD))
    at = ["src_table", "uid", "line_no"]

    short = rec.where("record = 'short'")
    wording = short.groupBy("key").agg(
        F.count_distinct("uid").alias("docs"), F.avg(F.col("interrupts").cast("int")).alias("cuts"), F.avg(F.col("edge").cast("int")).alias("edges")
    )
    judged = short.join(wording, "key")
    known = F.col("docs") >= min_docs
    usual = (F.col("cuts") >= share) | (F.col("edges") >= edge_share)
    furniture = judged.where(F.when(known, usual).otherwise(F.col("interrupts") | F.col("edge")))
    headings = judged.join(furniture.select(*at), at, "left_anti")

    breaks = rec.where("record = 'hyphen'")
    count = words.select(F.col("word"), "n")
    breaks = breaks.join(count.withColumnRenamed("word", "key").withColumnRenamed("n", "n_joined"), "key", "left")
    breaks = breaks.join(count.withColumnRenamed("word", "first").withColumnRenamed("n", "n_compound"), "first", "left")
    breaks = breaks.where(F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_compound", F.lit(0)))

    misread = rec.where("record = 'word'").join(fixes.select(F.col("wrong").alias("key")), "key", "left_semi")
    running = misread.where("first = 'body'").select(*at).unionByName(
        misread.where("first = 'short'").select(*at).join(headings.select(*at), at, "left_semi")
    )
    noise = (
        furniture.select(*at, F.lit("running_header").alias("noise_kind"))
        .unionByName(rec.where("record = 'number'").select(*at, F.lit("page_number").alias("noise_kind")))
        .unionByName(breaks.select(*at, F.lit("hyphen_break").alias("noise_kind")))
        .unionByName(running.select(*at, F.lit("misread").alias("noise_kind")))
        .distinct()
    )
    return noise, fixes


def repair_texts(tables: dict[str, DataFrame]) -> DataFrame:
    """Repaired texts: ``src_table``, ``uid``, ``text``, ``n_changes``.

    Furniture is dropped, broken words are joined, misread words replaced (their case
    kept) and lines run together into paragraphs. Texts without noise stay as they are.
    """
    noise, fixes = scan_noise(tables)
    noise = checkpoint(noise)
    texts = _texts(tables)

    def bad_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (s, u, n, t)
                for s, u, text, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for all_ in [text.split("\n")]
                for n in lines
                for t in tokens(all_[n])
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())],
                names=["src_table", "uid", "line_no", "wrong"],
            )

    at = ["src_table", "uid"]
    per_text = noise.groupBy(*at).agg(F.collect_list(F.struct("line_no", "noise_kind")).alias("noise"))  # bounded by a text's lines
    misread_at = noise.where("noise_kind = 'misread'").groupBy(*at).agg(F.collect_set("line_no").alias("lines"))
    found = texts.join(misread_at, at).mapInArrow(bad_words, "src_table string, uid string, line_no int, wrong string")
    swaps = found.join(fixes, "wrong").groupBy(*at).agg(F.collect_set(F.struct("line_no", "wrong", "right")).alias("swaps"))
    whole = texts.join(per_text, at, "left").join(swaps, at, "left").select(*at, "full_text", "noise", "swaps")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, u, *_mended(t, noise_, swaps_)) for s, u, t, noise_, swaps_ in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())],
                names=["src_table", "uid", "text", "n_changes"],
            )

    return whole.mapInArrow(mend, "src_table string, uid string, text string, n_changes int")


def _mended(text: str, noise: list[dict] | None, swaps: list[dict] | None) -> tuple[str, int]:
    if not is_scanned(text):
        return text, 0
    kinds: dict[int, set[str]] = {}
    for x in noise or []:
        kinds.setdefault(x["line_no"], set()).add(x["noise_kind"])
    right = {(x["line_no"], x["wrong"]): x["right"] for x in swaps or []}
    paragraphs: list[str] = []
    current, open_word = "", False
    for line in sort_lines(text):
        mine = kinds.get(line.no, set())
        if mine & {"running_header", "page_number"}:
            continue
        if line.kind == "blank":
            # A blank line ends a paragraph only after a finished sentence; page breaks leave others.
            if current and not open_word and (_TERMINAL.search(current) or current.endswith("?")):
                paragraphs.append(current)
                current = ""
            continue
        words = []
        for w in line.text.split():
            core = w.strip(_TOKEN_EDGE)
            good = right.get((line.no, core.lower())) if core else None
            if good:
                good = good.upper() if core.isupper() and len(core) > 1 else good.capitalize() if core[0].isupper() or core[0].isdigit() and not current else good
                w = w.replace(core, good)
            words.append(w)
        joined = " ".join(words)
        if line.kind in ("short", "table"):
            if current:
                paragraphs.append(current)
            paragraphs.append(joined)
            current = ""
            continue
        current = current + joined if open_word else f"{current} {joined}".strip()
        open_word = False
        if joined[-1] in HYPHENS:
            open_word = True
            if "hyphen_break" in mine:
                current = current[:-1]
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs), sum(map(len, kinds.values()))
