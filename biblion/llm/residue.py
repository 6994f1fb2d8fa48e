"""Problem 10: template residue and error-page text.

Both signals come from aligning records of the same template over the whole corpus; one
pass over the texts feeds both.

* Slots. Records that share the words around a slot are aligned. Where what stands
  there varies between them, it is a slot; it is unfilled if it still holds a variable
  name, that is a name seen in several bracket styles, or a blank. A bracket that never
  varies between unlike records of one template is part of the sentence (a text that
  writes about templates) and no slot.
* Whole pages. Segments (lines and sentences, digits masked) that recur over unlike
  short records and keep out of long ones are the templates of error pages, notices and
  filler. What words these have is learnt from the corpus, so that a template's text is
  also known where its slots are filled in a way seen once; lists of wordings only tip
  the balance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblion.session import checkpoint

# Wording of notices and filler; it only tips the balance where the corpus is undecided.
SCRIPT_NOTICE = [
    r"java ?script", r"\bscripts?\b", r"\bscripting\b", r"\bcookies?\b", r"자바스크립트", r"스크립트", r"ジャバスクリプト|スクリプト",
]
ERROR_PAGE = [
    r"^(?:http|status|error|erreur|fehler|código)[: ]+(?:code )?#", r"\berror #", r"\b(?:not found|bad gateway|bad request|forbidden|gateway time-?out|too many requests|internal server error|service unavailable|unauthorized|access denied|request timeout)\b",
    r"^# gone\b", r"^traceback \(most recent", r"^error\b", r"^erreur\b", r"^fehler\b", r"오류", r"database connection", r"upstream", r"session has expired", r"maintenance", r"wartungsarbeiten", r"mantenimiento", r"점검 중",
    r"unavailable|no longer available|nicht erreichbar|nicht verfügbar|no disponible|indisponible|introuvable|nicht gefunden|no se ha encontrado",
    r"took too long|failed to load|cannot be reached|could not be loaded|has been removed|temporarily offline|timed out",
    r"don't have permission|no permission|permission to access|접근 권한|찾을 수 없습니다|acceso denegado|accès refusé|zugriff verweigert|captcha|verify (?:that )?you are human",
]
FILLER = [
    r"lorem ipsum", r"\btodo\b", r"\btbd\b", r"\bfixme\b", r"\bx{3,}\b", r"\bgoes here\b", r"\b(?:copy|headline|text|title|content|summary|abstract) here\b", r"\binsert text\b", r"\bsample text\b", r"\bsummary text\b", r"\bdummy\b", r"\bplaceholder (?:text|copy)\b",
    r"^<?add (?:key|#)", r"description pending", r"start writing here", r"to be supplied", r"replace this paragraph", r"before release", r"only here to show", r"\b(\w{2,})(?:[ ,]+\1){2,}", r"more words", r"blindtext", r"faux texte", r"texto de relleno", r"내용을 입력", r"자리만 채우",
]
# Short sentences that go with a notice and say nothing of their own.
COMPANION = [
    r"\btry again\b", r"^(?:please )?(?:go back|return to|sign in|log in|contact (?:the|our|us)|check the address|reload|refresh)\b", r"\bwe apologi[sz]e\b", r"\bback by\b.*$", r"^thank you for your patience",
    r"réessayer|veuillez réessayer", r"versuchen sie es", r"inténtelo de nuevo|vuelva a intentarlo", r"다시 (?:시도|이용)",
]
#: Words of dummy Latin; a segment made of them is filler.
DUMMY_LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim est laborum vestibulum vivamus tincidunt pharetra faucibus"
).split()
#: Bracket styles of template languages: name -> pattern with the field's name as its group.
STYLES = {
    "mustache": r"\{\{\s*([\w.\- ]{1,40}?)\s*\}\}",
    "shell": r"\$\{\s*([\w.\- ]{1,40}?)\s*\}",
    "brace": r"(?<![{$\\\w_])\{([\w.\- ,]{1,40}?)\}(?!\})",
    "erb": r"<%=?\s*([\w.\- ]{1,40}?)\s*%>",
    "jinja": r"\{%\s*([\w.\- ]{1,40}?)\s*%\}",
    "your": r"\[your ([\w.\- ]{1,40}?) here\]",
    "insert": r"\[insert ([\w.\- ]{1,40}?)(?: here)?\]",
    "at": r"@@\s*([\w.\- ]{1,40}?)\s*@@",
    "percent": r"%([a-z_][\w.]{1,40}?)%",
    "hash": r"(?<!#)#([a-z_][\w.]{1,40}?)#",
    "angles": r"<<\s*([\w.\- ]{1,40}?)\s*>>",
    "angle": r"(?<!<)<([a-z_][\w.\- ]{0,40}?)>(?!>)",
    "wiki": r"\[\[([\w.\- ]{1,40}?)\]\]",
    "bracket": r"(?<!\[)\[([a-z_][\w.\- ]{1,40}?)\](?!\])",
    "under": r"(?<!\w)__([a-z][\w.]*?)__(?!\w)",
}
#: Blanks that stand where a value should.
BLANK = r"_{4,}|\[\s*\]|\{\s*\}|<\s*>|(?:\. ?){6,}"
#: What a text must hold for a style to occur in it: signs and how often.
_NEEDS = {
    "mustache": ("{{", 1), "shell": ("${", 1), "brace": ("{", 1), "erb": ("<%", 1), "jinja": ("{%", 1), "your": ("[", 1), "insert": ("[", 1), "at": ("@@", 2),
    "percent": ("%", 2), "hash": ("#", 2), "angles": ("<<", 1), "angle": ("<", 1), "wiki": ("[[", 1), "bracket": ("[", 1), "under": ("__", 2),
}
_STYLES = [(name, *_NEEDS[name], regex.compile(p, regex.I)) for name, p in STYLES.items()]
_BLANK, _RUNS = regex.compile(BLANK), regex.compile(r"\S+")
_MAY_HOLD = regex.compile(r"[{}<>\[\]@%#_]|\. ?\. ?\. ?\.")


def slots(text: str) -> list[tuple[str, str, str, str]]:
    """(style, name, words around, opening of the record) of each bracket and blank."""
    if not _MAY_HOLD.search(text):
        return []
    spans: dict[tuple[int, int], tuple[str, str]] = {}
    for style, sign, times, pattern in _STYLES:
        if sign not in text or times > 1 and text.count(sign) < times:
            continue
        for m in pattern.finditer(text):
            if not any(a <= m.start() < b for a, b in spans):
                spans[m.span()] = (style, m[1].lower().strip())
    for m in _BLANK.finditer(text):
        if not any(a <= m.start() < b for a, b in spans):
            spans[m.span()] = ("blank", "")
    if not spans:
        return []
    marked, at, end, size = [], [], 0, 0
    for (a, b), found in sorted(spans.items()):
        marked += [text[end:a], " \u0001 "]
        at.append((size + a - end, found))
        size += a - end + 3
        end = b
    flat = "".join([*marked, text[end:]])
    first = " ".join(_RUNS.findall(flat[:400])[:6]).lower()
    out = []
    for place, (style, name) in at:
        before = _RUNS.findall(flat[max(0, place - 80) : place])[-3:]
        after = _RUNS.findall(flat[place + 3 : place + 83])[:2]
        out.append((style, name, " ".join([*before, "\u0002", *after]).lower(), first))
    return out


def unfilled_fields(scan: DataFrame, min_styles: int = 3, min_records: int = 5) -> DataFrame:
    """Documents with a slot that still holds a variable name or a blank: ``doc_id`` once each.

    A name counts as a variable's if it occurs in ``min_styles`` bracket styles or more.
    Where the content is the same in all of at least ``min_records`` records with
    different openings and the same words around, it is text and no slot; a blank
    counts only where records of the same template show that a name belongs there.
    """
    found = scan.where("rec = 'slot'").select("doc_id", "style", "name", "context", "opening")
    names = found.where("style <> 'blank'").groupBy("name").agg(F.count_distinct("style").alias("n")).where(F.col("n") >= min_styles).select("name")
    aligned = found.groupBy("context", "opening").agg(
        F.min(F.struct("style", "name")).alias("a"), F.max(F.struct("style", "name")).alias("b"), F.max("name").alias("name")
    ).groupBy("context").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("name").alias("name"), F.count(F.lit(1)).alias("n"))
    literal = aligned.where((F.col("a") == F.col("b")) & (F.col("n") >= min_records)).select("context")
    held = found.where("style <> 'blank'").join(names, "name", "left_semi").join(literal, "context", "left_anti")
    of_names = aligned.where("name <> ''").join(names, "name", "left_semi").select("context")
    blank = found.where("style = 'blank'").join(of_names, "context", "left_semi").join(literal, "context", "left_anti")
    return held.select("doc_id").unionByName(blank.select("doc_id")).distinct()


_TAGS = re.compile(r"</?(?:html|head|body|h[1-6]|p|div|span|br|title|center)\b[^>]*>", re.I)
_PARTS = re.compile(r"\n|(?<=[.!?。！？…])\s+")
_DIGITS = re.compile(r"\d+")
_PROSE = re.compile(r"(?:[.!。！…][\"'”’)\]]*|\[#\]\.?)$")
_WORD = re.compile(r"[가-힣]{1,2}|[^\W\d_]+|[^\s\w]|[\d_]+")
# Rows of keys; words typed along them, or such a run twice, are no words.
KEY_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz"]
#: A record of so many segments or fewer is short.
SHORT = 4
#: Buckets in which words, pairs and triples of words are counted; this bounds what is collected and broadcast.
BUCKETS = 1 << 20
_LATIN = frozenset(DUMMY_LATIN)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@lru_cache(200_000)
def _mashed(word: str) -> bool:
    half = word[: len(word) // 2]
    run = half if half and word == half * 2 else word
    return len(word) > 1 and len(set(word)) == 1 or word == "#" or len(run) > 1 and any(run in row for row in KEY_ROWS)


def _masked(text: str) -> str:
    return _DIGITS.sub("#", text.lower()).strip()


def _mostly(words: list[str], test: Callable[[str], bool]) -> bool:
    """Whether four in five words pass, given up as soon as they can't."""
    left = len(words) // 5
    for w in words:
        if not test(w):
            left -= 1
            if left < 0:
                return False
    return True


def _typed(segment: str) -> str:
    """Words typed along the keys and dummy Latin have no wording of their own: such segments are all alike."""
    raw = segment.split()
    if len(raw) >= 3 and _mostly(raw, _mashed) and any(set(w) != {"#"} for w in raw) or raw and _mostly(raw, lambda w: w.strip(".,;:!?") in _LATIN):
        return "~ ~ ~."
    return segment


def each_segment(text: str, title: str | None = None) -> Iterator[str]:
    """Lines and sentences in order, in lower case, digits masked, without tags and the record's own title; worked out one by one."""
    own = _masked(title or "")
    if "<" in text:
        text = _TAGS.sub("\n", text)
    at = 0
    for m in _PARTS.finditer(text):
        if (x := _masked(text[at : m.start()])) and x != own:
            yield _typed(x)
        at = m.end()
    if (x := _masked(text[at:])) and x != own:
        yield _typed(x)


def segments(text: str, title: str | None = None) -> list[str]:
    """Distinct segments."""
    return list(dict.fromkeys(each_segment(text, title)))


def is_sentence(segment: str) -> bool:
    return len(segment) > 2 and bool(_PROSE.search(segment))


class Words:
    """Buckets of a segment's words, pairs and triples of words, its edges included."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def buckets(self, segment: str) -> np.ndarray:
        ids = []
        if len(self.known) > 200_000:  # a cache only
            self.known.clear()
        for w in ("^", *_WORD.findall(segment), "$"):
            h = self.known.get(w)
            if h is None:
                h = self.known[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        h = np.array(ids, np.uint64)
        two = h[:-1] * _A + (h[1:] ^ (h[1:] >> np.uint64(31))) * _B
        three = two[:-1] * _C + h[2:] * _A if len(h) > 2 else two[:0]
        return (np.concatenate([h[1:-1], two, three]) >> np.uint64(44)).astype(np.int64)


_CUES = regex.compile("|".join([*SCRIPT_NOTICE, *ERROR_PAGE, *FILLER, *COMPANION]))


def hinted(segment: str) -> bool:
    """Whether a segment has the wording of notices, companions of theirs, or filler."""
    return bool(_CUES.search(segment))


def hash_of_set(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(parts))) - 2**63


_SCHEMA = "rec string, doc_id long, style string, name string, context string, opening string, page long, segs array<string>, bucket int, n long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass for both halves: slots, short records, and in how many long records a bucket occurs."""
    words = Words()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int64()]
    for batch in batches:
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        for doc, text, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [("slot", doc, *x, None, None, None, None) for x in slots(text)]
            parts = segments(text, title)
            if len(parts) > SHORT:
                held.append(np.unique(np.concatenate([words.buckets(x) for x in parts])))
            elif parts:
                rows.append(("short", doc, None, None, None, None, hash_of_set(parts), parts, None, None))
        if held:
            flat, n = np.unique(np.concatenate(held), return_counts=True)
            rows += [("long", None, None, None, None, None, None, None, b, k) for b, k in zip(flat.tolist(), n.tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def scanned(docs: DataFrame) -> DataFrame:
    return checkpoint(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "title").mapInArrow(_scan, _SCHEMA))


class PageModel:
    """How much likelier a segment's words are in page templates than in content, by the company their records keep.

    ``odds`` has the logarithm of a bucket's odds, 0 where it tells nothing; ``seen``
    whether the corpus has it, ``again`` whether it recurs over unlike short records.
    """

    def __init__(self, odds: np.ndarray, seen: np.ndarray, again: np.ndarray):
        self.odds, self.seen, self.again = odds, seen, again
        self.words, self.known = Words(), {}

    @classmethod
    def of(cls, short: np.ndarray, long_: np.ndarray, min_pages: int) -> PageModel:
        """From the number of unlike short and of long records of each bucket.

        The share of short records over all buckets is the prior of both counts, so that
        a bucket of few records tells little; buckets of fewer than ``min_pages`` short
        records are no evidence for a template.
        """
        share = min(0.9, max(1e-3, short.sum() / max(1, short.sum() + long_.sum())))
        prior = 2.0
        odds = np.log((short + prior * share) / (long_ + prior * (1 - share))) - math.log(share / (1 - share))
        again = short >= min_pages
        return cls(np.where(again, odds, np.minimum(odds, 0)).astype(np.float32), short + long_ > 0, again)

    def score(self, segment: str) -> tuple[float, float]:
        """Mean logarithm of the odds over what is seen of a segment's words, pairs and triples, and the share of its words that recurs."""
        got = self.known.get(segment)
        if got is None:
            if len(self.known) > 200_000:  # a cache only
                self.known.clear()
            b = self.words.buckets(segment)
            n = max(1, (len(b) - 1) // 3)  # n words come first, then n + 1 pairs and n triples
            got = self.known[segment] = (float(self.odds[b].sum() / max(1, self.seen[b].sum())), float(self.again[b[:n]].mean()))
        return got


def _counted(records: DataFrame, into: str) -> DataFrame:
    """``bucket`` and in how many of the records (arrays of segments) it occurs, as column ``into``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            held = [np.unique(np.concatenate([words.buckets(x) for x in parts])) for parts in batch.column(0).to_pylist()]
            flat, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(flat.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return records.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(into))


def _dense(counts: DataFrame, column: str) -> np.ndarray:
    """Counts by bucket: at most ``BUCKETS`` rows are collected."""
    got = counts.toArrow()
    out = np.zeros(BUCKETS)
    out[got.column("bucket").to_numpy()] = got.column(column).to_numpy()
    return out


def residue_pages(docs: DataFrame, scan: DataFrame, min_pages: int = 3, odds: float = 0.7, hint: float = 0.4, share: float = 0.5, rounds: int = 2) -> DataFrame:
    """Documents that are nothing but a page template's text: ``doc_id`` and ``kind``.

    A segment is a template's if what is seen of its words, pairs and triples of words
    is on average ``odds`` (logarithm) likelier in templates than in content, and a
    ``share`` of its words recurs over unlike short records (copies of one record count
    once); wording of notices and filler is worth ``hint``. A document is residue if it has such a segment and no sentence besides. From
    the second round on, long documents found so count with the short ones. Where
    nothing recurs, nothing is residue.
    """
    # Copies of a record are one page.
    pages = scan.where("rec = 'short'").groupBy("page").agg(F.first("segs").alias("segs")).select("segs")
    short, long_ = _dense(_counted(pages, "n"), "n"), _dense(scan.where("rec = 'long'").groupBy("bucket").agg(F.sum("n").alias("n")), "n")
    text = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "title")
    found, moved = None, 0.0
    for _ in range(rounds):
        model = PageModel.of(short + moved, long_ - moved, min_pages)
        shared = docs.sparkSession.sparkContext.broadcast((model.odds, model.seen, model.again))

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = PageModel(*shared.value)
            for batch in batches:
                rows = []
                for doc, text, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    some, parts = False, []
                    for seg in each_segment(text, title):
                        parts.append(seg)
                        mean, again = known.score(seg)
                        template = again >= share and (mean >= odds or mean >= odds - hint and hinted(seg))
                        if not template and is_sentence(seg):
                            break  # a sentence of its own; most texts end the search with their first
                        some |= template
                    else:
                        if some:
                            rows.append((doc, parts if len(set(parts)) > SHORT else None))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.string()))], names=["doc_id", "segs"])

        found = checkpoint(text.mapInArrow(judge, "doc_id long, segs array<string>"))
        moved = _dense(_counted(found.where("segs is not null").select("segs"), "n"), "n")
    return found.select("doc_id").distinct().withColumn("kind", F.lit("page"))


def template_residue(docs: DataFrame, min_pages: int = 3) -> DataFrame:
    """Documents to exclude: ``doc_id``, ``kind`` (field or page), one row each.

    Needs ``doc_id``, ``text`` and ``title``; NULL and empty texts are no residue (there
    is nothing left of a template in them), rows with NULL ids are left out, repeated
    ids count once.
    """
    scan = scanned(docs)
    fields = unfilled_fields(scan).select("doc_id", F.lit("field").alias("kind"))
    pages = residue_pages(docs, scan, min_pages)
    return fields.unionByName(pages).groupBy("doc_id").agg(F.min("kind").alias("kind"))


def without_residue(docs: DataFrame) -> DataFrame:
    """The corpus without residue; all other rows and columns unchanged."""
    return docs.join(template_residue(docs).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
