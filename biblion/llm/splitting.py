"""Problem 3: splitting oversized items at natural boundaries by agglomerative merging.

An item is cut into atomic units at the finest level that its limit needs; adjacent
pieces then wait in a heap, weakest boundary first, and merge while the merged piece
plus the overlap fits the limit. What remains are cuts at the strongest boundaries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "sentence", "word", "none")
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "al approx assoc bzgl bzw ca cf ch cp dept dipl dr ed eds eg e.g eq eqs et etc evtl exp fig figs ggf hr i.e ie inc jr jun lic ltd max min mr "
    "mrs ms mt nr no nos op p pp p.ej ph.d prof ref refs resp s.a sec sect sen sog sr sra st tab tabs u.a univ usw vgl viz vol vols vs z.b zz"
).split()
_BLANK_LINE = regex.compile(r"\n[ \t\r\f\v]*(?:\n[ \t\r\f\v]*)+")
_END = regex.compile(r"(?:\p{Sentence_Terminal}|[.!?…])+[\"'”’»)\]」』]*")
_WORDS = regex.compile(r"\s+")
_SHORT = frozenset(ABBREVIATIONS)
_LAST_WORD = regex.compile(r"[\p{L}.]+$")


def paragraph_cuts(text: str) -> list[int]:
    """Places between blocks: the end of each run of blank lines."""
    return [m.end() for m in _BLANK_LINE.finditer(text) if 0 < m.start() and m.end() < len(text)]


def sentence_cuts(text: str, start: int = 0, end: int | None = None) -> list[int]:
    """Places after sentences.

    Marks of scripts that write no blanks end a sentence by themselves; . ! ? … need a
    blank or the end after them. A full stop after an abbreviation or a single letter
    ends none.
    """
    end = len(text) if end is None else end
    out = []
    for m in _END.finditer(text, start, end):
        stop, mark = m.end(), m[0]
        if mark[0] in ".!?…":
            if stop < end and not text[stop].isspace():
                continue
            if mark[0] == "." and not mark.startswith(".."):
                word = _LAST_WORD.search(text, max(start, m.start() - 24), m.start())
                if word:
                    last = word[0].lower()
                    if last in _SHORT or len(last) == 1 and word[0].isupper() or regex.fullmatch(r"(?:\p{L}\.)+\p{L}", last):
                        continue
        while stop < end and text[stop].isspace():
            stop += 1
        if start < stop < end:
            out.append(stop)
    return out


def word_cuts(text: str, start: int, end: int) -> list[int]:
    return [m.end() for m in _WORDS.finditer(text, start, end) if start < m.end() < end and m.start() > start]


def _longest(text: str, cuts: list[int], start: int, end: int) -> int:
    """Characters of the longest unit, blanks around it not counted."""
    edges = [start, *cuts, end]
    return max((len(text[a:b].strip()) for a, b in zip(edges, edges[1:], strict=False)), default=0)


def cut_level(text: str, max_chars: int, overlap: int) -> str:
    """The first level at which every unit has at most ``max_chars - overlap`` characters: what the pieces' weakest cut has to be."""
    room = max_chars - overlap
    blocks = [0, *paragraph_cuts(text), len(text)]
    spans = list(zip(blocks, blocks[1:], strict=False))
    if _longest(text, blocks[1:-1], 0, len(text)) <= room:
        return "paragraph"
    if all(_longest(text, sentence_cuts(text, a, b), a, b) <= room for a, b in spans):
        return "sentence"
    return "word" if _longest(text, word_cuts(text, 0, len(text)), 0, len(text)) <= room else "none"


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as (start, end), in order; see ``cut_pieces``."""
    return [(a, b) for a, b, _ in cut_pieces(text, max_chars, overlap)]


def cut_pieces(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as (start, end, strength of the cut before it), in order.

    Every piece has at most ``max_chars`` characters and each but the first begins
    exactly ``overlap`` characters before the one before it ends. The pieces without
    their overlaps are the text, character by character. Strengths: 4 between blocks, 3
    between sentences, 2 between words, 1 inside a word; 5 before the first piece. A
    weaker cut is made only inside a unit that no piece can hold, so the weakest cut
    tells the level the text needs. An overlap of more than half the limit counts as
    half of it.
    """
    if len(text) <= max_chars:
        return [(0, len(text), 5)]
    overlap = max(0, min(overlap, max_chars // 2))
    room = max(1, max_chars - overlap)
    strength: dict[int, int] = {}
    edges = [0]

    def fits(start: int, end: int, mark: int) -> bool:
        """Whether a unit is no longer than a piece, blanks around it not counted; blanks that are too many are cut off with the unit's own strength."""
        core = text[start:end].rstrip()
        if len(core.lstrip()) > room:
            return False
        if end - start > room:
            first = start + len(core) - len(core.lstrip())
            for at in sorted({first, start + len(core), *range(start + room, first, room), *range(start + len(core) + room, end, room)}):
                if start < at < end:
                    strength[at] = mark
                    edges.append(at)
        return True

    blocks = [0, *paragraph_cuts(text), len(text)]
    for a, b in zip(blocks, blocks[1:], strict=False):
        strength[a] = 4
        edges.append(a)
        if fits(a, b, 4):
            continue
        sentences = [a, *sentence_cuts(text, a, b), b]
        for c, d in zip(sentences, sentences[1:], strict=False):
            if c > a:
                strength[c] = 3
                edges.append(c)
            if fits(c, d, 3):
                continue
            words = [c, *word_cuts(text, c, d), d]
            for e, f in zip(words, words[1:], strict=False):
                if e > c:
                    strength[e] = 2
                    edges.append(e)
                if fits(e, f, 2):
                    continue
                for g in range(e + room, f, room):
                    strength[g] = 1
                    edges.append(g)
    edges = sorted({*edges, len(text)})
    # Pieces as a linked list over their left edges; merging drops the edge between two.
    nxt = dict(zip(edges, edges[1:], strict=False))
    prv = {b: a for a, b in nxt.items()}
    alive = set(edges)
    heap = []

    def offer(mid: int) -> None:
        left, right = prv[mid], nxt[mid]
        if right - left <= room:
            heapq.heappush(heap, (strength[mid], right - left, mid, left, right))

    for mid in edges[1:-1]:
        offer(mid)
    while heap:
        _, _, mid, left, right = heapq.heappop(heap)
        if mid not in alive or prv[mid] != left or nxt[mid] != right:
            continue
        alive.discard(mid)
        nxt[left], prv[right] = right, left
        if left != 0:
            offer(left)
        if right != len(text):
            offer(right)
    kept = sorted(alive)
    return [(max(0, a - overlap) if a else 0, b, strength[a] if a else 5) for a, b in zip(kept, kept[1:], strict=False)]


def split_items(items: DataFrame, key: str, text: str, section: str | None, limits: DataFrame, item_table: str) -> DataFrame:
    """Pieces of every item, oversized or not.

    Columns: ``item_table``, ``item_key`` (as text), ``piece_no`` from 0, ``n_pieces``,
    ``start`` and ``end`` (characters), ``content``, ``section`` (the item's, kept on
    each piece), ``cut_level`` (NULL for items within the limit).

    ``limits`` is the fixed table of limits; the row for ``item_table`` and ``text``
    applies. Items with NULL text or key give no rows, empty ones one empty piece; a
    key that repeats counts once, by its greatest text.
    """
    row = limits.where((F.col("item_table") == item_table) & (F.col("text_column") == text)).select("max_chars", "overlap_chars").first()
    if row is None:
        raise ValueError(f"no limit for {item_table}.{text}")
    max_chars, overlap = row
    own = F.col(section) if section else F.lit(None).cast("string")
    once = (
        items.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key).cast("string").alias("item_key"), F.struct(F.col(text).alias("t"), own.alias("s")).alias("v"))
        .groupBy("item_key")
        .agg(F.max("v").alias("v"))
        .select("item_key", F.col("v.t").alias("text"), F.col("v.s").alias("section"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, t, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = cut_pieces(t, max_chars, overlap)
                weakest = min(x for _, _, x in pieces)
                level = LEVELS[4 - weakest] if weakest < 5 else None
                rows += [(item_table, k, i, len(pieces), a, b, t[a:b], s, level) for i, (a, b, _) in enumerate(pieces)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["item_table", "item_key", "piece_no", "n_pieces", "start", "end", "content", "section", "cut_level"],
            )

    return once.mapInArrow(
        run,
        "item_table string, item_key string, piece_no int, n_pieces int, start int, end int, content string, section string, cut_level string",
    )


def oversized(pieces: DataFrame) -> DataFrame:
    """Items above their limit and the level their cuts need: that of the weakest cut between their pieces."""
    return pieces.where(F.col("cut_level").isNotNull() & (F.col("piece_no") == 0)).select("item_table", "item_key", "cut_level")
