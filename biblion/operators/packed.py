"""Problem 7: several values packed in one field, split by vectorised byte masks.

The work happens on the value buffer of the Arrow string array, a whole batch at a
time: quote parity and bracket depth are running sums over the bytes, each delimiter is
a mask over the bytes outside quotes and brackets, a field's strongest delimiter is
picked from the masks' sums, and the cuts of all fields together become the child
offsets of one list array, flattened with its parents' ordinals.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackedField:
    """How a field is packed.

    ``person``: values are names, so ``Last, First`` pairs hold together. ``joiners``:
    "and", "&" and "+" part values; set it for fields of roles or names, not for
    fields of topics, whose values contain such words.
    """

    name: str
    person: bool = False
    joiners: bool = True


# Delimiters from the strongest to the weakest; a field is split at its strongest.
_STRONG = [b"\n", b"\t", b"|"]
_WIDE = ["，", "、", "；", "·", "•"]
_JOIN_WORDS = ["and", "und"]


def _runs(buf: np.ndarray, pattern: bytes) -> np.ndarray:
    """Mask of the bytes at which ``pattern`` starts."""
    n, k = len(buf), len(pattern)
    hit = np.zeros(n, bool)
    if n >= k:
        ok = np.ones(n - k + 1, bool)
        for i, b in enumerate(pattern):
            ok &= buf[i : n - k + 1 + i] == b
        hit[: n - k + 1] = ok
    return hit


def _per_row(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[ends] - total[starts]


def _running(step: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sum that begins anew in every row."""
    total = np.cumsum(step)
    before = np.concatenate([[0], total])[starts]
    return total - np.repeat(before, ends - starts)


def split_packed(values: pa.Array, person: bool = False, joiners: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The values packed in each string and the ordinal of the string they came from."""
    values = values.cast(pa.large_string())
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pa.concat_arrays([pc.fill_null(values, "")])
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64, n + 1, values.offset * 8)
    raw = values.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends = offsets[:-1], offsets[1:]
    size = len(buf)
    row = np.repeat(np.arange(n), ends - starts)

    text = pc.utf8_trim_whitespace(values)
    is_json = pc.match_substring_regex(text, r'^\[\s*"[\s\S]*"\s*\]$').to_numpy(zero_copy_only=False)
    slash = np.concatenate([[False], buf[:-1] == 92]) & is_json[row] if size else np.zeros(0, bool)
    quote = (buf == 34) & ~slash
    odd = _per_row(quote, starts, ends) % 2 == 1
    parity = _running(quote & ~odd[row], starts, ends) % 2
    outside = (parity == 0) & ~quote
    opens = ((buf == 40) | ((buf == 91) & ~is_json[row])) & outside
    closes = ((buf == 41) | ((buf == 93) & ~is_json[row])) & outside
    balanced = _per_row(opens, starts, ends) == _per_row(closes, starts, ends)
    depth = _running((opens.astype(np.int64) - closes) * balanced[row], starts, ends)
    free = outside & (depth <= 0)

    # begin/end of each possible cut, by kind of delimiter
    def at(pattern: bytes) -> np.ndarray:
        return _runs(buf, pattern) & free

    comma, semicolon = at(b","), at(b";")
    strong = [at(x) for x in _STRONG]
    wide = [at(x.encode()) for x in _WIDE]
    slashes, plus, amp = at(b"/"), at(b" + "), at(b"&")
    digit = (buf >= 48) & (buf <= 57)
    blank = (buf == 32) | (buf == 9) | (buf == 10)
    before_blank = np.concatenate([[True], blank[:-1]]) if size else blank
    if size:
        before_blank[starts[ends > starts]] = True
    number = digit & before_blank & free
    marked = np.zeros(size, bool)  # "1) " or "12. " at a value's beginning
    for width in (1, 2):
        after = np.zeros(size, bool)
        if size > width + 1:
            after[: size - width - 1] = ((buf[width:-1] == 41) | (buf[width:-1] == 46)) & blank[width + 1 :]
        same = np.ones(size, bool)
        for i in range(1, width):
            same[: size - i] &= digit[i:]
        marked |= number & after & same
    non_blank = ~blank
    seen = _running(non_blank, starts, ends)
    first_char = non_blank & (seen == 1)
    enumerated = np.zeros(n, bool)
    enumerated[row[marked & first_char]] = True

    cut = np.zeros(size, bool)
    width_of = np.ones(size, np.int64)
    open_rows = np.ones(n, bool)

    def take(mask: np.ndarray, width: int, rows: np.ndarray) -> None:
        chosen = mask & rows[row]
        cut[chosen] = True
        width_of[chosen] = width

    def claim(masks: list[tuple[np.ndarray, int]], also: np.ndarray | None = None) -> None:
        """Rows that hold one of the delimiters are split at them and done."""
        nonlocal open_rows
        has = np.zeros(n, bool)
        for mask, _ in masks:
            has |= _per_row(mask, starts, ends) > 0
        has &= open_rows if also is None else open_rows & also
        for mask, width in masks:
            take(mask, width, has)
        open_rows = open_rows & ~has

    claim([(comma, 1)], is_json)
    open_rows &= ~is_json
    claim([(strong[0], 1)])
    claim([(strong[1], 1)])
    claim([(strong[2], 1)])
    claim([(marked & ~first_char, 0)], enumerated)
    open_rows &= ~enumerated
    if person:
        claim([(semicolon, 1), (wide[2], len(_WIDE[2].encode()))])
    else:
        claim([(semicolon, 1), (wide[2], len(_WIDE[2].encode())), (comma, 1)], _per_row(semicolon | wide[2], starts, ends) > 0)
    claim([(m, len(w.encode())) for m, w in zip(wide, _WIDE, strict=True)])
    has_comma = (_per_row(comma, starts, ends) > 0) & open_rows
    named = has_comma.copy()
    take(comma, 1, has_comma)
    open_rows &= ~has_comma
    claim([(slashes, 1)])
    claim([(plus, 3)])
    ends_joined = open_rows | named
    if joiners:
        take(amp, 1, ends_joined)
        for word in _JOIN_WORDS:
            pattern = f" {word} ".encode()
            take(at(pattern), len(pattern), ends_joined)

    where = np.flatnonzero(cut)
    begin = np.concatenate([starts, where + width_of[where]])
    stop_row = np.concatenate([np.arange(n), row[where]])
    order = np.lexsort((begin, stop_row))
    begin, parent = begin[order], stop_row[order]
    stop_at = np.concatenate([where, ends])
    stop = stop_at[np.lexsort((stop_at, np.concatenate([row[where], np.arange(n)])))]
    begin = np.minimum(begin, stop)

    piece = _slices(buf, begin, stop)
    piece = _clean(piece, is_json[parent], joiners)
    if person and named.any():
        piece, parent = _pair_names(piece, parent, named)
    keep = pc.not_equal(piece, "").to_numpy(zero_copy_only=False)
    if person:
        keep &= ~pc.match_substring_regex(piece, r"(?i)^(?:et\.? al\b\.?|and others|others)$").to_numpy(zero_copy_only=False)
    return piece.filter(pa.array(keep)), parent[keep]


def _slices(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Byte ranges as a string array: child offsets over gathered bytes, no loop over values."""
    sizes = stop - begin
    out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    index = np.repeat(begin - out[:-1], sizes) + np.arange(out[-1])
    data = np.ascontiguousarray(buf[index]) if len(index) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(out), pa.py_buffer(data)])


def _clean(piece: pa.Array, from_json: np.ndarray, joiners: bool) -> pa.Array:
    """Values without outer blanks, list marks, joining words and quoting."""
    sub = pc.replace_substring_regex
    piece = pc.utf8_trim_whitespace(piece)
    piece = sub(piece, r"^(?:[-*•–—·]\s+|\(?\d{1,2}[.)]\s+)", "")
    if joiners:
        piece = sub(piece, r"^(?:and |And |und |& ?)", "")
        piece = sub(piece, r"(?: and| &)$", "")
    piece = pc.utf8_trim_whitespace(piece)
    json_piece = pa.array(from_json)
    piece = pc.if_else(json_piece, sub(sub(piece, r"^\[\s*", ""), r"\s*\]$", ""), piece)
    quoted = pc.match_substring_regex(piece, r'^"[\s\S]*"$')
    inner = sub(sub(piece, r'^"', ""), r'"$', "")
    piece = pc.if_else(quoted, pc.if_else(json_piece, inner, pc.replace_substring(inner, '""', '"')), piece)
    piece = sub(piece, r"^[“”«»„](.*)[“”«»‟]$", r"\1")
    escaped = pc.and_(json_piece, pc.match_substring(piece, "\\"))
    if pc.any(escaped).as_py():
        rows = np.flatnonzero(escaped.to_numpy(zero_copy_only=False))
        fixed = [_unescape(piece[int(i)].as_py()) for i in rows]
        piece = pc.replace_with_mask(piece, escaped, pa.array(fixed, pa.large_string()))
    return pc.utf8_trim_whitespace(piece)


def _unescape(text: str) -> str:
    try:
        return json.loads(f'"{text}"')
    except ValueError:
        return text


def _pair_names(piece: pa.Array, parent: np.ndarray, named: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Put ``Last, First`` together where a row's commas part the halves of names.

    A row is of this kind if its pieces (without blanks and et al.) come in pairs and
    each pair has a half of one word, or initials in its second half.
    """
    real = pc.and_(pc.not_equal(piece, ""), pc.invert(pc.match_substring_regex(piece, r"(?i)^et\.? al\b\.?$")))
    real = real.to_numpy(zero_copy_only=False) & named[parent]
    at = np.flatnonzero(real)
    if not len(at):
        return piece, parent
    owner = parent[at]
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    group_start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    ord_ = np.arange(len(at)) - group_start
    counts = np.bincount(owner, minlength=len(named))
    sub = piece.take(pa.array(at))
    one_word = pc.match_substring_regex(sub, r"^\S+$").to_numpy(zero_copy_only=False)
    initials = pc.match_substring_regex(sub, r"^(?:\p{Lu}\p{Ll}?\.?[- ]?){1,4}$").to_numpy(zero_copy_only=False)
    single = np.bincount(owner, weights=one_word & (ord_ % 2 == 0), minlength=len(named))
    second_ok = np.bincount(owner, weights=initials & (ord_ % 2 == 1), minlength=len(named))
    half = counts // 2
    pairs = (counts % 2 == 0) & (counts > 0) & ((single == half) | (second_ok == half)) & (single + second_ok > 0)
    left = pairs[owner] & (ord_ % 2 == 0)
    right = pairs[owner] & (ord_ % 2 == 1)
    if not left.any():
        return piece, parent
    both = pc.binary_join_element_wise(sub.filter(pa.array(left)), sub.filter(pa.array(right)), pa.scalar(", ", pa.large_string()))
    mask = np.zeros(len(piece), bool)
    mask[at[left]] = True
    piece = pc.replace_with_mask(piece, pa.array(mask), both)
    keep = np.ones(len(piece), bool)
    keep[at[right]] = False
    return piece.filter(pa.array(keep)), parent[keep]


def explode_packed(df: DataFrame, key: str, fields: list[PackedField], min_values: int = 1) -> DataFrame:
    """One row per value: ``key``, ``field_name``, ``ord`` from 1, ``val``.

    Keys that repeat count once; of differing texts under one key the greatest is
    taken. NULL and blank fields and NULL keys give no rows. ``min_values`` drops
    fields with fewer values. Columns besides the key and the fields are not read.
    """
    names = [f.name for f in fields]
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("__key")).agg(*[F.max(x).alias(x) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, field in enumerate(fields):
                vals, parent = split_packed(batch.column(i + 1), field.person, field.joiners)
                new = np.concatenate([[True], parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, bool)
                first = np.maximum.accumulate(np.where(new, np.arange(len(parent)), 0)) if len(parent) else parent
                ordinal = np.arange(len(parent)) - first + 1
                enough = np.bincount(parent, minlength=batch.num_rows)[parent] >= min_values if len(parent) else new
                pick = pa.array(np.flatnonzero(enough))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(parent[enough])).cast(pa.string()),
                        pa.array([field.name] * len(pick), pa.string()),
                        pa.array(ordinal[enough], pa.int32()),
                        vals.take(pick).cast(pa.string()),
                    ],
                    names=["key", "field_name", "ord", "val"],
                )

    return once.mapInArrow(run, "key string, field_name string, ord int, val string").withColumnRenamed("key", key)


ARTICLE_FIELDS = [
    PackedField("authors", person=True),
    PackedField("secondary_issues", joiners=False),
    PackedField("key_stakeholders"),
]
