import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biblion.llm.splitting import cut_level, oversized, sentence_cuts, split_items, split_text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?。\n\tÄ漢", max_size=400), st.integers(10, 80), st.integers(0, 30))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    back = min(overlap, limit // 2)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    rest = "".join(text[(a + (min(back, prev[1]) if prev else 0)) if prev else a : b] for prev, (a, b) in zip([None, *pieces], pieces, strict=False))
    assert all(q[0] == max(0, p[1] - back) for p, q in zip(pieces, pieces[1:], strict=False))
    assert "".join(text[p[1] if p else 0 : q[1]] for p, q in zip([None, *pieces], pieces, strict=False)) == text and len(rest) >= 0


@pytest.mark.parametrize(
    ("text", "level"),
    [("a" * 40 + "\n\n" + "b" * 40, "paragraph"), ("Aa bb. " * 10, "sentence"), ("see e.g. this and Fig. 3 " * 4, "word"), ("x" * 90, "none"), ("漢字。" * 30, "sentence")],
)
def test_levels(text, level):
    assert cut_level(text, 60, 10) == level


def test_abbreviations_end_nothing():
    text = "Dr. Lo et al. saw Fig. 3. Then e.g. this. J. Ho left."
    assert [text[i:][:4] for i in sentence_cuts(text)] == ["Then", "J. H"]


def test_items(spark):
    limits = spark.createDataFrame([("t", "body", 50, 10)], "item_table string, text_column string, max_chars int, overlap_chars int")
    rows = [(1, "One two three. " * 10, "S", 1), (1, "One two three. " * 10, "S", 2), (2, None, "S", 3), (3, "", None, 4), (None, "x" * 99, "S", 5), (4, "short", "S", 6)]
    df = spark.createDataFrame(rows, "id long, body string, section string, start int")
    got = split_items(df, "id", "body", "section", limits, "t")
    by = {}
    for r in got.collect():
        by.setdefault(r.item_key, []).append(r)
    assert set(by) == {"1", "3", "4"} and all(r.section == "S" and len(r.content) <= 50 for r in by["1"]) and by["3"][0].content == ""
    assert [tuple(r) for r in oversized(got).collect()] == [("t", "1", "sentence")]
    assert split_items(df.limit(0), "id", "body", None, limits, "t").count() == 0
    with pytest.raises(ValueError):
        split_items(df, "id", "body", None, limits, "other")
