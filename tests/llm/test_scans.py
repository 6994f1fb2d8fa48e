from pyspark.sql import functions as F

from biblion.llm.scans import anagram_hash, is_scanned, repair_texts, scan_noise


def _page(n, noise=True):
    """A scanned page of a known text, its noise and what has to come out."""
    words = "the committee asked for a careful study of the clinical incident before any deployment in the general hospital was made".split()
    lines, line = [], ""
    for w in words * 6:
        if len(line) + len(w) + 1 > 60:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    lines.append(line + ".")
    if not noise:
        return lines
    assert "the" in lines[2]
    lines[2] = lines[2].replace("the", "tbe", 1)
    return [*lines[:4], "", "Journal of Careful Studies", f"- {100 + n} -", "", *lines[4:]]


def test_noise(spark):
    rows = [(f"u{i}", "\n".join(_page(i))) for i in range(12)] + [("plain", "One long line without any breaks. " * 30), (None, "x"), ("nul", None), ("empty", ""), ("u0", "\n".join(_page(0)))]
    df = spark.createDataFrame([(*r, 3) for r in rows], "uid string, full_text string, line_no int")
    noise, fixes = scan_noise({"t": df})
    got = {}
    for r in noise.collect():
        got.setdefault(r.uid, set()).add((r.line_no, r.noise_kind))
    assert set(got) == {f"u{i}" for i in range(12)}
    assert all({(5, "running_header"), (6, "page_number")} <= v for v in got.values())
    assert ("tbe", "the") in {(r.wrong, r.right) for r in fixes.collect()} and all((2, "misread") in v for v in got.values())
    text = {r.uid: r.text for r in repair_texts({"t": df}).collect()}
    assert text["u1"] == " ".join(_page(1, noise=False)) and text["plain"].startswith("One long")
    assert scan_noise({"t": df.limit(0)})[0].count() == 0


def test_hyphens_by_evidence(spark):
    body = ["the self-learning tool was used in the clinic and the emergency room and the", "privacy-preserving model of the emergency department was a self-learning tool"]
    page = [*body * 3, "we saw that the tool was used for privacy-", "preserving work in the clinic and for the emer-", "gency department of the hospital and in the room."]
    df = spark.createDataFrame([(f"u{i}", "\n".join(page)) for i in range(3)], "uid string, full_text string")
    got = {(r.line_no, r.noise_kind) for r in scan_noise({"t": df})[0].where("uid = 'u0'").collect()}
    assert (7, "hyphen_break") in got and (6, "hyphen_break") not in got
    assert "emergency department of the hospital" in {r.uid: r.text for r in repair_texts({"t": df}).collect()}["u0"]


def test_hash_and_page(spark):
    r = spark.sql("select 'listen' a, 'silent' b, 'tbe' c, 'the' d").select(*[anagram_hash(F.col(c)).alias(c) for c in ("a", "b", "c", "d")]).first()
    assert r.a == r.b and r.c - r.d == ord("b") ** 5 - ord("h") ** 5
    assert not is_scanned("short") and not is_scanned("")
