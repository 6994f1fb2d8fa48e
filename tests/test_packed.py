import pyarrow as pa
import pytest

from biblion.operators.packed import ARTICLE_FIELDS, PackedField, explode_packed, split_packed


def split(text, person=False, joiners=True):
    return split_packed(pa.array([text], pa.string()), person, joiners)[0].to_pylist()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A; B;C;", ["A", "B", "C"]), ("A|B | C", ["A", "B", "C"]), ("- A\n- B", ["A", "B"]), ("1) A 2) B 3) C", ["A", "B", "C"]), ("A、B、C", ["A", "B", "C"]),
        ('["A, x", "\\ucc45"]', ["A, x", "책"]), ('"a, b";"c ""d"" e"', ["a, b", 'c "d" e']), ("A, B and C", ["A", "B", "C"]), ("A (x, y), B", ["A (x, y)", "B"]),
        ("A/ B (x / y)", ["A", "B (x / y)"]), ("A; B, C", ["A", "B", "C"]), ("A + B", ["A", "B"]), ("A\tB", ["A", "B"]), ("a, b | c", ["a, b", "c"]), ("  ", []), ("", []), ("한글，둘", ["한글", "둘"]),
    ],
)
def test_values(text, want):
    assert split(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Wesredan, Tom; Borevarn, Michael", ["Wesredan, Tom", "Borevarn, Michael"]), ("Sorbekint, Jean-Luc G.", ["Sorbekint, Jean-Luc G."]),
        ("Narbeax, D. N., Hesdimort, F.", ["Narbeax, D. N.", "Hesdimort, F."]), ("Palgolenk, T., & Palbekodt, C.", ["Palgolenk, T.", "Palbekodt, C."]),
        ("Normakerg D, Perregek G", ["Normakerg D", "Perregek G"]), ("Henry Norpakirn, Elizabeth Caldosek, et al.", ["Henry Norpakirn", "Elizabeth Caldosek"]),
        ("Kenji D. Morgadack, and Nadia N. Korlanern", ["Kenji D. Morgadack", "Nadia N. Korlanern"]), ("Vera Morbeloln, RN; Kofi Hesmipock, PhD", ["Vera Morbeloln, RN", "Kofi Hesmipock, PhD"]),
    ],
)
def test_names(text, want):
    assert split(text, person=True) == want


def test_topics_keep_joining_words():
    assert split("safety and oversight, trust", joiners=False) == ["safety and oversight", "trust"]


def test_rows(spark):
    long = "; ".join(f"v{i}" for i in range(5000))
    df = spark.createDataFrame(
        [("a", "X; Y", None, ""), ("a", "X; Y", None, ""), (None, "P; Q", "p, q", "z"), ("b", None, long, "one"), ("c", "Solo, Han", None, None)],
        "uid string, authors string, secondary_issues string, key_stakeholders string",
    )
    got = explode_packed(df, "uid", ARTICLE_FIELDS, 2).collect()
    assert {(r.uid, r.field_name, r.ord, r.val) for r in got if r.uid == "a"} == {("a", "authors", 1, "X"), ("a", "authors", 2, "Y")}
    assert sum(r.uid == "b" for r in got) == 5000 and not any(r.uid in (None, "c") for r in got)
    assert explode_packed(df.limit(0), "uid", [PackedField("authors", person=True)]).count() == 0
