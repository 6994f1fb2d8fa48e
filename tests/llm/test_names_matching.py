import random

import pyarrow as pa

from biblion.llm.components import components
from biblion.llm.matching import author_words, comparable, compare, doi_form, is_generic, match_records, same_work, title_form
from biblion.llm.names import cells_of, close, deletions, edit_distance, link_names, near_units, organisation_words, person_parts, within_one

GIVEN = frozenset(["robert", "anna", "jeanluc", "henry", "olga"])


def test_distance_is_a_metric():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(40)]
    for a in words:
        for b in words:
            d = edit_distance(a, b, 9)
            assert d == edit_distance(b, a, 9) and (d == 0) == (a == b)
            assert within_one(a, b) == (d <= 1)
            if d <= 1:
                assert deletions(a) & deletions(b)
            c = rng.choice(words)
            assert edit_distance(a, c, 20) <= d + edit_distance(b, c, 20)
    assert edit_distance("nelrevev", "nelervev") == 1


def test_name_parts():
    for text in ("Robert Nelrevev", "Nelrevev, Robert", "NELREVEV Robert", "Nelrevev Robert", "Dr. Robert Nelrevev, MD, PhD", "robert nelrevev", "Nelrevev, Robert (RN)"):
        assert person_parts(text, GIVEN) == ("robert", "", "nelrevev"), text
    assert person_parts("Nelrevev RK", GIVEN) == ("r", "k", "nelrevev") and person_parts("R. K. Nelrevev", GIVEN) == ("r", "k", "nelrevev")
    assert person_parts("Jean-Luc G. Sorbekint", GIVEN) == ("jeanluc", "g", "sorbekint") and person_parts("Solo", GIVEN) is None
    assert sorted(organisation_words("The Univ. of Belgavird")) == sorted(organisation_words("Belgavird University"))
    assert close("robert nelrevev", "robert nelervev", "person") and not close("robert nelrevev", "robert nelrevix", "person")


def test_radius_join_finds_all_pairs(spark):
    rng = random.Random(4)
    units = {(f"{rng.choice(['anna', 'ana', 'olga'])} {''.join(rng.choice('abc') for _ in range(4))}", "person") for _ in range(60)}
    units |= {(" ".join(sorted(rng.sample(["clinic", "clinc", "centre", "center", "north", "health", "helath", "of"], 3))), "organisation") for _ in range(40)}
    got = {(r.u, r.v, r.kind) for r in near_units(spark.createDataFrame(sorted(units), "unit string, kind string")).collect()}
    assert got == {(a, b, k) for a, k in units for b, m in units if k == m and a < b and close(a, b, k)} and len(got) > 50
    assert all(cells_of(a, k) & cells_of(b, k) for a, b, k in got)


def test_links(spark):
    ent = [(1, "Robert Nelrevev", "PERSON", None), (2, "NELREVEV, Bob", "Person", []), (3, "Robert Nelervev PhD", "PERSON", None), (4, "R. Nelrevev", "PERSON", None), (5, "Anna Quillepar", "PERSON", ["A. Quillepar"]),
           (6, "Belgavird University", "ORGANIZATION", None), (7, "Univ. of Belgavird", "ORGANIZATION", None), (8, "Belgavird University", "DATASET", None), (9, None, "PERSON", None), (1, "Robert Nelrevev", "PERSON", None),
           (10, "Henry A. Lo", "PERSON", None), (11, "Henry B. Lo", "PERSON", None), (12, "Henry Lo", "PERSON", None)]
    art = [("u1", "Nelrevev, Robert; Quillepar, Anna"), ("u2", "Nobody Known"), ("u3", None), (None, "Anna Quillepar"), ("u4", "Nelrevev R")] + [(f"v{i}", f"Sur{c}, {g}") for i, (c, g) in enumerate((c, g) for c in "abcdef" for g in ("Robert", "Anna", "Henry"))]
    e = spark.createDataFrame([(*r, 1) for r in ent], "id long, canonical_name string, entity_type string, aliases array<string>, node int")
    a = spark.createDataFrame([(*r, 1) for r in art], "uid string, authors string, label int")
    got = {tuple(r) for r in link_names(e, a).collect()}
    pairs = {(int(x), int(y)) for k, x, y in got if k == "entity_entity"}
    assert {(1, 2), (1, 3), (2, 3), (1, 4), (6, 7)} <= pairs and not any(p & {10, 11, 12} for p in map(set, pairs)) and not any(8 in p for p in pairs)
    assert {("author_entity", "u1", "1"), ("author_entity", "u1", "5"), ("author_entity", "u4", "1")} <= got
    assert link_names(e.limit(0), a).count() == 0 and link_names(e, a.limit(0)).count() == len(pairs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_record_forms():
    assert doi_form("https://doi.org/10.5555%2FLPD.2021.1502.v2") == "10.5555/lpd.2021.1502" and doi_form("10.5555/none") == "" and doi_form(None) == ""
    assert title_form("[cs.CY] Research article: <i>A study</i> of X.") == ("a study of x", "")
    assert title_form("Correction to: A study of X")[1] == "correction" and title_form("A study of X, revisited")[1] == "revisited" and title_form("Reply")[1] == ""
    a = {"title": "a study of the wards", "author": "lo anna", "date": "2024-05-01", "doi": ""}
    assert compare(a, {**a, "author": "lo", "date": "2024"})[1:] == (1, 2, 0) and same_work(True, 1.0, 1, 2, 0, False) and not same_work(False, 1.0, 1, 2, 1, False)


def test_matches(spark):
    listed = [(f"l:{i}", f"Measuring {w} in the ward of {c}: a careful study", f"{c}son, Anna", "2024-05-01", f"10.5555/j.{i}{c}", 1) for i, (w, c) in enumerate((w, c) for w in ("trust", "fairness", "privacy", "dignity") for c in ("Kor", "Bel", "Mal", "Ter", "Gel"))]
    cand = [("c:1", "MEASURING TRUST IN THE WARD OF KOR: A CAREFUL STUDY.", "Korson A", "2024", None, 1), ("c:2", "Measuring trust in teh ward of Bel: a careful study", "A. Belson", "2024-05-01", None, 1), ("c:3", "Correction: Measuring trust in the ward of Mal: a careful study", "Malson", "2024-05-01", None, 1),
            ("c:4", None, None, None, None, 1), ("c:5", "Something else entirely about clocks", "Lo", "2020", "10.5555/j.0Kor", 1), ("c:1", "MEASURING TRUST IN THE WARD OF KOR: A CAREFUL STUDY.", "Korson A", "2024", None, 1)]
    zones = spark.createDataFrame([("l", "UTC", "MDY"), ("c", "UTC", "MDY")], "source string, zone string, date_order string")
    schema = "k string, title string, first_author string, pub_date string, doi string, sig int"
    c, l = spark.createDataFrame(cand, schema).withColumnRenamed("k", "cand_uid"), spark.createDataFrame(listed, schema).withColumnRenamed("k", "uid")
    got = {(r.cand_uid, r.uid): r.confidence for r in match_records(c, l, zones).collect()}
    assert set(got) == {("c:1", "l:0"), ("c:2", "l:1")} and all(0 <= x <= 1 for x in got.values())
    assert match_records(c.limit(0), l, zones).count() == 0


def test_mistyped_pairs_without_exact_key_meet(spark):
    """Title, author and month all differ, so only hyperplane blocks bring the pairs together."""
    subjects = "transparency deskilling explainability accountability trust consent".split()
    things = "the readmission score|a consent chatbot|the referral sorter|a delirium monitor|the rota optimiser|a stroke detector".split("|")
    names = [a + b for a in ("garma", "torpa", "selo", "nelke", "calda", "fenmo") for b in ("divirg", "mirsot", "pevack", "zikorn", "nirgat", "moldek")]
    places = "telehealth oncology dermatology cardiology radiology pneumonia".split()
    pairs = [(s, t, p) for s, p in zip(subjects, places, strict=True) for t in things]
    listed = [(f"l:{i}", f"Patient {s} after the introduction of {t} in {p}", f"Anna {n}", "2021-03-20", f"10.5555/x.{i}") for i, ((s, t, p), n) in enumerate(zip(pairs, names, strict=True))]
    cand = [(f"c:{i}", f"Pateint {s[:3] + s[4] + s[3] + s[5:]} after the introduction of {t} in {p}", f"{n[:4]}x{n[4:]}", "2021-05-02", None) for i, ((s, t, p), n) in enumerate(zip(pairs, names, strict=True))]
    zones = spark.createDataFrame([("l", "UTC", "MDY"), ("c", "UTC", "MDY")], "source string, zone string, date_order string")
    columns = "title string, first_author string, pub_date string, doi string"
    found = match_records(spark.createDataFrame(cand, f"cand_uid string, {columns}"), spark.createDataFrame(listed, f"uid string, {columns}"), zones)
    got = {(r.cand_uid, r.uid) for r in found.collect()}

    def forms(rows):
        return [{"key": k, "title": title_form(t)[0], "author": " ".join(author_words(a)), "date": d, "doi": doi_form(o)} for k, t, a, d, o in rows]

    want = {(a["key"], b["key"]) for a in forms(cand) for b in forms(listed) if same_work(True, *compare(a, b), False)}
    assert len(want) >= len(pairs) and got == want


def test_pairs_left_out_before_python_are_none_that_compare_keeps(spark):
    """The filter in the plan drops most pairs, but none that the comparison in Python would go on with."""
    from pyspark.sql import functions as F

    from biblion.llm.matching import _day

    rng = random.Random(6)
    words, surnames = "trust fairness privacy dignity consent wards models triage".split(), ["lannodoln", "lannodlon", "selbipott", "sebipot", "lo", "ol", "merdolin"]
    dois = ["", "", "10.5555/a.1", "10.5555/a.2", "10.5555/a.1/pre.3"]

    def record(i):
        title, author = " ".join(rng.sample(words, 4)), " ".join(rng.sample(surnames, rng.choice([0, 1, 2])))
        return {"sig": i * 7919 - 3000, "title": title, "author": author, "date": rng.choice(["", "2021", "2021-03", "2021-03-04", "2024-05-01", "2016-01-01"]), "doi": rng.choice(dois)}

    made = [record(i) for i in range(120)]
    rows = [(r["sig"], (r["title"], r["author"], r["date"], r["doi"], [hash(w) for w in r["title"].split()], *_day(r["date"]))) for r in made]
    df = spark.createDataFrame(rows, "sig long, r struct<title string, author string, date string, doi string, words array<long>, day double, within int>")
    both = df.select(F.col("sig").alias("c"), F.col("r").alias("a")).crossJoin(df.select(F.col("sig").alias("l"), F.col("r").alias("b")))
    got = {(r.c, r.l) for r in both.where(comparable()).select("c", "l").collect()}
    want = set()
    for a in made:
        for b in made:
            x, y = set(a["title"].split()), set(b["title"].split())
            _, author, date, doi = compare({**a, "title": ""}, {**b, "title": ""})
            if (len(x & y) >= 0.25 * min(len(x), len(y)) or a["doi"] == b["doi"]) and not (doi != 1 and (author < 0 or date < 0) and (doi == 0 or (a["sig"] ^ b["sig"]) % 16)):
                want.add((a["sig"], b["sig"]))
    assert want <= got and len(got) < 0.7 * len(made) ** 2


def test_a_walk_starts_at_every_record(spark):
    from pyspark.sql import functions as F

    from biblion.llm.matching import node_bucket, walks

    n = 60_000
    records = spark.range(n).select(F.col("id").alias("sig"), F.array(F.concat(F.lit("w"), F.col("id")), F.concat(F.lit("v"), (F.col("id") / 2).cast("long"))).alias("tokens"))
    got = walks(records)
    assert got.count() == n
    three = {tuple(sorted(r.words)) for r in walks(records.where("sig < 1")).collect()}
    assert three == {tuple(sorted(str(node_bucket(t)) for t in ("w0", "v0")))}


def test_generic_titles_at_any_size():
    """An ordinary title's share stays when the table grows; early postings of generic titles match."""
    for times in (1, 10, 100):
        assert not is_generic(8 * times, 8000 * times, 0.002) and is_generic(31 * times, 8000 * times, 0.002)
    assert same_work(True, 1.0, 1, 1, 0, True) and same_work(True, 1.0, 1, 2, -1, True)
    assert not same_work(True, 1.0, 0, 2, 0, True) and not same_work(True, 1.0, 1, 1, -1, True) and not same_work(True, 1.0, 1, -1, 0, True)
