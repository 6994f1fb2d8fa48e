import datetime as dt

import pytest
from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import graph as G
from biblion.operators import ingest as I
from biblion.operators import resolution as E
from biblion.operators import retrieval as R
from biblion.sources import connectors as C
from biblion.sources.extract import extract_sections, html_sections, order_fragments, xml_sections
from biblion.streaming import jobs as J


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw", ["10.1000/Test.Case", "https://doi.org/10.1000/test.case", "http://dx.doi.org/10.1000/test.case", "doi:10.1000/test.case", " DOI: 10.1000/test.case. ", "https://www.doi.org/10.1000/test.case,"])
def test_doi(spark, raw):
    assert one(spark, T.normalize_doi(F.col("c")), c=raw) == "10.1000/test.case"


def test_scalars(spark):
    assert one(spark, T.duplicate_title(F.col("c")), c="A Large Language Model, Preprint!") == "a llm"
    assert one(spark, T.inverted_abstract(F.col("c")), c='{"clinical":[1],"AI":[0],"support":[2]}') == "AI clinical support"
    assert one(spark, T.chunk_type(F.col("c")), c="2. Materials and Methods") == "methods"
    assert one(spark, T.dehyphenated(F.col("c")), c="foo-\nbar Foo-\nBar") == "foobar Foo-\nBar"
    assert one(spark, T.sentence_cut(F.col("c")), c="This is the first. And here is a second one! Then") == "This is the first. And here is a second one!"
    assert one(spark, T.match_query(F.col("c")), c='self-management a "x y"') == '"self-management" OR """x" OR "y"""'
    assert one(spark, T.masked_key(F.col("c")), c="sk-123456789") == "sk-1...6789"
    assert [len(w.split()) for w in one(spark, T.word_windows(F.col("c")), c="w " * 1000)] == [450, 450, 220]
    assert one(spark, T.json_payload(F.col("c")), c='text [1, 2] more') == "[1, 2]"
    assert one(spark, T.partial_date(F.col("c")), c="2026 May") == dt.date(2026, 5, 1)
    assert one(spark, T.feed_date(F.col("c")), c="Mon, 18 May 2026 00:00:00 GMT") == dt.date(2026, 5, 18)
    assert one(spark, T.preprint_id(F.col("c")), c="https://arxiv.org/pdf/2605.16113.pdf?x=1") == "2605.16113"
    urls = one(spark, T.publisher_urls(F.col("c")), c="10.7554/eLife.1234.2")
    assert [u.publisher for u in urls] == ["elife"] and urls[0].url.endswith("/1234/pdf")
    windows = one(spark, I.listing_windows(F.lit("2026-03-01").cast("date"), F.lit("2026-05-20").cast("date")))
    assert str(windows[0].start) == "2026-04-21" and str(windows[-1].start) == "2026-03-01" and str(windows[-1].end) == "2026-03-21"
    assert one(spark, I.query_terms(F.array(*[F.lit(x) for x in ["a", "A ", "b", "", "c"]]))) == ["a", "b", "c"]


def test_merge_keeps_the_richest_and_fills_blanks(spark):
    rows = [("u", 1, "T", None, None, "Journal", None), ("u", 2, "T2", "Sum", "2026-01-01", None, "10.1/x"), ("u", 3, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "uid string, seq int, title string, summary string, pub_date string, journal string, doi string")
    r = I.merge_candidates(df, fields=["title", "summary", "pub_date", "journal", "doi"]).first()
    assert (r.title, r.summary, r.journal, r.doi, r.n_records) == ("T2", "Sum", "Journal", "10.1/x", 3)


def test_greedy_dedup_remembers_kept_ones_only(spark):
    rows = [("r", 1, "a", "T1", "10.1/a"), ("r", 2, "b", "T2", "10.1/a"), ("r", 3, "c", "T2", "10.1/c")]
    got = I.first_of_run(spark.createDataFrame(rows, "run_id string, seq int, uid string, title string, doi string")).orderBy("seq").collect()
    assert [r.status for r in got] == ["deduped", "skipped_cross_source", "deduped"]


def test_upsert_precedence(spark):
    old = spark.createDataFrame([("a", "Old", "text", "pdf"), ("b", "Old", None, None)], "uid string, title string, full_text string, content_type string")
    new = spark.createDataFrame([("a", "", "abs", "abstract_only", True), ("b", "New", "abs", "abstract_only", False), ("c", "C", None, None, False)], "uid string, title string, full_text string, content_type string, evaluated boolean")
    got = {r.uid: tuple(r) for r in I.upsert_articles(old, new, ["title"]).collect()}
    assert got["a"][1:4] == ("Old", "text", "pdf") and got["b"][1:4] == ("New", "abs", "abstract_only") and got["c"][4] == "inserted"


def test_edges(spark):
    e = spark.createDataFrame([(1, 1, 2, "Developed   By", "x", 2.0, ["a"]), (2, 2, 1, "develops", "longer text", None, ["b", "a"]), (3, 2, 1, "uses", "y", 1.0, [])], "id long, src long, tgt long, rel_type string, description string, weight double, articles array<string>")
    got = {r.rel_type: r for r in G.merge_edges(e).collect()}
    assert (got["develops"].src, got["develops"].weight, got["develops"].articles, got["develops"].description) == (2, 3.0, ["a", "b"], "longer text")


def test_graph_selection_and_layout(spark):
    e = spark.createDataFrame([(1, 2, "r", 9.0), (3, 4, "r", 8.0), (1, 3, "r", 7.0), (5, 1, "r", 6.0)], "src long, tgt long, rel_type string, weight double")
    assert {(r.src, r.tgt) for r in G.select_graph(e, 4).collect()} == {(1, 2), (3, 4), (1, 3)}
    nodes = G.degrees(e).withColumn("mentions", F.col("degree"))
    a, b = G.force_layout(nodes, e).orderBy("node").collect(), G.force_layout(nodes, e).orderBy("node").collect()
    assert a == b and max(abs(r.x) for r in a) <= 0.96
    assert G.select_graph(e.limit(0), 4).count() == 0


def test_bm25_against_brute_force(spark):
    import math

    docs = [(1, "alpha beta alpha"), (2, "beta gamma"), (3, "alpha"), (4, None), (5, "")]
    got = {r.doc_id: r.score for r in R.bm25(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, "alpha")], "query_id int, query string"), "doc_id", "text").collect()}
    n, avg = 4, 6 / 4
    idf = max(math.log((n - 2 + 0.5) / (2 + 0.5)), 1e-6)
    for doc, tf, dl in ((1, 2, 3), (3, 1, 1)):
        assert got[doc] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)), abs=1e-6)


def test_resolution(spark):
    ent = spark.createDataFrame([(1, "Alpha", ["Al"], 3), (2, "Beta", None, None)], "id long, canonical_name string, aliases array<string>, mention_count long")
    m = spark.createDataFrame([(10, " alpha "), (11, "AL"), (12, "gamma")], "mention_id long, name string")
    assert {(r.mention_id, r.entity_id, r.how) for r in E.resolve_exact(m, ent).collect()} == {(10, 1, "name"), (11, 1, "alias")}
    up = {r.id: r for r in E.register_mentions(ent, spark.createDataFrame([(1, "ALPHA"), (1, "Alfa")], "entity_id long, name string")).collect()}
    assert up[1].mention_count == 5 and up[1].aliases == ["Al", "Alfa"] and up[2].aliases == []


def test_connectors(spark):
    def run(source, payload):
        return C.list_source(source, spark.createDataFrame([(payload,)], "payload string")).collect()

    r = run("crossref", '{"DOI":"10.1000/TEST.case","title":["A title."],"abstract":"<p>Text</p>","author":[{"given":"Ada","family":"Lo"}],"issued":{"date-parts":[[2026,5,18]]},"container-title":["J"],"URL":"u"}')[0]
    assert (r.uid, r.title, r.summary, r.pub_date, r.first_author) == ("crossref:10.1000/test.case", "A title", "Text", "2026-05-18", "Ada Lo")
    r = run("doaj", '{"id":"d1","bibjson":{"title":"T","year":"2026","month":"5","identifier":[{"type":"DOI","id":"10.1/AB"}],"link":[{"type":"Fulltext","url":"f"}]}}')[0]
    assert (r.doi, r.pub_date, r.url) == ("10.1/ab", "2026-05-01", "f")
    r = run("openalex", '{"id":"https://openalex.org/W1","title":"T","abstract_inverted_index":{"b":[1],"a":[0]},"authorships":[{"author":{"display_name":"X Y"}}]}')[0]
    assert (r.uid, r.summary, r.authors) == ("openalex:W1", "a b", "X Y")
    r = run("arxiv", "<record><metadata><arXiv><id>2605.16113</id><created>2026-05-18</created><authors><author><keyname>Lo</keyname><forenames>Ada</forenames></author></authors><title>T</title></arXiv></metadata></record>")[0]
    assert (r.uid, r.first_author, r.pub_date) == ("arxiv:2605.16113", "Ada Lo", "2026-05-18")
    assert run("crossref", '{"title":["no id"]}') == [] and run("pubmed", "not json") == []
    with pytest.raises(ValueError):
        C.list_source("nowhere", spark.range(1))


def test_extraction(spark):
    page = '<html><head><meta name="citation_pdf_url" content="x.pdf"><script>"</p>"</script></head><body><nav>menu</nav><h1>Title</h1><p>One &amp; two</p><div>three</div><footer>f</footer></body></html>'
    parts, pdf = html_sections(page)
    assert pdf == "x.pdf" and parts == [("Title", "One & two\n\nthree")] or "three" in parts[0][1]
    assert xml_sections("<article><abstract><p>A</p></abstract><body><sec><title>S</title><p>B</p></sec></body></article>") == [("Abstract", "A"), ("S", "B")]
    assert xml_sections("<broken") == []
    df = spark.createDataFrame([(1, page, "html"), (2, None, "xml"), (3, "a  b", "pdf")], "id int, c string, t string")
    assert {r.key: r.full_text for r in extract_sections(df, "id", "c", "t").collect()}["3"] == "a b"
    rows = [(1, 10.0, 90.0, 700.0, 200.0, 10.0, "left-"), (1, 110.0, 190.0, 700.0, 200.0, 10.0, "right"), (1, 10.0, 90.0, 680.0, 200.0, 10.0, "over"), (1, 10.0, 190.0, 750.0, 200.0, 10.0, "title")]
    frags = spark.createDataFrame(rows, "page long, x double, x_end double, y double, page_width double, font_size double, text string")
    assert order_fragments(frags).first().text == "title\nleftover\nright"


def test_stream_windows_and_resume(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=20 * i), i % 2, "view", 1.0, "{}") for i in range(12)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = J.resume_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"])
    q.awaitTermination()
    q = J.resume_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp2"), ["event_id"])
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    batch = {(r.window_start, r.n_events) for r in J.tumbling_counts(spark.createDataFrame(rows, schema)).collect()}
    s = J.tumbling_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    s.processAllAvailable()
    assert {(r.window_start, r.n_events) for r in spark.table("w").collect()} == batch
    s.stop()


def test_tokens_of_all_scripts_are_counted(spark, tmp_path):
    import regex

    from biblion.queries.text import fn_count_tokens_all

    texts = ["Plain words, two.", "Die Pflegekräfte – müde.", "¿Qué es l'été?", "한국어 문장 하나.", "", None]
    spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in fn_count_tokens_all(spark, str(tmp_path)).collect()}
    assert got == {i: len(regex.findall(r"\w+|[^\w\s]", t)) for i, t in enumerate(texts) if t is not None}
