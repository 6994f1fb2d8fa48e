"""Scalar functions, source lists, fetch steps and generation steps of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import generation as N
from biblion.operators import graph as G
from biblion.operators import ingest as I
from biblion.operators import retrieval as R
from biblion.operators import wiki as W
from biblion.queries import kb
from biblion.queries.intake import _C, _CLEAN, _DAY, _DOI, _FORM, candidates
from biblion.session import table
from biblion.sources import connectors as S
from biblion.sources.extract import extract_sections, glyph_fragments

query = kb.Registry()
QUERIES, ORACLE = query.queries, query.oracle
_c = F.col
_WS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


@query("SELECT 'haie_rev' AS name, count(*) AS n FROM haie_rev UNION ALL SELECT 'kg_entities', count(*) FROM kg_entities UNION ALL SELECT 'events', count(*) FROM events")
def scan_table(spark, d):
    out = None
    for name in ("haie_rev", "kg_entities", "events"):
        n = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT * FROM (VALUES ('haie_rev', (SELECT count(*) FROM (DESCRIBE haie_rev)), true), ('kg_entities', (SELECT count(*) FROM (DESCRIBE kg_entities)), false)) v(name, n_columns, has_doi)")
def db_schema_probe(spark, d):
    """Which columns a table has."""
    rows = [(n, len(table(spark, d, n).columns), "doi" in table(spark, d, n).columns) for n in ("haie_rev", "kg_entities")]
    return spark.createDataFrame(rows, "name string, n_columns long, has_doi boolean")


_DIST = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"
_TW = _WS.replace("{0}", "title")


@query(f"SELECT uid, array_to_string(list_transform(list_slice({_DIST.replace('{0}', _TW)}, 1, 8), lambda w: '\"' || replace(w, '\"', '') || '\"'), ' OR ') AS asked FROM {{art}} WHERE title IS NOT NULL")
def src_query_build(spark, d):
    """Search strings of sources: at most eight terms, each once whatever its case, quoted and joined by OR."""
    terms = I.query_terms(F.filter(F.split("title", r"\s+"), lambda w: w != ""))
    return kb.articles(spark, d).where("title is not null").select("uid", I.quoted_or(terms).alias("asked"))


@query(f"SELECT uid, array_to_string(CASE WHEN len(o) > 0 THEN o ELSE list_slice({_DIST.replace('{0}', _TW)}, 1, 8) END, '|') AS terms FROM (SELECT *, CASE WHEN length(uid) % 2 = 0 THEN ['own terms'] ELSE [] END AS o FROM {{art}}) WHERE title IS NOT NULL")
def fn_query_terms(spark, d):
    """Terms a workspace overrides, else its own."""
    own = F.when(F.length("uid") % 2 == 0, F.array(F.lit("own terms"))).otherwise(F.array().cast("array<string>"))
    seeds = I.query_terms(F.filter(F.split("title", r"\s+"), lambda w: w != ""))
    return kb.articles(spark, d).where("title is not null").select("uid", F.array_join(F.when(F.size(own) > 0, own).otherwise(seeds), "|").alias("terms"))


@query("SELECT * FROM (VALUES ('none', 'ai in health|ethics'), ('some', 'sepsis alert')) v(kind, terms)")
def src_default_queries(spark, d):
    """A workspace's concepts, else the source's default list."""
    rows = spark.createDataFrame([("none", []), ("some", ["sepsis alert"])], "kind string, concepts array<string>")
    return rows.select("kind", F.array_join(T.or_default("concepts", ["ai in health", "ethics"]), "|").alias("terms"))


_PUB = [("10.3389/x1", "https://www.frontiersin.org/articles/10.3389/x1/pdf"), ("10.1371/y.2", "https://journals.plos.org/plosone/article/file?id=10.1371/y.2&type=printable"), ("10.7554/eLife.123", "https://elifesciences.org/articles/123/pdf"), ("10.9/none", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {repr(b) if b else 'NULL'})" for a, b in _PUB) + ") v(doi, url)")
def src_publisher_urls(spark, d):
    return spark.createDataFrame([(a,) for a, _ in _PUB], "doi string").select("doi", F.get(T.publisher_urls(_c("doi")), F.lit(0))["url"].alias("url"))


_PAGE = "'<html><head><meta name=\"citation_pdf_url\" content=\"https://x.example/' || doc_id || '.pdf\"></head><body><nav>menu</nav><h1>Head</h1><p>Body ' || doc_id || '</p><script>no</script></body></html>'"


def _pages(spark, d):
    i = F.col("doc_id").cast("string")
    html = F.concat(F.lit('<html><head><meta name="citation_pdf_url" content="https://x.example/'), i, F.lit('.pdf"></head><body><nav>menu</nav><h1>Head</h1><p>Body '), i, F.lit("</p><script>no</script></body></html>"))
    return table(spark, d, "documents").select("doc_id", html.alias("html"), F.lit("html").alias("kind"))


@query("SELECT doc_id, 'https://x.example/' || doc_id || '.pdf' AS pdf_url FROM documents")
def src_citation_meta(spark, d):
    return extract_sections(_pages(spark, d), "doc_id", "html", "kind").select(F.col("key").cast("long").alias("doc_id"), "pdf_url")


@query("SELECT doc_id, 'Head' AS title, 'Body ' || doc_id AS content FROM documents")
def fn_extract_html(spark, d):
    x = extract_sections(_pages(spark, d), "doc_id", "html", "kind")
    return x.select(F.col("key").cast("long").alias("doc_id"), F.get("sections", F.lit(0))["title"].alias("title"), F.get("sections", F.lit(0))["content"].alias("content"))


@query("SELECT doc_id, 'Abstract|Methods' AS titles, 'Short ' || doc_id AS abstract FROM documents")
def fn_extract_xml(spark, d):
    i = F.col("doc_id").cast("string")
    xml = F.concat(F.lit("<article><front><abstract><p>Short "), i, F.lit("</p></abstract></front><body><sec><title>Methods</title><p>We did it.</p></sec></body></article>"))
    x = extract_sections(table(spark, d, "documents").select("doc_id", xml.alias("xml"), F.lit("xml").alias("kind")), "doc_id", "xml", "kind")
    return x.select(F.col("key").cast("long").alias("doc_id"), F.array_join(F.transform("sections", lambda s: s["title"]), "|").alias("titles"), F.get("sections", F.lit(0))["content"].alias("abstract"))


@query("SELECT doc_id, 'page ' || doc_id AS text FROM documents WHERE doc_id % 2 = 0")
def src_pmc_xml(spark, d):
    """Full text by XML: only what holds an article or a body."""
    i = F.col("doc_id").cast("string")
    xml = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<article><body><p>page "), i, F.lit("</p></body></article>"))).otherwise(F.lit("<error>none</error>"))
    kept = table(spark, d, "documents").select("doc_id", xml.alias("xml"), F.lit("xml").alias("kind")).where(T.is_article_xml(_c("xml")))
    return extract_sections(kept, "doc_id", "xml", "kind").select(F.col("key").cast("long").alias("doc_id"), F.col("full_text").alias("text"))


@query(f"SELECT cand_uid, {_CLEAN.replace('{0}', 'summary')} AS text, 'abstract_only' AS content_type FROM {_C} WHERE {_CLEAN.replace('{0}', 'summary')} IS NOT NULL")
def src_pubmed_abstract(spark, d):
    """Abstracts that come as XML, without the markup."""
    c = candidates(spark, d).withColumn("text", T.present(T.clean_text(F.concat(F.lit("<AbstractText>"), "summary", F.lit("</AbstractText>")))))
    return c.where("text is not null").select("cand_uid", "text", F.lit("abstract_only").alias("content_type"))


@query(f"SELECT cand_uid, nullif(trim(summary), '') AS text FROM {_C}")
def src_summary(spark, d):
    return candidates(spark, d).select("cand_uid", T.present(_c("summary")).alias("text"))


@query(f"SELECT cand_uid, CASE WHEN length(cand_uid) % 2 = 0 THEN url || '.pdf' ELSE url END AS url FROM {_C}")
def src_unpaywall_pdf(spark, d):
    place = F.struct(F.when(F.length("cand_uid") % 2 == 0, F.concat("url", F.lit(".pdf"))).alias("url_for_pdf"), "url")
    j = F.from_json(F.to_json(F.struct(place.alias("best_oa_location"))), "best_oa_location struct<url_for_pdf:string,url:string>")["best_oa_location"]
    return candidates(spark, d).select("cand_uid", F.coalesce(j["url_for_pdf"], j["url"]).alias("url"))


_REL = [("https://a.example/x/y", "z.pdf", "https://a.example/x/z.pdf"), ("https://a.example/x/y", "/z.pdf", "https://a.example/z.pdf"), ("https://a.example/x/y", "https://b.example/z.pdf", "https://b.example/z.pdf"), ("https://a.example/x/y", "//b.example/z.pdf", "https://b.example/z.pdf")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _REL) + ") v(page, link, url)")
def src_landing_pdf(spark, d):
    """Links of a landing page made whole by its address."""
    return spark.createDataFrame([(a, b) for a, b, _ in _REL], "page string, link string").select("page", "link", T.absolute_url(_c("page"), _c("link")).alias("url"))


@query("SELECT * FROM (VALUES ('%PDF-1.7 body', true), ('<html>not one</html>', false), ('%PDF', false)) v(content, is_pdf)")
def src_fetch_pdf_chain(spark, d):
    """What counts as a PDF: its mark and ten bytes."""
    return spark.createDataFrame([("%PDF-1.7 body",), ("<html>not one</html>",), ("%PDF",)], "content string").select("content", T.is_pdf(_c("content")).alias("is_pdf"))


@query("SELECT event_id, strftime(to_timestamp(greatest(floor(epoch(ts)), p + 3)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT event_id, ts, coalesce(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))), 0) AS p FROM events)")
def src_ratelimit(spark, d):
    """When a request may go out: three seconds after the one before it to the same host at the earliest."""
    from biblion.streaming.jobs import event_time

    e = event_time(table(spark, d, "events"))
    return S.spaced(e, "user_id", "ts", "event_id", 3).select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


_TR = "(SELECT DISTINCT id, prompt_name, article_uid, model, success FROM prompt_traces)"


@query(f"SELECT id FROM {_TR} WHERE prompt_name = 'full_evaluation' AND success = 0")
def flt_traces(spark, d):
    """Traces by whichever of prompt, article, model and success are asked."""
    t = table(spark, d, "prompt_traces").select("id", "prompt_name", "article_uid", "model", "success").distinct()
    return I.equal_to(t, {"prompt_name": "full_evaluation", "article_uid": None, "model": None, "success": 0}).select("id")


@query("SELECT uid, row_number() OVER (ORDER BY title DESC NULLS LAST, uid)::INTEGER AS position FROM {art} ORDER BY position LIMIT 40")
def srt_local_toggle(spark, d):
    """A page sorted by one of its columns, downwards after upwards."""
    order = R.toggled("title", descending=True)
    return R.numbered(kb.articles(spark, d).orderBy(*order, "uid").limit(40), [*order, F.asc("uid")], "position").select("uid", "position")


@query("SELECT a.vec_id AS query_id, count(*) AS n, round(min(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 5) AS least FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) a, (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id GROUP BY 1")
def join_knn_cross(spark, d):
    """A stated set of vectors (every hundredth) against all rows."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(_c("vec_id").alias("query_id"), _c("embedding").alias("query_vector"))
    near = R.knn(e, asked, "vec_id", "embedding", 1 << 20).where("vec_id <> query_id")
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.max("similarity"), 5).alias("least"))


@query("SELECT DISTINCT category, content_type FROM {art}")
def set_distinct(spark, d):
    return kb.articles(spark, d).select("category", "content_type").distinct()


@query(f"SELECT cand_uid AS uid, 2 AS n FROM {_C}")
def set_merge_sources(spark, d):
    """Two lists of one source as one, a record each."""
    c = candidates(spark, d).withColumnRenamed("cand_uid", "uid")
    return S.merged_lists([c, c.withColumn("summary", F.lit(None).cast("string"))]).select("uid", _c("n_records").cast("int").alias("n"))


_TOK = f"list_sort(list_distinct(list_filter(string_split_regex({_FORM.replace('{0}', 'title')}, ' +'), lambda w: length(w) >= 3)))"


@query(f"SELECT cand_uid, len({_TOK}) AS n FROM {_C} WHERE title IS NOT NULL")
def set_tokens_unique(spark, d):
    return candidates(spark, d).where("title is not null").select("cand_uid", F.size(T.search_tokens(_c("title"))).cast("long").alias("n"))


@query(f"SELECT cand_uid, {_FORM.replace('{0}', 'title')} AS form FROM {_C}")
def fn_norm_search_text(spark, d):
    return candidates(spark, d).select("cand_uid", T.search_form(_c("title")).alias("form"))


_STOP = ", ".join(repr(w) for w in T.QUERY_STOPWORDS)
_FOC = f"list_filter({_TOK}, lambda w: NOT list_contains([{_STOP}], w))"


@query(f"SELECT cand_uid, array_to_string({_FOC}, ' ') AS tokens, array_to_string(list_filter({_FOC}, lambda w: NOT list_contains([{', '.join(map(repr, T.ANCHOR_STOPWORDS))}], w)), ' ') AS anchors, array_to_string(list_filter({_FOC}, lambda w: list_contains([{', '.join(map(repr, T.TECH_WORDS))}], w)), ' ') AS tech FROM {_C} WHERE title IS NOT NULL")
def fn_token_groups(spark, d):
    g = candidates(spark, d).where("title is not null").select("cand_uid", T.token_groups(_c("title")).alias("g"))
    return g.select("cand_uid", *[F.array_join(f"g.{x}", " ").alias(x) for x in ("tokens", "anchors", "tech")])


@query(f"SELECT cand_uid, {_CLEAN.replace('{0}', 'title')} AS first FROM {_C}")
def fn_first_string(spark, d):
    """A field that is a list in one source and a text in another: the first one, cleaned."""
    j = F.when(F.length("cand_uid") % 2 == 0, F.to_json(F.struct(F.array("title").alias("t")))).otherwise(F.to_json(F.struct(_c("title").alias("t"))))
    return candidates(spark, d).select("cand_uid", T.first_string(j, "t").alias("first"))


@query("SELECT doc_id, 'clinical AI support' AS text FROM documents")
def fn_inverted_abstract(spark, d):
    return table(spark, d, "documents").select("doc_id", T.inverted_abstract(F.lit('{"clinical":[0],"support":[2],"AI":[1]}')).alias("text"))


@query("SELECT uid, nullif(trim(coalesce('Anna ' || first_author, 'Anna')), '') AS name FROM {art}")
def fn_authors_given_family(spark, d):
    return kb.articles(spark, d).select("uid", T.present(F.concat_ws(" ", F.lit("Anna"), "first_author")).alias("name"))


@query("SELECT * FROM (VALUES (1, '2024-01-01'), (2, '2024-03-01'), (3, '2024-03-09')) v(n, d)")
def fn_date_parts(spark, d):
    rows = spark.createDataFrame([(1, 2024, None, None), (2, 2024, 3, None), (3, 2024, 3, 9)], "n int, y int, m int, dd int")
    return rows.select("n", T.date_parts(_c("y"), _c("m"), _c("dd")).alias("d"))


@query("SELECT * FROM (VALUES ('2024 Mar 9', '2024-03-09'), ('2024 Mar', '2024-03-01'), ('2024', '2024-01-01'), ('in press', NULL)) v(said, d)")
def fn_partial_date(spark, d):
    return spark.createDataFrame([("2024 Mar 9",), ("2024 Mar",), ("2024",), ("in press",)], "said string").select("said", T.partial_date(_c("said")).cast("string").alias("d"))


@query("SELECT * FROM (VALUES ('Mon, 18 May 2026 00:00:00 GMT', '2026-05-18'), ('2026-05-18T03:00:00Z', '2026-05-18'), ('2026-05-18', '2026-05-18'), ('soon', NULL)) v(said, d)")
def fn_rss_date(spark, d):
    rows = spark.createDataFrame([("Mon, 18 May 2026 00:00:00 GMT",), ("2026-05-18T03:00:00Z",), ("2026-05-18",), ("soon",)], "said string")
    return rows.select("said", T.feed_date(_c("said")).cast("string").alias("d"))


@query("SELECT * FROM (VALUES (0, '2026-05-31', '2026-06-01'), (7, '2026-05-25', '2026-06-01')) v(days, a, b)")
def fn_date_window(spark, d):
    w = I.date_window(F.lit("2026-06-01").cast("date"), _c("days"))
    return spark.createDataFrame([(0,), (7,)], "days int").select("days", w["start"].cast("string").alias("a"), w["end"].cast("string").alias("b"))


@query("SELECT * FROM (VALUES ('arXiv:2605.16113', '2605.16113'), ('https://arxiv.org/abs/2605.16113v2?x=1', '2605.16113v2'), ('http://arxiv.org/pdf/2605.16113.pdf', '2605.16113')) v(said, id)")
def fn_arxiv_id(spark, d):
    rows = spark.createDataFrame([("arXiv:2605.16113",), ("https://arxiv.org/abs/2605.16113v2?x=1",), ("http://arxiv.org/pdf/2605.16113.pdf",)], "said string")
    return rows.select("said", T.preprint_id(_c("said")).alias("id"))


@query(f"SELECT cand_uid, nullif(trim(journal), '') AS field FROM {_C}")
def fn_rss_field(spark, d):
    text = F.concat(F.lit("Authors: Anna Lo Subjects: "), F.coalesce("journal", F.lit("")), F.lit(" Comments: none"))
    return candidates(spark, d).select("cand_uid", T.feed_field(text, "subjects").alias("field"))


@query(f"SELECT cand_uid, title FROM {_C}")
def fn_html_entities(spark, d):
    coded = _c("title")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return candidates(spark, d).select("cand_uid", T.html_entities(coded).alias("title"))


@query(f"SELECT cand_uid, list_last(string_split('https://x.example/' || source_id, '/')) AS id FROM {_C}")
def fn_openalex_id(spark, d):
    return candidates(spark, d).select("cand_uid", F.element_at(F.split(F.concat(F.lit("https://x.example/"), "source_id"), "/"), -1).alias("id"))


@query(f"SELECT cand_uid, source || ':' || source_id AS uid FROM {_C}")
def fn_uid(spark, d):
    return candidates(spark, d).select("cand_uid", F.concat_ws(":", "source", "source_id").alias("uid"))


@query(r"SELECT doc_id, regexp_replace(title, '([\[\]])', '\\\1', 'g') AS label FROM documents")
def fn_md_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.markdown_label(_c("title")).alias("label"))


@query("SELECT id, '[' || name || '](e' || (min(id) OVER (PARTITION BY lower(name))) || '.md) and [[Nobody Known]]' AS body FROM {ent} WHERE id <= 20 AND name NOT LIKE '%[%' AND name NOT LIKE '%|%'")
def fn_wiki_links(spark, d):
    e = kb.entities(spark, d).where("id <= 20 and name not like '%[%' and name not like '%|%'").select("id", "name")
    targets = {r.name: f"e{r.id}.md" for r in e.orderBy(F.desc("id")).collect()}  # the bounded index; of one name the first
    pages = e.select(_c("id").cast("string").alias("path"), F.concat(F.lit("[["), "name", F.lit("]] and [[Nobody Known]]")).alias("body"))
    return W.link_pages(pages, targets).select(_c("path").cast("long").alias("id"), "body")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'We saw [sepsis](s.md) and sepsis.' ELSE 'No `sepsis` here, nor re-sepsis.' END AS body FROM documents")
def fn_auto_link(spark, d):
    said = F.when(_c("doc_id") % 2 == 0, "We saw sepsis and sepsis.").otherwise("No `sepsis` here, nor re-sepsis.")
    pages = table(spark, d, "documents").select(_c("doc_id").cast("string").alias("path"), said.alias("body"))
    return W.link_pages(pages, {"Sepsis": "s.md"}).select(_c("path").cast("long").alias("doc_id"), "body")


@query(f"SELECT cand_uid, CASE WHEN length(source_id) <= 8 THEN '***' ELSE left(source_id, 4) || '...' || right(source_id, 4) END AS shown FROM {_C}")
def fn_mask_key(spark, d):
    return candidates(spark, d).select("cand_uid", T.masked_key(_c("source_id")).alias("shown"))


@query("SELECT id, lower(trim(name)) AS name_key, kind FROM {ent}")
def fn_entity_type_norm(spark, d):
    from biblion.operators.resolution import name_key

    return kb.entities(spark, d).select("id", name_key(_c("name")).alias("name_key"), "kind")


@query("SELECT uid, array_to_string(list_filter(list_transform(string_split(authors, ','), lambda x: upper(trim(x))), lambda x: x <> ''), '|') AS parts FROM {art} WHERE authors IS NOT NULL")
def fn_csv_list(spark, d):
    return kb.articles(spark, d).where("authors is not null").select("uid", F.array_join(T.csv_list(_c("authors")), "|").alias("parts"))


@query("SELECT * FROM (VALUES ('[\"a\", \"b\"]', 'a|b'), ('nonsense', ''), (NULL, '')) v(said, parts)")
def fn_json_list(spark, d):
    rows = spark.createDataFrame([('["a", "b"]',), ("nonsense",), (None,)], "said string")
    return rows.select("said", F.array_join(T.json_list(_c("said")), "|").alias("parts"))


@query("SELECT doc_id, '{\"k\": ' || doc_id || '}' AS payload FROM documents")
def fn_json_salvage(spark, d):
    said = F.concat(F.lit('Here it is: {"k": '), _c("doc_id").cast("string"), F.lit("} as asked."))
    return table(spark, d, "documents").select("doc_id", T.json_payload(said).alias("payload"))


@query("SELECT uid AS key, 'Title: ' || coalesce(nullif(trim(title), ''), '(not set)') || ' {kept}' AS prompt FROM {art}")
def fn_template(spark, d):
    return W.render_rows(kb.articles(spark, d), "Title: {title} {{kept}}", "uid", ["title"])


@query("SELECT * FROM (VALUES (0, NULL, 1000), (1, NULL, 2000), (2, NULL, 4000), (9, NULL, 8000), (1, '7', 7000)) v(attempt, retry_after, ms)")
def fn_retry_delay(spark, d):
    """Milliseconds before an attempt: what the service asks for, else a table that doubles."""
    rows = spark.createDataFrame([(0, None), (1, None), (2, None), (9, None), (1, "7")], "attempt int, retry_after string")
    return rows.select("attempt", "retry_after", T.retry_delay(_c("attempt"), _c("retry_after")).alias("ms"))


_DATED = [("doaj", "src_doaj_list"), ("unpaywall", "src_unpaywall_list"), ("clinical_trials", "src_ctgov_list"), ("europepmc", "src_europepmc_list"), ("openalex", "src_openalex_list"), ("crossref", "src_crossref_list"), ("semantic_scholar", "src_s2_list")]


def _list_query(name: str, source: str, dated: bool):
    """A source's list: two queries' records merged by key; without a date filter of the server's, filtered here."""

    def run(spark, d):
        c = candidates(spark, d).withColumnRenamed("cand_uid", "uid")
        halves = [c.where(F.pmod(F.length("uid"), F.lit(3)) != i) for i in (0, 1)]
        window = (F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date")) if dated else None
        return S.source_list(halves, window).select("uid", _c("n_records").cast("int").alias("n"))

    run.__name__ = name
    keep = f"({_DAY} IS NULL OR {_DAY} BETWEEN '2024-01-01' AND '2025-12-31')" if dated else "true"
    query(f"SELECT cand_uid AS uid, CASE WHEN length(cand_uid) % 3 = 2 THEN 2 ELSE 1 END AS n FROM {_C} WHERE {keep.replace('pub_date', 'trim(pub_date)')}")(run)


for _source, _name in _DATED:
    _list_query(_name, _source, _source in ("doaj", "unpaywall", "clinical_trials"))


@query(f"SELECT uid FROM (SELECT cand_uid AS uid, row_number() OVER (PARTITION BY coalesce({_DOI.replace('{0}', 'doi')}, 't:' || lower(trim(title)), 'u:' || cand_uid) ORDER BY cand_uid) AS r FROM {_C}) WHERE r = 1")
def src_rxiv_collection(spark, d):
    """Pages of several categories: of one DOI, else of one title, the first counts."""
    return S.first_of_key(candidates(spark, d).withColumnRenamed("cand_uid", "uid"), "uid").select("uid")


@query(f"SELECT uid FROM (SELECT cand_uid AS uid, row_number() OVER (ORDER BY cand_uid) AS r FROM {_C} WHERE contains({_FORM.replace('{0}', 'title')}, 'alert')) WHERE r <= 50")
def src_rxiv_list(spark, d):
    """What of a listing meets the words, fifty at most."""
    c = candidates(spark, d).where(T.search_form(_c("title")).contains("alert"))
    return c.orderBy("cand_uid").limit(50).select(_c("cand_uid").alias("uid"))


@query("SELECT * FROM (VALUES ('{\"messages\":[{\"total\":\"927\"}]}', 927), ('{\"messages\":[{\"total\":12}]}', 12), ('{}', NULL)) v(body, total)")
def fn_rxiv_total(spark, d):
    rows = spark.createDataFrame([('{"messages":[{"total":"927"}]}',), ('{"messages":[{"total":12}]}',), ("{}",)], "body string")
    return rows.select("body", F.get_json_object("body", "$.messages[0].total").try_cast("int").alias("total"))


@query("SELECT * FROM (VALUES ('medrxiv', 'type 2 diabetes', 2), ('medrxiv', 'stroke', 0), ('biorxiv', 'diabetes', 0)) v(server, terms, n)")
def fn_rxiv_categories(spark, d):
    rows = spark.createDataFrame([("medrxiv", "type 2 diabetes"), ("medrxiv", "stroke"), ("biorxiv", "diabetes")], "server string, terms string")
    return rows.select("server", "terms", F.size(S.rxiv_categories(_c("server"), _c("terms"))).alias("n"))


@query("SELECT * FROM (VALUES (0, 0), (1, 30), (2, 60), (3, 90)) v(page, cursor)")
def src_rxiv_paging(spark, d):
    """Where each page of a listing of 100 records starts, thirty a page, eight pages at most."""
    return spark.range(1).select(F.posexplode(S.page_cursors(F.lit(100), 30, 8)).alias("page", "cursor"))


@query(f"SELECT cand_uid FROM {_C} WHERE regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[0]}') AND regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[1]}') AND regexp_matches(lower(concat_ws(' ', title, summary)), '{I.SCOPE[2]}')")
def flt_arxiv_profile(spark, d):
    """The default scope, where a workspace has no words of its own."""
    return I.profile_filter(candidates(spark, d), []).select("cand_uid")


@query(f"SELECT cand_uid AS uid FROM {_C} WHERE {_DOI.replace('{0}', 'doi')} IN (SELECT {_DOI.replace('{0}', 'doi')} FROM {{art}} WHERE byline_summary IS NOT NULL)")
def agg_dups_by_uid(spark, d):
    """Records that are there already and evaluated."""
    done = kb.articles(spark, d).where("byline_summary is not null").select(T.present(T.normalize_doi(_c("doi"))).alias("k"))
    return candidates(spark, d).withColumn("k", T.present(T.normalize_doi(_c("doi")))).join(done, "k", "left_semi").select(_c("cand_uid").alias("uid"))


@query("SELECT doc_id, trim(regexp_replace(title, ' +', ' ', 'g')) AS text FROM documents WHERE trim(title) <> '' AND regexp_full_match(title, '[\\x21-\\x7E ]+')")
def fn_pdf_fragments(spark, d):
    """Glyphs to words and lines: what lies on one line and near is one fragment, a gap is a blank."""
    docs = table(spark, d, "documents").where(r"trim(title) <> '' and title rlike '^[\\x21-\\x7E ]+$'")
    chars = docs.select("doc_id", F.posexplode(F.split("title", "")).alias("i", "ch")).where("ch not in ('', ' ')")
    glyphs = chars.select("doc_id", (_c("i") * 5.0).alias("x"), F.lit(5.0).alias("width"), F.lit(700.0).alias("y"), F.lit(10.0).alias("size"), "ch")
    return glyph_fragments(glyphs, "doc_id").select("doc_id", "text")


@query("SELECT c.id AS chunk_id, CASE WHEN c.id % 5 = 0 THEN 0 ELSE 1 END AS n_entities FROM {chunk} c")
def kg_extract_chunk(spark, d):
    """Chunks given to a service (here: one that fails on every fifth) and what it answered, checked."""

    def service(prompts):
        return [None if int(p) % 5 == 0 else '{"entities": [{"name": "Sepsis alert", "entity_type": "CONCEPT", "description": "A tool of the wards."}], "relationships": []}' for p in prompts]

    asked = kb.chunks(spark, d).select(_c("id").alias("chunk_id"), _c("id").cast("string").alias("prompt"))
    got = N.extracted_graph(N.completed(asked, "chunk_id", "prompt", service), "chunk_id")
    return got.select("chunk_id", F.size(G.valid_extraction(_c("entities"), _c("relations"))["entities"]).alias("n_entities"))


@query("SELECT id, id % 3 = 0 AS same FROM {ent}")
def kg_verify(spark, d):
    """Pairs in doubt put to a service; a hesitant yes is none."""

    def service(prompts):
        return [f'{{"same_entity": true, "confidence": {0.9 if int(p) % 3 == 0 else 0.5}}}' for p in prompts]

    asked = kb.entities(spark, d).select("id", _c("id").cast("string").alias("prompt"))
    return N.verdicts(N.completed(asked, "id", "prompt", service), "id")


@query("SELECT count(*) AS processed, count(*) FILTER (WHERE entity_id % 2 = 0) AS compiled, count(*) FILTER (WHERE entity_id % 2 = 1) AS failed FROM {syn} WHERE stale OR entity_id % 2 = 1")
def kg_compile_loop(spark, d):
    """Stale syntheses given to a service: how many were written anew and how many failed."""

    def service(prompts):
        return ['{"summary": "s"}' if int(p) % 2 == 0 else "no json" for p in prompts]

    asked = kb.syntheses(spark, d).where("stale or entity_id % 2 = 1").select("entity_id", _c("entity_id").cast("string").alias("prompt"))
    return N.counts(N.completed(asked, "entity_id", "prompt", service))


@query("SELECT * FROM (VALUES ('started', 10), ('conflict', 0), ('skipped', 0)) v(status, batch)")
def kg_compile_start(spark, d):
    e = kb.entities(spark, d)
    one = lambda df, running: N.start(df, F.lit(running), 10).select("status", _c("batch").cast("int").alias("batch"))
    return one(e, False).unionByName(one(e, True)).unionByName(one(e.limit(0), False))


@query("SELECT entity_id, string_agg(title, chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT m.entity_id, a.title, row_number() OVER (PARTITION BY m.entity_id ORDER BY m.mention_id) AS r FROM {ment} m JOIN {art} a ON a.uid = m.article_uid WHERE nullif(trim(a.title), '') IS NOT NULL) WHERE r <= 5 GROUP BY 1")
def kg_build_context(spark, d):
    a = kb.articles(spark, d).select(_c("uid").alias("article_uid"), "title")
    return N.context(kb.mentions(spark, d).join(a, "article_uid"), "entity_id", "mention_id", "title")


@query("SELECT uid, title, doi FROM {art} WHERE uid = (SELECT min(uid) FROM haie_rev)")
def art_get(spark, d):
    first = F.broadcast(table(spark, d, "haie_rev").agg(F.min("uid").alias("uid")))
    return kb.articles(spark, d).join(first, "uid", "left_semi").select("uid", "title", "doi")
