"""Sources and records on their way in: landed payloads through every mapper, lists of sources, merging, text functions.

The payloads are made of the candidate table in each source's own form, so that what a
mapper reads out of them can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import graph as G
from biblion.operators import ingest as I
from biblion.operators.resolution import resolve_vectors
from biblion.queries import kb
from biblion.session import table
from biblion.sources import connectors as S

query = kb.Registry()
QUERIES, ORACLE = query.queries, query.oracle
FIELDS = ["source", "source_id", "title", "summary", "first_author", "authors", "pub_date", "journal", "doi", "url"]
_C = "(SELECT cand_uid, " + ", ".join(f"min({c}) AS {c}" for c in FIELDS) + " FROM article_candidate GROUP BY cand_uid)"
_CLEAN = r"nullif(regexp_replace(trim(regexp_replace(regexp_replace({0}, '<[^>]*(>|$)', '', 'g'), '\s+', ' ', 'g')), '\.+$', ''), '')"
_DOI = r"nullif(trim(regexp_replace(regexp_replace(lower(trim({0})), '^(?:https?://|dx\.doi\.org/|www\.doi\.org/|doi\.org/|doi:|\s)+', ''), '[.,]+$', '')), '')"
_FORM = "regexp_replace(replace(replace(replace(replace(replace(lower({0}), 'large language model', 'llm'), 'large-language-model', 'llm'), 'chat bot', 'chatbot'), 'chat-bot', 'chatbot'), 'self-management', 'self management'), '[^a-z0-9]', ' ', 'g')"
_DAY = "coalesce(try_strptime(CASE WHEN regexp_full_match(pub_date, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN pub_date END, '%Y-%m-%d'), try_strptime(CASE WHEN regexp_full_match(pub_date, '[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}') THEN pub_date END, '%Y/%m/%d'))"
_TITLE = f"array_to_string(list_filter(string_split_regex({_FORM}, ' +'), lambda w: w <> '' AND w <> 'preprint'), ' ')"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_candidate").groupBy("cand_uid").agg(*[F.min(c).alias(c) for c in FIELDS])


def _json(spark: SparkSession, d: str, *columns) -> DataFrame:
    return candidates(spark, d).select(F.to_json(F.struct(*columns)).alias("payload"))


def _expected(source: str, sid: str, title: str = "title", summary: str = "NULL::VARCHAR", author: str = "NULL::VARCHAR", date: str = "NULL::VARCHAR", journal: str = "NULL::VARCHAR", doi: str = "NULL::VARCHAR", url: str = "NULL::VARCHAR") -> str:
    clean = _CLEAN.replace("{0}", title)
    return (
        f"SELECT '{source}:' || trim({sid}) AS uid, {clean} AS title, {_CLEAN.replace('{0}', summary)} AS summary, coalesce({author}, 'Unknown') AS first_author, {author} AS authors, {date} AS pub_date, "
        f"{_CLEAN.replace('{0}', journal)} AS journal, {_DOI.replace('{0}', doi)} AS doi, nullif(trim({url}), '') AS url FROM {_C} WHERE nullif(trim({sid}), '') IS NOT NULL AND {clean} IS NOT NULL"
    )


def _read(source: str, landed: DataFrame) -> DataFrame:
    return S.list_source(source, landed).select("uid", "title", "summary", "first_author", "authors", "pub_date", "journal", "doi", "url")


_AUTHOR = _CLEAN.replace("{0}", "first_author")
_c = F.col


@query(_expected("crossref", _DOI.replace("{0}", "doi"), summary="summary", author=_AUTHOR, date="'2024-03-01'", journal="journal", doi="doi", url="url"))
def src_crossref(spark, d):
    author = F.array(F.struct(F.lit(None).cast("string").alias("given"), _c("first_author").alias("family")))
    issued = F.struct(F.array(F.array(F.lit(2024), F.lit(3))).alias("date-parts"))
    return _read("crossref", _json(spark, d, _c("doi").alias("DOI"), F.array("title").alias("title"), _c("summary").alias("abstract"), author.alias("author"), issued.alias("issued"), F.array("journal").alias("container-title"), _c("url").alias("URL")))


@query(_expected("doaj", "source_id", summary="summary", author=_AUTHOR, date="'2026-05-01'", journal="journal", doi="doi", url="url"))
def src_doaj(spark, d):
    one = lambda kind, name, value: F.array(F.struct(F.lit(kind).alias("type"), _c(value).alias(name)))
    bib = F.struct("title", _c("summary").alias("abstract"), F.lit("2026").alias("year"), F.lit("5").alias("month"), F.array(F.struct(_c("first_author").alias("name"))).alias("author"), F.struct(_c("journal").alias("title")).alias("journal"), one("doi", "id", "doi").alias("identifier"), one("fulltext", "url", "url").alias("link"))
    return _read("doaj", _json(spark, d, _c("source_id").alias("id"), bib.alias("bibjson")))


@query(_expected("openalex", "list_last(string_split(source_id, '/'))", summary="CASE WHEN summary IS NOT NULL THEN 'clinical AI' END", author="nullif(trim(first_author), '')", date="'2024-02-03'", journal="journal", doi="doi", url="url"))
def src_openalex(spark, d):
    inverted = F.when(_c("summary").isNotNull(), F.struct(F.array(F.lit(1)).alias("AI"), F.array(F.lit(0)).alias("clinical")))
    place = F.struct(_c("url").alias("landing_page_url"), F.struct(_c("journal").alias("display_name")).alias("source"))
    return _read("openalex", _json(spark, d, F.concat(F.lit("https://openalex.example/"), "source_id").alias("id"), "title", "doi", F.lit("2024-02-03").alias("publication_date"), F.array(F.struct(F.struct(_c("first_author").alias("display_name")).alias("author"))).alias("authorships"), place.alias("primary_location"), inverted.alias("abstract_inverted_index")))


@query(_expected("pubmed", "source_id", author=_AUTHOR, date="'2024-05-01'", journal="journal", doi="doi", url="'https://pubmed.ncbi.nlm.nih.gov/' || source_id || '/'"))
def src_pubmed(spark, d):
    ids = F.array(F.struct(F.lit("doi").alias("idtype"), _c("doi").alias("value")))
    return _read("pubmed", _json(spark, d, _c("source_id").alias("uid"), "title", F.array(F.struct(_c("first_author").alias("name"))).alias("authors"), F.lit("2024 May").alias("pubdate"), _c("journal").alias("fulljournalname"), ids.alias("articleids")))


@query(_expected("pmc", "'PMC' || regexp_replace(source_id, '^PMC', '')", author=_AUTHOR, date="'2024-01-01'", journal="journal", doi="doi"))
def src_pmc(spark, d):
    ids = F.array(F.struct(F.lit("doi").alias("idtype"), _c("doi").alias("value")))
    return _read("pmc", _json(spark, d, _c("source_id").alias("uid"), "title", F.array(F.struct(_c("first_author").alias("name"))).alias("authors"), F.lit("2024").alias("pubdate"), _c("journal").alias("fulljournalname"), ids.alias("articleids")))


@query(f"SELECT source_id AS pmc_id, 'p' || source_id AS pubmed_id FROM {_C} WHERE source_id IS NOT NULL AND length(source_id) % 2 = 0")
def src_elink(spark, d):
    """Links of one archive to another; sets without a link give none."""
    db = F.when(F.length("source_id") % 2 == 0, "pubmed").otherwise("elsewhere")
    one = F.struct(F.array("source_id").alias("ids"), F.array(F.struct(db.alias("dbto"), F.array(F.concat(F.lit("p"), "source_id")).alias("links"))).alias("linksetdbs"))
    return S.pmc_links(_json(spark, d, F.array(one).alias("linksets")))


@query(_expected("europepmc", "source_id", summary="summary", author="nullif(regexp_replace(trim(first_author), '[.]$', ''), '')", date="'2024-01-09'", journal="journal", doi="doi", url="url").replace(" FROM (SELECT", " FROM (SELECT", 1) + " AND coalesce(first_author, '') NOT LIKE '%,%'")
def src_europepmc(spark, d):
    c = candidates(spark, d).where("coalesce(first_author, '') not like '%,%'")  # the source writes authors with commas between
    p = F.to_json(F.struct(_c("source_id").alias("id"), "title", _c("summary").alias("abstractText"), _c("first_author").alias("authorString"), F.lit("2024-01-09").alias("firstPublicationDate"), _c("journal").alias("journalTitle"), "doi", F.struct(F.array(F.struct("url")).alias("fullTextUrl")).alias("fullTextUrlList")))
    return _read("europepmc", c.select(p.alias("payload")))


@query(_expected("medrxiv", "doi", summary="summary", author="nullif(trim(first_author), '')", date="'2024-01-09'", journal="'medrxiv'", doi="doi", url="'https://www.medrxiv.org/content/' || doi"))
def src_rxiv(spark, d):
    """Preprints: the DOI is their key, so those without one are none."""
    return _read("medrxiv", _json(spark, d, "doi", "title", _c("summary").alias("abstract"), _c("first_author").alias("authors"), F.lit("2024-01-09").alias("date")))


@query(_expected("unpaywall", _DOI.replace("{0}", "doi"), author="nullif(trim(first_author), '')", date="'2024-01-09'", journal="journal", doi="doi", url="url"))
def src_unpaywall(spark, d):
    who = F.array(F.struct(F.lit(None).cast("string").alias("given"), F.trim("first_author").alias("family")))
    return _read("unpaywall", _json(spark, d, F.struct("doi", "title", F.lit("2024-01-09").alias("published_date"), _c("journal").alias("journal_name"), who.alias("z_authors"), F.struct("url").alias("best_oa_location")).alias("response")))


@query(_expected("semantic_scholar", f"coalesce({_DOI.replace('{0}', 'doi')}, source_id)", summary="summary", author=_AUTHOR, date="'2023-01-01'", journal="journal", doi="doi", url="url"))
def src_s2(spark, d):
    return _read("semantic_scholar", _json(spark, d, _c("source_id").alias("paperId"), "title", _c("summary").alias("abstract"), F.lit(2023).alias("year"), _c("journal").alias("venue"), F.array(F.struct(_c("first_author").alias("name"))).alias("authors"), F.struct(_c("doi").alias("DOI")).alias("externalIds"), "url"))


@query(_expected("clinical_trials", "source_id", summary="summary", author="first_author", date="'2024-01-09'", journal="'ClinicalTrials.gov'", url="'https://clinicaltrials.gov/study/' || source_id").replace("coalesce(first_author, 'Unknown')", "coalesce(nullif(trim(first_author), ''), 'Unknown')").replace("first_author AS authors", "nullif(trim(first_author), '') AS authors"))
def src_ctgov(spark, d):
    part = lambda name, *c: F.struct(*c).alias(name)
    p = F.struct(part("identificationModule", _c("source_id").alias("nctId"), _c("title").alias("briefTitle")), part("descriptionModule", _c("summary").alias("briefSummary")), part("statusModule", F.lit("2024-01-09").alias("studyFirstSubmitDate")), part("sponsorCollaboratorsModule", part("leadSponsor", F.trim("first_author").alias("name"))))
    return _read("clinical_trials", _json(spark, d, p.alias("protocolSection")))


def _xml(c: str):
    out = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tag(name: str, inner):
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))


def _oai(spark, d):
    body = F.concat(_tag("id", _xml("source_id")), _tag("updated", F.lit("2024-02-01")), _tag("authors", _tag("author", F.concat(_tag("keyname", F.lit("Lo")), _tag("forenames", F.lit("Anna"))))), _tag("title", _xml("title")), _tag("doi", _xml("doi")), _tag("abstract", _xml("summary")))
    return candidates(spark, d).select(_tag("record", _tag("metadata", _tag("arXiv", body))).alias("payload"))


_SOURCE_ID = "trim(source_id)"


@query(f"SELECT 'arxiv:' || trim(source_id) AS uid, 'Anna Lo' AS authors, '2024-02-01' AS pub_date, {_DOI.replace('{0}', 'doi')} AS doi FROM {_C} WHERE {_CLEAN.replace('{0}', 'title')} IS NOT NULL AND nullif(trim(source_id), '') IS NOT NULL")
def src_arxiv_oai(spark, d):
    return S.list_source("arxiv", _oai(spark, d)).select("uid", "authors", "pub_date", "doi")


def _rss(spark, d):
    body = F.concat(_tag("title", F.concat(F.lit("[cs.CY] "), _xml("title"))), _tag("link", F.concat(F.lit("https://arxiv.example/abs/"), _xml("source_id"))), _tag("description", F.concat(F.lit("Authors: Anna Lo, Bo Li Abstract: "), _xml("journal"))), _tag("pubDate", F.lit("Mon, 18 May 2026 00:00:00 GMT")))
    return candidates(spark, d).select(_tag("item", body).alias("payload"))


@query(f"SELECT 'arxiv:' || trim(source_id) AS uid, 'Anna Lo' AS first_author, '2026-05-18' AS pub_date, {_CLEAN.replace('{0}', 'journal')} AS summary FROM {_C} WHERE {_CLEAN.replace('{0}', 'title')} IS NOT NULL AND nullif(trim(source_id), '') IS NOT NULL")
def src_arxiv_rss(spark, d):
    return S.list_source("arxiv_rss", _rss(spark, d)).select("uid", "first_author", "pub_date", "summary")


@query(f"SELECT 'arxiv:' || trim(source_id) AS uid, 2 AS n_records, {_DOI.replace('{0}', 'doi')} AS doi FROM {_C} WHERE {_CLEAN.replace('{0}', 'title')} IS NOT NULL AND nullif(trim(source_id), '') IS NOT NULL")
def src_arxiv(spark, d):
    """Both feeds of a source as one list: records of one key are merged."""
    both = S.merged_lists([S.list_source("arxiv", _oai(spark, d)), S.list_source("arxiv_rss", _rss(spark, d))])
    return both.select("uid", F.col("n_records").cast("int").alias("n_records"), "doi")


@query(f"SELECT label, count(*) AS n FROM (SELECT CASE source {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in T.SOURCE_LABELS.items())} END AS label FROM {_C} WHERE contains({_FORM.replace('{0}', 'title')}, 'alert')) GROUP BY 1")
def src_dispatch(spark, d):
    """Lists of all sources, kept where they meet the workspace's words."""
    group = F.array(F.struct(F.array(F.lit("alert")).alias("tokens"), F.array(F.lit("alert")).alias("anchors"), F.array().cast("array<string>").alias("domains"), F.array().cast("array<string>").alias("tech")))
    title = T.search_form(F.col("title"))
    kept = candidates(spark, d).where(I.matches_groups(title, title, group))
    return kept.groupBy(T.source_label(F.col("source")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT cand_uid FROM {_C} WHERE {_DAY} IS NULL OR {_DAY} BETWEEN '2024-01-01' AND '2025-12-31'")
def flt_known_date(spark, d):
    """Records of the window, and those whose date is missing or can't be read."""
    return candidates(spark, d).where(I.in_window(F.col("pub_date"), F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date"))).select("cand_uid")


@query(f"SELECT cand_uid, strftime({_DAY}, '%Y-%m-%d') AS d FROM {_C}")
def fn_candidate_date(spark, d):
    return candidates(spark, d).select("cand_uid", T.candidate_date(F.col("pub_date")).cast("string").alias("d"))


_RUN = f"(SELECT source AS run_id, cand_uid AS uid, row_number() OVER (PARTITION BY source ORDER BY cand_uid) AS seq, nullif({_DOI.replace('{0}', 'doi')}, '') AS dk, nullif({_TITLE.replace('{0}', 'title')}, '') AS tk FROM {_C})"


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM {_RUN}),
r AS (SELECT run_id, 0::BIGINT AS seq, NULL::VARCHAR AS uid, []::VARCHAR[] AS ds, []::VARCHAR[] AS ts, false AS kept FROM c GROUP BY 1 UNION ALL
SELECT c.run_id, c.seq, c.uid, CASE WHEN k AND dk IS NOT NULL THEN list_append(ds, dk) ELSE ds END, CASE WHEN k AND tk IS NOT NULL THEN list_append(ts, tk) ELSE ts END, k FROM (SELECT c.*, r.ds, r.ts, NOT (coalesce(list_contains(r.ds, c.dk), false) OR coalesce(list_contains(r.ts, c.tk), false)) AS k FROM r JOIN c ON c.run_id = r.run_id AND c.seq = r.seq + 1) c)
SELECT run_id, uid, CASE WHEN kept THEN 'deduped' ELSE 'skipped_cross_source' END AS status FROM r WHERE seq > 0""")
def win_cross_source_first(spark, d):
    """Within a run (here: a source) a candidate is kept unless a kept earlier one shares its DOI or title."""
    from pyspark.sql import Window

    c = candidates(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("source").orderBy("cand_uid")))
    return I.first_of_run(c.select("source", F.col("cand_uid").alias("uid"), "title", "doi", "seq"), run="source").select("run_id", "uid", "status")


_BLANK = "nullif(trim({0}), '')"
_RICH = f"(CASE WHEN {_BLANK.replace('{0}', 'doi')} IS NULL THEN 0 ELSE 1 END + CASE WHEN {_BLANK.replace('{0}', 'summary')} IS NULL THEN 0 ELSE 2 END + CASE WHEN {_BLANK.replace('{0}', 'pub_date')} IS NULL THEN 0 ELSE 1 END + CASE WHEN {_BLANK.replace('{0}', 'authors')} IS NULL THEN 0 ELSE 1 END)"


@query(f"SELECT cand_uid AS uid, 2 AS n_records, CASE WHEN {_RICH} > 1 THEN coalesce({_BLANK.replace('{0}', 'title')}, 'a sparse title') ELSE 'a sparse title' END AS title, coalesce(CASE WHEN {_RICH} > 1 THEN coalesce({_BLANK.replace('{0}', 'authors')}, 'Lo, Anna') ELSE 'Lo, Anna' END) AS authors, coalesce({_BLANK.replace('{0}', 'doi')}, doi) AS doi, {_BLANK.replace('{0}', 'summary')} AS summary FROM {_C}")
def agg_merge_candidates(spark, d):
    """A sparse record and a later one of the same key: the richer is the base, the other fills its blanks."""
    c = candidates(spark, d).withColumnRenamed("cand_uid", "uid")
    none = F.lit(None).cast("string")
    sparse = c.select("uid", F.lit(1).alias("seq"), F.lit("a sparse title").alias("title"), none.alias("summary"), F.lit("Anna").alias("first_author"), F.lit("Lo, Anna").alias("authors"), none.alias("pub_date"), none.alias("journal"), none.alias("doi"), none.alias("url"))
    both = sparse.unionByName(c.select("uid", F.lit(2).alias("seq"), "title", "summary", "first_author", "authors", "pub_date", "journal", "doi", "url"))
    return I.merge_candidates(both).select("uid", F.col("n_records").cast("int").alias("n_records"), "title", "authors", "doi", F.nullif(F.trim("summary"), F.lit("")).alias("summary"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])|\s+')) AS n_tokens FROM documents WHERE text IS NOT NULL")
def fn_count_tokens(spark, d):
    """Pieces of every document, of any script."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.pieces(F.col("text"))).cast("long").alias("n_tokens"))


_CUT = "CASE WHEN strlen(text) < 20 THEN text " + " ".join(f"WHEN contains(text, '{m}') AND length(text) - instr(reverse(text), '{m}') + 1 > length(text) / 2 THEN trim(left(text, length(text) - instr(reverse(text), '{m}') + 1))" for m in ".?!") + " ELSE trim(text) END"


@query(f"SELECT doc_id, {_CUT} AS cut FROM documents")
def fn_sentence_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentence_cut(F.col("text")).alias("cut"))


_ODD = "(SELECT doc_id, text FROM documents UNION ALL SELECT -a, t FROM (VALUES (1, '  two  blanks  around '), (2, 'a' || chr(10) || chr(10) || chr(10) || chr(10) || 'b'), (3, ''), (4, NULL), (5, chr(9) || 'x  y' || chr(9))) v(a, t))"


def _odd_docs(spark, d):
    odd = [(-1, "  two  blanks  around "), (-2, "a\n\n\n\nb"), (-3, ""), (-4, None), (-5, "\tx  y\t")]
    return table(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS clean FROM {_ODD}".replace("{{", "{").replace("}}", "}"))
def fn_clean_text_doc(spark, d):
    return _odd_docs(spark, d).select("doc_id", T.clean_document(F.col("text")).alias("clean"))


@query("SELECT doc_id, CASE WHEN length(text) <= 24000 THEN text ELSE left(text, 16000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 8000) END AS bounded FROM (SELECT doc_id, text || repeat(text, 20) AS text FROM documents)")
def fn_bound_kg_text(spark, d):
    """Texts twenty-one times over, so that many are too long."""
    return table(spark, d, "documents").select("doc_id", T.bounded_text(F.concat("text", F.repeat("text", F.lit(20)))).alias("bounded"))


@query("SELECT doc_id, CASE WHEN length(text) <= 16000 THEN text ELSE left(text, 8000) || m || substr(text, greatest(least(length(text) // 2 - 2000, length(text) - 8000), 8000) + 1, 4000) || m || right(text, 4000) END AS compact FROM (SELECT doc_id, text || repeat(text, 20) AS text, chr(10) || chr(10) || '[...]' || chr(10) || chr(10) AS m FROM documents)")
def fn_compact_eval_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.head_middle_tail(F.concat("text", F.repeat("text", F.lit(20)))).alias("compact"))


@query("SELECT doc_id, CASE WHEN length(x) <= 24000 THEN x ELSE left(x, 16000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(x, 8000) END AS prepared FROM (SELECT doc_id, CASE WHEN nullif(trim(title),'') IS NULL OR trim(title) = coalesce(nullif(trim(text),''), trim(title)) THEN coalesce(nullif(trim(text),''), nullif(trim(title),'')) ELSE 'Title: ' || trim(title) || chr(10) || chr(10) || coalesce(nullif(trim(text),''), trim(title)) END AS x FROM documents)")
def fn_prepare_kg_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.titled_text(F.col("title"), F.col("text")).alias("prepared"))


_QUOTED = "(SELECT doc_id, title FROM documents UNION ALL SELECT -a, t FROM (VALUES (1, 'the \"hard\" case'), (2, 'a b'), (3, ' \"x ')) v(a, t))"


@query(r"""SELECT doc_id, CASE WHEN len(ws) > 0 THEN array_to_string(list_transform(ws, lambda w: '"' || replace(w, '"', '""') || '"'), ' OR ') ELSE '"' || replace(trim(title), '"', '""') || '"' END AS match_query FROM (SELECT doc_id, title, list_filter(string_split_regex(trim(title), '\s+'), lambda w: strlen(w) >= 2) AS ws FROM """ + _QUOTED + " WHERE title IS NOT NULL)")
def fn_fts_query(spark, d):
    odd = spark.createDataFrame([(-1, 'the "hard" case'), (-2, "a b"), (-3, ' "x ')], "doc_id long, title string")
    docs = table(spark, d, "documents").select("doc_id", "title").unionByName(odd)
    return docs.where("title is not null").select("doc_id", T.match_query(F.col("title")).alias("match_query"))


@query()
def fn_dehyphenate(spark, d):
    """No SQL: the pattern looks behind, which the checking engine can't."""
    return table(spark, d, "article_input").select("uid", T.dehyphenated(F.col("full_text")).alias("text")).distinct()


_NEAR = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_MIX = "list_transform(list_zip(a.v, b.v), lambda p: p[1] + {0} * p[2])"


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id, a.label, list_transform(list_zip(a.v, b.v), lambda p: p[1] + CASE WHEN a.vec_id % 200 = 0 THEN 0.1 ELSE 0.7 END * p[2]) AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0),
s AS (SELECT n.vec_id, k.vec_id AS entity_id, round(list_dot_product(n.v, k.v) / (sqrt(list_dot_product(n.v, n.v)) * sqrt(list_dot_product(k.v, k.v))), 6) AS similarity FROM p n JOIN e k USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, entity_id) AS rank, max(similarity) OVER (PARTITION BY vec_id) AS best FROM s WHERE similarity >= 0.8)
SELECT vec_id, entity_id, similarity, rank::INTEGER AS rank, CASE WHEN best >= 0.9 THEN 'same' ELSE 'ambiguous' END AS verdict FROM r WHERE rank = 1 OR (best < 0.9 AND rank <= 5)""")
def join_type_blocked_cosine(spark, d):
    """New vectors, made of a known one and a part of its neighbour, against all of their type."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("type"), "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    share = F.when(F.col("vec_id") % 200 == 0, F.lit(0.1)).otherwise(F.lit(0.7))
    new = e.where("vec_id % 100 = 0").join(nxt, "vec_id").select("vec_id", "type", F.zip_with("embedding", "other", lambda a, b: a.cast("double") + share * b.cast("double")).alias("embedding"))
    return resolve_vectors(new, e).select("vec_id", "entity_id", "similarity", "rank", "verdict")


@query()
def win_greedy_graph_select(spark, d):
    """No SQL: each edge depends on those taken before it; a test replays the rule."""
    return G.select_graph(kb.edges(spark, d), 60)


@query("SELECT uid, CASE WHEN first IS NULL THEN 'Unknown' ELSE first END AS first, CASE WHEN len(names) > 0 THEN array_to_string(names, ', ') END AS authors FROM (SELECT uid, names, names[1] AS first FROM (SELECT uid, list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> '') AS names FROM {art}))")
def fn_extract_authors(spark, d):
    names = F.filter(F.transform(F.split("authors", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return kb.articles(spark, d).select("uid", T.author_list(names).alias("a")).select("uid", F.coalesce("a.first", F.lit("Unknown")).alias("first"), "a.authors")


@query("SELECT uid, doi FROM {art}")
def fn_extract_doi(spark, d):
    """The DOI among a record's identifiers."""
    ids = F.array(F.struct(F.lit("pii").alias("idtype"), F.lit("x").alias("value")), F.struct(F.lit("doi").alias("idtype"), F.col("doi").alias("value")))
    return kb.articles(spark, d).select("uid", T.identifier(ids, "doi").alias("doi"))


@query(f"SELECT cand_uid, {_CLEAN.replace('{0}', 'title')} AS title FROM {_C}")
def fn_rss_title(spark, d):
    """Titles of a feed without the category before them."""
    return candidates(spark, d).select("cand_uid", T.feed_title(F.concat(F.lit("[cs.CY] "), F.col("title"))).alias("title"))


@query("SELECT DISTINCT id, CASE WHEN length(output_text) > 2000 THEN left(output_text, 2000) || '...' ELSE output_text END AS stored FROM (SELECT id, min(output_text) AS output_text FROM prompt_traces GROUP BY id)")
def fn_trace_truncate(spark, d):
    t = table(spark, d, "prompt_traces").groupBy("id").agg(F.min("output_text").alias("output_text"))
    return t.select("id", T.truncated(F.col("output_text"), 2000).alias("stored"))


@query("SELECT * FROM (VALUES (0, 2), (1, 4), (2, 8), (3, 16), (4, 16), (9, 16)) v(attempt, seconds)")
def src_retry(spark, d):
    """Waits before another attempt: two seconds doubled, four times at most."""
    return spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 9)], "attempt int").select("attempt", T.retry_seconds(F.col("attempt")).alias("seconds"))


_TEXTQ = "len(list_filter(['alert', 'fatigue', 'triage'], lambda w: contains({0}, w)))"


@query(f"SELECT cand_uid FROM {_C} WHERE {_TEXTQ.replace('{0}', _FORM.replace('{0}', chr(39) + chr(39) + ' || concat_ws(' + repr(' ') + ', title, summary, journal)'))} >= 2")
def flt_text_query(spark, d):
    """Records with two words of a query or more."""
    words = F.array(*map(F.lit, ("alert", "fatigue", "triage")))
    return candidates(spark, d).where(I.matches_words(I.candidate_text(), words, F.array().cast("array<string>"))).select("cand_uid")


_SAID = "(SELECT id, CASE WHEN id % 5 = 0 THEN '{\"relevant\": \"No\"}' WHEN id % 5 = 1 THEN '{\"relevant\": \"yes\"}' WHEN id % 5 = 2 THEN 'NO, not relevant' WHEN id % 5 = 3 THEN '{}' ELSE NULL END AS said FROM (SELECT DISTINCT id FROM prompt_traces))"


@query(f"SELECT id, NOT (id % 5 IN (0, 2)) AS relevant FROM {_SAID}")
def flt_screen_parse(spark, d):
    """What a screening answer decides: relevant unless it says no; no answer and no decision leave a record in."""
    i = F.col("id") % 5
    said = F.when(i == 0, '{"relevant": "No"}').when(i == 1, '{"relevant": "yes"}').when(i == 2, "NO, not relevant").when(i == 3, "{}")
    return table(spark, d, "prompt_traces").select("id").distinct().select("id", I.screened_relevant(said).alias("relevant"))


@query("SELECT uid, coalesce(nullif(trim(journal), ''), 'from the model') AS journal, 'from the model' AS ai_tech FROM {art}")
def fn_overlay_meta(spark, d):
    """What a source says of a record stands over what a model says of it."""
    a = kb.articles(spark, d).select("uid", F.create_map(F.lit("journal"), F.lit("from the model"), F.lit("ai_tech"), F.lit("from the model")).alias("said"), "journal")
    m = T.overlaid(F.col("said"), F.create_map(F.lit("journal"), T.present(F.col("journal"))))
    return a.select("uid", m["journal"].alias("journal"), m["ai_tech"].alias("ai_tech"))


@query("SELECT uid, journal, title FROM {art}")
def fn_flatten_sections(spark, d):
    """Fields a model put into sections of its answer are hoisted."""
    said = F.to_json(F.struct(F.struct("journal").alias("metadata"), F.struct("title").alias("content")))
    m = T.hoisted(said, ["journal", "title"])
    return kb.articles(spark, d).select("uid", m["journal"].alias("journal"), m["title"].alias("title"))


@query("SELECT uid, 'full' AS found FROM {art} WHERE nullif(trim(abstract_text), '') IS NOT NULL AND content_type IN ('pdf', 'xml', 'html') UNION ALL SELECT uid, CASE WHEN nullif(trim(byline_summary), '') IS NOT NULL THEN 'summary' WHEN content_type = 'pdf_stored' THEN 'pdf_stored' ELSE 'none' END FROM {art} WHERE NOT (nullif(trim(abstract_text), '') IS NOT NULL AND content_type IN ('pdf', 'xml', 'html'))")
def src_fetch_fallback(spark, d):
    """The first of several ways that gave a text: full text, summary, a stored PDF, none."""
    full = F.when(F.col("content_type").isin("pdf", "xml", "html"), T.present(F.col("abstract_text")))
    stored = F.when(F.col("content_type") == "pdf_stored", F.lit("(stored)"))
    return kb.articles(spark, d).select("uid", T.first_way({"full": full, "summary": T.present(F.col("byline_summary")), "pdf_stored": stored}).alias("found"))


@query("SELECT doc_id, '<p>' || regexp_replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\*\\*([^*]+)\\*\\*', '<strong>\\1</strong>', 'g') || '</p>' AS html FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(title, '[_`\\[\\]#]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents WHERE title IS NOT NULL)")
def fn_md_html(spark, d):
    """Titles as Markdown; tests cover lists, headings, code and links."""
    from biblion.operators.wiki import to_html

    plain = F.trim(F.regexp_replace(F.regexp_replace("title", r"[_`\[\]#]", ""), r"\s+", " "))
    return to_html(table(spark, d, "documents").where("title is not null").select("doc_id", plain.alias("md")), "doc_id", "md")
