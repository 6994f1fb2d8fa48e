"""Mappers from landed source payloads to one candidate record.

Fetching, paging, retries and rate limits belong to the landing job; a mapper takes the
landed JSON or XML text in column ``payload`` and yields the ten record columns.
Records without id or title give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import clean_text, date_parts, feed_date, feed_field, inverted_abstract, normalize_doi, partial_date, preprint_id, present

RECORD = ["uid", "source", "source_id", "title", "summary", "first_author", "authors", "pub_date", "journal", "doi", "url"]


def _record(df: DataFrame, source: str, **c: Column) -> DataFrame:
    names = c.get("names", F.array().cast("array<string>"))
    df = df.select(
        F.lit(source).alias("source"), present(c["source_id"]).alias("source_id"), present(clean_text(c["title"])).alias("title"),
        present(clean_text(c.get("summary", F.lit(None)))).alias("summary"), F.coalesce(present(F.get(names, F.lit(0))), F.lit("Unknown")).alias("first_author"),
        present(F.array_join(names, ", ")).alias("authors"), c.get("pub_date", F.lit(None)).cast("string").alias("pub_date"),
        present(clean_text(c.get("journal", F.lit(None).cast("string")))).alias("journal"), present(normalize_doi(c.get("doi", F.lit(None).cast("string")))).alias("doi"),
        present(c.get("url", F.lit(None).cast("string"))).alias("url"),
    )
    df = df.where("source_id is not null and title is not null")
    return df.withColumn("uid", F.concat_ws(":", "source", "source_id")).select(*RECORD)


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("payload", schema).alias("j"))


def _names(array: str, field: str | None = None) -> Column:
    clean = lambda x: present(clean_text(x[field] if field else x))
    return F.array_compact(F.transform(F.col(array), clean))


def pubmed(df: DataFrame) -> DataFrame:
    d = _parsed(df, "uid string, title string, authors array<struct<name:string>>, pubdate string, fulljournalname string, elocationid string, articleids array<struct<idtype:string,value:string>>")
    ids = F.get(F.filter("j.articleids", lambda x: x["idtype"] == "doi"), F.lit(0))["value"]
    own = F.when(F.col("j.elocationid").startswith("doi:"), F.col("j.elocationid"))
    return _record(d, "pubmed", source_id=F.col("j.uid"), title=F.col("j.title"), names=_names("j.authors", "name"), pub_date=partial_date(F.col("j.pubdate")),
                   journal=F.col("j.fulljournalname"), doi=F.coalesce(own, ids), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "j.uid", F.lit("/")))


def pmc(df: DataFrame) -> DataFrame:
    d = _parsed(df, "uid string, title string, authors array<struct<name:string>>, pubdate string, fulljournalname string, articleids array<struct<idtype:string,value:string>>")
    doi = F.get(F.filter("j.articleids", lambda x: x["idtype"] == "doi"), F.lit(0))["value"]
    return _record(d, "pmc", source_id=F.concat(F.lit("PMC"), F.regexp_replace("j.uid", "^PMC", "")), title=F.col("j.title"), names=_names("j.authors", "name"),
                   pub_date=partial_date(F.col("j.pubdate")), journal=F.col("j.fulljournalname"), doi=doi)


def pmc_links(df: DataFrame) -> DataFrame:
    """``pmc_id``, ``pubmed_id``: the first PubMed link of each set."""
    d = df.select(F.explode(F.from_json("payload", "linksets array<struct<ids:array<string>,linksetdbs:array<struct<dbto:string,links:array<string>>>>>")["linksets"]).alias("s"))
    link = F.get(F.get(F.filter("s.linksetdbs", lambda x: x["dbto"] == "pubmed"), F.lit(0))["links"], F.lit(0))
    return d.select(F.get("s.ids", F.lit(0)).alias("pmc_id"), link.alias("pubmed_id")).where("pmc_id is not null and pubmed_id is not null")


def europe_pmc(df: DataFrame) -> DataFrame:
    d = _parsed(df, "pmid string, pmcid string, id string, title string, abstractText string, authorString string, firstPublicationDate string, journalTitle string, doi string, fullTextUrlList struct<fullTextUrl:array<struct<url:string>>>")
    names = F.array_compact(F.transform(F.split("j.authorString", ",\\s*"), lambda x: present(F.regexp_replace(x, r"\.$", ""))))
    return _record(d, "europepmc", source_id=F.coalesce("j.pmid", "j.pmcid", "j.id"), title=F.col("j.title"), summary=F.col("j.abstractText"), names=names,
                   pub_date=F.col("j.firstPublicationDate"), journal=F.col("j.journalTitle"), doi=F.col("j.doi"), url=F.get("j.fullTextUrlList.fullTextUrl", F.lit(0))["url"])


def preprint_server(df: DataFrame, server: str = "medrxiv") -> DataFrame:
    d = _parsed(df, "doi string, title string, abstract string, authors string, date string, version string").where("j.doi <> ''")
    return _record(d, server, source_id=F.col("j.doi"), title=F.col("j.title"), summary=F.col("j.abstract"), names=F.filter(F.transform(F.split("j.authors", ";"), lambda x: F.trim(x)), lambda x: x != ""),
                   pub_date=F.col("j.date"), journal=F.lit(server), doi=F.col("j.doi"), url=F.concat(F.lit(f"https://www.{server}.org/content/"), "j.doi"))


def openalex(df: DataFrame) -> DataFrame:
    d = df.select(F.from_json("payload", "id string, title string, doi string, publication_date string, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>").alias("j"),
                  F.get_json_object("payload", "$.abstract_inverted_index").alias("inv"))
    return _record(d, "openalex", source_id=F.element_at(F.split("j.id", "/"), -1), title=F.col("j.title"), summary=inverted_abstract(F.col("inv")),
                   names=F.array_compact(F.transform("j.authorships", lambda x: present(x["author"]["display_name"]))), pub_date=F.col("j.publication_date"),
                   journal=F.col("j.primary_location.source.display_name"), doi=F.col("j.doi"), url=F.col("j.primary_location.landing_page_url"))


def crossref(df: DataFrame) -> DataFrame:
    d = _parsed(df, "DOI string, title array<string>, abstract string, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, URL string")
    part = lambda i: F.get(F.get(F.col("j.issued").getField("date-parts"), F.lit(0)), F.lit(i))
    names = F.array_compact(F.transform("j.author", lambda a: present(clean_text(F.concat_ws(" ", a["given"], a["family"])))))
    return _record(d, "crossref", source_id=normalize_doi(F.col("j.DOI")), title=F.get("j.title", F.lit(0)), summary=F.col("j.abstract"), names=names, pub_date=date_parts(part(0), part(1), part(2)),
                   journal=F.get(F.col("j").getField("container-title"), F.lit(0)), doi=F.col("j.DOI"), url=F.col("j.URL"))


def doaj(df: DataFrame) -> DataFrame:
    d = _parsed(df, "id string, bibjson struct<title:string,abstract:string,year:string,month:string,author:array<struct<name:string>>,journal:struct<title:string>,identifier:array<struct<type:string,id:string>>,link:array<struct<type:string,url:string>>>")
    of = lambda a, kind: F.get(F.filter(a, lambda x: F.lower(x["type"]) == kind), F.lit(0))
    num = lambda c: F.expr(f"try_cast({c} as int)")
    return _record(d, "doaj", source_id=F.col("j.id"), title=F.col("j.bibjson.title"), summary=F.col("j.bibjson.abstract"), names=_names("j.bibjson.author", "name"),
                   pub_date=date_parts(num("j.bibjson.year"), num("j.bibjson.month"), F.lit(None).cast("int")), journal=F.col("j.bibjson.journal.title"),
                   doi=of("j.bibjson.identifier", "doi")["id"], url=of("j.bibjson.link", "fulltext")["url"])


def unpaywall(df: DataFrame) -> DataFrame:
    fields = ["doi string", "title string", "published_date string", "journal_name string", "z_authors array<struct<given:string,family:string>>", "best_oa_location struct<url_for_pdf:string,url:string>"]
    inner = ",".join(f.replace(" ", ":", 1) for f in fields)
    d = df.select(F.from_json("payload", f"response struct<{inner}>")["response"].alias("a"), F.from_json("payload", ", ".join(fields)).alias("b"))
    d = d.select(F.when(F.col("a.doi").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("j")).where("j.doi is not null")
    names = F.array_compact(F.transform("j.z_authors", lambda a: present(F.concat_ws(" ", a["given"], a["family"]))))
    return _record(d, "unpaywall", source_id=normalize_doi(F.col("j.doi")), title=F.col("j.title"), names=names, pub_date=F.col("j.published_date"), journal=F.col("j.journal_name"),
                   doi=F.col("j.doi"), url=F.coalesce("j.best_oa_location.url_for_pdf", "j.best_oa_location.url"))


def semantic_scholar(df: DataFrame) -> DataFrame:
    d = _parsed(df, "paperId string, title string, abstract string, year int, publicationDate string, venue string, authors array<struct<name:string>>, externalIds struct<DOI:string>, url string")
    return _record(d, "semantic_scholar", source_id=F.coalesce(present(normalize_doi(F.col("j.externalIds.DOI"))), F.col("j.paperId")), title=F.col("j.title"), summary=F.col("j.abstract"), names=_names("j.authors", "name"),
                   pub_date=F.coalesce(present(F.col("j.publicationDate")), F.concat(F.col("j.year").cast("string"), F.lit("-01-01"))), journal=F.col("j.venue"), doi=F.col("j.externalIds.DOI"), url=F.col("j.url"))


def clinical_trials(df: DataFrame) -> DataFrame:
    d = _parsed(df, "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>,descriptionModule:struct<briefSummary:string>,statusModule:struct<studyFirstSubmitDate:string>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>>")
    p = "j.protocolSection."
    return _record(d, "clinical_trials", source_id=F.col(p + "identificationModule.nctId"), title=F.col(p + "identificationModule.briefTitle"), summary=F.col(p + "descriptionModule.briefSummary"),
                   names=F.array_compact(F.array(p + "sponsorCollaboratorsModule.leadSponsor.name")), pub_date=F.col(p + "statusModule.studyFirstSubmitDate"), journal=F.lit("ClinicalTrials.gov"),
                   url=F.concat(F.lit("https://clinicaltrials.gov/study/"), p + "identificationModule.nctId"))


def arxiv_oai(df: DataFrame) -> DataFrame:
    """OAI records as XML in ``payload``: authors as "forenames keyname", the date created, else updated."""
    d = df.select(F.from_xml("payload", "metadata struct<arXiv:struct<id:string,created:string,updated:string,authors:struct<author:array<struct<keyname:string,forenames:string>>>,title:string,doi:string,abstract:string>>").alias("x"))
    a = "x.metadata.arXiv."
    names = F.array_compact(F.transform(a + "authors.author", lambda n: present(F.concat_ws(" ", n["forenames"], n["keyname"]))))
    return _record(d, "arxiv", source_id=F.col(a + "id"), title=F.col(a + "title"), summary=F.col(a + "abstract"), names=names, pub_date=F.coalesce(present(F.col(a + "created")), F.col(a + "updated")),
                   journal=F.lit("arXiv"), doi=F.col(a + "doi"), url=F.concat(F.lit("https://arxiv.org/pdf/"), a + "id"))


def arxiv_rss(df: DataFrame) -> DataFrame:
    """RSS items as XML in ``payload``: the title's ``[category]`` dropped, labelled fields cut from the description."""
    d = df.select(F.from_xml("payload", "title string, link string, guid string, description string, pubDate string, creator string").alias("i"))
    title = F.regexp_replace(F.trim("i.title"), r"^\[[^\]]*\]\s*", "")
    text = F.col("i.description")
    names = F.array_compact(F.transform(F.split(F.coalesce(feed_field(text, "authors"), F.col("i.creator")), r"[,;]"), lambda x: present(x)))
    summary = F.coalesce(feed_field(text, "abstract"), F.when(~text.rlike("(?i)authors:|subjects:"), text))
    return _record(d, "arxiv", source_id=preprint_id(F.coalesce("i.link", "i.guid")), title=title, summary=summary, names=names, pub_date=feed_date(F.col("i.pubDate")), journal=F.lit("arXiv"), url=F.col("i.link"))


CONNECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "arxiv": arxiv_oai, "arxiv_rss": arxiv_rss, "pmc": pmc, "pubmed": pubmed, "europepmc": europe_pmc, "medrxiv": preprint_server,
    "biorxiv": lambda df: preprint_server(df, "biorxiv"), "openalex": openalex, "crossref": crossref, "doaj": doaj, "unpaywall": unpaywall,
    "semantic_scholar": semantic_scholar, "clinical_trials": clinical_trials,
}


def list_source(source: str, landed: DataFrame) -> DataFrame:
    """Candidates of a source from its landed payloads."""
    if source not in CONNECTORS:
        raise ValueError(f"unknown source {source!r}")
    return CONNECTORS[source](landed)


def merged_lists(lists: list[DataFrame]) -> DataFrame:
    """Several lists of records as one: records of one key are merged in the order of the lists."""
    from biblion.operators.ingest import merge_candidates

    out = None
    for i, df in enumerate(lists):
        numbered = df.withColumn("seq", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered)
    return merge_candidates(out)


def source_list(lists: list[DataFrame], window: tuple[Column, Column] | None = None) -> DataFrame:
    """The lists of a source's queries as one; where its server filters no dates, records outside the window are dropped here."""
    from biblion.operators.ingest import in_window

    out = merged_lists(lists)
    return out.where(in_window(F.trim("pub_date"), *window)) if window else out


def first_of_key(records: DataFrame, seq: str) -> DataFrame:
    """Of the records of one DOI, else of one title, the first; records with neither stay."""
    key = F.coalesce(present(normalize_doi(F.col("doi"))), F.concat(F.lit("t:"), F.lower(F.trim("title"))), F.concat(F.lit("u:"), "uid"))
    rest = [c for c in records.columns if c != seq]
    return records.groupBy(key.alias("__k")).agg(F.min_by(F.struct(seq, *rest), seq).alias("v")).select("v.*")


def rxiv_categories(server: Column, terms: Column) -> Column:
    """Categories of a preprint server that are listed for words about diabetes; none for others."""
    # The two categories.
    both = F.array(F.lit("endocrinology"), F.lit("health_informatics"))
    return F.when((server == "medrxiv") & F.lower(terms).rlike("diabet|glyc|glucose"), both).otherwise(F.array().cast("array<string>"))


def page_cursors(total: Column, size: int, most: int) -> Column:
    """Where the pages of a listing start."""
    return F.slice(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(size)), 1, most)


def spaced(requests: DataFrame, host: str, at: str, seq: str, seconds: int) -> DataFrame:
    """Requests with the time ``at`` they may go out: ``seconds`` after the one before it to the same host at the earliest."""
    w = Window.partitionBy(host).orderBy(at, seq)
    before = F.coalesce(F.floor(F.unix_timestamp(F.lag(at).over(w))), F.lit(0))
    return requests.withColumn("__before", before).withColumn("at", F.timestamp_seconds(F.greatest(F.unix_timestamp(at), F.col("__before") + seconds))).drop("__before")
