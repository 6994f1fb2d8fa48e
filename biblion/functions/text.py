"""Scalar functions on text, dates and lists, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase rewrites of the search normal form, in order.
PHRASES = [
    ("large language model", "llm"), ("large-language-model", "llm"), ("chat bot", "chatbot"), ("chat-bot", "chatbot"),
    ("self-management", "self management"),
]
# Words a workspace query is not focused by; words that are no anchors; domain and technology words.
QUERY_STOPWORDS = (
    "adult adults clinical education intervention large language life management model outcome outcomes patient patients quality randomized "
    "research safety self study trial type usual"
).split()
ANCHOR_STOPWORDS = "adherence agent cgm diabetes glycemic glucose hba1c monitoring".split()
DOMAIN_WORDS = "diabetes glycemic glycaemic glucose hba1c".split()
TECH_WORDS = "cgm chatbot chatgpt conversational digital llm virtual".split()
# Source ids and their labels.
SOURCE_LABELS = {
    "arxiv": "arXiv", "pmc": "PMC", "pubmed": "PubMed", "europepmc": "Europe PMC", "medrxiv": "medRxiv", "biorxiv": "bioRxiv",
    "openalex": "OpenAlex", "crossref": "Crossref", "doaj": "DOAJ", "unpaywall": "Unpaywall", "semantic_scholar": "Semantic Scholar",
    "clinical_trials": "ClinicalTrials.gov",
}
# Words in a section's title and the type of its chunks; the first that occurs decides.
CHUNK_TYPES = [
    ("abstract", "abstract"), ("introduction|background", "introduction"), ("method", "methods"), ("result", "results"),
    ("discussion", "discussion"), ("conclusion", "conclusion"), ("reference|bibliography", "references"),
]


def present(c: Column) -> Column:
    """``c`` without outer blanks, NULL if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_doi(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://|dx\.doi\.org/|www\.doi\.org/|doi\.org/|doi:|\s)+", "")
    return F.trim(F.regexp_replace(bare, r"[.,]+$", ""))


def search_form(c: Column) -> Column:
    out = F.lower(c)
    for old, new in PHRASES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, "[^a-z0-9]", " ")


def duplicate_title(c: Column) -> Column:
    words = F.filter(F.split(search_form(c), " +"), lambda w: (w != "") & (w != "preprint"))
    return F.array_join(words, " ")


def search_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(search_form(c), " +"), lambda w: F.length(w) >= 3)))


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def focused_tokens(c: Column) -> Column:
    return F.array_except(search_tokens(c), _words(QUERY_STOPWORDS))


def token_groups(c: Column) -> Column:
    t = focused_tokens(c)
    return F.struct(
        t.alias("tokens"), F.array_except(t, _words(ANCHOR_STOPWORDS)).alias("anchors"),
        F.array_intersect(t, _words(DOMAIN_WORDS)).alias("domains"), F.array_intersect(t, _words(TECH_WORDS)).alias("tech"),
    )


def clean_text(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c, "<[^>]*(>|$)", ""), r"\s+", " ")
    return F.regexp_replace(F.trim(plain), r"\.+$", "")


def clean_document(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"), "^[ \n\r\t]+|[ \n\r\t]+$", "")


def first_author(c: Column) -> Column:
    return F.coalesce(present(F.get(F.split(c, "[,;]"), F.lit(0))), F.lit("Unknown"))


def inverted_abstract(c: Column) -> Column:
    """Words of a JSON map word -> positions, in the order of the positions."""
    entries = F.map_entries(F.from_json(c, "map<string,array<int>>"))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def date_parts(year: Column, month: Column, day: Column) -> Column:
    return F.when(year.isNotNull(), F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1))))


def partial_date(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(
        F.try_to_date(t, "yyyy MMM d"), F.try_to_date(F.concat(t, F.lit(" 1")), "yyyy MMM d"), F.try_to_date(F.concat(t, F.lit(" Jan 1")), "yyyy MMM d")
    )


def candidate_date(c: Column) -> Column:
    return F.coalesce(F.try_to_date(c, "yyyy-M-d"), F.try_to_date(c, "yyyy/M/d"))


def feed_date(c: Column) -> Column:
    """ISO dates and the day, month and year of mail dates."""
    return F.coalesce(F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd"), F.try_to_date(F.nullif(F.regexp_extract(c, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("")), "d MMM yyyy"))


def days_since(stamp: Column, as_of: Column) -> Column:
    """Whole days, 0 at least; NULL where there is no time."""
    return F.when(stamp.isNotNull(), F.greatest(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(stamp)) / 86400), F.lit(0)))


def preprint_id(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^.*/(?:abs|pdf)/", ""), r"(?i)^arxiv:", "")
    return present(F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"(?:\.pdf)?/*$", ""))


def feed_field(c: Column, label: str) -> Column:
    return present(F.regexp_extract(c, rf"(?is){label}:(.*?)(?=(?:abstract|authors|subjects|comments|journal-ref):|$)", 1))


def html_entities(c: Column) -> Column:
    out = c
    for name, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def source_label(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv]), c)


def wiki_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def workspace_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("workspace"))


def markdown_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}&&[^\n\r\t]]", ""), r"([\[\]])", r"\\$1")


def truncated(c: Column, chars: int) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


def masked_key(c: Column) -> Column:
    return F.when(F.length(c) <= 8, "***").otherwise(F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4))))


def bounded_text(c: Column, whole: int = 24_000, tail: int = 8_000, mark: str = "\n\n[...]\n\n") -> Column:
    return F.when(F.length(c) <= whole, c).otherwise(F.concat(F.left(c, F.lit(whole - tail)), F.lit(mark), F.right(c, F.lit(tail))))


def head_middle_tail(c: Column, head: int = 8_000, part: int = 4_000, mark: str = "\n\n[...]\n\n") -> Column:
    n = F.length(c)
    start = F.greatest(F.least((n / 2).cast("int") - part // 2, n - 2 * part), F.lit(head))
    middle = F.substr(c, start + 1, F.lit(part))
    return F.when(n <= head + 2 * part, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(mark), middle, F.lit(mark), F.right(c, F.lit(part))))


def titled_text(title: Column, content: Column) -> Column:
    t, body = present(title), F.coalesce(present(content), present(title))
    return bounded_text(F.when(t.isNull() | (t == body), body).otherwise(F.concat(F.lit("Title: "), t, F.lit("\n\n"), body)))


def word_windows(c: Column, size: int = 450, stride: int = 390, most: int = 12) -> Column:
    """Overlapping windows of words; the window that reaches the end is the last."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(starts, lambda s: (s == 0) | (s - stride + size < n))
    return F.slice(F.transform(kept, lambda s: F.array_join(F.slice(words, s + 1, size), " ")), 1, most)


def word_tokens(c: Column) -> Column:
    """Words and single marks; stands for a subword tokenizer where none is given."""
    return F.regexp_extract_all(c, F.lit(r"(\w+|[^\w\s])"), F.lit(1))


def unicode_word_tokens(c: Column) -> Column:
    """Words of any script and single marks."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


#: A token with the blanks before it; the pieces of a text add up to it.
PIECE = r"\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])|\s+"


def pieces(c: Column) -> Column:
    """Words and single marks, each with the blanks before it: encoding without loss, for where no tokenizer file is given."""
    return F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))


def token_windows(c: Column, size: int = 512, shared: int = 64) -> Column:
    """Windows of ``size`` tokens that share ``shared``, each cut back to its last sentence; blank ones are left out."""
    stride = max(1, size - shared)
    p = pieces(c)
    n = F.size(p)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(starts, lambda s: (s == 0) | (s - stride + size < n))
    cut = F.transform(kept, lambda s: sentence_cut(F.array_join(F.slice(p, s + 1, size), "")))
    return F.filter(cut, lambda x: F.trim(x) != "")


def similarity_of(distance: Column) -> Column:
    return 1 - distance


def sentence_cut(c: Column) -> Column:
    """Up to the last full stop in the second half, else the last ? there, else the last !; short texts as they are."""
    n = F.length(c)
    out = None
    for mark in ".?!":
        at = n - F.instr(F.reverse(c), mark) + 1
        hit = (F.instr(c, mark) > 0) & (at > n / 2)
        cut = F.trim(F.left(c, at))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return F.when(F.octet_length(c) < 20, c).otherwise(out.otherwise(F.trim(c)))


def chunk_type(title: Column) -> Column:
    t, out = F.lower(title), F.when(title.isNull(), "body")
    for words, kind in CHUNK_TYPES:
        out = out.when(t.rlike(words), kind)
    return out.otherwise("body")


def dehyphenated(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=.)-\n(?=\p{Ll})", "")


def match_query(c: Column) -> Column:
    """Full-text query: quoted words of two bytes or more joined by OR, else the whole quoted."""
    quote = lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.octet_length(w) >= 2)
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, quote), " OR ")).otherwise(quote(F.trim(c)))


def json_payload(c: Column) -> Column:
    """JSON of a text: the whole, else from the first [ to the last ], else from the first { to the last }."""
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    part = lambda p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    return F.coalesce(valid(c), valid(part(r"(?s)\[.*\]")), valid(part(r"(?s)\{.*\}")))


def json_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def query_preview(terms: Column, n: int) -> Column:
    more = F.size(terms) - n
    return F.concat(F.array_join(F.slice(terms, 1, n), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def chunk_reference(page: Column, section: Column, kind: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Page "), page.cast("string")), F.concat(F.lit("Section: "), present(section)), kind)


def pdf_filename(uid: Column, content: Column) -> Column:
    return F.concat(F.regexp_replace(uid, "[^A-Za-z0-9._-]", "_"), F.lit("-"), F.left(F.sha2(content, 256), F.lit(16)), F.lit(".pdf"))


def publisher_urls(doi: Column) -> Column:
    """Places of a work's PDF by its DOI: array of (url, publisher)."""
    d, low = F.trim(doi), F.lower(F.trim(doi))
    at = lambda cond, url, name: F.when(cond, F.struct(url.alias("url"), F.lit(name).alias("publisher")))
    put = lambda a, b="": F.concat(F.lit(a), d, F.lit(b))
    elife = F.nullif(F.regexp_extract(low, r"^10\.7554/elife\.([^.]+)", 1), F.lit(""))
    # publishers' addresses.
    return F.array_compact(F.array(
        at(low.contains("springer") | low.contains("s41"), put("https://link.springer.com/content/pdf/", ".pdf"), "springer"),
        at(low.contains("nature"), F.concat(F.lit("https://www.nature.com/articles/"), F.substring_index(d, "/", -1), F.lit(".pdf")), "nature"),
        at(low.contains("biomedcentral") | low.contains("bmc"), put("https://bmcmedethics.biomedcentral.com/track/pdf/", ".pdf"), "bmc"),
        at(low.contains("jmir"), put("https://www.jmir.org/article/download/", "/"), "jmir"),
        at(low.contains("cambridge"), put("https://www.cambridge.org/core/services/aop-cambridge-core/content/view/"), "cambridge"),
        at(low.startswith("10.3389/"), put("https://www.frontiersin.org/articles/", "/pdf"), "frontiers"),
        at(low.startswith("10.1371/"), put("https://journals.plos.org/plosone/article/file?id=", "&type=printable"), "plos"),
        at(elife.isNotNull(), F.concat(F.lit("https://elifesciences.org/articles/"), elife, F.lit("/pdf")), "elife"),
    ))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty vectors, unlike lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norms <= 1.2e-7), F.lit(0.0)).otherwise(dot(a, b) / norms)


def name_similarity(query: Column, name: Column, aliases: Column) -> Column:
    q, n = F.lower(F.trim(query)), F.lower(F.trim(name))
    low = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return (
        F.when(q == n, 1.0).when(n.startswith(q), 0.95).when(n.contains(q), 0.85).when(F.array_contains(low, q), 0.9)
        .when(F.exists(low, lambda x: x.contains(q)), 0.8)
    )


def node_radius(degree: Column, most: Column) -> Column:
    return F.lit(4.5) + F.lit(8.0) * F.sqrt(degree / F.greatest(most, F.lit(1)))


def or_not_set(c: Column) -> Column:
    """Variables of prompts: blank ones read "(not set)"."""
    return F.coalesce(present(c), F.lit("(not set)"))


def first_present(*columns: str) -> Column:
    """The first of several texts that has something in it, without outer blanks."""
    return F.coalesce(*[present(F.col(c)) for c in columns])


def author_list(names: Column) -> Column:
    """First of a list of names and all of them joined; NULL where there is none."""
    return F.struct(F.get(names, F.lit(0)).alias("first"), F.when(F.size(names) > 0, F.array_join(names, ", ")).alias("authors"))


def identifier(ids: Column, kind: str) -> Column:
    """The first identifier of a kind (idtype, value)."""
    return F.get(F.filter(ids, lambda x: x["idtype"] == kind), F.lit(0))["value"]


def feed_title(c: Column) -> Column:
    return present(clean_text(F.regexp_replace(F.trim(c), r"^\[[^\]]*\]\s*", "")))


def retry_seconds(attempt: Column, first: int = 2, most: int = 3) -> Column:
    """Seconds to wait before another attempt: doubled from one to the next, ``most`` times."""
    return (F.lit(first) * F.pow(F.lit(2), F.least(attempt, F.lit(most)))).cast("int")


def overlaid(base: Column, over: Column) -> Column:
    """A map with the values of another that aren't NULL in place of its own."""
    given = F.map_filter(over, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False))), given)


#: Sections of a model's answer whose fields are hoisted.
SECTIONS = ["metadata", "classification", "content_analysis", "content", "scoring"]


def hoisted(answer: Column, fields: list[str]) -> Column:
    """Fields of a JSON answer as a map, whether they stand at its top or in one of its sections; the top counts first."""
    at = lambda f: F.coalesce(F.get_json_object(answer, f"$.{f}"), *[F.get_json_object(answer, f"$.{s}.{f}") for s in SECTIONS])
    return F.create_map(*[x for f in fields for x in (F.lit(f), at(f))])


def first_way(ways: dict[str, Column]) -> Column:
    """The name of the first way that gave something, in their order, else ``none``."""
    out = F.when(F.lit(False), "")
    for name, c in ways.items():
        out = out.when(c.isNotNull(), name)
    return out.otherwise("none")


def or_default(terms: str, default: list[str]) -> Column:
    return F.when(F.size(terms) > 0, F.col(terms)).otherwise(F.array(*map(F.lit, default)))


def is_article_xml(c: Column) -> Column:
    return F.coalesce(c.contains("<article") | c.contains("<body"), F.lit(False))


def is_pdf(c: Column) -> Column:
    """Whether bytes or text begin as a PDF does and have ten bytes at least."""
    return F.coalesce(c.startswith("%PDF") & (F.octet_length(c) >= 10), F.lit(False))


def absolute_url(page: Column, link: Column) -> Column:
    """A link of a page made whole: given in full, without scheme, from the host's root or beside the page."""
    scheme, host = F.regexp_extract(page, r"^(https?:)", 1), F.regexp_extract(page, r"^(https?://[^/]+)", 1)
    beside = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(link.rlike(r"^https?://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(beside, link))


def first_string(json: Column, field: str) -> Column:
    """A JSON field's text, or the first one of its list, cleaned; NULL if nothing is left."""
    return present(clean_text(F.coalesce(F.get_json_object(json, f"$.{field}[0]"), F.get_json_object(json, f"$.{field}"))))


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Milliseconds before another attempt: what the service asked for in seconds, else 1, 2, 4 or 8 seconds."""
    return F.coalesce(retry_after.try_cast("int") * 1000, (F.lit(1000) * F.pow(F.lit(2), F.least(attempt, F.lit(3)))).cast("int"))


def feed_summary(c: Column) -> Column:
    """The abstract of a feed's description, else the whole of it, unless it has labels of other fields."""
    return F.coalesce(feed_field(c, "abstract"), F.when(~c.rlike("(?i)authors:|subjects:"), present(c)))
