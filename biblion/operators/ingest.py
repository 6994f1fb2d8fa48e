"""Candidate records: filters, merging, deduplication, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import candidate_date, duplicate_title, normalize_doi, present, search_form
from biblion.session import checkpoint

FIELDS = ["title", "summary", "first_author", "authors", "pub_date", "journal", "doi", "url"]
# The default research scope, three lists of which each must be met.
SCOPE = [
    "artificial intelligence|machine learning|large language models?|llm|clinical decision support|algorithmic|federated learning",
    "clinical|healthcare|health care|medical|medicine|patients?|hospital|biomedical|biomedicine|public health",
    "ethics|ethical|bias|fairness|privacy|governance|accountability|safety|oversight|human-in-the-loop|human in the loop",
]
#: Statuses of a run's candidates whose keys count as seen.
CLAIMING = ["deduped", "relevant", "irrelevant", "processing", "saved", "failed"]


def richness(prefix: str = "") -> Column:
    """0 to 5: DOI 1, summary 2, date 1, authors 1."""
    has = lambda c, n: F.when(present(F.col(prefix + c)).isNotNull(), n).otherwise(0)
    return has("doi", 1) + has("summary", 2) + has("pub_date", 1) + has("authors", 1)


def merge_candidates(records: DataFrame, seq: str = "seq", fields: list[str] | None = None) -> DataFrame:
    """One record per ``uid``: the richest one, its blanks filled from the others.

    The fold follows arrival (``seq``): a richer record becomes the base and the former
    base fills its blanks; else the new one fills the base's. It is exact for any number
    of records of a uid. Records of one uid are few; NULL uids are left out.
    """
    fields = fields or FIELDS
    row = F.struct(F.col(seq).alias("seq"), *[F.col(f).cast("string").alias(f) for f in fields])
    rich = lambda r: sum((F.when(present(r[f]).isNotNull(), n).otherwise(0) for f, n in (("doi", 1), ("summary", 2), ("pub_date", 1), ("authors", 1)) if f in fields), F.lit(0))

    def fold(acc: Column, new: Column) -> Column:
        swap = rich(new) > rich(acc)
        pick = lambda f: F.when(swap, F.coalesce(present(new[f]), present(acc[f]), new[f])).otherwise(F.coalesce(present(acc[f]), present(new[f]), acc[f]))
        return F.struct(acc["seq"].alias("seq"), *[pick(f).alias(f) for f in fields])

    ordered = records.where("uid is not null").groupBy("uid").agg(F.array_sort(F.collect_list(row)).alias("r"), F.count(F.lit(1)).alias("n_records"))
    folded = F.aggregate(F.slice(F.col("r"), 2, 1 << 30), F.get("r", F.lit(0)), fold)
    return ordered.select("uid", "n_records", folded.alias("m")).select("uid", "n_records", *[F.col(f"m.{f}").alias(f) for f in fields])


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"doi_key": present(normalize_doi(F.col("doi"))), "title_key": present(duplicate_title(F.col("title")))})


def known_duplicates(candidates: DataFrame, articles: DataFrame, key: str = "cand_uid") -> DataFrame:
    """Keys of candidates whose DOI or title is known; two equi-joins, not one with OR."""
    c, a = duplicate_keys(candidates), duplicate_keys(articles)
    by_doi = c.join(a.select("doi_key").where("doi_key is not null").distinct(), "doi_key", "left_semi").select(key)
    by_title = c.join(a.select("title_key").where("title_key is not null").distinct(), "title_key", "left_semi").select(key)
    return by_doi.union(by_title).distinct()


def duplicate_target(candidates: DataFrame, articles: DataFrame, key: str = "cand_uid") -> DataFrame:
    """The article a candidate repeats: by DOI first, else by title, the least uid of several."""
    c, a = duplicate_keys(candidates).select(key, "doi_key", "title_key").distinct(), duplicate_keys(articles)
    by_doi = a.where("doi_key is not null").groupBy("doi_key").agg(F.min("uid").alias("doi_uid"))
    by_title = a.where("title_key is not null").groupBy("title_key").agg(F.min("uid").alias("title_uid"))
    both = c.join(by_doi, "doi_key", "left").join(by_title, "title_key", "left")
    return both.select(key, F.coalesce("doi_uid", "title_uid").alias("uid")).where("uid is not null")


def first_of_run(candidates: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Greedy dedup of each run in arrival order: a candidate is kept unless a *kept* earlier one shares its DOI or title.

    In rounds: of the undecided the first of all its keys is kept, what shares a key
    with a kept one is skipped. No task holds a run; a key's first is found by an
    aggregation that is summed before it is shuffled. Each round decides the first
    undecided of every run at least; in practice few rounds are needed.
    """
    keyed = duplicate_keys(candidates).select(F.col(run).cast("string").alias("run_id"), F.col(seq).cast("long").alias("seq"), "uid", "doi_key", "title_key")
    open_ = checkpoint(keyed)
    done: DataFrame | None = None
    while not open_.isEmpty():
        for key in ("doi_key", "title_key"):
            first = open_.where(F.col(key).isNotNull()).groupBy("run_id", key).agg(F.min("seq").alias(f"{key}_first"))
            open_ = open_.join(first, ["run_id", key], "left")
        ahead = lambda key: F.coalesce(F.col(f"{key}_first") < F.col("seq"), F.lit(False))
        open_ = checkpoint(open_.withColumn("kept", ~ahead("doi_key") & ~ahead("title_key")).drop("doi_key_first", "title_key_first"))
        kept = open_.where("kept")
        rest = open_.where("not kept").drop("kept")
        for key in ("doi_key", "title_key"):
            taken = kept.where(F.col(key).isNotNull()).select("run_id", key).distinct().withColumn(f"{key}_taken", F.lit(True))
            rest = rest.join(taken, ["run_id", key], "left")
        rest = checkpoint(rest.withColumn("gone", F.coalesce("doi_key_taken", F.lit(False)) | F.coalesce("title_key_taken", F.lit(False))).drop("doi_key_taken", "title_key_taken"))
        settled = kept.select("run_id", "seq", "uid", F.lit("deduped").alias("status")).unionByName(rest.where("gone").select("run_id", "seq", "uid", F.lit("skipped_cross_source").alias("status")))
        done = settled if done is None else done.unionByName(settled)
        open_ = rest.where("not gone").drop("gone")
    return done if done is not None else keyed.select("run_id", "seq", "uid", F.lit("deduped").alias("status"))


def matches_words(text: Column, words: Column, domains: Column) -> Column:
    """Whether a text has two of the words (or its one) and, where domain words are given, one of these; no words ask nothing."""
    n = F.size(F.filter(words, lambda w: text.contains(w)))
    return (F.size(words) == 0) | ((n >= F.least(F.lit(2), F.size(words))) & ((F.size(domains) == 0) | F.exists(domains, lambda w: text.contains(w))))


def screened_relevant(answer: Column) -> Column:
    """What a screening answer decides: relevant unless its decision, or a text without any, begins with no."""
    decision = F.get_json_object(F.when(F.try_parse_json(answer).isNotNull(), answer), "$.relevant")
    said = F.lower(F.trim(F.coalesce(decision, F.when(F.try_parse_json(answer).isNull(), answer), F.lit(""))))
    return ~said.rlike(r"^no\b")


def candidate_text(title: str = "title", summary: str = "summary", journal: str = "journal") -> Column:
    return search_form(F.concat_ws(" ", F.col(title), F.col(summary), F.col(journal)))


def matches_groups(text: Column, title: Column, groups: Column) -> Column:
    """Whether a group of query words fits: two of its words (or its one) in the text, an anchor in the title, domain and technology met."""
    has = lambda words, where: (F.size(words) == 0) | F.exists(words, lambda w: where.contains(w))
    enough = lambda g: F.size(F.filter(g["tokens"], lambda w: text.contains(w))) >= F.least(F.lit(2), F.size(g["tokens"]))
    return (F.size(groups) == 0) | F.exists(groups, lambda g: enough(g) & has(g["anchors"], title) & has(g["domains"], text) & has(g["tech"], text))


def in_scope(title: Column, summary: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, summary))
    out = F.lit(True)
    for words in SCOPE:
        out = out & text.rlike(words)
    return out


def in_window(pub_date: Column, start: Column, end: Column) -> Column:
    d = candidate_date(pub_date)
    return d.isNull() | d.between(start, end)


def listing_windows(start: Column, end: Column, days: int = 30) -> Column:
    """Windows of at most ``days`` days that cover start..end, the latest first."""
    ends = F.sequence(end, start, F.expr(f"interval -{days} days"))
    return F.transform(ends, lambda e: F.struct(F.greatest(F.date_sub(e, days - 1), start).alias("start"), e.alias("end")))


def query_terms(terms: Column, most: int = 8) -> Column:
    """Terms without repeats (whatever the case), the first of each, at most ``most``."""
    low = F.transform(terms, lambda t: F.lower(F.trim(t)))
    firsts = F.filter(terms, lambda t, i: (F.trim(t) != "") & (F.array_position(low, F.lower(F.trim(t))) == i + 1))
    return F.slice(F.transform(firsts, lambda t: F.trim(t)), 1, most)


def quoted_or(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"')), F.lit('"'))), " OR ")


def upsert_articles(articles: DataFrame, incoming: DataFrame, text_fields: list[str]) -> DataFrame:
    """Articles with incoming records applied: new values where given, else the old ones.

    ``incoming`` (uid, fields, full_text, content_type, evaluated) has one record a uid.
    Full text and its type follow precedence: fetched text replaces, an abstract only
    fills a blank. Existing rows change only if the record is evaluated or has text;
    unknown uids are inserted.
    """
    new = incoming.select("uid", *[F.col(f).alias(f"n_{f}") for f in [*text_fields, "full_text", "content_type", "evaluated"]])
    is_new = ~F.coalesce(F.col("known"), F.lit(False))
    both = articles.withColumn("known", F.lit(True)).join(new, "uid", "full_outer")
    touch = is_new | F.coalesce("n_evaluated", F.lit(False)) | present(F.col("n_full_text")).isNotNull()
    fetched = F.coalesce(F.col("n_content_type") != "abstract_only", F.lit(False)) & present(F.col("n_full_text")).isNotNull()
    take = fetched | (present(F.col("full_text")).isNull() & present(F.col("n_full_text")).isNotNull())
    cols = [F.when(touch, F.coalesce(present(F.col(f"n_{f}")), F.col(f))).otherwise(F.col(f)).alias(f) for f in text_fields]
    return both.select(
        "uid", *cols,
        F.when(touch & take, F.col("n_full_text")).otherwise(F.col("full_text")).alias("full_text"),
        F.when(touch & take, F.col("n_content_type")).otherwise(F.col("content_type")).alias("content_type"),
        F.when(is_new, "inserted").when(F.col("n_evaluated").isNull() & F.col("n_full_text").isNull(), "kept").when(touch, "updated").otherwise("skipped").alias("change"),
    )


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` replaced (chunks of an article)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys are not there yet, once each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def delete_cascade(articles: DataFrame, dependents: dict[str, DataFrame], gone: DataFrame, key: str = "uid", foreign: str = "article_uid") -> dict[str, DataFrame]:
    out = {"articles": articles.join(gone.select(key), key, "left_anti")}
    for name, df in dependents.items():
        out[name] = df.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")
    return out


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("v")).select(*keys, "v.*")


def next_versions(history: DataFrame, edits: DataFrame, key: str = "prompt_name") -> DataFrame:
    """Edits numbered on from the greatest version there is."""
    top = history.groupBy(key).agg(F.max("version").alias("top"))
    w = Window.partitionBy(key).orderBy("seq")
    return edits.join(top, key, "left").withColumn("version", F.coalesce("top", F.lit(0)) + F.row_number().over(w)).drop("top")


def date_window(as_of: Column, days: Column) -> Column:
    """The days up to ``as_of``, one at least."""
    return F.struct(F.date_sub(as_of, F.greatest(days, F.lit(1)).cast("int")).alias("start"), as_of.alias("end"))


def equal_to(df: DataFrame, asked: dict[str, object]) -> DataFrame:
    """Rows that equal all values asked; None asks nothing."""
    for name, value in asked.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def profile_filter(candidates: DataFrame, terms: list[str]) -> DataFrame:
    """The default scope, unless the workspace has terms of its own."""
    return candidates if terms else candidates.where(in_scope(F.col("title"), F.col("summary")))
