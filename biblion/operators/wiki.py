"""Wiki pages and prompts: rows to Markdown, links between pages, templates, prompt versions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblion.functions.text import markdown_label, present, wiki_slug


def entity_filename(id_: Column, name: Column) -> Column:
    slug = present(wiki_slug(name))
    return F.when(slug.isNull(), F.concat(F.lit("entity-"), id_.cast("string"), F.lit(".md"))).otherwise(F.concat(id_.cast("string"), F.lit("-"), slug, F.lit(".md")))


def source_filename(uid: Column) -> Column:
    slug = present(wiki_slug(uid))
    return F.when(slug.isNull(), F.concat(F.lit("source-"), F.url_encode(uid), F.lit(".md"))).otherwise(F.concat(slug, F.lit(".md")))


def _line(label: str, value: Column) -> Column:
    """A line that is left out where there is nothing to say."""
    return F.concat(F.lit(f"- {label}: "), present(value))


def entity_pages(entities: DataFrame) -> DataFrame:
    """``path`` and ``body`` of entities (id, canonical_name, entity_type, description, aliases, summary, synthesis)."""
    parts = [
        F.concat(F.lit("# "), markdown_label(F.col("canonical_name"))), _line("Type", F.col("entity_type")),
        _line("Also known as", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), ", ")),
        present(F.col("summary")), F.concat(F.lit("## Description\n\n"), present(F.col("description"))), F.concat(F.lit("## Synthesis\n\n"), present(F.col("synthesis"))),
    ]
    return entities.where("canonical_name is not null").select(
        F.concat(F.lit("entities/"), entity_filename(F.col("id"), F.col("canonical_name"))).alias("path"), F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("body")
    )


def source_pages(articles: DataFrame) -> DataFrame:
    """``path`` and ``body`` of articles (uid, title, authors, journal, pub_date, doi, url, byline_summary)."""
    facts = F.nullif(F.concat_ws("\n", _line("Authors", F.col("authors")), _line("Journal", F.col("journal")), _line("Published", F.col("pub_date")), _line("DOI", F.col("doi")), _line("Link", F.col("url"))), F.lit(""))
    title = F.coalesce(present(F.col("title")), F.col("uid"))
    return articles.where("uid is not null").select(
        F.concat(F.lit("sources/"), source_filename(F.col("uid"))).alias("path"),
        F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), markdown_label(title)), facts, present(F.col("byline_summary"))), F.lit("\n")).alias("body"),
    )


def daily_pages(articles: DataFrame, most: int = 200) -> DataFrame:
    """``path`` and ``body`` of a page for each day of registration: its articles by title, ``most`` at most."""
    order = Window.partitionBy("reg_date").orderBy(F.asc_nulls_last("title"), "uid")
    top = articles.where("reg_date is not null").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most)
    line = F.concat(F.lit("- ["), markdown_label(F.coalesce(present(F.col("title")), F.col("uid"))), F.lit("](../sources/"), source_filename(F.col("uid")), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("__r", line.alias("line"))))  # at most ``most``
    body = F.concat(F.lit("# "), F.col("reg_date"), F.lit("\n\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n"))
    return top.groupBy("reg_date").agg(body.alias("body")).select(F.concat(F.lit("daily/"), "reg_date", F.lit(".md")).alias("path"), "body")


def index_page(pages: DataFrame, title: str = "Index", most: int = 500) -> DataFrame:
    """One page that lists at most ``most`` entities (id, canonical_name, n_sources, stale), by sources and name."""
    top = pages.orderBy(F.desc("n_sources"), "canonical_name", "id").limit(most)
    mark = F.when(F.coalesce("stale", F.lit(False)), " (stale)").otherwise("")
    line = F.concat(F.lit("- ["), markdown_label(F.col("canonical_name")), F.lit("](entities/"), entity_filename(F.col("id"), F.col("canonical_name")), F.lit(") - "), F.col("n_sources").cast("string"), F.lit(" sources"), mark)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n_sources")).alias("n"), F.col("canonical_name"), F.col("id"), line.alias("line"))))
    return top.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).alias("body")).select(F.lit("index.md").alias("path"), "body")


_CODE = re.compile(r"```.*?```|`[^`]*`|!?\[[^\]]*\]\([^)]*\)|\[\[[^\]]*\]\]", re.S)


def link_text(text: str, targets: dict[str, str]) -> str:
    """``[[Target|Label]]`` to links where the target is known; the first mention of each known name linked once.

    Names shorter than three characters, code and existing links are left alone; of two
    names at one place the longer wins.
    """
    known = {k.lower(): (k, v) for k, v in targets.items()}

    def wiki(m: re.Match) -> str:
        name, _, label = m[1].partition("|")
        hit = known.get(name.strip().lower())
        return f"[{(label or name).strip()}]({hit[1]})" if hit else m[0]

    text = re.sub(r"\[\[([^\]\n]+)\]\]", wiki, text)
    names = sorted((k for k in targets if len(k) >= 3 and k.isascii()), key=lambda k: (-len(k), k))
    if not names:
        return text
    pattern = re.compile(r"(?<![\w-])(" + "|".join(map(re.escape, names)) + r")(?![\w-])", re.I)
    done: set[str] = set()

    def put(m: re.Match) -> str:
        key = m[1].lower()
        if key in done:
            return m[1]
        done.add(key)
        return f"[{m[1]}]({known[key][1]})"

    out, at = [], 0
    for m in _CODE.finditer(text):
        out += [pattern.sub(put, text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, pattern.sub(put, text[at:])])


def link_pages(pages: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Bodies with links; ``targets`` is the bounded index of entities (name -> file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [None if b is None else link_text(b, targets) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["path", "body"])

    return pages.select("path", "body").mapInArrow(run, "path string, body string")


class TemplateError(ValueError):
    pass


def render_template(template: str, values: dict[str, str]) -> str:
    """``{name}`` replaced, ``{{`` and ``}}`` as braces; missing names and unmatched braces are errors."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if template[i : i + 2] in ("{{", "}}"):
            out.append(c)
            i += 2
        elif c == "{":
            end = template.find("}", i)
            if end < 0:
                raise TemplateError(f"unclosed brace at {i}")
            name = template[i + 1 : end].strip()
            if name not in values:
                raise TemplateError(f"no value for {name!r}")
            out.append(values[name])
            i = end + 1
        elif c == "}":
            raise TemplateError(f"unmatched brace at {i}")
        else:
            out.append(c)
            i += 1
    return "".join(out)


def render_rows(rows: DataFrame, template: str, key: str, names: list[str]) -> DataFrame:
    """``key``, ``prompt`` of each row; blank values read "(not set)"."""
    cols = [F.coalesce(present(F.col(n).cast("string")), F.lit("(not set)")).alias(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [c.to_pylist() for c in batch.columns]
            done = [render_template(template, dict(zip(names, vals, strict=True))) for vals in zip(*data[1:], strict=True)] if names else [render_template(template, {}) for _ in data[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["key", "prompt"])

    return rows.select(F.col(key).cast("string").alias("key"), *cols).mapInArrow(run, "key string, prompt string")


def read_prompts(spark, path: str) -> DataFrame:
    """Prompt files of a folder: ``name`` (file without ending) and ``content``."""
    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    return files.select(F.regexp_extract("file", r"([^/]+?)\.[A-Za-z]+$", 1).alias("name"), "content")


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as a table partitioned by their folder; a single-file export reads it page by page."""
    pages.withColumn("folder", F.coalesce(present(F.regexp_extract("path", r"^(.*)/", 1)), F.lit("root"))).write.mode("overwrite").partitionBy("folder").parquet(folder)


_INLINE = [
    (re.compile(r"`([^`]+)`"), r"<code>\1</code>"), (re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<!\*)\*([^*\n]+)\*(?!\*)"), r"<em>\1</em>"),
    (re.compile(r"\[([^\]]+)\]\(((?:https?://|/|#|[\w./-]+\.md)[^)\s]*)\)"), r'<a href="\2">\1</a>'),
]


def markdown_html(text: str) -> str:
    """Markdown as HTML with everything else escaped: headings, lists, quotes, fences, paragraphs, and inline code, strong, emphasis and links."""

    def inline(x: str) -> str:
        for pattern, put in _INLINE:
            x = pattern.sub(put, x)
        return x

    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    out: list[str] = []
    block: list[str] = []
    kind, fence = "", False

    def close() -> None:
        nonlocal kind
        if block:
            if kind in ("ul", "ol"):
                out.append(f"<{kind}>" + "".join(f"<li>{x}</li>" for x in block) + f"</{kind}>")
            elif kind == "quote":
                out.append("<blockquote>" + " ".join(block) + "</blockquote>")
            else:
                out.append("<p>" + " ".join(block) + "</p>")
        block.clear()
        kind = ""

    def put(new: str, line: str) -> None:
        nonlocal kind
        if kind != new:
            close()
            kind = new
        block.append(line)

    for line in text.split("\n"):
        if line.startswith("```"):
            if fence:
                out.append("<pre><code>" + "\n".join(block) + "</code></pre>")
                block.clear()
            else:
                close()
            fence = not fence
        elif fence:
            block.append(escape(line))
        elif not line.strip():
            close()
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{inline(escape(m[2].strip()))}</h{len(m[1])}>")
        elif m := re.match(r"\s*[-*]\s+(.*)", line):
            put("ul", inline(escape(m[1])))
        elif m := re.match(r"\s*\d+\.\s+(.*)", line):
            put("ol", inline(escape(m[1])))
        elif m := re.match(r">\s?(.*)", line):
            put("quote", inline(escape(m[1])))
        else:
            put("p", inline(escape(line.strip())))
    if fence:
        out.append("<pre><code>" + "\n".join(block) + "</code></pre>")
    else:
        close()
    return "\n".join(out)


def to_html(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``html`` of Markdown texts; NULL stays NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if x is None else markdown_html(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=[key, "html"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, text).mapInArrow(run, f"`{key}` {kind}, html string")
