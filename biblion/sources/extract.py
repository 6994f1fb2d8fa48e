"""Text of HTML pages, JATS XML and positioned page fragments."""

from __future__ import annotations

import html.parser
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "head"}
_BLOCK = {"p", "div", "li", "tr", "br", "section", "article", "table", "ul", "ol", "h4", "h5", "h6", "blockquote", "pre"}


class _Page(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[tuple[str, list[str]]] = [("", [])]
        self.hidden, self.heading, self.title = 0, False, []
        self.pdf_url: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            meta = dict(attrs)
            if (meta.get("name") or "").lower() == "citation_pdf_url" and not self.pdf_url:
                self.pdf_url = meta.get("content")
        elif tag in _SKIP:
            self.hidden += 1
        elif tag in ("h1", "h2", "h3") and not self.hidden:
            self.heading, self.title = True, []
        elif tag in _BLOCK:
            self.sections[-1][1].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("h1", "h2", "h3") and self.heading:
            self.heading = False
            self.sections.append((" ".join("".join(self.title).split()), []))
        elif tag in _BLOCK:
            self.sections[-1][1].append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.title if self.heading else self.sections[-1][1]).append(data)


def _tidy(text: str) -> str:
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_sections(text: str) -> tuple[list[tuple[str, str]], str | None]:
    """Sections (title, text) under h1 to h3 with all text below them, and the PDF address a page cites.

    Scripts, styles, navigation, headers, footers and asides are left out.
    """
    page = _Page()
    page.feed(text)
    page.close()
    parts = [(t, _tidy("".join(x))) for t, x in page.sections]
    return [(t, x) for t, x in parts if x], page.pdf_url


def xml_sections(text: str) -> list[tuple[str, str]]:
    """JATS: the abstract and the body's top sections; titles of nested ones stay in their text. Else all text."""
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text))
    except ET.ParseError:
        plain = _tidy(re.sub(r"<[^>]*(>|$)", " ", text))
        return [("", plain)] if plain else []
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else e.tag
    flat = lambda e: _tidy("\n".join(" ".join("".join(p.itertext()).split()) for p in (e.iter("p") if e.find(".//p") is not None else [e])))
    out = [("Abstract", flat(e)) for e in root.iter("abstract")][:1]
    for sec in root.findall(".//body/sec"):
        title = sec.find("title")
        name = " ".join("".join(title.itertext()).split()) if title is not None else ""
        if title is not None:
            sec.remove(title)
        out.append((name, _tidy(" ".join(" ".join(sec.itertext()).split()))))
    out = [(t, x) for t, x in out if x]
    whole = _tidy(" ".join(root.itertext()))
    return out or ([("", whole)] if whole else [])


def extract_sections(df: DataFrame, key: str, content: str, content_type: str) -> DataFrame:
    """``key``, ``full_text``, ``sections`` and ``pdf_url`` of fetched content by its type (html, xml, else plain text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pdf = None
                if text is None:
                    parts = []
                elif kind == "html":
                    parts, pdf = html_sections(text)
                elif kind == "xml":
                    parts = xml_sections(text)
                else:
                    plain = _tidy(text)
                    parts = [("", plain)] if plain else []
                full = "\n\n".join(f"{t}\n{x}" if t else x for t, x in parts)
                rows.append((k, full, [{"title": t, "content": x} for t, x in parts], pdf))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            section = pa.list_(pa.struct([("title", pa.string()), ("content", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], section), pa.array(cols[3], pa.string())], names=["key", "full_text", "sections", "pdf_url"])

    slim = df.selectExpr(f"cast(`{key}` as string) as key", f"`{content}` as content", f"lower(`{content_type}`) as kind")
    return slim.mapInArrow(run, "key string, full_text string, sections array<struct<title:string,content:string>>, pdf_url string")


def order_fragments(pages: DataFrame) -> DataFrame:
    """Reading order of positioned fragments (page, x, x_end, y, page_width, font_size, text): ``page``, ``text``.

    A line's fragments share a baseline. Lines wider than 0.6 of the page span both
    columns; between them the left column is read before the right one. ``y`` grows
    upwards. A page is bounded and ordered in one task.
    """

    def order(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["y", "x"], ascending=[False, True])
        lines: list[dict] = []
        for r in pdf.itertuples():
            side = 0 if (r.x + r.x_end) / 2 < r.page_width / 2 else 1
            last = next((x for x in lines if abs(x["y"] - r.y) <= 0.5 * r.font_size and (r.x - x["end"] < 2 * r.font_size)), None)
            if last and r.x >= last["end"] - 0.5 * r.font_size:
                last["text"] += (" " if r.x - last["end"] > 0.1 * r.font_size else "") + r.text
                last["end"] = r.x_end
            else:
                lines.append({"y": r.y, "x": r.x, "end": r.x_end, "side": side, "text": r.text, "width": r.page_width})
        out, block = [], []
        for x in lines:
            wide = (x["end"] - x["x"]) > 0.6 * x["width"]
            if wide:
                out += sorted(block, key=lambda z: (z["side"], -z["y"]))
                block = []
                out.append(x)
            else:
                block.append(x)
        out += sorted(block, key=lambda z: (z["side"], -z["y"]))
        text = re.sub(r"(?<=.)-\n(?=[a-zà-ÿ])", "", "\n".join(x["text"] for x in out))
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "text": [text]})

    return pages.groupBy("page").applyInPandas(order, "page long, text string")


def glyph_fragments(glyphs: DataFrame, by: str) -> DataFrame:
    """Fragments (``by``, ``no``, ``x``, ``x_end``, ``y``, ``text``) of glyphs (x, width, y, size, ch) in their order.

    A glyph goes on with the fragment before it if it stands on its line (half its size
    up or down) and near it (from half a size before its end to two sizes after); a gap
    of more than a tenth of the size is a blank.
    """
    w = Window.partitionBy(by).orderBy(F.desc("y"), "x")
    end, line = F.lag(F.col("x") + F.col("width")).over(w), F.lag("y").over(w)
    gap = F.col("x") - F.col("__end")
    near = (F.abs(F.col("y") - F.col("__line")) <= 0.5 * F.col("size")) & gap.between(-0.5 * F.col("size"), 2 * F.col("size"))
    marked = glyphs.withColumn("__end", end).withColumn("__line", line).withColumn("__near", F.coalesce(near, F.lit(False)))
    numbered = marked.withColumn("no", F.sum((~F.col("__near")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.concat(F.when(F.col("__near") & (gap > 0.1 * F.col("size")), " ").otherwise(""), F.col("ch"))
    rows = F.array_sort(F.collect_list(F.struct("x", piece.alias("p"))))  # the glyphs of one fragment
    return numbered.groupBy(by, "no").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("x_end"), F.first("y").alias("y"), F.array_join(F.transform(rows, lambda r: r["p"]), "").alias("text"))
