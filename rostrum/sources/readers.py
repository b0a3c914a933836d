"""Tables from CSV, parquet, SQL and HTML; schemas are stated, never inferred."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "speeches": "date string, speech_title string, president string, text string, paragraph int",
    "speeches_by_paragraph": "date string, speech_title string, president string, text string, paragraph int, full_document int",
    "words": "word string, pos string, lemma string, year int, president string",
    "words_lemmaless": "word string, pos string, year int, president string",
    "topic_labels": "president_num int, president string, topics_list array<array<string>>",
    "topic_labels_wide": "president_num int, president string, " + ", ".join(f"topic_{i} string" for i in range(1, 16)),
    "stop_words": "president_num int, president string, stop_words array<string>",
    "pages": "page_id bigint, url string, html string",
}


def read_csv(spark: SparkSession, path: str | list[str], schema: str, index: bool = False, lines: bool = False, null: str = "") -> DataFrame:
    """CSV with a header and quoted multi-line text; undecodable bytes vanish. ``index``: an unnamed first column.

    ``lines``: no field holds a line break, so that large files are split among tasks. ``null`` is how null is written; with
    the default, an empty field, an empty string is null too.
    """
    full = f"_index string, {schema}" if index else schema
    rows = spark.read.schema(full).csv(path, header=True, multiLine=not lines, escape='"', encoding="UTF-8", enforceSchema=True, nullValue=null)
    rows = rows.drop("_index")
    return rows.select(*[F.translate(c, "�", "").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def read_batches(spark: SparkSession, pattern: str, schema: str, index: bool = True, null: str = "") -> DataFrame:
    """All batch files of a glob, each once, as one scan; ``batch_file`` tells the file, or the folder ``batch_file=...`` it is in."""
    full = f"_index string, {schema}" if index else schema
    # The folder's name is an escaped value, and the path holds it escaped once more.
    folder = F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "batch_file=([^/]+)/", 1)))
    name = F.when(folder != "", folder).otherwise(F.col("_metadata.file_name"))
    rows = spark.read.schema(full).csv(pattern, header=True, multiLine=True, escape='"', nullValue=null).select("*", name.alias("batch_file"))
    return rows.drop("_index")


def read_sql(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A query run by a database; projections, filters and sorts in it stay there."""
    return spark.read.jdbc(url, f"({query}) AS q", properties=properties or {})


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small hand-made table."""
    return spark.createDataFrame(rows, schema)


class _Page(HTMLParser):
    """Texts of paragraphs by containing class, links, and single texts by tag and class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.skip = 0
        self.paragraphs: list[tuple[tuple[str, ...], str]] = []
        self.singles: list[tuple[str, str, str]] = []
        self.links: list[tuple[str, str]] = []
        self.open: list[list] = []
        self.href: str | None = None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.close()
        if tag in ("p", "a", "h1", "span", "div"):
            if tag == "a":
                self.href = values.get("href")
            if tag != "div":
                self.open.append([tag, values.get("class") or "", []])
        if tag not in ("br", "img", "meta", "link", "hr", "input"):
            self.stack.append((tag, values.get("class") or ""))

    def handle_data(self, data):
        if not self.skip:
            for o in self.open:
                o[2].append(data)

    def close(self):
        tag, css, parts = self.open.pop()
        text = "".join(parts)
        if tag == "p":
            self.paragraphs.append((tuple(c for _, c in self.stack if c), text))
        if tag == "a":
            self.links.append((text, self.href or ""))
        self.singles.append((tag, css, text))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self.close()
            self.close()
        if any(t == tag for t, _ in self.stack):
            if tag not in ("p", "a", "span", "b", "i", "em", "strong"):  # the end of a container ends its open paragraphs
                while self.open:
                    self.close()
            while self.stack.pop()[0] != tag:
                pass


def html_paragraphs(pages: DataFrame, containers: tuple[str, ...] = ("expandable-text-container", "view-transcript"), name_class: str = "president-name") -> DataFrame:
    """``page_id, president, paragraph, text, full_document`` of scraped pages.

    The paragraphs of the first container that has any count, from 0; ``full_document`` is 1 for a single paragraph,
    else 0. A page without such paragraphs gives one row of null paragraph and text with 2. Null pages likewise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"]):
                parser = _Page()
                parser.feed(html or "")
                while parser.open:
                    parser.close()
                name = next((t.strip() for tag, css, t in parser.singles if tag == "p" and name_class in css.split()), None)
                found = next((got for c in containers if (got := [t for css, t in parser.paragraphs if any(c in x.split() for x in css)])), [])
                rows += [(page, name, i, t, int(len(found) == 1)) for i, t in enumerate(found)] or [(page, name, None, None, 2)]
            yield pd.DataFrame(rows, columns=["page_id", "president", "paragraph", "text", "full_document"]).astype({"paragraph": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, president string, paragraph int, text string, full_document int")


def html_links(pages: DataFrame) -> DataFrame:
    """``page_id, date, title, url`` of links whose text is ``date: title``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"]):
                parser = _Page()
                parser.feed(html or "")
                rows += [(page, *t.split(": ", 1), href) for t, href in parser.links if ": " in t]
            yield pd.DataFrame(rows, columns=["page_id", "date", "title", "url"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, date string, title string, url string")
