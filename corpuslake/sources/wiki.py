"""Wiki dumps: pages from XML, article text from wikitext, counts of what is passed over.

The stripper of wikitext is our own: it removes comments, templates, tables, the tags and links listed below, and
keeps the shown text of links, headings and formatting.  Nested templates go from the inside out.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import wiki_url
from ..functions.unicode import _mapped, _where

#: Tags and links whose content goes, and projects by the prefix of their dumps.
SKIP_TAGS = ("ref", "references", "gallery", "timeline", "score", "math", "chem")
SKIP_LINKS = ("category:", "file:", "image:", "media:", "wikipedia:", "портал:")
PROJECTS = {
    "ruwiki": ("ruwiki_cc_by_sa", "ru", "https://ru.wikipedia.org/wiki/"),
    "simplewiki": ("simplewiki_cc_by_sa", "en", "https://simple.wikipedia.org/wiki/"),
    "enwikibooks": ("enwikibooks_cc_by_sa", "en", "https://en.wikibooks.org/wiki/"),
}
PAGE = "title string, ns string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
SHORTEST = 300

_TAGS = "|".join(SKIP_TAGS)
_REMOVED = [re.compile(p, re.I | re.S) for p in (r"<!--.*?-->", rf"<(?:{_TAGS})\b[^>]*/>", rf"<({_TAGS})\b[^>]*>.*?</\1\s*>")]
_INNER_TEMPLATE, _TABLE = re.compile(r"\{\{[^{}]*\}\}"), re.compile(r"\{\|(?:(?!\{\|).)*?\|\}", re.S)
_LINK, _EXTERNAL = re.compile(r"\[\[([^\[\]]*)\]\]"), re.compile(r"\[(?:https?|ftp)://\S*\s*([^\]]*)\]")
_MARKS = (
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"(?m)^=+\s*(.*?)\s*=+\s*$"), r"\1"),
    (re.compile(r"(?m)^[*#:;]+\s*"), ""),
    (re.compile(r"__[A-ZА-Я]+__"), ""),
    (re.compile(r"</?[a-zA-Z][^>]*>"), ""),
)
#: Reference marks on lines of their own, runs of blanks, blanks at line ends, runs of blank lines.
_TIDY = ((re.compile(r"(?m)^\s*(?:\[\d+\]|↑\s*\d+)\s*$"), ""), (re.compile(r"[ \t]{2,}"), " "), (re.compile(r" *\n *"), "\n"), (re.compile(r"\n{3,}"), "\n\n"))


def _shown(found: re.Match) -> str:
    target, *label = found[1].split("|")
    if target.strip().lower().startswith(SKIP_LINKS):
        return ""
    return label[-1] if label else target.lstrip(":")


def plain_text(wikitext: str) -> str:
    """Article text of wikitext."""
    for p in _REMOVED:
        wikitext = p.sub("", wikitext)
    for p, by in ((_INNER_TEMPLATE, ""), (_TABLE, ""), (_LINK, _shown)):
        while (less := p.sub(by, wikitext)) != wikitext:
            wikitext = less
    wikitext = _EXTERNAL.sub(r"\1", wikitext)
    for p, by in _MARKS:
        wikitext = p.sub(by, wikitext)
    wikitext = html.unescape(wikitext)
    for p, by in _TIDY:
        wikitext = p.sub(by, wikitext)
    return wikitext.strip()


_plain = _mapped(plain_text)


def text_of(wikitext: Column) -> Column:
    """Article text of a wikitext column (null: empty)."""
    given = F.coalesce(wikitext, F.lit(""))
    return _where(given != "", _plain, F.lit(""), given)


def project_of(name: Column) -> Column:
    """Project of a dump by the part of its file name before the first dash; null if it isn't known."""
    prefix = F.split_part(F.substring_index(name, "/", -1), F.lit("-"), F.lit(1))
    return F.when(prefix.isin(*PROJECTS), prefix)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, is_redirect and wikitext of the pages of a dump; compressed dumps are read as they are."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return raw.select(F.trim("title").alias("title"), F.trim("ns").alias("ns"), F.col("redirect").isNotNull().alias("is_redirect"), F.col("revision.text._VALUE").alias("wikitext"))


def classify(pages: DataFrame) -> DataFrame:
    """Adds `text` and `verdict`: namespace, redirect, short or kept.  Only articles are stripped."""
    article = (F.coalesce(F.col("ns"), F.lit("")) == "0") & ~F.col("is_redirect")
    text = text_of(F.when(article, F.col("wikitext")))
    verdict = F.when(F.coalesce(F.col("ns"), F.lit("")) != "0", "namespace").when(F.col("is_redirect"), "redirect").when(F.length("text") < SHORTEST, "short").otherwise("kept")
    return pages.withColumn("text", text).withColumn("verdict", verdict)


def articles(pages: DataFrame, project: str) -> DataFrame:
    """The rows that an extraction writes: title and text as one text, address, language and source."""
    source, language, base = PROJECTS[project]
    title = F.col("title")
    return classify(pages).where("verdict = 'kept'").select(F.concat_ws("\n", title, "text").alias("text"), title, wiki_url(base, title).alias("source_url"), F.lit(language).alias("language_hint"), F.lit(source).alias("source_id"))


def counts(pages: DataFrame) -> DataFrame:
    """How many pages there are of each verdict, and characters of text."""
    return classify(pages).groupBy("verdict").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"))
