"""Readable text and metadata of web pages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import fit, or_else, strip, unescape
from loomgraph.functions.urls import host_of, is_public_ip, scheme_of

# --- fixed values: HTML elements ---------------------------------------------------
HIDDEN = r"(?is)<(script|style|noscript|template|svg|head|nav|footer|aside|form|iframe)\b[^>]*>.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
BREAK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|main|blockquote|pre|figure|hr|body)\b[^>]*>"
TAG = r"(?s)<[^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# --- end of fixed values ----------------------------------------------------------


def readable(html: Column) -> Column:
    """Visible text, one line per block; '' when the page shows none."""
    visible = F.regexp_replace(F.regexp_replace(html, COMMENT, ""), HIDDEN, "")
    plain = unescape(F.regexp_replace(F.regexp_replace(visible, BREAK, "\n"), TAG, ""))
    tidy = F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\S\n]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(tidy, r"^[ \n]+|[ \n]+$", "")


def _meta(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, rf'(?is)<meta\b[^>]*\b(?:name|property)=["\'](?:{name})["\'][^>]*>', 0)
    return F.regexp_extract(tag, r'(?is)\bcontent=["\']([^"\']*)["\']', 1)


def page_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Pages (``url, html``) with ``page_title, page_author, page_date, page_text, truncated``; an unreadable page has a
    null text."""
    html = F.col("html")
    text, truncated = fit(F.col("_text"), max_chars)
    return (
        pages.withColumn("_text", or_else(readable(html)))
        .withColumns(
            {
                "page_title": or_else(strip(unescape(F.regexp_extract(html, TITLE, 1)))),
                "page_author": or_else(unescape(_meta(html, "author|article:author"))),
                "page_date": or_else(_meta(html, "date|article:published_time|pubdate")),
                "page_text": text,
                "truncated": truncated,
            }
        )
        .drop("_text")
    )


def url_safety(urls: DataFrame, resolved: DataFrame, unresolved: str = "transient") -> DataFrame:
    """URLs with ``safety``: public, blocked, or ``unresolved`` for a host without address.

    ``resolved`` has ``host, ip``; one private address blocks the host."""
    hosts = resolved.groupBy("host").agg(F.bool_and(is_public_ip(F.col("ip"))).alias("all_public"))
    safety = (
        F.when(~F.coalesce(F.col("_scheme").isin("http", "https"), F.lit(False)) | F.col("host").isNull(), "blocked")
        .when(F.col("all_public").isNull(), unresolved)
        .when(F.col("all_public"), "public")
        .otherwise("blocked")
    )
    return (
        urls.withColumns({"host": host_of(F.col("url")), "_scheme": scheme_of(F.col("url"))})
        .join(hosts, "host", "left")
        .withColumn("safety", safety)
        .drop("_scheme", "all_public")
    )
