"""Names, URLs, abstracts, pages and feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions import dates, text
from loomgraph.functions.markdown import report_slug
from loomgraph.functions.urls import canonical_url, host_of
from loomgraph.operators import claims
from loomgraph.plans.oracle_views import LINES
from loomgraph.plans.registry import query
from loomgraph.sources import feeds, pages
from loomgraph.sources.tables import Tables


@query(
    f"""WITH {LINES}
SELECT doc_id, pos, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS name, regexp_replace(upper(replace(line, 'ß', 'SS')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM lines"""
)
def normalize_names(t: Tables) -> DataFrame:
    line = F.col("line")
    return t.lines().select("doc_id", "pos", text.normalize_name(line).alias("name"), text.type_key(line).alias("key"))


@query("""SELECT doc_id, substring(trim(regexp_extract(trim(text, chr(10) || ' '), '^(?s:.*?[.!?])(\\s|$)|^(?s:.*)$', 0), chr(10) || ' '), 1, 240) AS abstract FROM documents""")
def abstracts(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", text.first_sentence(F.col("text")).alias("abstract"))


@query("""SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents""")
def sanitize_text(t: Tables) -> DataFrame:
    """Texts with control characters put around every line lose exactly those."""
    dirty = F.concat(F.lit("\x00"), F.replace("text", F.lit("\n"), F.lit("\x07\n\x1f")), F.lit("\x0b"))
    clean = t.documents().select("doc_id", text.sanitize(dirty).alias("clean"))
    return clean.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").cast("bigint").alias("n"))


@query("""SELECT doc_id, source, length(text) AS n FROM documents""")
def sanitize_metadata(t: Tables) -> DataFrame:
    """The same inside nested JSON values."""
    doc = F.to_json(F.struct(F.concat("source", F.lit("\x00")).alias("source"), F.array(F.concat("text", F.lit("\x07"))).alias("parts")))
    clean = t.documents().select("doc_id", text.sanitize_json(doc).alias("j"))
    return clean.select(
        "doc_id", F.get_json_object("j", "$.source").alias("source"), F.length(F.get_json_object("j", "$.parts[0]")).cast("bigint").alias("n")
    )


CANONICAL = """
url_parts AS (
  SELECT page_id, url, html, regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
canonical AS (
  SELECT page_id, url, html, lower(u.host) AS host, concat(lower(u.scheme), '://', lower(u.host), CASE WHEN rtrim(u.path, '/') = '' THEN u.path ELSE rtrim(u.path, '/') END,
    CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS canonical_url
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(u.query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS q FROM url_parts))"""


@query(f"WITH {CANONICAL} SELECT page_id, canonical_url, host FROM canonical")
def canonical_urls(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages().select("page_id", canonical_url(url).alias("canonical_url"), host_of(url).alias("host"))


@query(
    f"""WITH {CANONICAL},
first AS (SELECT canonical_url, min(page_id) AS first_id FROM canonical GROUP BY 1)
SELECT page_id AS submission_id, canonical_url, CASE WHEN page_id = first_id AND first_id % 2 = 1 THEN 'created' ELSE 'known' END AS outcome,
  CASE WHEN first_id % 2 = 0 THEN concat('stored/', first_id) ELSE sha256(canonical_url) END AS document_id
FROM canonical JOIN first USING (canonical_url)"""
)
def submit_url(t: Tables) -> DataFrame:
    """Every page is submitted; pages first seen under an even id are stored already."""
    submissions = t.pages().select(F.col("page_id").alias("submission_id"), "url")
    firsts = submissions.groupBy(canonical_url(F.col("url")).alias("canonical_url")).agg(F.min("submission_id").alias("first_id"))
    stored = firsts.where("first_id % 2 = 0").select("canonical_url", F.concat(F.lit("stored/"), "first_id").alias("document_id"))
    found = claims.submit_urls(stored, submissions)
    outcome = F.when(F.col("created"), "created").otherwise("known").alias("outcome")
    return found.select("submission_id", "canonical_url", outcome, "document_id")


@query(
    """SELECT page_id, host, CASE WHEN n = 0 THEN 'transient' WHEN private THEN 'blocked' ELSE 'public' END AS safety
FROM (SELECT page_id, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, length(regexp_extract(url, '//([^/?#]*)', 1)) % 4 AS n FROM pages)
JOIN (SELECT DISTINCT lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, length(regexp_extract(url, '//([^/?#]*)', 1)) % 3 = 0 AS private FROM pages) USING (host)"""
)
def public_urls(t: Tables) -> DataFrame:
    """Hosts resolve to up to three addresses by the length of their name, some of them private."""
    hosts = t.pages().select(host_of(F.col("url")).alias("host")).distinct().where(F.length("host") % 4 > 0)
    size = F.length("host")
    private = F.element_at(F.array(*(F.lit(a) for a in ("10.0.0.", "127.0.0.", "169.254.1.", "192.168.7."))), size % 4 + 1)
    last = F.when(size % 3 == 0, F.concat(private, size)).otherwise(F.concat(F.lit("93.184.216."), size))
    public = F.transform(F.sequence(F.lit(1), size % 4), lambda i: F.concat(F.lit("8.8.4."), i))
    resolved = hosts.select("host", F.explode(F.concat(public, F.array(last))).alias("ip"))
    return pages.url_safety(t.pages().select("page_id", "url"), resolved).select("page_id", "host", "safety")


# DuckDB's patterns know no back references: one alternative for each element whose content is not shown.
_HIDDEN = "|".join(
    rf"<{name}\b[^>]*>.*?</{name}\s*>"
    for name in "script style noscript template svg head nav footer aside form iframe".split()
)
_BREAKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|main|blockquote|pre|figure|hr|body"


def _plain(html: str) -> str:
    """SQL for the character references that the given pages use."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        html = f"replace({html}, '&{name};', '{char}')"
    return html


@query(
    rf"""WITH shown AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is){_HIDDEN}', '', 'g') AS s FROM pages),
bare AS (SELECT page_id, html, regexp_replace(regexp_replace(s, '(?i)</?(?:{_BREAKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS s FROM shown),
tidy AS (SELECT page_id, html, regexp_replace(regexp_replace({_plain("s")}, '[\t\x0B\f\r\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g') AS s FROM bare)
SELECT page_id, nullif(trim({_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)")}, ' ' || chr(9) || chr(10) || chr(13)), '') AS page_title,
  nullif(trim(s, ' ' || chr(10)), '') AS page_text, false AS truncated FROM tidy"""
)
def html_text(t: Tables) -> DataFrame:
    found = pages.page_text(t.pages())
    return found.select("page_id", "page_title", "page_text", "truncated")


@query("SELECT doc_id, substring(text, 1, 2000) AS head, length(text) > 2000 AS truncated, least(length(text), 2000) AS n FROM documents")
def text_fit(t: Tables) -> DataFrame:
    head, truncated = text.fit(F.col("text"), 2000)
    return t.documents().select("doc_id", head.alias("head"), truncated.alias("truncated"), F.length(head).cast("bigint").alias("n"))


def feed_entries(t: Tables) -> DataFrame:
    """Pages as feed entries with the usual flaws: no guid, mangled links, empty bodies."""
    page, url = F.col("page_id"), F.col("url")
    day = F.concat(F.lpad((page % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 10:00:00 +0200"))
    return t.pages().select(
        page.alias("pos"),
        host_of(url).alias("source_id"),
        F.when(page % 3 == 1, url).when(page % 3 == 2, F.concat(F.lit("guid-"), page)).otherwise("").alias("guid"),
        F.when(page % 11 == 0, F.concat(F.lit('<a href="'), url, F.lit('">'))).when(page % 13 != 0, url).alias("link"),
        F.concat(F.lit("<i>"), F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit("</i> ")).alias("title"),
        F.when(page % 5 == 0, "").when(page % 5 > 1, F.col("html")).alias("content"),
        F.concat(F.lit("about "), page).alias("summary"),
        F.when(page % 4 == 0, F.concat(F.lit("Mon, "), day)).when(page % 4 == 1, day).when(page % 4 == 2, "2024-01-05").otherwise("soon").alias("published"),
    )


FEED_ITEMS = f"""{CANONICAL},
entries AS (
  SELECT page_id AS pos, host AS source_id, url, canonical_url, html,
    CASE page_id % 3 WHEN 1 THEN url WHEN 2 THEN concat('guid-', page_id) ELSE '' END AS guid,
    CASE WHEN page_id % 11 = 0 THEN 'mangled' WHEN page_id % 13 <> 0 THEN url END AS link,
    replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&') AS title
  FROM canonical),
items AS (
  SELECT pos, source_id, coalesce(nullif(guid, ''), CASE link WHEN 'mangled' THEN concat('<a href="', url, '">') ELSE canonical_url END) AS dedup_key,
    CASE WHEN link <> 'mangled' THEN url WHEN guid = url THEN url END AS url, nullif(trim(title), '') AS title,
    CASE WHEN pos % 5 = 0 THEN NULL WHEN pos % 5 > 1 THEN html ELSE concat('about ', pos) END AS text,
    CASE pos % 4 WHEN 3 THEN NULL WHEN 2 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-01 08:00:00' + to_days((pos % 28)::INTEGER) END AS published_at
  FROM entries WHERE guid <> '' OR link IS NOT NULL)"""


@query(
    f"""WITH {FEED_ITEMS}
SELECT pos, source_id, CASE WHEN contains(dedup_key, '<a') THEN 'mangled' ELSE dedup_key END AS dedup_key, coalesce(url, '') AS url, coalesce(title, '') AS title,
  md5(coalesce(text, '')) AS text, coalesce(strftime(published_at, '%Y-%m-%d %H:%M'), '') AS published_at FROM items"""
)
def feed_items(t: Tables) -> DataFrame:
    items = feeds.to_items(feed_entries(t))
    blank = F.lit("")
    return items.select(
        "pos", "source_id", F.when(F.col("dedup_key").contains("<a"), "mangled").otherwise(F.col("dedup_key")).alias("dedup_key"),
        F.coalesce("url", blank).alias("url"), F.coalesce("title", blank).alias("title"), F.md5(F.coalesce("text", blank)).alias("text"),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm"), blank).alias("published_at"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS day,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate - INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 10:30') ELSE '' END AS stamp
FROM orders"""
)
def iso_dates(t: Tables) -> DataFrame:
    """Order dates in several spellings, a third of them unreadable."""
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    spelled = F.when(key % 3 == 0, F.concat(day, F.lit("T00:00:00+02:30"))).when(
        key % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" 1030"))
    ).otherwise(F.concat(F.lit("on "), day))
    stamp = F.coalesce(F.date_format(dates.parse_iso(spelled), "yyyy-MM-dd HH:mm"), F.lit(""))
    return t.raw("orders").select("o_orderkey", dates.iso_or_empty(day).alias("day"), stamp.alias("stamp"))


@query(
    f"""WITH {LINES}
SELECT doc_id, pos, coalesce(nullif(substring(trim(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), ''), 'document') AS slug FROM lines"""
)
def report_slugs(t: Tables) -> DataFrame:
    return t.lines().select("doc_id", "pos", report_slug(F.col("line"), F.lit("url")).alias("slug"))


@query(
    f"""WITH {FEED_ITEMS}
SELECT pos, coalesce(title, url, 'untitled') AS source, coalesce(url, '') AS url, coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS published_at FROM items"""
)
def submission_metadata(t: Tables) -> DataFrame:
    from loomgraph.operators.news import submission_metadata as metadata

    items = feeds.to_items(feed_entries(t)).withColumn("m", metadata(F.col("title"), F.col("url"), F.col("published_at")))
    read = [F.coalesce(F.get_json_object("m", f"$.{k}"), F.lit("")).alias(k) for k in ("source", "url", "published_at")]
    return items.select("pos", *read)


@query(
    """SELECT concat('page/', page_id) AS dedup_key, url, concat('Page ', page_id) AS title, md5(trim(html, chr(10) || chr(13) || chr(9) || ' ')) AS text,
  strftime(TIMESTAMP '2024-01-01 08:00:00' + to_days((page_id % 28)::INTEGER), '%Y-%m-%d %H:%M') AS published_at FROM pages"""
)
def feed_files(t: Tables) -> DataFrame:
    """Pages written as RSS files to the shared folder and read back as items."""
    page = F.col("page_id")
    at = F.lit("2024-01-01 08:00:00").cast("timestamp") + F.make_dt_interval((page % 28).cast("int"))
    entries = t.pages().select(
        F.struct(F.concat(F.lit("page/"), page).alias("_VALUE"), F.lit("false").alias("_isPermaLink")).alias("guid"), F.col("url").alias("link"),
        F.concat(F.lit("Page "), page).alias("title"), F.col("html").alias("description"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"),
    )
    folder = durable.fresh_folder(t.spark, "feeds")
    entries.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(folder)
    items = feeds.to_items(feeds.read_feeds(t.spark, folder))
    return items.select("dedup_key", "url", "title", F.md5("text").alias("text"), F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))
