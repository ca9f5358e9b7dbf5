"""Feeds, drop directories, pages, URL safety, jobs and sinks."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators import jobs, news
from loomgraph.sources import feeds, files, pages, sinks

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed T</title>
<item><title>One</title><link>https://a.org/1?utm_source=x</link><guid isPermaLink="false">g-1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>sum</description><content:encoded><![CDATA[<p>full</p>]]></content:encoded></item>
<item><title>&lt;a href="x"&gt;Two &amp;amp; a half&lt;/a&gt;</title><link>https://a.org/2/?b=2&amp;a=1</link><description>only summary</description></item>
<item><title>Three</title><link>&lt;a href="https://a.org"&gt;</link><guid>https://a.org/3</guid></item>
<item><title>No key</title></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Atom T</title><entry><id>urn:1</id><title>A</title><link rel="self" href="https://b.org/self"/><link rel="alternate" href="https://b.org/1"/>
<updated>2024-01-02T00:00:00Z</updated><summary>s</summary></entry></feed>"""


@pytest.fixture
def feed_dir(tmp_path):
    folder = tmp_path / "feeds"
    folder.mkdir()
    (folder / "rss.xml").write_text(RSS)
    (folder / "atom.xml").write_text(ATOM)
    (folder / "broken.xml").write_text("<html>not a feed</html>")
    return str(folder)


def test_feeds(spark, feed_dir):
    got = {r["dedup_key"]: r for r in feeds.to_items(feeds.read_feeds(spark, feed_dir)).collect()}
    assert set(got) == {"g-1", "https://a.org/2?a=1&b=2", "https://a.org/3", "urn:1"}
    one = got["g-1"]
    assert (one["title"], one["url"], one["text"], one["published_at"]) == ("One", "https://a.org/1?utm_source=x", "<p>full</p>", datetime(2024, 1, 1, 10))
    assert got["https://a.org/2?a=1&b=2"]["title"] == "Two & a half"
    assert (got["https://a.org/3"]["url"], got["https://a.org/3"]["text"]) == ("https://a.org/3", None)
    assert (got["urn:1"]["url"], got["urn:1"]["text"], got["urn:1"]["published_at"]) == ("https://b.org/1", "s", datetime(2024, 1, 2))


def test_feed_outcomes(spark, feed_dir):
    entries, titles = feeds.read_feeds(spark, feed_dir), feeds.feed_titles(spark, feed_dir)
    asked = spark.read.format("binaryFile").load(feed_dir).select(F.col("path").alias("locator"))
    got = {os.path.basename(r["locator"]): (r["ok"], r["feed_title"]) for r in feeds.feed_outcomes(asked, entries, titles).collect()}
    assert got == {"rss.xml": (True, "Feed T"), "atom.xml": (True, "Atom T"), "broken.xml": (False, None)}


def test_drop_directory(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "one.txt").write_text("a\r\nb")
    (folder / "Two words.MD").write_bytes(b"bad \xff byte")
    (folder / "skip.bin").write_bytes(b"x")
    (folder / "txt").write_text("no suffix")
    (folder / "sub").mkdir()
    first = {r["title"]: r for r in files.read_drop_directory(spark, str(folder)).collect()}
    assert set(first) == {"one.txt", "Two words.MD"}
    assert first["one.txt"]["text"] == "a\nb" and first["Two words.MD"]["text"] == "bad � byte"
    (folder / "one.txt").write_text("changed")
    second = {r["title"]: r for r in files.read_drop_directory(spark, str(folder)).collect()}
    assert second["one.txt"]["dedup_key"] != first["one.txt"]["dedup_key"]
    assert second["Two words.MD"]["dedup_key"] == first["Two words.MD"]["dedup_key"]
    assert files.read_drop_directory(spark, str(tmp_path / "missing")).count() == 0


def test_dispatch(spark, tmp_path, feed_dir):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("x")
    got = feeds.fetch_items(spark, [("rss", feed_dir), ("files", str(tmp_path / "d"))])
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"rss": 4, "files": 1}
    with pytest.raises(ValueError, match="no reader for kind pigeon"):
        feeds.fetch_items(spark, [("pigeon", "x")])


def test_specs(spark):
    rows = [("rss", "https://a", None, "A"), ("files", None, "/d", None), ("pigeon", "x", None, None), ("rss", "", None, None)]
    good, bad = feeds.check_specs(spark.createDataFrame(rows, "kind string, url string, path string, title string"))
    assert {(r["kind"], r["locator"]) for r in good.collect()} == {("rss", "https://a"), ("files", "/d")}
    assert sorted(r["reason"] for r in bad.collect()) == ["no reader for kind pigeon", "rss without a place: give url or path"]


def test_page_text(spark):
    html = (
        '<html><head><title>T &amp; U</title><meta name="author" content="Ann"><meta property="article:published_time" content="2024-01-02"></head><body><nav>menu</nav>'
        "<script>var x='<p>';</script><!-- note --><article><h1>Head</h1><p>First   <b>bold</b> &lt;x&gt;</p><p>Second<br>line</p></article><footer>foot</footer></body></html>"
    )
    df = spark.createDataFrame([(1, html), (2, "<html><script>only()</script></html>")], "url int, html string")
    got = {r["url"]: r for r in pages.page_text(df).collect()}
    assert got[1]["page_text"] == "Head\nFirst bold <x>\nSecond\nline"
    assert (got[1]["page_title"], got[1]["page_author"], got[1]["page_date"], got[1]["truncated"]) == ("T & U", "Ann", "2024-01-02", False)
    assert got[2]["page_text"] is None
    short = pages.page_text(df, max_chars=5).where("url = 1").first()
    assert (short["page_text"], short["truncated"]) == ("Head\n", True)


def test_url_safety(spark):
    urls = [("https://ok.org/x",), ("https://mixed.org",), ("https://gone.org",), ("ftp://ok.org",), ("https:///x",)]
    resolved = spark.createDataFrame([("ok.org", "8.8.8.8"), ("ok.org", "1.1.1.1"), ("mixed.org", "8.8.8.8"), ("mixed.org", "10.0.0.1")], "host string, ip string")
    df = spark.createDataFrame(urls, "url string")
    got = {r["url"]: r["safety"] for r in pages.url_safety(df, resolved).collect()}
    assert list(got.values()).count("blocked") == 3 and got["https://ok.org/x"] == "public" and got["https://gone.org"] == "transient"
    assert pages.url_safety(df, resolved, "blocked").where("safety = 'public'").count() == 1


def test_job_outcomes(spark):
    rows = [("1", "processing", 0, "old", None), ("2", "processing", 1, None, None), ("3", "processing", 2, None, None), ("4", "pending", 0, None, None)]
    table = spark.createDataFrame(rows, "job_id string, status string, attempts int, error string, relevance_reason string").withColumn("processed_at", F.lit(None).cast("timestamp"))
    out = spark.createDataFrame([("1", "skipped", "off topic", None), ("2", "error", None, "boom"), ("3", "error", None, "boom")], "job_id string, result string, reason string, message string")
    got = {r["job_id"]: r for r in jobs.apply_outcomes(table, out, F.lit(datetime(2024, 1, 1))).collect()}
    assert (got["1"]["status"], got["1"]["error"], got["1"]["relevance_reason"]) == ("skipped", None, "off topic")
    assert (got["2"]["status"], got["2"]["attempts"], got["2"]["processed_at"]) == ("pending", 2, None)
    assert (got["3"]["status"], got["3"]["attempts"]) == ("failed", 3) and got["3"]["processed_at"] is not None
    assert got["4"]["status"] == "pending"


def test_polling(spark):
    items = [("s", i, f"k{i % 60}", " " if i == 0 else f"t{i}") for i in range(120)]
    df = spark.createDataFrame(items, "source_id string, pos int, dedup_key string, text string")
    polled = news.polled_items(df)
    assert polled.agg(F.min("pos"), F.max("pos"), F.count("*")).first()[:] == (1, 50, 50)
    stored = spark.createDataFrame([("s", "k1"), ("t", "k2")], "source_id string, dedup_key string")
    assert news.absent_items(stored, df).count() == 59


def test_markdown_sink_and_snapshots(spark, tmp_path):
    from loomgraph.operators.pages_text import issue_lines

    n = 200
    stories = spark.createDataFrame([("i", "kb", "c", f"{k:05d}", f"H{k}", "B") for k in range(n)], "issue_id string, kb_id string, cluster_id string, story_order string, headline string, body string")
    issues = spark.createDataFrame([("i", datetime(2024, 1, 2), datetime(2024, 1, 1)), ("e", datetime(2024, 1, 2), datetime(2024, 1, 1))], "issue_id string, generated_at timestamp, covers_since timestamp")
    cited = spark.createDataFrame([], "kb_id string, cluster_id string, rank int, label string, published_at timestamp, ingested_at timestamp")
    names = issues.select("issue_id", F.concat(F.lit("slug-"), "issue_id").alias("slug"))
    out = str(tmp_path / "out")
    sinks.write_markdown(issue_lines(issues, stories, cited), names, "issue_id", out)
    folder = os.path.join(out, "slug=slug-i")
    text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert text.startswith("# Issue — 2024-01-02\n") and [x for x in text.split("\n") if x.startswith("## ")] == [f"## H{k}" for k in range(n)]
    first, second = durable.publish(names, str(tmp_path / "t")), durable.publish(names, str(tmp_path / "t"))
    assert first != second and spark.read.parquet(second).count() == 2


def test_written_drop_directory(spark, tmp_path):
    """One flat directory with a file for each name, whatever the name; rows that share one are its lines."""
    rows = [("a-1", "first"), ("a/b:2 ü", "two\nlines"), ("", "nameless"), ("_x", None), ("twice", "same"), ("twice", "same")]
    folder = tmp_path / "drop"
    files.write_drop_directory(spark.createDataFrame(rows, "name string, value string"), str(folder))
    assert all(f.is_file() for f in folder.iterdir())
    got = {r["title"]: r["text"] for r in files.read_drop_directory(spark, str(folder)).collect()}
    assert sorted(got.values()) == ["\n", "first\n", "nameless\n", "same\nsame\n", "two\nlines\n"]


def test_order_lines_are_joined_once_and_shuffles_follow_the_input(spark, tmp_path, monkeypatch):
    from loomgraph.sources import tables

    lines = [(1, 7, 3, 1, "R"), (1, 7, 4, 2, "N"), (2, 7, 3, 1, "N"), (3, 7, 3, 1, "N"), (3, 8, 3, 2, "N")]
    made = {
        "customer": ([(1, "A"), (2, None)], "c_custkey long, c_mktsegment string"),
        "orders": ([(1, 1, "p"), (2, 1, "p"), (3, 2, "p")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"),
    }
    for name, (rows, schema) in made.items():
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn("o_orderdate", F.lit("2024-01-01").cast("timestamp")) if name == "orders" else df
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(tables, "PARTITION_BYTES", 100, raising=False)
    t = tables.Tables(spark, str(tmp_path))
    assert "Join" not in t._lines()._jdf.queryExecution().optimizedPlan().toString()
    # A source without a tenant names one unknown entity, as before.
    got = sorted(map(tuple, t.mentions().select("job_id", "entity_id").collect()))
    assert got == [(1, "A/P/7"), (2, "A/P/7"), (3, None)]
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(spark.conf.get(key)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(tables, "PARTITION_BYTES", 1 << 40, raising=False)
    tables.Tables(spark, str(tmp_path))
    assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
