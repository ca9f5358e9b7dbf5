"""Job queue and news sweeps, and issues."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators import clustering, jobs, news, pages_text, prompts
from loomgraph.operators.graph_read import recent_sources
from loomgraph.plans import newsroom, rules
from loomgraph.plans.graph_queries import _WINDOW, _STORY_COLUMNS, _window_start, _window_stories
from loomgraph.plans.oracle_views import ENTITIES, JOBS, SOURCES
from loomgraph.plans.registry import query
from loomgraph.plans.resolve_queries import order_lines
from loomgraph.plans.text_queries import CANONICAL
from loomgraph.sources import feeds, sinks
from loomgraph.sources.tables import Tables

RUN = "2024-06-01"


def _stamp() -> F.Column:
    return F.lit(RUN).cast("timestamp")


def _text(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _big(name: str) -> F.Column:
    return F.col(name).cast("bigint").alias(name)


# --- job queue: jobs = documents ---------------------------------------------------


def _queue(t: Tables) -> DataFrame:
    """The documents as a queue in all states."""
    state = F.array(*(F.lit(s) for s in ("pending", "processing", "done", "skipped", "failed")))
    return t.jobs().select(
        "job_id", "kb_id", "content", "metadata", F.element_at(state, (F.col("job_id") % 5 + 1).cast("int")).alias("status"),
        F.lit(None).cast("string").alias("relevance_reason"), F.when(F.col("job_id") % 2 == 0, "old error").alias("error"),
        (F.col("job_id") % 4).cast("int").alias("attempts"), F.timestamp_seconds("created_s").alias("created_at"),
        F.lit(None).cast("timestamp").alias("processed_at"), "relevant",
    )


_QUEUE = f"""{JOBS},
queue AS (
  SELECT *, ['pending', 'processing', 'done', 'skipped', 'failed'][(job_id % 5 + 1)::INTEGER] AS status,
    CASE WHEN job_id % 2 = 0 THEN 'old error' END AS error, (job_id % 4)::INTEGER AS attempts FROM jobs)"""


@query(
    """SELECT doc_id AS submission_id, concat('kb', doc_id % 4) AS kb_id, md5(replace(text, chr(7), '')) AS content, source, 'pending' AS status,
  sha256(concat('kb', doc_id % 4, chr(1), doc_id)) AS job_id FROM documents"""
)
def job_append(t: Tables) -> DataFrame:
    submissions = t.jobs().select(
        "kb_id", F.col("job_id").alias("submission_id"), F.concat("content", F.lit("\x00")).alias("text"),
        F.to_json(F.struct(F.col("kb_id"), F.lit("a\x07b").alias("x"))).alias("metadata"), F.timestamp_seconds("created_s").alias("submitted_at"),
    )
    made = jobs.new_jobs(submissions)
    ids = t.documents().select(
        F.sha2(F.concat_ws("\u0001", F.concat(F.lit("kb"), F.col("doc_id") % 4), F.col("doc_id").cast("string")), 256).alias("job_id"), F.col("doc_id").alias("submission_id"), "source"
    )
    return made.join(ids, "job_id").select("submission_id", "kb_id", F.md5("content").alias("content"), "source", "status", "job_id")


@query(
    f"""WITH {_QUEUE}
SELECT o_orderkey AS request_id, coalesce(status, '') AS status FROM orders LEFT JOIN queue ON job_id = o_custkey AND kb_id = concat('kb', o_orderkey % 4)"""
)
def job_status_lookup(t: Tables) -> DataFrame:
    """Orders ask for the job of their customer's number, often under a foreign tenant."""
    requests = t.raw("orders").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("kb"), F.col("o_orderkey") % 4).alias("kb_id"), F.col("o_custkey").alias("job_id")
    )
    return jobs.job_status(requests, _queue(t)).select("request_id", _text("status"))


@query(f"WITH {_QUEUE} SELECT job_id, kb_id, 'processing' AS status FROM queue WHERE status = 'pending' ORDER BY created_s, job_id LIMIT 5")
def claim_batch(t: Tables) -> DataFrame:
    return jobs.claim_batch(_queue(t)).select("job_id", "kb_id", "status")


@query(f"WITH {_QUEUE} SELECT job_id, CASE WHEN relevant THEN 'merge' WHEN NOT relevant THEN 'skip' ELSE 'retry' END AS route FROM queue")
def relevance_split(t: Tables) -> DataFrame:
    return t.jobs().select("job_id", jobs.relevance_route(F.col("relevant")).alias("route"))


@query(
    f"""WITH {JOBS}
SELECT job_id, coalesce(json_extract_string(metadata, '$.source'), '') AS source_label,
  strftime(make_timestamp(created_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS source_published_at FROM jobs"""
)
def job_metadata(t: Tables) -> DataFrame:
    found = jobs.job_metadata(t.jobs().withColumn("created_at", F.timestamp_seconds("created_s")))
    return found.select("job_id", "source_label", "source_published_at")


@query(
    f"""WITH {_QUEUE},
outcome AS (SELECT job_id, CASE WHEN relevant THEN 'done' WHEN NOT relevant THEN 'skipped' ELSE 'error' END AS result FROM queue WHERE status = 'processing')
SELECT q.job_id, CASE WHEN result IN ('done', 'skipped') THEN result WHEN attempts + 1 >= 3 AND result = 'error' THEN 'failed' WHEN result = 'error' THEN 'pending' ELSE status END AS status,
  coalesce(CASE WHEN result IN ('done', 'skipped') THEN NULL WHEN result = 'error' THEN 'no verdict' ELSE error END, '') AS error,
  (attempts + CASE WHEN result = 'error' THEN 1 ELSE 0 END)::BIGINT AS attempts,
  CASE WHEN result IN ('done', 'skipped') OR (result = 'error' AND attempts + 1 >= 3) THEN '{RUN}' ELSE '' END AS processed_at
FROM queue q LEFT JOIN outcome o ON o.job_id = q.job_id"""
)
def job_lifecycle(t: Tables) -> DataFrame:
    queue = _queue(t)
    route = F.col("relevant")
    outcomes = queue.where("status = 'processing'").select(
        "job_id", F.when(route, "done").when(~route, "skipped").otherwise("error").alias("result"), F.lit("because").alias("reason"),
        F.when(route.isNull(), "no verdict").alias("message"),
    )
    after = jobs.apply_outcomes(queue, outcomes, _stamp())
    return after.select("job_id", "status", _text("error"), _big("attempts"), F.coalesce(F.date_format("processed_at", "yyyy-MM-dd"), F.lit("")).alias("processed_at"))


@query(
    """WITH failures AS (
  SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
ends AS (
  SELECT user_id, min((ts, event_id)) FILTER (event_type = 'purchase') AS done, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1),
counted AS (
  SELECT e.user_id, done, last, count(n) FILTER (n <= 3 AND (done IS NULL OR (f.ts, f.event_id) < done)) AS attempts
  FROM ends e LEFT JOIN failures f ON f.user_id = e.user_id GROUP BY 1, 2, 3)
SELECT user_id AS job_id, attempts, CASE WHEN attempts >= 3 THEN 'failed' WHEN done IS NOT NULL THEN 'done' WHEN last IN ('view', 'click') THEN 'processing' ELSE 'pending' END AS status FROM counted"""
)
def job_replay(t: Tables) -> DataFrame:
    names = {"error": "failed_attempt", "purchase": "done", "signup": "submitted", "view": "processing", "click": "processing"}
    event = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("event_type")]
    log = t.raw("events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", event.alias("event"))
    return jobs.replay_events(log).select("job_id", "status", _big("attempts"))


# --- sources and polling -------------------------------------------------------------


def _stored_sources(t: Tables) -> DataFrame:
    """Customers are the feeds known so far."""
    return t.raw("customer").select(
        F.lit("rss").alias("kind"), F.col("c_name").alias("locator"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("title"),
        (F.col("c_nationkey") % 3 > 0).alias("active"), F.lit(None).cast("timestamp").alias("last_polled_at"),
        F.col("c_nationkey").alias("failure_count"), F.col("c_custkey").alias("source_id"),
    )


def _specs(t: Tables) -> DataFrame:
    """Customers with open orders and all suppliers are declared; some declarations are wrong."""
    open_ = t.raw("orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("ord"))
    feeds_ = open_.join(t.raw("customer"), "c_custkey").select(
        F.when(F.col("c_nationkey") == 24, "carrier-pigeon").otherwise("rss").alias("kind"), F.col("c_name").alias("url"),
        F.lit(None).cast("string").alias("path"), F.lit("declared").alias("title"), "ord",
    )
    folders = t.raw("supplier").select(
        F.lit("files").alias("kind"), F.lit("").alias("url"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("path"),
        F.lit(None).cast("string").alias("title"), F.col("s_suppkey").alias("ord"),
    )
    return feeds_.unionByName(folders)


_SPECS = """
specs AS (
  SELECT CASE c_nationkey WHEN 24 THEN 'carrier-pigeon' ELSE 'rss' END AS kind, c_name AS locator, 'declared' AS title FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
  UNION ALL SELECT 'files', CASE WHEN s_acctbal > 0 THEN s_name END, NULL FROM supplier),
valid AS (SELECT * FROM specs WHERE kind IN ('rss', 'files') AND locator IS NOT NULL)"""


@query(
    f"""WITH {_SPECS}
SELECT kind, coalesce(locator, '') AS locator, CASE WHEN kind NOT IN ('rss', 'files') THEN concat('no reader for kind ', kind) WHEN locator IS NULL THEN concat(kind, ' without a place: give url or path') ELSE '' END AS reason FROM specs"""
)
def source_specs(t: Tables) -> DataFrame:
    good, bad = feeds.check_specs(_specs(t))
    return good.select("kind", "locator", F.lit("").alias("reason")).unionByName(bad.select("kind", _text("locator"), "reason"))


@query(
    f"""WITH {_SPECS},
stored AS (SELECT 'rss' AS kind, c_name AS locator, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS title, c_nationkey % 3 > 0 AS active, c_nationkey AS failure_count FROM customer)
SELECT kind, locator, coalesce(CASE WHEN v.locator IS NULL THEN s.title ELSE v.title END, '') AS title, v.locator IS NOT NULL AS active, coalesce(failure_count, 0)::BIGINT AS failure_count,
  CASE WHEN v.locator IS NOT NULL AND s.locator IS NULL THEN 'inserted' WHEN v.locator IS NOT NULL THEN 'declared' WHEN s.active THEN 'deactivated' ELSE 'unchanged' END AS change
FROM stored s FULL JOIN valid v USING (kind, locator)"""
)
def source_reconcile(t: Tables) -> DataFrame:
    after = news.reconcile_sources(_stored_sources(t).drop("source_id"), feeds.check_specs(_specs(t))[0])
    return after.select("kind", "locator", _text("title"), "active", _big("failure_count"), "change")


@query(
    f"""SELECT c_custkey AS source_id, coalesce(CASE WHEN n > 0 THEN coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'found') ELSE CASE WHEN c_acctbal > 0 THEN c_mktsegment END END, '') AS title,
  (CASE WHEN n > 0 THEN 0 WHEN n = 0 THEN c_nationkey + 1 ELSE c_nationkey END)::BIGINT AS failure_count, CASE WHEN n > 0 THEN '{RUN}' ELSE '' END AS last_polled_at
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def poll_result(t: Tables) -> DataFrame:
    """A customer's orders are one poll; it worked when an open order came back."""
    polled = t.raw("orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"))
    outcomes = polled.select("source_id", (F.col("n") > 0).alias("ok"), F.lit("found").alias("discovered_title"))
    after = news.apply_poll(_stored_sources(t), outcomes, _stamp())
    return after.select("source_id", _text("title"), _big("failure_count"), F.coalesce(F.date_format("last_polled_at", "yyyy-MM-dd"), F.lit("")).alias("last_polled_at"))


def _polled(t: Tables) -> DataFrame:
    """Order lines are feed items of 97 sources, keyed by part; returned ones are blank."""
    return order_lines(t).select(
        (F.col("l_partkey") % 97).alias("source_id"),
        (F.col("o_orderkey") * 1000 + F.col("pos")).alias("pos"),
        (F.col("l_partkey") % 1000).alias("dedup_key"),
        F.when(F.col("l_returnflag") == "R", F.lit("   ")).otherwise(F.concat(F.lit("text "), F.col("o_orderkey"))).alias("text"),
    )


_POLLED = """
order_lines AS (
  SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS pos FROM lineitem),
polled AS (
  SELECT l_partkey % 97 AS source_id, pos, l_partkey % 1000 AS dedup_key, concat('text ', l_orderkey) AS text
  FROM order_lines WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_partkey % 97 ORDER BY pos) <= 50),
stored AS (SELECT DISTINCT l_partkey % 97 AS source_id, l_partkey % 1000 AS dedup_key FROM order_lines WHERE pos % 1000 = 1 AND l_returnflag = 'R')"""


@query(
    f"""WITH {_POLLED}
SELECT source_id, dedup_key, arg_min(text, pos) AS text FROM polled p
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id = p.source_id AND s.dedup_key = p.dedup_key) GROUP BY 1, 2"""
)
def item_insert(t: Tables) -> DataFrame:
    items = _polled(t)
    lines = order_lines(t).where("pos = 1 AND l_returnflag = 'R'")
    stored = lines.select((F.col("l_partkey") % 97).alias("source_id"), (F.col("l_partkey") % 1000).alias("dedup_key")).distinct()
    return news.absent_items(stored, news.polled_items(items)).select("source_id", "dedup_key", "text")


# --- item submission: items = documents -------------------------------------------------


def _items(t: Tables) -> DataFrame:
    status = F.array(*(F.lit(s) for s in ("pending", "processing", "done", "skipped", "failed", "")))
    doc = F.col("doc_id")
    sent = doc % 3 > 0
    return t.documents().select(
        doc.alias("item_id"), F.timestamp_seconds(F.lit(10_000_000) - doc).alias("created_at"), F.when(sent, doc).alias("job_id"),
        F.when(sent & (doc % 7 > 0), F.element_at(status, (doc % 6 + 1).cast("int"))).alias("job_status"), (doc % 5).cast("int").alias("attempts"),
        F.when(doc % 2 == 0, "old").alias("error"), "text", F.col("source").alias("title"),
    )


_ITEMS = """
items AS (
  SELECT doc_id AS item_id, 10000000 - doc_id AS created_s, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS job_id,
    CASE WHEN doc_id % 3 > 0 AND doc_id % 7 > 0 THEN ['pending', 'processing', 'done', 'skipped', 'failed', ''][(doc_id % 6 + 1)::INTEGER] END AS job_status,
    doc_id % 5 AS attempts, CASE WHEN doc_id % 2 = 0 THEN 'old' END AS error, text FROM documents)"""


@query(f"WITH {_ITEMS} SELECT item_id, attempts FROM items WHERE job_id IS NULL AND attempts < 3 ORDER BY created_s, item_id LIMIT 25")
def items_to_submit(t: Tables) -> DataFrame:
    return news.items_to_submit(_items(t)).select("item_id", _big("attempts"))


@query(f"WITH {_ITEMS} SELECT count(*) FILTER (job_id IS NULL AND attempts < 3) AS considered, count(*) FILTER (job_id IS NULL AND attempts >= 3) AS dead_lettered FROM items")
def dead_letters(t: Tables) -> DataFrame:
    free = F.col("job_id").isNull()
    return news.counters(_items(t), considered=free & (F.col("attempts") < 3), dead_lettered=free & (F.col("attempts") >= 3))


@query(
    f"""WITH {_ITEMS}, tried AS (SELECT item_id FROM items WHERE job_id IS NULL AND attempts < 3)
SELECT i.item_id, coalesce(CASE WHEN t.item_id % 2 = 0 THEN t.item_id ELSE job_id END::VARCHAR, '') AS job_id,
  coalesce(CASE WHEN t.item_id % 2 = 0 THEN 'pending' ELSE job_status END, '') AS job_status,
  (attempts + CASE WHEN t.item_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS attempts,
  coalesce(CASE WHEN t.item_id % 2 = 0 THEN NULL WHEN t.item_id IS NOT NULL THEN substring(text, 1, 500) ELSE error END, '') AS error
FROM items i LEFT JOIN tried t USING (item_id)"""
)
def submission_outcome(t: Tables) -> DataFrame:
    """Even items are accepted; for the others the text comes back as the error."""
    items = _items(t)
    even = F.col("item_id") % 2 == 0
    outcomes = news.unsubmitted(items).select("item_id", F.when(even, F.col("item_id")).alias("new_job_id"), F.when(~even, F.col("text")).alias("message"))
    after = news.apply_submissions(items, outcomes)
    return after.select("item_id", _text("job_id"), _text("job_status"), _big("attempts"), _text("error"))


@query(
    f"""WITH {CANONICAL},
extracted AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN html END AS page_text FROM pages)
SELECT page_id AS item_id, md5(coalesce(CASE WHEN page_id % 4 = 0 THEN 'kept' ELSE coalesce(nullif(page_text, ''), url) END, '')) AS full_text,
  CASE WHEN page_id % 4 = 0 THEN '2024-01-01' ELSE '{RUN}' END AS extracted_at FROM pages JOIN extracted USING (page_id)"""
)
def prepare_items(t: Tables) -> DataFrame:
    page = F.col("page_id")
    done = page % 4 == 0
    items = t.pages().select(
        page.alias("item_id"), F.col("url").alias("content"), F.when(done, "kept").alias("full_text"),
        F.when(done, F.lit("2024-01-01").cast("timestamp")).alias("extracted_at"),
    )
    extracted = t.pages().select(page.alias("item_id"), F.when(page % 3 == 0, "").when(page % 3 == 1, F.col("html")).alias("page_text"))
    after = news.prepare_items(items, extracted, _stamp())
    return after.select("item_id", F.md5(F.coalesce("full_text", F.lit(""))).alias("full_text"), F.date_format("extracted_at", "yyyy-MM-dd").alias("extracted_at"))


_OUTSTANDING = f"""{_ITEMS},
outstanding AS (SELECT * FROM items WHERE job_id IS NOT NULL AND (job_status IS NULL OR job_status NOT IN ('done', 'skipped', 'failed'))),
told AS (SELECT doc_id AS job_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'done' ELSE 'processing' END AS status FROM labels),
recorded AS (SELECT o.item_id, coalesce(nullif(status, ''), job_status) AS job_status, coalesce(status = 'done', false) AS resolved FROM outstanding o LEFT JOIN told ON told.job_id = o.job_id)"""


def _recorded(t: Tables) -> DataFrame:
    told = t.raw("labels").select(
        F.col("doc_id").alias("job_id"), F.when(F.col("toxic") == 1, "").when(F.col("quality") == 1, "done").otherwise("processing").alias("status")
    )
    return news.record_statuses(_items(t).where(news.is_outstanding()), told)


@query(f"WITH {_OUTSTANDING} SELECT item_id, coalesce(job_status, '') AS job_status, resolved FROM recorded")
def job_status_sweep(t: Tables) -> DataFrame:
    return _recorded(t).select("item_id", _text("job_status"), "resolved")


@query(f"WITH {_OUTSTANDING} SELECT count(*) AS checked, count(*) FILTER (resolved) AS resolved FROM recorded")
def status_counters(t: Tables) -> DataFrame:
    return news.counters(_recorded(t), checked=F.lit(True), resolved=F.col("resolved"))


@query(f"WITH {_ITEMS} SELECT item_id FROM items WHERE job_id IS NOT NULL AND (job_status IS NULL OR job_status NOT IN ('done', 'skipped', 'failed')) ORDER BY created_s, item_id LIMIT 200")
def outstanding_items(t: Tables) -> DataFrame:
    return news.outstanding_items(_items(t)).select("item_id")


# --- issues ------------------------------------------------------------------------------


@query(
    f"""WITH {SOURCES},
recent AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY ingested_at DESC NULLS FIRST, job_id) AS rank FROM sources QUALIFY rank <= 500)
SELECT kb_id, count(*) AS returned, count(*) >= 500 AS truncated, strftime(min(coalesce(ingested_at, published_at)), '%Y-%m-%d') AS oldest FROM recent GROUP BY 1"""
)
def window_report(t: Tables) -> DataFrame:
    found = news.window_report(recent_sources(t.sources()))
    return found.select("kb_id", "returned", "truncated", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"))


def _issues(t: Tables) -> DataFrame:
    """Documents as issue bodies, their first line as headline; several share a minute."""
    doc = F.col("doc_id")
    body = F.when(doc % 10 > 0, F.concat(F.lit("# Issue\n\n"), F.when(doc % 3 > 0, "## ").otherwise("### "), "text"))
    return t.documents().select(doc.alias("issue_id"), F.timestamp_seconds((doc - doc % 4) * 600 + doc % 4).alias("generated_at"), body.alias("body"))


_ISSUES = """
issues AS (
  SELECT doc_id AS issue_id, make_timestamp(((doc_id - doc_id % 4) * 600 + doc_id % 4) * 1000000) AS generated_at,
    CASE WHEN doc_id % 3 > 0 THEN coalesce(nullif(trim(string_split(ltrim(text, chr(10) || ' '), chr(10))[1]), ''), 'Untitled issue') ELSE 'Untitled issue' END AS headline
  FROM documents WHERE doc_id % 10 > 0)"""


@query(f"WITH {_ISSUES} SELECT issue_id, strftime(generated_at, '%Y-%m-%d-%H%M') AS slug, headline FROM issues")
def issue_list(t: Tables) -> DataFrame:
    return pages_text.list_issues(_issues(t)).select("issue_id", "slug", "headline")


@query(f"WITH {_ISSUES} SELECT strftime(generated_at, '%Y-%m-%d-%H%M') AS slug, arg_max(issue_id, generated_at) AS issue_id FROM issues GROUP BY 1")
def issue_by_slug(t: Tables) -> DataFrame:
    return pages_text.issues_by_slug(_issues(t)).select("slug", "issue_id")


_ISSUE_TEXT = f"""{_WINDOW}, {_STORY_COLUMNS},
stories AS (
  SELECT kb_id, cluster_id, concat('Story ', cluster_id) AS headline, concat(size, ' sources') AS body,
    row_number() OVER (PARTITION BY kb_id ORDER BY size DESC, newest DESC, arg_lead) AS place
  FROM sized JOIN (SELECT kb_id, cluster_id, arg_min(job_id, rank) AS arg_lead FROM kept GROUP BY 1, 2) USING (kb_id, cluster_id)),
dates AS (SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS until, strftime(max(o_orderdate) - INTERVAL 30 DAY, '%Y-%m-%d') AS since FROM orders),
tenants AS (SELECT DISTINCT c_mktsegment AS kb_id FROM customer),
text AS (
  SELECT kb_id AS issue_id, 0 AS a, 0 AS b, 0 AS c, 0 AS d, unnest([concat('# Issue — ', until), '', concat('*Covering ', since, ' to ', until, '.*'), '']) AS line, unnest([1, 2, 3, 4]) AS e FROM tenants, dates
  UNION ALL SELECT kb_id, 1, place, 0, 0, unnest([concat('## ', headline), '', body, '', '**Sources:**']), unnest([1, 2, 3, 4, 5]) FROM stories
  UNION ALL SELECT k.kb_id, 1, place, 1, rank, concat('- ', label, ' — ', strftime(published_at, '%Y-%m-%d')), 0 FROM kept k JOIN stories s ON s.kb_id = k.kb_id AND s.cluster_id = k.cluster_id
  UNION ALL SELECT kb_id, 1, place, 2, 0, '', 0 FROM stories)"""


def _issue_parts(t: Tables):
    """One issue per tenant from the last thirty days, with stories written by rule."""
    sources, mentions = _window_stories(t)
    kept = clustering.newest_sources(clustering.assign_clusters(sources, mentions))
    start = _window_start(t, 30)
    until = F.lit(start).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS")
    issues = t.raw("customer").select(F.col("c_mktsegment").alias("issue_id")).distinct().select(
        "issue_id", until.alias("generated_at"), F.lit(start).cast("timestamp_ntz").alias("covers_since")
    )
    # Biggest first, then newest, then the smallest leading source, as one sortable text.
    order = F.concat_ws(
        "/", F.lpad((F.lit(10**6) - F.col("size")).cast("string"), 7, "0"),
        F.lpad((F.lit(10**10) - F.unix_seconds(F.col("newest").cast("timestamp"))).cast("string"), 11, "0"), F.lpad(F.col("lead_id").cast("string"), 20, "0"),
    )
    stories = clustering.cluster_sizes(kept).select(
        F.col("kb_id").alias("issue_id"), "kb_id", "cluster_id", order.alias("story_order"), F.concat(F.lit("Story "), "cluster_id").alias("headline"),
        F.concat("size", F.lit(" sources")).alias("body"),
    )
    return issues, stories, kept, mentions


@query(f"""{_ISSUE_TEXT} SELECT issue_id, part, concat(string_agg(line, chr(10) ORDER BY n), chr(10)) AS body FROM (
  SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY a, b, c, d, e) AS n, ((row_number() OVER (PARTITION BY issue_id ORDER BY a, b, c, d, e) - 1) // {pages_text.PART_LINES})::INTEGER AS part FROM text) GROUP BY 1, 2""")
def issue_markdown(t: Tables) -> DataFrame:
    issues, stories, kept, _ = _issue_parts(t)
    return pages_text.bodies(pages_text.issue_lines(issues, stories, kept), "issue_id")


@query(
    f"""{_WINDOW}, {_STORY_COLUMNS}, {ENTITIES},
named AS (
  SELECT k.kb_id, cluster_id, entity_id, min(rank) AS r, any_value(concat('### ', name, ' (', type, ')', chr(10), coalesce(article, summary, ''))) AS block
  FROM kept k JOIN mentions m ON m.kb_id = k.kb_id AND m.job_id = k.job_id JOIN entities e ON e.kb_id = k.kb_id AND e.id = entity_id GROUP BY 1, 2, 3),
about AS (SELECT kb_id, cluster_id, string_agg(block, chr(10) || chr(10) ORDER BY r, entity_id) AS blocks FROM named GROUP BY 1, 2),
cited AS (SELECT kb_id, cluster_id, string_agg(concat('- ', label, ' (', strftime(published_at, '%Y-%m-%d'), ')'), chr(10) ORDER BY rank) AS items FROM kept GROUP BY 1, 2)
SELECT kb_id, cluster_id, concat(coalesce(blocks, ''), chr(10), chr(10), '### Sources', chr(10), items, chr(10)) AS brief FROM cited LEFT JOIN about USING (kb_id, cluster_id)"""
)
def cluster_briefs(t: Tables) -> DataFrame:
    _, stories, kept, mentions = _issue_parts(t)
    found = clustering.cluster_entities(kept, mentions)
    described = t.entities().select("kb_id", F.col("id").alias("entity_id"), "name", "type", "summary", "article")
    about = found.join(described, ["kb_id", "entity_id"])
    return pages_text.cluster_brief(stories, about, kept).select("kb_id", "cluster_id", "brief")


@query(
    f"""WITH {JOBS}
SELECT job_id, md5(content) AS user, concat('interest ', kb_id) AS opening FROM jobs"""
)
def relevance_prompts(t: Tables) -> DataFrame:
    asked = prompts.relevance(F.concat(F.lit("interest "), "kb_id"), F.col("content"))
    built = t.jobs().select("job_id", asked["system"].alias("system"), asked["user"].alias("user"))
    return built.select("job_id", F.md5("user").alias("user"), F.substring_index("system", "\n\n", 1).alias("opening"))


@query(
    f"""WITH {_POLLED},
fresh AS (SELECT DISTINCT source_id, dedup_key FROM polled p WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id = p.source_id AND s.dedup_key = p.dedup_key))
SELECT (SELECT count(DISTINCT l_partkey % 97) FROM order_lines) AS sources, (SELECT count(*) FROM fresh) AS inserted"""
)
def poll_counters(t: Tables) -> DataFrame:
    """Sources polled and items inserted by the sweep."""
    items = _polled(t)
    lines = order_lines(t).where("pos = 1 AND l_returnflag = 'R'")
    stored = lines.select((F.col("l_partkey") % 97).alias("source_id"), (F.col("l_partkey") % 1000).alias("dedup_key")).distinct()
    seen = items.select("source_id").distinct().select(F.lit(True).alias("polled"))
    fresh = news.absent_items(stored, news.polled_items(items)).select(F.lit(False).alias("polled"))
    return news.counters(seen.unionByName(fresh), sources=F.col("polled"), inserted=~F.col("polled"))


@query(
    f"""{_ISSUE_TEXT} SELECT concat('issue-', lower(issue_id)) AS slug, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (
  SELECT issue_id, unnest(string_split(line, chr(10))) AS line FROM text) GROUP BY 1"""
)
def issue_files(t: Tables) -> DataFrame:
    """Issues written twice as Markdown files to the shared folder, and read back once."""
    issues, stories, kept, _ = _issue_parts(t)
    lines = durable.cut(pages_text.issue_lines(issues, stories, kept))
    names = issues.select("issue_id", F.concat(F.lit("issue-"), F.lower("issue_id")).alias("slug"))
    folder = durable.fresh_folder(t.spark, "issues")
    for _ in range(2):
        sinks.write_markdown(lines, names, "issue_id", folder)
    return t.spark.read.text(folder).groupBy("slug").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


@query(
    """SELECT event_type AS key, strftime(CASE WHEN event_type = 'click' THEN TIMESTAMP '2030-01-01' ELSE max(ts) END, '%Y-%m-%d %H:%M:%S') AS ran_at,
  (SELECT count(*) FROM events e WHERE e.ts >= (SELECT max(ts) FROM events WHERE event_type = 'click')) AS since_last FROM events GROUP BY event_type"""
)
def covered_windows(t: Tables) -> DataFrame:
    """Events as runs of flows by kind: what the next run of one covers, and the watermarks after it."""
    runs = t.raw("events").select(F.col("event_type").alias("key"), F.col("ts").alias("ran_at"))
    since = news.watermark(runs, "click", datetime(2030, 1, 1))
    waiting = runs.where(F.col("ran_at") >= F.lit(since)).agg(F.count(F.lit(1)).alias("since_last"))
    after = news.advance_watermark(runs, "click", datetime(2030, 1, 1)).groupBy("key").agg(F.max("ran_at").alias("ran_at"))
    # ``waiting`` is one row.
    return after.join(F.broadcast(waiting), F.lit(True)).select("key", F.date_format("ran_at", "yyyy-MM-dd HH:mm:ss").alias("ran_at"), "since_last")


@query(
    f"""{_WINDOW}, {_STORY_COLUMNS}
SELECT 'issue' AS run, t.kb_id, count(size) AS clusters, count(size) AS stories, (4 + CASE WHEN count(size) = 0 THEN 1 ELSE 6 * count(size) + sum(size) END)::BIGINT AS lines, coalesce(sum(size), 0)::BIGINT AS told
FROM (SELECT DISTINCT c_mktsegment AS kb_id FROM customer) t LEFT JOIN sized s ON s.kb_id = t.kb_id GROUP BY 2
UNION ALL SELECT DISTINCT 'empty', c_mktsegment, 0, 0, 5, 0 FROM customer"""
)
def newsroom_run(t: Tables) -> DataFrame:
    """Every tenant's issue since its watermark, and the next ones, for which nothing has arrived."""
    start = _window_start(t, 30)
    until = start + timedelta(days=30)
    tenants = t.raw("customer").select(F.col("c_mktsegment").alias("kb_id")).distinct()
    marks = tenants.select("kb_id", F.lit(newsroom.WATERMARK).alias("key"), F.lit(start).cast("timestamp").alias("ran_at"))
    described = t.entities().withColumn("aliases", F.array().cast("array<string>"))
    rows = None
    for run, at in (("issue", until), ("empty", until + timedelta(days=2))):
        drafts = newsroom.draft_issues(tenants, t.story_sources(), t.mentions(), described, marks, at, rules.story_of_sources)
        marks = drafts.watermarks.withColumn("ran_at", F.lit(until + timedelta(days=1)).cast("timestamp"))
        told = F.regexp_extract("line", "^([0-9]+) sources$", 1)
        counted = drafts.lines.groupBy("issue_id").agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.when(told != "", told.cast("bigint"))), F.lit(0)).alias("told"))
        named = drafts.issues.select("issue_id", "kb_id").join(counted, "issue_id")
        row = drafts.reports.join(named, "kb_id").select(F.lit(run).alias("run"), "kb_id", "clusters", "stories", "lines", "told")
        rows = row if rows is None else rows.unionByName(row)
    return rows
