"""Graph reads and writes, and story clusters."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import clustering, graph_read, graph_write
from loomgraph.operators.graph_read import at_least
from loomgraph.plans.oracle_views import ENTITIES, MENTIONS, RELATED, SOURCES, STORY_SOURCES, label_rounds
from loomgraph.plans.registry import query
from loomgraph.sources.tables import Tables


# Lines from this length on make documents tell the same story.
LEAST_LINE = 1


def _date(name: str, fmt: str = "yyyy-MM-dd") -> F.Column:
    return F.coalesce(F.date_format(name, fmt), F.lit("")).alias(name)


def _window_start(t: Tables, days: int):
    """Watermark: so many days before the newest order; one maximum over a date column."""
    return t.raw("orders").agg(F.max("o_orderdate")).first()[0] - timedelta(days=days)


# --- stories --------------------------------------------------------------------


def _window_stories(t: Tables) -> tuple[DataFrame, DataFrame]:
    sources = t.story_sources()
    return sources.where(at_least(sources, "ingested_at", _window_start(t, 30))), t.mentions()


def _show_stories(stories: DataFrame) -> DataFrame:
    return stories.select(
        "kb_id", "cluster_id", "size", _date("newest"), F.col("job_id").alias("source_id"), F.col("rank").cast("bigint").alias("rank")
    )


_STORY_COLUMNS = """
kept AS (
  SELECT *, row_number() OVER (PARTITION BY kb_id, cluster_id ORDER BY coalesce(ingested_at, published_at) DESC NULLS LAST, job_id) AS rank
  FROM assigned QUALIFY rank <= 12),
sized AS (SELECT kb_id, cluster_id, count(*) AS size, max(coalesce(ingested_at, published_at)) AS newest FROM kept GROUP BY 1, 2)"""

_STORY_SELECT = """
SELECT kb_id, cluster_id, size, coalesce(strftime(newest, '%Y-%m-%d'), '') AS newest, job_id AS source_id, rank
FROM kept JOIN sized USING (kb_id, cluster_id)"""

_WINDOW = f"""WITH {STORY_SOURCES}, {MENTIONS},
fresh AS (SELECT * FROM sources WHERE ingested_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY),
members AS (SELECT m.kb_id, job_id AS node, entity_id AS entity FROM mentions m WHERE job_id IN (SELECT job_id FROM fresh)),
{label_rounds("members", 14)},
assigned AS (SELECT f.*, coalesce(l.label, job_id) AS cluster_id FROM fresh f LEFT JOIN labels_14 l ON f.kb_id = l.kb_id AND f.job_id = l.node)"""

_ALL_TIME = f"""WITH {SOURCES}, {MENTIONS},
members AS (SELECT kb_id, job_id AS node, entity_id AS entity FROM mentions),
{label_rounds("members", 10)},
assigned AS (SELECT f.*, coalesce(l.label, job_id) AS cluster_id FROM sources f LEFT JOIN labels_10 l ON f.kb_id = l.kb_id AND f.job_id = l.node)"""


@query(f"{_WINDOW}, {_STORY_COLUMNS} {_STORY_SELECT}")
def story_clusters(t: Tables) -> DataFrame:
    return _show_stories(clustering.story_clusters(*_window_stories(t)))


@query(f"{_ALL_TIME}, {_STORY_COLUMNS} {_STORY_SELECT}")
def story_clusters_all_time(t: Tables) -> DataFrame:
    return _show_stories(clustering.story_clusters(t.sources(), t.mentions()))


@query(f"{_ALL_TIME} SELECT kb_id, cluster_id, count(*) AS members FROM assigned GROUP BY 1, 2")
def cluster_sizes(t: Tables) -> DataFrame:
    assigned = clustering.assign_clusters(t.sources(), t.mentions())
    return assigned.groupBy("kb_id", "cluster_id").agg(F.count(F.lit(1)).alias("members"))


@query(
    f"""{_WINDOW}, {_STORY_COLUMNS}
SELECT kb_id, cluster_id, entity_id, min(rank) AS first_rank
FROM kept JOIN mentions USING (kb_id, job_id) GROUP BY 1, 2, 3"""
)
def cluster_entities(t: Tables) -> DataFrame:
    sources, mentions = _window_stories(t)
    kept = clustering.newest_sources(clustering.assign_clusters(sources, mentions))
    return clustering.cluster_entities(kept, mentions).withColumn("first_rank", F.col("first_rank").cast("bigint"))


@query(
    f"""WITH lines AS (
  SELECT doc_id, md5(line) AS entity FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE length(line) >= {LEAST_LINE}),
members AS (SELECT DISTINCT 'all' AS kb_id, doc_id AS node, entity FROM lines),
{label_rounds("members", 14)}
SELECT d.doc_id, coalesce(label, d.doc_id) AS cluster_id FROM documents d LEFT JOIN labels_14 ON d.doc_id = node"""
)
def shared_line_clusters(t: Tables) -> DataFrame:
    """Documents telling the same story, by the lines they share."""
    documents = t.documents().select(F.lit("all").alias("kb_id"), F.col("doc_id").alias("job_id"))
    lines = t.lines().where(F.length("line") >= LEAST_LINE)
    mentions = lines.select(F.lit("all").alias("kb_id"), F.md5("line").alias("entity_id"), F.col("doc_id").alias("job_id")).distinct()
    return clustering.assign_clusters(documents, mentions).select(F.col("job_id").alias("doc_id"), "cluster_id")


# --- reads ------------------------------------------------------------------------

_GRAPH = f"{SOURCES}, {MENTIONS}, {ENTITIES}, {RELATED}"


@query(
    f"""WITH {_GRAPH}
SELECT kb_id, id, name, strftime(updated_at, '%Y-%m-%d') AS updated_at,
  row_number() OVER (PARTITION BY kb_id ORDER BY entities.updated_at DESC, id) AS rank
FROM entities WHERE entities.updated_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY QUALIFY rank <= 50"""
)
def nodes_since(t: Tables) -> DataFrame:
    found = graph_read.nodes(t.entities(), since=_window_start(t, 60))
    return found.select("kb_id", "id", "name", _date("updated_at"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH {_GRAPH}
SELECT kb_id, id, name, row_number() OVER (PARTITION BY kb_id ORDER BY id) AS rank
FROM entities WHERE type = 'Supplier' QUALIFY rank <= 500"""
)
def nodes_of_type(t: Tables) -> DataFrame:
    found = graph_read.nodes(t.entities(), type_="Supplier", limit=500)
    return found.select("kb_id", "id", "name", F.col("rank").cast("bigint").alias("rank"))


def _requested_parts(t: Tables) -> DataFrame:
    """Page requests for the bought parts; urgent buyers ask in a tenant that does not hold them."""
    lines = t._lines().select("kb_id", "l_partkey", "o_orderpriority")
    foreign = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("NOWHERE")).otherwise(F.col("kb_id"))
    return lines.select(foreign.alias("ask_kb"), t.part_id().alias("id")).distinct().withColumnRenamed("ask_kb", "kb_id")


@query(
    f"""WITH {_GRAPH},
requests AS (
  SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'NOWHERE' ELSE kb_id END AS kb_id, concat(kb_id, '/P/', l_partkey) AS id
  FROM lineitem JOIN orders_kb ON l_orderkey = o_orderkey)
SELECT r.kb_id, r.id, e.id IS NOT NULL AS found, coalesce(name, '') AS name
FROM requests r LEFT JOIN entities e ON r.kb_id = e.kb_id AND r.id = e.id"""
)
def node_lookup(t: Tables) -> DataFrame:
    found = graph_read.node_lookup(_requested_parts(t), t.entities())
    return found.select("kb_id", "id", "found", F.coalesce("name", F.lit("")).alias("name"))


@query(
    f"""WITH {_GRAPH}
SELECT r.kb_id, source_id, r.type, target_id, b.name AS target_name, b.type AS target_type
FROM related r JOIN entities a ON a.kb_id = r.kb_id AND a.id = source_id JOIN entities b ON b.kb_id = r.kb_id AND b.id = target_id"""
)
def edges_bulk(t: Tables) -> DataFrame:
    return graph_read.edges(t.related(), t.entities()).select(
        "kb_id", "source_id", "type", "target_id", "target_name", "target_type"
    )


@query(
    f"""WITH {_GRAPH}
SELECT e.kb_id, entity_id, m.job_id, coalesce(label, '') AS label, coalesce(strftime(published_at, '%Y-%m-%d'), '') AS published_at
FROM mentions m JOIN entities e ON m.kb_id = e.kb_id AND m.entity_id = e.id JOIN sources s ON s.kb_id = m.kb_id AND s.job_id = m.job_id"""
)
def references(t: Tables) -> DataFrame:
    found = graph_read.references(t.mentions(), t.sources(), t.entities())
    return found.select("kb_id", "entity_id", "job_id", "label", _date("published_at"))


def _requests(t: Tables) -> DataFrame:
    """Pages are asked for one at a time; the query set is every supplier whose number divides by 20."""
    number = F.element_at(F.split("id", "/"), -1).cast("bigint")
    return t.entities().where((F.col("type") == "Supplier") & (number % 20 == 0)).select("kb_id", "id")


_ASKED = "type = 'Supplier' AND split_part(id, '/', 3)::BIGINT % 20 = 0"


_TWO_HOPS = f"""
pairs AS (SELECT kb_id, source_id AS id, target_id AS other FROM related UNION SELECT kb_id, target_id, source_id FROM related),
two_hops AS (
  SELECT DISTINCT a.kb_id, a.id, b.other AS related_id
  FROM pairs a JOIN pairs b ON a.kb_id = b.kb_id AND a.other = b.id AND a.id <> b.other
  JOIN (SELECT kb_id, id FROM entities WHERE {_ASKED}) e ON e.kb_id = a.kb_id AND e.id = a.id),
near AS (
  SELECT h.kb_id, h.id, related_id, e.name AS related_name, e.type AS related_type
  FROM two_hops h JOIN entities e ON e.kb_id = h.kb_id AND e.id = related_id
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.id = h.id AND p.other = related_id))"""


@query(f"WITH {_GRAPH}, {_TWO_HOPS} SELECT kb_id, id, related_id, related_name FROM near")
def related_two_hop(t: Tables) -> DataFrame:
    """Suppliers two hops from each requested one: those sharing a part with it."""
    return graph_read.related_nodes(_requests(t), t.related(), t.entities()).select("kb_id", "id", "related_id", "related_name")


@query(
    f"""WITH {_GRAPH},
recent AS (
  SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY ingested_at DESC NULLS FIRST, job_id) AS rank FROM sources QUALIFY rank <= 500)
SELECT r.kb_id, r.rank, r.job_id, label, coalesce(strftime(ingested_at, '%Y-%m-%d'), '') AS ingested_at,
  coalesce(entity_id, '') AS entity_id, coalesce(e.name, '') AS entity_name
FROM recent r LEFT JOIN (mentions m JOIN entities e ON e.kb_id = m.kb_id AND e.id = m.entity_id) ON r.kb_id = m.kb_id AND r.job_id = m.job_id"""
)
def sources_since(t: Tables) -> DataFrame:
    recent = graph_read.recent_sources(t.sources())
    found = graph_read.sources_with_entities(recent, t.mentions(), t.entities())
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("entity_id", "entity_name")]
    return found.select("kb_id", F.col("rank").cast("bigint").alias("rank"), "job_id", "label", _date("ingested_at"), *text)


@query(
    f"""WITH {_GRAPH},
named AS (
  SELECT s.kb_id, s.job_id, coalesce(string_agg(entity_id, ',' ORDER BY entity_id), '') AS entities, count(entity_id) AS n
  FROM sources s LEFT JOIN mentions m ON s.kb_id = m.kb_id AND s.job_id = m.job_id GROUP BY 1, 2)
SELECT kb_id, job_id, entities, n FROM named WHERE n > 0"""
)
def nested_sources(t: Tables) -> DataFrame:
    """The nested form: each source with the ordered list of its entities."""
    named = t.sources().join(t.mentions(), ["kb_id", "job_id"])
    nested = graph_read.nest(named, ["kb_id", "job_id"], ["entity_id"], ["entity_id"])
    return nested.select("kb_id", "job_id", F.array_join("items.entity_id", ",").alias("entities"), "n")


@query(
    f"""WITH {_GRAPH}, {_TWO_HOPS},
asked AS (SELECT * FROM entities WHERE {_ASKED})
SELECT kb_id, id, 'body' AS section, type AS grouping, name AS item_id, coalesce(nullif(article, ''), nullif(summary, ''), '') AS text FROM asked
UNION ALL
SELECT r.kb_id, source_id, 'edge', r.type, target_id, b.name
FROM related r JOIN asked a ON a.kb_id = r.kb_id AND a.id = source_id JOIN entities b ON b.kb_id = r.kb_id AND b.id = target_id
UNION ALL SELECT kb_id, id, 'related', related_type, related_id, related_name FROM near
UNION ALL
SELECT m.kb_id, entity_id, 'reference', '', m.job_id::VARCHAR, concat(coalesce(strftime(published_at, '%Y-%m-%d'), ''), '|', label)
FROM mentions m JOIN asked a ON m.kb_id = a.kb_id AND entity_id = a.id JOIN sources s ON s.kb_id = m.kb_id AND s.job_id = m.job_id"""
)
def entity_page(t: Tables) -> DataFrame:
    return graph_read.entity_page(_requests(t), t.entities(), t.related(), t.mentions(), t.sources())


@query(
    f"""WITH {_GRAPH},
supplied AS (SELECT kb_id, target_id AS source_id, type, source_id AS target_id FROM related),
listed AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY id) AS r FROM entities QUALIFY r <= 200),
links AS (
  SELECT x.kb_id, x.source_id, x.type, x.target_id, b.name, b.type AS target_type
  FROM supplied x JOIN listed a ON a.kb_id = x.kb_id AND a.id = source_id JOIN entities b ON b.kb_id = x.kb_id AND b.id = target_id)
SELECT kb_id, 'link' AS kind, source_id AS id, target_id, type, '' AS name FROM links
UNION ALL
SELECT DISTINCT kb_id, 'node', id, '', type, name FROM (
  SELECT kb_id, id, type, name FROM listed UNION SELECT kb_id, target_id, target_type, name FROM links)"""
)
def graph_view(t: Tables) -> DataFrame:
    """Edges point from part to supplier here, so that the first nodes have some."""
    supplied = t.related().select("kb_id", F.col("target_id").alias("source_id"), "type", F.col("source_id").alias("target_id"))
    return graph_read.graph_view(t.entities(), supplied)


@query(
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS since FROM events"""
)
def since_arguments(t: Tables) -> DataFrame:
    """Every event's time as a ``since`` argument; an empty one is no filter."""
    given = F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    parsed = graph_read.since_or_error(given)
    return t.raw("events").select("event_id", F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("since"))


# --- writes -----------------------------------------------------------------------

RUN = "2024-06-01"


def _stamp() -> F.Column:
    return F.lit(RUN).cast("timestamp_ntz")


def _stored_entities(t: Tables) -> DataFrame:
    return t.entities().withColumns({"name_normalized": F.lower("name"), "aliases": F.array(F.lower("name"))})


def _entity_batch(t: Tables) -> DataFrame:
    """Every line mentions its part under a name made from the ordering job; returned lines name
    a part nobody stored before."""
    fresh = F.when(F.col("l_returnflag") == "R", "/new").otherwise("")
    return t._lines().select(
        "kb_id",
        F.concat(t.part_id(), fresh).alias("entity_id"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("batch_pos"),
        F.lit("Part").alias("type"),
        F.concat(F.lit("Part  "), "l_partkey", F.lit(" of Job "), "o_orderkey").alias("name"),
        F.concat(F.lit("seen in "), "o_orderkey").alias("summary"),
        F.lit("article").alias("article"),
        F.array(F.concat(F.lit(" Alias "), F.col("l_linenumber").cast("string"))).alias("aliases"),
    )


@query(
    f"""WITH {_GRAPH},
batch AS (
  SELECT kb_id, concat(kb_id, '/P/', l_partkey, CASE l_returnflag WHEN 'R' THEN '/new' ELSE '' END) AS id,
    arg_max(concat('Part  ', l_partkey, ' of Job ', o_orderkey), o_orderkey * 10 + l_linenumber) AS name,
    arg_max(concat('seen in ', o_orderkey), o_orderkey * 10 + l_linenumber) AS summary,
    arg_max(concat('alias ', l_linenumber), o_orderkey * 10 + l_linenumber) AS alias
  FROM lineitem JOIN orders_kb ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT coalesce(e.kb_id, b.kb_id) AS kb_id, id, coalesce(e.type, 'Part') AS type, coalesce(b.name, e.name) AS name,
  lower(regexp_replace(coalesce(b.name, e.name), ' +', ' ', 'g')) AS name_normalized, coalesce(b.summary, e.summary, '') AS summary,
  CASE WHEN b.id IS NULL THEN coalesce(e.article, '') ELSE 'article' END AS article,
  coalesce(b.alias, lower(e.name)) AS aliases,
  strftime(coalesce(e.created_at, TIMESTAMP '{RUN}'), '%Y-%m-%d') AS created_at,
  strftime(CASE WHEN b.id IS NULL THEN e.updated_at ELSE TIMESTAMP '{RUN}' END, '%Y-%m-%d') AS updated_at
FROM entities e FULL JOIN batch b USING (id)"""
)
def entity_upsert(t: Tables) -> DataFrame:
    after = graph_write.upsert_entities(_stored_entities(t), _entity_batch(t), _stamp())
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("summary", "article")]
    return after.select(
        "kb_id", "id", "type", "name", "name_normalized", *text, F.array_join("aliases", ",").alias("aliases"),
        _date("created_at"), _date("updated_at"),
    )


@query(
    f"""WITH {_GRAPH},
stored AS (SELECT * FROM related WHERE type = 'Supplies'),
batch AS (
  SELECT kb_id, concat(kb_id, '/S/', l_suppkey) AS source_id,
    CASE WHEN l_linenumber = 7 THEN concat('other/P/', l_partkey) ELSE concat(kb_id, '/P/', l_partkey) END AS target_id,
    CASE l_returnflag WHEN 'R' THEN 'Took back' ELSE 'Supplies' END AS type, o_orderkey AS job_id, o_orderkey * 10 + l_linenumber AS batch_pos
  FROM lineitem JOIN orders_kb ON l_orderkey = o_orderkey),
fresh AS (
  SELECT b.kb_id, source_id, target_id, b.type, arg_min(job_id, batch_pos) AS source_job_id
  FROM batch b JOIN entities s ON s.kb_id = b.kb_id AND s.id = source_id JOIN entities d ON d.kb_id = b.kb_id AND d.id = target_id
  GROUP BY 1, 2, 3, 4)
SELECT kb_id, source_id, target_id, type, source_job_id, '1999-01-01' AS created_at FROM stored
UNION ALL
SELECT kb_id, source_id, target_id, type, source_job_id, '{RUN}' FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.kb_id = f.kb_id AND s.source_id = f.source_id AND s.target_id = f.target_id AND s.type = f.type)"""
)
def relationship_upsert(t: Tables) -> DataFrame:
    """The returns of all lines are written over a graph that knows supplies only."""
    stored = t.related().where("type = 'Supplies'").withColumn("created_at", F.lit("1999-01-01").cast("timestamp_ntz"))
    astray = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("other/P/"), "l_partkey")).otherwise(t.part_id())
    batch = t._lines().select(
        "kb_id",
        t.supplier_id().alias("source_id"),
        astray.alias("target_id"),
        F.when(F.col("l_returnflag") == "R", "Took back").otherwise("Supplies").alias("type"),
        F.col("o_orderkey").alias("job_id"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("batch_pos"),
    )
    after = graph_write.upsert_relationships(stored, batch, t.entities(), _stamp())
    return after.select("kb_id", "source_id", "target_id", "type", "source_job_id", _date("created_at"))


def _source_batch(t: Tables) -> DataFrame:
    urgent = t.sources().where("label = '1-URGENT'")
    unreadable = F.when(F.col("job_id") % 3 == 0, "soon").otherwise(F.date_format("published_at", "yyyy-MM-dd"))
    return urgent.select(
        "kb_id",
        "job_id",
        F.lit(0).alias("batch_pos"),
        F.lit("updated").alias("label"),
        F.coalesce(unreadable, F.lit("")).alias("published_at"),
        F.lit("2024-05-31T10:00:00+02:00").alias("ingested_at"),
    )


@query(
    f"""WITH {_GRAPH}
SELECT kb_id, job_id, CASE label WHEN '1-URGENT' THEN 'updated' ELSE label END AS label,
  CASE WHEN label = '1-URGENT' AND job_id % 3 = 0 THEN '' ELSE coalesce(strftime(published_at, '%Y-%m-%d'), '') END AS published_at,
  CASE label WHEN '1-URGENT' THEN '2024-05-31 08:00' ELSE coalesce(strftime(ingested_at, '%Y-%m-%d %H:%M'), '') END AS ingested_at
FROM sources"""
)
def provenance_upsert(t: Tables) -> DataFrame:
    after = graph_write.upsert_sources(t.sources(), _source_batch(t))
    return after.select("kb_id", "job_id", "label", _date("published_at"), _date("ingested_at", "yyyy-MM-dd HH:mm"))


@query(
    f"""WITH {_GRAPH}
SELECT kb_id, entity_id, job_id FROM mentions
UNION
SELECT o.kb_id, concat(o.kb_id, '/S/', l_suppkey), o_orderkey
FROM lineitem JOIN orders_kb o ON l_orderkey = o_orderkey
JOIN entities e ON e.kb_id = o.kb_id AND e.id = concat(o.kb_id, '/S/', l_suppkey)"""
)
def mention_upsert(t: Tables) -> DataFrame:
    batch = t._lines().select("kb_id", t.supplier_id().alias("entity_id"), F.col("o_orderkey").alias("job_id"))
    return graph_write.upsert_mentions(t.mentions(), batch, t.entities())


def _leaving(t: Tables) -> DataFrame:
    """Tenants whose customers owe more than they hold."""
    balance = t.raw("customer").groupBy(F.col("c_mktsegment").alias("kb_id")).agg(F.sum("c_acctbal").alias("b"), F.avg("c_acctbal").alias("a"))
    overall = t.raw("customer").agg(F.avg("c_acctbal")).first()[0]
    return balance.where(F.col("a") < overall).select("kb_id")


_LEAVING = """
leaving AS (
  SELECT c_mktsegment AS kb_id FROM customer GROUP BY 1 HAVING avg(c_acctbal) < (SELECT avg(c_acctbal) FROM customer))"""


@query(
    f"""WITH {_GRAPH}, {_LEAVING}
SELECT kb_id, (SELECT count(*) FROM entities e WHERE e.kb_id = l.kb_id) + (SELECT count(*) FROM sources s WHERE s.kb_id = l.kb_id) AS deleted
FROM leaving l"""
)
def purge_counts(t: Tables) -> DataFrame:
    return graph_write.purge_counts(_leaving(t), t.entities(), t.sources())


@query(
    f"""WITH {_GRAPH}, {_LEAVING}
SELECT 'entity' AS kind, kb_id, id FROM entities WHERE kb_id NOT IN (SELECT kb_id FROM leaving)
UNION ALL SELECT 'source', kb_id, job_id::VARCHAR FROM sources WHERE kb_id NOT IN (SELECT kb_id FROM leaving)"""
)
def tenant_purge(t: Tables) -> DataFrame:
    leaving = _leaving(t)
    entities = graph_write.purge_tenants(t.entities(), leaving).select(F.lit("entity").alias("kind"), "kb_id", "id")
    sources = graph_write.purge_tenants(t.sources(), leaving)
    return entities.unionByName(sources.select(F.lit("source").alias("kind"), "kb_id", F.col("job_id").cast("string").alias("id")))


@query(
    """SELECT o_orderkey AS request_id,
  CASE WHEN c.c_custkey IS NULL THEN 'not_found'
       WHEN o_orderpriority = '5-LOW' THEN 'name_mismatch'
       WHEN (SELECT count(*) FROM supplier s WHERE s.s_nationkey = c.c_nationkey) <= 1 THEN 'last_tenant' ELSE 'ok' END AS outcome
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey"""
)
def tenant_deletions(t: Tables) -> DataFrame:
    """Deletion requests: tenant = customer with a balance, user = nation, membership = supplier."""
    nations = t.raw("customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_nationkey").alias("user_id"))
    tenants = t.raw("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("name"))
    members = t.raw("supplier").select(F.col("s_nationkey").alias("user_id"))
    asked = t.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("kb_id"), "o_orderpriority")
    names = t.raw("customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("typed"))
    requests = (
        asked.join(nations, "kb_id")
        .join(names, "kb_id")
        .withColumn("confirm_name", F.when(F.col("o_orderpriority") == "5-LOW", "?").otherwise(F.col("typed")))
    )
    return graph_write.deletable_tenants(requests, tenants, members).select("request_id", "outcome")


@query(
    f"""WITH {_GRAPH}
SELECT kb_id, id,
  coalesce(article, summary, '') AS article,
  coalesce(CASE WHEN article IS NULL THEN substring(regexp_extract(trim(summary), '^(?s:(.*?[.!?])\\s|(.*)$)', 0), 1, 240) ELSE summary END, '') AS summary
FROM entities"""
)
def article_backfill(t: Tables) -> DataFrame:
    after = graph_write.backfill_articles(t.entities())
    return after.select("kb_id", "id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("article", "summary")))


@query(
    f"""WITH {SOURCES}
SELECT kb_id, s.job_id,
  CASE WHEN s.job_id % 5 = 0 THEN coalesce(json_extract_string(CASE WHEN doc_id % 7 = 0 THEN '{{}}' ELSE concat('{{"source":"', source, '"}}') END, '$.source'), '') ELSE label END AS label,
  CASE WHEN s.job_id % 5 = 0 THEN coalesce(strftime(to_timestamp(doc_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), '') ELSE '' END AS date
FROM sources s LEFT JOIN documents d ON d.doc_id = s.job_id"""
)
def label_backfill(t: Tables) -> DataFrame:
    sources = t.sources().withColumn("label", F.when(F.col("job_id") % 5 != 0, F.col("label")))
    jobs = t.jobs().withColumn("created_at", F.timestamp_seconds("created_s"))
    return graph_write.backfill_labels(sources, jobs).select("kb_id", "job_id", "label", F.coalesce("date", F.lit("")).alias("date"))
