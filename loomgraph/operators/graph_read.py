"""Tenant-scoped reads of the graph. Every join key starts with ``kb_id``.

Reads come in bulk form: a table of requests instead of one call per node. Results are
flat rows with ordering columns; they are never folded into one row per hub entity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions.dates import parse_iso
from loomgraph.functions.text import or_else
from loomgraph.operators.search import search, search_newest
from loomgraph.operators.skew import gathered, lookup, top_per_large_key
from loomgraph.schemas import GRAPH_VIEW_LIMIT, READ_LIMIT_DEFAULT, READ_LIMIT_MAX

UNLIMITED = 2**31 - 1
NODE = ["id", "type", "name", "summary", "article", "created_at", "updated_at"]


def page_size(limit: int | None) -> int:
    """Rows of one page. ``None`` asks for everything; more than the API's maximum is an error, never a silent cut."""
    if limit is None:
        return UNLIMITED
    if limit > READ_LIMIT_MAX:
        raise ValueError(f"limit {limit} is above {READ_LIMIT_MAX}; None reads everything")
    return max(limit, 1)


def at_least(df: DataFrame, column: str, since: datetime) -> Column:
    """``column >= since`` compared in the column's own type, so that the scan can use it."""
    return F.col(column) >= F.lit(since).cast(df.schema[column].dataType)


def since_or_error(c: Column) -> Column:
    """A ``since`` argument column: empty means no filter, anything unparseable is an error."""
    parsed = parse_iso(c)
    wrong = (F.coalesce(c, F.lit("")) != "") & parsed.isNull()
    return F.when(
        wrong, F.raise_error(F.concat(F.lit("invalid `since` timestamp: "), c)).cast("timestamp")
    ).otherwise(parsed)


def nodes(
    entities: DataFrame,
    kb_id: str | None = None,
    type_: str | None = None,
    since: datetime | None = None,
    limit: int | None = READ_LIMIT_DEFAULT,
) -> DataFrame:
    """Entities of one tenant, or of each tenant; with ``since`` the newest first, otherwise by id."""
    found = entities if kb_id is None else entities.where(F.col("kb_id") == kb_id)
    if type_:
        found = found.where(F.col("type") == type_)
    order = [F.col("id")]
    if since is not None:
        found = found.where(at_least(found, "updated_at", since))
        order = [F.col("updated_at").desc(), F.col("id")]
    if kb_id is not None:
        ordered = found.orderBy(*order)
        return ordered if limit is None else ordered.limit(page_size(limit))
    return top_per_large_key(found, ["kb_id"], order, page_size(limit))


def nodes_search(
    entities: DataFrame, searches: DataFrame, since: datetime | None = None, limit: int | None = READ_LIMIT_DEFAULT
) -> DataFrame:
    """Entities matching each search (``kb_id, text``): best score first, or with ``since`` newest first."""
    if since is None:
        return search(searches, entities, ["kb_id"], page_size(limit))
    recent = entities.where(at_least(entities, "updated_at", since))
    return search_newest(searches, recent, ["kb_id"], page_size(limit))


def node_lookup(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """The requested node, or nulls for an unknown id or another tenant's node."""
    found = lookup(requests, entities.withColumn("found", F.lit(True)), ["kb_id", "id"])
    return found.withColumn("found", F.coalesce("found", F.lit(False)))


def edges(related: DataFrame, entities: DataFrame, requests: DataFrame | None = None, type_: str | None = None) -> DataFrame:
    """Outgoing edges with their target node. Edge, source and target must share the tenant."""
    links = related.select("kb_id", "source_id", "target_id", "type")
    if type_:
        links = links.where(F.col("type") == type_)
    asked = entities if requests is None else requests.join(entities, ["kb_id", "id"], "left_semi")
    links = links.join(asked.select("kb_id", F.col("id").alias("source_id")), ["kb_id", "source_id"], "left_semi")
    target = entities.select(
        "kb_id",
        F.col("id").alias("target_id"),
        F.col("type").alias("target_type"),
        F.col("name").alias("target_name"),
        F.col("summary").alias("target_summary"),
    )
    return links.join(target, ["kb_id", "target_id"])


def references(mentions: DataFrame, sources: DataFrame, entities: DataFrame) -> DataFrame:
    """Sources naming each entity of ``entities``; sort by ``published_at`` with nulls last."""
    known = mentions.join(entities.select("kb_id", F.col("id").alias("entity_id")), ["kb_id", "entity_id"], "left_semi")
    return known.join(sources.select("kb_id", "job_id", "label", "published_at"), ["kb_id", "job_id"]).withColumn(
        "label", F.coalesce("label", F.lit(""))
    )


def both_ways(related: DataFrame) -> DataFrame:
    """Edges as undirected pairs ``kb_id, id, other``, each from both of its ends."""
    pairs = F.explode(
        F.array(
            F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")),
            F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")),
        )
    )
    return related.select("kb_id", pairs.alias("p")).select("kb_id", "p.id", "p.other")


def neighbours(related: DataFrame) -> DataFrame:
    """Distinct undirected neighbour pairs ``kb_id, id, other``."""
    return both_ways(related).distinct()


def related_nodes(requests: DataFrame, related: DataFrame, entities: DataFrame) -> DataFrame:
    """For each requested id, the entities exactly two undirected hops away.

    Only paths that start at a requested id are walked, so the output grows with the requests. The first hop is written
    down: Spark then knows its size, and the hop from few middles is a broadcast join that shuffles none of ``related``;
    many middles are joined by sort and merge, where AQE splits a hub. Direct
    neighbours are left out even where the direct edge carries another tenant's id."""
    asked = requests.select("kb_id", "id").distinct().join(entities.select("kb_id", "id"), ["kb_id", "id"], "left_semi")
    asked = durable.cut(asked)
    pairs = both_ways(related)
    first = durable.cut(pairs.join(asked, ["kb_id", "id"]).select("kb_id", "id", F.col("other").alias("middle")).distinct())
    second = pairs.select("kb_id", F.col("id").alias("middle"), F.col("other").alias("related_id"))
    two_hops = second.join(first, ["kb_id", "middle"]).where("id <> related_id").select("kb_id", "id", "related_id").distinct()
    ids = asked.select("id").distinct()
    near = related.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(
        related.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    )
    direct = neighbours(near.withColumn("kb_id", F.lit(""))).select("id", F.col("other").alias("related_id"))
    target = entities.select(
        "kb_id",
        F.col("id").alias("related_id"),
        F.col("type").alias("related_type"),
        F.col("name").alias("related_name"),
        F.col("summary").alias("related_summary"),
    )
    return two_hops.join(direct, ["id", "related_id"], "left_anti").join(target, ["kb_id", "related_id"])


def recent_sources(sources: DataFrame, since: datetime | None = None, limit: int | None = READ_LIMIT_MAX) -> DataFrame:
    """Each tenant's newest sources with their ``rank``; a source without ingest date comes
    first, unless ``since`` rules it out."""
    if since is not None:
        sources = sources.where(at_least(sources, "ingested_at", since))
    return top_per_large_key(sources, ["kb_id"], [F.col("ingested_at").desc_nulls_first(), F.col("job_id")], page_size(limit))


def sources_with_entities(recent: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per source and entity it names; a source without entities keeps one row."""
    node = entities.select(
        "kb_id", F.col("id").alias("entity_id"), F.col("type").alias("entity_type"), F.col("name").alias("entity_name"), "summary", "article"
    )
    named = mentions.join(recent.select("kb_id", "job_id"), ["kb_id", "job_id"], "left_semi").join(node, ["kb_id", "entity_id"])
    return recent.join(named, ["kb_id", "job_id"], "left")


def nest(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The API's nested shape: ``keys``, an ordered array of structs, and its length. A source's
    entities come out of one text, which bounds them; the flat rows are there for all else."""
    return gathered(rows, keys, order, F.struct(*fields))


def entity_page(
    requests: DataFrame, entities: DataFrame, related: DataFrame, mentions: DataFrame, sources: DataFrame
) -> DataFrame:
    """Everything on the pages of the requested entities, one row per item.

    ``section`` is body, edge, related or reference; ``grouping`` the type heading an item
    stands under; ``item_id`` and ``text`` what it shows."""
    asked = entities.join(requests.select("kb_id", "id").distinct(), ["kb_id", "id"], "left_semi")

    def section(rows: DataFrame, name: str, owner: str, grouping: str | None, item: Column, text: Column) -> DataFrame:
        heading = F.lit("") if grouping is None else F.col(grouping)
        return rows.select(
            "kb_id", F.col(owner).alias("id"), F.lit(name).alias("section"), heading.alias("grouping"),
            item.cast("string").alias("item_id"), F.coalesce(text, F.lit("")).alias("text"),
        )

    body = section(asked, "body", "id", "type", F.col("name"), or_else(F.col("article"), F.col("summary")))
    out = section(edges(related, entities, requests), "edge", "source_id", "type", F.col("target_id"), F.col("target_name"))
    near = section(
        related_nodes(requests, related, entities), "related", "id", "related_type", F.col("related_id"), F.col("related_name")
    )
    date = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit(""))
    cited = section(
        references(mentions, sources, asked), "reference", "entity_id", None, F.col("job_id"), F.concat_ws("|", date, "label")
    )
    return body.unionByName(out).unionByName(near).unionByName(cited)


def graph_view(entities: DataFrame, related: DataFrame, limit: int = GRAPH_VIEW_LIMIT) -> DataFrame:
    """What the graph picture of each tenant shows: its first nodes, the targets of their
    edges, and the edges as links."""
    listed = nodes(entities, limit=limit).select("kb_id", "id", "name", "type")
    links = edges(related, entities, listed)
    targets = links.select("kb_id", F.col("target_id").alias("id"), F.col("target_name").alias("name"), F.col("target_type").alias("type"))
    # A listed node's own record wins over the copy seen through an edge.
    shown = (
        listed.withColumn("p", F.lit(0))
        .unionByName(targets.withColumn("p", F.lit(1)))
        .groupBy("kb_id", "id")
        .agg(F.min(F.struct("p", "name", "type")).alias("v"))
        .select("kb_id", F.lit("node").alias("kind"), "id", F.lit("").alias("target_id"), F.col("v.type").alias("type"), F.col("v.name").alias("name"))
    )
    drawn = links.select(
        "kb_id", F.lit("link").alias("kind"), F.col("source_id").alias("id"), "target_id", "type", F.lit("").alias("name")
    )
    return shown.unionByName(drawn)
