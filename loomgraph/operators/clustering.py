"""Stories: sources that share an entity, directly or through others, belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators.skew import top_per_key
from loomgraph.schemas import CLUSTER_MAX_SOURCES


def source_links(mentions: DataFrame) -> DataFrame:
    """Edges ``kb_id, a, b`` from every source of an entity to the entity's smallest source.

    An entity named by ``n`` sources gives ``n - 1`` edges, never ``n * n``; its minimum
    comes from a map-side aggregate, and AQE splits the partition of a hub when it is joined back."""
    return _to_least(mentions).distinct()


def nearest_links(mentions: DataFrame) -> DataFrame:
    """Of ``source_links`` one for each source ``a``, that to its smallest ``b``: at most as many as there are sources, and
    as each leads to a smaller one, a forest."""
    return _to_least(mentions).groupBy("kb_id", "a").agg(F.min("b").alias("b"))


def _to_least(mentions: DataFrame) -> DataFrame:
    keys = ["kb_id", "entity_id"]
    mentions = mentions.select(*keys, "job_id")
    least = mentions.groupBy(*keys).agg(F.min("job_id").alias("b"), F.max("job_id").alias("most")).where("most > b").drop("most")
    linked = mentions.join(least, keys)
    return linked.where("job_id > b").select("kb_id", F.col("job_id").alias("a"), "b")


def _distinct(edges: DataFrame, previous: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Write the distinct edges, count them and those that moved, and drop the table they came from."""
    unique = edges.groupBy("kb_id", "a", "b").agg(F.bool_or("moved").alias("moved"))
    table, counted = durable.cut_counted(unique, moved=F.col("moved"))
    durable.drop(previous)
    return table.drop("moved"), counted


def connected_components(links: DataFrame, forest: bool = False) -> DataFrame:
    """``kb_id, job_id, cluster_id`` for every source that has a link; the cluster is
    named by its smallest source. ``forest`` says that no two links have the same ``a``.

    Alternates two star contractions (Kiveris et al., "Connected Components in
    MapReduce and Beyond", SoCC 2014): first every node hands its smallest parent to
    the nodes pointing at it, then every node points its other parents at the smallest
    one. The rows stay one per link, and the rounds grow with the logarithm of the
    longest chain. Each half round is one written table. Once every node has one parent the
    first half alone goes on: it doubles the steps to the root."""
    edges, counted = durable.cut_counted(links)
    while counted["n"]:
        parent = edges.groupBy("kb_id", F.col("a").alias("b")).agg(F.min("b").alias("m"))
        lifted = edges.join(parent, ["kb_id", "b"], "left").select(
            "kb_id", "a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")
        )
        edges, counted = _distinct(lifted, edges)
        lifted_any = counted["moved"]
        if forest:
            if lifted_any:
                continue
            break
        least = edges.groupBy("kb_id", "a").agg(F.min("b").alias("m"))
        pair = F.struct(F.col("a"), F.col("m").alias("b"), F.lit(False).alias("moved"))
        other = F.struct(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        pulled = edges.join(least, ["kb_id", "a"]).select(
            "kb_id", F.inline(F.when(F.col("b") == F.col("m"), F.array(pair)).otherwise(F.array(pair, other)))
        )
        edges, counted = _distinct(pulled, edges)
        forest = not counted["moved"]
        if forest and not lifted_any:
            break
    children = edges.select("kb_id", F.col("a").alias("job_id"), F.col("b").alias("cluster_id"))
    roots = edges.select("kb_id", F.col("b").alias("job_id"), F.col("b").alias("cluster_id")).distinct()
    return children.unionByName(roots)


def assign_clusters(sources: DataFrame, mentions: DataFrame) -> DataFrame:
    """``sources`` with ``cluster_id``; a source sharing no entity is its own cluster.

    The rounds run over one link of each source first. Entities are then named by the clusters found so far, and only
    those still named by several give further links, between whole clusters."""
    keys = ["kb_id", "job_id"]
    inside = durable.cut(mentions.select("kb_id", "entity_id", "job_id").join(sources.select(*keys), keys, "left_semi"))
    near = durable.cut(connected_components(nearest_links(inside), forest=True))
    near = near.select(*keys, F.col("cluster_id").alias("_near"))
    named = inside.join(near, keys, "left").select("kb_id", "entity_id", F.coalesce("_near", "job_id").alias("job_id"))
    named = durable.cut(named.distinct())
    durable.drop(inside)
    far = connected_components(source_links(named)).select("kb_id", F.col("job_id").alias("_near"), F.col("cluster_id").alias("_far"))
    durable.drop(named)
    labelled = sources.join(near, keys, "left").withColumn("_near", F.coalesce("_near", "job_id"))
    return labelled.join(far, ["kb_id", "_near"], "left").select(*sources.columns, F.coalesce("_far", "_near").alias("cluster_id"))


def recency() -> F.Column:
    """What ranks a source: when it was ingested, else when it was published."""
    return F.coalesce("ingested_at", "published_at")


def newest_sources(assigned: DataFrame, max_sources: int = CLUSTER_MAX_SOURCES) -> DataFrame:
    """The newest ``max_sources`` of each cluster with their ``rank``; ties go to the
    smaller source id."""
    order = [recency().desc_nulls_last(), F.col("job_id")]
    return top_per_key(assigned, ["kb_id", "cluster_id"], order, max_sources)


def cluster_sizes(kept: DataFrame) -> DataFrame:
    """``size, newest, lead_id`` of each cluster over its kept sources; ordering clusters by
    (size, newest) descending, then ``lead_id``, puts the biggest and freshest story first."""
    return kept.groupBy("kb_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.max(recency()).alias("newest"),
        F.min_by("job_id", "rank").alias("lead_id"),
    )


def story_clusters(sources: DataFrame, mentions: DataFrame, max_sources: int = CLUSTER_MAX_SOURCES) -> DataFrame:
    """One row per kept source: its cluster, the cluster's size and newest date, its rank."""
    kept = newest_sources(assign_clusters(sources, mentions), max_sources)
    return kept.join(cluster_sizes(kept), ["kb_id", "cluster_id"])


def cluster_entities(kept: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct entities of each cluster's kept sources with the first place they appear
    (``first_rank`` of the source, then entity id)."""
    return (
        kept.select("kb_id", "cluster_id", "job_id", "rank")
        .join(mentions, ["kb_id", "job_id"])
        .groupBy("kb_id", "cluster_id", "entity_id")
        .agg(F.min("rank").alias("first_rank"))
    )
