"""Upserts of the graph tables, as joins that yield the next snapshot.

Parquet tables take no MERGE. Each ``*_changes`` gives the rows that a batch adds or replaces, each ``upsert_*`` the
whole state after it. Batches are reduced to one row per key and written down before they meet
the state: Spark then knows their size, and a small batch is broadcast instead of
shuffling the state. Only the rows of touched keys take part in a full join, and of a table stored
in buckets of its keys only the touched buckets are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions.dates import parse_iso
from loomgraph.functions.text import first_sentence, normalize_name

ENTITY_COLUMNS = [
    "kb_id", "id", "type", "name", "name_normalized", "summary", "article", "aliases", "created_at", "updated_at"
]
EDGE_KEY = ["kb_id", "source_id", "target_id", "type"]
SOURCE_KEY = ["kb_id", "job_id"]
MENTION_KEY = ["kb_id", "entity_id", "job_id"]


def last_per_entity(batch: DataFrame) -> DataFrame:
    """One row per entity of a batch: its type from the first mention, everything else from the last.

    ``batch`` has ``kb_id, entity_id, batch_pos, type, name, summary, article, aliases``."""
    latest = F.struct("name", "summary", "article", "aliases")
    return (
        batch.groupBy("kb_id", "entity_id")
        .agg(F.max_by(latest, "batch_pos").alias("v"), F.min_by("type", "batch_pos").alias("type"))
        .select("kb_id", F.col("entity_id").alias("id"), "type", "v.*")
    )


# The partition column of a stored table: the place of a row's key among the buckets, and how many there are.
BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int").alias(BUCKET)


def touched_buckets(new: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets that the keys of ``new`` fall in: as many numbers as there are buckets, at most."""
    return sorted(r[0] for r in new.select(bucket_of(keys, buckets)).distinct().collect())


def _near(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` without the buckets that hold none of the keys of ``new``; all of a table that has no buckets."""
    buckets = state.__dict__.get("_buckets")
    if not buckets:
        return state
    return state.where(F.col(BUCKET).isin(touched_buckets(new, keys, buckets)))


def _stored(state: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns of the rows of ``state`` whose keys ``new`` has."""
    return _near(state, new, keys).select(*columns).join(new.select(*keys), keys, "left_semi")


def replaced(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` with the rows of ``changes`` added, and those of the same keys taken out."""
    return state.select(*changes.columns).join(changes.select(*keys), keys, "left_anti").select(*changes.columns).unionByName(changes)


def _present(rows: DataFrame, entities: DataFrame, end: str) -> DataFrame:
    """The rows whose ``end`` is an entity of the tenant; the entities are cut down to those asked for first."""
    asked = rows.select("kb_id", F.col(end).alias("id")).distinct()
    known = entities.select("kb_id", "id").join(asked, ["kb_id", "id"], "left_semi").withColumnRenamed("id", end)
    return rows.join(known, ["kb_id", end], "left_semi")


def _new_entities(batch: DataFrame) -> DataFrame:
    new = last_per_entity(batch).select(
        F.col("id"),
        F.struct(
            "kb_id",
            "type",
            "name",
            normalize_name(F.col("name")).alias("name_normalized"),
            "summary",
            "article",
            F.transform(F.coalesce("aliases", F.array()), normalize_name).alias("aliases"),
        ).alias("new"),
    )
    return durable.packed(new)


def _entity_changes(entities: DataFrame, new: DataFrame, run_ts: Column) -> DataFrame:
    touched = _stored(entities, new, ["id"], ENTITY_COLUMNS)
    joined = touched.withColumn("_stored", F.lit(True)).join(new, "id", "full_outer")
    is_new, changed = F.col("_stored").isNull(), F.col("new").isNotNull()

    def once(name: str) -> Column:
        return F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(name)).alias(name)

    def always(name: str) -> Column:
        return F.when(changed, F.col(f"new.{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(
        once("kb_id"),
        "id",
        once("type"),
        *(always(n) for n in ("name", "name_normalized", "summary", "article", "aliases")),
        F.when(is_new, run_ts).otherwise(F.col("created_at")).alias("created_at"),
        F.when(changed, run_ts).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def entity_changes(entities: DataFrame, batch: DataFrame, run_ts: Column) -> DataFrame:
    """The entities that a batch adds or changes, as they are after it: tenant, type and creation time are set once;
    name, summary, article and aliases (overwritten, not united) follow the latest mention."""
    return _entity_changes(entities, _new_entities(batch), run_ts)


def upsert_entities(entities: DataFrame, batch: DataFrame, run_ts: Column) -> DataFrame:
    """Entities after a batch."""
    new = _new_entities(batch)
    others = entities.select(*ENTITY_COLUMNS).join(new.select("id"), "id", "left_anti")
    return others.unionByName(_entity_changes(entities, new, run_ts))


def relationship_changes(related: DataFrame, batch: DataFrame, entities: DataFrame, run_ts: Column) -> DataFrame:
    """The edges that a batch adds (``kb_id, source_id, target_id, type, job_id, batch_pos``): one edge per
    (tenant, source, target, type), which keeps the first job naming it. Both ends must
    exist in the tenant."""
    first = durable.packed(batch.groupBy(*EDGE_KEY).agg(F.min_by("job_id", "batch_pos").alias("source_job_id")))
    stored = _stored(related, first, EDGE_KEY, EDGE_KEY)
    for end in ("source_id", "target_id"):
        first = _present(first, entities, end)
    fresh = first.join(stored, EDGE_KEY, "left_anti").withColumn("created_at", run_ts)
    return fresh.select(*EDGE_KEY, "source_job_id", "created_at")


def upsert_relationships(related: DataFrame, batch: DataFrame, entities: DataFrame, run_ts: Column) -> DataFrame:
    """Edges after a batch."""
    fresh = relationship_changes(related, batch, entities, run_ts)
    return related.select(*fresh.columns).unionByName(fresh)


def source_changes(batch: DataFrame) -> DataFrame:
    """The sources a batch writes (``kb_id, job_id, batch_pos, label, published_at, ingested_at`` as text): label and
    dates are overwritten, an empty or unreadable date becomes null."""
    value = F.struct("label", "published_at", "ingested_at")
    last = batch.groupBy(*SOURCE_KEY).agg(F.max_by(value, "batch_pos").alias("new"))
    # Dates are read once a source, not once for every row that names it.
    dates = [parse_iso(F.col(f"new.{c}")).alias(c) for c in ("published_at", "ingested_at")]
    return durable.cut(last.select(*SOURCE_KEY, "new.label", *dates))


def upsert_sources(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """Sources after a batch."""
    return replaced(sources, source_changes(batch), SOURCE_KEY)


def mention_changes(mentions: DataFrame, batch: DataFrame, entities: DataFrame) -> DataFrame:
    """The (entity, source) links that a batch adds; the entity must exist in the tenant."""
    named = durable.packed(batch.select(*MENTION_KEY).distinct())
    stored = _stored(mentions, named, MENTION_KEY, MENTION_KEY)
    return _present(named, entities, "entity_id").join(stored, MENTION_KEY, "left_anti")


def upsert_mentions(mentions: DataFrame, batch: DataFrame, entities: DataFrame) -> DataFrame:
    """The set of (entity, source) links after a batch."""
    return mentions.select(*MENTION_KEY).unionByName(mention_changes(mentions, batch, entities))


def purge_tenants(table: DataFrame, tenants: DataFrame) -> DataFrame:
    """``table`` without the rows of the given tenants."""
    return table.join(tenants.select("kb_id").distinct(), "kb_id", "left_anti")


def purge_counts(tenants: DataFrame, *tables: DataFrame) -> DataFrame:
    """``kb_id, deleted``: rows the purge removes from all tables together."""
    counts = [t.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")) for t in tables]
    total = counts[0]
    for other in counts[1:]:
        total = total.unionByName(other)
    summed = total.groupBy("kb_id").agg(F.sum("n").alias("n"))
    return tenants.select("kb_id").distinct().join(summed, "kb_id", "left").select("kb_id", F.coalesce("n", F.lit(0)).alias("deleted"))


def deletable_tenants(requests: DataFrame, tenants: DataFrame, members: DataFrame) -> DataFrame:
    """Deletion requests (``kb_id, user_id, confirm_name``) with their ``outcome``: ok, not_found,
    name_mismatch, or last_tenant when the caller has no other."""
    owned = members.groupBy("user_id").agg(F.count(F.lit(1)).alias("memberships"))
    asked = requests.join(tenants.select("kb_id", F.col("name").alias("tenant_name")), "kb_id", "left").join(owned, "user_id", "left")
    outcome = (
        F.when(F.col("tenant_name").isNull(), "not_found")
        .when(F.col("confirm_name") != F.col("tenant_name"), "name_mismatch")
        .when(F.coalesce("memberships", F.lit(0)) <= 1, "last_tenant")
        .otherwise("ok")
    )
    return asked.withColumn("outcome", outcome)


def backfill_articles(entities: DataFrame) -> DataFrame:
    """Entities whose missing article is taken from the summary, which shrinks to its first sentence."""
    due = F.col("article").isNull() & F.col("summary").isNotNull()
    return entities.withColumns(
        {
            "article": F.when(due, F.col("summary")).otherwise(F.col("article")),
            "summary": F.when(due, first_sentence(F.col("summary"))).otherwise(F.col("summary")),
        }
    )


def backfill_labels(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unlabelled sources get label and date from their job, '' where the job does not tell."""
    told = jobs.select(
        "job_id",
        F.coalesce(F.get_json_object("metadata", "$.source"), F.lit("")).alias("job_label"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("job_date"),
    )
    due = F.col("label").isNull()
    return (
        sources.join(told, "job_id", "left")
        .withColumn("date", F.when(due, F.coalesce("job_date", F.lit(""))))
        .withColumn("label", F.when(due, F.coalesce("job_label", F.lit(""))).otherwise(F.col("label")))
        .drop("job_label", "job_date")
    )
