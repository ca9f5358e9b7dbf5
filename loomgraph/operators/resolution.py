"""Which existing entity a mention refers to, and which identity a batch gives it.

Mentions are rows ``kb_id, job_id, pos, name, type, description, aliases``; ``pos``
is the place in the job's extraction, and every order below comes from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import normalize_name
from loomgraph.operators.search import RARE_PROFILES, search
from loomgraph.operators.skew import top_per_key
from loomgraph.schemas import CANDIDATE_LIMIT

NAME = ["kb_id", "type", "name"]


def exact_candidates(names: DataFrame, entities: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """``kb_id, type, name, rank, id``: the first ``limit`` entities (by id) of the same tenant
    and type whose normalized name, or one alias, equals the name.

    The lookup table is cut to ``limit`` ids per name before it is joined, so a name shared
    by very many entities and mentions never multiplies out."""
    keys = F.array_distinct(F.concat(F.array(normalize_name(F.col("name"))), F.coalesce("aliases", F.array())))
    spelled = entities.select("kb_id", "type", "id", F.explode(keys).alias("key"))
    lookup = top_per_key(spelled, ["kb_id", "type", "key"], [F.col("id")], limit)
    asked = names.select(*NAME, normalize_name(F.col("name")).alias("key")).distinct()
    return asked.join(lookup, ["kb_id", "type", "key"]).select(*NAME, "rank", "id")


def candidates(
    mentions: DataFrame, entities: DataFrame, limit: int = CANDIDATE_LIMIT, rare: int = RARE_PROFILES
) -> DataFrame:
    """``kb_id, type, name, rank, id`` for each distinct name: exact matches, then token
    matches not among them, ``limit`` in all.

    Candidates depend on tenant, type and spelling only, so they are found once per
    distinct name and joined to the mentions afterwards."""
    names = mentions.select(*NAME).distinct()
    exact = exact_candidates(names, entities, limit).withColumn("tier", F.lit(0))
    queries = names.withColumnRenamed("name", "text")
    similar = (
        search(queries, entities, ["kb_id", "type"], limit, rare)
        .select("kb_id", "type", F.col("text").alias("name"), "rank", "id")
        .withColumn("tier", F.lit(1))
    )
    place = F.min(F.struct("tier", "rank")).alias("place")
    both = exact.unionByName(similar).groupBy(*NAME, "id").agg(place)
    return top_per_key(both, NAME, [F.col("place")], limit).select(*NAME, "rank", "id")


def mention_candidates(mentions: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates of every mention, with the candidate's name and summary for the prompt."""
    shown = entities.select("kb_id", "id", F.col("name").alias("candidate_name"), F.col("summary").alias("candidate_summary"))
    described = found.join(shown, ["kb_id", "id"])
    return mentions.join(described, NAME)


def accepted(offered: DataFrame, answers: DataFrame) -> DataFrame:
    """``job_id, pos, existing_id``: the last answer naming one of the mention's own candidates.

    ``answers`` has ``job_id, index, id, answer_pos``; "NEW" and invented ids match nothing."""
    # A mention's few candidates, and what one answer says of it, become one row each before they move, and move once.
    mention = ["job_id", "pos"]
    shown = offered.select("job_id", F.col("pos").cast("int").alias("pos"), "id").dropna()
    given = answers.select("job_id", F.col("index").cast("int").alias("pos"), "answer_pos", "id").dropna()
    shown = shown.groupBy(*mention).agg(F.collect_set("id").alias("shown"))
    given = given.groupBy(*mention).agg(F.collect_set(F.struct("answer_pos", "id")).alias("given"))
    last = F.array_max(F.filter("given", lambda a: F.array_contains("shown", a.id)))
    return shown.join(given, mention).select(*mention, last.id.alias("existing_id")).where("existing_id IS NOT NULL")


def resolve(mentions: DataFrame, offered: DataFrame, answers: DataFrame) -> DataFrame:
    """Mentions with ``existing_id``; null means a new entity."""
    return mentions.join(accepted(offered, answers), ["job_id", "pos"], "left")


def new_entity_id(*keys: Column) -> Column:
    """An id that a retry derives again."""
    return F.sha2(F.concat_ws("\u0001", *(k.cast("string") for k in keys)), 256)


def batch_identity(mentions: DataFrame, batch: str | None = None) -> DataFrame:
    """Mentions with ``name_normalized`` and ``entity_id``.

    Within a job, equal names of one type share an identity: the latest one resolved so far,
    else one new id. With a ``batch`` name, the new id is the same in all jobs of the batch, so
    jobs that run side by side do not mint one entity each."""
    keys = ["kb_id", "type", "name_normalized"]
    named = mentions.withColumn("name_normalized", normalize_name(F.col("name"))).dropna(subset=[*keys, "job_id", "pos"])
    # A job's mentions come out of one answer, which bounds them: one pass over them where they lie.
    earlier = Window.partitionBy(*keys, "job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = named.withColumn("known_id", F.last("existing_id", ignorenulls=True).over(earlier))
    minted = new_entity_id(*(F.col(k) for k in keys), F.col("job_id") if batch is None else F.lit(batch))
    return known.withColumn("entity_id", F.coalesce("known_id", minted)).drop("known_id")


def merge_counts(identified: DataFrame) -> DataFrame:
    """``kb_id, job_id, entities_created, entities_merged``: one creation per identity whose
    first mention was not resolved; every other mention is a merge."""
    firsts = identified.groupBy("kb_id", "job_id", "name_normalized", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.col("existing_id").isNull(), "pos").alias("minted")
    )
    created = F.count_if("minted")
    return firsts.groupBy("kb_id", "job_id").agg(
        created.alias("entities_created"), (F.sum("n") - created).alias("entities_merged")
    )


def name_ids(identified: DataFrame) -> DataFrame:
    """Per job and normalized name, the id given to its last mention, whatever the type."""
    return identified.groupBy("kb_id", "job_id", "name_normalized").agg(F.max_by("entity_id", "pos").alias("entity_id"))


def relationship_endpoints(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships (``kb_id, job_id, pos, source_name, target_name, type``) whose two ends were
    both named as entities of the job; a relationship of an entity with itself is kept."""
    found = relationships
    for end in ("source", "target"):
        lookup = ids.select("kb_id", "job_id", F.col("name_normalized").alias(f"{end}_key"), F.col("entity_id").alias(f"{end}_id"))
        found = found.withColumn(f"{end}_key", normalize_name(F.col(f"{end}_name"))).join(lookup, ["kb_id", "job_id", f"{end}_key"])
    return found.drop("source_key", "target_key")
