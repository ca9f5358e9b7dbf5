"""From queued content to the graph: one batch of jobs, end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators import graph_write, infer, jobs, prompts, resolution, vocabulary
from loomgraph.operators.articles import fold_articles, latest_articles
from loomgraph.operators.infer import Provider
from loomgraph.schemas import EXTRACTION, JOB_BATCH, RELEVANCE, RESOLUTIONS, TYPE_CONSOLIDATION

JOB = ["kb_id", "job_id"]


@dataclass(frozen=True)
class Models:
    """Provider factories of the model calls. Without an ``article`` model, texts are kept as extracted."""

    relevance: Callable[[], Provider]
    extraction: Callable[[], Provider]
    resolution: Callable[[], Provider]
    types: Callable[[], Provider] | None = None
    article: Callable[[], Provider] | None = None
    parallelism: int | None = None


@dataclass(frozen=True)
class State:
    """The tables a batch reads and replaces."""

    jobs: DataFrame
    configs: DataFrame
    entities: DataFrame
    related: DataFrame
    sources: DataFrame
    mentions: DataFrame


# What makes a row of each table the same row.
KEYS = {
    "jobs": ["job_id"],
    "configs": ["kb_id"],
    "entities": ["id"],
    "related": graph_write.EDGE_KEY,
    "sources": graph_write.SOURCE_KEY,
    "mentions": graph_write.MENTION_KEY,
}


@dataclass(frozen=True)
class Merged:
    """A batch's results: the rows it added or changed in each table (written down), the state with them, an outcome
    per job, counters, and new types per kind."""

    changes: State
    state: State
    outcomes: DataFrame
    counts: DataFrame
    new_types: dict[str, DataFrame]


def _after(state: State, changes: State) -> State:
    return State(**{t: graph_write.replaced(getattr(state, t), getattr(changes, t), key) for t, key in KEYS.items()})


def _ask(requests: DataFrame, factory: Callable[[], Provider], models: Models, schema, valid) -> DataFrame:
    """Answers, read and written out: each call is made once and each answer parsed once, whatever reads the result."""
    answers = infer.infer(requests, JOB, factory, models.parallelism)
    value, wrong = infer.parsed(F.col("answer"), schema, valid)
    return durable.packed(answers.select(*JOB, value.alias("v"), F.coalesce("error", wrong).alias("error")))


def _novel_type_answers(kind: str, mentions: DataFrame, example: Column, batch: DataFrame, types: DataFrame, models: Models):
    """Decisions on the batch's novel types; a failed call decides nothing, so novel types drop out."""
    discovering = batch.where("discover_types")
    candidates = vocabulary.unmatched(mentions.join(discovering.select(*JOB), JOB, "left_semi"), types)
    listed = candidates.join(vocabulary.type_examples(mentions, example), [*JOB, "type"], "left")
    column = f"{kind}_types"
    asked = batch.withColumn(column, vocabulary.active_types(F.col(column)))
    requests = prompts.consolidation(kind, listed, asked, column)
    good = _ask(requests, models.types, models, TYPE_CONSOLIDATION, infer.valid_type_consolidation).where("error IS NULL")
    echoes = good.select("job_id", F.posexplode("v.decisions").alias("answer_pos", "d")).select("job_id", "answer_pos", "d.*")
    return vocabulary.decisions(candidates, echoes)


def _resolve_kind(kind: str, mentions: DataFrame, example: Column, batch: DataFrame, configs: DataFrame, models: Models):
    """(mentions of accepted types, types minted by the batch).

    Decisions and minted types, a few rows for each novel type of a job, are written down: many branches read them."""
    types = vocabulary.type_rows(configs, f"{kind}_types")
    if models.types is None:
        decided = mentions.sparkSession.createDataFrame(
            [], "job_id string, key string, decision string, canonical string, name string, description string"
        ).withColumn("job_id", F.col("job_id").cast(mentions.schema["job_id"].dataType))
    else:
        decided = durable.packed(_novel_type_answers(kind, mentions, example, batch, types, models))
    minted = durable.packed(vocabulary.minted_types(mentions, types, decided))
    return vocabulary.resolve_types(mentions, types, decided, minted), minted


def merge(batch: DataFrame, state: State, models: Models, run_ts: Column, batch_id: str) -> Merged:
    """Merge a batch of claimed jobs into the graph, all at once.

    The batch resolves against the graph as it stood before, and shares new identities; a
    job that fails at any step leaves no trace in the graph and is reported as an error. ``merge_in_turn``
    lets the jobs of a tenant see each other."""
    # Written down, so that Spark knows how small they are: jobs and mentions are not shuffled by their few tenants.
    settings = durable.packed(state.configs.join(batch.select("kb_id").distinct(), "kb_id", "left_semi"))
    batch = durable.packed(jobs.job_metadata(vocabulary.with_config(batch, settings)))
    interests = F.col("interests")
    asked = batch.select(*JOB, *(c.alias(n) for n, c in prompts.relevance(interests, F.col("content")).items()))
    verdicts = _ask(asked, models.relevance, models, RELEVANCE, infer.valid_relevance)
    relevant = batch.join(verdicts.where("v.relevant").select(*JOB), JOB, "left_semi")

    request = prompts.extraction(
        F.col("entity_types"), F.col("relationship_types"), F.col("content"), interests, F.col("discover_types")
    )
    asked = relevant.select(*JOB, *(c.alias(n) for n, c in request.items()))
    extracted = _ask(asked, models.extraction, models, EXTRACTION, infer.valid_extraction)
    found = extracted.select(*JOB, F.posexplode("v.entities").alias("pos", "e")).select(
        *JOB, "pos", "e.name", "e.type", "e.description", "e.aliases"
    )
    mentions, entity_types = _resolve_kind("entity", found, F.col("name"), relevant, settings, models)
    mentions = durable.packed(mentions)

    offered = resolution.mention_candidates(mentions, resolution.candidates(mentions, state.entities), state.entities)
    offered = durable.packed(offered)
    chosen = _ask(prompts.resolution(offered), models.resolution, models, RESOLUTIONS, infer.valid_resolutions)
    # An empty answer means that all are new; anything unreadable fails the job.
    unread = chosen.where("error IS NOT NULL AND error <> 'empty response'")
    answers = chosen.select("job_id", F.posexplode("v.resolutions").alias("answer_pos", "r")).select(
        "job_id", "answer_pos", F.col("r.index").alias("index"), F.col("r.id").alias("id")
    )
    failed = (
        verdicts.where("error IS NOT NULL")
        .select(*JOB, "error")
        .unionByName(extracted.where("error IS NOT NULL").select(*JOB, "error"))
        .unionByName(unread.select(*JOB, "error"))
    )
    failed = durable.packed(failed)
    resolved = resolution.resolve(mentions, offered, answers).join(failed.select(*JOB), JOB, "left_anti")
    # Joined first, so that a job's mentions already lie together when they get their identities.
    order = batch.select(*JOB, "created_at", "source_label", "source_published_at", "source_ingested_at")
    identified = durable.packed(
        resolution.batch_identity(resolved.join(order, JOB), batch_id)
        .withColumn("batch_pos", F.struct("created_at", "job_id", "pos"))
    )

    known = state.entities.select("kb_id", F.col("id").alias("entity_id"), F.col("article").alias("existing_article"))
    told = identified.join(known, ["kb_id", "entity_id"], "left")
    if models.article is None:
        articles = latest_articles(told)
    else:
        articles = durable.packed(fold_articles(told, models.article, models.parallelism))
    written = identified.join(articles, ["kb_id", "entity_id"])
    entities = durable.packed(graph_write.entity_changes(state.entities, written, run_ts))
    # Links and edges join entities of this batch, and of these the changes hold every row, stored before or not.
    there = entities.select("kb_id", "id")
    provenance = identified.select(
        *JOB, "entity_id", "batch_pos", F.col("source_label").alias("label"),
        F.col("source_published_at").alias("published_at"), F.col("source_ingested_at").alias("ingested_at"),
    )
    sources = graph_write.source_changes(provenance)
    links = graph_write.mention_changes(state.mentions, provenance, there)

    relations = extracted.join(failed.select(*JOB), JOB, "left_anti").select(
        *JOB, F.posexplode("v.relationships").alias("pos", "r")
    ).select(*JOB, "pos", "r.source_name", "r.target_name", "r.type")
    example = F.concat_ws(" -> ", "source_name", "target_name")
    typed, relation_types = _resolve_kind("relationship", relations, example, relevant, settings, models)
    ends = durable.packed(
        resolution.relationship_endpoints(typed, resolution.name_ids(identified))
        .join(order.select(*JOB, "created_at"), JOB)
        .withColumn("batch_pos", F.struct("created_at", "job_id", "pos"))
    )
    related = graph_write.relationship_changes(state.related, ends, there, run_ts)

    attempts = ends.groupBy(*JOB).agg(F.count(F.lit(1)).alias("relationships_created"))
    counts = resolution.merge_counts(identified).join(attempts, JOB, "full_outer").na.fill(0)
    skipped = verdicts.where("NOT v.relevant").select(*JOB, F.lit("skipped").alias("result"), F.col("v.reason").alias("reason"))
    done = verdicts.where("v.relevant").join(failed.select(*JOB), JOB, "left_anti")
    outcomes = (
        skipped.unionByName(done.select(*JOB, F.lit("done").alias("result"), F.col("v.reason").alias("reason")))
        .withColumn("message", F.lit(None).cast("string"))
        .unionByName(failed.select(*JOB, F.lit("error").alias("result"), F.lit(None).cast("string").alias("reason"), F.col("error").alias("message")))
    )
    minted = {
        "entity_types": entity_types.join(failed.select(*JOB), JOB, "left_anti"),
        "relationship_types": relation_types.join(failed.select(*JOB), JOB, "left_anti"),
    }
    minting = [rows.select("kb_id") for rows in minted.values()]
    configs = settings.join(minting[0].unionByName(minting[1]), "kb_id", "left_semi")
    for column, rows in minted.items():
        configs = _with_new_types(configs, column, rows.join(order.select(*JOB, "created_at"), JOB))
    mine = state.jobs.join(batch.select("job_id"), "job_id", "left_semi")
    changes = State(
        jobs=durable.packed(jobs.apply_outcomes(mine, outcomes, run_ts)),
        configs=durable.packed(configs),
        entities=entities,
        related=durable.packed(related),
        sources=sources,
        mentions=durable.packed(links),
    )
    return Merged(changes, _after(state, changes), outcomes, counts, minted)


def _with_new_types(configs: DataFrame, column: str, minted: DataFrame) -> DataFrame:
    """Configurations with the batch's new types appended, in the order they were minted.

    A vocabulary is one configuration value that goes into every prompt, so its list per
    tenant is small by its purpose."""
    place = F.struct("created_at", "job_id", "mint_pos")
    first = (
        minted.join(configs.select("kb_id"), "kb_id", "left_semi")
        .groupBy("kb_id", "key")
        .agg(F.min(F.struct(place.alias("place"), "name", "description")).alias("v"))
    )
    added = first.groupBy("kb_id").agg(F.array_sort(F.collect_list(F.struct("v.place", "v.name", "v.description"))).alias("added"))
    as_types = F.transform(
        "added",
        lambda a: F.struct(
            a["name"].alias("name"), a["description"].alias("description"), F.lit(False).alias("pinned"), F.lit(False).alias("banned")
        ),
    )
    extended = F.when(F.col("added").isNotNull(), F.concat(column, as_types)).otherwise(F.col(column))
    return configs.join(added, "kb_id", "left").withColumn(column, extended).drop("added")


def merge_in_turn(batch: DataFrame, state: State, models: Models, run_ts: Column, batch_id: str) -> Merged:
    """Merge a batch so that each job sees what the tenant's earlier jobs wrote: entities, their latest names, types, articles.

    Tenants share nothing, so turn ``k`` merges the ``k``-th job of every tenant together: there are as many turns as one
    tenant has jobs in the batch, however many tenants there are. A turn writes down the rows changed so far, not the
    state, and deletes those of the turn before."""
    place = F.row_number().over(Window.partitionBy("kb_id").orderBy("created_at", "job_id"))
    batch = durable.packed(batch.withColumn("_turn", place))
    turns = batch.agg(F.max("_turn")).first()[0] or 0
    if turns < 2:
        return merge(batch.drop("_turn"), state, models, run_ts, batch_id)
    outcomes = counts = changes = None
    minted: dict[str, DataFrame] = {}
    for turn in range(1, turns + 1):
        now = _after(state, changes) if changes else state
        merged = merge(batch.where(F.col("_turn") == turn).drop("_turn"), now, models, run_ts, f"{batch_id}/{turn}")
        before = changes
        changes = _gathered(before, merged.changes) if before else merged.changes
        parts = [durable.packed(x) for x in (merged.outcomes, merged.counts)]
        outcomes, counts = parts if outcomes is None else (x.unionByName(y) for x, y in zip((outcomes, counts), parts, strict=True))
        for kind, rows in merged.new_types.items():
            rows = durable.packed(rows)
            minted[kind] = minted[kind].unionByName(rows) if kind in minted else rows
        if before:
            for f in fields(State):
                durable.drop(getattr(before, f.name))
    return Merged(changes, _after(state, changes), outcomes, counts, minted)


def _gathered(before: State, changes: State) -> State:
    """The rows changed up to a turn, one for each key."""
    after = _after(before, changes)
    return State(**{f.name: durable.packed(getattr(after, f.name)) for f in fields(State)})


def drain(state: State, models: Models, run_ts: Column, batch_id: str, n: int = JOB_BATCH, in_turn: bool = True) -> Merged:
    """One pass over the queue: claim the oldest pending jobs and merge them, ``in_turn`` or all at once."""
    claimed = durable.packed(jobs.claim_batch(state.jobs, n))
    running = state.jobs.join(claimed.select("job_id", F.lit("processing").alias("_now")), "job_id", "left").withColumn(
        "status", F.coalesce("_now", "status")
    )
    step = merge_in_turn if in_turn else merge
    return step(claimed, replace(state, jobs=running.drop("_now")), models, run_ts, batch_id)
