"""The per-tenant vocabulary of entity and relationship types."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions.text import sanitize, strip, type_key
from loomgraph.schemas import TYPE_DEF


def clean_types(types: Column) -> Column:
    """A submitted type list with clean names and descriptions, blank names dropped."""
    cleaned = F.transform(
        types,
        lambda t: F.struct(
            strip(sanitize(t["name"])).alias("name"),
            strip(sanitize(F.coalesce(t.description, F.lit("")))).alias("description"),
            F.coalesce(t.pinned, F.lit(False)).alias("pinned"),
            F.coalesce(t.banned, F.lit(False)).alias("banned"),
        ),
    )
    return F.filter(cleaned, lambda t: t["name"] != "")


def active_types(types: Column) -> Column:
    return F.filter(types, lambda t: ~F.coalesce(t.banned, F.lit(False)))


def banned_types(types: Column) -> Column:
    return F.filter(types, lambda t: F.coalesce(t.banned, F.lit(False)))


def to_type_defs(names: Column) -> Column:
    """Plain names upgraded to type definitions without description."""
    return F.coalesce(
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("name"), F.lit("").alias("description"), F.lit(False).alias("pinned"), F.lit(False).alias("banned")
            ),
        ),
        F.array().cast(f"array<{TYPE_DEF.simpleString()}>"),
    )


def to_type_names(types: Column) -> Column:
    return F.coalesce(F.transform(types, lambda t: t["name"]), F.array().cast("array<string>"))


def type_rows(configs: DataFrame, column: str) -> DataFrame:
    """``kb_id, ord, name, description, pinned, banned, key``: one row per configured type."""
    return configs.select("kb_id", F.posexplode(column).alias("ord", "t")).select(
        "kb_id", "ord", "t.name", "t.description", F.coalesce("t.pinned", F.lit(False)).alias("pinned"),
        F.coalesce("t.banned", F.lit(False)).alias("banned"), type_key(F.col("t.name")).alias("key"),
    )


def current_config(changes: DataFrame) -> DataFrame:
    """The latest whole-value configuration of each tenant from a change log."""
    fields = [c for c in changes.columns if c not in ("kb_id", "changed_at", "change_id")]
    latest = F.max_by(F.struct(*fields), F.struct("changed_at", "change_id")).alias("v")
    return changes.groupBy("kb_id").agg(latest).select("kb_id", "v.*")


def with_config(jobs: DataFrame, configs: DataFrame) -> DataFrame:
    """Jobs with their tenant's configuration; without one: no interests, no discovery, no types."""
    none = F.array().cast(f"array<{TYPE_DEF.simpleString()}>")
    return jobs.join(configs, "kb_id", "left").withColumns(
        {
            "interests": F.coalesce("interests", F.lit("")),
            "discover_types": F.coalesce("discover_types", F.lit(False)),
            "entity_types": F.coalesce("entity_types", none),
            "relationship_types": F.coalesce("relationship_types", none),
        }
    )


def canon(types: DataFrame) -> DataFrame:
    """``kb_id, key, canonical`` of the active types; the later of two equal keys wins."""
    return types.where(~F.col("banned")).groupBy("kb_id", "key").agg(F.max_by("name", "ord").alias("canonical"))


def banned_keys(types: DataFrame) -> DataFrame:
    return types.where("banned").select("kb_id", "key").distinct()


def unmatched(mentions: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct extracted spellings per job that the vocabulary neither knows nor bans."""
    seen = mentions.select("kb_id", "job_id", "type", type_key(F.col("type")).alias("key")).distinct()
    return seen.join(types.select("kb_id", "key").distinct(), ["kb_id", "key"], "left_anti")


def type_examples(mentions: DataFrame, example: Column) -> DataFrame:
    """Per job and spelling, the example shown with it: the first one extracted."""
    return mentions.groupBy("kb_id", "job_id", "type").agg(F.min_by(example, "pos").alias("example"))


def match_echoes(candidates: DataFrame, echoes: DataFrame) -> DataFrame:
    """Answers matched to the candidate they echo: ``key`` is the equal candidate, else the
    longest candidate the echo starts with, else the echo itself.

    Only prefixes as long as one of the job's candidates are tried, each by an equality join."""
    keys = candidates.select("job_id", type_key(F.col("type")).alias("key")).distinct()
    echoed = echoes.withColumn("echo", type_key(F.col("candidate")))
    lengths = keys.groupBy("job_id").agg(F.collect_set(F.length("key")).alias("lengths"))
    spelled = echoed.select("job_id", "echo").distinct()
    tried = spelled.join(lengths, "job_id").select(
        "job_id", "echo", F.explode(F.filter("lengths", lambda n: n <= F.length("echo"))).alias("length")
    )
    hits = tried.withColumn("key", F.expr("substring(echo, 1, length)")).join(keys, ["job_id", "key"])
    best = hits.groupBy("job_id", "echo").agg(F.max_by("key", "length").alias("key"))
    return echoed.join(best, ["job_id", "echo"], "left").withColumn("key", F.coalesce("key", "echo"))


def decisions(candidates: DataFrame, echoes: DataFrame) -> DataFrame:
    """``job_id, key, decision, canonical, name, description``: the last answer per candidate."""
    fields = F.struct("decision", "canonical", "name", "description")
    matched = match_echoes(candidates, echoes)
    return matched.groupBy("job_id", "key").agg(F.max_by(fields, "answer_pos").alias("v")).select("job_id", "key", "v.*")


def _mint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each job's offers in order; only the names minted so far are kept."""
    job, done = None, set()
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if (row.kb_id, row.job_id) != job:
                job, done = (row.kb_id, row.job_id), set()
            if row.key not in done and row.new_key not in done:
                done.add(row.new_key)
                out.append((row.kb_id, row.job_id, row.new_key, row.pos, row.name, row.description))
        yield pd.DataFrame(out, columns=["kb_id", "job_id", "key", "mint_pos", "name", "description"])


def minted_types(mentions: DataFrame, types: DataFrame, decided: DataFrame) -> DataFrame:
    """``kb_id, job_id, key, mint_pos, name, description``: types a job adds to the vocabulary.

    A mention mints the name its type was decided to become, unless that name is banned or
    known, or the mention's own type has become known at an earlier mention. The walk runs
    over a job's distinct novel types, in the order of their first mentions."""
    first = mentions.groupBy("kb_id", "job_id", type_key(F.col("type")).alias("key")).agg(F.min("pos").alias("pos"))
    listed = types.select("kb_id", "key").distinct()
    novel = first.join(listed, ["kb_id", "key"], "left_anti")
    offers = (
        novel.join(decided.where("decision = 'new'"), ["job_id", "key"])
        .withColumn("new_key", type_key(F.col("name")))
        .join(listed.withColumnRenamed("key", "new_key"), ["kb_id", "new_key"], "left_anti")
    )
    ordered = offers.select("kb_id", "job_id", "pos", "key", "new_key", "name", F.coalesce("description", F.lit("")).alias("description"))
    ordered = ordered.repartition("kb_id", "job_id").sortWithinPartitions("kb_id", "job_id", "pos")
    job = offers.schema["job_id"].dataType.simpleString()
    return ordered.mapInPandas(_mint, f"kb_id string, job_id {job}, key string, mint_pos int, name string, description string")


def resolve_types(mentions: DataFrame, types: DataFrame, decided: DataFrame, minted: DataFrame) -> DataFrame:
    """Mentions whose type the vocabulary accepts, with ``type`` in its canonical spelling.

    Known types come first, banned types drop out, then the answer for the type decides. An
    answer naming a type that the same job mints holds only after the minting mention."""
    known = canon(types)
    banned = banned_keys(types).withColumn("banned", F.lit(True))
    new = minted.select("kb_id", "job_id", "key", "mint_pos", F.col("name").alias("minted_name"))
    answer = decided.select(
        "job_id",
        "key",
        "decision",
        F.when(F.col("decision") == "existing", type_key(F.col("canonical")))
        .when(F.col("decision") == "new", type_key(F.col("name")))
        .alias("goal"),
    )
    # Everything but the place of a mention is the same for all mentions of a type in a job: it is looked up once for each,
    # without their texts, and goals only where there is one. Mentions move once.
    spelled = durable.cut(mentions.select("kb_id", "job_id", type_key(F.col("type")).alias("key")).distinct())
    answered = spelled.join(answer, ["job_id", "key"])
    aims = answered.where("goal IS NOT NULL").select("kb_id", "job_id", "goal").distinct()
    aims = (
        aims.join(known.select("kb_id", F.col("key").alias("goal"), F.col("canonical").alias("goal_name")), ["kb_id", "goal"], "left")
        .join(banned.select("kb_id", F.col("key").alias("goal"), F.col("banned").alias("goal_banned")), ["kb_id", "goal"], "left")
        .join(
            new.select("kb_id", "job_id", F.col("key").alias("goal"), F.col("mint_pos").alias("goal_pos"), F.col("minted_name").alias("goal_minted")),
            ["kb_id", "job_id", "goal"],
            "left",
        )
    )
    answered = answered.join(aims, ["kb_id", "job_id", "goal"])
    own = new.withColumnRenamed("mint_pos", "own_pos").withColumnRenamed("minted_name", "own_name")
    # A type without an answer, or with one that has no goal, can still be known or minted.
    facts = (
        spelled.join(known, ["kb_id", "key"], "left")
        .join(banned.withColumnRenamed("banned", "is_banned"), ["kb_id", "key"], "left")
        .join(own, ["kb_id", "job_id", "key"], "left")
        .join(answered, ["kb_id", "job_id", "key"], "left")
        .where("canonical IS NOT NULL OR own_name IS NOT NULL OR (is_banned IS NULL AND goal IS NOT NULL)")
        .withColumnsRenamed({"kb_id": "_kb_id", "job_id": "_job_id", "key": "_key"})
    )
    # Jobs without number are told apart by their types alone.
    same = (
        (F.col("kb_id") == F.col("_kb_id"))
        & (type_key(F.col("type")) == F.col("_key"))
        & F.col("job_id").eqNullSafe(F.col("_job_id"))
    )
    joined = mentions.join(facts, same)
    goal_known = F.coalesce("goal_name", F.when(F.col("goal_pos") < F.col("pos"), F.col("goal_minted")))
    by_answer = F.when(F.col("decision") == "existing", goal_known).when(
        (F.col("decision") == "new") & F.col("goal_banned").isNull(), F.coalesce("goal_name", "goal_minted")
    )
    resolved = (
        F.when(F.col("canonical").isNotNull(), F.col("canonical"))
        .when(F.col("own_pos") < F.col("pos"), F.col("own_name"))
        .when(F.col("is_banned").isNull(), by_answer)
    )
    return joined.withColumn("_resolved", resolved).where("_resolved IS NOT NULL").select(
        *[F.col("_resolved").alias("type") if c == "type" else F.col(c) for c in mentions.columns]
    )


def append_types(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """``kb_id, ord, name, description, pinned, banned``: the stored types, then each added type
    whose key is not there yet (the first spelling wins, without flags).

    ``additions`` has ``kb_id, add_pos, name, description``; tenants without a stored
    configuration are the caller's to leave out."""
    fresh = additions.withColumn("key", type_key(F.col("name"))).join(
        existing.select("kb_id", "key").distinct(), ["kb_id", "key"], "left_anti"
    )
    first = fresh.groupBy("kb_id", "key").agg(F.min(F.struct("add_pos", "name", "description")).alias("v"))
    last = existing.groupBy("kb_id").agg(F.max("ord").alias("last"))
    added = first.join(last, "kb_id", "left").select(
        "kb_id",
        (F.coalesce("last", F.lit(-1)) + 1 + F.col("v.add_pos")).alias("ord"),
        "v.name",
        F.coalesce("v.description", F.lit("")).alias("description"),
        F.lit(False).alias("pinned"),
        F.lit(False).alias("banned"),
    )
    return existing.select("kb_id", "ord", "name", "description", "pinned", "banned").unionByName(added)
