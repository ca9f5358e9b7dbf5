"""Whole batches: all documents as jobs, with rules in place of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators.vocabulary import to_type_defs
from loomgraph.plans import knowledge, rules
from loomgraph.plans.registry import query
from loomgraph.schemas import MENTION, RELATED, SOURCE
from loomgraph.sources.tables import Tables
from loomgraph.streaming import flows
from loomgraph.streaming.store import TableStore

RUN = "2024-06-01"


def _configs(queue: DataFrame) -> DataFrame:
    return queue.select("kb_id").distinct().select(
        "kb_id", F.lit("words").alias("interests"), F.lit(False).alias("discover_types"), to_type_defs(F.array(F.lit("Person"))).alias("entity_types"),
        to_type_defs(F.array(F.lit("Near"))).alias("relationship_types"),
    )


def _state(t: Tables) -> knowledge.State:
    """Documents with even numbers were merged before; now all documents wait in the queue."""
    queue = t.jobs().select(
        F.col("job_id").cast("string").alias("job_id"), "kb_id", "content", "metadata", F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("relevance_reason"), F.lit(None).cast("string").alias("error"), F.lit(2).alias("attempts"),
        F.timestamp_seconds("created_s").alias("created_at"), F.lit(None).cast("timestamp").alias("processed_at"),
    )
    configs = _configs(queue)
    words = t.text_mentions().where("doc_id % 2 = 0").select(F.concat(F.lit("kb"), F.col("doc_id") % 4).alias("kb_id"), F.lower("name").alias("n")).distinct()
    past = F.lit("2020-01-01").cast("timestamp")
    entities = words.select(
        "kb_id", F.concat(F.lit("stored/"), "kb_id", F.lit("/"), "n").alias("id"), F.lit("Person").alias("type"), F.initcap("n").alias("name"), F.col("n").alias("name_normalized"),
        F.lit("old").alias("summary"), F.lit("old article").alias("article"), F.array().cast("array<string>").alias("aliases"), past.alias("created_at"), past.alias("updated_at"),
    )
    spark = t.spark
    empty = [spark.createDataFrame([], s) for s in (RELATED, SOURCE, MENTION)]
    return knowledge.State(queue, configs, entities, *empty)


def _merged(t: Tables) -> knowledge.Merged:
    models = knowledge.Models(rules.relevant_by_length, rules.capitalised_words, rules.same_name)
    state = _state(t)
    return knowledge.merge(state.jobs, state, models, F.lit(RUN).cast("timestamp"), "batch-1")


_WORDS = f"""
words AS (
  SELECT doc_id, concat('kb', doc_id % 4) AS kb_id, unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}+')) AS name,
    generate_subscripts(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}+'), 1) AS i, length(text) % 5 <> 0 AS relevant FROM documents),
stored AS (SELECT DISTINCT kb_id, lower(name) AS n FROM words WHERE doc_id % 2 = 0),
mentioned AS (SELECT kb_id, lower(name) AS n, count(DISTINCT doc_id) AS sources FROM words WHERE relevant GROUP BY 1, 2)"""


@query(
    f"""WITH {_WORDS}
SELECT coalesce(s.kb_id, m.kb_id) AS kb_id, coalesce(s.n, m.n) AS name_normalized, CASE WHEN s.n IS NULL THEN 'new' ELSE 'stored' END AS origin,
  CASE WHEN s.n IS NULL THEN concat(upper(m.n[1]), m.n[2:], '. A word.') ELSE 'old article' END AS article,
  CASE WHEN m.n IS NULL THEN '2020-01-01' ELSE '{RUN}' END AS updated_at, coalesce(m.sources, 0)::BIGINT AS sources
FROM stored s FULL JOIN mentioned m ON s.kb_id = m.kb_id AND s.n = m.n"""
)
def merge_entities(t: Tables) -> DataFrame:
    after = _merged(t).state
    named = after.mentions.groupBy("kb_id", F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("sources"))
    return after.entities.join(named, ["kb_id", "id"], "left").select(
        "kb_id", "name_normalized", F.when(F.col("id").startswith("stored/"), "stored").otherwise("new").alias("origin"), "article",
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"), F.coalesce("sources", F.lit(0)).alias("sources"),
    )


@query(
    f"""WITH {_WORDS}
SELECT a.kb_id, lower(a.name) AS source, lower(b.name) AS target, min(a.doc_id)::VARCHAR AS first_job
FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.relevant GROUP BY 1, 2, 3"""
)
def merge_relationships(t: Tables) -> DataFrame:
    after = _merged(t).state
    ends = after.entities.select("kb_id", "id", "name_normalized")
    source = ends.select("kb_id", F.col("id").alias("source_id"), F.col("name_normalized").alias("source"))
    target = ends.select("kb_id", F.col("id").alias("target_id"), F.col("name_normalized").alias("target"))
    named = after.related.join(source, ["kb_id", "source_id"]).join(target, ["kb_id", "target_id"])
    return named.select("kb_id", "source", "target", F.col("source_job_id").alias("first_job"))


@query(
    f"""WITH {_WORDS}
SELECT doc_id::VARCHAR AS job_id, CASE WHEN length(text) % 5 <> 0 THEN 'done' ELSE 'skipped' END AS status, 'by length' AS reason FROM documents"""
)
def merge_jobs(t: Tables) -> DataFrame:
    return _merged(t).state.jobs.select("job_id", "status", F.col("relevance_reason").alias("reason"))


@query(
    f"""WITH {_WORDS},
told AS (SELECT doc_id, concat('kb', doc_id // 3) AS kb_id, lower(name) AS n FROM words WHERE relevant),
first AS (SELECT kb_id, n, min(doc_id) AS doc_id FROM told GROUP BY 1, 2)
SELECT t.kb_id, t.doc_id::VARCHAR AS job_id, count(DISTINCT f.n) AS entities_created, count(*) - count(DISTINCT f.n) AS entities_merged
FROM told t LEFT JOIN first f ON f.kb_id = t.kb_id AND f.n = t.n AND f.doc_id = t.doc_id GROUP BY 1, 2"""
)
def merge_in_turn(t: Tables) -> DataFrame:
    """What each job creates and merges where it sees the jobs before it; three documents a tenant, into an empty graph."""
    state = _state(t)
    tenant = F.concat(F.lit("kb"), F.floor(F.col("job_id").cast("bigint") / 3))
    start = F.timestamp_seconds(F.col("job_id").cast("bigint"))
    queue = state.jobs.withColumn("kb_id", tenant).withColumn("created_at", start)
    configs = _configs(queue)
    models = knowledge.Models(rules.relevant_by_length, rules.capitalised_words, rules.same_name)
    state = knowledge.State(queue, configs, state.entities.limit(0), state.related, state.sources, state.mentions)
    merged = knowledge.merge_in_turn(queue, state, models, F.lit(RUN).cast("timestamp"), "batch-1")
    return merged.counts.select("kb_id", "job_id", "entities_created", "entities_merged")


@query(
    f"""WITH {_WORDS}
SELECT coalesce(s.kb_id, m.kb_id) AS kb_id, coalesce(s.n, m.n) AS name_normalized, CASE WHEN s.n IS NULL THEN 'new' ELSE 'stored' END AS origin,
  CASE WHEN s.n IS NULL THEN concat(upper(m.n[1]), m.n[2:], '. A word.') ELSE 'old article' END AS article,
  m.n IS NOT NULL AS renewed, coalesce(m.sources, 0)::BIGINT AS sources
FROM stored s FULL JOIN mentioned m ON s.kb_id = m.kb_id AND s.n = m.n"""
)
def queue_drain(t: Tables) -> DataFrame:
    """The queue as a stream, drained in one sweep into a graph stored in buckets: the graph that the batch merge yields."""
    state = _state(t)
    folder, place, check = (durable.fresh_folder(t.spark, kind) for kind in ("queue", "store", "checkpoint"))
    store = TableStore(t.spark, place, buckets=8)
    store.write({name: durable.cut(getattr(state, name)) for name in store.tables if name != "jobs"} | {"jobs": state.jobs.limit(0)})
    queue = state.jobs.select("job_id", "kb_id", "content", "metadata", "created_at")
    queue.write.parquet(folder)
    models = knowledge.Models(rules.relevant_by_length, rules.capitalised_words, rules.same_name)
    flows.drain_stream(t.spark.readStream.schema(queue.schema).parquet(folder), store, models, check).awaitTermination()
    named = store.read("mentions").groupBy("kb_id", F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("sources"))
    return store.read("entities").join(named, ["kb_id", "id"], "left").select(
        "kb_id", "name_normalized", F.when(F.col("id").startswith("stored/"), "stored").otherwise("new").alias("origin"), "article",
        (F.col("updated_at") > F.lit("2020-01-01").cast("timestamp")).alias("renewed"), F.coalesce("sources", F.lit(0)).alias("sources"),
    )


def _discovering(t: Tables) -> knowledge.Merged:
    """All documents into an empty graph, with types found on the way and articles written by rule."""
    state = _state(t)
    configs = state.configs.withColumn("discover_types", F.lit(True))
    empty = state.entities.limit(0)
    models = knowledge.Models(rules.relevant_by_length, rules.words_by_initial, rules.same_name, rules.kinds_by_letter, rules.counting_article)
    state = knowledge.State(state.jobs, configs, empty, state.related, state.sources, state.mentions)
    return knowledge.merge(state.jobs, state, models, F.lit(RUN).cast("timestamp"), "batch-1")


_KINDS = f"""{_WORDS},
kinds AS (
  SELECT *, CASE unicode(name) % 3 WHEN 1 THEN concat('Kind ', name[1]) ELSE 'Person' END AS type, unicode(name) % 3 > 0 AS kept FROM words WHERE relevant)"""


@query(
    f"""WITH {_KINDS}
SELECT kb_id, lower(name) AS name_normalized, type, count(*)::VARCHAR AS article, count(DISTINCT doc_id) AS sources FROM kinds WHERE kept GROUP BY 1, 2, 3"""
)
def merge_discovered(t: Tables) -> DataFrame:
    """Entities under the types that the merge itself accepted, and articles folded over all their mentions."""
    after = _discovering(t).state
    named = after.mentions.groupBy("kb_id", F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("sources"))
    return after.entities.join(named, ["kb_id", "id"]).select("kb_id", "name_normalized", "type", "article", "sources")


@query(
    f"""WITH {_KINDS}
SELECT kb_id, 'Person' AS name, 0::BIGINT AS added FROM words GROUP BY kb_id
UNION ALL SELECT kb_id, type, 1 FROM kinds WHERE kept AND type <> 'Person' GROUP BY kb_id, type"""
)
def discovered_types(t: Tables) -> DataFrame:
    """Each tenant's entity types after the merge."""
    types = _discovering(t).state.configs.select("kb_id", F.explode("entity_types").alias("t"))
    return types.select("kb_id", "t.name", (F.col("t.description") != "").cast("bigint").alias("added"))


@query(
    f"""WITH {_KINDS}
SELECT a.kb_id, a.doc_id::VARCHAR AS job_id, count(*) AS relationships_created
FROM kinds a JOIN kinds b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.kept AND b.kept GROUP BY 1, 2"""
)
def relationships_created(t: Tables) -> DataFrame:
    """Relationships each job's merge wrote, where both ends were accepted."""
    return _discovering(t).counts.where("relationships_created > 0").select("kb_id", "job_id", "relationships_created")
