"""From the graph's recent sources to an issue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions import markdown as md
from loomgraph.operators import clustering, graph_read, infer, news, pages_text, prompts
from loomgraph.operators.infer import Provider
from loomgraph.schemas import CLUSTER_MAX_SOURCES, DEFAULT_LOOKBACK_HOURS, STORY
from loomgraph.sources import sinks

WATERMARK = "draft_issue"


@dataclass(frozen=True)
class Draft:
    """A drafted issue: its row, its lines, the next watermark table, and the counters."""

    issue: DataFrame
    lines: DataFrame
    watermarks: DataFrame
    report: dict


def render_beat(template: str, date: str, since: str) -> str:
    """The editorial brief with its two date variables filled in."""
    return template.replace("{{ issue.date }}", date).replace("{{ issue.since }}", since)


@dataclass(frozen=True)
class Drafts:
    """The drafted issues of many tenants: their rows, lines, the next watermark table, and one report row per tenant."""

    issues: DataFrame
    lines: DataFrame
    watermarks: DataFrame
    reports: DataFrame


def _stories(window: DataFrame, mentions: DataFrame, entities: DataFrame, writer: Callable[[], Provider], beat: Column, max_sources: int):
    """(ranked sources of each cluster, clusters with their size, an answer or error per cluster); ``beat`` may use the columns
    of ``window`` that are the same for a whole tenant."""
    kept = durable.cut(clustering.newest_sources(clustering.assign_clusters(window, mentions), max_sources))
    sized = durable.cut(clustering.cluster_sizes(kept))
    described = entities.select("kb_id", F.col("id").alias("entity_id"), "name", "type", "summary", "article")
    about = clustering.cluster_entities(kept, mentions).join(described, ["kb_id", "entity_id"])
    briefs = kept.groupBy("kb_id", "cluster_id").agg(F.any_value(beat).alias("_beat"))
    brief = pages_text.cluster_brief(sized, about, kept).join(briefs, ["kb_id", "cluster_id"])
    asked = brief.select("kb_id", "cluster_id", *(c.alias(n) for n, c in prompts.story(F.col("brief"), F.col("_beat")).items()))
    answers = durable.cut(infer.infer(asked, ["kb_id", "cluster_id"], writer))
    value, wrong = infer.parsed(F.col("answer"), STORY, infer.valid_story)
    return kept, sized, answers.select("kb_id", "cluster_id", value.alias("v"), F.coalesce("error", wrong).alias("error"))


def _ordered(written: DataFrame, sized: DataFrame) -> DataFrame:
    """The stories that were written: biggest cluster first, then the newest, as one sortable text."""
    order = F.concat_ws(
        "/", F.lpad((F.lit(10**9) - F.col("size")).cast("string"), 10, "0"),
        F.lpad((F.lit(10**11) - F.unix_seconds(F.col("newest").cast("timestamp"))).cast("string"), 12, "0"),
        F.lpad(F.col("lead_id").cast("string"), 64, "0"),
    )
    told = written.where("error IS NULL").join(sized, ["kb_id", "cluster_id"])
    return told.select("kb_id", "cluster_id", F.coalesce(order, F.lit("~")).alias("story_order"), "v.headline", "v.body")


def draft_issue(
    kb_id: str,
    sources: DataFrame,
    mentions: DataFrame,
    entities: DataFrame,
    watermarks: DataFrame,
    run_start: datetime,
    writer: Callable[[], Provider],
    beat: str = "",
    limit: int | None = None,
    max_sources: int = CLUSTER_MAX_SOURCES,
) -> Draft:
    """Cluster the tenant's sources since the watermark, write a story per cluster, assemble.

    A story that fails drops its cluster; when all fail, the run fails and the watermark
    stays. The whole window is covered; with a ``limit`` it is one page of the newest, and a full
    page is reported as truncated. Publish the lines before the watermark table."""
    since = news.watermark(watermarks, WATERMARK, run_start)
    mine = sources.where(F.col("kb_id") == kb_id)
    window = mine.where(graph_read.at_least(mine, "ingested_at", since))
    if limit is not None:
        window = window.orderBy(F.col("ingested_at").desc_nulls_first(), "job_id").limit(graph_read.page_size(limit))
    window = durable.cut(window)
    rendered = render_beat(beat, run_start.date().isoformat(), since.date().isoformat())
    kept, sized, written = _stories(window, mentions, entities, writer, F.lit(rendered), max_sources)
    tally = written.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("error").isNull()).alias("stories")).first()
    if tally["clusters"] and not tally["stories"]:
        raise RuntimeError(f"no story was written for any of {tally['clusters']} clusters; the watermark is left where it was")
    issue_id = f"{kb_id}/{run_start.isoformat()}"
    stories = _ordered(written, sized).withColumn("issue_id", F.lit(issue_id))
    issues = sources.sparkSession.range(1).select(
        F.lit(issue_id).alias("issue_id"), F.lit(kb_id).alias("kb_id"), F.lit(run_start).cast("timestamp").alias("generated_at"),
        F.lit(since).cast("timestamp").alias("covers_since"), F.lit(tally["stories"]).alias("story_count"),
    )
    lines = pages_text.issue_lines(issues, stories, kept)
    full = limit is not None and window.count() >= graph_read.page_size(limit)
    report = {"clusters": tally["clusters"], "stories": tally["stories"], "since": since, "truncated": full}
    return Draft(issues, lines, news.advance_watermark(watermarks, WATERMARK, run_start), report)


def draft_issues(
    tenants: DataFrame,
    sources: DataFrame,
    mentions: DataFrame,
    entities: DataFrame,
    watermarks: DataFrame,
    run_start: datetime,
    writer: Callable[[], Provider],
    beat: str = "",
    max_sources: int = CLUSTER_MAX_SOURCES,
    lookback_hours: int = DEFAULT_LOOKBACK_HOURS,
) -> Drafts:
    """An issue for every tenant (``kb_id``; repeated and null ones count once and not at all), in one plan.

    Each tenant's window starts at its own watermark (``kb_id, key, ran_at``), or ``lookback_hours`` before the run. A tenant all of
    whose stories fail gets no issue and keeps its watermark, whatever becomes of the others; its report says ``failed``.
    Publish the lines before the watermark table."""
    ran = watermarks.where(F.col("key") == WATERMARK).groupBy("kb_id").agg(F.max("ran_at").cast("timestamp").alias("ran_at"))
    first = F.lit(run_start - timedelta(hours=lookback_hours)).cast("timestamp")
    asked = tenants.where("kb_id IS NOT NULL").select("kb_id").distinct().join(ran, "kb_id", "left")
    covers = durable.cut(asked.select("kb_id", F.coalesce("ran_at", first).alias("covers_since")))
    # The oldest of the watermarks prunes the scan, each tenant's own one then decides.
    oldest = covers.agg(F.min("covers_since")).first()[0] or run_start
    recent = sources.where(graph_read.at_least(sources, "ingested_at", oldest))
    inside = F.col("ingested_at").cast("timestamp") >= F.col("covers_since")
    window = durable.cut(recent.join(covers, "kb_id").where(inside))
    today = F.lit(run_start.date().isoformat())
    dated = F.replace(F.replace(F.lit(beat), F.lit("{{ issue.date }}"), today), F.lit("{{ issue.since }}"), md.day(F.col("covers_since")))
    kept, sized, written = _stories(window, mentions, entities, writer, dated, max_sources)
    tally = written.groupBy("kb_id").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("error").isNull()).alias("stories"))
    reports = durable.cut(
        covers.join(tally, "kb_id", "left").na.fill(0, ["clusters", "stories"]).withColumn("failed", F.expr("clusters > 0 AND stories = 0"))
    )
    issue_id = F.concat("kb_id", F.lit(f"/{run_start.isoformat()}")).alias("issue_id")
    at = F.lit(run_start).cast("timestamp")
    issues = reports.where("NOT failed").select(issue_id, "kb_id", at.alias("generated_at"), "covers_since", F.col("stories").alias("story_count"))
    lines = pages_text.issue_lines(issues, _ordered(written, sized).withColumn("issue_id", issue_id), kept)
    done = issues.select("kb_id", F.lit(WATERMARK).alias("key"), at.alias("ran_at"))
    marks = watermarks.select("kb_id", "key", "ran_at").join(done, ["kb_id", "key"], "left_anti").unionByName(done)
    return Drafts(issues, lines, marks, reports)


def publish(draft: Draft, path: str) -> DataFrame:
    """Write the issue's Markdown below ``path`` and return its row with body; store that, then the
    draft's watermarks."""
    names = draft.issue.select("issue_id", md.issue_slug(F.col("generated_at")).alias("slug"))
    sinks.write_markdown(draft.lines, names, "issue_id", path)
    return draft.issue.join(pages_text.bodies(draft.lines, "issue_id"), "issue_id")


def publish_all(drafts: Drafts, path: str) -> DataFrame:
    """Write every tenant's issue as Markdown below ``path``, in a folder of its time and tenant, and return the rows with their
    bodies in parts; store those, then the watermarks."""
    slug = F.concat_ws("-", md.issue_slug(F.col("generated_at")), "kb_id").alias("slug")
    sinks.write_markdown(drafts.lines, drafts.issues.select("issue_id", slug), "issue_id", path)
    return drafts.issues.join(pages_text.bodies(drafts.lines, "issue_id"), "issue_id")
