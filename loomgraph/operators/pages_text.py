"""Issues and reports as ordered lines.

A document is a set of rows ``keys, section, ..., line`` with ordering columns, so even
one with very many claims is spread over tasks; ``bodies`` joins them into numbered parts of
a fixed number of lines, whatever the document's length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import markdown as md
from loomgraph.functions.text import or_else
from loomgraph.operators.claims import tally
from loomgraph.operators.skew import gathered

PART_LINES = 1000
LINE_ORDER = ["section", "major", "minor", "sub", "step"]


def _line(section: int, major: Column, minor: Column, sub: Column, texts: list[Column]) -> list[Column]:
    """Consecutive lines as structs."""
    place = (F.lit(section).alias("section"), major.alias("major"), minor.alias("minor"), sub.alias("sub"))
    return [F.struct(*place, F.lit(i).alias("step"), t.alias("line")) for i, t in enumerate(texts)]


def _lines(rows: DataFrame, key: str, *options: tuple[Column, list[Column]]) -> DataFrame:
    """The lines of the first option whose condition holds, in one pass over ``rows``."""
    chosen = F.when(options[0][0], F.array(*options[0][1]))
    for condition, lines in options[1:]:
        chosen = chosen.when(condition, F.array(*lines))
    return rows.select(key, F.inline(chosen))


def _descending(score: Column) -> Column:
    """Text that sorts like the score, highest first."""
    return F.format_string("%014.9f", F.lit(1000.0) - score)


def report_lines(documents: DataFrame, claims: DataFrame, evidence: DataFrame, generated_at: Column) -> DataFrame:
    """``document_id, section, major, minor, sub, step, line`` of each document's report.

    Claims go by checkworthiness, then id; the evidence of a claim by its ``evidence_order``, a text
    that sorts like creation time and id."""
    none = F.lit("")
    n, checked = F.coalesce("claim_count", F.lit(0)), F.coalesce("verified_count", F.lit(0))
    counts = F.concat(
        F.lit("*"), n.cast("string"), F.lit(" claims extracted · "), checked.cast("string"),
        F.lit(" checked · "), F.coalesce("summary", F.lit(md.NO_VERDICTS)), F.lit(".*"),
    )
    name = F.coalesce(or_else(F.col("title")), F.col("canonical_url"))
    by = md.byline(F.col("canonical_url"), F.col("author"), F.col("published_at"), generated_at)
    head = _line(0, none, none, none, [F.concat(F.lit("# Claim check — "), name), none, by, none, counts, none])
    around = _line(2, none, none, none, [F.lit("## Not checked"), none]) + _line(4, none, none, none, [none])
    framed = _lines(
        documents.join(tally(claims), "document_id", "left"), "document_id", (n > checked, head + around), (F.lit(True), head)
    )
    inside = claims.join(documents.select("document_id"), "document_id", "left_semi")
    rank, order = _descending(F.col("checkworthiness")), F.col("claim_id").cast("string")
    said = md.attribution(*(F.col(c) for c in ("attributed_to", "attribution_type", "cited_source", "cited_source_url")))
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    verdict = md.verdict_line(F.col("verdict"), F.col("confidence"))
    told = [F.concat(F.lit("## "), quoted), none, said, none, verdict, none, F.coalesce("rationale", none), none]
    judged = _line(1, rank, order, F.lit("0"), told) + _line(1, rank, order, F.lit("2"), [none])
    reason = md.unchecked_reason(F.col("selected"), F.col("claim_type"), F.col("checkworthiness"), F.col("error"))
    waiting = _line(3, rank, order, none, [F.concat(F.lit("- "), quoted, F.lit(" — "), reason)])
    body = _lines(inside, "document_id", (F.col("verdict").isNotNull(), judged), (F.lit(True), waiting))
    found = evidence.select("claim_id", "evidence_order", "stance", F.col("title").alias("e_title"), "url", "snippet")
    backed = inside.where("verdict IS NOT NULL").select("document_id", "claim_id", "checkworthiness").join(found, "claim_id")
    shown = md.evidence_line(F.col("stance"), F.col("e_title"), F.col("url"), F.col("snippet"))
    sub = F.concat(F.lit("1"), F.col("evidence_order"))
    cited = _lines(backed, "document_id", (F.lit(True), _line(1, rank, order, sub, [shown])))
    return framed.unionByName(body).unionByName(cited)


def issue_lines(issues: DataFrame, stories: DataFrame, cited: DataFrame) -> DataFrame:
    """``issue_id, section, major, minor, sub, step, line`` of each issue.

    ``issues`` has ``issue_id, generated_at, covers_since``; ``stories`` ``issue_id, story_order, cluster_id,
    headline, body`` with a sortable ``story_order``; ``cited`` the ranked sources of each cluster."""
    none = F.lit("")
    since, until = md.day(F.col("covers_since")), md.day(F.col("generated_at"))
    covering = F.concat(F.lit("*Covering "), since, F.lit(" to "), until, F.lit(".*"))
    head = _line(0, none, none, none, [F.concat(F.lit("# Issue — "), until), none, covering, none])
    empty = _line(1, none, none, none, [F.lit(md.NO_STORIES)])
    told = stories.groupBy("issue_id").agg(F.count(F.lit(1)).alias("stories"))
    framed = _lines(
        issues.join(told, "issue_id", "left"), "issue_id", (F.col("stories").isNull(), head + empty), (F.lit(True), head)
    )
    order = F.col("story_order")
    text = [F.concat(F.lit("## "), F.col("headline")), none, F.col("body"), none, F.lit("**Sources:**")]
    written = _line(2, order, none, F.lit("0"), text) + _line(2, order, none, F.lit("2"), [none])
    item = md.source_item(F.col("label"), md.source_day(F.col("published_at"), F.col("ingested_at")), " — %s")
    sources = stories.select("issue_id", "story_order", "kb_id", "cluster_id").join(cited, ["kb_id", "cluster_id"])
    sub = F.concat(F.lit("1"), F.lpad(F.col("rank").cast("string"), 6, "0"))
    return (
        framed.unionByName(_lines(stories, "issue_id", (F.lit(True), written)))
        .unionByName(_lines(sources, "issue_id", (F.lit(True), _line(2, order, none, sub, [item]))))
    )


def bodies(lines: DataFrame, key: str, part_lines: int = PART_LINES) -> DataFrame:
    """``key, part, body``: each document's text in parts of ``part_lines`` lines, numbered from 0. Reading the
    parts in order gives the whole text."""
    order = Window.partitionBy(key).orderBy(*LINE_ORDER)
    numbered = lines.withColumn("_n", F.row_number().over(order) - 1).withColumn("part", F.floor(F.col("_n") / part_lines).cast("int"))
    parts = gathered(numbered, [key, "part"], ["_n"], F.col("line"))
    return parts.select(key, "part", F.concat(F.array_join("items", "\n"), F.lit("\n")).alias("body"))


def cluster_brief(stories: DataFrame, entities: DataFrame, cited: DataFrame) -> DataFrame:
    """``kb_id, cluster_id, brief``: the material for writing one story.

    ``entities`` has the cluster's entities with ``first_rank``; ``cited`` its kept sources, which
    the cluster cap bounds, and with them the entities."""
    key = ["kb_id", "cluster_id"]
    block = F.concat(
        F.lit("### "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")\n"),
        F.coalesce(or_else(F.col("article"), F.col("summary")), F.lit("")),
    )
    about = gathered(entities, key, ["first_rank", "entity_id"], block).withColumnRenamed("n", "entity_count")
    item = md.source_item(F.col("label"), md.source_day(F.col("published_at"), F.col("ingested_at")), " (%s)")
    from_ = gathered(cited, key, ["rank"], item).withColumnRenamed("items", "citations").drop("n")
    joined = stories.select(*key).distinct().join(about, key, "left").join(from_, key)
    blocks = F.when(F.col("entity_count").isNull(), F.lit("")).otherwise(F.array_join("items", "\n\n"))
    tail = F.concat(F.lit("\n\n### Sources\n"), F.array_join("citations", "\n"), F.lit("\n"))
    return joined.select(*key, F.concat(blocks, tail).alias("brief"))


def list_issues(issues: DataFrame) -> DataFrame:
    """Issues with a body, with their slug and headline; sort by ``generated_at`` descending."""
    return issues.where("body IS NOT NULL").withColumns(
        {"slug": md.issue_slug(F.col("generated_at")), "headline": md.headline(F.col("body"))}
    )


def issues_by_slug(issues: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """The latest issue of each slug, or of the requested ones."""
    listed = list_issues(issues)
    if slugs is not None:
        listed = listed.join(slugs.select("slug").distinct(), "slug", "left_semi")
    latest = F.max_by(F.struct("issue_id", "generated_at", "headline", "body"), F.struct("generated_at", "issue_id"))
    return listed.groupBy("slug").agg(latest.alias("v")).select("slug", "v.*")
