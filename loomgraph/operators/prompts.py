"""Prompt columns for each model call.

The instruction texts are this library's own defaults and may be replaced; what the
operators rely on is the data laid out in them: vocabulary lines, numbered mention
blocks, candidate ids and evidence blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import markdown as md
from loomgraph.functions.text import is_blank, or_else, strip
from loomgraph.operators.skew import gathered

EXTRACT_GUIDE = (
    "Extract concrete, named things and what holds between them. Describe each so that a stranger to the text "
    "understands it, and write every relationship end exactly as the entity's name."
)
GUIDED_RULE = "Use the type names as given and no others."
DISCOVER_RULE = "Reuse a known type where one fits; coin a short new one only for something truly different."
RELEVANCE_RULE = "Say whether the content below is relevant under this instruction, and why, in one sentence."
RESOLVE_RULE = (
    "For each numbered mention return the id of the candidate that is certainly the same thing, or NEW when in doubt."
)
CONSOLIDATE_RULE = (
    "For each candidate answer 'existing' with the exact known name it means, 'new' with a clean name and a "
    "one-line description, or 'drop'."
)
CONSOLIDATE_CRITERION = {
    "entity": "An entity type is new only if its members deserve pages of their own.",
    "relationship": "A relationship type is new only if no known relation says the same.",
}
ARTICLE_RULE = "Keep the article about its subject, add what the new source tells, and give a short abstract."
STORY_RULE = "Write one story from the material below, in plain paragraphs, and a headline."
CLAIMS_RULE = (
    "List every claim of the document in order: text, quote, attributed_to, attribution_type, cited_source, "
    "cited_source_url, claim_type (empirical, predictive, normative or opinion) and checkworthiness from 0 to 1."
)
SUPPORT_RULE = "Find sources that bear on the claim, with url, title, snippet, stance and published_at; at most 8."
OPPOSE_RULE = "Find the strongest sources against the claim, with url, title, snippet, stance and published_at; at most 8."
JUDGE_RULE = "Judge the claim on the evidence below alone: supported, disputed, refuted or unverifiable, with confidence."


def type_lines(types: Column) -> Column:
    """``- name: description`` per type."""

    def line(t: Column) -> Column:
        described = or_else(strip(t.description))
        return F.concat(F.lit("- "), t["name"], F.coalesce(F.concat(F.lit(": "), described), F.lit("")))

    return F.array_join(F.transform(types, line), "\n")


def relevance(interests: Column, content: Column) -> dict[str, Column]:
    return {"system": F.concat(interests, F.lit(f"\n\n{RELEVANCE_RULE}")), "user": content}


def _lens(interests: Column) -> Column:
    return F.when(is_blank(interests), "").otherwise(F.concat(F.lit("Reader's interest: "), interests, F.lit("\n\n")))


def extraction(
    entity_types: Column, relationship_types: Column, content: Column, interests: Column, discover: Column
) -> dict[str, Column]:
    rule = F.when(discover, DISCOVER_RULE).otherwise(GUIDED_RULE)
    vocabulary = F.concat(
        F.lit("Entity types:\n"), type_lines(entity_types), F.lit("\nRelationship types:\n"), type_lines(relationship_types)
    )
    system = F.concat(_lens(interests), F.lit(f"{EXTRACT_GUIDE}\n"), rule, F.lit("\n\n"), vocabulary)
    return {"system": system, "user": content}


def consolidation(kind: str, candidates: DataFrame, jobs: DataFrame, types_column: str) -> DataFrame:
    """``kb_id, job_id, system, user``: one request per job with novel types. ``candidates`` has ``kb_id, job_id,
    type, example``; ``jobs`` the tenant's ``interests`` and type list."""
    shown = F.concat(
        F.lit("- "), F.col("type"), F.coalesce(F.concat(F.lit(' (e.g. "'), F.col("example"), F.lit('")')), F.lit(""))
    )
    listed = gathered(candidates, ["kb_id", "job_id"], ["type"], shown)

    def known(t: Column) -> Column:
        pinned = F.when(F.coalesce(t.pinned, F.lit(False)), " (fixed name)").otherwise("")
        return F.concat(F.lit("- "), t["name"], pinned, F.lit(": "), F.coalesce(t.description, F.lit("")))

    vocabulary = F.coalesce(or_else(F.array_join(F.transform(types_column, known), "\n")), F.lit("(no types so far)"))
    system = F.concat(
        F.lit(f"{CONSOLIDATE_RULE} {CONSOLIDATE_CRITERION[kind]}\nReader's interest: "), F.col("interests"),
        F.lit(f"\n\nKnown {kind} types:\n"), vocabulary,
    )
    user = F.concat(F.lit("Types to place:\n"), F.array_join("items", "\n"))
    return listed.join(jobs.select("kb_id", "job_id", "interests", types_column), ["kb_id", "job_id"]).select(
        "kb_id", "job_id", system.alias("system"), user.alias("user")
    )


def resolution(offered: DataFrame) -> DataFrame:
    """``kb_id, job_id, system, user``: one request per job, a numbered block per mention with candidates."""
    option = F.concat(
        F.lit("    - id="), F.col("id"), F.lit(": "), F.col("candidate_name"), F.lit(" — "), F.coalesce("candidate_summary", F.lit(""))
    )
    mention = ["kb_id", "job_id", "pos", "name", "type", "description"]
    blocks = gathered(offered, mention, ["rank"], option).withColumn(
        "block",
        F.concat(
            F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(") — "),
            F.coalesce("description", F.lit("")), F.lit("\n"), F.array_join("items", "\n"),
        ),
    )
    jobs = gathered(blocks.drop("items", "n"), ["kb_id", "job_id"], ["pos"], F.col("block"))
    return jobs.select("kb_id", "job_id", F.lit(RESOLVE_RULE).alias("system"), F.array_join("items", "\n\n").alias("user"))


def article(name: Column, type_: Column, existing: Column, news: Column) -> dict[str, Column]:
    subject = F.concat(F.lit("Subject: "), name, F.lit(" ("), type_, F.lit(")"))
    user = F.concat(subject, F.lit("\n\nExisting article:\n"), existing, F.lit("\n\nNew source:\n"), news)
    return {"system": F.concat(F.lit(f"{ARTICLE_RULE}\n"), subject), "user": user}


def story(brief: Column, beat: Column) -> dict[str, Column]:
    return {"system": F.trim(F.concat(F.lit(f"{STORY_RULE}\n\n"), beat)), "user": brief}


def claim_extraction(title: Column, text: Column) -> dict[str, Column]:
    header = F.coalesce(F.concat(F.lit("# "), or_else(title), F.lit("\n\n")), F.lit(""))
    return {"system": F.lit(CLAIMS_RULE), "user": F.concat(header, text)}


def _claim(text: Column, speaker: Column) -> Column:
    who = F.coalesce(or_else(speaker), F.lit(md.DEFAULT_SPEAKER))
    return F.concat(F.lit("Statement: "), text, F.lit("\nSaid by: "), who)


def research(text: Column, speaker: Column, context: Column, opposing: bool) -> dict[str, Column]:
    user = F.concat(_claim(text, speaker), F.lit("\n\nWhere it stands (no proof by itself):\n"), context)
    return {"system": F.lit(OPPOSE_RULE if opposing else SUPPORT_RULE), "user": user}


def judgment(text: Column, speaker: Column, evidence: Column) -> dict[str, Column]:
    return {"system": F.lit(JUDGE_RULE), "user": F.concat(_claim(text, speaker), F.lit("\n\nWhat was found:\n"), evidence)}


def evidence_text(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, evidence_text``: the pooled evidence of each claim as the judge reads it."""
    block = md.evidence_block(*(F.col(c) for c in ("stance", "title", "url", "published_at", "snippet")))
    listed = gathered(evidence, ["claim_id"], ["call", "pos"], block)
    shown = F.when(F.col("n").isNull(), md.NO_EVIDENCE).otherwise(F.array_join("items", "\n\n"))
    return claims.select("claim_id").join(listed, "claim_id", "left").select("claim_id", shown.alias("evidence_text"))
