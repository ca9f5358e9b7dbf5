"""Text of issues and reports as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import or_else
from loomgraph.schemas import (
    CHECKABLE_CLAIM_TYPE,
    CHECKWORTHINESS_MIN,
    SLUG_MAX_CHARS,
    STANCE_LABELS,
    VERIFY_MAX_PER_DOCUMENT,
)

# --- fixed values: output formats -----------------------------------------------
ISSUE_SLUG = "yyyy-MM-dd-HHmm"
REPORT_STAMP = "yyyy-MM-dd-HHmmss"
HEADLINE = r"(?m)^##\s+(.+?)\s*$"
NO_HEADLINE = "Untitled issue"
NO_LABEL = "untitled"
NO_STORIES = "No new stories in this window."
NO_VERDICTS = "none checked"
NO_EVIDENCE = "(no evidence was found)"
DEFAULT_SPEAKER = "the article"
NOT_CHECKED = "could not be checked: "
UNKNOWN_ERROR = "unknown error"
BELOW_FLOOR = "below the checkworthiness floor (%s)"
CROWDED_OUT = f"not among the {VERIFY_MAX_PER_DOCUMENT} most checkworthy claims"
# --- end of fixed values ----------------------------------------------------------


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def source_day(published_at: Column, ingested_at: Column) -> Column:
    """The date a source is cited with, '' when none is known."""
    return F.coalesce(day(F.coalesce(published_at, ingested_at)), F.lit(""))


def two_decimals(c: Column) -> Column:
    """Rounded on the exact binary value, halves to even."""
    return F.format_number(c, 2)


def issue_slug(generated_at: Column) -> Column:
    return F.date_format(generated_at, ISSUE_SLUG)


def headline(body: Column) -> Column:
    """First second-level heading of an issue."""
    return F.coalesce(F.nullif(F.regexp_extract(body, HEADLINE, 1), F.lit("")), F.lit(NO_HEADLINE))


def report_slug(title: Column, url: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(or_else(title), url)), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, SLUG_MAX_CHARS)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("document"))


def report_name(title: Column, url: Column, generated_at: Column) -> Column:
    """File stem of a report."""
    return F.concat_ws("-", report_slug(title, url), F.date_format(generated_at, REPORT_STAMP))


def unchecked_reason(selected: Column, claim_type: Column, score: Column, error: Column) -> Column:
    """Why a claim carries no verdict."""
    failed = F.concat(F.lit(NOT_CHECKED), F.coalesce(or_else(error), F.lit(UNKNOWN_ERROR)))
    weak = F.format_string(BELOW_FLOOR, two_decimals(score))
    crowded = F.lit(CROWDED_OUT)
    return (
        F.when(selected, failed)
        .when(claim_type != CHECKABLE_CLAIM_TYPE, claim_type)
        .when(score < CHECKWORTHINESS_MIN, weak)
        .otherwise(crowded)
    )


def attribution(speaker: Column, kind: Column, cited: Column, cited_url: Column) -> Column:
    """Who asserts a claim, and on what source."""
    who = F.concat(F.lit("Attributed to "), F.coalesce(or_else(speaker), F.lit(DEFAULT_SPEAKER)))
    how = F.coalesce(F.concat(F.lit(" ("), F.replace(or_else(kind), F.lit("_"), F.lit(" ")), F.lit(")")), F.lit(""))
    link = F.coalesce(F.concat(F.lit("["), cited, F.lit("]("), or_else(cited_url), F.lit(")")), cited)
    return F.concat_ws(" · ", F.concat(who, how), F.when(or_else(cited).isNotNull(), F.concat(F.lit("citing "), link)))


def verdict_line(verdict: Column, confidence: Column) -> Column:
    bold = F.concat(F.lit("**"), F.upper(F.substring(verdict, 1, 1)), F.lower(F.substring(verdict, 2, 1000)), F.lit("**"))
    return F.coalesce(F.concat(bold, F.lit(" · confidence "), two_decimals(confidence)), bold)


def evidence_line(stance: Column, title: Column, url: Column, snippet: Column) -> Column:
    label = stance
    for value, shown in STANCE_LABELS.items():
        label = F.when(stance == value, shown).otherwise(label)
    quoted = F.coalesce(F.concat(F.lit(' — "'), or_else(snippet), F.lit('"')), F.lit(""))
    return F.concat(
        F.lit("- **"), label, F.lit(":** ["), F.coalesce(or_else(title), url), F.lit("]("), url, F.lit(")"), quoted
    )


def evidence_block(stance: Column, title: Column, url: Column, published: Column, snippet: Column) -> Column:
    """One piece of evidence as the judge reads it."""
    dated = F.coalesce(F.concat(F.lit(" ("), or_else(published), F.lit(")")), F.lit(""))
    return F.concat(
        F.lit("["), stance, F.lit("] "), F.coalesce(or_else(title), F.lit(NO_LABEL)), F.lit(" — "), url, dated,
        F.lit("\n"), F.coalesce(snippet, F.lit("")),
    )


def byline(url: Column, author: Column, published_at: Column, checked_at: Column) -> Column:
    return F.concat_ws(
        " · ",
        or_else(url),
        or_else(author),
        F.concat(F.lit("published "), day(published_at)),
        F.concat(F.lit("checked "), day(checked_at)),
    )


def source_item(label: Column, date: Column, dated: str) -> Column:
    """A cited source; ``dated`` is the pattern for its date, such as " (%s)"."""
    before, after = dated.split("%s")
    shown = F.when(date != "", F.concat(F.lit(before), date, F.lit(after))).otherwise("")
    return F.concat(F.lit("- "), F.coalesce(or_else(label), F.lit(NO_LABEL)), shown)
