"""Text clean-up as Column expressions."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.schemas import ABSTRACT_MAX_CHARS, CLAIM_CONTEXT_CHARS

# --- fixed values: patterns -----------------------------------------------------
# White space as Python's \s sees it, for Java regular expressions.
SPACE = r"[\s\x1c-\x1f]"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]"
SENTENCE_END = r"(?<=[.!?])" + SPACE
MARKUP_TAG = r"<[^>]+>"
# --- end of fixed values ----------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    Nested definitions would otherwise repeat the whole expression at every use and
    outgrow what code generation can compile."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Drop white space, Unicode kinds included, from both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def or_else(*options: Column) -> Column:
    """First option that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(option, F.lit("")) for option in options))


def normalize_name(c: Column) -> Column:
    """Key for comparing names: single spaces, no outer space, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " ")))


def type_key(c: Column) -> Column:
    """Key for comparing type names: upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), NOT_ALPHANUMERIC, "")


def sanitize(c: Column) -> Column:
    """Drop control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(c, CONTROL_CHARS, "")


@F.pandas_udf(StringType())
def _sanitize_json(documents: pd.Series) -> pd.Series:
    import json
    import re

    control = re.compile(CONTROL_CHARS)

    def clean(value):
        if isinstance(value, str):
            return control.sub("", value)
        if isinstance(value, list):
            return [clean(v) for v in value]
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items()}
        return value

    def one(document):
        try:
            return json.dumps(clean(json.loads(document)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return documents.map(one, na_action="ignore")


def sanitize_json(c: Column) -> Column:
    """``sanitize`` on every string value (never a key) of a JSON document; null for a text that is not JSON."""
    return _sanitize_json(c)


def first_sentence(c: Column, limit: int = ABSTRACT_MAX_CHARS) -> Column:
    """A cheap abstract: the first sentence, at most ``limit`` characters."""
    return F.substring(F.element_at(F.split(strip(c), rf"(?U){SENTENCE_END}", 2), 1), 1, limit)


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Replace HTML character references."""
    return _unescape(c)


def clean_title(c: Column) -> Column:
    """A feed title without markup and character references; null when nothing is left."""
    return F.nullif(strip(unescape(F.regexp_replace(c, MARKUP_TAG, ""))), F.lit(""))


def context_window(text: Column, quote: Column, size: int = CLAIM_CONTEXT_CHARS) -> Column:
    """The part of ``text`` around ``quote``, or its head when the quote is not in it."""
    half = size // 2

    def cut(at: Column) -> Column:
        start = F.greatest(at - half, F.lit(0))
        found = F.substring(text, start + 1, at + half - start)
        return F.when(at < 0, F.substring(text, 1, size)).otherwise(found)

    at = F.when(F.coalesce(quote, F.lit("")) == "", 0).otherwise(F.instr(text, quote)) - 1
    return F.coalesce(let(at, cut), F.lit(""))


def words(c: Column) -> Column:
    """Lower-cased letter and digit runs, the tokens of text search."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fit(c: Column, limit: int | None) -> tuple[Column, Column]:
    """(text of at most ``limit`` characters, whether something was cut off); without a limit the whole text."""
    if limit is None:
        return c, F.lit(False)
    return F.substring(c, 1, limit), F.coalesce(F.length(c) > limit, F.lit(False))
