"""Batch model inference as an operator.

A provider factory is any callable that returns a function from a list of requests to a
list of answers; it runs once per task. An answer is raw response text, or an
exception, which becomes that row's ``error``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import is_blank
from loomgraph.schemas import CLAIM_TYPES, TYPE_DECISIONS

Request = dict
Provider = Callable[[list[Request]], list]

RESPONSE = "choices ARRAY<STRUCT<finish_reason: STRING, message: STRUCT<content: STRING, annotations: STRING>>>"


def infer(
    requests: DataFrame, keys: list[str], factory: Callable[[], Provider], parallelism: int | None = None
) -> DataFrame:
    """``keys, answer, error`` for requests with ``system`` and ``user`` prompt columns.

    ``parallelism`` bounds the calls in flight: it is the number of tasks. Write the result
    out before branching on it, so that no call is made twice."""
    prompts = requests.select(*keys, "system", "user")
    if parallelism:
        prompts = prompts.repartition(parallelism)
    schema = T.StructType(
        [*(prompts.schema[k] for k in keys), T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for batch in batches:
            # A prompt that could not be built is a failed call, not a reason to stop.
            ready = batch["user"].notna()
            asked = batch[ready]
            answers = provider(asked[["system", "user"]].to_dict("records")) if len(asked) else []
            out = batch[keys].copy()
            out["answer"], out["error"] = None, None
            out.loc[~ready, "error"] = "prompt exceeds the model's input"
            for index, answer in zip(asked.index, answers, strict=True):
                if isinstance(answer, Exception):
                    out.at[index, "error"] = str(answer)
                else:
                    out.at[index, "answer"] = answer
            yield out

    return prompts.mapInPandas(run, schema)


def response_content(raw: Column) -> tuple[Column, Column, Column]:
    """(content, annotations, error) of a chat response in JSON."""
    parsed = F.from_json(raw, RESPONSE)
    choice = F.get(parsed.choices, 0)
    error = (
        F.when(F.coalesce(F.size(parsed.choices), F.lit(0)) < 1, "the answer holds no choice")
        .when(choice.finish_reason == "length", "the answer was cut off at its length limit")
        .when(is_blank(choice.message.content), "the answer is blank")
    )
    return F.when(error.isNull(), choice.message.content), choice.message.annotations, error


def parsed(answer: Column, schema: T.StructType, valid: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(typed answer, error): text that is not JSON of the schema, or that breaks ``valid``, is an error."""
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    value = F.from_json(answer, corrupt, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    good = answer.isNotNull() & value["_corrupt"].isNull() & F.coalesce(valid(value), F.lit(False))
    return F.when(good, value), F.when(~good, F.when(is_blank(answer), "empty response").otherwise("unparseable response"))


def _all(items: Column, check: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(items, lambda x: F.coalesce(check(x), F.lit(False))), F.lit(True))


# What a complete answer of each call site must carry.
def valid_relevance(v: Column) -> Column:
    return v.relevant.isNotNull() & v.reason.isNotNull()


def valid_extraction(v: Column) -> Column:
    named = _all(v.entities, lambda e: e["name"].isNotNull() & e.type.isNotNull() & e.description.isNotNull())
    return named & _all(
        v.relationships, lambda r: r.source_name.isNotNull() & r.target_name.isNotNull() & r.type.isNotNull()
    )


def valid_resolutions(v: Column) -> Column:
    return _all(v.resolutions, lambda r: r["index"].isNotNull() & r.id.isNotNull())


def valid_type_consolidation(v: Column) -> Column:
    return _all(v.decisions, lambda d: d.candidate.isNotNull() & d.decision.isin(*TYPE_DECISIONS))


def valid_article(v: Column) -> Column:
    return v.abstract.isNotNull() & v.article.isNotNull()


def valid_story(v: Column) -> Column:
    return v.headline.isNotNull() & v.body.isNotNull()


def valid_claims(v: Column) -> Column:
    return _all(
        v.claims, lambda c: c.text.isNotNull() & c.claim_type.isin(*CLAIM_TYPES) & c.checkworthiness.between(0.0, 1.0)
    )


def valid_research(v: Column) -> Column:
    return _all(v.evidence, lambda e: e.url.isNotNull() & e.stance.isNotNull())


def valid_judgment(v: Column) -> Column:
    return v.verdict.isNotNull() & v.rationale.isNotNull() & v.confidence.between(0.0, 1.0)
