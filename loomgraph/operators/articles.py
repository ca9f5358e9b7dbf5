"""Living articles: each mention of an entity rewrites what the previous one left."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import first_sentence, or_else
from loomgraph.operators import prompts
from loomgraph.operators.infer import Provider
from loomgraph.schemas import ABSTRACT_MAX_CHARS

OUTPUT = "kb_id string, entity_id string, summary string, article string"


def _settle(answer: object, existing: str, news: str) -> tuple[str, str]:
    """(abstract, article) of an answer; without a usable one, what is already known."""
    try:
        value = json.loads(answer)
        if isinstance(value["abstract"], str) and isinstance(value["article"], str):
            return value["abstract"], value["article"]
    except (TypeError, ValueError, KeyError):
        pass
    article = existing or news
    head = re.split(r"(?<=[.!?])\s", article.strip(), maxsplit=1)[0]
    return head[:ABSTRACT_MAX_CHARS], article


def fold_articles(mentions: DataFrame, factory: Callable[[], Provider], parallelism: int | None = None) -> DataFrame:
    """``kb_id, entity_id, summary, article`` after all mentions, in the order of ``batch_pos``.

    ``mentions`` has ``kb_id, entity_id, batch_pos, name, type, description, existing_article``. Every
    rewrite needs the one before it, so an entity's mentions run one after the other; rows
    stream through the task in batches and only the article at hand is kept. Rewrites of
    different entities go to the provider together."""
    keys = [F.col("kb_id"), F.col("entity_id")]
    placed = mentions.repartition(parallelism, *keys) if parallelism else mentions.repartition(*keys)
    ordered = placed.sortWithinPartitions("kb_id", "entity_id", "batch_pos").select(
        "kb_id", "entity_id", "name", "type", "description", "existing_article"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        state: dict[tuple, tuple[str, str]] = {}
        for batch in batches:
            entity = list(zip(batch.kb_id, batch.entity_id, strict=True))
            told = list(zip(batch.name, batch.type, batch.description, batch.existing_article, strict=True))
            # Wave n holds the n-th mention of every entity in the batch; each row is looked at once.
            waves: list[list[int]] = []
            seen: dict[tuple, int] = {}
            for i, key in enumerate(entity):
                turn = seen.get(key, 0)
                seen[key] = turn + 1
                if turn == len(waves):
                    waves.append([])
                waves[turn].append(i)
            for asked in waves:
                before, news, requests = [], [], []
                for i in asked:
                    name, kind, new, stored = told[i]
                    before.append(state.get(entity[i], ("", stored or ""))[1])
                    news.append(new or "")
                    subject = f"Subject: {name} ({kind})"
                    user = f"{subject}\n\nExisting article:\n{before[-1]}\n\nNew source:\n{news[-1]}"
                    requests.append({"system": f"{prompts.ARTICLE_RULE}\n{subject}", "user": user})
                for i, answer, old, new in zip(asked, provider(requests), before, news, strict=True):
                    state[entity[i]] = _settle(answer, old, new)
            if entity:
                # The last entity may go on in the next batch; the others are complete.
                last = entity[-1]
                done = [(*e, *v) for e, v in state.items() if e != last]
                state = {last: state[last]}
                yield pd.DataFrame(done, columns=["kb_id", "entity_id", "summary", "article"])
        yield pd.DataFrame([(*e, *v) for e, v in state.items()], columns=["kb_id", "entity_id", "summary", "article"])

    return ordered.mapInPandas(run, OUTPUT)


def latest_articles(mentions: DataFrame) -> DataFrame:
    """The same without a model: the first known text stays the article, as when every rewrite
    fails. An aggregate, so a hub entity costs no more than any other."""
    first = F.coalesce(or_else(F.max("existing_article")), F.min_by("description", "batch_pos"), F.lit(""))
    kept = mentions.groupBy("kb_id", "entity_id").agg(first.alias("article"))
    return kept.select("kb_id", "entity_id", first_sentence(F.col("article")).alias("summary"), "article")
