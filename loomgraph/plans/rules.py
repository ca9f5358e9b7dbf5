"""Stand-ins for model providers that follow plain rules, for queries and tests."""

from __future__ import annotations

import json
import re

import regex

WORD = regex.compile(r"\p{Lu}\p{Ll}+")
KINDS = ("Person", "PERSON", "per-son")


def relevant_by_length():
    """Content is relevant unless its length divides by five."""
    return lambda asked: [json.dumps({"relevant": len(r["user"]) % 5 != 0, "reason": "by length"}) for r in asked]


def capitalised_words():
    """Every capitalised word is an entity, next to the one before it."""

    def answer(text: str) -> str:
        words = WORD.findall(text)
        entities = [{"name": w, "type": KINDS[len(w) % 3], "description": f"{w}. A word.", "aliases": []} for w in words]
        pairs = zip(words, words[1:], strict=False)
        return json.dumps(
            {
                "entities": entities,
                "relationships": [{"source_name": a, "target_name": b, "type": "NEAR"} for a, b in pairs],
            }
        )

    return lambda asked: [answer(r["user"]) for r in asked]


def same_name():
    """A mention is the candidate of exactly its name, if there is one."""

    def answer(prompt: str) -> str:
        chosen, place, name = [], None, ""
        for line in prompt.split("\n"):
            head = re.match(r"\[(\d+)\] (.*) \(", line)
            option = re.match(r"    - id=(.*?): (.*) — ", line)
            if head:
                place, name = int(head.group(1)), head.group(2)
            elif option and option.group(2).lower() == name.lower():
                chosen.append({"index": place, "id": option.group(1)})
        return json.dumps({"resolutions": chosen})

    return lambda asked: [answer(r["user"]) for r in asked]


def append_article():
    """The article grows by each new source."""

    def answer(prompt: str) -> str:
        old, new = prompt.split("\n\nExisting article:\n")[1].split("\n\nNew source:\n")
        return json.dumps({"abstract": new, "article": f"{old}|{new}" if old else new})

    return lambda asked: [answer(r["user"]) for r in asked]


def words_by_initial():
    """Every capitalised word is an entity of a kind named after its first letter, next to the one before it."""

    def answer(text: str) -> str:
        words = WORD.findall(text)
        entities = [{"name": w, "type": f"Kind {w[0]}", "description": f"{w}. A word.", "aliases": []} for w in words]
        pairs = zip(words, words[1:], strict=False)
        return json.dumps({"entities": entities, "relationships": [{"source_name": a, "target_name": b, "type": "NEAR"} for a, b in pairs]})

    return lambda asked: [answer(r["user"]) for r in asked]


def kinds_by_letter():
    """Of three kinds, one is new, one means persons, and one is dropped, by the code of its letter."""

    def answer(prompt: str) -> str:
        decided = []
        for line in prompt.split("\n")[1:]:
            kind = line.removeprefix("- ").partition(" (e.g.")[0]
            choice = ("drop", "new", "existing")[ord(kind[-1]) % 3]
            decided.append({"candidate": kind, "decision": choice, "canonical": "Person", "name": kind, "description": f"like {kind}"})
        return json.dumps({"decisions": decided})

    return lambda asked: [answer(r["user"]) for r in asked]


def counting_article():
    """The article counts its sources."""

    def answer(prompt: str) -> str:
        old, new = prompt.split("\n\nExisting article:\n")[1].split("\n\nNew source:\n")
        return json.dumps({"abstract": new, "article": str(int(old or 0) + 1)})

    return lambda asked: [answer(r["user"]) for r in asked]


def lines_as_claims():
    """Every line of a document is a claim; its place gives its kind and its length its weight."""
    kinds = ("empirical", "predictive", "normative", "opinion")

    def answer(text: str) -> str:
        lines = [line for line in text.split("\n") if line]
        claims = [{"text": x, "quote": x, "claim_type": kinds[i % 4], "checkworthiness": len(x) % 101 / 100} for i, x in enumerate(lines)]
        return json.dumps({"claims": claims})

    return lambda asked: [answer(r["user"]) for r in asked]


def _response(evidence: list[dict], cited: list[str]) -> str:
    notes = [{"type": "url_citation", "url_citation": {"url": u, "title": "t"}} for u in cited]
    message = {"content": json.dumps({"evidence": evidence}), "annotations": notes}
    return json.dumps({"choices": [{"finish_reason": "stop", "message": message}]})


def _found(stance: str, *paths: str) -> list[dict]:
    return [{"url": f"https://e.org/{p}", "title": p, "snippet": "s", "stance": stance, "published_at": ""} for p in paths]


def supports():
    """Two pages for every statement, one of them twice and one not really visited."""
    return lambda asked: [_response(_found("supports", "a", "a?utm_source=x", "b", "c"), ["https://e.org/a", "https://e.org/b"]) for _ in asked]


def opposes():
    """One page against every statement, and one that was not visited."""
    return lambda asked: [_response(_found("opposes", "a", "d"), ["https://e.org/a"]) for _ in asked]


def judges_by_length():
    """The verdict follows the length of the statement."""
    verdicts = ("supported", "refuted", "unverifiable")

    def answer(prompt: str) -> str:
        statement = prompt.partition("\n")[0].removeprefix("Statement: ")
        return json.dumps({"verdict": verdicts[len(statement) % 3], "confidence": 0.5, "rationale": "by length"})

    return lambda asked: [answer(r["user"]) for r in asked]


def story_of_sources():
    """A story tells how many sources it has."""

    def answer(prompt: str) -> str:
        n = prompt.partition("### Sources\n")[2].count("\n- ") + 1
        return json.dumps({"headline": "A story", "body": f"{n} sources"})

    return lambda asked: [answer(r["user"]) for r in asked]
