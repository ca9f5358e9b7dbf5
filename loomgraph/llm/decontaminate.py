"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may occur with up to ``e`` edits (6 % of ``m``). Cut into ``e + 1``
pieces, at least one piece of it stands unchanged in every such occurrence. One Aho-Corasick
automaton finds all pieces of a block of items in one pass over a text; each hit says where its item
would begin, and Myers' bit-parallel algorithm (JACM 1999) decides on the stretch around it.

The items are the stated query set: they are taken in blocks of bounded size, and every text meets
every block; no text is cut and none is compared with another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT_RATE = 0.06
# Shorter items leave no room for edits: they are looked for as they stand.
MIN_CHARS = 20
# Scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han): a word may end at any of their characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
# Characters of test items in one automaton; more items make more blocks.
BLOCK_CHARS = 2_000_000

MATCH = "array<struct<item_id: long, distance: int, start: int, stop: int>>"


def normalized(text: str | None) -> str:
    """Lower case, every run of white space one space."""
    return "" if text is None else " ".join(text.lower().split())


def _inside_word(text: str, at: int) -> bool:
    """Whether the place before ``text[at]`` is between two characters of one word."""
    if not 0 < at < len(text):
        return False
    sides = text[at - 1], text[at]
    return all(unicodedata.category(c)[0] in "LNM" and not UNSPACED.match(c) for c in sides)


def pieces(text: str, budget: int) -> Iterator[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places."""
    n, at = budget + 1, 0
    for i in range(n):
        end = len(text) * (i + 1) // n
        yield at, text[at:end]
        at = end


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of ``text`` (any prefix of it if ``anchored``), and
    where the first such one ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        if score < best:
            best, end = score, j + 1
        plus = (plus << 1 | anchored) & full
        up = (minus << 1 & full) | (full & ~(vertical | plus))
        down = plus & vertical
    return best, end


class Block:
    """Some test items, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int, short: bool = False):
        self.items = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalized(text)
            exact = len(text) < min_chars
            if not text or exact and not short:
                continue
            budget = 0 if exact else int(rate * len(text))
            for at, piece in pieces(text, budget):
                hits.setdefault(piece, []).append((len(self.items), at + len(piece) - 1))
            self.items.append((item_id, text, budget, exact, _masks(text), _masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """``item_id, distance, start, stop`` (code points of the normalised text) of the best occurrence of each item."""
        if not self.items:
            return []
        text = normalized(text)
        starts: dict[int, list[int]] = {}
        whole: dict[int, int] = {}
        for end, where in self.automaton.iter(text):
            for item, back in where:
                if not self.items[item][3]:
                    starts.setdefault(item, []).append(end - back)
                elif item not in whole and not _inside_word(text, end - back) and not _inside_word(text, end + 1):
                    whole[item] = end - back
        found = [(self.items[item][0], 0, at, at + len(self.items[item][1])) for item, at in whole.items()]
        for item, begins in starts.items():
            item_id, pattern, budget, _, masks, mirrored = self.items[item]
            m, best = len(pattern), None
            for low, high in _merged(sorted(begins), m + 2 * budget):
                low, high = max(0, low - budget), min(len(text), high + m + budget)
                distance, end = best_end(masks, m, text[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    back = text[max(low, low + end - m - budget) : low + end][::-1]
                    best = distance, low + end - best_end(mirrored, m, back, anchored=True)[1], low + end
            if best:
                found.append((item_id, *best))
        return sorted(found, key=lambda m: (m[0] is None, m[0] or 0, *m[1:]))


def _merged(begins: list[int], gap: int) -> Iterator[tuple[int, int]]:
    low = high = begins[0]
    for b in begins[1:]:
        if b - high > gap:
            yield low, high
            low = b
        high = b
    yield low, high


@lru_cache(maxsize=4)
def _block(key: str, rate: float, min_chars: int, short: bool, holder) -> Block:
    return Block(holder.value, rate, min_chars, short)


class _Held:
    """A broadcast list of items, compared by its key so that a worker builds each automaton once."""

    def __init__(self, key: str, shared):
        self.key, self.shared = key, shared

    @property
    def value(self):
        return self.shared.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items with a text, in blocks of about ``block_chars`` characters."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in block.orderBy("item_id", "text").collect()]


def matcher(docs: DataFrame, items: list[tuple[int | None, str]], rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, short: bool = False) -> Column:
    """Column of the matches of one block of items in ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    held = _Held(f"{shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)}", shared)
    names = ("item_id", "distance", "start", "stop")

    def find(texts: pd.Series) -> pd.Series:
        block = _block(held.key, rate, min_chars, short, held)
        return pd.Series([[dict(zip(names, m, strict=True)) for m in block.matches(t)] for t in texts], dtype=object)

    return F.pandas_udf(find, MATCH)(F.col("text"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, short: bool = False
) -> DataFrame:
    """``doc_id, item_id, distance, start, stop``: each test item that a document holds with at most
    ``rate`` of its length in edits, at its best (then first) place; code points of the normalised text.

    Items with fewer than ``min_chars`` characters match only on request (``short``), then as they stand and as whole
    words. Null, empty and blank texts and items match nothing; an item without id matches with a null ``item_id``; equal
    items all match; a repeated row gives repeated results; a null ``doc_id`` stays
    null; an empty table on either side gives an empty result; other columns are ignored."""
    found = None
    for items in item_blocks(benchmark, block_chars):
        hits = docs.select("doc_id", matcher(docs, items, rate, min_chars, short).alias("m")).select("doc_id", F.inline("m"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start int, stop int")
    return found


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, short: bool = False
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item, with or without id; short items as in ``contamination``."""
    for items in item_blocks(benchmark, block_chars):
        docs = docs.where(F.size(matcher(docs, items, rate, min_chars, short)) == 0)
    return docs
