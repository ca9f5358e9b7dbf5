"""Hard negatives by exact inner products of Kronecker-packed vectors.

Components are integers. With a bias that makes them non-negative, the components of several candidates fit side by side
into the fields of one wide integer; one multiplication by an anchor's component multiplies all of them, and the sum over
the components holds each candidate's exact product in its own field (Kronecker substitution). Fields are as wide as the
largest possible sum of the given data, so none ever reaches into the next one. Two or more fields share a double (exact up to
53 bits, and multiplied as matrices) or a 64-bit integer; where not even two fit, integers as wide as needed take over.

Anchors are the stated query set: blocks of anchors meet blocks of all rows, spread over cells by an ordinary join, and a
block hands on only what may be among an anchor's first few. Positives are found first; their scores bound the negatives,
which a second pass over the same blocks finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.llm.frames import map_rows
from loomgraph.llm.vector_codes import arrays, common_size, scaled, sound
from loomgraph.operators.skew import top_per_key

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# Negatives score from 30 to 90 per cent of the positive.
LOW, HIGH = 30, 90
# Rows of one block of candidates (fewer for small tables) and of one block of anchors.
CANDIDATE_ROWS = 65_536
ANCHOR_ROWS = 512
# Every block of candidates gets a copy of all anchors: no more blocks than this before they are full.
BLOCKS = 128
_SLICE = 4096

_BLOCK = "block long, ids binary, labels binary, x binary, keys binary, given binary, scores binary"


@dataclass(frozen=True)
class Packing:
    """How candidates lie in wide integers: ``size`` components from ``low`` on, ``fields`` of ``bits`` bits each."""

    size: int
    low: int
    bits: int
    fields: int
    kind: type

    @staticmethod
    def of(size: int, low: int, high: int) -> Packing:
        bits = max(1, (size * (high - low) ** 2).bit_length())
        for kind, room in ((np.float64, 53), (np.uint64, 64)):
            if room // bits > 1:
                return Packing(size, low, bits, room // bits, kind)
        return Packing(size, low, bits, 8, object)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Rows of components as rows of wide integers, ``fields`` candidates in each."""
        whole = -(-len(x) // self.fields) * self.fields
        biased = np.zeros((whole, self.size), object if self.kind is object else np.uint64)
        biased[: len(x)] = x - self.low
        shifted = biased.reshape(-1, self.fields, self.size)
        word = shifted[:, 0].copy()
        for f in range(1, self.fields):
            word += shifted[:, f] << (self.bits * f if self.kind is object else np.uint64(self.bits * f))
        return word.astype(self.kind)

    def scores(self, words: np.ndarray, x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Inner products of candidates ``x`` (packed as ``words``) and anchors, one row per candidate."""
        total = words @ (anchors - self.low).astype(self.kind).T
        wide = object if self.kind is object else np.uint64
        total = total.astype(wide)
        out = np.empty((len(words), self.fields, len(anchors)), object if self.kind is object else np.int64)
        for f in range(self.fields):
            shift, mask = self.bits * f, (1 << self.bits) - 1
            out[:, f] = total >> shift & mask if self.kind is object else total >> np.uint64(shift) & np.uint64(mask)
        out = out.reshape(-1, len(anchors))[: len(x)]
        sums = x.astype(out.dtype).sum(axis=1)[:, None] + anchors.astype(out.dtype).sum(axis=1)
        return out + self.low * sums - self.size * self.low * self.low


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a partition as blocks of at most ``rows``, the columns side by side as bytes."""
    number = TaskContext.get().partitionId() << 32
    held: list[dict[str, np.ndarray]] = []
    n = 0

    def block():
        joined = {name: np.concatenate([h[name] for h in held]).tobytes() for name in held[0]}
        return pa.RecordBatch.from_arrays([pa.array([number if f.name == "block" else joined.get(f.name)], f.type) for f in arrow], schema=arrow)

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            while part.num_rows:
                piece = part.slice(0, rows - n)
                part = part.slice(piece.num_rows)
                of = {"ids": "vec_id", "labels": "label", "keys": "key"}
                held.append({k: piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for k, c in of.items() if c in piece.schema.names})
                held[-1]["x"] = arrays(piece, "x").astype(np.int64)
                held[-1] |= {c: arrays(piece, c) for c in ("given", "scores") if c in piece.schema.names}
                n += piece.num_rows
                if n == rows:
                    yield block()
                    held, n, number = [], 0, number + 1
    if n:
        yield block()


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """Blocks of at most ``n`` rows ``vec_id, label, x``, of anchors also ``key`` and lists ``given, scores``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(_BLOCK)
    arrow = to_arrow_schema(parsed)
    return rows.mapInArrow(lambda batches: _blocks(batches, n, arrow), parsed)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` ids by falling score, then id; an id that repeats counts at its best."""
    at = np.arange(len(ids))
    if len(ids) > 4 * k:
        # With so many scores at least as high, repeated ids aside, nothing below can be among the first.
        least = np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k]
        high = np.flatnonzero(scores >= least)
        if len(np.unique(ids[high])) >= k:
            at = high
    order = at[np.lexsort((ids[at], -scores[at]))]
    _, firsts = np.unique(ids[order], return_index=True)
    return order[np.sort(firsts)[:k]]


def _meetings(rows: Iterator[tuple], packing: Packing):
    """For each pair of blocks: candidates' ids, labels and scores, by slices, and the anchors' columns."""
    kept: dict[int, list] = {}
    for block, ids, labels, x, a_ids, a_labels, a_x, keys, given, scores in rows:
        if block not in kept:
            every = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(x, np.int64).reshape(-1, packing.size)
            kept = {block: [(i, v, c, packing.pack(c)) for i, v, c in zip(*(np.split(e, range(_SLICE, len(e), _SLICE)) for e in every), strict=True)]}
        anchors = [np.frombuffer(c, np.int64) for c in (a_ids, a_labels, keys)]
        a_x = np.frombuffer(a_x, np.int64).reshape(-1, packing.size)
        lists = [np.frombuffer(c, np.int64).reshape(len(a_x), -1) for c in (given, scores)] if given is not None else None
        product = np.concatenate([packing.scores(w, c, a_x) for _, _, c, w in kept[block]])
        yield np.concatenate([s[0] for s in kept[block]]), np.concatenate([s[1] for s in kept[block]]), product, anchors, lists


def _positives(rows: Iterator[tuple], packing: Packing, k: int) -> Iterator[tuple]:
    for ids, labels, product, (a_ids, a_labels, keys), _ in _meetings(rows, packing):
        alike = {label: np.flatnonzero(labels == label) for label in np.unique(a_labels)}
        for i, (anchor, label, key) in enumerate(zip(a_ids.tolist(), a_labels.tolist(), keys.tolist(), strict=True)):
            others = alike[label][ids[alike[label]] != anchor]
            scores = product[others, i]
            for p in _first(scores, ids[others], k):
                yield anchor, key, int(ids[others[p]]), int(scores[p])


def _negatives(rows: Iterator[tuple], packing: Packing, k: int, low: int, high: int) -> Iterator[tuple]:
    for ids, labels, product, (a_ids, a_labels, keys), (given, best) in _meetings(rows, packing):
        unlike = {label: np.flatnonzero(labels != label) for label in np.unique(a_labels)}
        for i, (anchor, label, key) in enumerate(zip(a_ids.tolist(), a_labels.tolist(), keys.tolist(), strict=True)):
            others = unlike[label]
            scores = product[others, i]
            for positive, score in zip(given[i].tolist(), best[i].tolist(), strict=True):
                # low * p <= 100 * n <= high * p, in whole numbers; nothing for a negative p.
                least, most = -(-low * score // 100), high * score // 100
                fitting = np.flatnonzero((scores >= least) & (scores <= most))
                for q in _first(scores[fitting], ids[others[fitting]], k):
                    found = fitting[q]
                    yield anchor, key, positive, score, int(ids[others[found]]), int(scores[found])


def _met(candidates: DataFrame, anchors: DataFrame, cells: int) -> DataFrame:
    """Every block of anchors beside every block of candidates; each cell holds about one block of candidates.

    The anchors' copies, one for each cell, are dealt out by a shuffle: as one table they would go through the driver."""
    here = candidates.select("block", "ids", "labels", "x", F.pmod(F.xxhash64("block"), F.lit(cells)).alias("cell"))
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")
    there = anchors.select(F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("x").alias("a_x"), "keys", "given", "scores", cell)
    return here.hint("merge").join(there, "cell").select("block", "ids", "labels", "x", "a_ids", "a_labels", "a_x", "keys", "given", "scores")


def relabelled(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` where every seventh id has the next of ten labels."""
    label = F.col("label")
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def mined(
    embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    candidate_rows: int = CANDIDATE_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``embeddings`` (``vec_id,
    embedding, label``) whose ``vec_id`` is divisible by ``every``.

    Components count as ``floor(256 * x)``, scores are inner products. An anchor's positives are the ``positives`` best other
    rows of its label; of each, the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` per cent of
    the positive's follow. Higher scores come first, then smaller ids. Rows without id, label or vector, or with a
    null or non-finite component, take no part, nor do vectors that are not as long as most (of two lengths equally
    frequent, the longer counts). Components beyond a million in size count as a million. Repeated
    rows count once; of an id with several different rows each is an anchor, and as positive or negative the id
    counts once, with its best (fitting) score. An anchor without positives, and a positive without negatives, give no
    rows; an empty table gives an empty result. Other columns are ignored."""
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("v")))
    size, n = common_size(rows, "v")
    rows = rows.where(F.size("v") == size).select("vec_id", "label", scaled(F.col("v"), SCALE).alias("x"))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchor = F.col("vec_id") % every == 0
    bounds = rows.agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"), F.count_if(anchor).alias("n")).first()
    if not n or not bounds.n:
        return embeddings.sparkSession.createDataFrame([], result)
    packing = Packing.of(size, bounds.low, bounds.high)
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, min(candidate_rows, max(1024, -(-n // min(2 * tasks, BLOCKS)))))
    candidates = durable.cut(blocks(rows, block))
    cells = -(-n // block)

    key = F.xxhash64("label", "x").alias("key")
    asked = durable.cut(rows.where(anchor).select("vec_id", "label", "x", key).distinct())
    few = -(-bounds.n // anchor_rows)
    met = _met(candidates, blocks(asked.coalesce(few), anchor_rows), cells)
    found = map_rows(met, lambda r: _positives(r, packing, positives), "anchor long, key long, given long, score long")
    best = found.groupBy("anchor", "key", "given").agg(F.max("score").alias("score"))
    best = top_per_key(best, ["anchor", "key"], [F.desc("score"), F.col("given")], positives)
    # At most ``positives`` of each; shorter lists are filled up with a score that no negative fits.
    pair = F.sort_array(F.collect_list(F.struct("rank", "given", "score")))
    lists = best.groupBy("anchor", "key").agg(pair.alias("p")).withColumnsRenamed({"anchor": "vec_id"})
    filled = lambda c, v: F.slice(F.concat(F.col(f"p.{c}"), F.array_repeat(F.lit(v).cast("long"), positives)), 1, positives).alias(c)
    lists = lists.select("vec_id", "key", filled("given", -1), filled("score", -1).alias("scores"))
    asked = durable.cut(asked.join(lists, ["vec_id", "key"]).select("vec_id", "label", "x", "key", "given", "scores"))

    met = _met(candidates, blocks(asked.coalesce(few), anchor_rows), cells)
    schema = "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = map_rows(met, lambda r: _negatives(r, packing, negatives, low, high), schema)
    keys = ["anchor_id", "key", "positive_id", "positive_score"]
    best = found.groupBy(*keys, "negative_id").agg(F.max("negative_score").alias("negative_score"))
    ranked = top_per_key(best, keys, [F.desc("negative_score"), F.col("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
