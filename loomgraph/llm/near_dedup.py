"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

One hash of each shingle fills all bins of a signature (Li et al., "One Permutation Hashing",
NIPS 2012); empty bins copy a bin chosen by a random walk of their own, which keeps every bin's
collision probability at the Jaccard similarity (Shrivastava, "Optimal Densification", ICML 2017).
128 bins make 32 bands of 4: two sets at similarity 0.75 share no band with probability 5e-6.

Documents with equal shingle sets are one node from the start. Candidate edges are stars: a node is compared
with one centre of its buckets only, so a bucket of ``n`` nodes gives at most ``n - 1`` edges. Nodes connected
by confirmed links need no further comparison, so what is left are pairs of one bucket in different components.
Two exact bounds settle nearly all of them. In the order of their frequency among the nodes left, two similar
sets share one of their first ``n - ceil(0.75 n) + 1`` shingles (prefix filter, Chaudhuri et al., ICDE 2006).
If the first shared one is rare, its short posting list gives the pair. If not, they share frequent
shingles only, and with ``c`` of those a pair reaches at most ``min(c, c') / (n + n' - min(c, c'))``; this is
asked per bucket and set size first, so nodes that can reach nobody meet nobody. What passes is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.llm import words as W
from loomgraph.llm.frames import map_arrays, map_rows
from loomgraph.operators.clustering import connected_components

SHINGLE = 5
BINS = 128
BAND = 4
STAR_ROUNDS = 1
PERCENT = 75
# A shingle of at most so many open nodes is rare: its nodes may be paired with each other.
RARE = 64

_WALKS = np.stack([np.random.Generator(np.random.PCG64(i)).permutation(BINS) for i in range(BINS)])
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's ``k``-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    hashes = W.hashes(W.utf8(text).lower())
    return np.unique(W.grams(hashes, min(k, len(hashes)))) if len(hashes) else hashes


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, empty bins filled by their walks."""
    at = np.searchsorted(shingles, _EDGES)
    filled = at < np.append(at[1:], len(shingles))
    out = np.zeros(BINS, np.uint64)
    out[filled] = shingles[at[filled]]
    empty = np.flatnonzero(~filled)
    if len(empty):
        walks = _WALKS[empty]
        out[empty] = out[walks[np.arange(len(empty)), filled[walks].argmax(axis=1)]]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One bucket id per band; the band's number is part of it."""
    rows = W.mix(sig).reshape(-1, BAND)
    h = np.arange(len(rows), dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for i in range(BAND):
        h = W.mix(h + rows[:, i] * np.uint64(0x9FB21C651E98DF25))
    return h


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        parts = np.array(
            [W.mix(shingles).sum(dtype=np.uint64), W.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64
        )
    return tuple(W.signed(parts).tolist())


def _sketch(rows: Iterator[tuple], k: int) -> Iterator[tuple]:
    for doc_id, text in rows:
        found = shingle_set(text, k)
        if len(found):
            yield doc_id, len(found), *_identity(found), W.signed(bands(signature(found)))
        else:
            yield doc_id, 0, None, None, None


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, buckets`` of each row; (s1, s2) names the shingle set."""
    return map_rows(
        docs.select("doc_id", "text"), lambda rows: _sketch(rows, k), "doc_id long, n_shingles long, s1 long, s2 long, buckets array<long>"
    )


def _compare(rows: Iterator[tuple], k: int, percent: int) -> Iterator[list]:
    """Linked pairs among (a, b, text of a, text of b); rows come ordered by b, whose set is kept."""
    last, kept = None, None
    for a, b, left, right in rows:
        if b != last or kept is None:
            last, kept = b, shingle_set(right, k)
        mine = shingle_set(left, k)
        if 100 * min(len(mine), len(kept)) < percent * max(len(mine), len(kept)):
            continue
        common = len(np.intersect1d(mine, kept, assume_unique=True))
        if 100 * common >= percent * (len(mine) + len(kept) - common) > 0:
            yield [[a], [b]]


def confirm(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` of nodes whose full shingle sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").sortWithinPartitions("b")
    return map_arrays(both, lambda rows: _compare(rows, k, percent), "a long, b long")


def _own_text(rows: Iterator[tuple], k: int) -> Iterator[tuple]:
    for node, s1, s2, text in rows:
        if _identity(shingle_set(text, k)) == (s1, s2):
            yield node, text


def _components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node with a link."""
    edges = links.select(F.lit("").alias("kb_id"), F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = connected_components(edges)
    return durable.cut(found.select(F.col("job_id").alias("node"), F.col("cluster_id").alias("comp")))


def _open_members(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members of buckets that still hold more than one component, with their component."""
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    return placed.join(mixed, "bucket", "left_semi")


def _star(members: DataFrame, tested: DataFrame | None, turn: int) -> DataFrame:
    """For each node the one centre it shares most buckets with. At first a bucket's centre is the node that shares
    buckets with the most others, later one drawn at random by bucket and turn."""
    rank = -F.col("weight") if turn == 0 else F.xxhash64("bucket", "node", F.lit(turn))
    draw = F.struct(rank, "node", "comp")
    centre = members.groupBy("bucket").agg(F.min(draw).alias("c")).select("bucket", F.col("c.node").alias("b"), F.col("c.comp").alias("centre_comp"))
    edges = members.join(centre, "bucket").where("comp <> centre_comp").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    if tested is not None:
        edges = edges.join(tested, ["a", "b"], "left_anti")
    return edges.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _shingle_rows(rows: Iterator[tuple], k: int) -> Iterator[list]:
    for node, text in rows:
        found = shingle_set(text, k)
        yield [np.full(len(found), node), W.signed(found)]


def _rest(members: DataFrame, texts: DataFrame, tested: DataFrame, k: int, percent: int, rare: int = RARE) -> tuple[DataFrame, dict[str, int]]:
    """The pairs in different components that no star has compared and that the bounds let through; and their number."""
    sizes = durable.cut(members.select("node", "comp", "n").distinct())
    asked = texts.join(sizes.select("node"), "node", "left_semi").select("node", "text")
    shingles = durable.cut(map_arrays(asked, lambda rows: _shingle_rows(rows, k), "node long, shingle long"))
    few = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") <= rare)
    # Rare shingles come first in the order, so their rank among themselves is their rank among all.
    order = Window.partitionBy("node").orderBy("times", "shingle")
    ranked = durable.cut(shingles.join(few, "shingle").withColumn("rank", F.row_number().over(order)))
    durable.drop(shingles)

    counts = ranked.groupBy("node").agg(F.count(F.lit(1)).alias("few"))
    common = sizes.join(counts, "node", "left").withColumn("c", F.col("n") - F.coalesce("few", F.lit(0)))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    early = ranked.where("times > 1").join(sizes, "node").where(F.col("rank") <= prefix).select("shingle", "node", "comp", "n")
    one, other = (early.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "n"))) for x in "ab")
    near = (F.col("comp_a") != F.col("comp_b")) & (F.col("node_a") < F.col("node_b"))
    near &= 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    by_rare = one.join(other, "shingle").where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    def within(c, other_c, n, other_n):
        return (100 + percent) * F.least(F.col(c), F.col(other_c)) >= percent * (F.col(n) + F.col(other_n))

    able = common.where(F.col("c") * 100 >= F.col("n") * percent).select("node", "c")
    nodes = durable.cut(members.join(able, "node").select("bucket", "node", "comp", "n", "c"))
    groups = nodes.groupBy("bucket", F.col("n").alias("n_b")).agg(F.max("c").alias("c_b"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    elsewhere = (F.col("low") != F.col("comp")) | (F.col("high") != F.col("comp"))
    reach = nodes.join(groups, "bucket").where(within("c", "c_b", "n", "n_b") & elsewhere)
    reach = reach.select("bucket", "n_b", F.col("node").alias("a"), F.col("comp").alias("comp_a"), "n", "c")
    partner = nodes.select("bucket", F.col("n").alias("n_b"), F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("c").alias("c_b"))
    apart = (F.col("comp_a") != F.col("comp_b")) & (F.col("a") < F.col("b"))
    by_frequent = reach.join(partner, ["bucket", "n_b"]).where(apart & within("c", "c_b", "n", "n_b")).select("a", "b")

    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, counted = durable.cut_counted(by_rare.unionByName(by_frequent).distinct().join(known, ["a", "b"], "left_anti"))
    for table in (sizes, ranked, nodes):
        durable.drop(table)
    return pairs, counted


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, rounds: int = STAR_ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Rows are linked when their sets of ``k``-word shingles have a Jaccard similarity of at least
    ``percent`` per cent; ``component_id`` is the smallest id reachable by links, and ``kept``
    is true for the row with that id. Texts with fewer than ``k`` words are one shingle; null, empty
    and blank texts have none, are linked with nothing and are kept. Equal sets form one node, named by
    their smallest id. Repeated rows share all results; a null id never names a component, and
    where nothing else does, ``component_id`` is null and ``kept`` true; other columns are ignored."""
    found = durable.cut(sketches(docs, k))
    sets = found.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    # All rows of one set have the same buckets: those of the named row are enough.
    named = found.join(sets.withColumnRenamed("node", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["s1", "s2"])
    nodes = durable.cut(named.withColumnRenamed("doc_id", "node"))
    drawn = durable.cut(found.drop("buckets"))
    durable.drop(found)
    sets = nodes.select("s1", "s2", "node")
    buckets = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    held = durable.cut(buckets.join(shared, "bucket"))
    weights = held.groupBy("node").agg(F.sum("held").alias("weight"))
    members = durable.cut(held.join(weights, "node").select("bucket", "node", "n", "weight"))
    durable.drop(held)
    asked = nodes.select("node", "s1", "s2").join(members.select("node").distinct(), "node", "left_semi")
    rows = docs.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("node")).select("node", "s1", "s2", "text")
    texts = durable.cut(map_rows(rows, lambda r: _own_text(r, k), "node long, text string").dropDuplicates(["node"]))

    tested = links = comps = None
    for turn in range(rounds):
        edges, counted = durable.cut_counted(_star(_open_members(members, comps), tested, turn))
        if not counted["n"]:
            break
        tested = edges if tested is None else tested.unionByName(edges)
        new = durable.cut(confirm(edges, texts, k, percent))
        links = new if links is None else links.unionByName(new)
        comps = _components(links)
    else:
        still = durable.cut(_open_members(members, comps))
        durable.drop(members)
        edges, counted = _rest(still, texts, tested, k, percent)
        durable.drop(still)
        if counted["n"]:
            comps = _components(links.unionByName(confirm(edges, texts, k, percent)))
    durable.drop(texts)

    named = sets if comps is None else sets.join(comps, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("node"))
    out = drawn.join(named, ["s1", "s2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept")
    )


def one_of_each_group(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each group the row with the smallest id stays, and of
    repeated rows (same id and text) one.

    Rows are told apart by id and text, so an id shared by different texts costs none of them; a row without id counts
    as one with an id above all others. Rows that go are few beside those that stay, so they alone are looked up."""
    key, name = F.xxhash64("doc_id", "text"), "_key"
    while name in docs.columns:
        name = f"_{name}"
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), k, percent)
    none = F.lit(None).cast("long")
    groups = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"), none.alias("id"), F.lit(1).alias("n"))
    ids = docs.select(key.alias("key"), none.alias("group"), F.col("doc_id").alias("id"), F.lit(0).alias("n"))
    texts = groups.unionByName(ids).groupBy("key").agg(F.max("group").alias("group"), F.max("id").alias("id"), F.sum("n").alias("n"))
    texts = durable.cut(texts)
    first = texts.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key")).alias("first")).select("first.key", F.lit(True).alias("stays"))
    marks = texts.join(first, "key", "left").where("stays is null or n > 1").select(F.col("key").alias(name), F.col("stays").isNotNull().alias("stays"))
    marks, counted = durable.cut_counted(marks, several=F.col("stays"))
    durable.drop(texts)
    left = docs.join(marks.select(name), key == marks[name], "left_anti")
    if not counted["several"]:
        return left
    repeated = docs.join(marks.where("stays").select(name), key == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.unionByName(repeated)
