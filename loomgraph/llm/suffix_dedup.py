"""Byte-exact repeats from a suffix array to a fixed depth, built in blocks over a difference cover.

A cover of period ``v`` is a set of residues in which every difference modulo ``v`` occurs (Burkhardt & Kärkkäinen,
CPM 2003). For any two places of the corpus one of the next ``v`` steps therefore leads both to places of the sample,
those whose residue is in the cover. Two suffixes that agree on 400 bytes agree at such a pair of sample places on the
first ``400 - v + 1`` bytes: the long tie is settled by the ranks of the sample, and only the few bytes around it are
left to compare. Nothing longer than a window is ever sorted (cf. Kärkkäinen, "Fast BWT in small space by blockwise
suffix sorting", TCS 2007).

1. Texts are packed into blocks of a bounded size. The sample suffixes of all blocks are dealt into buckets, and one
   bucket at a time is sorted and ranked. Only ranks that tie matter: a suffix without a tied sample place among its
   next ``v`` is unlike all others and is never looked at again.
2. A tied place is extended both ways as far as a window that starts up to ``v - 1`` bytes before it can reach. Places
   of one rank with equal extensions repeat as a whole.
3. Where some extension of a rank stands alone, a match ends inside it: only there the suffixes themselves are sorted,
   those of one specimen of each repeated extension among them.

The order of the suffixes is that of hashes of their first bytes, not the alphabet's: repeats are neighbours in any
order, and hashes deal evenly into buckets whatever the text. Ranks are 64 bits and always confirmed by an independent
64-bit hash of the whole extension; whole windows are told apart by 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.llm.frames import map_arrays, map_rows
from loomgraph.llm.words import STRETCH, mix, signed, utf8

# Bytes of text in one block, unless a single text has more, and texts in one; sample suffixes sorted at a time.
BLOCK_BYTES = 1 << 20
BLOCK_TEXTS = 20_000
BUCKET_SUFFIXES = 1_000_000
# Rows handed back to Spark at a time.
OUT_ROWS = 32_768


@dataclass(frozen=True)
class Cover:
    """Windows of ``window`` bytes over sample places whose residues modulo ``period`` are ``places``."""

    window: int
    period: int
    places: tuple[int, ...]

    def __post_init__(self):
        reached = {(a - b) % self.period for a in self.places for b in self.places}
        if len(reached) < self.period or self.window < self.period:
            raise ValueError("the places do not cover all differences, or a window is shorter than the period")

    @property
    def depth(self) -> int:
        """Bytes by which sample suffixes are ranked."""
        return self.window - self.period + 1


# A perfect difference set, in which each difference modulo 57 occurs once.
COVER = Cover(400, 57, (0, 1, 3, 13, 32, 36, 43, 52))

_KEYS = np.random.Generator(np.random.PCG64(20260303)).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    kept = _powers.get((seed, inverse))
    if kept is None or len(kept) < n:
        base = pow(_BASES[seed], -1, 2**64) if inverse else _BASES[seed]
        size = 1 << max(12, (n - 1).bit_length())
        kept = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        _powers[seed, inverse] = kept
    return kept[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """One uint64 per span of bytes; ``start`` ascends. Worked out a stretch of the text at a time."""
    size = np.broadcast_to(np.asarray(size, np.int64), start.shape)
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = int(np.searchsorted(start, low + STRETCH))
        a, n = start[at:to] - low, size[at:to]
        part = data[low : low + int((a + n).max())]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_KEYS[seed][part] * _power(seed, len(part)), dtype=np.uint64, out=sums[1:])
        out[at:to] = (sums[a + n] - sums[a]) * _power(seed, len(sums), inverse=True)[a]
        at = to
    return mix(out + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _blocks(rows: Iterator[tuple], block_bytes: int) -> Iterator[tuple]:
    number = TaskContext.get().partitionId() << 32
    ids, sizes, parts, held = [], [], [], 0
    for doc_id, text in rows:
        data = utf8(text)
        if held and held + len(data) > block_bytes or len(ids) >= BLOCK_TEXTS:
            yield number, held, ids, sizes, _packed(b"".join(parts))
            number += 1
            ids, sizes, parts, held = [], [], [], 0
        ids.append(doc_id)
        sizes.append(len(data))
        parts.append(data)
        held += len(data)
    if ids:
        yield number, held, ids, sizes, _packed(b"".join(parts))


def _packed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=5).compress(data, asbytes=True) if data else b""


def _unpacked(data: bytes, sizes: list[int]) -> np.ndarray:
    n = sum(sizes)
    return np.frombuffer(pa.decompress(data, n, codec="zstd", asbytes=True) if n else b"", np.uint8)


def _starts(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])[: len(sizes)]


def _sample(sizes: list[int], cover: Cover) -> np.ndarray:
    """The sample places of a block with ``depth`` bytes of their text left; places count from their text's start."""
    most = max(sizes, default=0)
    one = (np.arange(0, most + 1, cover.period)[:, None] + np.array(sorted(cover.places))).ravel()
    counts = np.searchsorted(one, np.array(sizes, np.int64) - cover.depth, side="right")
    return np.concatenate([np.zeros(0, np.int64), *(one[:n] + at for n, at in zip(counts, _starts(sizes), strict=True) if n)])


def _ranks(data: np.ndarray, places: np.ndarray, cover: Cover, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of each sample suffix in the upper bits, its hash below; and the number of lower bits."""
    h = span_hashes(data, places, cover.depth)
    low = 64 - max(16, buckets.bit_length())
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(low)) | (h & np.uint64((1 << low) - 1)), low


def _deal(rows: Iterator[tuple], cover: Cover, buckets: int) -> Iterator[tuple]:
    """The distinct ranks of each block, six bytes each, by bucket."""
    for block, sizes, data in rows:
        found, low = _ranks(_unpacked(data, sizes), _sample(sizes, cover), cover, buckets)
        found = np.unique(found)
        if not len(found):
            continue
        of = (found >> np.uint64(low)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
            part = found[a:b] & np.uint64((1 << low) - 1)
            yield int(of[a]), block, part.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _tied(rows: Iterator[tuple], low: int) -> Iterator[tuple]:
    """Sort one bucket at a time; give each block its ranks that tie with another block's. Rows come ordered by bucket."""
    bucket, held = None, []

    def settled():
        ranks = [np.frombuffer(x, np.uint8).reshape(-1, 6) for _, x in held]
        ranks = [np.pad(x, ((0, 0), (0, 2))).view(np.uint64).ravel() for x in ranks]
        order = np.sort(np.concatenate(ranks))
        ties = np.unique(order[1:][order[1:] == order[:-1]])
        for (block, _), own in zip(held, ranks, strict=True):
            found = own[_among(own, ties)]
            if len(found):
                yield block, (found | np.uint64(bucket << low)).tobytes()

    for b, block, ranks in rows:
        if b != bucket and held:
            yield from settled()
            held = []
        bucket = b
        held.append((block, ranks))
    if held:
        yield from settled()


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are in an ascending array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _reach(places: np.ndarray, sizes: list[int], cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and from each place that windows starting up to ``period - 1`` bytes before it cover in its text."""
    starts = _starts(sizes)
    of = np.searchsorted(starts, places, side="right") - 1
    # Empty texts share their start with the next text, so the last start at or before a place is its own.
    return np.minimum(cover.period - 1, places - starts[of]), np.minimum(cover.window, starts[of] + np.array(sizes, np.int64)[of] - places)


def _extend(rows: Iterator[tuple], cover: Cover, buckets: int, everything: bool) -> Iterator[tuple]:
    """Results of the texts without a tied place, unless ``everything`` stays; the other texts of the block with places, ranks
    and extensions."""
    for block, ids, sizes, data, given in rows:
        data = _unpacked(data, sizes)
        places = _sample(sizes, cover)
        ranks, _ = _ranks(data, places, cover, buckets)
        own, of, times = np.unique(ranks, return_inverse=True, return_counts=True)
        ties = np.sort(np.frombuffer(b"".join(given or []), np.uint64))
        live = ((times > 1) | _among(own, ties))[of]
        places, ranks = places[live], ranks[live]
        before, ahead = _reach(places, sizes, cover)
        fits = before + ahead >= cover.window
        places, ranks, before, ahead = places[fits], ranks[fits], before[fits], ahead[fits]
        starts = _starts(sizes)
        stays = np.full(len(sizes), everything)
        stays[np.searchsorted(starts, places, side="right") - 1] = True
        done = [(i, n, hashlib.sha256(data[a : a + n].tobytes()).hexdigest()) for i, n, a, s in zip(ids, sizes, starts, stays, strict=True) if not s]
        kept = [i for i, s in enumerate(stays) if s]
        around = span_hashes(data, places - before, before + ahead, seed=1)
        around = mix(around + before.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        own_sizes = np.where(stays, np.array(sizes, np.int64), 0)
        moved = places - (starts - (np.cumsum(own_sizes) - own_sizes))[np.searchsorted(starts, places, side="right") - 1]
        text = b"".join(data[starts[i] : starts[i] + sizes[i]].tobytes() for i in kept)
        yield (
            block,
            [ids[i] for i in kept],
            [sizes[i] for i in kept],
            _packed(text),
            moved.astype(np.uint32).tobytes(),
            ranks.tobytes(),
            around.tobytes(),
            *([d[k] for d in done] for k in range(3)),
        )


def _extension_rows(rows: Iterator[tuple]) -> Iterator[list]:
    """``block, rank, around, times`` of the distinct extensions of a block."""
    for block, ranks, around in rows:
        pair = np.stack([np.frombuffer(ranks, np.uint64), np.frombuffer(around, np.uint64)], axis=1)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        pair = pair[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)])) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(pair)))
        yield from _sliced([np.full(len(new), block), signed(pair[new, 0].copy()), signed(pair[new, 1].copy()), times])


def _sliced(columns: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    for at in range(0, len(columns[0]), OUT_ROWS):
        yield [c[at : at + OUT_ROWS] for c in columns]


def _covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def _suffixes(rows: Iterator[tuple], cover: Cover) -> Iterator[tuple]:
    """Per block: the windows inside extensions that repeat whole, and the suffixes still to be sorted, with the hashes of
    their windows and whether they are known to repeat."""
    for block, sizes, data, places, around, whole, asked in rows:
        data = _unpacked(data, sizes)
        places, around = np.frombuffer(places, np.uint32).astype(np.int64), np.frombuffer(around, np.uint64)
        before, ahead = _reach(places, sizes, cover)
        repeats, tried = (_among(around, np.sort(np.array(x or [], np.int64).view(np.uint64))) for x in (whole, asked))
        first, end = places - before, places + ahead
        known = _covered(len(data), first[repeats], end[repeats] - cover.window + 1)
        start = np.flatnonzero(_covered(len(data), first[tried], end[tried] - cover.window + 1))
        other = (span_hashes(data, start, cover.window, seed=1) >> np.uint64(32)).astype(np.uint32)
        yield block, _runs(np.flatnonzero(known)), _runs(start), np.packbits(known[start]).tobytes(), span_hashes(data, start, cover.window).tobytes(), other.tobytes()


def _runs(places: np.ndarray) -> bytes:
    """Ascending places as the first of each run of neighbours and its length."""
    new = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1])) if len(places) else places
    return np.stack([places[new], np.diff(np.append(new, len(places)))]).astype(np.uint32).tobytes()


def _places(runs: bytes | None) -> np.ndarray:
    first, count = np.frombuffer(runs or b"", np.uint32).astype(np.int64).reshape(2, -1)
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _suffix_rows(rows: Iterator[tuple]) -> Iterator[list]:
    for block, runs, known, one, other in rows:
        start = _places(runs)
        sure = np.unpackbits(np.frombuffer(known, np.uint8))[: len(start)].astype(bool)
        yield from _sliced([np.full(len(start), block), start.astype(np.int32), np.frombuffer(one, np.int64), np.frombuffer(other, np.int32), sure])


def _strip(rows: Iterator[tuple], cover: Cover, with_bytes: bool) -> Iterator[tuple]:
    for ids, sizes, data, known, starts in rows:
        data = _unpacked(data, sizes)
        first = np.concatenate([_places(known), np.array(starts or [], np.int64)])
        gone = _covered(len(data), first, first + cover.window)
        at = 0
        for doc_id, size in zip(ids, sizes, strict=True):
            part = gone[at : at + size]
            kept = data[at : at + size][~part].tobytes()
            runs = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
            out = doc_id, size, size - len(kept), runs, hashlib.sha256(kept).hexdigest()
            yield (*out, kept) if with_bytes else out
            at += size


def strip_repeated_bytes(docs: DataFrame, cover: Cover = COVER, block_bytes: int = BLOCK_BYTES, bucket_suffixes: int = BUCKET_SUFFIXES, with_bytes: bool = False) -> DataFrame:
    """Remove each byte of a text's UTF-8 form that is covered by a string of ``cover.window`` bytes which also starts anywhere
    else in ``docs``, the same text and overlapping places included: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` of each row and, on request, the bytes ``kept``.

    Matches never cross texts; all copies of a repeat are removed, and strings are judged on the texts as they come in, so
    what is left need not be valid UTF-8. Null texts are empty; texts shorter than a window stay whole; a repeated row is
    another place, so its long strings repeat; ids are only handed through, so null and shared ids are rows like others;
    an empty table gives an empty result; other columns are ignored, whatever their names.

    Memory: a task holds one block of texts (``block_bytes``, or one text), or one bucket of about
    ``bucket_suffixes`` sample suffixes, in which a rank that very many blocks hold counts once a block."""
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    pack = "block long, n_bytes long, ids array<long>, sizes array<long>, data binary"
    blocks = durable.cut(map_rows(docs.select("doc_id", "text"), lambda rows: _blocks(rows, block_bytes), pack))
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    spark = docs.sparkSession
    sample = total * len(cover.places) // cover.period
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sample // bucket_suffixes))
    low = 64 - max(16, buckets.bit_length())

    dealt = map_rows(blocks.select("block", "sizes", "data"), lambda rows: _deal(rows, cover, buckets), "bucket int, block long, ranks binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    # A block's ranks fit where the block does, and so do all lists per block below.
    tied = durable.cut(map_rows(dealt, lambda rows: _tied(rows, low), "block long, ranks binary"))
    given = tied.groupBy("block").agg(F.collect_list("ranks").alias("given"))
    extended = durable.cut(
        map_rows(
            blocks.join(given, "block", "left").select("block", "ids", "sizes", "data", "given"),
            lambda rows: _extend(rows, cover, buckets, with_bytes),
            "block long, ids array<long>, sizes array<long>, data binary, places binary, ranks binary, around binary, "
            "done_ids array<long>, done_sizes array<long>, done_sha array<string>",
        )
    )
    for table in (blocks, tied):
        durable.drop(table)

    places = map_arrays(extended.select("block", "ranks", "around"), _extension_rows, "block long, rank long, around long, times long")
    kinds = durable.cut(places.groupBy("rank", "around").agg(F.sum("times").alias("n"), F.min("block").alias("specimen")))
    ends = kinds.where("n = 1").select("rank").distinct()
    whole = places.join(kinds.where("n > 1").select("rank", "around"), ["rank", "around"], "left_semi")
    asked = kinds.join(ends, "rank", "left_semi").select(F.col("specimen").alias("block"), "around")
    marks = whole.select("block", "around", F.lit(True).alias("whole")).unionByName(asked.withColumn("whole", F.lit(False)))
    lists = [F.collect_list(F.when(c, F.col("around"))).alias(name) for c, name in ((F.col("whole"), "repeats"), (~F.col("whole"), "asked"))]
    answers = durable.cut(marks.groupBy("block").agg(*lists))
    durable.drop(kinds)
    suffixes = durable.cut(
        map_rows(
            extended.join(answers, "block").select("block", "sizes", "data", "places", "around", "repeats", "asked"),
            lambda rows: _suffixes(rows, cover),
            "block long, known binary, start binary, sure binary, one binary, other binary",
        )
    )
    durable.drop(answers)

    windows = map_arrays(suffixes.select("block", "start", "sure", "one", "other"), _suffix_rows, "block long, start int, one long, other int, sure boolean")
    same = ["one", "other"]
    seen = windows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.bool_or("sure").alias("sure")).where("n > 1 or sure").select(*same)
    hits = windows.where("not sure").join(seen, same, "left_semi").groupBy("block").agg(F.collect_list("start").alias("starts"))
    texts = extended.select("block", "ids", "sizes", "data").where(F.size("ids") > 0)
    found = texts.join(suffixes.select("block", "known"), "block", "left").join(hits, "block", "left")
    stripped = map_rows(found.select("ids", "sizes", "data", "known", "starts"), lambda rows: _strip(rows, cover, with_bytes), result)

    if with_bytes:
        return stripped
    # Texts without a tie were settled when their block was extended.
    row = F.explode(F.arrays_zip("done_ids", "done_sizes", "done_sha")).alias("d")
    done = extended.select(row).select(F.col("d.done_ids").alias("doc_id"), F.col("d.done_sizes").alias("n_bytes"), F.col("d.done_sha").alias("kept_sha256"))
    none = F.lit(0).cast("long")
    return stripped.unionByName(done.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256"))
