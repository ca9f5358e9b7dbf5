"""Vector codes by product quantisation, trained with member-resident Lloyd rounds.

A vector is cut into consecutive parts, and each position has a codebook of its own (Jégou et al., "Product Quantization
for Nearest Neighbor Search", PAMI 2011). Rows of parts live with their owner, a (position, entry, salt), in a table that is
written in that order:

* An owner's update is a sum over its resident members: every task sums what it reads, and only one row for each entry and
  task is shuffled.
* The new codebook goes to all residents. Members that stay with their entry are written again by the task that read them;
  only those whose entry changes are shuffled, to their new owner.

Salts spread an entry with very many members: their number follows the number of rows, so an owner stays small even if one
entry holds all rows. All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph import durable

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Scaled components are held to this size, so that sums of them fit a long; and rows one owner may hold.
MOST = 1 << 30
OWNER_ROWS = 100_000
OWNER = ("position", "entry", "salt")
_LONG = (1 << 63) - 1
_CHUNK = 4096


def sound(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    x = F.transform(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(x, lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))


def scaled(vector: Column, scale: int, most: int = MOST) -> Column:
    """Components as ``floor(scale * x)``."""
    def whole(v: Column) -> Column:
        return F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(most))), F.lit(float(-most)))).cast("long")

    return F.transform(vector, whole)


def common_size(rows: DataFrame, vector: str) -> tuple[int, int]:
    """The most frequent number of components (ties: the larger), and how many rows have it."""
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return (top.d, top.n) if top else (0, 0)


def arrays(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    lists = batch.column(column)
    if not len(lists):
        return np.zeros((0, 0), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties: the smaller) and its squared distance, in exact integers."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(codebook).max(initial=0)))
    # Doubles hold every sum exactly up to 2^53; longer integers take over beyond.
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else object
    c = codebook.astype(kind)
    own = (c * c).sum(axis=1)
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), object if kind is object else np.int64)
    for at in range(0, len(x), _CHUNK):
        part = x[at : at + _CHUNK].astype(kind)
        d = (part * part).sum(axis=1)[:, None] - 2 * (part @ c.T) + own
        best = d.argmin(axis=1)
        index[at : at + _CHUNK] = best
        distance[at : at + _CHUNK] = d[np.arange(len(part)), best]
    return index, distance


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, parsed)


def _least_ids(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list]:
    """The ``n`` smallest ids of a partition with their smallest vectors."""
    kept: dict[int, tuple[int, ...]] = {}
    for batch in batches:
        ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), arrays(batch, "x")
        few = np.unique(ids)[:n]
        for i in np.flatnonzero(ids <= few[-1]) if len(few) else ():
            vector = tuple(x[i].tolist())
            kept[int(ids[i])] = min(kept.get(int(ids[i]), vector), vector)
        kept = dict(sorted(kept.items())[:n])
    yield [list(kept), list(kept.values())]


def first_entries(rows: DataFrame, n: int = ENTRIES) -> list[list[int]]:
    """The vectors of the ``n`` smallest ids, ascending; of an id with several vectors, the smallest."""
    few = _mapped(rows.where("vec_id is not null").select("vec_id", "x"), lambda b: _least_ids(b, n), "vec_id long, x array<long>")
    return [r.x for r in few.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(n).collect()]


def _placed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[list]:
    """Parts with the entry that owns them now; ``moved`` if another one did before."""
    codebooks = shared.value
    for batch in batches:
        position, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("position", "entry"))
        x, entry = arrays(batch, "part"), np.zeros(len(before), np.int64)
        for p in np.unique(position):
            mine = position == p
            entry[mine] = nearest(x[mine], codebooks[p])[0]
        yield [position, entry.astype(np.int32), batch.column("salt"), batch.column("part"), entry != before]


def _settle(residents: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """Residents, each with its owner by the given codebooks and whether it has to move there."""
    shared = residents.sparkSession.sparkContext.broadcast(codebooks)
    schema = "position int, entry int, salt int, part array<long>, moved boolean"
    return _mapped(residents.select("position", "entry", "salt", "part"), lambda b: _placed(b, shared), schema)


def _housed(movers: DataFrame) -> DataFrame:
    """Rows at their owners: each owner's rows come to one task and lie together there."""
    return movers.repartition(*OWNER).sortWithinPartitions(*OWNER).select(*OWNER, "part")


def _updated(residents: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of their residents; an entry without any stays."""
    width = codebooks[0].shape[1]
    sums = [F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(width)]
    # One row for each position and entry.
    found = residents.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    new = [c.copy() for c in codebooks]
    for r in found:
        new[r.position][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return new


def train(rows: DataFrame, size: int, n: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owner_rows: int = OWNER_ROWS) -> list[np.ndarray]:
    """One codebook per position for rows ``vec_id, x`` of ``n`` integer vectors with ``size`` components."""
    width = -(-size // parts)
    start = np.array(first_entries(rows, entries), np.int64).reshape(-1, size)
    start = np.pad(start, ((0, 0), (0, parts * width - size)))
    codebooks = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    if not len(start):
        return codebooks
    salts = -(-n // owner_rows)
    cuts = F.array(*(F.slice("x", p * width + 1, width) for p in range(parts)))
    # Copies of one vector go to different salts, whatever their ids.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt")
    members = rows.select(salt, padded(F.col("x"), parts * width).alias("x")).select("salt", F.posexplode(cuts).alias("position", "part"))
    # All parts find their first owner; from then on tables are owned, and only movers are shuffled.
    owned = [durable.cut(_housed(_settle(members.withColumn("entry", F.lit(-1)), codebooks)))]
    residents = owned[0]
    codebooks = _updated(residents, codebooks)
    for _ in range(rounds - 1):
        settled = durable.cut(_settle(residents, codebooks), partition_by=("moved",))
        arrived = durable.cut(_housed(settled.where("moved")))
        for table in owned:
            durable.drop(table)
        owned = [settled, arrived]
        # Those who stay were written by the task that had read them.
        residents = settled.where("not moved").select(*OWNER, "part").unionByName(arrived)
        codebooks = _updated(residents, codebooks)
    for table in owned:
        durable.drop(table)
    return codebooks


def padded(x: Column, size: int) -> Column:
    """Vectors filled up with zeros."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0).cast("long"), size)), 1, size)


def _coded(batches: Iterator[pa.RecordBatch], shared, keep: list[str]) -> Iterator[list]:
    codebooks = shared.value
    for batch in batches:
        x = arrays(batch, "x")
        width = codebooks[0].shape[1]
        x = np.pad(x, ((0, 0), (0, len(codebooks) * width - x.shape[1])))
        index, error = np.empty((len(x), len(codebooks)), np.int64), np.zeros(len(x), object)
        for p, codebook in enumerate(codebooks):
            index[:, p], distance = nearest(x[:, p * width : (p + 1) * width], codebook)
            error += distance.astype(object)
        yield [*(batch.column(c) for c in keep), ["".join(f"{i:02x}" for i in row) for row in index.tolist()], [min(int(e), _LONG) for e in error]]


def encode(rows: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` of rows ``vec_id, label, x``."""
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)
    keep = ["vec_id", "label"]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", code string, error long"
    return _mapped(rows.select(*keep, "x"), lambda b: _coded(b, shared, keep), schema)


def fingerprint(codebooks: list[np.ndarray]) -> str:
    text = ",".join(str(int(v)) for c in codebooks for v in c.ravel())
    return hashlib.sha256(text.encode()).hexdigest()


def integer_rows(embeddings: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int, int]:
    """Rows ``vec_id, label, x`` with integer components, their number of components and of rows."""
    kept = embeddings.select("vec_id", "label", F.col("embedding").alias("v")).where(sound(F.col("v")))
    size, n = common_size(kept, "v")
    return kept.where(F.size("v") == size).select("vec_id", "label", scaled(F.col("v"), scale).alias("x")), size, n


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept row of ``embeddings`` (``vec_id, embedding, label``).

    Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are vectors that are not as
    long as most (of two lengths equally frequent, the longer counts); lengths that ``parts`` does not divide are
    filled up with zeros. Components beyond a million in size count as a million, errors beyond a long as the largest long.
    Codebooks start from the smallest ids, fewer than ``entries`` if there are fewer; null ids start none but are coded like others;
    of an id with several vectors the smallest one starts an entry. With null ids alone there is no codebook: the
    code is empty and the error 0. Repeated rows are members, and coded, as often as they occur. An empty table gives an
    empty result. Other columns are ignored."""
    rows, size, n = integer_rows(embeddings)
    codebooks = train(rows, size, n, parts, entries, rounds, owner_rows) if n else []
    if not codebooks or not len(codebooks[0]):
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = durable.cut(encode(rows, codebooks))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    errors = coded.groupBy(F.col("label").alias("_label")).agg(F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    found = coded.join(errors, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))
