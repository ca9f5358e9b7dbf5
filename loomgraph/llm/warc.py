"""A deterministic sharded WARC writer, and a reader of what it wrote.

Records are range-sorted by page id into shards; a shard's task rolls its files by compressed size. Range bounds come
from ids with small hashes, and records carry no clock and no random numbers, so the same pages give the same bytes.

Commit: tasks write below ``_temporary/<attempt>`` and report their files; Spark keeps the report of one attempt per
task; the reported files are then moved to their names, and the manifest is written last. Readers go by the
manifest alone, so files of lost or repeated attempts are never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.llm.frames import map_rows

SHARD_BYTES = 256 << 20
MAX_SHARDS = 20_000
SAMPLE_PER_SHARD = 50
ROLL_BYTES = 128 << 20
LEAST_REVISIT_BYTES = 0
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"
SOFTWARE = "loomgraph"

_NAMES = uuid.UUID("6f1d1c0e-5d0f-5f0a-9d53-1f2a2f1f7c11")
MANIFEST = "shard int, seq int, name string, temporary string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str, n: int) -> str:
    """The id of the ``n``-th record with this page id and digest in its partition (0 but for repeated rows)."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{n}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def _one_line(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _page_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, n: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest, n)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to, digest, 0) if revisit else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, block)


@dataclass
class _Open:
    """One archive file being written under a temporary name."""

    shard: int
    seq: int
    folder: str
    date: str
    level: int

    def __post_init__(self):
        self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.temporary = f"{self.folder}/{self.name}"
        self.system, path = fs.FileSystem.from_uri(self.temporary)
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.sum, self.size, self.records, self.first, self.last = self.system.open_output_stream(path, compression=None), hashlib.sha256(), 0, 0, None, None
        info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, self.name)}>"), ("WARC-Date", self.date)]
        self.write(_record([*headers, ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def write(self, record: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def add(self, page_id: int | None, record: bytes) -> None:
        self.write(record)
        self.records += 1
        if page_id is not None:
            self.first, self.last = page_id if self.first is None else self.first, page_id

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.seq, self.name, self.temporary, self.records, self.size, self.sum.hexdigest(), self.first, self.last


def _write(rows: Iterator[tuple], folder: str, roll: int, least: int, date: str, level: int) -> Iterator[tuple]:
    """Rows come by shard, page id and digest; a group's mark (no payload, but ``refers_to``) comes before its pages."""
    attempt = f"{folder}/_temporary/{uuid.uuid4().hex}"
    file, mark, group, n = None, None, None, 0
    for shard, page_id, sha, url, html, refers_to, is_mark in rows:
        if is_mark:
            mark = (page_id, sha, refers_to)
            continue
        if (page_id, sha) != group:
            group, n = (page_id, sha), 0
        payload = (html or "").encode("utf-8", "surrogatepass")
        digest = sha1_base32(payload)
        marked = mark is not None and mark[:2] == group and len(payload) >= least
        refers = mark[2] if marked else None
        # Of repeated rows with the largest id, the first is the response.
        revisit = marked and (page_id != refers or n > 0)
        if file is None or file.shard != shard or (file.records and file.size >= roll):
            if file is not None:
                yield file.close()
            file = _Open(shard, file.seq + 1 if file is not None and file.shard == shard else 0, attempt, date, level)
        file.add(page_id, _page_record(page_id, url, payload, digest, refers, revisit, n, date))
        n += 1
    if file is not None:
        yield file.close()


def _move(rows: Iterator[tuple], folder: str) -> Iterator[tuple]:
    for row in rows:
        system, source = fs.FileSystem.from_uri(row[3])
        target = fs.FileSystem.from_uri(f"{folder}/{row[2]}")[1]
        if system.get_file_info(source).type != fs.FileType.NotFound:  # else an earlier attempt has moved it
            system.move(source, target)
        yield row


def _bounds(pages: DataFrame, shard_bytes: int) -> np.ndarray:
    """Inner bounds of the shards: quantiles of the ids whose hashes are smallest, about 50 for each shard."""
    n, total = pages.agg(F.approx_count_distinct("page_id"), F.sum(F.octet_length("html") + 1024)).first()
    shards = min(MAX_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2 or not n:
        return np.zeros(0, np.int64)
    share = min(1.0, SAMPLE_PER_SHARD * shards / n)
    chosen = pages.where(F.xxhash64("page_id") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).select("page_id").where("page_id is not null").distinct()
    ids = np.sort(np.array([r.page_id for r in chosen.collect()], np.int64))
    return np.unique(ids[np.arange(1, shards) * len(ids) // shards]) if len(ids) else np.zeros(0, np.int64)


def _shard(bounds: np.ndarray) -> Column:
    """Shard of a row by its id; rows without id are dealt by their payload."""

    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right").astype(np.int32))

    dealt = F.pmod(F.hash("sha"), F.lit(len(bounds) + 1))
    known = F.pandas_udf(find, "int")(F.coalesce("page_id", F.lit(0))) if len(bounds) else F.lit(0)
    return F.when(F.col("page_id").isNull(), dealt).otherwise(known).cast("int")


def write_archives(
    pages: DataFrame,
    folder: str,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    least_revisit_bytes: int = LEAST_REVISIT_BYTES,
    date: str = DATE,
    level: int = LEVEL,
) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``) to WARC files in ``folder``; returns the manifest.

    Among records with equal payloads of ``least_revisit_bytes`` or more, the one with the largest id is a
    response and the others revisit it. Null html is the empty payload, a null url leaves the target out;
    of repeated rows with the largest id the first is the response; rows without id revisit others but
    are responses if all of their group lack one; an empty table gives an empty manifest; other columns are ignored."""
    folder = folder.rstrip("/")
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", sha.alias("sha"), "url", "html")
    keys = pages.select("page_id", sha.alias("sha"))
    groups = keys.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    none = F.lit(None).cast("string")
    marks = keys.join(groups, "sha").distinct().select("page_id", "sha", none.alias("url"), none.alias("html"), "refers_to", F.lit(True).alias("mark"))
    bounds = _bounds(pages, shard_bytes)
    everything = rows.select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("mark")).unionByName(marks)
    dealt = everything.select(_shard(bounds).alias("shard"), "*").repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "sha", F.col("mark").desc(), "url")
    written = durable.cut(map_rows(ordered, lambda r: _write(r, folder, roll_bytes, least_revisit_bytes, date, level), MANIFEST))
    moved = map_rows(written.repartition("shard", "seq"), lambda r: _move(r, folder), MANIFEST).drop("temporary")
    moved.write.parquet(f"{folder}/_manifest")
    durable.delete(pages.sparkSession, f"{folder}/_temporary")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/_manifest")


def _members(path: str) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at, compression=None) as source:
        unpacker, parts, data = zlib.decompressobj(31), [], b""
        while data or (data := source.read(1 << 20)):
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
        if parts:
            raise ValueError(f"{path} ends inside a record")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _read(rows: Iterator[tuple], folder: str, payloads: bool) -> Iterator[tuple]:
    for (name,) in rows:
        for record in _members(f"{folder}/{name}"):
            head, _, rest = record.partition(b"\r\n\r\n")
            fields = _fields(head)
            block = rest[: int(fields["content-length"])]
            if len(rest) != len(block) + 4 or fields.get("warc-block-digest", f"sha1:{sha1_base32(block)}") != f"sha1:{sha1_base32(block)}":
                raise ValueError(f"{name}: damaged record {fields.get('warc-record-id')}")
            if fields["warc-type"] == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(_fields(http)["content-length"])
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            response = fields["warc-type"] == "response"
            if response and (len(payload) != size or sha1_base32(payload) != digest):
                raise ValueError(f"{name}: damaged payload {fields.get('warc-record-id')}")
            number = {k: int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")}
            out = number["x-page-id"], size, digest, fields["warc-type"], number["x-refers-to-page-id"], fields.get("warc-target-uri")
            yield (*out, payload.decode("utf-8", "surrogatepass") if response else None) if payloads else out


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the files in the manifest, each checked against its digests."""
    folder = folder.rstrip("/")
    names = read_manifest(spark, folder).select("shard", "name")
    shards = (names.agg(F.max("shard")).first()[0] or 0) + 1
    files = names.repartitionById(shards, F.col("shard")).select("name")
    return map_rows(files, lambda r: _read(r, folder, payloads), RECORD + (", html string" if payloads else ""))


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to archives in ``folder`` (by default a new one in the run's folder) and read the records back."""
    spark = pages.sparkSession
    folder = folder or durable.fresh_folder(spark, "warc")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder)
