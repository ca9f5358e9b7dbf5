"""Packing, archives, and the pipeline."""

import collections
import gzip
import os
import random
import zlib

import numpy as np
import plain
import pytest
from public_tokenizers import path

import __spark_entry__ as entry
import corpus_pipeline
from loomgraph.llm import decontaminate, packing, quality_pu, secret_scan, warc
from loomgraph.llm.frames import table
from loomgraph.llm.queries import public_vocabulary

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), 1)


def test_both_libraries_give_equal_ids(encoder):
    draw = random.Random(2)
    for _ in range(2000):
        text = "".join(chr(draw.randrange(0x250)) if draw.random() < 0.7 else draw.choice(" \n\t's'll'rea1") for _ in range(draw.randint(0, 60)))
        assert encoder.ids(text)[:-1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("<|endoftext|> x", "日本語 text", "x y", "🙂"):
        assert encoder.ids(text)[:-1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids(None).tolist() == [1]


def test_windows_cost_least():
    draw = random.Random(3)
    for _ in range(300):
        length, places, p = draw.randint(5, 30), [], 0
        for _ in range(draw.randint(1, 40)):
            p += draw.randint(1, length)
            places.append(p)
        penalties = [draw.choice([0, 2, 9]) for _ in places]
        least = [0]
        for j, (p, penalty) in enumerate(zip(places, penalties, strict=True), 1):
            before = [0, *places]
            least.append(min(least[i] + length - (p - before[i]) for i in range(j) if p - before[i] <= length) + penalty)
        cost = at = 0
        for end in packing.best_windows(places, penalties, length):
            assert 0 < end - at <= length
            cost += length - (end - at) + dict(zip(places, penalties, strict=True))[end]
            at = end
        assert cost == least[-1] and at == places[-1]


@pytest.mark.parametrize(("length", "segment"), [(2048, 1 << 20), (64, 100), (5, 1)])
def test_every_id_is_in_one_piece(spark, encoder, length, segment):
    draw = random.Random(4)
    texts = [*plain.ODD, "x" * 3000, "no sentence end " * 400, "日本 <|endoftext|>"]
    texts += [" ".join(draw.choice(["the", "cat.", "sat!", "on\n", "mats?"]) for _ in range(draw.randint(0, 300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(2)
    pieces = packing.pack(docs, **public_vocabulary(), length=length, segment=segment, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for i, text in rows:
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = [x for p in own for x in p.ids]
        assert ids == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own[:-1])]).tolist()
        assert {p.doc_tokens for p in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own[:-1])]).tolist()
        assert own[-1].offset + own[-1].length <= length
    assert packing.pack(docs.limit(0), **public_vocabulary()).count() == 0


@needs_tables
def test_padding_is_small(spark):
    pieces = packing.pack(table(spark, FOLDER.replace("0.001", "0.01"), "documents").coalesce(1), **public_vocabulary()).collect()
    sizes = collections.Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    padding = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padding < 0.012 * sum(sizes.values())


PAGES = [
    (1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "http://é", "é" * 100), (None, "n", "x"), (None, "m", "q"),
    (7, "z", "zz"), (7, "z", "zz"), (-5, "r", "x"), (None, "m", "q"),
]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 2000, "roll_bytes": 300}, {"least_revisit_bytes": 2}])
def test_archives_round_trip(spark, options):
    pages = spark.createDataFrame([(*r, "s") for r in PAGES], "page_id long, url string, html string, sha string")
    got = sorted((tuple(r)[:5] for r in warc.round_trip(pages, **options).collect()), key=str)
    assert got == plain.records(PAGES, options.get("least_revisit_bytes", 0))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_deterministic_and_committed_by_manifest(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, f"http://p/{i}", "<p>" + "".join(draw.choice("ab ") for _ in range(draw.randint(0, 900)))) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    options = {"shard_bytes": 60_000, "roll_bytes": 5000}
    first = warc.write_archives(pages, f"{tmp_path}/a", **options).collect()
    again = warc.write_archives(pages.repartition(5), f"{tmp_path}/b", **options).collect()
    assert {(r.name, r.sha256) for r in first} == {(r.name, r.sha256) for r in again} and len({r.shard for r in first}) > 2
    assert not os.path.exists(f"{tmp_path}/a/_temporary")
    (tmp_path / "a" / "part-999999-00000.warc.gz").write_bytes(b"left by a lost attempt")
    html = {r.page_id: r.html for r in warc.read_archives(spark, f"{tmp_path}/a", payloads=True).collect() if r.record_type == "response"}
    assert html == {i: h for i, _, h in rows if i in html} and len(html) == len({h for _, _, h in rows})
    for r in first:
        assert gzip.open(f"{tmp_path}/a/{r.name}").read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    bounds = sorted((r.shard, r.seq, r.first_id, r.last_id) for r in first)
    assert all(a[3] < b[2] for a, b in zip(bounds, bounds[1:], strict=False))


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    (file,) = warc.write_archives(pages, f"{tmp_path}/a").collect()
    target = tmp_path / "a" / file.name
    raw = gzip.open(target).read().replace(b"\r\n\r\nzz\r\n", b"\r\n\r\nzy\r\n")
    target.write_bytes(b"".join(gzip.compress(b"WARC/1.1" + part) for part in raw.split(b"WARC/1.1")[1:]))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, f"{tmp_path}/a").collect()


def _run_stages(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return docs


@needs_tables
def test_pipeline_is_what_its_stages_say(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality_pu.train(docs, table(spark, FOLDER, "labels"))
    rows = [(d, t) for d, t in rows if model.score(quality_pu.features(t)[None])[0] >= 0.5]
    kept = {d for d, _, _, k in plain.near_groups(rows) if k}
    block = decontaminate.Block([(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()], decontaminate.EDIT_RATE, decontaminate.MIN_CHARS)
    want = {d: secret_scan.redact(t) for d, t in rows if d in kept and not block.matches(t)}
    encoder = packing.Encoder(**public_vocabulary(), end_id=1)
    tokens = collections.Counter()
    for p in entry.queries()["pipeline"](spark, FOLDER).collect():
        tokens[p.doc_id] += p.length
    assert tokens == {d: len(encoder.ids(t)) for d, t in want.items()} and 0 < len(want) < docs.count()


@needs_tables
def test_pipeline_on_odd_rows(spark):
    known = [tuple(r) for r in table(spark, FOLDER, "documents").limit(60).collect()]
    ids = [r[0] for r in known]
    odd = [(10**6 + i, t, None, None, None) for i, t in enumerate(plain.ODD)] + [(None, known[0][1], "en", "s", 3), (None, "a new text", None, None, None)]
    docs = spark.createDataFrame(known + known[:5] + odd, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    out = _run_stages(spark, docs, FOLDER).collect()
    assert len({r.doc_id for r in out if r.doc_id is not None}) == len([r for r in out if r.doc_id is not None])
    assert {r.doc_id for r in out} <= {None, *ids, *(10**6 + i for i in range(len(plain.ODD)))}
    assert _run_stages(spark, docs.limit(0), FOLDER).count() == 0


def test_near_duplicates_go_by_id_and_text(spark):
    draw = random.Random(5)
    a, b, c, d = (" ".join(f"{draw.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [(7, a), (7, b), (7, b), (3, b + " end"), (7, c), (9, c), (None, d), (None, d), (None, a), (8, None), (8, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        got = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(parts), "").collect()), key=str)
        assert got == sorted([(7, a), (3, b + " end"), (7, c), (None, d), (8, None), (8, ""), (5, "")], key=str)


def test_all_queries_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] and set(entry.oracle_sql()) <= set(entry.queries())
