"""Byte-exact repeats against a plain count of all windows."""

import collections
import hashlib
import random

import numpy as np
import plain
import pytest

from loomgraph.llm import suffix_dedup as S

SMALL = S.Cover(20, 7, (0, 1, 3))


def removed(rows, window):
    seen = collections.Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[i : i + window] for i in range(len(data) - window + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * (len(data) + 1)
        for i in range(len(data) - window + 1):
            if seen[data[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        runs = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out.append((doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def got(docs, *args, **more):
    return sorted((tuple(r) for r in S.strip_repeated_bytes(docs, *args, **more).collect()), key=str)


def sharing(draw, n, letters="abé ", base=300, least=5, most=90):
    pool = ["".join(draw.choice(letters) for _ in range(base)) for _ in range(4)]
    for i in range(n):
        text = ""
        for _ in range(draw.randint(1, 5)):
            at = draw.randint(0, base)
            text += draw.choice(pool)[at : at + draw.randint(least, most)] + "".join(draw.choice(letters) for _ in range(draw.randint(0, 15)))
        yield 10 + i, text


def test_covers_reach_every_pair_of_places():
    with pytest.raises(ValueError):
        S.Cover(400, 91, (0, 1, 3))
    for cover in (SMALL, S.COVER):
        inside = np.isin(np.arange(2 * cover.period) % cover.period, cover.places)
        for shift in range(cover.period):
            assert (inside[: cover.period] & inside[shift : shift + cover.period]).any()


def test_hashes_follow_the_bytes_alone(monkeypatch):
    data = np.frombuffer(b"abcabcabcXabc" * 50, np.uint8)
    start = np.arange(len(data) - 9)
    whole = S.span_hashes(data, start, 9)
    assert len(set(whole.tolist())) == len({bytes(data[i : i + 9]) for i in start})
    monkeypatch.setattr(S, "STRETCH", 17)
    assert (S.span_hashes(data, start, 9) == whole).all()


@pytest.mark.parametrize(("seed", "block", "bucket"), [(1, 1 << 20, 10_000), (2, 200, 50), (3, 1, 1)])
def test_repeats(spark, seed, block, bucket):
    rows = [(None, t) for t in plain.ODD] + [(1, "x" * 200), (2, "xy" * 70), (3, "x" * 19), *sharing(random.Random(seed), 60)]
    rows += [rows[-1], (rows[-2][0], "another text " * 2), (None, rows[-3][1]), (4, "ab" * 10 + "é" * 8)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, block string, n long").repartition(3)
    want = removed(rows, SMALL.window)
    assert got(docs, SMALL, block, bucket) == [w[:5] for w in want]
    assert got(docs, SMALL, block, bucket, with_bytes=True) == want
    assert any(w[2] for w in want) and any(w[3] > 1 for w in want)


def test_long_windows(spark):
    rows = [(i, t) for i, (_, t) in enumerate(sharing(random.Random(8), 30, "abcdefgh ", base=3000, least=300, most=700))]
    rows += [(100, rows[0][1]), (101, rows[1][1][:399]), (102, rows[1][1][:400]), (103, "z" * 401), (104, "z" * 400)]
    want = removed(rows, 400)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == [w[:5] for w in want]
    assert 5 < sum(w[2] > 0 for w in want)


def test_nothing_and_nothing_repeated(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert got(docs.limit(0)) == []
    assert got(docs) == [(1, 3, 0, 0, hashlib.sha256(b"abc").hexdigest()), (2, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_one_id_and_one_text_on_a_third_of_all_rows(spark):
    rows = [(7, "the same long text over and over")] * 300 + [(7, f"text {i} of a shared id") for i in range(300)] + [(i, f"{i} alone {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, SMALL, 500, 100) == [w[:5] for w in removed(rows, SMALL.window)]
