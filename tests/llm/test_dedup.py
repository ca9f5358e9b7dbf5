"""Substring and near-duplicate operators against plain definitions."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import near_dedup as near
from loomgraph.llm import words as W
from loomgraph.llm.substring_dedup import anchors, strip_repeats


def test_words_are_cut_and_hashed_alike_everywhere():
    draw = random.Random(4)
    for _ in range(200):
        text = "".join(draw.choice("ab é\t\n\x0b\x0c\r\x1c\x85x") for _ in range(draw.randint(0, 60)))
        data = text.encode()
        starts, ends = W.bounds(data)
        found = [data[s:e].decode() for s, e in zip(starts, ends, strict=True)]
        assert found == plain.words(text)
        hashes = W.hashes(data)
        assert len(hashes) == len(found) and len(set(hashes.tolist())) == len(set(found))
        assert [W.hashes(w.encode())[0] for w in found] == hashes.tolist()


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    data = b" ".join(b"w%d" % (i % 77) for i in range(3000))
    whole = W.hashes(data)
    monkeypatch.setattr(W, "STRETCH", 101)
    assert (W.hashes(data) == whole).all()


def test_every_window_holds_its_anchor():
    draw = random.Random(5)
    for _ in range(50):
        hashes = W.hashes(" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 90))).encode())
        place, first, last, _ = anchors(hashes, 12, 3)
        covered = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
        assert covered == list(range(max(0, len(hashes) - 11)))
        assert ((first >= place - 9) & (last <= place)).all()


def _sharing(draw, n):
    base = [[draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(200)] for _ in range(6)]
    for i in range(n):
        text = []
        for _ in range(draw.randint(1, 4)):
            at = draw.randint(0, 150)
            text += draw.choice(base)[at : at + draw.randint(10, 80)] + [draw.choice("abc") for _ in range(draw.randint(0, 20))]
        yield 10 + i, " ".join(text)


@pytest.mark.parametrize(("window", "seed"), [(35, 8), (12, 3)])
def test_strip_repeats(spark, window, seed):
    rows = [(None, t) for t in plain.ODD] + [(1, "x " * 100), (2, "x " * 90), (3, "a b c d e " * 20), *_sharing(random.Random(1), 40)]
    rows += [rows[-1], rows[-2], (rows[-1][0], "another text"), (None, rows[-3][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    got = sorted((tuple(r) for r in strip_repeats(docs, window, seed).collect()), key=str)
    assert got == plain.stripped(rows, window)
    assert any(r[2] for r in got) and strip_repeats(docs.limit(0)).count() == 0


def test_texts_of_one_id_with_equal_short_hashes_stay_apart(spark):
    shared, lone = " ".join(f"s{i}" for i in range(40)), " ".join(f"q{i}" for i in range(37))
    ends = spark.range(200_000).select(F.concat(F.lit(" e"), "id").alias("end"))
    left = ends.select(F.concat(F.lit(shared), "end").alias("a")).withColumn("h", F.hash("a"))
    right = ends.select(F.concat(F.lit(lone), "end").alias("b")).withColumn("h", F.hash("b"))
    a, b = left.join(right, "h").select("a", "b").orderBy("a", "b").first()
    rows = [(None, a), (None, b), (1, f"{shared} another end")]
    got = sorted((tuple(r) for r in strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain.stripped(rows, 35)


def test_many_rows_of_one_id_and_text(spark):
    """A third of all rows is one row repeated, a third shares its id: the work stays in proportion."""
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(7, shared)] * 2000 + [(7, f"{shared if i % 3 else ''} own {i} " + " ".join(f"t{(i * 31 + j) % 997}" for j in range(50))) for i in range(2000)]
    rows += [(i, f"{i} " * 40) for i in range(2000)]
    got = sorted((tuple(r) for r in strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=str)
    assert got == plain.stripped(rows, 35)


def _edited(draw, n):
    rows = []
    for i in range(n):
        if i > 10 and draw.random() < 0.7:
            w = draw.choice(rows)[1].split()
            for _ in range(draw.randint(0, max(1, len(w) // 25))):
                w[draw.randrange(len(w))] = draw.choice("abcdefgh")
            w = w[: -draw.randint(1, 3)] if draw.random() < 0.3 and len(w) > 4 else w
        else:
            w = [draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(draw.randint(3, 250))]
        rows.append((10 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rare", [1, 2, 64])
def test_near_duplicates(spark, monkeypatch, rare):
    monkeypatch.setattr(near, "RARE", rare)
    monkeypatch.setattr(near._rest, "__defaults__", (rare,))
    rows = [(2, ""), (3, None), (4, "a b"), (5, "A b"), (6, " \t"), (7, "a b c"), *_edited(random.Random(rare), 200)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(3)
    got = sorted(tuple(r) for r in near.near_duplicates(docs).collect())
    want = plain.near_groups(rows)
    assert got == want and len({r[2] for r in want}) < 150


def test_near_duplicates_of_one_hot_text(spark):
    base = [f"w{i}" for i in range(150)]
    draw, rows = random.Random(9), []
    for i in range(150):
        w = list(base)
        for _ in range(draw.randint(0, 9)):
            w[draw.randrange(150)] = draw.choice(["the", "of", f"e{i}", f"f{draw.randint(0, 9)}"])
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain.near_groups(rows)


def test_near_duplicates_without_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (None, "z"), (None, None), (9, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_duplicates(docs).collect()), key=str)
    assert got == sorted(
        [(None, 2, 9, False)] * 2 + [(9, 2, 9, True)] * 2 + [(None, 1, None, True), (None, 0, None, True)], key=str
    )
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets_do():
    draw = np.random.default_rng(3)
    for n, common in ((4, 3), (40, 30), (1000, 750)):
        agree = []
        for _ in range(300):
            pool = draw.integers(0, 2**63, 2 * n - common, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(pool[n - common :])
            agree.append((near.signature(a) == near.signature(b)).mean())
        assert abs(np.mean(agree) - common / (2 * n - common)) < 0.03
