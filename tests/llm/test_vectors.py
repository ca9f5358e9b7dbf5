"""Vector codes and hard negatives against plain definitions."""

import hashlib
import random
from collections import Counter, defaultdict
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from loomgraph import durable
from loomgraph.llm import hard_negatives as H
from loomgraph.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, x long, part int"


def kept(rows, scale):
    found = [(i, tuple(floor(scale * v) for v in x), label) for i, x, label in rows if x and all(v is not None and isfinite(v) for v in x)]
    sizes = Counter(len(x) for _, x, _ in found)
    most = max(sizes, key=lambda d: (sizes[d], d), default=0)
    return [r for r in found if len(r[1]) == most]


def codes(rows, parts=4, entries=256, rounds=4):
    rows = kept(rows, 1024)
    first = {}
    for i, x, _ in rows:
        if i is not None:
            first[i] = min(first.get(i, x), x)
    width = -(-len(rows[0][1]) // parts)
    cut = lambda x: [(*x, *[0] * parts)[p * width : p * width + width] for p in range(parts)]
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, x, _ in rows:
                own[nearest(cut(x)[p], books[p])[1]].append(cut(x)[p])
            for k, members in own.items():
                books[p][k] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    out, by = [], Counter()
    for i, x, label in rows:
        best = [nearest(cut(x)[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(((i, code, e, by[label], sha) for i, code, e, label in out), key=str)


def negatives(rows, every=100):
    rows = [(i, x, (label + 1) % 10 if i % 7 == 0 else label) for i, x, label in rows if i is not None and label is not None]
    rows = [(i, np.array(x, object), label) for i, x, label in kept(rows, 256)]
    out = set()
    for a, x, label in rows:
        if a % every:
            continue
        same, other = defaultdict(lambda: -inf), defaultdict(set)
        for i, y, v in rows:
            score = int((x * y).sum())
            if v == label and i != a:
                same[i] = max(same[i], score)
            elif v != label:
                other[i].add(score)
        for p, ps in sorted(same.items(), key=lambda s: (-s[1], s[0]))[:5]:
            fit = {i: max(s) for i, scores in other.items() if (s := [n for n in scores if 30 * ps <= 100 * n <= 90 * ps])}
            for rank, (n, ns) in enumerate(sorted(fit.items(), key=lambda s: (-s[1], s[0]))[:10], 1):
                out.add((a, p, rank, n, ps, ns))
    return sorted(out)


def vectors(draw, n, size=8, step=1):
    return [(i * step, [draw.gauss(0, 0.3) for _ in range(size)], draw.choice([*range(9), None])) for i in range(n)]


def odd(draw, size=8):
    whole = [draw.gauss(0, 0.3) for _ in range(size)]
    return [(1, None, 2), (2, [], 2), (3, [None, *whole[1:]], 1), (4, [nan, *whole[1:]], 1), (5, [*whole[1:], inf], 1), (6, whole[:3], 1), (None, whole, 3)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 8) for r in rows], SCHEMA).repartition(3)


def coded(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("size", "entries", "rows_each"), [(8, 256, 100_000), (6, 16, 7), (8, 3, 1)])
def test_codes(spark, size, entries, rows_each):
    draw = random.Random(size * entries)
    rows = vectors(draw, 150, size)
    # Single precision before scaling, as stored.
    rows = [(i, np.array(x, np.float32).tolist(), v) for i, x, v in rows]
    rows += [(*r[:1], np.array(r[1], np.float32).tolist() if r[1] and None not in r[1] else r[1], r[2]) for r in odd(draw, size)]
    rows += [(7, rows[20][1], 4), *[rows[40]] * 60, (None, rows[41][1], None), (500, [9e4] * size, 1)]
    assert coded(V.compressed(frame(spark, rows), entries=entries, owner_rows=rows_each)) == codes(rows, entries=entries)


def test_codes_of_nothing(spark):
    assert coded(V.compressed(frame(spark, []))) == []
    none = hashlib.sha256(b"").hexdigest()
    assert coded(V.compressed(frame(spark, [(None, [0.5] * 8, 1), (1, None, 1)]))) == [(None, "", 0, 0, none)]


def test_distances_are_exact_at_any_size():
    draw = random.Random(3)
    for most in (10, 1 << 20, V.MOST):
        x, book = ([[draw.randint(-most, most) for _ in range(16)] for _ in range(n)] for n in (20, 9))
        index, distance = V.nearest(np.array(x), np.array(book))
        want = [min((sum((a - b) ** 2 for a, b in zip(r, c, strict=True)), k) for k, c in enumerate(book)) for r in x]
        assert [(int(d), int(k)) for d, k in zip(distance, index, strict=True)] == want


def test_only_movers_are_shuffled(spark):
    """A second round over settled members moves none of them."""
    draw = random.Random(5)
    rows, size, n = V.integer_rows(frame(spark, vectors(draw, 200)))
    books = V.train(rows, size, n, entries=4, rounds=30)
    cuts = [rows.selectExpr(f"{p} AS position", "-1 AS entry", "0 AS salt", f"slice(x, {2 * p + 1}, 2) AS part") for p in range(4)]
    parts = cuts[0].unionByName(cuts[1]).unionByName(cuts[2]).unionByName(cuts[3])
    settled = V._settle(parts, books)
    again = V._settle(V._housed(settled), V._updated(settled, books))
    assert settled.where("moved").count() == 800 and again.where("moved").count() == 0


@pytest.mark.parametrize(("low", "high", "kind"), [(-160, 150, np.float64), (-9000, 9000, np.uint64), (-(1 << 30), 1 << 30, object)])
def test_packed_products_are_exact(low, high, kind):
    draw = random.Random(high)
    x, a = ([[draw.choice([low, high, draw.randint(low, high)]) for _ in range(12)] for _ in range(n)] for n in (23, 4))
    packing = H.Packing.of(12, low, high)
    assert packing.kind is kind and packing.fields > 1
    x, a = np.array(x), np.array(a)
    got = packing.scores(packing.pack(x), x, a)
    assert got.tolist() == (x.astype(object) @ a.astype(object).T).tolist()


@pytest.mark.parametrize(("block", "anchors"), [(65_536, 512), (10, 2)])
def test_negatives(spark, block, anchors):
    draw = random.Random(block)
    rows = vectors(draw, 400, step=5)
    rows += [*odd(draw), *[rows[40]] * 30, (200, rows[3][1], 5), (35, rows[4][1], 2), (15, rows[5][1], 1), *[rows[60]] * 10]
    rows += [(9, rows[20][1], 0), (11, rows[20][1], 0), (13, rows[20][1], 1)]
    rows = [(i, x and [None if v is None else float(np.float32(v)) for v in x], label) for i, x, label in rows]
    found = H.mined(H.relabelled(frame(spark, rows)), candidate_rows=block, anchor_rows=anchors)
    assert coded(found.distinct()) == sorted(negatives(rows), key=str) and found.count() > 100


def test_copies_of_anchors_do_not_go_through_the_driver(spark):
    """Blocks and anchors that look small enough to be broadcast meet in a shuffle: the anchors are copied for each cell."""
    block = durable.cut(spark.createDataFrame([(7, b"", b"", b"", b"", None, None)], H._BLOCK))
    met = H._met(block, block, 3)
    assert met.count() == 1
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_negatives_of_nothing(spark):
    assert coded(H.mined(frame(spark, []))) == [] == coded(H.mined(frame(spark, [(100, None, 1), (7, [0.1] * 8, 2)])))
    # An anchor alone, and one whose positive has a negative score.
    assert coded(H.mined(frame(spark, [(100, [0.1] * 8, 2)]))) == []
    assert coded(H.mined(frame(spark, [(100, [0.1] * 8, 2), (1, [-0.1] * 8, 2), (2, [0.1] * 8, 3)]))) == []
