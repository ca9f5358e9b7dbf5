"""Secrets, benchmark passages and licences."""

import hashlib
import math
import random
import zlib
from collections import Counter

import plain
import pytest

import corpus_pipeline
from loomgraph.llm import decontaminate as dec
from loomgraph.llm import licenses, queries
from loomgraph.llm import secret_scan as sec


def _plain_secrets(text):
    out = [("assign", *m.span()) for m in sec.ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in sec.ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in sec.HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], sec.KINDS.index(s[0])))


def _random_text(draw):
    parts = ["password", "PassWD", "token=", "api_key", "apikey:", " ", '"', "'", "AKIA", "ABCDEF0123", "0123456789abcdef", "deadbeef", "é", "İ", "ſecret", "=", "xyz12345", "\n", "_", 'secret = "abcdefgh1"']
    return "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))


def test_plain_kinds_are_found_as_a_full_scan_finds_them():
    draw = random.Random(3)
    for _ in range(3000):
        text = _random_text(draw)
        assert [s for s in sec.find_secrets(text) if s[0] in ("assign", "access", "hex")] == _plain_secrets(text)


def _base62(n, width):
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = sec.BASE62[r] + out
    return out.rjust(width, "0")


def _base58(raw):
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = sec.BASE58[r] + out
    return out


def test_checksums_decide():
    body = "abcdefghij0123456789ABCDEFGHIJ"
    token = "ghp_" + body + _base62(zlib.crc32(body.encode()), 6)
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    key = _base58(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4])
    note = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"
    file_key = "AGE-SECRET-KEY-1GFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPQ4EGAEX"
    for kind, secret in (("github", token), ("xprv", key), ("nsec", note), ("age", file_key), ("npm", token.replace("ghp", "npm"))):
        assert [s for s in sec.find_secrets(f"é {secret}.") if s[0] == kind] == [(kind, 2, 2 + len(secret))], kind
        wrong = secret[:-1] + ("0" if secret[-1] != "0" else "2")
        assert not [s for s in sec.find_secrets(f"é {wrong}.") if s[0] == kind], kind


def test_report_and_redaction(spark):
    text = 'é token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end'
    rows = [(1, text, "x"), (None, None, "y"), (2, "", "z"), (1, text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    spans = ",".join("%s:%d:%d" % s for s in _plain_secrets(text))
    found = (1, 1, 0, 1, hashlib.sha256(spans.encode()).hexdigest(), spans)
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted((tuple(r) for r in sec.report(docs).collect()), key=str)
    assert got == sorted([found, found, (None, 0, 0, 0, empty, ""), (2, 0, 0, 0, empty, "")], key=str)
    assert sorted(((r.doc_id, r.text) for r in sec.redacted(docs).collect()), key=str) == sorted(
        [(1, "é <secret>\" end")] * 2 + [(None, None), (2, "")], key=str
    )
    assert sec.report(docs.limit(0)).count() == 0


def test_report_is_the_full_scan_on_random_texts(spark):
    draw = random.Random(8)
    rows = [(i, _random_text(draw)) for i in range(300)]
    got = {r.doc_id: r.spans for r in sec.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ",".join("%s:%d:%d" % s for s in _plain_secrets(t)) for i, t in rows}


def test_bit_parallel_distance():
    draw = random.Random(3)
    for _ in range(300):
        p, t = ("".join(draw.choice("abc") for _ in range(draw.randint(1, n))) for n in (90, 150))
        assert dec.best_end(dec._masks(p), len(p), t) == plain.edits(p, t)


def _items(draw, n=20):
    return [(i, " ".join("".join(draw.choice("abcde") for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(3, 40)))) for i in range(n)]


def _leaks(draw, items, n):
    for _ in range(n):
        q = list(dec.normalized(draw.choice(items)[1]))
        for _ in range(draw.randint(0, int(0.1 * len(q)))):
            k, kind = draw.randrange(len(q)), draw.random()
            if kind < 0.33:
                q[k] = draw.choice("abcde")
            elif kind < 0.66 and len(q) > 1:
                del q[k]
            else:
                q.insert(k, "x")
        yield "foo " * draw.randint(0, 9) + "".join(q).upper() + "  bar" * draw.randint(0, 9)


@pytest.mark.parametrize("block_chars", [2_000_000, 500])
def test_contamination(spark, block_chars):
    draw = random.Random(6)
    items = [*_items(draw), (77, None), (78, " "), (None, "a text without an id of its own")]
    rows = [(i, t) for i, t in enumerate([*plain.ODD, *_leaks(draw, items[:20], 120)])]
    want = set()
    for i, text in rows:
        for j, item in items:
            pattern = dec.normalized(item)
            if j is not None and len(pattern) >= dec.MIN_CHARS:
                distance, _ = plain.edits(pattern, dec.normalized(text))
                if distance <= int(dec.EDIT_RATE * len(pattern)):
                    want.add((i, j, distance))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dec.contamination(docs, bench, block_chars=block_chars).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == want and len(found) == len(want)
    texts, named = dict(rows), dict(items)
    for r in found[:40]:
        assert plain.edits(dec.normalized(named[r.item_id]), dec.normalized(texts[r.doc_id])[r.start : r.stop], whole=True) == r.distance
    kept = {r.doc_id for r in dec.decontaminated(docs, bench, block_chars=block_chars).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _, _ in want}
    assert dec.contamination(docs, bench.limit(0)).count() == 0 and dec.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_chars", [2_000_000, 10])
def test_short_items_and_items_without_id(spark, block_chars):
    items = [(1, "Why  not?"), (2, "日本の首都は東京です"), (None, "a question that has no id"), (4, " "), (5, "cat"), (6, "क")]
    texts = ["so WHY NOT? he said", "why nothing", "何、日本の首都は東京ですか", "x a question that has no id y", "concatenate", "(cat)", "कि", "", None, "cats cat cat"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dec.contamination(docs, bench, block_chars=block_chars, short=True).collect()
    assert {tuple(r) for r in got} == {(0, 1, 0, 3, 11), (2, 2, 0, 2, 12), (3, None, 0, 2, 27), (5, 5, 0, 1, 4), (9, 5, 0, 5, 8)}
    assert {r.doc_id for r in dec.decontaminated(docs, bench, block_chars=block_chars, short=True).collect()} == {1, 4, 6, 7, 8}
    assert {r.doc_id for r in dec.decontaminated(docs, bench, block_chars=block_chars).collect()} == {*range(10)} - {3}


def test_the_registered_run_looks_for_short_items(spark, monkeypatch):
    tables = {
        "documents": spark.createDataFrame([(1, "so why not? he said"), (2, "other")], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(9, "Why not?")], "item_id long, text string"),
    }
    monkeypatch.setattr(queries, "table", lambda s, folder, name: tables[name])
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, folder, name: tables[name])
    assert [(r.doc_id, r.item_id) for r in queries.QUERIES["op8_benchmark_decontamination"](spark, "").collect()] == [(1, 9)]
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, tables["documents"], "").collect()] == [2]


def test_licenses_are_own_or_inherited(spark):
    mit, apache = "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny"
    full = next(t for name, t in licenses.TEMPLATES if name == "GPL-3.0" and len(t) > 200)
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c.txt", "hello"), (3, "a/b/d.txt", apache), (4, "z.txt", "hi license to kill"), (5, None, "hi"),
        (6, "a/b/COPYING", None), (7, "a/q/LICENSE.md", full), (8, "a/q/r/s.py", ""), (None, "a/q/r/t.py", None), (2, "a/b/c.txt", "hello"),
    ]
    files = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, path string, text string, license string")
    got = sorted(((r.doc_id, r.license, r.origin, r.inherited_from) for r in licenses.scan(files).collect()), key=str)
    assert got == sorted(
        [
            (1, "MIT", "own", None), (2, "MIT", "inherited", "a/LICENSE"), (2, "MIT", "inherited", "a/LICENSE"), (3, "Apache-2.0", "own", None),
            (4, None, "none", None), (5, None, "none", None), (6, "MIT", "inherited", "a/LICENSE"), (7, "GPL-3.0", "own", None),
            (8, "GPL-3.0", "inherited", "a/q/LICENSE.md"), (None, "GPL-3.0", "inherited", "a/q/LICENSE.md"),
        ],
        key=str,
    )
    assert licenses.scan(files.limit(0)).count() == 0


def test_every_template_is_its_own_license(spark):
    rows = [(i, f"f{i}.txt", f"Some text.\n{t}\nMore.") for i, (_, t) in enumerate(licenses.TEMPLATES) if licenses.re.search(licenses.SPEAKS_OF_LICENSING, t)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {i: licenses.TEMPLATES[i][0] for i, _, _ in rows}


def _license(text, least=licenses.LEAST_COSINE):
    """Best template of any stretch of words of any template's length, by the plain formula."""
    vectors, idf, other = licenses._vectors()
    best = (0.0, None)
    own = licenses.words(text)
    for t, (name, template) in enumerate(licenses.TEMPLATES):
        n = len(licenses.words(template))
        needed = licenses._telling(template)
        for at in range(max(1, len(own) - n + 1)):
            part = Counter(own[at : at + n])
            marks = {w for w in part if w in licenses.FAMILY_WORDS and w not in licenses.words(template)}
            if needed - set(part) or marks:
                continue
            w = {x: (1 + math.log(k)) * idf.get(x, other) for x, k in part.items()}
            cosine = sum(v * vectors[t].get(x, 0) for x, v in w.items()) / math.sqrt(sum(v * v for v in w.values()))
            best = max(best, (round(cosine, 6), name))
    return best if best[0] >= least else (None, None)


def _own(spark, texts):
    files = spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    return {r.doc_id: (r.score, r.license) for r in licenses.scan(files).collect()}


def test_notices_inside_long_lines(spark):
    draw = random.Random(4)
    prose = lambda n: " ".join(draw.choice("alpha beta gamma delta license of the work copyright free use".split()) for _ in range(n))
    notices = [t for name, t in licenses.TEMPLATES]
    texts = [f"{prose(draw.randint(30, 60))} {t} {prose(draw.randint(30, 60))}" for t in notices] + [prose(300)]
    texts.append("x" * 25_000 + " " + next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 300))
    got = _own(spark, texts)
    for i, text in enumerate(texts):
        score, name = _license(text)
        # The whole line is compared, too, but never beats the window that the notice fills.
        assert got[i][1] == name and (score is None or abs(got[i][0] - score) < 1e-5), (i, got[i], score, name)
    assert [got[i][1] for i in range(len(notices))] == [n for n, _ in licenses.TEMPLATES] and got[len(notices)] == (None, None)
    assert got[len(notices) + 1] == (1.0, "Apache-2.0")


def test_versions_and_families_have_to_agree(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = [gnu.format(2), gnu.format(3), gnu.format(1), gnu.format(3).replace("General", "Affero General"), "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-SA 4.0."]
    assert [_own(spark, texts)[i][1] for i in range(6)] == ["GPL-2.0", "GPL-3.0", None, "AGPL-3.0", None, "CC-BY-SA-4.0"]


def test_repeated_rows_change_no_score(spark):
    row = (1, "a/b.txt", "Licensed under the Apache License, Version 2.0, as far as we know.")
    one, many = (spark.createDataFrame([row] * n, "doc_id long, path string, text string") for n in (1, 50))
    (want,) = {tuple(r) for r in licenses.scan(one).collect()}
    assert {tuple(r) for r in licenses.scan(many).collect()} == {want} and licenses.scan(many).count() == 50
