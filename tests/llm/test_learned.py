"""Language codes, the positive-unlabelled classifier and the divergence rules."""

import os
import random

import duckdb
import numpy as np
import plain
import pytest

from loomgraph.llm import divergence as div
from loomgraph.llm import language_id as lid
from loomgraph.llm import quality_pu as pu
from loomgraph.llm.frames import table
from loomgraph.llm.sql import divergence_sql

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 40])
def test_codewords_differ_in_many_bits(n):
    code = lid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    least = {1: 0, 2: 1, 3: 2, 4: 4, 5: 8}.get(n, code.shape[1] // 5)
    assert min(apart, default=0) >= least
    assert all(abs(column.sum()) < n for column in code.T)


def _languages(draw, n):
    syllables = {"en": "the ing an of to er".split(), "fr": "le ou é que ai tre".split(), "de": "sch ein ü und ge ten".split()}
    syllables |= {"es": "ción os ñ el la do".split(), "xx": "kw zz qq kk wk zq".split(), "yy": "bam bum bim pom pum pam".split()}
    for i in range(n):
        lang = draw.choice(sorted(syllables))
        yield i, lang, " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(4, 60)))


@pytest.mark.parametrize("names", [("en", "fr"), ("en", "fr", "de", "es", "xx", "yy")])
def test_languages_are_told_apart(spark, names):
    rows = [r for r in _languages(random.Random(2), 600) if r[1] in names]
    labelled = spark.createDataFrame(rows[::2], "doc_id long, lang string, text string")
    model = lid.train(labelled)
    assert model.languages == sorted(names)
    fresh = spark.createDataFrame(rows[1::2] + [(None, None, t) for t in (None, "", "12 ;")], "doc_id long, lang string, text string")
    got = lid.identify(fresh.withColumn("score", fresh["lang"]), model).collect()
    truth = {i: lang for i, lang, _ in rows}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert [(r.lang_pred, r.score) for r in got if r.doc_id is None] == [("und", 0.0)] * 3
    assert lid.identify(fresh.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "hello", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in lid.identify(docs, lid.train(docs)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(1, "hello", "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in lid.identify(one, lid.train(one)).collect()] == [("en", 1.0)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pu.train(docs, labels) is None
    assert {(r.score, r.predicted) for r in pu.scores(docs, None).collect()} == {(1.0, 1)}
    assert pu.good(docs, None).count() == 2


def test_languages_of_one_shared_id(spark):
    """A third of the labelled rows shares an id, and so does a whole language; both count as one row."""
    rows = [r for r in _languages(random.Random(3), 900) if r[1] in ("en", "fr", "xx")]
    rows = [(1, "en", "the same row")] * 10_000 + [(-5 if lang == "xx" else i, lang, t) for i, lang, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = lid.train(docs)
    assert model.languages == ["en", "fr", "xx"]
    fresh = spark.createDataFrame([(i, t) for i, (_, lang, t) in enumerate(_languages(random.Random(4), 200)) if lang == "fr"], "doc_id long, text string")
    assert np.mean([r.lang_pred == "fr" for r in lid.identify(fresh, model).collect()]) > 0.9


def test_training_and_decoding_as_defined(spark):
    """The model and its decisions against a plain reading of the definitions, on a table small enough to take whole."""
    rows = [r for r in _languages(random.Random(6), 80) if r[1] in ("de", "en", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = lid.train(docs)
    want = lid.fit(np.array([lid.features(t) for _, _, t in sorted(rows)]), [lang for _, lang, _ in sorted(rows)])
    assert np.allclose(model.weights, want.weights, atol=1e-5) and np.allclose(model.trust, want.trust)
    for r in lid.identify(docs, model).collect():
        x = lid.features(next(t for i, _, t in rows if i == r.doc_id)).astype(float)
        losses = []
        for bits, trust in zip(model.code, model.trust, strict=True):
            margins = [x @ w + b for w, b in zip(model.weights.T, model.bias, strict=True)]
            losses.append(len(bits) * sum(t * np.log1p(np.exp(-c * m)) for c, t, m in zip(bits, trust, margins, strict=True)))
        p = np.exp(min(losses) - np.array(losses))
        assert r.lang_pred == model.languages[int(np.argmin(losses))] and abs(r.score - p.max() / p.sum()) < 1e-4


def test_one_id_holds_a_third_of_all_rows(spark):
    draw = random.Random(2)
    rows = [(7, f"junk | {i} | # $ %", "x") for i in range(3000)] + [(7, "one row | #", "y")] * 3000
    rows += [(100 + i, " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) if i % 2 else "# $ | % " * 20, "z") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, positive string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = pu.train(docs, labels)
    assert 0.05 <= model.prior <= 0.99 and model.labelled_share == 0.5
    got = pu.scores(docs.where("doc_id >= 400"), model).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


@needs_tables
def test_held_out_languages(spark):
    docs = table(spark, FOLDER, "documents")
    got = lid.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.99


@needs_tables
def test_held_out_quality(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    got = pu.held_out_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_risk_without_negatives_finds_them():
    draw = np.random.default_rng(5)
    positives = draw.normal(1, 1, (400, 6))
    unlabelled = np.concatenate([draw.normal(1, 1, (700, 6)), draw.normal(-1, 1, (300, 6))])
    model = pu.fit(positives, unlabelled, 0.7)
    fresh = model.score(np.concatenate([draw.normal(1, 1, (500, 6)), draw.normal(-1, 1, (500, 6))])) >= 0.5
    assert fresh[:500].mean() > 0.93 and fresh[500:].mean() < 0.07
    rough = pu.fit(positives, unlabelled, 0.5)
    assert abs(pu.prior_from_scores(rough.score(positives), rough.score(unlabelled)) - 0.7) < 0.1


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(plain.ODD)] + [(None, "x" * 50_000, "s")], "doc_id long, text string, score string")
    model = pu.fit(np.random.default_rng(1).random((50, pu.N_FEATURES)), np.random.default_rng(2).random((50, pu.N_FEATURES)), 0.6)
    got = pu.scores(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert pu.scores(docs.limit(0), model).count() == 0
    kept = {r.text for r in pu.good(docs, model).collect()}
    by_id = {i: t for i, t in enumerate(plain.ODD)} | {None: "x" * 50_000}
    assert kept == {by_id[r.doc_id] for r in got if r.predicted}


def _rows_for_rules():
    draw = random.Random(7)
    texts = [*plain.ODD, "a b c " * 40, "\n\n", "x\nx\ny\n\ny\n", "# * $ % & | < >", "w " * 60]
    common = sorted(div.COMMON_WORDS)
    for _ in range(60):
        words = [draw.choice(common) if draw.random() < 0.4 else draw.choice("abcdefgh") * draw.randint(2, 6) for _ in range(draw.randint(30, 300))]
        texts.append("".join(w + draw.choice(["\n", " ", " ", ". "]) for w in words))
    texts += ["".join(draw.choice("#*$%&|<>ab ") for _ in range(900)), " ".join(["zz%d" % i for i in range(200)])]
    langs = ["en", "de", None, "", "en"]
    return [(None if i == 3 else i, t, langs[i % 5]) for i, t in enumerate(texts)] + [(7, texts[7], "de")] * 2


def test_divergence_rules(spark):
    rows = _rows_for_rules()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_words int")
    got = div.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=str) == sorted(((d, *plain.counts(t)) for d, t, _ in rows), key=str)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert all(0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1 for r in got)
    assert any(r.kept for r in got) and any(not r.kept and not r.base_failed for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cursor = con.execute(divergence_sql())
    columns = [d[0] for d in cursor.description]
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got)
    assert div.judge(docs.limit(0)).count() == 0


def test_rare_and_unnamed_languages_are_not_held_against_others(spark):
    """Clean Cyrillic text among much Latin text stays, in a language under a thousandth of the rows and without one; by both engines."""
    draw = random.Random(3)
    latin = [(i, " ".join(draw.choice(["the", "of", "house", "river", "and", "green"]) + str(draw.randint(0, 99)) for _ in range(60)), "en") for i in range(2100)]
    cyrillic = [" ".join(draw.choice(["река", "дом", "зелёный", "лес", "и", "поле"]) + draw.choice("абвгд") for _ in range(120)) for _ in range(4)]
    rows = latin + [(9000 + i, t, lang) for i, (t, lang) in enumerate(zip(cyrillic, ["ru", "ru", None, ""], strict=True))] + [(9100, "# | " * 200, "xx")]
    got = {r.doc_id: r for r in div.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[9000 + i].kept for i in range(4)) and not got[9100].kept
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows[-200:])
    few = {r.doc_id: r.kept for r in div.judge(spark.createDataFrame(rows[-200:], "doc_id long, text string, lang string")).collect()}
    cursor = con.execute(divergence_sql())
    place = {d[0]: i for i, d in enumerate(cursor.description)}
    assert {r[place["doc_id"]]: r[place["kept"]] for r in cursor.fetchall()} == few


def test_distance_is_jensen_shannons(spark):
    p, q = np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    want = ((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, q, strict=True)], "p double, q double")
    got = rows.select(div._entropy_term(rows["p"], rows["q"]).alias("x")).groupBy().sum("x").first()[0]
    assert abs(got - want) < 1e-12


def test_features_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = " ".join(random.Random(2).choice(["Das", "ist", "ein", "TEST!", "§4", "é\n"]) for _ in range(3000))
    language, quality = lid.features(text), pu.features(text)
    monkeypatch.setattr(lid, "STRETCH", 97)
    monkeypatch.setattr(pu.W, "STRETCH", 97)
    assert np.allclose(lid.features(text), language) and np.allclose(pu.features(text), quality)

def test_rare_languages_are_learned(spark):
    # "yy" holds 6 of 9 006 labelled rows, under a thousandth.
    draw = random.Random(4)
    rows = [(i, *r[1:]) for i, r in enumerate(r for r in _languages(draw, 30_000) if r[1] == "en")]
    common = [rows[i % len(rows)] for i in range(9_000)]
    rare = [(10_000 + i, *r[1:]) for i, r in enumerate(r for r in _languages(draw, 600) if r[1] == "yy")]
    labelled = [(i, *r[1:]) for i, r in enumerate(common)] + rare[:6]
    model = lid.train(spark.createDataFrame(labelled, "doc_id long, lang string, text string"))
    assert model.languages == ["en", "yy"]
    got = lid.identify(spark.createDataFrame(rare[6:], "doc_id long, lang string, text string"), model).collect()
    assert np.mean([r.lang_pred == "yy" for r in got]) > 0.97


def test_an_id_in_two_languages_hides_neither(spark):
    rows = [(i % 3, lang, f"{lang} {i}") for i, lang in enumerate(["aa"] * 9 + ["bb"] * 3)]
    assert lid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string")).languages == ["aa", "bb"]


def test_decoding_sums_losses_over_bits():
    draw = np.random.default_rng(1)
    code = lid.codewords(9)
    model = lid.Model([str(i) for i in range(9)], code, draw.normal(size=(20, code.shape[1])), draw.normal(size=code.shape[1]), draw.random(code.shape))
    x = draw.random((5, 20))
    margins = x @ model.weights + model.bias
    distance = (np.logaddexp(0, -code[None] * margins[:, None, :]) * model.trust[None]).sum(axis=2) * code.shape[1]
    want = np.exp(distance.min(axis=1, keepdims=True) - distance)
    assert np.allclose(model.decode(x)[0], want / want.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_rare_languages_have_their_own_reference(spark, threshold):
    # Two of 2 102 rows are Greek, under a thousandth.
    draw = random.Random(3)
    made = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(draw.randint(3, 7))) for _ in range(60))
    rows = [(i, made("abcdefghij"), "en") for i in range(2_100)] + [(5_000 + i, made("αβγδεζηθικ"), "el") for i in range(2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.doc_id: r for r in div.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(rows) and all(r.kept for r in got.values())
    assert all(got[5_000 + i].class_distance < div.MAX_CLASS_DISTANCE for i in range(2))
