"""One very long text among odd ones goes through every operator whole."""

import hashlib

import numpy as np
import plain
import pytest

from loomgraph.llm import decontaminate, divergence, language_id, licenses, near_dedup, packing, quality_pu, secret_scan, substring_dedup, warc
from loomgraph.llm.queries import public_vocabulary

WORDS = [f"w{i % 20_000}é" for i in range(60_000)]
END = " the very last passage of this text token = 'abcdefgh_12345678'\nReleased under the MIT License."
LONG = " ".join(WORDS) + END
ROWS = [(1, LONG, "en"), (2, None, None), (3, "", "de"), (4, "some short text", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


def _of(df, doc_id=1):
    (row,) = df.where(f"doc_id = {doc_id}").collect()
    return row


def test_substring_dedup(docs):
    got = _of(substring_dedup.strip_repeats(docs))
    assert (got.n_words, got.n_removed, got.text) == (len(plain.words(LONG)), 60_000, " ".join(plain.words(END)))
    assert got.kept_sha256 == hashlib.sha256(got.text.encode()).hexdigest()


def test_near_duplicates(docs):
    assert _of(near_dedup.near_duplicates(docs)).n_shingles == len(plain.shingles(LONG))


def test_secrets(docs):
    start = LONG.index("token")
    assert _of(secret_scan.report(docs)).spans == f"assign:{start}:{start + len("token = 'abcdefgh_12345678")}"


def test_languages_and_quality(docs):
    model = language_id.train(docs)
    assert _of(language_id.identify(docs, model)).lang_pred == "en"
    draw = np.random.default_rng(1)
    pu = quality_pu.fit(draw.random((30, quality_pu.N_FEATURES)), draw.random((30, quality_pu.N_FEATURES)), 0.5)
    assert 0 <= _of(quality_pu.scores(docs, pu)).score <= 1


def test_divergence(docs):
    got = _of(divergence.judge(docs))
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == plain.counts(LONG) and got.base_failed


def test_packing(docs):
    pieces = packing.pack(docs.where("doc_id = 1"), **public_vocabulary()).collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens > 200_000 and max(p.length for p in pieces) <= 2048


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(7, "The  very last passage of thus text")], "item_id long, text string")
    got = _of(decontaminate.contamination(docs, bench))
    assert (got.item_id, got.distance) == (7, 1) and decontaminate.normalized(LONG)[got.start : got.stop] == "the very last passage of this text"


def test_licenses(spark):
    files = spark.createDataFrame([(1, "a/b.txt", LONG)], "doc_id long, path string, text string")
    assert _of(licenses.scan(files)).license == "MIT"


def test_archives(spark):
    pages = spark.createDataFrame([(1, "http://a", LONG), (2, "http://b", LONG)], "page_id long, url string, html string")
    got = sorted(tuple(r)[:5] for r in warc.round_trip(pages).collect())
    assert got == plain.records([(1, "", LONG), (2, "", LONG)])
