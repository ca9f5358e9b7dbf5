"""Quality rules by distribution divergence, in DataFrame functions only.

A document's shares of character classes and of common words are compared with those of its language by the
Jensen-Shannon distance (the square root of the divergence to base 2, from 0 to 1). The references are sums over all
rows that pass the plain rules, one per language. Short texts have no reliable shares, so each test has a least length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# Tests and their guards.
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.55
MIN_CHARS = 200
MIN_LETTER_WORDS = 100
# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son elle",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words.split()})
CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "space": r"[ \t\n\x0B\f\r]+",
    "mark": r"[.,;:!?'\"()-]+",
    "symbol": r"[#*$%&|<>@/\\+=_~^`{}\[\]]+",
    "beyond": r"[^\x00-\x7F]+",
}
_SPACES = r"[ \t\n\x0B\f\r]+"


def _n(column: Column) -> Column:
    return column.cast("long")


def _without(text: Column, pattern: str) -> Column:
    """Code points that match: each pattern is a run of one class."""
    return _n(F.length(text) - F.length(F.regexp_replace(text, pattern, "")))


def features(docs: DataFrame) -> DataFrame:
    """Counts of each row's whole text, kept per row: no row meets another here."""
    text = F.col("text")
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    letters = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    rows = rows.select(
        "doc_id",
        "lang",
        F.length(text).cast("long").alias("n_chars"),
        F.array_remove(F.split(text, _SPACES), "").alias("words"),
        _without(text, r"[#*$%&|<>]+").alias("n_symbols"),
        lines.alias("lines"),
        letters.alias("letters"),
        F.array(*(_without(text, p) for p in CLASSES.values())).alias("classes"),
    )
    words = F.col("words")
    triples = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    common = F.filter("letters", lambda w: w.isin(COMMON_WORDS))
    rows = rows.select(
        "doc_id",
        "lang",
        "n_chars",
        F.size("words").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("classes")[list(CLASSES).index("space")]).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > 2, F.slice(triples, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")).alias("triples"),
        "classes",
        F.size("letters").cast("long").alias("n_letters"),
        common.alias("common"),
    )
    # Only texts with a repeated triple need to know where their triples stand.
    ordered = F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    listed = F.transform(
        F.array_distinct("common"), lambda w: F.struct(w.alias("w"), _n(F.size("common") - F.size(F.array_remove("common", w))).alias("n"))
    )
    rows = rows.withColumn("ordered", F.when(some, ordered)).withColumn("counts", listed).drop("triples")
    at = F.col("ordered")
    twice = F.filter(at, lambda x, j: (x["h"] == F.get(at, j - 1)["h"]) | (x["h"] == F.get(at, j + 1)["h"]))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("ordered", "common")
    starts = F.col("starts")
    # Each start covers three words, fewer if the next one is nearer.
    steps = F.transform(starts, lambda p, j: F.least(F.coalesce(F.get(starts, j + 1) - p, F.lit(3)), F.lit(3)))
    repeated = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", _n(F.coalesce(repeated, F.lit(0)))).drop("starts")


def _entropy_term(p: Column, q: Column) -> Column:
    """Half of what one outcome adds to the divergence."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (side(p) + side(q)) / 2


def references(counted: DataFrame) -> DataFrame:
    """Per language, however rare: shares of the character classes (array) and of the common words (map)."""
    keyed = counted.where("lang is not null and lang <> ''").select(F.col("lang").alias("ref"), "classes", "counts", "n_letters")
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    totals = keyed.groupBy("ref").agg(F.sum("n_letters").alias("letters"), *sums)
    each = keyed.select("ref", F.inline("counts")).groupBy("ref", "w").agg(F.sum("n").alias("n"))
    shares = (
        each.join(totals.select("ref", "letters"), "ref")
        .groupBy("ref")
        .agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("n") / F.col("letters")))).alias("word_shares"))
    )
    size = sum((F.col(f"c{i}") for i in range(len(CLASSES))), F.lit(0))
    classes = F.array(*(F.when(size > 0, F.col(f"c{i}") / size).otherwise(0.0) for i in range(len(CLASSES))))
    return totals.select("ref", classes.alias("class_shares")).join(shares, "ref", "left")


def distances(counted: DataFrame, refs: DataFrame) -> DataFrame:
    """``counted`` with ``class_distance`` and ``word_distance`` to its language; without a reference of its own a row is at no distance."""
    # As many rows as there are languages: Spark broadcasts them if they are small, or else joins by key.
    rows = counted.join(refs, F.col("lang") == F.col("ref"), "left")
    known = F.col("ref").isNotNull()
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    rows = rows.withColumnRenamed("class_shares", "q_classes").withColumn("q_words", F.coalesce("word_shares", none))
    size = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("size", size)
    zero = F.lit(0.0)
    # A text without a counted character has no shares: its distance is zero, and the guards leave it out anyway.
    by_class = F.aggregate(
        F.zip_with("classes", "q_classes", lambda n, q: F.when(F.col("size") > 0, _entropy_term(n / F.col("size"), q)).otherwise(zero)), zero, lambda a, x: a + x
    )
    terms = F.transform(
        "counts",
        lambda x: F.struct(
            (x["n"] / F.col("n_letters")).alias("p"), F.coalesce(F.try_element_at("q_words", x["w"]), zero).alias("q")
        ),
    )
    rows = rows.withColumn("terms", F.when(F.col("n_letters") > 0, terms))
    total = lambda what: F.aggregate("terms", zero, lambda a, x: a + what(x))
    seen = rows.withColumn("p_seen", total(lambda x: x["p"])).withColumn("q_seen", total(lambda x: x["q"]))
    q_common = F.aggregate(F.map_values("q_words"), zero, lambda a, x: a + x)
    # Common words that the text lacks add half their share; all other words are one outcome.
    by_word = total(lambda x: _entropy_term(x["p"], x["q"])) + (q_common - F.col("q_seen")) / 2 + _entropy_term(1 - F.col("p_seen"), 1 - q_common)
    root = lambda x: F.sqrt(F.greatest(F.coalesce(x, zero), zero))
    return seen.select(*counted.columns, *(F.when(known, root(x)).otherwise(zero).alias(n) for x, n in ((by_class, "class_distance"), (by_word, "word_distance"))))


def judge(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_letter_words: int = MIN_LETTER_WORDS,
) -> DataFrame:
    """``doc_id``, the counts, both distances, ``base_failed`` and ``kept`` of each row of ``docs`` (``doc_id, text, lang``).

    ``base_failed``: fewer than 50 words, or over half of them in three-word runs found twice. Else a row is dropped if
    its characters are too far from its language's and it has ``min_chars``, or its common words are and it has
    ``min_letter_words`` words of letters. Null texts count as empty; rows of null or empty ``lang``, and of a language
    none of whose rows passes the plain rules, have nothing to be compared with: the plain rules alone decide. Repeated rows and null ids are rows like others; an empty table gives no rows; other
    columns are ignored."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    counted = durable.cut(features(docs))
    rows = distances(counted, durable.cut(references(counted.where(~failed))))
    odd = (F.col("n_chars") >= min_chars) & (F.col("class_distance") > max_class_distance)
    odd = odd | ((F.col("n_letters") >= min_letter_words) & (F.col("word_distance") > max_word_distance))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False)))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"
    )
