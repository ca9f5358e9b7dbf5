"""Token search over entity names and aliases, ranked by BM25.

Work is shared before anything is paired: entities with the same tokens form one
profile that keeps its ``k`` smallest ids, and equal queries are evaluated once.
Pairs come from rare tokens only. Queries are also scored on their frequent tokens
alone, once per distinct set of frequent tokens, which finds every match that shares
no rare token. The union holds the exact top ``k`` of every query.

Frequent tokens have posting lists in blocks by the profile's length, each with a bound on what a profile of it can score.
A set is first scored on the ``k`` best profiles of each of its tokens. No other profile with one token of the set
can be among its ``k`` best, and the k-th score is a threshold for those with several: the longest lists that
together stay below it are never opened (MaxScore, Turtle & Flood, IPM 1995), and of the others only blocks whose bound
reaches it (cf. Ding & Suel, "Block-max indexes", SIGIR 2011)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions.text import words
from loomgraph.operators.skew import top_per_key
from loomgraph.schemas import BM25_B, BM25_K1

RARE_PROFILES = 1000
# Profiles of one token and length that one task pairs with the sets asking for them.
BLOCK_PROFILES = 20_000
# Bounds are added up in another order than scores: this much rounding never hides a block.
SLACK = 1 + 1e-9


def entity_tokens() -> Column:
    return F.concat(words(F.col("name")), F.flatten(F.transform(F.col("aliases"), words)))


def _profiles(entities: DataFrame, scope: list[str], k: int) -> DataFrame:
    """``scope, tokens, n, ids, first_id``: entities sharing a bag of tokens, with their ``k`` smallest ids.

    ``first_id`` names the profile within its scope."""
    bags = entities.select(*scope, "id", F.array_sort(entity_tokens()).alias("tokens")).where(F.size("tokens") > 0)
    first = top_per_key(bags, [*scope, "tokens"], [F.col("id")], k)
    ids = first.groupBy(*scope, "tokens").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sizes = bags.groupBy(*scope, "tokens").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(ids, [*scope, "tokens"]).withColumn("first_id", F.col("ids")[0])


def _at_first_match(terms: Column) -> Column:
    """Keeps one row per query and profile: the one at the first of ``terms`` in the profile."""
    return F.col("token") == F.filter(terms, lambda t: F.array_contains(F.col("tokens"), t.token))[0].token


def _impact(tf: Column, length: Column, average: Column) -> Column:
    """What ``tf`` occurrences in a name of this length count for; grows with ``tf`` and falls with the length."""
    tf = tf.cast("double")
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))


def _times(token: Column, tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def _score(terms: Column, tokens: Column, average: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term.idf * _impact(_times(term.token, tokens), F.size(tokens), average))


def _best_of_sets(sets: DataFrame, postings: DataFrame, scope: list[str], k: int, block: int) -> DataFrame:
    """``scope, common, tokens, first_id, score``: the ``k`` best profiles of each set of frequent tokens by these alone.

    ``sets`` has ``common`` (token, idf, held, top of each) and ``average``; ``postings`` are those of frequent tokens."""
    # A token's repeats in a name, whichever token it is, are at most these.
    repeats = F.col("length") - F.size(F.array_distinct("tokens")) + 1
    shelf = [*scope, "token", "length"]
    blocks = postings.groupBy(*shelf).agg(F.count(F.lit(1)).alias("n_block"), F.max(repeats).alias("repeats"))
    blocks = durable.cut(blocks.withColumn("salts", F.ceil(F.col("n_block") / block)).drop("n_block"))
    salt = F.pmod(F.xxhash64("first_id"), F.col("salts")).alias("salt")
    index = durable.cut(postings.join(blocks, shelf).select(*shelf, salt, "tokens", "first_id", "impact"))

    key, order = [*scope, "common"], [F.col("score").desc(), F.col("first_id")]
    heads = top_per_key(index, [*scope, "token"], [F.col("impact").desc(), F.col("first_id")], k, "_r")
    scored = (
        sets.withColumn("token", F.explode("common.token"))
        .join(heads.select(*scope, "token", "tokens", "first_id"), [*scope, "token"])
        .withColumn("score", _score(F.col("common"), F.col("tokens"), F.col("average")))
        .select(*key, "tokens", "first_id", "score")
        .distinct()
    )
    led = durable.cut(top_per_key(scored, key, order, k, "_r").drop("_r"))
    reached = led.groupBy(*key).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reached"))

    # Longest lists first: those that stay below the threshold together are not opened, and one never has to be.
    longest = F.array_sort("common", lambda a, b: F.when(a.held != b.held, F.when(a.held > b.held, -1).otherwise(1)).when(a.token < b.token, -1).otherwise(1))
    below = F.aggregate(
        "longest",
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda a, t: F.struct(
            (a.sum + t.idf * t.top).alias("sum"), F.when((a.sum + t.idf * t.top) * SLACK < F.col("reached"), a.n + 1).otherwise(a.n).alias("n")
        ),
    ).n
    several = sets.where(F.size("common") > 1).join(reached, key).withColumn("longest", longest)
    opened = several.withColumn("opened", F.slice("longest", F.greatest(below, F.lit(1)) + 1, F.size("longest"))).where(F.size("opened") > 0)
    bound = F.aggregate("common", F.lit(0.0), lambda total, t: total + t.idf) * _impact(F.col("repeats"), F.col("length"), F.col("average"))
    chosen = (
        opened.select(*key, "average", "opened", "reached", F.explode("opened.token").alias("token"))
        .join(blocks, [*scope, "token"])
        .where(F.col("reached").isNull() | (bound * SLACK >= F.col("reached")))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    )
    others = (
        chosen.join(index.drop("impact"), [*shelf, "salt"])
        .where(_at_first_match(F.col("opened")))
        .withColumn("score", _score(F.col("common"), F.col("tokens"), F.col("average")))
        .select(*key, "tokens", "first_id", "score")
    )
    return top_per_key(led.unionByName(others).distinct(), key, order, k, "_r")


def search(
    queries: DataFrame, entities: DataFrame, scope: list[str], k: int, rare: int = RARE_PROFILES, block: int = BLOCK_PROFILES
) -> DataFrame:
    """``scope, text, rank, id, score``: the ``k`` best entities of each distinct query text.

    ``queries`` has the ``scope`` columns and ``text``; ``entities`` the ``scope`` columns,
    ``id``, ``name`` and ``aliases``. Any shared token matches; ties go to the smaller id."""
    # The index: written once, read by every branch below.
    profiles = durable.cut(_profiles(entities, scope, k))
    totals = profiles.groupBy(*scope).agg(
        F.sum("n").alias("docs"), (F.sum(F.col("n") * F.size("tokens")) / F.sum("n")).alias("average")
    )
    postings = profiles.select(
        *scope, F.explode(F.array_distinct("tokens")).alias("token"), "tokens", "n", "first_id", F.size("tokens").alias("length")
    )
    weighed = postings.join(totals, scope).withColumn("impact", _impact(_times(F.col("token"), F.col("tokens")), F.col("length"), F.col("average")))
    frequency = weighed.groupBy(*scope, "token").agg(
        F.sum("n").alias("df"), F.count(F.lit(1)).alias("held"), F.max("impact").alias("top"), F.first("docs").alias("docs"), F.first("average").alias("average")
    )
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = durable.cut(frequency.select(*scope, "token", idf.alias("idf"), "held", "top", "average"))

    asked = durable.cut(
        queries.select(*scope, "text").distinct().withColumn("asked", F.array_sort(F.array_distinct(words(F.col("text")))))
    )
    distinct = asked.select(*scope, "asked").distinct()
    key = [*scope, "asked"]
    # A query's terms are its own words, so this list is as long as the query text at most.
    known = (
        distinct.select(*key, F.explode("asked").alias("token"))
        .join(terms, [*scope, "token"])
        .groupBy(*key)
        .agg(
            F.array_sort(F.collect_list(F.struct("token", "idf", "held", "top"))).alias("terms"),
            F.first("average").alias("average"),
        )
    )
    known = known.withColumns(
        {"scarce": F.filter("terms", lambda t: t.held <= rare), "common": F.filter("terms", lambda t: t.held > rare)}
    )
    pair = [*key, "first_id", "score"]
    by_rare = (
        known.select(*key, "terms", "scarce", "average", F.explode("scarce.token").alias("token"))
        .join(postings, [*scope, "token"])
        .where(_at_first_match(F.col("scarce")))
        .withColumn("score", _score(F.col("terms"), F.col("tokens"), F.col("average")))
        .select(*pair)
    )
    sets = known.select(*scope, "common", "average").where(F.size("common") > 0).distinct()
    frequent = weighed.join(terms.where(F.col("held") > rare).select(*scope, "token"), [*scope, "token"], "left_semi")
    best = _best_of_sets(durable.cut(sets), frequent, scope, k, block)
    # A profile that also has a rare token of the query was scored in full above.
    by_frequent = (
        known.select(*key, "common", "scarce")
        .join(best.select(*scope, "common", "tokens", "first_id", "score"), [*scope, "common"])
        .where(~F.arrays_overlap(F.col("scarce.token"), F.col("tokens")))
        .select(*pair)
    )
    # The k best profiles, by their smallest ids among equals, hold the k best entities.
    order = [F.col("score").desc(), F.col("first_id")]
    leading = top_per_key(by_rare.unionByName(by_frequent), key, order, k, "_r").select(*pair)
    named = leading.join(profiles.select(*scope, "first_id", "ids"), [*scope, "first_id"])
    found = named.select(*key, F.explode("ids").alias("id"), "score")
    ranked = top_per_key(found, key, [F.col("score").desc(), F.col("id")], k)
    return asked.join(ranked, key).select(*scope, "text", "rank", "id", "score")


def search_newest(queries: DataFrame, entities: DataFrame, scope: list[str], k: int) -> DataFrame:
    """Entities matching any token of the query, most recently updated first.

    The newest ``k`` of each token contain the newest ``k`` of every union of tokens, so
    each posting list is cut to ``k`` before it meets a query."""
    order = [F.col("updated_at").desc_nulls_first(), F.col("id")]
    postings = entities.select(*scope, "id", "updated_at", F.explode(F.array_distinct(entity_tokens())).alias("token"))
    newest = top_per_key(postings, [*scope, "token"], order, k, "_r").drop("_r")
    asked = queries.select(*scope, "text").distinct()
    hits = (
        asked.withColumn("token", F.explode(F.array_distinct(words(F.col("text")))))
        .join(newest, [*scope, "token"])
        .select(*scope, "text", "id", "updated_at")
        .distinct()
    )
    return top_per_key(hits, [*scope, "text"], order, k)
