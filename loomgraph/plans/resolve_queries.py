"""Candidate search, resolution, identities and the type vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.functions.text import type_key
from loomgraph.operators import graph_read, prompts, resolution, vocabulary
from loomgraph.operators.search import search_newest
from loomgraph.plans.oracle_views import ENTITIES, LINES, ORDERS, TEXT_MENTIONS
from loomgraph.plans.registry import query
from loomgraph.sources.tables import CAPITALISED, Tables


def _big(name: str) -> F.Column:
    return F.col(name).cast("bigint").alias(name)


# --- search: entities = parts and suppliers per tenant, queries = names in the orders -------


def _named_entities(t: Tables) -> DataFrame:
    """Entities whose alias is their description."""
    return t.entities().withColumn("aliases", F.when(F.col("summary").isNotNull(), F.array(F.lower("summary"))).otherwise(F.array().cast("array<string>")))


def order_lines(t: Tables) -> DataFrame:
    """All lines of each order with their place in it, ``pos``; line numbers repeat within an order."""
    place = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return t._lines().withColumn("pos", F.row_number().over(place))


def _order_mentions(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """Every order line mentions its part by name, or by its description in capitals."""
    parts = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    lines = (order_lines(t) if lines is None else lines).join(parts, "l_partkey")
    name = F.when(F.col("l_returnflag") == "R", F.concat(F.upper("p_type"), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    return lines.select(
        "kb_id", F.col("o_orderkey").alias("job_id"), "pos", F.lit("Part").alias("type"), name.alias("name"),
        F.concat(F.lit("line "), "pos").alias("description"),
    )


_NAMED = f"""{ORDERS}, {ENTITIES},
order_lines AS (
  SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))::INTEGER AS pos FROM lineitem),
order_mentions AS (
  SELECT kb_id, o_orderkey AS job_id, pos, 'Part' AS type,
    CASE l_returnflag WHEN 'R' THEN concat(upper(p_type), ' ', p_name) ELSE p_name END AS name
  FROM order_lines JOIN orders_kb ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

_EXACT = """
names AS (SELECT DISTINCT kb_id, type, name FROM order_mentions),
exact AS (
  SELECT n.kb_id, n.type, n.name, e.id, row_number() OVER (PARTITION BY n.kb_id, n.type, n.name ORDER BY e.id) AS rank
  FROM names n JOIN entities e ON e.kb_id = n.kb_id AND e.type = n.type AND (lower(e.name) = lower(n.name) OR lower(e.summary) = lower(n.name))
  QUALIFY rank <= 5)"""


def _bm25(scope: str, queries: str, k: int) -> str:
    """BM25 over all entities of a scope, pair by pair. ``queries`` is a view with the scope columns and ``text``."""
    cols = scope.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)
    return f"""
bags AS (
  SELECT {scope}, id, list_filter(string_split_regex(lower(concat_ws(' ', name, summary)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS tokens FROM entities),
totals AS (SELECT {scope}, count(*) AS docs, avg(len(tokens)) AS average FROM bags GROUP BY {scope}),
posted AS (SELECT {scope}, id, len(tokens) AS dl, unnest(list_distinct(tokens)) AS token, tokens FROM bags),
weights AS (
  SELECT p.*, list_count(list_filter(tokens, lambda x: x = token)) AS tf, count(*) OVER (PARTITION BY {', '.join('p.' + c for c in cols)}, token) AS df, docs, average
  FROM posted p JOIN totals t ON {on('p', 't')}),
scored AS (
  SELECT {scope}, id, token, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)) AS w FROM weights),
asked AS (SELECT DISTINCT {scope}, text FROM {queries}),
asked_tokens AS (SELECT {scope}, text, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS token FROM asked),
found AS (
  SELECT {', '.join('a.' + c for c in cols)}, text, id, round(sum(w), 9) AS score
  FROM asked_tokens a JOIN scored s ON {on('a', 's')} AND a.token = s.token GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY {scope}, text ORDER BY score DESC, id) AS rank FROM found QUALIFY rank <= {k})"""


@query(f"WITH {_NAMED}, {_EXACT} SELECT kb_id, type, name, rank, id FROM exact")
def exact_candidates(t: Tables) -> DataFrame:
    found = resolution.exact_candidates(_order_mentions(t), _named_entities(t))
    return found.select("kb_id", "type", "name", _big("rank"), "id")


@query(
    f"""WITH {_NAMED},
searches AS (SELECT DISTINCT kb_id, name AS text FROM order_mentions), {_bm25("kb_id", "searches", 50)}
SELECT kb_id, text, id, rank FROM best"""
)
def nodes_search(t: Tables) -> DataFrame:
    """Every name an order uses, searched among the tenant's entities."""
    searches = _order_mentions(t).select("kb_id", F.col("name").alias("text"))
    return graph_read.nodes_search(_named_entities(t), searches).select("kb_id", "text", "id", _big("rank"))


@query(
    f"""WITH {_NAMED},
searches AS (SELECT DISTINCT kb_id, name AS text FROM order_mentions),
posted AS (
  SELECT kb_id, id, updated_at, unnest(list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', name, summary)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS token
  FROM entities),
asked_tokens AS (SELECT kb_id, text, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS token FROM searches),
hits AS (SELECT DISTINCT a.kb_id, text, id, updated_at FROM asked_tokens a JOIN posted p ON a.kb_id = p.kb_id AND a.token = p.token)
SELECT kb_id, text, id, row_number() OVER (PARTITION BY kb_id, text ORDER BY updated_at DESC NULLS FIRST, id) AS rank FROM hits QUALIFY rank <= 50"""
)
def nodes_search_newest(t: Tables) -> DataFrame:
    searches = _order_mentions(t).select("kb_id", F.col("name").alias("text"))
    return search_newest(searches, _named_entities(t), ["kb_id"], 50).select("kb_id", "text", "id", _big("rank"))


_CANDIDATES = f"""{_EXACT},
searches AS (SELECT DISTINCT kb_id, type, name AS text FROM order_mentions), {_bm25("kb_id, type", "searches", 5)},
pooled AS (
  SELECT kb_id, type, name, id, min(tier * 10 + rank) AS place
  FROM (SELECT kb_id, type, name, id, 0 AS tier, rank FROM exact UNION ALL SELECT kb_id, type, text, id, 1, rank FROM best) GROUP BY ALL),
candidates AS (SELECT *, row_number() OVER (PARTITION BY kb_id, type, name ORDER BY place) AS rank FROM pooled QUALIFY rank <= 5)"""


@query(f"WITH {_NAMED}, {_CANDIDATES} SELECT kb_id, type, name, rank, id FROM candidates")
def candidate_set(t: Tables) -> DataFrame:
    found = resolution.candidates(_order_mentions(t), _named_entities(t))
    return found.select("kb_id", "type", "name", _big("rank"), "id")


def _answers(t: Tables, lines: DataFrame) -> DataFrame:
    """Answers per mention: NEW, then the mention's own part, then the next part (often no candidate)."""
    own = t.part_id()
    following = F.concat("kb_id", F.lit("/P/"), F.col("l_partkey") + 1)
    given = F.array(F.lit("NEW"), own, following)
    return lines.select(
        F.col("o_orderkey").alias("job_id"), F.col("pos").alias("index"), F.posexplode(given).alias("answer_pos", "id")
    )


@query(
    f"""WITH {_NAMED}, {_CANDIDATES},
answers AS (
  SELECT kb_id, o_orderkey AS job_id, pos, concat(kb_id, '/P/', l_partkey + d) AS id, d
  FROM order_lines JOIN orders_kb ON l_orderkey = o_orderkey CROSS JOIN (VALUES (0), (1)) v(d)),
valid AS (
  SELECT m.job_id, m.pos, arg_max(a.id, d) AS existing_id
  FROM order_mentions m JOIN candidates c USING (kb_id, type, name) JOIN answers a ON a.job_id = m.job_id AND a.pos = m.pos AND a.id = c.id GROUP BY 1, 2)
SELECT m.kb_id, m.job_id, m.pos, m.name, coalesce(existing_id, 'NEW') AS existing_id
FROM order_mentions m LEFT JOIN valid v ON v.job_id = m.job_id AND v.pos = m.pos"""
)
def resolution_apply(t: Tables) -> DataFrame:
    # Written down: answers and mentions read the lines, and several branches the mentions.
    lines = durable.packed(order_lines(t).select("kb_id", "o_orderkey", "l_partkey", "l_returnflag", "pos"))
    mentions, entities = durable.packed(_order_mentions(t, lines)), _named_entities(t)
    offered = mentions.join(resolution.candidates(mentions, entities), resolution.NAME)
    resolved = resolution.resolve(mentions, offered, _answers(t, lines))
    return resolved.select("kb_id", "job_id", "pos", "name", F.coalesce("existing_id", F.lit("NEW")).alias("existing_id"))


@query(
    f"""WITH {_NAMED}, {_EXACT},
blocks AS (
  SELECT m.kb_id, job_id, pos, concat('[', pos, '] ', m.name, ' (Part) — line ', pos, chr(10),
    string_agg(concat('    - id=', x.id, ': ', e.name, ' — ', coalesce(e.summary, '')), chr(10) ORDER BY x.rank)) AS block
  FROM order_mentions m JOIN exact x USING (kb_id, type, name) JOIN entities e ON e.kb_id = m.kb_id AND e.id = x.id GROUP BY m.kb_id, job_id, pos, m.name)
SELECT kb_id, job_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS user FROM blocks GROUP BY 1, 2"""
)
def resolution_prompts(t: Tables) -> DataFrame:
    mentions, entities = _order_mentions(t), _named_entities(t)
    offered = resolution.mention_candidates(mentions, resolution.exact_candidates(mentions, entities), entities)
    return prompts.resolution(offered).select("kb_id", "job_id", "user")


# --- identities: jobs = documents, mentions = capitalised words -------------------------------


def _word_mentions(t: Tables) -> DataFrame:
    """Word mentions; every third place was resolved to an id of its word's length."""
    words = t.text_mentions().select(
        F.concat(F.lit("kb"), F.col("doc_id") % 4).alias("kb_id"), F.col("doc_id").alias("job_id"), "pos", "name", "type"
    )
    known = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("known/"), F.length("name"), F.lit("/"), F.col("pos") % 2))
    return words.withColumn("existing_id", known)


_IDENTITY = f"""{TEXT_MENTIONS},
identified AS (
  SELECT *, lower(name) AS name_normalized,
    CASE WHEN pos % 3 = 1 THEN concat('known/', length(name), '/', pos % 2) END AS existing_id,
    coalesce(last_value(CASE WHEN pos % 3 = 1 THEN concat('known/', length(name), '/', pos % 2) END IGNORE NULLS) OVER (
      PARTITION BY kb_id, job_id, lower(name), type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      sha256(concat_ws(chr(1), kb_id, type, lower(name), job_id::VARCHAR))) AS entity_id
  FROM text_mentions)"""


@query(f"WITH {_IDENTITY} SELECT kb_id, job_id, pos, name_normalized, type, entity_id FROM identified")
def batch_identity(t: Tables) -> DataFrame:
    found = resolution.batch_identity(_word_mentions(t))
    return found.select("kb_id", "job_id", "pos", "name_normalized", "type", "entity_id")


@query(
    f"""WITH {_IDENTITY},
firsts AS (SELECT kb_id, job_id, name_normalized, type, count(*) AS n, arg_min(existing_id IS NULL, pos) AS minted FROM identified GROUP BY 1, 2, 3, 4)
SELECT kb_id, job_id, count(*) FILTER (minted) AS entities_created, (sum(n) - count(*) FILTER (minted))::BIGINT AS entities_merged FROM firsts GROUP BY 1, 2"""
)
def merge_counters(t: Tables) -> DataFrame:
    return resolution.merge_counts(resolution.batch_identity(_word_mentions(t)))


def _word_relationships(t: Tables) -> DataFrame:
    """Each line relates every capitalised word to the next one, in whatever spelling."""
    words = t.lines().withColumn("w", F.regexp_extract_all("line", F.lit(CAPITALISED), 0)).where(F.size("w") > 1)
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))
    return words.select("doc_id", "pos", F.inline(pairs).alias("a", "b")).select(
        F.concat(F.lit("kb"), F.col("doc_id") % 4).alias("kb_id"), F.col("doc_id").alias("job_id"), "pos",
        F.concat(F.lit(" "), F.lower("a"), F.lit(" ")).alias("source_name"), F.col("b").alias("target_name"), F.lit("Near").alias("type"),
    )


@query(
    f"""WITH {_IDENTITY}, {LINES},
ids AS (SELECT kb_id, job_id, name_normalized, arg_max(entity_id, pos) AS entity_id FROM identified GROUP BY 1, 2, 3),
relationships AS (
  SELECT concat('kb', doc_id % 4) AS kb_id, doc_id AS job_id, pos, lower(w[i]) AS s, lower(w[i + 1]) AS d
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM (SELECT *, regexp_extract_all(line, '{CAPITALISED}') AS w FROM lines)))
SELECT r.kb_id, r.job_id, r.pos, a.entity_id AS source_id, b.entity_id AS target_id
FROM relationships r JOIN ids a ON a.kb_id = r.kb_id AND a.job_id = r.job_id AND a.name_normalized = s
JOIN ids b ON b.kb_id = r.kb_id AND b.job_id = r.job_id AND b.name_normalized = d"""
)
def relationship_endpoints(t: Tables) -> DataFrame:
    ids = resolution.name_ids(resolution.batch_identity(_word_mentions(t)))
    found = resolution.relationship_endpoints(_word_relationships(t), ids)
    return found.select("kb_id", "job_id", "pos", "source_id", "target_id")


# --- vocabulary: types are words of the document's lines ------------------------------------------

# A type is known when it is seen this often, and by a rule that leaves about a third of all types novel.
LEAST_SEEN = 1


def _typed_mentions(t: Tables) -> DataFrame:
    """Each line is the name of a thing whose type is its first word, in one of two spellings."""
    word = F.regexp_extract("line", r"(\p{L}+)", 1)
    spelled = F.when(F.col("pos") % 2 == 0, F.upper(word)).otherwise(word)
    return t.lines().select(
        F.concat(F.lit("kb"), F.col("doc_id") % 4).alias("kb_id"), F.col("doc_id").alias("job_id"), "pos",
        F.col("line").alias("name"), spelled.alias("type"),
    ).where("type <> ''")


def _word_types(t: Tables, mentions: DataFrame | None = None) -> DataFrame:
    """Vocabulary per tenant: first words of lines, by a rule on their letters; short words are banned."""
    words = (mentions or _typed_mentions(t)).groupBy("kb_id", type_key(F.col("type")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    known = (F.col("n") >= LEAST_SEEN) & (F.length(F.replace("key", F.lit("E"), F.lit(""))) % 3 != 1)
    return words.where(known).select(
        "kb_id", F.lit(0).alias("ord"), F.initcap("key").alias("name"), F.lit("").alias("description"), F.lit(False).alias("pinned"),
        (F.length("key") <= 3).alias("banned"), "key",
    )


def _word_decisions(t: Tables, mentions: DataFrame, types: DataFrame) -> DataFrame:
    """Scripted answers: by the length of the word, drop it, call it an existing type, or make it new
    under its first four letters."""
    novel = vocabulary.unmatched(mentions, types)
    size = F.length("key")
    decision = F.when(size % 3 == 0, "drop").when(size % 3 == 1, "new").otherwise("existing")
    return novel.select(
        "job_id", "key", decision.alias("decision"), F.substring("key", 1, 4).alias("canonical"),
        F.initcap(F.substring("key", 1, 4)).alias("name"), F.concat(F.lit("like "), "key").alias("description"),
    ).distinct()


_TYPED = f"""{LINES},
typed AS (
  SELECT concat('kb', doc_id % 4) AS kb_id, doc_id AS job_id, pos, CASE WHEN pos % 2 = 0 THEN u ELSE w END AS type, u AS key, line AS name
  FROM (SELECT *, replace(replace(upper(w), 'ß', 'SS'), 'ẞ', 'SS') AS u FROM (SELECT *, regexp_extract(line, '(\\p{{L}}+)', 1) AS w FROM lines)) WHERE w <> ''),
types AS (SELECT kb_id, key, concat(upper(key[1]), lower(key[2:])) AS name, length(key) <= 3 AS banned FROM typed
  GROUP BY kb_id, key HAVING count(*) >= {LEAST_SEEN} AND length(replace(key, 'E', '')) % 3 <> 1),
novel AS (SELECT DISTINCT kb_id, job_id, key FROM typed WHERE (kb_id, key) NOT IN (SELECT kb_id, key FROM types)),
decided AS (
  SELECT *, CASE length(key) % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'new' ELSE 'existing' END AS decision, upper(substring(key, 1, 4)) AS goal,
    concat(upper(key[1]), lower(key[2:4])) AS goal_name FROM novel)"""


@query(f"WITH {_TYPED} SELECT DISTINCT t.kb_id, t.job_id, t.type, t.key FROM typed t JOIN novel n ON n.kb_id = t.kb_id AND n.job_id = t.job_id AND n.key = t.key")
def unmatched_types(t: Tables) -> DataFrame:
    return vocabulary.unmatched(_typed_mentions(t), _word_types(t)).select("kb_id", "job_id", "type", "key")


@query(f"WITH {_TYPED} SELECT kb_id, job_id, type, arg_min(name, pos) AS example FROM typed GROUP BY 1, 2, 3")
def type_examples(t: Tables) -> DataFrame:
    return vocabulary.type_examples(_typed_mentions(t), F.col("name"))


def _scripted(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    mentions = _typed_mentions(t)
    # Written down without the texts: vocabulary, answers and minted types read it several times each.
    seen = durable.cut(mentions.drop("name"))
    types = _word_types(t, seen)
    decided = _word_decisions(t, seen, types)
    return mentions, types, decided, vocabulary.minted_types(seen, types, decided)


# With four-letter goals a word of four letters mints itself, and a minted word is known from then on.
_MINTED = f"""{_TYPED},
firsts AS (SELECT kb_id, job_id, key, min(pos) AS pos FROM typed GROUP BY 1, 2, 3),
offers AS (
  SELECT f.kb_id, f.job_id, f.key, f.pos, goal, goal_name FROM firsts f JOIN decided d ON d.kb_id = f.kb_id AND d.job_id = f.job_id AND d.key = f.key
  WHERE decision = 'new' AND (f.kb_id, goal) NOT IN (SELECT kb_id, key FROM types)),
minted AS (SELECT kb_id, job_id, goal AS key, min(pos) AS mint_pos, arg_min(goal_name, pos) AS name FROM offers GROUP BY 1, 2, 3)"""


@query(f"WITH {_MINTED} SELECT kb_id, job_id, key, mint_pos, name FROM minted")
def minted_types(t: Tables) -> DataFrame:
    return _scripted(t)[3].select("kb_id", "job_id", "key", "mint_pos", "name")


_RESOLVED = f"""{_MINTED},
resolved AS (
  SELECT t.kb_id, t.job_id, t.pos, t.name,
    CASE WHEN k.key IS NOT NULL AND NOT k.banned THEN k.name
      WHEN own.mint_pos < t.pos THEN own.name
      WHEN k.banned THEN NULL
      WHEN decision = 'existing' AND g.key IS NOT NULL AND NOT g.banned THEN g.name
      WHEN decision = 'existing' AND m.mint_pos < t.pos THEN m.name
      WHEN decision = 'new' AND g.key IS NOT NULL AND NOT g.banned THEN g.name
      WHEN decision = 'new' AND g.key IS NULL THEN m.name END AS type
  FROM typed t LEFT JOIN types k ON k.kb_id = t.kb_id AND k.key = t.key
  LEFT JOIN decided d ON d.kb_id = t.kb_id AND d.job_id = t.job_id AND d.key = t.key
  LEFT JOIN types g ON g.kb_id = t.kb_id AND g.key = d.goal
  LEFT JOIN minted m ON m.kb_id = t.kb_id AND m.job_id = t.job_id AND m.key = d.goal
  LEFT JOIN minted own ON own.kb_id = t.kb_id AND own.job_id = t.job_id AND own.key = t.key)"""


@query(f"WITH {_RESOLVED} SELECT * FROM resolved WHERE type IS NOT NULL")
def type_resolution(t: Tables) -> DataFrame:
    return vocabulary.resolve_types(*_scripted(t)).select("kb_id", "job_id", "pos", "name", "type")


def _echoes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Candidates are a document's novel types; their echoes carry the example, some are cut short."""
    mentions = _typed_mentions(t)
    candidates = vocabulary.unmatched(mentions, _word_types(t))
    example = F.when(F.length("type") % 4 == 0, F.expr("substring(type, 1, length(type) - 1)")).otherwise(
        F.concat("type", F.lit(' (e.g. "'), "type", F.lit('")'))
    )
    echoes = candidates.select("job_id", example.alias("candidate"), F.lit(0).alias("answer_pos")).distinct()
    return candidates, echoes


@query(
    f"""WITH {_TYPED},
shown AS (SELECT DISTINCT t.job_id, t.type, t.key FROM typed t JOIN novel n ON n.kb_id = t.kb_id AND n.job_id = t.job_id AND n.key = t.key),
echoes AS (
  SELECT DISTINCT job_id, CASE WHEN length(type) % 4 = 0 THEN substring(type, 1, length(type) - 1) ELSE concat(type, ' (e.g. "', type, '")') END AS candidate FROM shown),
keyed AS (SELECT *, regexp_replace(replace(replace(upper(candidate), 'ß', 'SS'), 'ẞ', 'SS'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS echo FROM echoes),
keys AS (SELECT DISTINCT job_id, key FROM shown)
SELECT e.job_id, candidate, coalesce(arg_max(key, length(key)), echo) AS key
FROM keyed e LEFT JOIN keys k ON k.job_id = e.job_id AND starts_with(echo, key) GROUP BY e.job_id, candidate, echo"""
)
def type_echo_match(t: Tables) -> DataFrame:
    return vocabulary.match_echoes(*_echoes(t)).select("job_id", "candidate", "key")


@query(
    f"""WITH {_MINTED},
last AS (SELECT kb_id, 0 AS last FROM types GROUP BY 1),
added AS (SELECT kb_id, key, min(job_id * 1000 + mint_pos) AS add_pos, arg_min(name, job_id * 1000 + mint_pos) AS name FROM minted GROUP BY 1, 2)
SELECT kb_id, 0::BIGINT AS ord, name, banned FROM types
UNION ALL SELECT a.kb_id, coalesce(last, -1) + 1 + add_pos, name, false FROM added a LEFT JOIN last l ON l.kb_id = a.kb_id"""
)
def vocab_append(t: Tables) -> DataFrame:
    _, types, _, minted = _scripted(t)
    additions = minted.select("kb_id", (F.col("job_id") * 1000 + F.col("mint_pos")).alias("add_pos"), "name", "description")
    return vocabulary.append_types(types, additions).select("kb_id", _big("ord"), "name", "banned")


def _submitted_types(t: Tables) -> DataFrame:
    """Per document, its lines as submitted type definitions, some blank, some flagged."""
    return t.documents().select(
        "doc_id",
        F.transform(
            F.split("text", "\n"),
            lambda x: F.struct(
                F.concat(F.lit("  "), F.substring_index(x, " ", 1), F.lit("\x07 ")).alias("name"),
                F.concat(F.lit(" "), F.substr(x, F.length(F.substring_index(x, " ", 1)) + 2)).alias("description"),
                (F.length(x) % 2 == 0).alias("pinned"),
                (F.length(x) % 5 == 0).alias("banned"),
            ),
        ).alias("types"),
    )


@query(
    """WITH x AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
cleaned AS (SELECT doc_id, i, split_part(x, ' ', 1) AS name, trim(substring(x, length(split_part(x, ' ', 1)) + 2)) AS description, length(x) % 5 = 0 AS banned FROM x)
SELECT doc_id, coalesce(string_agg(name, '|' ORDER BY i) FILTER (NOT banned), '') AS active, coalesce(string_agg(name, '|' ORDER BY i) FILTER (banned), '') AS banned,
  coalesce(string_agg(CASE WHEN description = '' THEN concat('- ', name) ELSE concat('- ', name, ': ', description) END, chr(10) ORDER BY i), '') AS shown
FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT * FROM cleaned WHERE name <> '') c USING (doc_id) GROUP BY doc_id"""
)
def type_filters(t: Tables) -> DataFrame:
    cleaned = _submitted_types(t).withColumn("types", vocabulary.clean_types(F.col("types")))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "|")
    return cleaned.select(
        "doc_id",
        names(vocabulary.active_types(F.col("types"))).alias("active"),
        names(vocabulary.banned_types(F.col("types"))).alias("banned"),
        prompts.type_lines(F.col("types")).alias("shown"),
    )


@query(
    """SELECT doc_id, concat(array_to_string(string_split(text, chr(10)), '|'), '#', len(string_split(text, chr(10)))) AS round_trip FROM documents"""
)
def type_list_upgrade(t: Tables) -> DataFrame:
    upgraded = t.documents().select("doc_id", vocabulary.to_type_defs(F.split("text", "\n")).alias("types"))
    names = F.array_join(vocabulary.to_type_names(F.col("types")), "|")
    return upgraded.select("doc_id", F.concat(names, F.lit("#"), F.size("types").cast("string")).alias("round_trip"))


@query(
    """SELECT user_id AS kb_id, arg_max(concat(event_type, '/', value), (ts, event_id)) AS interests FROM events GROUP BY 1"""
)
def current_config(t: Tables) -> DataFrame:
    """Each event is a change of its user's configuration; the last one holds."""
    changes = t.raw("events").select(
        F.col("user_id").alias("kb_id"), F.col("ts").alias("changed_at"), F.col("event_id").alias("change_id"),
        F.concat("event_type", F.lit("/"), "value").alias("interests"),
    )
    return vocabulary.current_config(changes)


@query(
    """SELECT doc_id AS job_id, concat('kb', doc_id % 4) AS kb_id, CASE WHEN doc_id % 4 < 2 THEN concat('about ', doc_id % 4) ELSE '' END AS interests,
  doc_id % 4 = 1 AS discover, CASE WHEN doc_id % 4 < 2 THEN 2 ELSE 0 END::BIGINT AS n_types
FROM documents"""
)
def job_config(t: Tables) -> DataFrame:
    """Two of four tenants have a configuration; the others get the defaults."""
    tenant = F.col("kb_id")
    configs = t.jobs().select("kb_id").distinct().where(F.substring(tenant, 3, 1) < "2").select(
        "kb_id",
        F.concat(F.lit("about "), F.substring(tenant, 3, 1)).alias("interests"),
        (F.substring(tenant, 3, 1) == "1").alias("discover_types"),
        vocabulary.to_type_defs(F.array(F.lit("Person"), F.lit("Place"))).alias("entity_types"),
        vocabulary.to_type_defs(F.array(F.lit("Knows"))).alias("relationship_types"),
    )
    return vocabulary.with_config(t.jobs(), configs).select(
        "job_id", "kb_id", "interests", F.col("discover_types").alias("discover"), F.size("entity_types").cast("bigint").alias("n_types")
    )


@query(
    f"""SELECT doc_id AS job_id, concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Reader''s interest: topic ', doc_id, chr(10), chr(10)) END, '{prompts.EXTRACT_GUIDE.replace("'", "''")}', chr(10),
  CASE WHEN doc_id % 2 = 0 THEN '{prompts.DISCOVER_RULE}' ELSE '{prompts.GUIDED_RULE}' END, chr(10), chr(10), 'Entity types:', chr(10), '- Person: of ', lang, chr(10), '- Place', chr(10), 'Relationship types:', chr(10), '- Knows') AS system,
  md5(text) AS user FROM documents"""
)
def extraction_prompts(t: Tables) -> DataFrame:
    """Per document, with and without interests, discovering or not."""
    doc = F.col("doc_id")
    kinds = F.array(
        F.struct(F.lit("Person").alias("name"), F.concat(F.lit("of "), "lang").alias("description")),
        F.struct(F.lit("Place").alias("name"), F.lit(" ").alias("description")),
    )
    relations = F.array(F.struct(F.lit("Knows").alias("name"), F.lit(None).cast("string").alias("description")))
    interests = F.when(doc % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("topic "), doc))
    built = prompts.extraction(kinds, relations, F.col("text"), interests, doc % 2 == 0)
    return t.documents().select(doc.alias("job_id"), built["system"].alias("system"), F.md5(built["user"]).alias("user"))


@query(
    f"""WITH {_TYPED},
shown AS (
  SELECT t.kb_id, t.job_id, t.type, arg_min(t.name, t.pos) AS example FROM typed t JOIN novel n ON n.kb_id = t.kb_id AND n.job_id = t.job_id AND n.key = t.key GROUP BY 1, 2, 3)
SELECT kb_id, job_id, concat('Types to place:', chr(10), string_agg(concat('- ', type, ' (e.g. "', example, '")'), chr(10) ORDER BY type)) AS user FROM shown GROUP BY 1, 2"""
)
def consolidation_prompts(t: Tables) -> DataFrame:
    """Per document, its novel types with their examples."""
    mentions = _typed_mentions(t)
    novel = vocabulary.unmatched(mentions, _word_types(t))
    listed = novel.join(vocabulary.type_examples(mentions, F.col("name")), ["kb_id", "job_id", "type"])
    known = vocabulary.to_type_defs(F.array(F.lit("Person")))
    batch = t.jobs().select("kb_id", "job_id", F.lit("words").alias("interests"), known.alias("entity_types"))
    return prompts.consolidation("entity", listed, batch, "entity_types").select("kb_id", "job_id", "user")
