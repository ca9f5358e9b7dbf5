"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from loomgraph.llm import divergence as D
from loomgraph.llm import hard_negatives as H
from loomgraph.llm import vector_codes as V

WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest, count(*) OVER (PARTITION BY hex) AS n,
         row_number() OVER (PARTITION BY hex, page_id ORDER BY page_id) AS nth
  FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN largest IS NULL OR (page_id = largest AND nth = 1) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest IS NULL OR (page_id = largest AND nth = 1) THEN NULL ELSE largest END AS refers_to
FROM grouped
"""


def _whole_vectors(scale: int) -> str:
    """Integer vectors of the rows that count, of the most frequent length."""
    return f"""
finite AS (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), usual AS (
  SELECT len(v) AS d FROM finite GROUP BY d ORDER BY count(*) DESC, d DESC LIMIT 1
), whole AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(v, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x
  FROM finite WHERE len(v) = (SELECT d FROM usual)
)"""


def vector_codes_sql() -> str:
    steps = []
    for k in range(V.ROUNDS + 1):
        steps.append(f"""placed{k} AS MATERIALIZED (
  SELECT r, position, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) * {V.ENTRIES} + entry) AS best
  FROM parts p JOIN book{k} b USING (position) GROUP BY r, position
)""")
        if k < V.ROUNDS:
            steps.append(f"""mean{k} AS (
  SELECT position, entry, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS x FROM (
    SELECT position, best % {V.ENTRIES} AS entry, i, sum(x[i]) AS s, count(*) AS n
    FROM placed{k} JOIN parts USING (r, position), range(1, (SELECT d // {V.PARTS} FROM usual) + 1) AS o(i) GROUP BY ALL)
  GROUP BY position, entry
), book{k + 1} AS MATERIALIZED (
  SELECT position, entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (position, entry)
)""")
    last = V.ROUNDS
    return f"""
WITH {_whole_vectors(V.SCALE)}, parts AS MATERIALIZED (
  SELECT r, p AS position, x[p * d // {V.PARTS} + 1 : (p + 1) * d // {V.PARTS}] AS x FROM whole, usual, range(0, {V.PARTS}) AS o(p)
), first AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, x
  FROM (SELECT vec_id, min(x) AS x FROM whole WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {V.ENTRIES})
), book0 AS (
  SELECT p AS position, entry, x[p * d // {V.PARTS} + 1 : (p + 1) * d // {V.PARTS}] AS x FROM first, usual, range(0, {V.PARTS}) AS o(p)
), {", ".join(steps)}, coded AS (
  SELECT r, string_agg(printf('%02x', best % {V.ENTRIES}), '' ORDER BY position) AS code, CAST(sum(best // {V.ENTRIES}) AS BIGINT) AS error
  FROM placed{last} GROUP BY r
), print AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY position, entry, i)) AS codebooks_sha256
  FROM (SELECT position, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM book{last})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM whole JOIN coded USING (r), print
"""


def hard_negatives_sql(every: int = 100) -> str:
    return f"""
WITH {_whole_vectors(H.SCALE)}, rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM whole WHERE vec_id IS NOT NULL AND label IS NOT NULL
), anchors AS (
  SELECT row_number() OVER () AS a, vec_id AS anchor_id, label, x FROM rows WHERE vec_id % {every} = 0
), scored AS MATERIALIZED (
  SELECT a, anchor_id, b.vec_id, b.label = q.label AS alike, CAST(list_dot_product(q.x, b.x) AS BIGINT) AS score FROM anchors q, rows b
), alike AS (
  SELECT a, anchor_id, vec_id AS positive_id, max(score) AS positive_score,
         row_number() OVER (PARTITION BY a ORDER BY max(score) DESC, vec_id) AS nth
  FROM scored WHERE alike AND vec_id <> anchor_id GROUP BY a, anchor_id, vec_id
), fitting AS (
  SELECT p.a, p.anchor_id, positive_id, positive_score, vec_id AS negative_id, max(score) AS negative_score
  FROM alike p JOIN scored s USING (a)
  WHERE nth <= {H.POSITIVES} AND NOT s.alike AND {H.LOW} * positive_score <= 100 * score AND 100 * score <= {H.HIGH} * positive_score
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, positive_id ORDER BY negative_score DESC, negative_id) AS nth FROM fitting
)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE nth <= {H.NEGATIVES}
"""


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _half(p: str, q: str) -> str:
    """Half of what one outcome adds to the Jensen-Shannon divergence."""
    return f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END) + (CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)) / 2"


def divergence_sql() -> str:
    space = r"[ \t\n\x0B\f\r]"
    counts = ",\n    ".join(
        f"length(t) - length(regexp_replace(t, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c{i}" for i, pattern in enumerate(D.CLASSES.values())
    )
    names = [f"c{i}" for i in range(len(D.CLASSES))]
    size = " + ".join(names)
    sums = ", ".join(f"sum({c}) AS {c}" for c in names)
    shares = ", ".join(f"{c} / greatest({size}, 1) AS q{c}" for c in names)
    by_class = " + ".join(_half(f"({c} / greatest({size}, 1))", f"q{c}") for c in names)
    return f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT r, doc_id, lang, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines,
    list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda w: w <> '') AS letters,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    {counts}
  FROM rows
), starts AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) > 2
), triples AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS times FROM starts
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM triples, (VALUES (0), (1), (2)) AS o(k) WHERE times > 1 GROUP BY r
), counted AS (
  SELECT s.*, len(words) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, len(letters) AS n_letters,
    len(words) < {D.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {D.MAX_REPEATED_PERCENT} * len(words) AS base_failed
  FROM split s LEFT JOIN repeated USING (r)
), common AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(letters) AS w FROM split) WHERE w IN ({_quoted(D.COMMON_WORDS)}) GROUP BY r, w
), sound AS (
  SELECT * FROM counted WHERE NOT base_failed
), keyed AS (
  SELECT r, lang AS ref, n_letters, {", ".join(names)} FROM sound WHERE lang IS NOT NULL AND lang <> ''
), totals AS (
  SELECT ref, sum(n_letters) AS letters, {sums} FROM keyed GROUP BY ref
), refs AS (
  SELECT ref, letters, {shares} FROM totals
), ref_words AS (
  SELECT ref, w, sum(n) / any_value(letters) AS q FROM keyed JOIN common USING (r) JOIN (SELECT ref, letters FROM refs) USING (ref) GROUP BY ref, w
), ref_common AS (
  SELECT ref, sum(q) AS q_common FROM ref_words GROUP BY ref
), placed AS (
  SELECT c.*, CASE WHEN c.lang IN (SELECT ref FROM refs) THEN c.lang END AS ref FROM counted c
), by_word AS (
  SELECT r, sum(p) AS p_seen, sum(q) AS q_seen, sum({_half("p", "q")}) AS seen
  FROM (SELECT r, n / n_letters AS p, coalesce(q, 0) AS q FROM placed JOIN common USING (r) LEFT JOIN ref_words USING (ref, w))
  GROUP BY r
), measured AS (
  SELECT d.*, CASE WHEN {size} > 0 AND ref IS NOT NULL THEN {by_class} ELSE 0 END AS class_divergence,
    CASE WHEN n_letters > 0 AND ref IS NOT NULL THEN coalesce(seen, 0) + (coalesce(q_common, 0) - coalesce(q_seen, 0)) / 2
      + {_half("(1 - coalesce(p_seen, 0))", "(1 - coalesce(q_common, 0))")} ELSE 0 END AS word_divergence
  FROM placed d LEFT JOIN refs USING (ref) LEFT JOIN ref_common USING (ref) LEFT JOIN by_word USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(t) - c{list(D.CLASSES).index("space")} AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed
    AND NOT coalesce(length(t) >= {D.MIN_CHARS} AND sqrt(greatest(class_divergence, 0)) > {D.MAX_CLASS_DISTANCE}, FALSE)
    AND NOT coalesce(n_letters >= {D.MIN_LETTER_WORDS} AND sqrt(greatest(word_divergence, 0)) > {D.MAX_WORD_DISTANCE}, FALSE) AS kept
FROM measured
"""
