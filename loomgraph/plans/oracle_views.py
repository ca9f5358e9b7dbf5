"""SQL views over the raw tables for the checking queries, as WITH items."""

ORDERS = """
orders_kb AS (
  SELECT c_mktsegment AS kb_id, o_orderkey, o_orderdate, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

STORY_SOURCES = f"""{ORDERS},
sources AS (
  SELECT kb_id, o_orderkey AS job_id, o_orderpriority AS label, o_orderdate AS published_at, o_orderdate AS ingested_at
  FROM orders_kb)"""

SOURCES = f"""{ORDERS},
sources AS (
  SELECT kb_id, o_orderkey AS job_id, o_orderpriority AS label,
    CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS published_at,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS ingested_at
  FROM orders_kb)"""

MENTIONS = """
mentions AS (
  SELECT DISTINCT kb_id, concat(kb_id, '/P/', l_partkey) AS entity_id, o_orderkey AS job_id
  FROM lineitem JOIN orders_kb ON l_orderkey = o_orderkey)"""

ENTITIES = """
entities AS (
  SELECT kb_id, concat(kb_id, '/P/', p_partkey) AS id, 'Part' AS type, p_name AS name, p_type AS summary,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS article,
    min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
  FROM lineitem JOIN orders_kb ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY kb_id, p_partkey, p_name, p_type, p_brand, p_size
  UNION ALL
  SELECT kb_id, concat(kb_id, '/S/', s_suppkey), 'Supplier', s_name, NULL, NULL, min(o_orderdate), max(o_orderdate)
  FROM lineitem JOIN orders_kb ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY kb_id, s_suppkey, s_name)"""

RELATED = """
related AS (
  SELECT kb_id, concat(kb_id, '/S/', l_suppkey) AS source_id, concat(kb_id, '/P/', l_partkey) AS target_id,
    CASE l_returnflag WHEN 'R' THEN 'Took back' ELSE 'Supplies' END AS type, min(o_orderkey) AS source_job_id
  FROM lineitem JOIN orders_kb ON l_orderkey = o_orderkey
  GROUP BY kb_id, l_suppkey, l_partkey, CASE l_returnflag WHEN 'R' THEN 'Took back' ELSE 'Supplies' END)"""

JOBS = """
jobs AS (
  SELECT doc_id AS job_id, concat('kb', doc_id % 4) AS kb_id, text AS content,
    CASE WHEN doc_id % 7 = 0 THEN '{}' ELSE concat('{"source":"', source, '"}') END AS metadata,
    doc_id * 60 AS created_s, l.quality = 1 AS relevant
  FROM documents LEFT JOIN labels l USING (doc_id))"""

LINES = """
lines AS (
  SELECT doc_id, (i - 1)::INTEGER AS pos, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents) WHERE length(line) > 0)"""

CLAIMS = f"""{LINES},
claims AS (
  SELECT doc_id AS document_id, pos, line AS text,
    ['empirical', 'predictive', 'normative', 'opinion'][(pos % 4 + 1)::INTEGER] AS claim_type,
    (length(line) % 101) / 100.0 AS checkworthiness
  FROM lines)"""

TEXT_MENTIONS = """
words AS (
  SELECT doc_id, (i - 1)::INTEGER AS pos, name FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '\\p{Lu}\\p{Ll}+')) AS name,
      generate_subscripts(regexp_extract_all(text, '\\p{Lu}\\p{Ll}+'), 1) AS i
    FROM documents)),
text_mentions AS (
  SELECT doc_id AS job_id, concat('kb', doc_id % 4) AS kb_id, pos, name,
    ['Person', 'PERSON', 'per-son'][(length(name) % 3 + 1)::INTEGER] AS type
  FROM words)"""


def label_rounds(members: str, n: int) -> str:
    """Smallest source reachable through shared entities, spread in ``n`` rounds. ``members`` is a view of
    (kb_id, node, entity); the last view is ``labels_<n>`` (kb_id, node, label)."""
    steps = [f"labels_0 AS (SELECT DISTINCT kb_id, node, node AS label FROM {members})"]
    for i in range(n):
        steps.append(
            f"by_entity_{i} AS MATERIALIZED (SELECT m.kb_id, m.entity, min(l.label) AS label FROM {members} m "
            f"JOIN labels_{i} l ON m.kb_id = l.kb_id AND m.node = l.node GROUP BY 1, 2)"
        )
        steps.append(
            f"labels_{i + 1} AS MATERIALIZED (SELECT m.kb_id, m.node, min(e.label) AS label FROM {members} m "
            f"JOIN by_entity_{i} e ON m.kb_id = e.kb_id AND m.entity = e.entity GROUP BY 1, 2)"
        )
    return ",\n".join(steps)
