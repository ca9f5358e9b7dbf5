"""Record shapes, and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------
# Vocabularies.
JOB_STATUSES = ("pending", "processing", "done", "skipped", "failed")
TERMINAL_JOB_STATUSES = ("done", "skipped", "failed")
CLAIM_TYPES = ("empirical", "predictive", "normative", "opinion")
CHECKABLE_CLAIM_TYPE = "empirical"
VERDICTS = ("supported", "disputed", "refuted", "unverifiable")
STANCES = ("supports", "contradicts", "context")
STANCE_LABELS = {"supports": "Supporting", "contradicts": "Contradicting", "context": "Context"}
TYPE_DECISIONS = ("existing", "new", "drop")
SOURCE_KINDS = ("rss", "files")
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".text")
TRACKING_PARAMS = ("fbclid", "gclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"

# Sweep sizes, caps and floors.
JOB_BATCH = 5
JOB_MAX_ATTEMPTS = 3
READ_LIMIT_MAX = 500
READ_LIMIT_DEFAULT = 50
GRAPH_VIEW_LIMIT = 200
CANDIDATE_LIMIT = 5
POLL_ITEM_LIMIT = 50
SUBMIT_BATCH = 25
SUBMIT_MAX_ATTEMPTS = 3
STATUS_BATCH = 200
CLUSTER_MAX_SOURCES = 12
DEFAULT_LOOKBACK_HOURS = 24
EXTRACT_BATCH = 10
EXTRACT_MAX_ATTEMPTS = 3
VERIFY_BATCH = 25
VERIFY_MAX_ATTEMPTS = 3
VERIFY_MAX_PER_DOCUMENT = 8
CHECKWORTHINESS_MIN = 0.4
REPORT_BATCH = 25
FULL_TEXT_MAX_CHARS = 60_000
CLAIM_CONTEXT_CHARS = 2_000
ABSTRACT_MAX_CHARS = 240
SLUG_MAX_CHARS = 60
SUBMIT_ERROR_MAX_CHARS = 500
ERROR_MAX_CHARS = 1000
BM25_K1 = 1.2
BM25_B = 0.75
# --- end of fixed values --------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, B, I, D, TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

TYPE_DEF = _struct(("name", S), ("description", S), ("pinned", B), ("banned", B))

# Answers of the model calls, read with from_json.
RELEVANCE = _struct(("relevant", B), ("reason", S))
EXTRACTION = _struct(
    (
        "entities",
        T.ArrayType(_struct(("name", S), ("type", S), ("description", S), ("aliases", T.ArrayType(S)))),
    ),
    ("relationships", T.ArrayType(_struct(("source_name", S), ("target_name", S), ("type", S)))),
)
RESOLUTIONS = _struct(("resolutions", T.ArrayType(_struct(("index", I), ("id", S)))))
TYPE_CONSOLIDATION = _struct(
    (
        "decisions",
        T.ArrayType(_struct(("candidate", S), ("decision", S), ("canonical", S), ("name", S), ("description", S))),
    )
)
ARTICLE = _struct(("abstract", S), ("article", S))
STORY = _struct(("headline", S), ("body", S))
CLAIM_EXTRACTION = _struct(
    (
        "claims",
        T.ArrayType(
            _struct(
                ("text", S),
                ("quote", S),
                ("attributed_to", S),
                ("attribution_type", S),
                ("cited_source", S),
                ("cited_source_url", S),
                ("claim_type", S),
                ("checkworthiness", D),
            )
        ),
    )
)
RESEARCH = _struct(
    (
        "evidence",
        T.ArrayType(_struct(("url", S), ("title", S), ("snippet", S), ("stance", S), ("published_at", S))),
    )
)
JUDGMENT = _struct(("verdict", S), ("confidence", D), ("rationale", S))
ANNOTATIONS = T.ArrayType(_struct(("type", S), ("url_citation", _struct(("url", S), ("title", S)))))

# Tables of the graph.
ENTITY = _struct(
    ("kb_id", S),
    ("id", S),
    ("type", S),
    ("name", S),
    ("name_normalized", S),
    ("summary", S),
    ("article", S),
    ("aliases", T.ArrayType(S)),
    ("created_at", TS),
    ("updated_at", TS),
)
RELATED = _struct(
    ("kb_id", S), ("source_id", S), ("target_id", S), ("type", S), ("source_job_id", S), ("created_at", TS)
)
SOURCE = _struct(("kb_id", S), ("job_id", S), ("label", S), ("published_at", TS), ("ingested_at", TS))
MENTION = _struct(("kb_id", S), ("entity_id", S), ("job_id", S))
JOB = _struct(
    ("job_id", S),
    ("kb_id", S),
    ("content", S),
    ("metadata", S),
    ("status", S),
    ("relevance_reason", S),
    ("error", S),
    ("attempts", I),
    ("created_at", TS),
    ("processed_at", TS),
)
CONFIG = _struct(
    ("kb_id", S),
    ("interests", S),
    ("discover_types", B),
    ("entity_types", T.ArrayType(TYPE_DEF)),
    ("relationship_types", T.ArrayType(TYPE_DEF)),
)
