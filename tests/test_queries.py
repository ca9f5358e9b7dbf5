"""The registered queries: entry points, and a choice of them against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

CHOICE = [
    "story_clusters_all_time", "entity_page", "nodes_search", "batch_identity", "type_resolution", "relationship_upsert", "feed_items",
    "item_insert", "job_replay", "claim_gate", "evidence_dedupe", "claim_report", "issue_markdown",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry_points(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    # The training-data queries are optional and have tests of their own.
    own = {name for name in queries if name != "pipeline" and not name.startswith("op")}
    assert own <= set(sql)
    assert entry.entry(spark).columns == ["kb_id", "cluster_id", "size", "newest", "source_id", "rank"]


@pytest.mark.parametrize("name", CHOICE)
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = rows(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == want and want


def test_stored_views_follow_their_files(spark, tmp_path):
    """A file added to the folder between two runs is seen by the second one."""
    from loomgraph.sources.tables import Tables

    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    for name in ("orders", "customer"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines.where("l_orderkey % 2 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    half = Tables(spark, str(tmp_path)).mentions().count()
    assert Tables(spark, str(tmp_path)).mentions().count() == half
    lines.where("l_orderkey % 2 = 1").write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    assert Tables(spark, str(tmp_path)).mentions().count() == Tables(spark, FOLDER).mentions().count() > half
