"""Markdown files: one folder per document, lines in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.operators.pages_text import LINE_ORDER


def write_markdown(lines: DataFrame, names: DataFrame, key: str, path: str) -> None:
    """Write each document's lines below ``path/slug=<slug>/``; writing a document again replaces its folder.

    ``names`` maps ``key`` to ``slug``. Range partitioning on the document and the line order
    keeps lines in order over the files of a folder, and spreads a very long document
    over several files instead of one task."""
    order = [key, *LINE_ORDER]
    named = lines.join(names.select(key, "slug"), key)
    (
        named.repartitionByRange(*(F.col(c) for c in order))
        .sortWithinPartitions("slug", *order)
        .select("slug", F.col("line").alias("value"))
        .write.partitionBy("slug")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .text(path)
    )


def publish_documents(lines: DataFrame, names: DataFrame, key: str, path: str, table: DataFrame, table_path: str) -> str:
    """Markdown first, then the durable table; callers stamp the document only after both."""
    write_markdown(lines, names, key, path)
    return durable.publish(table, table_path)
