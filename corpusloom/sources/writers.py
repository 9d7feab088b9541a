"""Sinks: postings laid out by token, upserts, results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import latest


def write_postings(postings: DataFrame, path: str, files: int = 16) -> None:
    """Parquet in directories by unit and n-gram length, sorted by token within files, so that a term's scan skips almost all.

    Rows are ranged by token and unit id, not hashed by token: a term with a third of all rows is spread over many files.
    """
    ranged = postings.repartitionByRange(files, "unit", "ngram", "token", "unit_id").sortWithinPartitions("token", "unit_id")
    ranged.write.mode("overwrite").option("compression", "zstd").partitionBy("unit", "ngram").parquet(path)


def bucket_postings(postings: DataFrame, name: str, buckets: int = 64) -> None:
    """A catalog table bucketed by unit id, for joins with docs that need no shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "unit_id").sortBy("unit_id").saveAsTable(name)


def upsert(old: DataFrame | None, new: DataFrame, key: str, version: list[str], path: str) -> None:
    """Old and new rows, the highest version of each key, written beside the old data (never over what is being read)."""
    both = new if old is None else old.unionByName(new)
    latest(both, key, version).write.mode("overwrite").parquet(path)


def write_partitions(results: DataFrame, path: str, partition: str = "query_hash") -> None:
    """Replaces those partitions that the results hold and leaves the others."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def with_search_columns(vocabulary: DataFrame) -> DataFrame:
    """Vocabulary with the reversed token, so that suffixes are prefixes too."""
    return vocabulary.withColumn("token_reversed", F.reverse("token"))
