"""Results kept by the hash of their query, one partition of a Parquet table for each, as JSON only where an API reads them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query_hash(*parameters: object) -> str:
    """Equal for equal parameters, whatever the order of keys in mappings."""
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def parse_filters(text: str) -> dict:
    """Filters that a user wrote, as JSON; anything else is an error and is never evaluated."""
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("filters must be a mapping")
    return value


def split_terms(text: str, keep_first: bool = False) -> list[str]:
    """Comma-separated search terms: trimmed, lower-cased, dashes as blanks, each once, sorted (the first kept in front if asked).

    No term, or a character that no term has, is an error."""
    terms = list(dict.fromkeys(" ".join(t.strip().lower().replace("-", " ").strip("\"'").split()) for t in text.split(",") if t.strip()))
    bad = [t for t in terms if not all(c.isalnum() or c in " *_'" for c in t)]
    if not terms or bad:
        raise ValueError(f"not a search term: {bad or text!r}")
    return [terms[0], *sorted(terms[1:])] if keep_first else sorted(terms)


class ResultCache:
    """A folder of results; ``get`` computes and stores what isn't there yet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def get(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        place = f"{self.folder}/query_hash={key}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            compute().withColumn("computed", F.lit(date.today().isoformat())).write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place).drop("computed")

    def as_json(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        df = self.get(key, compute)
        return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
