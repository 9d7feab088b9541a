"""Sources: archives of scanned text, tables, word lists and gazetteers."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import expand_contractions, tokens


def read_text_files(spark: SparkSession, folder: str, glob: str = "*.ocr", encoding: str = "cp1252") -> DataFrame:
    """(path, tid, text) of every file under a folder, decoded; bytes that the encoding lacks are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "tid": b["path"].str.extract(r"([^/]+?)(?:\.[^./]*)?$")[0], "text": [c.decode(encoding, "ignore") for c in b["content"]]})

    return files.select("path", "content").mapInPandas(decode, "path string, tid string, text string")


def read_text_archives(spark: SparkSession, folder: str, encoding: str = "cp1252") -> DataFrame:
    """(tid, text) of every member of the tar.gz archives in a folder: lower-cased, contractions written out, tokens joined by blanks.

    An archive is one task; members are passed on one by one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").option("recursiveFileLookup", "true").load(folder)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for member in tar:
                        if member.isfile():
                            name = member.name.rpartition("/")[2].partition(".")[0]
                            yield pd.DataFrame({"tid": [name], "text": [tar.extractfile(member).read().decode(encoding, "ignore")]})

    raw = files.select("content").mapInPandas(unpack, "tid string, text string")
    return raw.select("tid", F.array_join(tokens(expand_contractions(F.lower("text"))), " ").alias("text"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in ranges of a numeric column, each read by its own task with a streaming cursor."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize="10000")
    return reader.options(**options).load()


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(token) of a file with a word a line: lower-cased, without blanks behind, shortest first."""
    words = spark.read.text(path).select(F.lower(F.rtrim("value")).alias("token")).where("token <> ''").distinct()
    return words.orderBy(F.length("token"), "token")


def read_gazetteer(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A tab-separated list of places; carriage returns within fields are dropped."""
    rows = spark.read.schema(columns).option("sep", "\t").option("lineSep", "\n").option("quote", "").csv(path)
    return rows.select(*[F.regexp_replace(c, "\r", "").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def read_lexicons(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(token, emotion, value) of tab-separated lists (token, value from 0 to 1), one for each emotion, on a scale from -1 to 1."""
    out = None
    for emotion, path in paths.items():
        part = spark.read.schema("token string, value double").option("sep", "\t").csv(path)
        part = part.select(F.lower("token").alias("token"), F.lit(emotion).alias("emotion"), ((F.col("value") - 0.5) * 2).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """(country, year, value) of a JSON list of objects with Country Name, Year and Value."""
    rows = spark.read.option("multiLine", "true").json(path)
    return rows.select(F.col("Country Name").alias("country"), F.col("Year").cast("int").alias("year"), F.col("Value").cast("double").alias("value"))


def read_wide_csv(spark: SparkSession, path: str, key: str, name: str, value: str) -> DataFrame:
    """A CSV with a column for each cohort, as rows (key, name, value)."""
    wide = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    rest = [c for c in wide.columns if c != key]
    return wide.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot([key], rest, name, value).where(F.col(value).isNotNull())
