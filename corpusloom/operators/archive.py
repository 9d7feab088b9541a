"""The archive's tables as the engine reads them: repeated rows once, stray case and blanks gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import table


class Archive:
    """Lazily built DataFrames over one folder of Parquet tables; Catalyst prunes what a query doesn't use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def docs(self) -> DataFrame:
        return self.docs_of()

    def docs_of(self, *columns: str) -> DataFrame:
        """The docs, each once. With ``columns`` only these are read: repeated rows are equal in full and ``id`` tells docs apart, so the
        rows are told apart by what is asked for."""
        rows = self.raw("docs")
        return (rows.select(*columns) if columns else rows).distinct()

    @property
    def doc_years(self) -> DataFrame:
        return self.raw("docs").select(F.col("id").alias("unit_id"), "year").distinct()

    @property
    def doc_types(self) -> DataFrame:
        """(doc_id, doc_type), lower-cased and trimmed, each pair once."""
        return self.raw("doc_types").where("doc_type is not null").select("doc_id", F.lower(F.trim("doc_type")).alias("doc_type")).distinct()

    @property
    def authors(self) -> DataFrame:
        return self.raw("authors").where("trim(author) <> ''").distinct()

    @property
    def recipients(self) -> DataFrame:
        return self.raw("recipients").where("trim(recipient) <> ''").distinct()

    @property
    def postings(self) -> DataFrame:
        """(unit, ngram, token, unit_id, tf), each row once."""
        return self.raw("postings").distinct()

    @property
    def vocabulary(self) -> DataFrame:
        """(ngram, token, total)."""
        rows = self.raw("tokens").distinct().where("token is not null")
        return rows.groupBy("ngram", "token").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))

    @property
    def texts(self) -> DataFrame:
        """(doc_id, year, text) of documents with a text."""
        years = self.raw("docs").select(F.col("id").alias("doc_id"), "year", "collection_id").distinct()
        return self.raw("documents").where("text is not null").join(years, "doc_id")

    @property
    def words(self) -> DataFrame:
        """(doc_id, words): the tokens of each text."""
        return self.raw("documents").where("text is not null").select("doc_id", tokens(F.col("text")).alias("words"))
