"""Frequency of every distinct term: recursive radix spilling, each partition aggregated out of core with DuckDB.

Rows go to partitions by bits of the hash of their term; a term that is too large for one partition is counted first and
takes bits of its items too. A task holds its rows up to a memory budget; beyond it, it writes them to 16 files by the next
four hash bits, and each file that is still over the budget is split by the next four, and so on. DuckDB aggregates what
fits. What the tasks return are sums for each term, which Spark adds up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

FANOUT_BITS = 4
#: token, ngram, source (0: token table, 1: postings), item (row id or unit id), amount
_SCHEMA = pa.schema([("token", pa.string()), ("ngram", pa.int32()), ("source", pa.int32()), ("item", pa.int64()), ("reversed", pa.string()), ("amount", pa.int64())])
_SUMS = """
    select token, ngram, cast(sum(case when source = 0 then amount end) as bigint) as total,
           count(*) filter (where source = 1) as records, bool_or(source = 0) as listed
    from (select distinct token, ngram, source, item, reversed, amount from part) group by token, ngram
"""


class _Spill:
    """Rows of one radix partition: in memory up to the budget, then in 16 files by hash bits."""

    def __init__(self, folder: str, budget: int, shift: int):
        self.folder, self.budget, self.shift = folder, budget, shift
        self.held: list[pa.Table] = []
        self.size = 0
        self.files: dict[int, tuple[pq.ParquetWriter, str]] = {}
        self.fs, self.path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def add(self, rows: pa.Table) -> None:
        self.held.append(rows)
        self.size += rows.nbytes
        if self.size > self.budget and self.shift < 60:
            self._write()

    def _write(self) -> None:
        import duckdb

        part = pa.concat_tables(self.held)
        self.held, self.size = [], 0
        con = duckdb.connect(config={"threads": 1})
        con.register("part", part)
        split = con.sql(f"select *, cast((hash(token, ngram, item) >> {self.shift}) & {2**FANOUT_BITS - 1} as integer) as radix from part order by radix").to_arrow_table()
        con.close()
        radix = split.column("radix").to_numpy()
        rows = split.drop_columns(["radix"])
        for k in range(2**FANOUT_BITS):
            lo, hi = radix.searchsorted(k), radix.searchsorted(k, side="right")
            if hi > lo:
                if k not in self.files:
                    self.fs.create_dir(self.path, recursive=True)
                    name = f"{self.path}/{self.shift}-{k}-{uuid.uuid4().hex}.parquet"
                    self.files[k] = pq.ParquetWriter(name, _SCHEMA, filesystem=self.fs, compression="zstd"), name
                self.files[k][0].write_table(rows.slice(lo, hi - lo).cast(_SCHEMA))

    def sums(self) -> Iterator[pa.RecordBatch]:
        import duckdb

        if not self.files:
            if self.held:
                con = duckdb.connect(config={"threads": 1})
                con.register("part", pa.concat_tables(self.held))
                yield from con.sql(_SUMS).to_arrow_table().to_batches(max_chunksize=50_000)
                con.close()
            return
        if self.held:
            self._write()
        for writer, name in self.files.values():
            writer.close()
            finer = _Spill(self.folder, self.budget, self.shift + FANOUT_BITS)
            for batch in pq.ParquetFile(name, filesystem=self.fs).iter_batches(100_000):
                finer.add(pa.Table.from_batches([batch]))
            self.fs.delete_file(name)
            yield from finer.sums()


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system named: one without a scheme is the cluster's default one, not a worker's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    name = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return "file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name


def count_terms(tokens: DataFrame, postings: DataFrame, unit: str = "docs", budget_mb: float = 96, partitions: int | None = None) -> DataFrame:
    """(token, ngram, total, records) of every term of ``tokens``.

    ``total`` is the sum of ``tokens.total`` over the term's distinct rows, null amounts adding nothing; ``records`` the
    number of distinct ``unit_id`` of its postings of ``unit``, 0 if there are none. Null tokens count as a term of their
    own; terms of postings only give no row; empty tables give no rows; further columns are ignored.

    A term with more than a quarter of a partition's share of the rows takes hash bits of its items as well, so a term that
    holds a third of all rows is spread evenly. There are fewer than 4 * partitions such terms, which bounds what is
    broadcast. Spilled rows go to the shared checkpoint folder and are read and removed by the task that wrote them.
    """
    spark = tokens.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = tokens.select("token", F.col("ngram").cast("int").alias("ngram"), F.lit(0).alias("source"), F.col("id").cast("bigint").alias("item"), F.col("token_reversed").alias("reversed"), F.col("total").cast("bigint").alias("amount"))
    met = postings.where(F.col("unit") == unit).select("token", F.col("ngram").cast("int").alias("ngram"), F.lit(1).alias("source"), F.col("unit_id").cast("bigint").alias("item"), F.lit(None).cast("string").alias("reversed"), F.lit(None).cast("bigint").alias("amount"))
    sizes = met.groupBy("token", "ngram").agg(F.count("*").alias("n"))
    limit = max(1000, met.count() // (4 * parts))
    hot = sizes.where(F.col("n") > limit).select(F.col("token").alias("t"), F.col("ngram").alias("g"), F.lit(1).alias("hot"))
    rows = listed.unionByName(met)
    marked = rows.join(F.broadcast(hot), rows["token"].eqNullSafe(F.col("t")) & rows["ngram"].eqNullSafe(F.col("g")), "left").drop("t", "g")
    spread = marked.withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("item"), F.lit(parts))).otherwise(0))
    folder = _qualified(spark, f"{shared_dir(spark)}/radix-{uuid.uuid4().hex}")
    budget = int(budget_mb * 2**20)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = _Spill(folder, budget, 0)
        for batch in batches:
            spill.add(pa.Table.from_batches([batch]).cast(_SCHEMA))
        yield from spill.sums()

    placed = spread.repartition(parts, "token", "ngram", "salt").select(*_SCHEMA.names)
    sums = placed.mapInArrow(run, "token string, ngram int, total bigint, records bigint, listed boolean")
    whole = sums.groupBy("token", "ngram").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.sum("records").alias("records"), F.bool_or("listed").alias("listed"))
    return whole.where("listed").select("token", "ngram", "total", "records")


def mark_terms(counts: DataFrame, records: int, common_share: float = 1 / 20, rare_below: int = 5) -> DataFrame:
    """Adds ``mark``: ``common`` if a term's records are more than this share of all, else ``rare`` below so many occurrences, else null."""
    common = F.col("records") > records * common_share
    return counts.withColumn("mark", F.when(common, "common").when(F.col("total") < rare_below, "rare"))
