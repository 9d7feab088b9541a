"""Queries of the general cleaning problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed_values import unpack_values
from ..operators.timestamps import epoch_seconds, estimate_zones, known_zones, normalise_times, parse_stated
from ..session import durable, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_values(table(spark, sf_dir, "docs"), "id", "availability")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_times(table(spark, sf_dir, "docs"), table(spark, sf_dir, "collections"))


def p4_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of each collection as estimated among all zones of the time zone database, without looking at its home_zone; the names in
    use only decide which of several zones of one history is named."""
    places = table(spark, sf_dir, "collections")
    docs = table(spark, sf_dir, "docs").select("id", "timestamp", "year", "date_orig", "collection_id").join(F.broadcast(places.select("collection_id", "day_order")), "collection_id").distinct()
    # materialised, so that the parser's expressions aren't copied into every later predicate
    parsed = durable(parse_stated(docs, "date_orig", F.col("day_order") == "dmy", F.col("year")).select("collection_id", "local", "offset", "timestamp", "year", "span"))
    rows = parsed.where("local is not null and offset is null and timestamp is not null").withColumn("instant", epoch_seconds(F.col("timestamp"), F.col("year"), F.lit("UTC")))
    used = [r[0] for r in places.select("home_zone").distinct().orderBy("home_zone").collect()]
    return estimate_zones(durable(rows.select("collection_id", "local", "instant", "span")), "collection_id", "local", "instant", "span", known_zones(spark, used))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_zones": p4_zones}

#: A quoted run, or a run without delimiters and brackets; then the enclosing marks go.
SQL = {
    "p2_found": r"""
        with f as (select distinct id, availability from docs where availability is not null),
        v as (select id, regexp_extract_all(availability, ' *"(?:[^"]|"")*" *| *''(?:[^'']|'''')*'' *|[^;；|,/\t\n\r\[\]{}()]+') as parts from f),
        t as (select id, list_filter(list_transform(parts, lambda p: case
                when trim(p) like '"%"' then replace(substr(trim(p), 2, length(trim(p)) - 2), '""', '"')
                when trim(p) like '''%''' then replace(substr(trim(p), 2, length(trim(p)) - 2), '''''', '''')
                else trim(p) end), lambda p: trim(p) <> '') as vals from v)
        select id, cast(u.pos as integer) as pos, trim(vals[u.pos]) as value from t, unnest(range(1, len(vals) + 1)) as u(pos)
    """,
}
