"""n-gram frequencies by year: counts, relative frequencies, z-scores, breakdowns and wildcard expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from ..functions.stats import relative_frequency, share, z_score
from .archive import Archive
from .corpus import numbered
from .filters import Filters, eligible


def term_vector(archive: Archive, terms: list[str], unit: str = "docs") -> DataFrame:
    """(token, unit_id, tf) of some terms; the predicate reaches the Parquet scan."""
    return archive.raw("postings").where((F.col("unit") == unit) & F.col("token").isin(terms)).distinct().select("token", "unit_id", "tf")


def unit_totals(archive: Archive, unit: str = "docs") -> DataFrame:
    """(unit_id, total): tokens of each unit, by its unigrams."""
    rows = archive.raw("postings").where((F.col("unit") == unit) & (F.col("ngram") == 1)).distinct()
    return rows.groupBy("unit_id").agg(F.sum("tf").alias("total"))


def years_of(archive: Archive) -> DataFrame:
    """Every year from the first to the last of the docs."""
    span = archive.raw("docs").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return span.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("year"))


def densify(series: DataFrame, archive: Archive, keys: list[str], values: list[str]) -> DataFrame:
    """A row for every key and year, 0 where there was none. Keys are few: they are what a query asked for."""
    grid = series.select(*keys).distinct().join(F.broadcast(years_of(archive)))
    return grid.join(series, [*keys, "year"], "left").fillna(0, values)


def year_counts(archive: Archive, terms: list[str], docs: DataFrame | None = None) -> DataFrame:
    """(token, year, cnt) over the docs given, or all: one semi-join and one aggregate whatever the number of filters."""
    years = archive.doc_years if docs is None else docs.select(F.col("id").alias("unit_id"), "year").distinct()
    return term_vector(archive, terms).join(years, "unit_id").groupBy("token", "year").agg(F.sum("tf").alias("cnt"))


def year_totals(archive: Archive, docs: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    years = archive.doc_years if docs is None else docs.select(F.col("id").alias("unit_id"), "year").distinct()
    return (unit_totals(archive) if totals is None else totals).join(years, "unit_id").groupBy("year").agg(F.sum("total").alias("total"))


def token_series(archive: Archive, terms: list[str], filters: Filters | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(token, year, cnt, total, freq): counts and relative frequencies of terms for every year. ``totals`` are ``unit_totals`` that a
    caller has at hand."""
    docs = eligible(archive, filters) if filters else None
    counts = densify(year_counts(archive, terms, docs), archive, ["token"], ["cnt"])
    both = counts.join(F.broadcast(year_totals(archive, docs, totals)), "year", "left").fillna(0, ["total"])
    return both.withColumn("freq", F.round(relative_frequency(F.col("cnt"), F.col("total")), 9)).select("token", "year", "cnt", "total", "freq")


def _ends(end: str) -> Column:
    """Tokens that end so, by their stored reversal where they have one: two plain predicates, which the scan takes."""
    return F.col("token_reversed").startswith(end[::-1]) | F.col("token_reversed").isNull() & F.col("token").endswith(end)


def expand_wildcard(archive: Archive, pattern: str, limit: int = 10) -> DataFrame:
    """(token, ngram, total): the most frequent tokens that a term with ``*`` at one end stands for, of the same number of words.

    ``abc*`` is a prefix and holds the bare word too; ``*abc`` is a prefix of the stored reversed token, so both reach the scan.
    """
    if pattern.startswith("*") and pattern.endswith("*") or not ("*" in pattern):
        raise ValueError("a wildcard at one end of the term is needed")
    n = len(pattern.split())
    rows = archive.raw("tokens").where(F.col("ngram") == n)
    hits = rows.where(F.col("token").startswith(pattern[:-1])) if pattern.endswith("*") else rows.where(_ends(pattern[1:]))
    found = hits.distinct().groupBy("token", "ngram").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return found.orderBy(F.desc("total"), "token").limit(limit)


def search_terms(archive: Archive, terms: list[str], limit: int = 10) -> DataFrame:
    """(asked, token, ngram, total): the concrete tokens of search terms, wildcards expanded, unknown terms left out."""
    out = None
    for t in dict.fromkeys(terms):
        if "*" in t:
            found = expand_wildcard(archive, t, limit)
        else:
            found = archive.vocabulary.where((F.col("token") == t) & (F.col("ngram") == len(t.split()))).select("token", "ngram", "total")
        rows = found.select(F.lit(t).alias("asked"), "token", "ngram", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def term_units(archive: Archive, term: str, unit: str = "docs") -> DataFrame:
    """(unit_id) of the units that hold a term: any of a wildcard's tokens; the n-gram itself, or, if the vocabulary lacks it,
    every one of its words."""
    postings = archive.raw("postings").where(F.col("unit") == unit)
    if "*" in term:
        return postings.join(F.broadcast(expand_wildcard(archive, term)), ["token", "ngram"], "left_semi").select("unit_id").distinct()
    words = term.split()
    known = not archive.vocabulary.where((F.col("token") == term) & (F.col("ngram") == len(words))).isEmpty()
    asked = [term] if known else sorted(set(words))
    held = postings.where(F.col("token").isin(asked)).groupBy("unit_id").agg(F.count_distinct("token").alias("_k"))
    return held.where(F.col("_k") == len(asked)).select("unit_id")


def known_terms(archive: Archive, terms: list[str]) -> DataFrame:
    """(token, known) of terms."""
    asked = archive.spark.createDataFrame([(t, len(t.split())) for t in terms], "token string, ngram int")
    held = archive.raw("tokens").select("token", "ngram").distinct().withColumn("known", F.lit(True))
    return asked.join(held, ["token", "ngram"], "left").select("token", F.coalesce("known", F.lit(False)).alias("known"))


def totals_by(archive: Archive, dim: DataFrame, key: str, totals: DataFrame | None = None) -> DataFrame:
    """(key, year, total): tokens by a dimension (unit_id, key) and year."""
    return (unit_totals(archive) if totals is None else totals).join(dim, "unit_id").join(archive.doc_years, "unit_id").groupBy(key, "year").agg(F.sum("total").alias("total"))


def collection_dim(archive: Archive, aggregates: dict[str, list[int]] | None = None) -> DataFrame:
    """(unit_id, collection): the code of each doc's collection, and aggregates of several collections beside it."""
    docs = archive.raw("docs").select(F.col("id").alias("unit_id"), "collection_id").distinct()
    out = docs.join(F.broadcast(archive.raw("collections").select("collection_id", F.col("code").alias("collection"))), "collection_id").select("unit_id", "collection")
    for name, ids in (aggregates or {}).items():
        out = out.unionByName(docs.where(F.col("collection_id").isin(ids)).select("unit_id", F.lit(name).alias("collection")))
    return out


def type_dim(archive: Archive) -> DataFrame:
    return archive.doc_types.select(F.col("doc_id").alias("unit_id"), "doc_type")


def group_dim(archive: Archive, groups: dict[str, list[str]]) -> DataFrame:
    """(unit_id, grp): groups of doc types; a doc is in a group once however many of its types are."""
    rows = [(t, g) for g, ts in groups.items() for t in ts]
    members = archive.spark.createDataFrame(rows, "doc_type string, grp string")
    return type_dim(archive).join(F.broadcast(members), "doc_type").select("unit_id", "grp").distinct()


def breakdown(archive: Archive, terms: list[str], dim: DataFrame, key: str, top: int | None = 9, totals: DataFrame | None = None) -> DataFrame:
    """(key, year, cnt, total, freq) of the terms together, by a dimension; the ``top`` keys of most hits, ties by key.

    All keys are counted in one grouped aggregate, so the top is exact.
    """
    hits = term_vector(archive, terms).groupBy("unit_id").agg(F.sum("tf").alias("tf"))
    series = hits.join(dim, "unit_id").join(archive.doc_years, "unit_id").groupBy(key, "year").agg(F.sum("tf").alias("cnt"))
    if top:
        best = series.groupBy(key).agg(F.sum("cnt").alias("all")).orderBy(F.desc("all"), key).limit(top)
        series = series.join(F.broadcast(best.select(key)), key, "left_semi")
    both = series.join(totals_by(archive, dim, key, totals), [key, "year"], "left").fillna(0, ["total"])
    return both.withColumn("freq", F.round(share(F.col("cnt"), F.col("total")), 9)).select(key, "year", "cnt", "total", "freq")


def z_series(own: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``z`` to (token, year, cnt, total) by a reference corpus (token, year, ref_cnt, ref_total)."""
    both = own.join(reference, ["token", "year"], "left").fillna(0, ["ref_cnt", "ref_total"])
    z = z_score(F.col("cnt").cast("double"), F.col("total").cast("double"), F.col("ref_cnt").cast("double"), F.col("ref_total").cast("double"))
    return both.withColumn("z", F.round(z, 6))


def moving_average(series: DataFrame, keys: list[str], value: str, smoothing: int) -> DataFrame:
    """Adds ``smooth``: the mean over a centred window of years, cut at the ends."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(-smoothing, smoothing)
    return series.withColumn("smooth", F.round(F.avg(value).over(w), 9))


def padded(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fills nulls with the last known value of the key."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(value, F.last(value, True).over(w))


def vector_sum(*vectors: DataFrame) -> DataFrame:
    """The bag sum of vectors (unit_id, tf)."""
    out = vectors[0]
    for v in vectors[1:]:
        out = out.unionByName(v)
    return out.groupBy("unit_id").agg(F.sum("tf").alias("tf"))


def vector_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """(year, ratio) of two yearly series (year, cnt), 0 where the second has nothing."""
    both = a.join(b.withColumnRenamed("cnt", "_b"), "year", "left")
    return both.select("year", F.round(share(F.col("cnt").cast("double"), F.col("_b").cast("double")), 9).alias("ratio"))


def vectors_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def doc_type_index(archive: Archive, min_docs: int = 100) -> DataFrame:
    """(doc_type, n, idx): types by number of docs, with a dense index; the types are few, so one window orders them."""
    counts = archive.doc_types.groupBy("doc_type").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return counts.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "doc_type")) - 1).cast("int"))


def year_ranges(archive: Archive) -> DataFrame:
    """(year, min_id, max_id, n)."""
    return archive.docs_of("id", "year").groupBy("year").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n"))


def year_range_counts(archive: Archive) -> DataFrame:
    """(range_year, n): for every year, the docs whose id lies in the year's range of ids, whichever year they are of themselves.

    Ranges overlap, so a doc can count for many years; a range's docs are the difference of the running numbers at its two ends, and no
    doc meets a range that it isn't an end of.
    """
    ids = numbered(archive.docs_of("id", "year").where("id is not null").groupBy("id").agg(F.count("*").alias("_k")), ["id"], "_before", F.col("_k"))
    ends = year_ranges(archive).where("year is not null").select(F.col("year").alias("range_year"), F.posexplode(F.array("min_id", "max_id")).alias("_top", "id"))
    n = F.sum(F.when(F.col("_top") == 1, F.col("_before") + F.col("_k")).otherwise(-F.col("_before")))
    return ids.join(F.broadcast(ends), "id").groupBy("range_year").agg(n.alias("n"))


def ngram_result(archive: Archive, terms: list[str], filters: Filters, groups: dict[str, list[str]]) -> DataFrame:
    """The whole answer to a frequency query, long: (kind, key, year, cnt, total, freq) with kinds token, collection, doc_type and group.

    The units' totals, the costliest part, and the eligible docs are computed once and written, as four series read them.
    """
    totals, docs = durable(unit_totals(archive)), durable(eligible(archive, filters).select(F.col("id").alias("unit_id")))
    tokens = token_series(archive, terms, filters, totals).select(F.lit("token").alias("kind"), F.col("token").alias("key"), "year", "cnt", "total", "freq")
    parts = [tokens]
    for kind, dim, key, top in (("collection", collection_dim(archive), "collection", 9), ("doc_type", type_dim(archive), "doc_type", 9), ("group", group_dim(archive, groups), "grp", None)):
        rows = breakdown(archive, terms, dim.join(docs, "unit_id", "left_semi"), key, top, totals)
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "year", "cnt", "total", "freq"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
