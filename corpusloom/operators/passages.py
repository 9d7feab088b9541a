"""Text passages: which sections hold the terms, where the hits are, the text around them, and which passages to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hit_offsets, shorten, unicode_regex, window
from .archive import Archive
from .corpus import text_sections


def cooccurring(postings: DataFrame, unit: list[str], terms: list[str]) -> DataFrame:
    """The units (columns ``unit``) that hold every one of the terms."""
    held = postings.where(F.col("token").isin(terms)).groupBy(*unit).agg(F.count_distinct("token").alias("k"))
    return held.where(F.col("k") == len(terms)).select(*unit)


def section_hits(archive: Archive, terms: list[str], length: int = 200) -> DataFrame:
    """(doc_id, section) of sections that hold every term; nothing is exploded for sections without one of them."""
    wanted = F.array(*map(F.lit, terms))
    rows = text_sections(archive, length).where(F.arrays_overlap("words", wanted))
    return rows.where(F.size(F.array_intersect("words", wanted)) == len(set(terms))).select("doc_id", "section")


def islands(hits: DataFrame, key: str, number: str) -> DataFrame:
    """(key, start, stop, n) of runs of successive numbers within a key."""
    run = F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number))
    return hits.withColumn("_run", run).groupBy(key, "_run").agg(F.min(number).alias("start"), F.max(number).alias("stop"), F.count("*").alias("n")).drop("_run")


def term_matches(archive: Archive, term: str, others: list[str] = ()) -> DataFrame:
    """(doc_id, year, hit, text) of every occurrence of a substring in the lower-cased texts that match all search terms."""
    rows = archive.texts.select("doc_id", "year", F.lower("text").alias("text")).where(F.col("text").contains(term))
    for t in (term, *others):
        rows = rows.where(F.col("text").rlike(unicode_regex(t)))
    return rows.select("doc_id", "year", F.explode(hit_offsets(F.col("text"), term)).alias("hit"), "text")


def passages(archive: Archive, term: str, others: list[str] = (), length: int = 200) -> DataFrame:
    """(doc_id, year, hit, passage): the windows around hits in which every search term matches; windows may overlap."""
    found = term_matches(archive, term, others).withColumn("passage", window(F.col("text"), F.col("hit"), length)).drop("text")
    for t in (term, *others):
        found = found.where(F.col("passage").rlike(unicode_regex(t)))
    return found.where("passage <> ''")


def readability(found: DataFrame, vocabulary: DataFrame, keys: list[str], text: str = "passage") -> DataFrame:
    """(keys, readability): the share of a passage's words, split at blanks, that are in the vocabulary."""
    words = found.select(*keys, F.explode(F.split(F.trim(text), r"\s+")).alias("token"))
    known = vocabulary.select("token").distinct().withColumn("known", F.lit(1))
    return words.join(known, "token", "left").groupBy(*keys).agg(F.round(F.avg(F.coalesce("known", F.lit(0))), 6).alias("readability"))


def hash_order(keys: list[str], seed: str) -> Column:
    return F.md5(F.concat_ws("#", *[F.col(k).cast("string") for k in keys], F.lit(seed)))


def quota(found: DataFrame, partition: list[str], keys: list[str], n: int, seed: str = "0") -> DataFrame:
    """At most n rows for each partition, by the order of a seeded hash: a sample that is the same on every run.

    The ranked window keeps n rows of a group before it shuffles (a group limit), so a group of any size is fine.
    """
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(hash_order(keys, seed), *keys))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def with_authors(archive: Archive, docs: DataFrame) -> DataFrame:
    """(id, title, author): shortened title and all authors in order; docs without authors stay, with an empty one."""
    names = archive.authors.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("author")), ", ").alias("author"))
    joined = docs.join(names, docs["id"] == names["doc_id"], "left")
    return joined.select("id", shorten(F.col("title")).alias("title"), shorten(F.coalesce("author", F.lit(""))).alias("author"))


def frequent(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(key, year, n) of the n most frequent keys, blank ones aside, by year."""
    counts = rows.where(F.col(key) != "").groupBy(key, "year").agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), key).limit(n)
    return counts.join(F.broadcast(best.select(key)), key, "left_semi")
