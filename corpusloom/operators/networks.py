"""Correspondence networks: who wrote to whom, how much, and about what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archive import Archive

#: A surname and one to three initials, the form in which most letters name persons.
PERSON = r"[A-Z][a-zA-Z]+[, -]+[A-Z]{1,3}"


def persons(name: Column) -> Column:
    """All names of the form surname, initials in a string."""
    return F.regexp_extract_all(name, F.lit(PERSON), F.lit(0))


def letters(archive: Archive, main: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, year, author, recipient), each once; with ``main`` only letters from or to that name."""
    docs = archive.raw("docs").select(F.col("id").alias("doc_id"), "year").distinct()
    if years:
        docs = docs.where(F.col("year").between(*years))
    rows = archive.authors.join(archive.recipients, "doc_id").join(docs, "doc_id")
    if main:
        rows = rows.where((F.col("author") == main) | (F.col("recipient") == main))
    return rows.select("doc_id", "year", "author", "recipient")


def weighted(pairs: DataFrame) -> DataFrame:
    """Adds ``weight``, 1 / (authors * recipients) of the doc."""
    n = pairs.groupBy("doc_id").agg((F.count_distinct("author") * F.count_distinct("recipient")).alias("_n"))
    return pairs.join(n, "doc_id").withColumn("weight", 1 / F.col("_n")).drop("_n")


def edges(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node1, node2, no_docs, no_docs_weighted, no_tokens, no_tokens_weighted) over letters and the token count of each doc."""
    full = weighted(pairs).join(tokens, "doc_id", "left").fillna(0, ["no_tokens"])
    out = full.groupBy(F.col("author").alias("node1"), F.col("recipient").alias("node2")).agg(
        F.count("*").alias("no_docs"), F.sum("weight").alias("w"), F.sum("no_tokens").alias("no_tokens"), F.sum(F.col("no_tokens") * F.col("weight")).alias("tw")
    )
    return out.select("node1", "node2", "no_docs", F.round("w", 6).alias("no_docs_weighted"), "no_tokens", F.round("tw", 6).alias("no_tokens_weighted"))


def nodes(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node, no_docs, no_docs_weighted, no_tokens): a letter counts for its author and its recipient, once if they are one."""
    full = weighted(pairs).join(tokens, "doc_id", "left").fillna(0, ["no_tokens"])
    each = full.select("doc_id", "weight", "no_tokens", F.explode(F.array_distinct(F.array("author", "recipient"))).alias("node"))
    out = each.groupBy("node").agg(F.count_distinct("doc_id").alias("no_docs"), F.sum("weight").alias("w"), F.sum("no_tokens").alias("no_tokens"))
    return out.select("node", "no_docs", F.round("w", 6).alias("no_docs_weighted"), "no_tokens")


def edge_weights(e: DataFrame) -> DataFrame:
    """(node1, node2, weight): the mean of an edge's share of docs and its share of tokens."""
    grand = e.agg(F.sum("no_docs_weighted").alias("_d"), F.sum("no_tokens_weighted").alias("_t"))
    share = (F.coalesce(F.try_divide("no_docs_weighted", "_d"), F.lit(0.0)) + F.coalesce(F.try_divide("no_tokens_weighted", "_t"), F.lit(0.0))) / 2
    return e.join(F.broadcast(grand)).select("node1", "node2", F.round(share, 6).alias("weight"))


def top_nodes(pairs: DataFrame, n: int = 50) -> DataFrame:
    """(node, n) of the names that most letters have."""
    each = pairs.select("doc_id", F.explode(F.array_distinct(F.array("author", "recipient"))).alias("node")).distinct()
    return each.groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(n)


def name_mentions(names: DataFrame, asked: list[str]) -> DataFrame:
    """(asked, name): names that contain one of some strings, whichever way round they stand; the strings come as a literal array,
    so nothing is joined."""
    return names.select("name", F.explode(F.array(*map(F.lit, asked))).alias("asked")).where(F.col("name").contains(F.col("asked"))).select("asked", "name").distinct()


def term_edge_cube(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(token, node1, node2, year, n): counts of a term by edge, and by edge and year, in one pass (year null in the first)."""
    rows = pairs.join(words, "doc_id").select("token", F.col("author").alias("node1"), F.col("recipient").alias("node2"), "year", "tf")
    sets = rows.groupingSets([["token", "node1", "node2"], ["token", "node1", "node2", "year"]], "token", "node1", "node2", "year")
    return sets.agg(F.sum("tf").alias("n"))


def select_letters(pairs: DataFrame, years: list[int] = (), nodes: list[str] = (), author: str | None = None) -> DataFrame:
    """Letters of any of the years and any of the nodes, and by an author if named."""
    if years:
        pairs = pairs.where(F.col("year").isin(list(years)))
    if nodes:
        pairs = pairs.where(F.col("author").isin(list(nodes)) | F.col("recipient").isin(list(nodes)))
    return pairs.where(F.col("author") == author) if author else pairs


def node_link_json(n: DataFrame, e: DataFrame, min_docs: int = 10) -> DataFrame:
    """(kind, json): one JSON object for each node, and for each edge of more than ``min_docs`` docs."""
    a = n.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node").alias("id"), "no_docs")).alias("json"))
    b = e.where(F.col("no_docs") > min_docs).select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("node1").alias("source"), F.col("node2").alias("target"), "no_docs")).alias("json"))
    return a.unionByName(b)
