"""Predicates on documents: any value within a category, every category together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archive import Archive
from .packed_values import unpack_values


@dataclass
class Filters:
    """What documents must have. Within a list any value will do; every list that isn't empty must be met."""

    doc_types: list[str] = field(default_factory=list)
    collections: list[int] = field(default_factory=list)
    availability: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    min_pages: int | None = None
    max_pages: int | None = None
    years: tuple[int, int] | None = None


def page_predicate(name: str) -> Column:
    """The predicate of a page filter's name, ``min_N`` or ``max_N``; unknown page counts are 0."""
    side, _, n = name.partition("_")
    pages = F.coalesce(F.col("pages"), F.lit(0))
    return pages >= int(n) if side == "min" else pages <= int(n)


def eligible(archive: Archive, f: Filters) -> DataFrame:
    """(id, year, collection_id, pages) of the docs that meet a filter. Attributes of the doc are plain predicates that reach the scan; the multi-valued ones are
    semi-joins, so no doc is counted twice however many of its types or labels match."""
    docs = archive.docs_of("id", "year", "collection_id", "pages")
    if f.collections:
        docs = docs.where(F.col("collection_id").isin(f.collections))
    if f.min_pages is not None:
        docs = docs.where(page_predicate(f"min_{f.min_pages}"))
    if f.max_pages is not None:
        docs = docs.where(page_predicate(f"max_{f.max_pages}"))
    if f.years:
        docs = docs.where(F.col("year").between(*f.years))
    if f.doc_types:
        docs = docs.join(archive.doc_types.where(F.col("doc_type").isin(f.doc_types)), docs["id"] == F.col("doc_id"), "left_semi")
    if f.availability:
        labels = unpack_values(archive.raw("docs"), "id", "availability").where(F.col("value").isin(f.availability))
        docs = docs.join(labels, "id", "left_semi")
    if f.terms:
        held = archive.raw("postings").where((F.col("unit") == "docs") & F.col("token").isin(f.terms))
        docs = docs.join(held, docs["id"] == F.col("unit_id"), "left_semi")
    return docs


def weighted_by_type(archive: Archive, doc_type: str) -> DataFrame:
    """(doc_id, weight) of the docs of a type, the weight shared among a doc's types (null weights count as a full one)."""
    rows = archive.raw("doc_types").where(F.lower(F.trim("doc_type")) == doc_type)
    return rows.groupBy("doc_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
