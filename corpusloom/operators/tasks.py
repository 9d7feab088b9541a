"""Whole tasks of an archive's users, and the smaller operators that only they need."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import shorten, window
from ..session import durable
from ..sources.writers import write_postings
from . import distinctive as di
from . import networks as ne
from . import passages as pa
from .archive import Archive
from .corpus import numbered, text_postings, text_sections
from .filters import Filters, eligible
from .result_cache import ResultCache, query_hash
from .side import top_by


def section_filter(archive: Archive, filters: Filters, length: int = 200) -> DataFrame:
    """(doc_id, section, words) of the sections that meet a filter. A filter on terms asks the section itself for any of them;
    all other filters are the doc's and carry over to every section of it."""
    docs = eligible(archive, Filters(filters.doc_types, filters.collections, filters.availability, [], filters.min_pages, filters.max_pages, filters.years))
    rows = text_sections(archive, length).join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return rows.where(F.arrays_overlap("words", F.array(*map(F.lit, filters.terms)))) if filters.terms else rows


def section_series(archive: Archive, terms: list[str], filters: Filters) -> DataFrame:
    """(token, year, cnt, total): a frequency query that a filter on terms has switched to sections, totals included."""
    kept = section_filter(archive, filters).join(archive.doc_years.withColumnRenamed("unit_id", "doc_id"), "doc_id")
    wanted = F.array(*map(F.lit, terms))
    each = kept.select("year", F.size("words").alias("size"), F.filter("words", lambda w: F.array_contains(wanted, w)).alias("hits"))
    each = durable(each.groupBy("year", "hits").agg(F.sum("size").alias("size"), F.count("*").alias("k")))
    totals = each.groupBy("year").agg(F.sum("size").alias("total"))
    counts = each.select("year", "k", F.explode("hits").alias("token")).groupBy("token", "year").agg(F.sum("k").alias("cnt"))
    return counts.join(F.broadcast(totals), "year").select("token", "year", "cnt", "total")


def section_numbers(archive: Archive, length: int = 200) -> DataFrame:
    """(section_id, doc_id, section): sections numbered through the archive in the order of docs."""
    return numbered(text_sections(archive, length).select("doc_id", "section"), ["doc_id", "section"], "section_id")


def docs_of_sections(archive: Archive, hits: DataFrame, length: int = 200) -> DataFrame:
    """(section_id, doc_id, section) of the numbers in ``hits.section_id``."""
    return section_numbers(archive, length).join(hits.select("section_id").distinct(), "section_id", "left_semi")


def section_spans(archive: Archive, length: int = 200) -> DataFrame:
    """(doc_id, section, first_char, last_char): the characters of the text, from 0 and both included, from a section's first token
    to its last. Every token is taken with what stands before it, so lengths add up to offsets and repeated passages do no harm."""
    piece = F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N}_]*[\p{L}\p{N}_]+"), F.lit(0))
    each = archive.raw("documents").where("text is not null").select("doc_id", F.posexplode(piece).alias("pos", "piece"))
    ends = each.withColumn("end", F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("pos")))
    begin = F.col("end") - F.length(F.regexp_extract("piece", r"[\p{L}\p{N}_]+$", 0))
    rows = ends.select("doc_id", (F.floor(F.col("pos") / length)).cast("int").alias("section"), begin.alias("begin"), "end")
    return rows.groupBy("doc_id", "section").agg(F.min("begin").cast("bigint").alias("first_char"), (F.max("end") - 1).cast("bigint").alias("last_char"))


def text_ranges(archive: Archive, ranges: DataFrame) -> DataFrame:
    """(doc_id, first, last, slice): any number of ranges (doc_id, first, last; characters from 0, both included) of each text, each
    text read once however many ranges it has."""
    asked = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("r"))
    rows = archive.raw("documents").where("text is not null").select("doc_id", "text").join(asked, "doc_id")
    slices = rows.select("doc_id", F.explode(F.transform("r", lambda x: F.struct(x["first"], x["last"], F.substring(F.col("text"), x["first"] + 1, x["last"] - x["first"] + 1).alias("slice")))).alias("x"))
    return slices.select("doc_id", "x.first", "x.last", "x.slice")


def display_series(series: DataFrame, key: str, value: str, excluded: list[str] = (), years: tuple[int, int] | None = None) -> DataFrame:
    """(key, total, mean, place) of series for a chart: excluded ones left out, the largest total within the years first."""
    rows = series.where(~F.trim(key).isin(list(excluded))) if excluded else series
    rows = rows.where(F.col("year").between(*years)) if years else rows
    sums = rows.groupBy(key).agg(F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), key)))  # series are what one chart shows


def resampled(series: DataFrame, key: str, value: str, points: int = 1000) -> DataFrame:
    """(key, x, y): a natural cubic spline through each series (key, year, value) at equal steps, below 0 cut to 0. A series has a
    point a year, so a group is small whatever the archive holds; null values are left out, a single point stays as it is."""

    def spline(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf.dropna(subset=[value]).sort_values("year")
        x, y = at["year"].to_numpy(float), at[value].to_numpy(float)
        n = len(x)
        if n < 2:
            return pd.DataFrame({key: at[key], "x": x, "y": np.maximum(y, 0)})
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        m = np.zeros(n)
        if n > 2:
            a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
            m[1:-1] = np.linalg.solve(a, 6 * np.diff(slope))
        at_x = np.linspace(x[0], x[-1], points)
        k = np.clip(np.searchsorted(x, at_x, "right") - 1, 0, n - 2)
        t, left = at_x - x[k], slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6
        out = y[k] + left * t + m[k] / 2 * t**2 + (m[k + 1] - m[k]) / (6 * h[k]) * t**3
        return pd.DataFrame({key: at[key].iloc[0], "x": at_x, "y": np.maximum(out, 0)})

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, "year", value).groupBy(key).applyInPandas(spline, f"{key} {kind}, x double, y double")


def absolute_counts(frequency: Column, total: Column) -> Column:
    """The count that a relative frequency stands for, half-even as numpy rounds."""
    return F.bround(frequency * total, 0).cast("bigint")


def cohorts(births: DataFrame, prevalence: DataFrame, span: int = 5) -> DataFrame:
    """(cohort, year, age, value): groups born in ``span`` years from ``cohort`` met with the yearly values (year, value) of their
    lives; years without a value are skipped. ``births`` has (cohort, until), both small by nature."""
    each = births.select("cohort", F.explode(F.sequence(F.col("cohort"), F.col("cohort") + span - 1)).alias("born"), "until")
    lives = each.select("cohort", "born", F.explode(F.sequence("born", "until")).alias("year"))
    met = lives.join(prevalence, "year")
    return met.groupBy("cohort", "year").agg(F.round(F.avg(F.col("year") - F.col("born")), 6).alias("age"), F.round(F.avg("value"), 6).alias("value"))


def node_pairs(nodes: DataFrame) -> DataFrame:
    """(node1, node2), node1 < node2, of every two of some nodes: what a layout asks edges for, so the nodes are a top-k."""
    few = nodes.select("node")
    return few.withColumnRenamed("node", "node1").join(F.broadcast(few.withColumnRenamed("node", "node2")), F.col("node1") < F.col("node2"))


def edge_mentions(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(node1, node2, doc_id, year) of letters whose author holds one end of an edge in its name and whose recipient the other, either
    way round. ``edges`` (node1, node2) are those of a top-k, so the names are met with a handful of strings."""
    e = F.broadcast(edges.select("node1", "node2").distinct())
    a, r = F.col("author"), F.col("recipient")
    either = (a.contains(F.col("node1")) & r.contains(F.col("node2"))) | (a.contains(F.col("node2")) & r.contains(F.col("node1")))
    names = pairs.select("author", "recipient").distinct().join(e, either)
    return pairs.join(names, ["author", "recipient"]).select("node1", "node2", "doc_id", "year").distinct()


def network_sections(archive: Archive, pairs: DataFrame, edges: DataFrame, length: int = 200) -> DataFrame:
    """(section_id, node1, node2, doc_id, section, weight, year, text): the sections of the letters of each edge, each with its letter's
    share among the edge's (1 / sections)."""
    letters = edge_mentions(pairs, edges)
    held = text_sections(archive, length).join(letters.select("doc_id").distinct(), "doc_id", "left_semi")
    n = held.groupBy("doc_id").agg(F.count("*").alias("_n"))
    texts = durable(numbered(held.join(n, "doc_id").select("doc_id", "section", F.round(1 / F.col("_n"), 6).alias("weight"), F.array_join("words", " ").alias("text")), ["doc_id", "section"], "section_id"))
    return letters.join(texts, "doc_id").select("section_id", "node1", "node2", "doc_id", "section", "weight", "year", "text")


def edge_terms(archive: Archive, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(node1, node2, token, a, b, g2): what sets the letters of each edge apart from all letters; parts of the names of either end
    don't count."""
    docs = pairs.join(F.broadcast(edges.select("node1", "node2")), (F.col("author") == F.col("node1")) & (F.col("recipient") == F.col("node2"))).select("doc_id", "node1", "node2").distinct()
    edge = F.struct("node1", "node2").alias("edge")
    here = di.count_words(archive.words.join(docs.select("doc_id", edge), "doc_id"), ["edge"])
    there = di.count_words(archive.words.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), [])
    parts = F.regexp_extract_all(F.lower(F.concat_ws(" ", "edge.node1", "edge.node2")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    compared = di.compare(here, there, ["edge"]).where(~F.array_contains(parts, F.col("token")))
    return di.winners_by(compared, "edge").select("edge.node1", "edge.node2", "token", "a", "b", "g2")


def ranked_edges(weights: DataFrame, edges: DataFrame, metric: str, least: float = 0.001) -> DataFrame:
    """Edges (node1, node2, weight, and those of ``edges``) above a weight, in the order of any of the metrics."""
    both = weights.where(F.col("weight") > least).join(edges, ["node1", "node2"])
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc(metric), "node1", "node2")))


def node_components(archive: Archive, pairs: DataFrame, k: int = 2, nodes: int = 25, terms: int = 200) -> DataFrame:
    """(node, c0..): principal components of the top nodes over the most frequent terms of their letters. Both are top-k parameters,
    so the matrix is bounded; its cells are counted over all letters."""
    top = F.broadcast(ne.top_nodes(pairs, nodes).select("node"))
    each = pairs.select("doc_id", F.explode(F.array_distinct(F.array("author", "recipient"))).alias("node")).distinct().join(top, "node", "left_semi")
    counts = durable(di.count_words(archive.words.join(each, "doc_id"), ["node"]))
    vocabulary = [r[0] for r in di.limited_vocabulary(counts.groupBy("token").agg(F.sum("n").alias("n")), terms, 1).select("token").orderBy("token").collect()]
    scaled = di.tfidf_smooth(counts.where(F.col("token").isin(vocabulary)), "node")
    maps = scaled.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("token", "tfidf"))).alias("m"))
    rows = maps.select("node", array_to_vector(F.array(*[F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0.0)) for t in vocabulary])).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    out = model.transform(rows).select("node", vector_to_array("p").alias("p"))
    return out.select("node", *[F.round(F.col("p")[i], 6).alias(f"c{i}") for i in range(k)])


def drill_down(archive: Archive, term: str, collection: int, years: tuple[int, int]) -> DataFrame:
    """(token, a, b, g2): what sets a collection's texts with a term apart in some years from those with it in all others."""
    rows = archive.texts.where((F.col("collection_id") == collection) & F.lower("text").contains(term)).select("doc_id", "year").distinct()
    within = F.col("year").between(*years)
    here, there = (di.count_words(archive.words.join(rows.where(w), "doc_id", "left_semi"), []) for w in (within, ~within))
    return di.winners(di.compare(here, there), search=term.split())


def passage_task(archive: Archive, term: str, others: list[str], filters: Filters, length: int = 200, least: float = 0.15, per_doc: int = 100, per_year: int = 50, docs_a_year: int = 1000, section: int = 200, seed: str = "7") -> DataFrame:
    """The whole answer to a passage query, long: (kind, key, year, value, text).

    Sections that hold every term are found among the docs that meet the filter; runs of successive sections are the places to look
    at. At most ``docs_a_year`` docs a year, ``per_doc`` runs a doc and ``per_year`` passages a year are shown, by the order of a
    seeded hash; those are caps on what is shown, and kind ``complete`` says for each year whether anything was left out. Kinds: passage
    (key: doc and offset, value: readability), run (key: doc, value: sections), author and term (the most frequent ones),
    distinctive (value: log-likelihood), documents (value: docs with hits), complete (value: 1 or 0).
    """
    docs = eligible(archive, filters).select(F.col("id").alias("doc_id"), "year")
    wanted = F.array(*map(F.lit, [term, *others]))
    held = text_sections(archive, section).where(F.arrays_overlap("words", wanted)).join(docs, "doc_id")
    hits = held.where(F.size(F.array_intersect("words", wanted)) == len({term, *others})).select("doc_id", "year", "section")
    runs = durable(pa.islands(hits, "doc_id", "section").join(docs, "doc_id"))
    found_docs = runs.select("doc_id", "year").distinct()
    shown_docs = pa.quota(found_docs, ["year"], ["doc_id"], docs_a_year, seed)
    shown = pa.quota(runs.join(shown_docs.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], ["doc_id", "start"], per_doc, seed)
    spans = section_spans(archive, section)
    first = shown.join(spans.select("doc_id", F.col("section").alias("start"), "first_char"), ["doc_id", "start"]).select("doc_id", "start", "first_char")
    ends = shown.join(spans.select("doc_id", F.col("section").alias("stop"), "last_char"), ["doc_id", "stop"]).select("doc_id", "start", "last_char")
    places = first.join(ends, ["doc_id", "start"])
    matches = pa.term_matches(archive, term).join(docs.select("doc_id"), "doc_id", "left_semi").join(places, "doc_id").where(F.col("hit").between(F.col("first_char"), F.col("last_char")))
    cut = matches.withColumn("passage", window(F.col("text"), F.col("hit"), length)).where("passage <> ''").select("doc_id", "year", "hit", "passage").distinct()
    cut = durable(cut)
    good = pa.readability(cut, archive.vocabulary.where("ngram = 1"), ["doc_id", "hit"]).where(F.col("readability") > least)
    readable = durable(cut.join(good, ["doc_id", "hit"]))
    shown_passages = durable(pa.quota(readable, ["year"], ["doc_id", "hit"], per_year, seed))
    own = shown_passages.select(F.split("passage", r"\s+").alias("words"))
    rest = archive.words.join(docs, "doc_id", "left_semi")
    none = F.lit(None)

    def part(df: DataFrame, kind: str, key: Column | str, year: Column, value: Column, text: Column = none) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), year.cast("int").alias("year"), value.cast("double").alias("value"), text.cast("string").alias("text"))

    counts = durable(di.count_words(own, []))
    terms = di.limited_vocabulary(counts, 200, 2)
    best = di.winners(di.compare(counts, di.count_words(rest, [])), search=[term, *others])
    authors = archive.authors.join(found_docs, "doc_id")
    before = found_docs.groupBy("year").agg(F.count("*").alias("n")).join(readable.groupBy("year").agg(F.count("*").alias("p")), "year", "left")
    runs_cut = runs.groupBy("doc_id", "year").agg(F.count("*").alias("r")).groupBy("year").agg(F.max("r").alias("r"))
    complete = before.join(runs_cut, "year").select("year", ((F.col("n") <= docs_a_year) & (F.coalesce("p", F.lit(0)) <= per_year) & (F.col("r") <= per_doc)).cast("int").alias("ok"))
    return (
        part(shown_passages, "passage", F.concat_ws("#", "doc_id", "hit"), F.col("year"), F.col("readability"), F.col("passage"))
        .unionByName(part(shown, "run", F.concat_ws("#", "doc_id", "start"), F.col("year"), F.col("n")))
        .unionByName(part(pa.frequent(authors, "author"), "author", "author", F.col("year"), F.col("n")))
        .unionByName(part(terms, "term", "token", none, F.col("n")))
        .unionByName(part(best, "distinctive", "token", none, F.col("g2")))
        .unionByName(part(found_docs.groupBy("year").agg(F.count("*").alias("n")), "documents", none, F.col("year"), F.col("n")))
        .unionByName(part(complete, "complete", none, F.col("year"), F.col("ok")))
    )


def task_vocabulary(answer: DataFrame) -> DataFrame:
    """(token): the frequent and the distinctive terms of a passage task together."""
    return answer.where("kind in ('term', 'distinctive')").select(F.col("key").alias("token")).distinct()


def snippet(title: Column, year: Column, passage: Column) -> Column:
    """A passage as it is shown, in HTML."""
    return F.concat(F.lit("<p><b>"), shorten(title), F.lit("</b> ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")<br>..."), passage, F.lit("...</p>"))


def safe_name(name: Column) -> Column:
    """A name that can be part of a path: slashes become underscores."""
    return F.translate(name, "/", "_")


def listed(names: list[str]) -> str:
    """Names in a sentence: "a", "a and b", "a, b, and c"."""
    if len(names) < 3:
        return " and ".join(names)
    return ", ".join(names[:-1]) + f", and {names[-1]}"


def check_type(value: Any, expected: type | tuple[type, ...], name: str = "value") -> Any:
    """The value, if it is of the type or of one of the types; a bool is no number. Anything else is a TypeError that says so."""
    kinds = expected if isinstance(expected, tuple) else (expected,)
    if isinstance(value, kinds) and not (isinstance(value, bool) and bool not in kinds):
        return value
    raise TypeError(f"{name} must be {listed([k.__name__ for k in kinds])}, not {type(value).__name__}")


def build_corpus(archive: Archive, folder: str, lengths: tuple[int, ...] = (1, 2, 3)) -> None:
    """The build of a corpus as one job: postings of texts by unit and n-gram length, sorted by token, and the vocabulary with totals
    and reversed tokens, in ``folder``."""
    posts = None
    for n in lengths:
        rows = text_postings(archive, n).select(F.lit("docs").alias("unit"), F.lit(n).alias("ngram"), "token", F.col("doc_id").alias("unit_id"), F.col("tf").cast("int").alias("tf"))
        posts = rows if posts is None else posts.unionByName(rows)
    write_postings(posts, f"{folder}/postings")
    built = archive.spark.read.parquet(f"{folder}/postings")
    totals = built.groupBy("ngram", "token").agg(F.sum("tf").alias("total")).withColumn("token_reversed", F.reverse("token"))
    totals.repartitionByRange("ngram", "token").sortWithinPartitions("ngram", "token").write.mode("overwrite").parquet(f"{folder}/vocabulary")


def built_vector(archive: Archive, folder: str, term: str) -> DataFrame:
    """(unit_id, tf) of a term from a built corpus: directories and sorted tokens leave a scan little to read."""
    n = len(term.split())
    return archive.spark.read.parquet(f"{folder}/postings").where((F.col("unit") == "docs") & (F.col("ngram") == n) & (F.col("token") == term)).select("unit_id", "tf")


class ArchiveApi:
    """What an API asks for, computed once for each set of parameters and then read."""

    def __init__(self, archive: Archive, folder: str):
        self.archive, self.cache = archive, ResultCache(archive.spark, folder)

    def frequencies(self, terms: list[str], filters: Filters, groups: dict[str, list[str]]) -> DataFrame:
        from .frequencies import ngram_result

        return self.cache.as_json(query_hash("frequencies", terms, vars(filters), groups), lambda: ngram_result(self.archive, terms, filters, groups))

    def passages(self, term: str, others: list[str], filters: Filters, years: tuple[int, int], **kw: Any) -> DataFrame:
        """The passage task of some years. Every year is kept on its own, so another span of years only adds those it lacks."""
        out = None
        for year in range(years[0], years[1] + 1):
            at = Filters(**{**vars(filters), "years": (year, year)})
            rows = self.cache.get(query_hash("passages", term, others, vars(at), kw), lambda f=at: passage_task(self.archive, term, others, f, **kw))
            out = rows if out is None else out.unionByName(rows)
        return out

    def sections(self, terms: list[str], filters: Filters, n: int = 50) -> DataFrame:
        """(doc_id, section, text) of at most n sections a year with every term, by hash order."""

        def compute() -> DataFrame:
            rows = section_filter(self.archive, Filters(**{**vars(filters), "terms": terms})).where(F.size(F.array_intersect("words", F.array(*map(F.lit, terms)))) == len(set(terms)))
            dated = rows.join(self.archive.doc_years.withColumnRenamed("unit_id", "doc_id"), "doc_id")
            return pa.quota(dated, ["year"], ["doc_id", "section"], n).select("doc_id", "year", "section", F.array_join("words", " ").alias("text"))

        return self.cache.get(query_hash("sections", terms, vars(filters), n), compute)


def person_network(archive: Archive, main: str, tokens: DataFrame, nodes: int = 50) -> DataFrame:
    """(kind, key, other, value): a person's network in one answer, the strongest names first. Kinds: node (alphabetical place of the
    top names with their letters), edge (weight), year (letters)."""
    pairs = durable(ne.letters(archive, main))
    top = ne.top_nodes(pairs, nodes)
    a = top.select(F.lit("node").alias("kind"), F.col("node").alias("key"), F.lit(None).cast("string").alias("other"), F.col("n").cast("double").alias("value"))
    e = ne.edge_weights(ne.edges(pairs, tokens)).select(F.lit("edge").alias("kind"), F.col("node1").alias("key"), F.col("node2").alias("other"), F.col("weight").alias("value"))
    years = pairs.groupBy("year").agg(F.count_distinct("doc_id").alias("n")).select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("key"), F.lit(None).cast("string").alias("other"), F.col("n").cast("double").alias("value"))
    return a.unionByName(e).unionByName(years).orderBy("kind", "key", "other")


def top_metric(nodes: DataFrame, metric: str, n: int = 50) -> DataFrame:
    """The n nodes of the highest metric, in the order of their names."""
    return top_by(nodes.withColumn("_all", F.lit(1)), "_all", metric, "node", n).drop("_all").orderBy("node")
