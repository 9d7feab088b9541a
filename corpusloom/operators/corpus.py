"""Building a corpus: metadata tables, ids, sections, vocabulary and postings from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ngrams, sections
from ..session import durable
from .archive import Archive


def text_ngrams(archive: Archive, n: int) -> DataFrame:
    """(doc_id, token) of every run of n tokens of every text. The text itself doesn't go along with the exploded rows."""
    return archive.words.select("doc_id", F.explode(ngrams(F.col("words"), n)).alias("token"))


def text_postings(archive: Archive, n: int = 1) -> DataFrame:
    """(doc_id, token, tf)."""
    return text_ngrams(archive, n).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def text_sections(archive: Archive, length: int = 200) -> DataFrame:
    """(doc_id, section, words): each text in sections of so many tokens, counted from 0."""
    return archive.words.select("doc_id", F.posexplode(sections(F.col("words"), length)).alias("section", "words"))


def section_postings(archive: Archive, n: int = 1, length: int = 200) -> DataFrame:
    """(doc_id, section, token, tf); an n-gram never crosses a section's border."""
    each = text_sections(archive, length).select("doc_id", "section", F.explode(ngrams(F.col("words"), n)).alias("token"))
    return each.groupBy("doc_id", "section", "token").agg(F.count("*").alias("tf"))


def section_offsets(archive: Archive, length: int = 200) -> DataFrame:
    """(doc_id, section, first_token, last_token): token positions from 0, both included."""
    count = F.size("words")
    numbers = F.sequence(F.lit(0), F.ceil(count / F.lit(length)).cast("int") - 1)
    rows = archive.words.where(count > 0).select("doc_id", count.alias("n"), F.explode(numbers).alias("section"))
    return rows.select("doc_id", "section", (F.col("section") * length).alias("first_token"), (F.least(F.col("n"), (F.col("section") + 1) * length) - 1).alias("last_token"))


def numbered(df: DataFrame, order: list[str], name: str, size: Column | None = None) -> DataFrame:
    """Adds dense numbers from 0 in the order given, or with ``size`` the running sum of the rows before.

    Rows are put in ranges, counted by range, and numbered within it from the range's start, so no window holds all rows; what is
    gathered is a number for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1) if size is None else F.coalesce(size, F.lit(0))
    # materialised: both uses below must see the same ranges, which a second sampling or a coalesced read could change
    ranged = durable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).withColumn("_one", one.cast("bigint")))
    starts = ranged.groupBy("_part").agg(F.sum("_one").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_start")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_in", F.coalesce(F.sum("_one").over(within), F.lit(0)))
    return inside.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_one", "_in", "_start")


def vocabulary(archive: Archive, n: int, min_count: int) -> DataFrame:
    """(token, n): runs of n tokens that occur at least so often."""
    return text_ngrams(archive, n).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


#: Short words that aren't accepted as vocabulary.
INVALID_SHORT_WORDS = [
    "ab", "ac", "al", "amp", "ar", "av", "aw", "ax", "be", "bf", "bi", "bk", "bl", "bo", "br", "bu", "bx", "cb", "cd", "ce", "cg", "ci", "ck", "cl",
    "cr", "cu", "cw", "cy", "do", "dz", "eb", "em", "fa", "ff", "fm", "fy", "gd", "ge", "gk", "go", "gs", "hz", "ia", "ii", "iii", "il", "ir", "jg",
    "ki", "kl", "kr", "kt", "kw", "lg", "li", "lr", "ls", "ly", "mi", "mk", "mt", "mu", "nb", "nd", "ne", "ni", "np", "nr", "nu", "ob", "ow", "ox",
    "oz", "pd", "pf", "pk", "pl", "pp", "pt", "pu", "rb", "rd", "rf", "rh", "rm", "rn", "rs", "rt", "rx", "ry", "sc", "se", "sf", "sh", "si", "sm",
    "so", "sp", "sq", "sr", "st", "tc", "te", "th", "tl", "tm", "tn", "to", "tr", "ts", "ty", "uc", "um", "ur", "vb", "wk", "wm", "wu", "xe", "yb",
    "yd", "zn", "zr", "zs",
]


def valid_unigram(token: Column) -> Column:
    """Whether a token is a plausible word: longer than one letter, not a stray short word, no dash, not led by 0, not figures run
    into letters, no number over 3000. A dictionary, where there is one, is a semi-join of its own."""
    number = token.try_cast("bigint")
    return (
        (F.length(token) > 1) & ~token.isin(INVALID_SHORT_WORDS) & ~token.contains("-") & ~token.startswith("0")
        & ~token.rlike("^[0-9]{5,}[a-zA-Z]+") & F.coalesce(number <= 3000, F.lit(True)) & ~token.rlike("^[0-9]{10,}$")
    )


def apriori(archive: Archive, n: int, min_count: int) -> DataFrame:
    """Runs of n tokens whose parts of n - 1 tokens are both in the vocabulary, and that don't begin with two figures.

    Each level is a pair of semi-joins against the level below. A level's counts are materialised: they are read twice, and its
    predicates would else be pushed below the count, to every occurrence instead of every distinct run.
    """
    if n == 1:
        words = durable(vocabulary(archive, 1, 1))
        return words.where(valid_unigram(F.col("token")) | F.col("token").rlike("^[0-9ai]$"))
    below = durable(apriori(archive, n - 1, min_count).select("token"))
    found = durable(vocabulary(archive, n, min_count)).where(~F.col("token").rlike("^[0-9]+ [0-9]+[a-z]*"))
    parts = F.split("token", " ")
    keyed = found.withColumn("_a", F.array_join(F.slice(parts, 1, n - 1), " ")).withColumn("_b", F.array_join(F.slice(parts, 2, n - 1), " "))
    first = keyed.join(below.withColumnRenamed("token", "_a"), "_a", "left_semi")
    return first.join(below.withColumnRenamed("token", "_b"), "_b", "left_semi").select("token", "n")


def admitted(archive: Archive, removed_types: list[str], first_year: int = 1901) -> DataFrame:
    """Docs to take in: dated, of a known collection, with a text, and of no type that is left out."""
    dated = archive.docs.where(F.col("timestamp").isNotNull() & (F.col("year") >= first_year) & ~F.coalesce(F.trim("date_orig") == "1900", F.lit(False)))
    known = dated.join(F.broadcast(archive.raw("collections").select("collection_id")), "collection_id", "left_semi")
    kept = known.join(archive.doc_types.where(F.col("doc_type").isin(removed_types)).select(F.col("doc_id").alias("id")), "id", "left_anti")
    return kept.join(archive.raw("documents").where("text is not null").select(F.col("doc_id").alias("id")), "id", "left_semi")


def to_eav(archive: Archive) -> DataFrame:
    """(id, itag, value): metadata as one row for each value. Tags: 3 title, 4 date, 5 author, 29 type, 49 recipient, 100 pages."""
    one = archive.docs.select("id", F.explode(F.array(
        F.struct(F.lit(3).alias("itag"), F.col("title").alias("value")), F.struct(F.lit(4).alias("itag"), F.col("date_orig").alias("value")), F.struct(F.lit(100).alias("itag"), F.col("pages").cast("string").alias("value")),
    )).alias("e")).select("id", "e.itag", "e.value")
    many = [(archive.authors, 5, "author"), (archive.doc_types, 29, "doc_type"), (archive.recipients, 49, "recipient")]
    for df, tag, name in many:
        one = one.unionByName(df.select(F.col("doc_id").alias("id"), F.lit(tag).alias("itag"), F.col(name).alias("value")))
    return one.where("value is not null")


def from_eav(eav: DataFrame) -> DataFrame:
    """(id, title, pages, n_authors, n_types, n_recipients, type_weight): one row a doc again, by conditional aggregation, no pivot job."""
    tag = F.col("itag")
    types = F.count_distinct(F.when(tag == 29, F.col("value")))
    return eav.groupBy("id").agg(
        F.min(F.when(tag == 3, F.col("value"))).alias("title"), F.min(F.when(tag == 100, F.col("value").try_cast("int"))).alias("pages"),
        F.count_distinct(F.when(tag == 5, F.col("value"))).alias("n_authors"), types.alias("n_types"),
        F.count_distinct(F.when(tag == 49, F.col("value"))).alias("n_recipients"), F.round(F.try_divide(F.lit(1.0), types), 6).alias("type_weight"),
    )


def latest(df: DataFrame, key: str, version: list[str]) -> DataFrame:
    """One row for each key, the one of the highest version: replacing upserts. A partial aggregate runs before the shuffle."""
    rest = [c for c in df.columns if c not in (key, *version)]
    return df.groupBy(key).agg(F.max(F.struct(*version, *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in (*version, *rest)])
