"""Side analyses: lexicon scores, weighted cohorts, as-of lookups, country series, places and generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .archive import Archive


def lexicon_scores(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, emotion, score, matched): sums of a lexicon's values (token, emotion, value) over a text's words, and the words of
    positive value in order. The lexicon is a word list; Catalyst broadcasts it while it is small."""
    rows = words.select("doc_id", F.explode("words").alias("token")).join(lexicon, "token")
    hits = F.sort_array(F.collect_set(F.when(F.col("value") > 0, F.col("token"))))
    return rows.groupBy("doc_id", "emotion").agg(F.round(F.sum("value"), 6).alias("score"), F.array_join(hits, " ").alias("matched"))


def top_by(df: DataFrame, partition: str, metric: str, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(F.desc(metric), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def weighted_statistics(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, mean, median) of values that each stand for ``weight`` observations, without writing them out."""
    w = F.col(weight)
    return df.groupBy(key).agg(F.round(F.sum(F.col(value) * w) / F.sum(w), 6).alias("mean"), F.round(F.percentile(value, 0.5, w.cast("bigint")), 6).alias("median"))


def as_of(asked: DataFrame, known: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, year, value): the value of the year asked for (kept within low and high), else of the next later year, else of the latest
    earlier one. ``known`` has (key, year, value)."""
    at = F.greatest(F.lit(low), F.least(F.lit(high), F.col("year"))).alias("_at")
    rows = asked.select(key, "year", at).distinct().join(known.select(key, F.col("year").alias("_y"), "value"), key, "left")
    later, earlier = F.col("_y") >= F.col("_at"), F.col("_y") < F.col("_at")
    ahead = F.min_by("value", F.when(later, F.col("_y")))
    behind = F.max_by("value", F.when(earlier, F.col("_y")))
    return rows.groupBy(key, "year").agg(F.coalesce(F.when(F.max(later), ahead), F.when(F.max(earlier), behind)).alias("value"))


def interpolated(series: DataFrame, key: str) -> DataFrame:
    """Fills null values (key, year, value) on the line between the known years around them."""
    w = Window.partitionBy(key).orderBy("year")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("year", "value"))
    both = series.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(ahead))
    line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * F.try_divide(F.col("year") - F.col("_a.year"), F.col("_b.year") - F.col("_a.year"))
    return both.withColumn("value", F.round(F.coalesce("value", line), 6)).drop("_a", "_b")


def continuations(archive: Archive, words: list[str], n: int) -> DataFrame:
    """(token, ngram, total, share): the vocabulary's n-grams that begin with the last n - 1 of some words, with their shares."""
    start = " ".join(words[-(n - 1) :]) + " "
    found = archive.vocabulary.where((F.col("ngram") == n) & F.col("token").startswith(start))
    total = found.agg(F.sum("total").alias("_t"))
    return found.join(F.broadcast(total)).select("token", "ngram", "total", F.round(F.try_divide("total", "_t"), 6).alias("share"))


def generate(archive: Archive, seed: str, n: int = 3, steps: int = 10, salt: str = "0") -> str:
    """Text that goes on from a seed: each step draws one of the continuations of the last words with the chance of its frequency, by
    a seeded hash; where there is none, shorter contexts are tried. The driver sees one row a step."""
    words = seed.split()
    for step in range(steps):
        row = None
        for k in range(min(n, len(words) + 1), 1, -1):
            u = (F.conv(F.substring(F.md5(F.concat_ws("#", "token", F.lit(f"{salt}{step}"))), 1, 8), 16, 10).cast("double") + 1) / (2.0**32 + 1)
            row = continuations(archive, words, k).where("total > 0").orderBy(-F.ln(u) / F.col("total"), "token").select("token").first()
            if row:
                break
        if not row:
            break
        words.append(row[0].split()[-1])
    return " ".join(words)


def places(words: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(doc_id, place, n): capitalised words that are in a list of places (place)."""
    each = words.select("doc_id", F.explode("words").alias("w")).select("doc_id", F.initcap("w").alias("place"))
    return each.join(gazetteer.select("place").distinct(), "place", "left_semi").groupBy("doc_id", "place").agg(F.count("*").alias("n"))


def per_million(count: Column, population: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(count * 1e6, population), F.lit(0.0)), 6)
