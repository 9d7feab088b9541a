"""Distinctive terms, frequent terms, term weights and change points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from ..functions.stats import signed_g2, smoothed_g2

#: Words too common to tell texts apart.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before but by can could de der des die do du each el en et for from had has have he her "
    "his how i if im in into is it its la las le les los may more most no not of on one only or other our over que s she should so some such t than that the "
    "their them then there these they this to und under up upon was we were what when which who will with would y you your à été von wurde für daß une"
).split()


def count_words(rows: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, token, n)."""
    return rows.select(*keys, F.explode(words).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def compare(here: DataFrame, there: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, token, a, b, g2): signed log-likelihood of terms counted here (keys, token, n) against there (token, n).

    Two aggregates meet in one join on the token; grand totals are one row (of each key), broadcast.
    """
    keys = list(keys)
    na = here.groupBy(*keys).agg(F.sum("n").alias("na")) if keys else here.agg(F.sum("n").alias("na"))
    nb = there.agg(F.sum("n").alias("nb"))
    both = here.withColumnRenamed("n", "a").join(there.withColumnRenamed("n", "b"), "token", "left").fillna(0, ["b"])
    both = both.join(na, keys) if keys else both.join(F.broadcast(na))
    g2 = signed_g2(F.col("a"), F.col("b"), F.col("na"), F.col("nb"))
    return both.join(F.broadcast(nb)).select(*keys, "token", "a", "b", F.round(g2, 6).alias("g2"))


def winners(compared: DataFrame, first: int = 50, then: int = 20, stop: list[str] = STOP_WORDS, search: list[str] = ()) -> DataFrame:
    """The ``then`` best of the ``first`` by g2, after search terms are gone before and stop words between; fewer may remain."""
    top = compared.where(~F.col("token").isin(list(search))).orderBy(F.desc("g2"), "token").limit(first)
    return top.where(~F.col("token").isin(stop)).orderBy(F.desc("g2"), "token").limit(then)


def winners_by(compared: DataFrame, key: str, first: int = 50, then: int = 20, stop: list[str] = STOP_WORDS) -> DataFrame:
    """The same within each key, by ranked windows with group limits."""
    w = Window.partitionBy(key).orderBy(F.desc("g2"), "token")
    top = compared.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first).where(~F.col("token").isin(stop))
    return top.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= then).drop("_r")


def limited_vocabulary(counts: DataFrame, limit: int, min_count: int, stop: list[str] = STOP_WORDS) -> DataFrame:
    """The most frequent terms (token, n), cut to the limit first, then without stop words and rare ones."""
    return counts.orderBy(F.desc("n"), "token").limit(limit).where(~F.col("token").isin(stop) & (F.col("n") >= min_count))


def tf_l2(counts: DataFrame, doc: str) -> DataFrame:
    """(doc, token, tf): counts scaled so that a doc's squares add up to 1."""
    norm = counts.groupBy(doc).agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("_norm"))
    return counts.join(norm, doc).select(doc, "token", F.round(F.col("n") / F.col("_norm"), 6).alias("tf"))


def tfidf_smooth(counts: DataFrame, doc: str) -> DataFrame:
    """(doc, token, tfidf): count * (ln((1 + docs) / (1 + df)) + 1), scaled the same way."""
    counts = durable(counts)  # four branches read them, and they come from whole texts
    docs = counts.select(doc).distinct().agg(F.count("*").alias("_docs"))
    df = counts.groupBy("token").agg(F.count("*").alias("_df"))
    idf = F.ln((F.col("_docs") + 1) / (F.col("_df") + 1)) + 1
    weighed = counts.join(df, "token").join(F.broadcast(docs)).withColumn("_w", F.col("n") * idf)
    norm = weighed.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return weighed.join(norm, doc).select(doc, "token", F.round(F.col("_w") / F.col("_norm"), 6).alias("tfidf"))


def change_points(series: DataFrame, keys: list[str], half: int = 4) -> DataFrame:
    """(keys, year, before, after, dunning) for each year of a dense series (keys, year, cnt, total) with full windows on both sides:
    the smoothed log-likelihood of the ``half`` years before the pivot against those after it, positive where the term rises."""
    w = Window.partitionBy(*keys).orderBy("year")
    left, right = w.rangeBetween(-half, -1), w.rangeBetween(1, half)
    sums = series.select(
        *keys, "year", F.sum("cnt").over(left).alias("before"), F.sum("cnt").over(right).alias("after"), F.sum("total").over(left).alias("t1"), F.sum("total").over(right).alias("t2"),
        F.count("*").over(left).alias("n1"), F.count("*").over(right).alias("n2"),
    ).where((F.col("n1") == half) & (F.col("n2") == half) & (F.col("t1") > 0) & (F.col("t2") > 0))
    g2 = smoothed_g2(F.col("before"), F.col("after"), F.col("t1"), F.col("t2"))
    return sums.select(*keys, "year", "before", "after", F.round(g2, 6).alias("dunning"))


def adoption(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, adopted, rise, ended, fall): the year of the strongest rise and of the strongest fall; earliest on a tie."""
    high, low = F.max(F.struct("dunning", (-F.col("year")).alias("y"))), F.min(F.struct("dunning", "year"))
    best = points.groupBy(*keys).agg(high.alias("h"), low.alias("l"))
    return best.select(*keys, (-F.col("h.y")).alias("adopted"), F.col("h.dunning").alias("rise"), F.col("l.year").alias("ended"), F.col("l.dunning").alias("fall"))
