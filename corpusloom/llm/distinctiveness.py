"""How distinctive a term is per record: correspondence-analysis residuals and inverse document frequency, by DataFrame arithmetic.

The records x terms table of counts is never built dense. Its cells are the (record, term, tf) rows; row, column and grand
totals give each cell's expected count e = row * column / grand, its residual (tf - e) / sqrt(e), and the adjusted residual
that also divides by sqrt((1 - row / grand) * (1 - column / grand)). The same rows give tf * ln(records / records with the term).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Runs of letters, digits and underscore of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than needed."""
    return df.limit(rows + 1).count() <= rows


def term_scores(documents: DataFrame, vocabulary: DataFrame, min_records: int = 2, broadcast_rows: int = 400_000) -> DataFrame:
    """(doc_id, token, tf, records, idf_score, residual, adjusted) for every eligible term of every document.

    ``documents`` has doc_id and text, ``vocabulary`` token; other columns are ignored, whatever their names. Eligible are
    the tokens of ``vocabulary`` held by at least ``min_records`` documents. Null texts are no records; empty texts are
    records without terms; equal (doc_id, text) rows count once, and several texts of one doc_id are one record. An empty
    table gives no rows. Row totals count eligible terms only, so that rows and columns add up to the same grand total.

    Texts move once, by doc_id; counting, scoring and picking per document then need no further shuffle. The vocabulary
    is broadcast only if it is counted to hold at most ``broadcast_rows`` tokens, and is joined by shuffle otherwise;
    both ways give the same rows.
    """
    listed = vocabulary.select("token").where("token is not null").distinct()
    small = _small(listed, broadcast_rows)
    hint = F.broadcast if small else (lambda x: x)
    held = documents.select("doc_id", "text").where("text is not null").repartition("doc_id").dropDuplicates(["doc_id", "text"])
    each = held.select("doc_id", F.explode(words(F.col("text"))).alias("token"))
    cells = each.join(hint(listed), "token", "left_semi").groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    columns = cells.groupBy("token").agg(F.count("*").alias("records"), F.sum("tf").alias("_column")).where(F.col("records") >= min_records)
    n = documents.where("text is not null").select("doc_id").distinct().count()
    grand = columns.agg(F.sum("_column").alias("_grand"))
    scored = cells.join(hint(columns), "token").join(F.broadcast(grand))
    rows = scored.groupBy("doc_id").agg(F.sum("tf").alias("_row"))
    full = scored.join(rows, "doc_id")
    expected = F.col("_row") * F.col("_column") / F.col("_grand")
    residual = (F.col("tf") - expected) / F.sqrt(expected)
    margin = F.sqrt((1 - F.col("_row") / F.col("_grand")) * (1 - F.col("_column") / F.col("_grand")))
    return full.select(
        "doc_id", "token", "tf", "records",
        idf_score(n).alias("idf_score"),
        F.round(residual, 9).alias("residual"),
        F.round(F.try_divide(residual, margin), 9).alias("adjusted"),
    )


def idf_score(n: int) -> Column:
    return F.round(F.col("tf") * F.ln(F.lit(float(n)) / F.col("records")), 9)


def top_terms(scores: DataFrame, by: str) -> DataFrame:
    """The highest term of each document by a column of ``term_scores``; on equal scores the smaller token."""
    best = F.min(F.struct((-F.col(by)).alias("s"), F.col("token").alias("token"))).alias("b")
    return scores.groupBy("doc_id").agg(best).select("doc_id", "b.token")
