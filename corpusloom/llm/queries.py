"""Queries of the text problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, table
from .bpe import encode_texts
from .distinctiveness import term_scores, top_terms
from .leakage import leaked_items
from .lookalikes import alike_pairs
from .mojibake import archive_values, decode_values
from .name_variants import variant_pairs
from .scan_repair import damaged_lines, repaired_paragraphs
from .term_frequency import count_terms, mark_terms


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and name with its original, null where bytes are lost for good."""
    return decode_values(archive_values(*(table(spark, sf_dir, t) for t in ("docs", "authors", "recipients"))))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).where("damaged").select("field", "doc_id", "value")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_lines(table(spark, sf_dir, "ocr_pages"))


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of every page."""
    return repaired_paragraphs(table(spark, sf_dir, "ocr_pages"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "tokens").where("ngram = 1"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_terms(_scores(spark, sf_dir), "idf_score")


def p5_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of each document with the largest adjusted residual."""
    return top_terms(_scores(spark, sf_dir), "adjusted")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings; the values that are cases of p1 are left out."""
    names = p1_restored(spark, sf_dir).where("field <> 'docs.title' and not damaged")
    return variant_pairs(durable(names.select(F.col("value").alias("name"))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_counts(spark, sf_dir).where("mark is not null").select("token", "ngram", "mark")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_terms(table(spark, sf_dir, "tokens"), table(spark, sf_dir, "postings"))
    return mark_terms(counts, table(spark, sf_dir, "docs").select("id").distinct().count())


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p3_found, p3_text, p5_found, p5_residuals, p6_found, p7_found, p7_counts, p8_ids, p9_found, p10_found)}

_P5 = r"""
    with d as (select distinct doc_id, text from documents where text is not null),
    v as (select distinct token from tokens where ngram = 1 and token is not null),
    w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as token from d),
    cells as (select doc_id, token, count(*) as tf from w semi join v using (token) group by all),
    cols as (select token, count(*) as df, sum(tf) as col from cells group by token having count(*) >= 2),
    c as (select cells.*, df, col, sum(tf) over (partition by doc_id) as r, (select sum(col) from cols) as g from cells join cols using (token)),
    n as (select count(distinct doc_id) as n from d)
"""
_P7 = """
    with r as (select token, ngram, sum(total) as total from (select distinct * from tokens) group by all),
    p as (select token, ngram, count(distinct unit_id) as records from postings where unit = 'docs' group by all),
    c as (select r.token, r.ngram, cast(coalesce(total, 0) as bigint) as total, coalesce(records, 0) as records
          from r left join p on r.token is not distinct from p.token and r.ngram = p.ngram),
    m as (select *, case when records > (select count(distinct id) from docs) / 20.0 then 'common' when total < 5 then 'rare' end as mark from c)
"""
SQL = {
    "p5_found": _P5 + """
        select doc_id, token from (select doc_id, token, row_number() over (partition by doc_id order by round(tf * ln(n::double / df), 9) desc, token) as k from c, n) where k = 1
    """,
    "p5_residuals": _P5 + """
        , e as (select doc_id, token, tf, r * col / g as e, sqrt((1 - r / g) * (1 - col / g)) as m from c)
        select doc_id, token from (select doc_id, token, row_number() over (partition by doc_id order by round((tf - e) / sqrt(e) / m, 9) desc, token) as k from e) where k = 1
    """,
    "p7_found": _P7 + "select token, ngram, mark from m where mark is not null",
    "p7_counts": _P7 + "select token, ngram, total, records, mark from m",
}
