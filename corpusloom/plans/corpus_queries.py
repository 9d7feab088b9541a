"""Corpus-building queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CONTRACTIONS, expand_contractions, ngrams, tokens
from ..operators import corpus as co
from ..operators.archive import Archive
from ..operators.timestamps import epoch_seconds
from ..session import durable
from .common import BASE, quoted


def text_postings_docs(spark: SparkSession, d: str) -> DataFrame:
    return co.text_postings(Archive(spark, d))


def text_postings_sections(spark: SparkSession, d: str) -> DataFrame:
    return co.section_postings(Archive(spark, d))


def section_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return co.section_postings(Archive(spark, d), 2).groupBy("token").agg(F.sum("tf").alias("n"))


def section_token_ranges(spark: SparkSession, d: str) -> DataFrame:
    return co.section_offsets(Archive(spark, d))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return co.vocabulary(Archive(spark, d), 2, 1)


def trigram_counts_min5(spark: SparkSession, d: str) -> DataFrame:
    return co.vocabulary(Archive(spark, d), 3, 5)


def five_gram_counts_min5(spark: SparkSession, d: str) -> DataFrame:
    return co.vocabulary(Archive(spark, d), 5, 5)


def unigram_validity(spark: SparkSession, d: str) -> DataFrame:
    return durable(co.vocabulary(Archive(spark, d), 1, 1)).select("token", co.valid_unigram(F.col("token")).alias("valid"))


def apriori_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return co.apriori(Archive(spark, d), 2, 5)


def apriori_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return co.apriori(Archive(spark, d), 3, 5)


def dense_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the docs in order of year, then tid."""
    return co.numbered(Archive(spark, d).docs.select("tid", "year"), ["year", "tid"], "new_id")


def section_map(spark: SparkSession, d: str) -> DataFrame:
    """The running number of each doc's first section, by stated token counts in sections of 200."""
    docs = Archive(spark, d).docs.select("id", "no_tokens").withColumn("n_sections", F.ceil(F.coalesce("no_tokens", F.lit(0)) / 200.0))
    return co.numbered(docs, ["id"], "first_section", F.col("n_sections")).select("id", "n_sections", "first_section")


def doc_admission(spark: SparkSession, d: str) -> DataFrame:
    return co.admitted(Archive(spark, d), ["deposition"]).select("id", "tid", "year")


def eav_rows(spark: SparkSession, d: str) -> DataFrame:
    return co.to_eav(Archive(spark, d))


def eav_pivot(spark: SparkSession, d: str) -> DataFrame:
    return co.from_eav(co.to_eav(Archive(spark, d)))


def contraction_expansion(spark: SparkSession, d: str) -> DataFrame:
    return Archive(spark, d).raw("documents").where("text like '%''%'").select("doc_id", F.md5(expand_contractions(F.lower("text"))).alias("expanded"))


def token_reversal(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary with reversed tokens and the hashes that name a term's place."""
    return Archive(spark, d).vocabulary.select("ngram", "token", F.reverse("token").alias("token_reversed"), F.sha2("token", 256).alias("sha"), F.md5("token").alias("md5"))


def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    return Archive(spark, d).raw("documents").select("doc_id", F.octet_length("text").alias("n_bytes"), F.length("text").alias("n_characters"))


def text_slices(spark: SparkSession, d: str) -> DataFrame:
    """A range of each text by the offsets of its second section of 100 characters."""
    return Archive(spark, d).raw("documents").where(F.length("text") > 100).select("doc_id", F.substring("text", 101, 100).alias("slice"))


def timestamps_to_dates(spark: SparkSession, d: str) -> DataFrame:
    """Date and year of every count since 1970, of whatever unit, moved on by six hours. The unit is the one that gives the doc's year in
    its collection's home zone (UTC where that isn't known); a count that no unit brings into that year gives no row."""
    a = Archive(spark, d)
    zones = F.broadcast(a.raw("collections").select("collection_id", "home_zone"))
    docs = a.docs_of("id", "timestamp", "year", "collection_id").where("timestamp is not null").join(zones, "collection_id", "left")
    seconds = epoch_seconds(F.col("timestamp"), F.col("year"), F.coalesce("home_zone", F.lit("UTC")))
    moved = F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, s + 21600)")
    rows = docs.select("id", seconds.alias("s")).where("s is not null").select("id", moved.alias("t"))
    return rows.select("id", F.year("t").alias("y"), F.date_format("t", "yyyy-MM-dd").alias("day"))


def token_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Stated token counts, filled in from the text where they are missing."""
    a = Archive(spark, d)
    counted = a.words.select(F.col("doc_id").alias("id"), F.size("words").alias("counted"))
    return a.docs_of("id", "no_tokens").join(counted, "id", "left").select("id", F.coalesce("no_tokens", "counted").alias("no_tokens"))


def vocabulary_union(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary with terms added."""
    a = Archive(spark, d)
    added = spark.createDataFrame([(1, "denialist"), (1, "tobacco"), (2, "compound w")], "ngram int, token string")
    return a.vocabulary.select("ngram", "token").union(added).distinct()


def collection_short_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    for word in ("Collection", "Records", "(DTTR)"):
        name = F.replace(name, F.lit(word), F.lit(""))
    return Archive(spark, d).raw("collections").select("collection_id", F.trim(F.replace(name, F.lit("&"), F.lit("and"))).alias("short_name"))


def latest_events(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user: rows replaced by key."""
    return co.latest(Archive(spark, d).raw("events").select("user_id", "event_id", "event_type", "value"), "user_id", ["event_id"])


def nation_long(spark: SparkSession, d: str) -> DataFrame:
    """Wide columns to rows."""
    wide = Archive(spark, d).raw("nation").select("n_name", F.col("n_nationkey").cast("bigint").alias("nation"), F.col("n_regionkey").cast("bigint").alias("region"))
    return wide.unpivot(["n_name"], ["nation", "region"], "field", "number")


def title_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """n-grams of titles."""
    each = Archive(spark, d).docs.where("title is not null").select(F.explode(ngrams(tokens(F.col("title")), 3)).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    text_postings_docs, text_postings_sections, section_bigrams, section_token_ranges, bigram_counts, trigram_counts_min5, five_gram_counts_min5,
    unigram_validity, apriori_bigrams, apriori_trigrams, dense_doc_ids, section_map, doc_admission, eav_rows, eav_pivot, contraction_expansion,
    token_reversal, text_lengths, text_slices, timestamps_to_dates, token_backfill, vocabulary_union, collection_short_names, latest_events, nation_long, title_trigrams,
)}


def _runs(n: int, words: str = "words") -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i+{n - 1}], ' '))"


_NGRAM = {n: f"n{n} as (select token, count(*) as n from (select unnest({_runs(n)}) as token from w) group by token)" for n in (1, 2, 3, 5)}
_SECTIONS = "s as (select doc_id, cast(i as integer) as section, words[i*200+1:(i+1)*200] as words from w, unnest(range(0, cast(ceil(len(words) / 200.0) as bigint))) as u(i))"
_VALID = f"(length(token) > 1 and token not in ({quoted(co.INVALID_SHORT_WORDS)}) and token not like '%-%' and token not like '0%' and not regexp_matches(token, '^[0-9]{{5,}}[a-zA-Z]+') and coalesce(try_cast(case when regexp_matches(token, '^[0-9]{{1,9}}$') then token end as bigint) <= 3000, true) and not regexp_matches(token, '^[0-9]{{10,}}$'))"
_A1 = f"a1 as (select token from n1 where {_VALID} or regexp_matches(token, '^[0-9ai]$'))"
_A2 = "a2 as (select token, n from n2 where n >= 5 and not regexp_matches(token, '^[0-9]+ [0-9]+[a-z]*') and split_part(token, ' ', 1) in (select token from a1) and split_part(token, ' ', 2) in (select token from a1))"
_EAV = """
    eav as (select id, 3 as itag, title as value from d union all select id, 4, date_orig from d union all select id, 100, cast(pages as varchar) from d
        union all select distinct doc_id, 5, author from authors where trim(author) <> '' union all select doc_id, 29, doc_type from ty
        union all select distinct doc_id, 49, recipient from recipients where trim(recipient) <> ''), e as (select id, cast(itag as integer) as itag, value from eav where value is not null)
"""
_CONTRACTED = "lower(text)"
for _k, _v in CONTRACTIONS.items():
    _CONTRACTED = f"replace({_CONTRACTED}, {quoted([_k])}, {quoted([_v])})"

SQL = {
    "text_postings_docs": f"{BASE} select doc_id, token, count(*) as tf from (select doc_id, unnest(words) as token from w) group by all",
    "text_postings_sections": f"{BASE}, {_SECTIONS} select doc_id, section, token, count(*) as tf from (select doc_id, section, unnest(words) as token from s) group by all",
    "section_bigrams": f"{BASE}, {_SECTIONS} select token, count(*) as n from (select unnest({_runs(2)}) as token from s) group by token",
    "section_token_ranges": f"{BASE} select doc_id, cast(i as integer) as section, cast(i * 200 as integer) as first_token, cast(least(len(words), (i + 1) * 200) - 1 as integer) as last_token from w, unnest(range(0, cast(ceil(len(words) / 200.0) as bigint))) as u(i)",
    "bigram_counts": f"{BASE}, {_NGRAM[2]} select * from n2",
    "trigram_counts_min5": f"{BASE}, {_NGRAM[3]} select * from n3 where n >= 5",
    "five_gram_counts_min5": f"{BASE}, {_NGRAM[5]} select * from n5 where n >= 5",
    "unigram_validity": f"{BASE}, {_NGRAM[1]} select token, {_VALID} as valid from n1",
    "apriori_bigrams": f"{BASE}, {_NGRAM[1]}, {_NGRAM[2]}, {_A1}, {_A2} select * from a2",
    "apriori_trigrams": f"{BASE}, {_NGRAM[1]}, {_NGRAM[2]}, {_NGRAM[3]}, {_A1}, {_A2} select token, n from n3 where n >= 5 and not regexp_matches(token, '^[0-9]+ [0-9]+[a-z]*') and regexp_extract(token, '^[^ ]+ [^ ]+') in (select token from a2) and regexp_extract(token, '[^ ]+ [^ ]+$') in (select token from a2)",
    "dense_doc_ids": f"{BASE} select tid, year, row_number() over (order by year, tid) - 1 as new_id from d",
    "section_map": f"{BASE}, n as (select id, cast(ceil(coalesce(no_tokens, 0) / 200.0) as bigint) as n_sections from d) select id, n_sections, cast(coalesce(sum(n_sections) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_section from n",
    "doc_admission": f"{BASE} select id, tid, year from d where timestamp is not null and year >= 1901 and coalesce(trim(date_orig), '') <> '1900' and collection_id in (select collection_id from collections) and id not in (select doc_id from ty where doc_type = 'deposition') and id in (select doc_id from documents where text is not null)",
    "eav_rows": f"{BASE}, {_EAV} select * from e",
    "eav_pivot": f"{BASE}, {_EAV} select id, min(value) filter (where itag = 3) as title, min(cast(case when itag = 100 then value end as integer)) as pages, count(distinct value) filter (where itag = 5) as n_authors, count(distinct value) filter (where itag = 29) as n_types, count(distinct value) filter (where itag = 49) as n_recipients, round(1.0 / nullif(count(distinct value) filter (where itag = 29), 0), 6) as type_weight from e group by id",
    "contraction_expansion": f"select doc_id, md5(lower({_CONTRACTED})) as expanded from documents where text like '%''%'",
    "token_reversal": f"{BASE} select ngram, token, reverse(token) as token_reversed, sha256(token) as sha, md5(token) as md5 from v",
    "text_lengths": "select doc_id, cast(strlen(text) as integer) as n_bytes, cast(length(text) as integer) as n_characters from documents",
    "text_slices": "select doc_id, substring(text, 101, 100) as slice from documents where length(text) > 100",
    "timestamps_to_dates": f"""{BASE}, z as (select id, year, timestamp as ts, coalesce(home_zone, 'UTC') as zone from d left join collections using (collection_id) where timestamp is not null),
        u as (select id, year, zone, k, cast(floor(ts / n) as bigint) as s from (select *, cast(ts as hugeint) as ts0 from z), (values (1, 1), (2, 1000), (3, 1000000), (4, 1000000000)) as units(k, n)),
        f as (select id, arg_min(s, k) as s from u where s between -5364662400 and 4102444800 and (year is null or year(timezone(zone, to_timestamp(case when s between -5364662400 and 4102444800 then s else 0 end))) = year) group by id),
        t as (select id, timestamp '1970-01-01' + to_seconds(s + 21600) as t from f) select id, cast(year(t) as integer) as y, strftime(t, '%Y-%m-%d') as day from t""",
    "token_backfill": f"{BASE} select id, coalesce(no_tokens, cast(len(words) as integer)) as no_tokens from d left join w on d.id = w.doc_id",
    "vocabulary_union": f"{BASE} select ngram, token from v union select 1, 'denialist' union select 1, 'tobacco' union select 2, 'compound w'",
    "collection_short_names": "select collection_id, trim(replace(replace(replace(replace(name, 'Collection', ''), 'Records', ''), '(DTTR)', ''), '&', 'and')) as short_name from collections",
    "latest_events": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "nation_long": "select n_name, 'nation' as field, cast(n_nationkey as bigint) as number from nation union all select n_name, 'region', cast(n_regionkey as bigint) from nation",
    "title_trigrams": f"{BASE}, tw as (select regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') as words from d where title is not null) select token, count(*) as n from (select unnest({_runs(3)}) as token from tw) group by token",
}
