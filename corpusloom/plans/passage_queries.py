"""Passage and term-statistics queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import highlight
from ..operators import corpus as co
from ..operators import distinctive as di
from ..operators import frequencies as fr
from ..operators import passages as pa
from ..operators.archive import Archive
from ..session import durable
from .common import BASE, quoted
from .corpus_queries import _SECTIONS

PAIR = ["panel", "cigarettes"]


def term_cooccurrence_units(spark: SparkSession, d: str) -> DataFrame:
    """Scanned docs that hold both terms."""
    a = Archive(spark, d)
    return pa.cooccurring(a.raw("postings").where("unit = 'docs'").distinct(), ["unit_id"], ["tobacco", "account"])


def term_cooccurrence_sections(spark: SparkSession, d: str) -> DataFrame:
    return pa.section_hits(Archive(spark, d), PAIR)


def section_islands(spark: SparkSession, d: str) -> DataFrame:
    return pa.islands(pa.section_hits(Archive(spark, d), ["the"]), "doc_id", "section")


def hit_positions(spark: SparkSession, d: str) -> DataFrame:
    return pa.term_matches(Archive(spark, d), "tobacco").select("doc_id", "year", "hit")


def keyword_passages(spark: SparkSession, d: str) -> DataFrame:
    return pa.passages(Archive(spark, d), "panel", ["cigar*"], 200)


def highlighted_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = pa.passages(Archive(spark, d), "panel", ["cigar*"], 200)
    return rows.select("doc_id", "hit", highlight(F.col("passage"), "panel").alias("html"))


def passage_readability(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return pa.readability(pa.passages(a, "panel", [], 200), a.vocabulary.where("ngram = 1"), ["doc_id", "hit"])


def passage_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 3 readable passages a year, by hash order."""
    a = Archive(spark, d)
    found = pa.passages(a, "panel", [], 200)
    good = pa.readability(found, a.vocabulary.where("ngram = 1"), ["doc_id", "hit"]).where("readability > 0.15")
    return pa.quota(found.join(good, ["doc_id", "hit"]), ["year"], ["doc_id", "hit"], 3, "7").select("year", "doc_id", "hit")


def documents_by_year(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    counts = a.texts.groupBy("year").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    return fr.densify(counts, a, ["all"], ["n"]).select("year", "n")


def doc_headers(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return pa.with_authors(a, a.docs)


def frequent_authors(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    rows = a.authors.join(a.doc_years.withColumnRenamed("unit_id", "doc_id"), "doc_id")
    return pa.frequent(rows, "author")


def _counts_by(a: Archive, docs: DataFrame, keys: list[str]) -> DataFrame:
    return di.count_words(a.words.join(docs, "doc_id"), keys)


def distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    """What sets the texts since 1990 apart from the earlier ones."""
    a = Archive(spark, d)
    years = a.doc_years.withColumnRenamed("unit_id", "doc_id")
    return di.winners(di.compare(_counts_by(a, years.where("year >= 1990"), []), _counts_by(a, years.where("year < 1990"), [])))


def all_term_comparison(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    years = a.doc_years.withColumnRenamed("unit_id", "doc_id")
    return di.compare(_counts_by(a, years.where("year >= 1990"), []), _counts_by(a, years.where("year < 1990"), []))


def distinctive_terms_by_collection(spark: SparkSession, d: str) -> DataFrame:
    """Each collection against all texts."""
    a = Archive(spark, d)
    docs = a.raw("docs").select(F.col("id").alias("doc_id"), "collection_id").distinct()
    here = _counts_by(a, docs, ["collection_id"])
    return di.winners_by(di.compare(here, here.groupBy("token").agg(F.sum("n").alias("n")), ["collection_id"]), "collection_id")


def distinctive_term_years(spark: SparkSession, d: str) -> DataFrame:
    """In how many texts of each year the distinctive terms occur."""
    a = Archive(spark, d)
    best = distinctive_terms(spark, d).select("token")
    each = a.words.select("doc_id", F.explode(F.array_distinct("words")).alias("token")).join(F.broadcast(best), "token", "left_semi")
    return each.join(a.doc_years.withColumnRenamed("unit_id", "doc_id"), "doc_id").groupBy("token", "year").agg(F.count("*").alias("df"))


def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    return di.limited_vocabulary(di.count_words(Archive(spark, d).words, []), 2000, 5)


def doc_set_totals(spark: SparkSession, d: str) -> DataFrame:
    """Term totals of the texts of one collection, raw and as shares of each text."""
    a = Archive(spark, d)
    rows = a.words.join(a.raw("docs").where("collection_id = 101").select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    counts = di.count_words(rows, ["doc_id"]).join(rows.select("doc_id", F.size("words").alias("len")), "doc_id")
    return counts.groupBy("token").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") / F.col("len")), 6).alias("tf"))


def tf_l2(spark: SparkSession, d: str) -> DataFrame:
    return di.tf_l2(di.count_words(Archive(spark, d).words, ["doc_id"]), "doc_id")


def tfidf_smooth(spark: SparkSession, d: str) -> DataFrame:
    return di.tfidf_smooth(di.count_words(Archive(spark, d).words, ["doc_id"]), "doc_id")


def _policy(a: Archive) -> DataFrame:
    """(collection_id, token, year, cnt, total) of short docs: every n-gram above the total of which no word is a single character or a
    number, in every collection and year, 0 where there was none."""
    sound = "not exists(split(token, ' '), x -> length(x) < 2 or x rlike '^[0-9]+$')"
    terms = durable(a.vocabulary.where(f"total > 100 and {sound}").select("token").distinct())
    short = a.docs.where("coalesce(pages, 0) <= 5 and year is not null").select(F.col("id").alias("unit_id"), "collection_id", "year").distinct()
    rows = a.raw("postings").where("unit = 'docs'").join(short, "unit_id", "left_semi").repartition("unit_id").distinct().join(short, "unit_id")
    named = rows.join(terms.select("token", F.col("token").alias("term")), "token", "left")
    # one pass over the postings for both: what isn't a term counts under null
    counts = durable(named.groupBy("collection_id", "year", "term").agg(F.sum("tf").alias("cnt"), F.sum(F.when(F.col("ngram") == 1, F.col("tf"))).alias("total")))
    totals = counts.groupBy("collection_id", "year").agg(F.sum("total").alias("total"))
    years = short.select("collection_id").distinct().join(F.broadcast(fr.years_of(a))).join(totals, ["collection_id", "year"], "left").fillna(0, ["total"])
    dated = years.groupBy("collection_id").agg(F.collect_list(F.struct("year", "total")).alias("years"))
    held = counts.where("term is not null").groupBy("collection_id", F.col("term").alias("token")).agg(F.map_from_entries(F.collect_list(F.struct("year", "cnt"))).alias("held"))
    # the years are unfolded where a term's series is kept together, so the dense series is never moved
    grid = terms.join(F.broadcast(dated)).join(held, ["collection_id", "token"], "left").repartition("collection_id", "token")
    each = grid.select("collection_id", "token", "held", F.explode("years").alias("y"))
    return each.select("collection_id", "token", "y.year", F.coalesce(F.try_element_at("held", F.col("y.year")), F.lit(0)).alias("cnt"), "y.total")


def policy_changepoints(spark: SparkSession, d: str) -> DataFrame:
    """Four years before against four years after, for every collection, year and frequent n-gram of short docs."""
    return di.change_points(_policy(Archive(spark, d)), ["collection_id", "token"])


def policy_adoptions(spark: SparkSession, d: str) -> DataFrame:
    """The year of the strongest rise and of the strongest fall of every frequent n-gram in every collection."""
    return di.adoption(policy_changepoints(spark, d), ["collection_id", "token"])


QUERIES = {f.__name__: f for f in (
    term_cooccurrence_units, term_cooccurrence_sections, section_islands, hit_positions, keyword_passages, highlighted_passages, passage_readability,
    passage_sample, documents_by_year, doc_headers, frequent_authors, distinctive_terms, all_term_comparison, distinctive_terms_by_collection,
    distinctive_term_years, frequent_terms, doc_set_totals, tf_l2, tfidf_smooth, policy_changepoints, policy_adoptions,
)}

_S = quoted(di.STOP_WORDS)
_G2 = """case when a = 0 or b = 0 then 0.0 else (case when a < na * (a + b) / (na + nb) then -1 else 1 end)
    * 2 * (a * ln(a / (na * (a + b) / (na + nb))) + b * ln(b / (nb * (a + b) / (na + nb)))) end"""
_COMPARE = f"""
    wy as (select doc_id, year, unnest(words) as token from w join y on w.doc_id = y.unit_id),
    c as (select token, (count(*) filter (where year >= 1990))::double as a, (count(*) filter (where year < 1990))::double as b from wy group by token),
    t as (select sum(a) as na, sum(b) as nb from c),
    g as (select token, cast(a as bigint) as a, cast(b as bigint) as b, round({_G2}, 6) as g2 from c, t where a > 0),
    best as (select * from (select * from g order by g2 desc, token limit 50) where token not in ({_S}) order by g2 desc, token limit 20)
"""
# hits: the lower-cased text cut at the term; a hit starts where the pieces before it and the terms between them end
_HITS = """
    lt as (select doc_id, year, lower(text) as t from tx),
    pc as (select doc_id, year, t, string_split(t, '{term}') as parts from lt where contains(t, '{term}') and regexp_matches(t, '{regex}')),
    hits as (select doc_id, year, t, cast(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * {size} as integer) as hit from pc, unnest(range(1, len(parts))) as u(i))
"""
_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_PANEL = _HITS.format(term="panel", size=5, regex=f"{_B}panel{_E}")
_WIN = "trim(regexp_extract(substring(t, greatest(0, hit - 100) + 1, hit + 100 - greatest(0, hit - 100)), '(?s)\\s.+\\s'))"
_PASSAGES = f"{_PANEL}, pas as (select * from (select doc_id, year, hit, {_WIN} as passage from hits) where passage <> '' and regexp_matches(passage, '{_B}panel{_E}'))"
_CIGAR = _PASSAGES.replace(f"regexp_matches(t, '{_B}panel{_E}')", f"regexp_matches(t, '{_B}panel{_E}') and regexp_matches(t, '{_B}cigar')").replace(f"regexp_matches(passage, '{_B}panel{_E}')", f"regexp_matches(passage, '{_B}panel{_E}') and regexp_matches(passage, '{_B}cigar')")
_READ = "rd as (select doc_id, hit, round(avg(case when token in (select token from v where ngram = 1) then 1 else 0 end), 6) as readability from (select doc_id, hit, unnest(regexp_split_to_array(trim(passage), '\\s+')) as token from pas) group by all)"
_POLICY = f"""
    tm as (select distinct token from v where total > 100 and not regexp_matches(token, '(^| )([^ ]|[0-9]+)($| )')),
    sh as (select distinct id as unit_id, collection_id, year from d where coalesce(pages, 0) <= 5 and year is not null),
    c as (select collection_id, token, year, sum(tf) as cnt from p join sh using (unit_id) where unit = 'docs' and token in (select token from tm) group by all),
    st as (select collection_id, year, sum(total) as total from tot join sh using (unit_id) group by all),
    se as (select collection_id, token, year, coalesce(cnt, 0) as cnt, coalesce(total, 0) as total
        from (select collection_id, token, cal.year from (select distinct collection_id from sh) cross join tm cross join cal) left join c using (collection_id, token, year) left join st using (collection_id, year)),
    ws as (select collection_id, token, year, sum(cnt) over l as b4, sum(cnt) over r as af, (sum(total) over l)::double as t1, (sum(total) over r)::double as t2, count(*) over l as n1, count(*) over r as n2 from se
        window l as (partition by collection_id, token order by year range between 4 preceding and 1 preceding), r as (partition by collection_id, token order by year range between 1 following and 4 following)),
    ab as (select *, (b4 + 1)::double as a, (af + 1)::double as b from ws where n1 = 4 and n2 = 4 and t1 > 0 and t2 > 0),
    pts as (select collection_id, token, year, cast(b4 as bigint) as before, cast(af as bigint) as after, round((case when a > t1 * (a + b) / (t1 + t2) then -1 else 1 end)
        * 2 * (a * ln(a / (t1 * (a + b) / (t1 + t2))) + b * ln(b / (t2 * (a + b) / (t1 + t2)))), 6) as dunning from ab)
"""

SQL = {
    "term_cooccurrence_units": f"{BASE} select unit_id from p where unit = 'docs' and token in ('tobacco', 'account') group by unit_id having count(distinct token) = 2",
    "term_cooccurrence_sections": f"{BASE}, {_SECTIONS} select doc_id, section from s where list_contains(words, 'panel') and list_contains(words, 'cigarettes')",
    "section_islands": f"{BASE}, {_SECTIONS}, h as (select doc_id, section, section - row_number() over (partition by doc_id order by section) as run from s where list_contains(words, 'the')) select doc_id, min(section) as start, max(section) as stop, count(*) as n from h group by doc_id, run",
    "hit_positions": f"{BASE}, {_HITS.format(term='tobacco', size=7, regex=f'{_B}tobacco{_E}')} select doc_id, year, hit from hits",
    "keyword_passages": f"{BASE}, {_CIGAR} select * from pas",
    "highlighted_passages": f"{BASE}, {_CIGAR} select doc_id, hit, replace(passage, 'panel', '<b>panel</b>') as html from pas",
    "passage_readability": f"{BASE}, {_PASSAGES}, {_READ} select * from rd",
    "passage_sample": f"{BASE}, {_PASSAGES}, {_READ} select year, doc_id, hit from pas join rd using (doc_id, hit) where readability > 0.15 qualify row_number() over (partition by year order by md5(doc_id || '#' || hit || '#7'), doc_id, hit) <= 3",
    "documents_by_year": f"{BASE} select cal.year, count(tx.doc_id) as n from cal left join tx on tx.year = cal.year group by cal.year",
    "doc_headers": f"{BASE}, au as (select doc_id, string_agg(author, ', ' order by author) as author from (select distinct * from authors where trim(author) <> '') group by doc_id), f as (select id, coalesce(title, '') as title, coalesce(author, '') as author from d left join au on d.id = au.doc_id) select id, case when length(title) > 50 then substring(title, 1, 50) || '...' else title end as title, case when length(author) > 50 then substring(author, 1, 50) || '...' else author end as author from f",
    "frequent_authors": f"{BASE}, c as (select author, year, count(*) as n from (select distinct * from authors where trim(author) <> '') a join y on a.doc_id = y.unit_id group by all) select * from c where author in (select author from c group by author order by sum(n) desc, author limit 10)",
    "distinctive_terms": f"{BASE}, {_COMPARE} select token, a, b, g2 from best",
    "all_term_comparison": f"{BASE}, {_COMPARE} select token, a, b, g2 from g",
    "distinctive_terms_by_collection": f"""{BASE}, wc as (select collection_id, unnest(words) as token from w join (select distinct id, collection_id from docs) x on w.doc_id = x.id),
        h as (select collection_id, token, count(*)::double as a from wc group by all), al as (select token, sum(a) as b from h group by token),
        t as (select collection_id, sum(a) as na from h group by all), n as (select sum(a) as nb from h),
        g as (select collection_id, token, cast(a as bigint) as a, cast(b as bigint) as b, round({_G2}, 6) as g2 from h join al using (token) join t using (collection_id), n),
        f as (select * from g qualify row_number() over (partition by collection_id order by g2 desc, token) <= 50)
        select * from f where token not in ({_S}) qualify row_number() over (partition by collection_id order by g2 desc, token) <= 20""",
    "distinctive_term_years": f"{BASE}, {_COMPARE} select token, year, count(*) as df from (select distinct doc_id, year, token from wy) where token in (select token from best) group by all",
    "frequent_terms": f"{BASE} select * from (select token, count(*) as n from (select unnest(words) as token from w) group by token order by n desc, token limit 2000) where token not in ({_S}) and n >= 5",
    "doc_set_totals": f"{BASE}, r as (select * from w where doc_id in (select id from docs where collection_id = 101)), c as (select doc_id, len(words) as len, unnest(words) as token from r) select token, cast(sum(n) as bigint) as n, round(sum(n / len), 6) as tf from (select doc_id, token, len, count(*) as n from c group by all) group by token",
    "tf_l2": f"{BASE}, c as (select doc_id, token, count(*) as n from (select doc_id, unnest(words) as token from w) group by all) select doc_id, token, round(n / sqrt(sum((n * n)::double) over (partition by doc_id)), 6) as tf from c",
    "tfidf_smooth": f"{BASE}, c as (select doc_id, token, count(*) as n from (select doc_id, unnest(words) as token from w) group by all), e as (select doc_id, token, n * (ln((1 + (select count(distinct doc_id) from c)) / (1 + count(*) over (partition by token))::double) + 1) as w from c) select doc_id, token, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as tfidf from e",
    "policy_changepoints": f"{BASE}, {_POLICY} select * from pts",
    "policy_adoptions": f"{BASE}, {_POLICY} select collection_id, token, arg_max(year, (dunning, -year)) as adopted, max(dunning) as rise, arg_min(year, (dunning, year)) as ended, min(dunning) as fall from pts group by collection_id, token",
}
