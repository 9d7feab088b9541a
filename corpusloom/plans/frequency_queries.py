"""Frequency queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import Archive
from ..operators.filters import Filters, eligible, page_predicate, weighted_by_type
from ..operators import frequencies as fr
from .common import BASE, GROUPS, REGIONS, TERMS, quoted
from .data_cleaning import SQL as CLEAN

FILTERS = Filters(doc_types=["letter", "memo"], collections=[101, 102, 105], availability=["public", "no restrictions"], max_pages=20)


def token_year_counts(spark: SparkSession, d: str) -> DataFrame:
    """Yearly counts, totals and relative frequencies of some terms, every year present."""
    return fr.token_series(Archive(spark, d), TERMS)


def unit_totals_docs(spark: SparkSession, d: str) -> DataFrame:
    return fr.unit_totals(Archive(spark, d), "docs")


def unit_totals_sections(spark: SparkSession, d: str) -> DataFrame:
    return fr.unit_totals(Archive(spark, d), "sections")


def collection_totals(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.totals_by(a, fr.collection_dim(a, REGIONS), "collection")


def doc_type_totals(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.totals_by(a, fr.type_dim(a), "doc_type")


def filter_combined_docs(spark: SparkSession, d: str) -> DataFrame:
    return eligible(Archive(spark, d), FILTERS).select("id", "year", "collection_id", "pages")


def filter_combined_counts(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.year_counts(a, TERMS, eligible(a, FILTERS))


def page_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = Archive(spark, d).docs
    named = [docs.where(page_predicate(n)).groupBy("year").agg(F.count("*").alias("n")).select(F.lit(n).alias("filter"), "year", "n") for n in ("min_5", "max_5")]
    return named[0].unionByName(named[1])


def weighted_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Term occurrences in letters by year, weighted by the share of the type in the doc."""
    a = Archive(spark, d)
    w = weighted_by_type(a, "letter").withColumnRenamed("doc_id", "unit_id")
    hits = fr.term_vector(a, TERMS).join(w, "unit_id").join(a.doc_years, "unit_id")
    return hits.groupBy("year").agg(F.round(F.sum(F.col("tf") * F.col("weight")), 6).alias("weighted"))


def term_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a term in the docs that hold any of two others."""
    a = Archive(spark, d)
    return fr.year_counts(a, ["tobacco"], eligible(a, Filters(terms=["account", "adjusted"])))


def wildcard_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fr.expand_wildcard(Archive(spark, d), "re*")


def wildcard_suffix(spark: SparkSession, d: str) -> DataFrame:
    return fr.expand_wildcard(Archive(spark, d), "*ed")


def wildcard_bigram(spark: SparkSession, d: str) -> DataFrame:
    return fr.expand_wildcard(Archive(spark, d), "audit o*")


def term_existence(spark: SparkSession, d: str) -> DataFrame:
    return fr.known_terms(Archive(spark, d), [*TERMS, "audit outlet", "no such term", "zzz"])


def concrete_terms(spark: SparkSession, d: str) -> DataFrame:
    """Search terms as the tokens they stand for."""
    return fr.search_terms(Archive(spark, d), ["tobacco", "re*", "audit outlet", "no such term"])


def units_of_terms(spark: SparkSession, d: str) -> DataFrame:
    """Docs that hold a wildcard's tokens, an n-gram, or the words of an n-gram that isn't in the vocabulary."""
    a = Archive(spark, d)
    parts = [fr.term_units(a, t).select(F.lit(t).alias("term"), "unit_id") for t in ("re*", "audit outlet", "tobacco account")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def collection_breakdown_top9(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.breakdown(a, TERMS, fr.collection_dim(a), "collection")


def doctype_breakdown(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.breakdown(a, TERMS, fr.type_dim(a), "doc_type")


def doctype_group_breakdown(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.breakdown(a, TERMS, fr.group_dim(a, GROUPS), "grp", None)


def ngram_query(spark: SparkSession, d: str) -> DataFrame:
    """A whole frequency query: tokens, collections, doc types and groups in one long result."""
    return fr.ngram_result(Archive(spark, d), TERMS, Filters(doc_types=["letter", "report"], max_pages=50), GROUPS)


def reference_series(a: Archive) -> DataFrame:
    """(token, year, ref_cnt, ref_total): the texts of the archive as reference corpus of the scanned docs' postings."""
    each = a.words.join(a.doc_years.withColumnRenamed("unit_id", "doc_id"), "doc_id").select("year", F.explode("words").alias("token"))
    totals = each.groupBy("year").agg(F.count("*").alias("ref_total"))
    return each.where(F.col("token").isin(TERMS)).groupBy("token", "year").agg(F.count("*").alias("ref_cnt")).join(totals, "year")


def zscore_vs_reference(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.z_series(fr.token_series(a, TERMS).drop("freq"), reference_series(a))


def moving_average_series(spark: SparkSession, d: str) -> DataFrame:
    return fr.moving_average(fr.token_series(Archive(spark, d), TERMS), ["token"], "freq", 3).select("token", "year", "smooth")


def padded_reference(spark: SparkSession, d: str) -> DataFrame:
    """The reference counts with years that lack one filled by the last known."""
    a = Archive(spark, d)
    grid = fr.years_of(a).join(reference_series(a).where("token = 'tobacco'"), "year", "left")
    return fr.padded(grid.select(F.lit("tobacco").alias("token"), "year", "ref_cnt"), ["token"], "ref_cnt")


def doc_type_indexes(spark: SparkSession, d: str) -> DataFrame:
    return fr.doc_type_index(Archive(spark, d))


def year_id_ranges(spark: SparkSession, d: str) -> DataFrame:
    return fr.year_ranges(Archive(spark, d))


def year_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Docs by the year whose range of ids they fall in, for every year. Ranges overlap, as some docs came in late."""
    return fr.year_range_counts(Archive(spark, d))


def vector_bag_sum(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return fr.vector_sum(*[fr.term_vector(a, [t]).select("unit_id", "tf") for t in TERMS])


def vector_mask(spark: SparkSession, d: str) -> DataFrame:
    """A term's vector where another term occurs too."""
    a = Archive(spark, d)
    return fr.term_vector(a, ["tobacco"]).join(fr.term_vector(a, ["account"]), "unit_id", "left_semi").select("unit_id", "tf")


def vector_year_ratio(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    one, two = (fr.year_counts(a, [t]).select("year", "cnt") for t in ("account", "tobacco"))
    return fr.vector_ratio(one, two)


def vector_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Sum, number of units and slice of years of each term's vector."""
    a = Archive(spark, d)
    rows = fr.term_vector(a, TERMS).join(a.doc_years, "unit_id")
    return rows.groupBy("token").agg(F.sum("tf").alias("total"), F.count_if(F.col("tf") != 0).alias("nnz"), F.sum(F.when(F.col("year").between(1950, 1959), F.col("tf")).otherwise(0)).alias("fifties"))


def incidence_long(spark: SparkSession, d: str) -> DataFrame:
    """Collection and doc-type incidence of docs, in long form."""
    a = Archive(spark, d)
    c = fr.collection_dim(a, REGIONS).select(F.lit("collection").alias("dim"), F.col("collection").alias("key"), "unit_id")
    return c.unionByName(fr.type_dim(a).select(F.lit("doc_type").alias("dim"), F.col("doc_type").alias("key"), "unit_id"))


def missing_years(spark: SparkSession, d: str) -> DataFrame:
    """Years that a term's cached series lacks."""
    a = Archive(spark, d)
    return fr.years_of(a).exceptAll(fr.year_counts(a, ["invoice"]).select("year"))


QUERIES = {f.__name__: f for f in (
    token_year_counts, unit_totals_docs, unit_totals_sections, collection_totals, doc_type_totals, filter_combined_docs, filter_combined_counts,
    page_filter_counts, weighted_type_counts, term_filtered_counts, wildcard_prefix, wildcard_suffix, wildcard_bigram, term_existence, concrete_terms, units_of_terms,
    collection_breakdown_top9, doctype_breakdown, doctype_group_breakdown, ngram_query, zscore_vs_reference, moving_average_series,
    padded_reference, doc_type_indexes, year_id_ranges, year_range_join, vector_bag_sum, vector_mask, vector_year_ratio, vector_statistics,
    incidence_long, missing_years,
)}

_T = quoted(TERMS)
_HITS = f"h as (select token, unit_id, tf from p where unit = 'docs' and token in ({_T}))"
_SERIES = f"""
    {_HITS},
    c as (select token, year, sum(tf) as cnt from h join y using (unit_id) group by all),
    ytot as (select year, sum(total) as total from tot join y using (unit_id) group by year),
    series as (select k.token, cal.year, cast(coalesce(cnt, 0) as bigint) as cnt, cast(coalesce(total, 0) as bigint) as total
        from (select distinct token from c) k cross join cal left join c on c.token = k.token and c.year = cal.year left join ytot on ytot.year = cal.year),
    ser as (select *, round(cnt / (total + 1), 9) as freq from series)
"""
_REGIONS = " union all ".join(f"select distinct id, '{n}' from docs where collection_id in ({quoted(ids)})" for n, ids in REGIONS.items())
_GROUPS = "select * from (values " + ", ".join(f"('{t}', '{g}')" for g, ts in GROUPS.items() for t in ts) + ") as g(doc_type, grp)"
_DIMS = f"""
    co as (select distinct id as unit_id, code as collection from docs join collections using (collection_id)),
    cr as (select * from co union all {_REGIONS}),
    td as (select doc_id as unit_id, doc_type from ty),
    gd as (select distinct unit_id, grp from td join ({_GROUPS}) using (doc_type))
"""
_LABELS = f"labels as ({CLEAN['p2_found']})"
_ELIGIBLE = """
    e as (select * from d where collection_id in (101, 102, 105) and coalesce(pages, 0) <= 20
        and id in (select doc_id from ty where doc_type in ('letter', 'memo')) and id in (select id from labels where value in ('public', 'no restrictions')))
"""


def _breakdown(dim: str, key: str, top: int | None, name: str = "b", among: str = "") -> str:
    limit = f"where {key} in (select {key} from {name}_s group by {key} order by sum(cnt) desc, {key} limit {top})" if top else ""
    source = f"(select * from {dim} where unit_id in (select id from {among}))" if among else dim
    return f"""
        {name}_s as (select {key}, year, cast(sum(tf) as bigint) as cnt from (select unit_id, sum(tf) as tf from h group by unit_id) join {source} using (unit_id) join y using (unit_id) group by all),
        {name}_t as (select {key}, year, cast(sum(total) as bigint) as total from tot join {source} using (unit_id) join y using (unit_id) group by all),
        {name} as (select {key}, year, cnt, coalesce(total, 0) as total, round(coalesce(cnt / nullif(total, 0), 0), 9) as freq from {name}_s left join {name}_t using ({key}, year) {limit})
    """


_REF = f"""
    ref as (select year, unnest(words) as token from w join y on w.doc_id = y.unit_id),
    rt as (select year, count(*) as ref_total from ref group by year),
    rc as (select token, year, count(*) as ref_cnt from ref where token in ({_T}) group by all)
"""
SQL = {
    "token_year_counts": f"{BASE}, {_SERIES} select * from ser",
    "unit_totals_docs": f"{BASE} select unit_id, cast(total as bigint) as total from tot",
    "unit_totals_sections": f"{BASE} select unit_id, cast(sum(tf) as bigint) as total from p where unit = 'sections' and ngram = 1 group by unit_id",
    "collection_totals": f"{BASE}, {_DIMS} select collection, year, cast(sum(total) as bigint) as total from tot join cr using (unit_id) join y using (unit_id) group by all",
    "doc_type_totals": f"{BASE}, {_DIMS} select doc_type, year, cast(sum(total) as bigint) as total from tot join td using (unit_id) join y using (unit_id) group by all",
    "filter_combined_docs": f"{BASE}, {_LABELS}, {_ELIGIBLE} select id, year, collection_id, pages from e",
    "filter_combined_counts": f"{BASE}, {_LABELS}, {_ELIGIBLE}, {_HITS} select token, e.year, cast(sum(tf) as bigint) as cnt from h join e on h.unit_id = e.id group by all",
    "page_filter_counts": f"{BASE} select 'min_5' as filter, year, count(*) as n from d where coalesce(pages, 0) >= 5 group by year union all select 'max_5', year, count(*) from d where coalesce(pages, 0) <= 5 group by year",
    "weighted_type_counts": f"{BASE}, {_HITS}, lw as (select doc_id, max(coalesce(weight, 1)) as weight from doc_types where lower(trim(doc_type)) = 'letter' group by doc_id) select year, round(sum(tf * weight), 6) as weighted from h join lw on h.unit_id = lw.doc_id join y using (unit_id) group by year",
    "term_filtered_counts": f"{BASE} select token, year, cast(sum(tf) as bigint) as cnt from p join y using (unit_id) where unit = 'docs' and token = 'tobacco' and unit_id in (select unit_id from p where unit = 'docs' and token in ('account', 'adjusted')) group by all",
    "wildcard_prefix": f"{BASE} select token, ngram, total from v where ngram = 1 and token like 're%' order by total desc, token limit 10",
    "wildcard_suffix": f"{BASE} select token, ngram, total from v where ngram = 1 and token like '%ed' order by total desc, token limit 10",
    "wildcard_bigram": f"{BASE} select token, ngram, total from v where ngram = 2 and token like 'audit o%' order by total desc, token limit 10",
    "term_existence": f"{BASE} select t as token, exists (select 1 from v where v.token = t and v.ngram = len(string_split(t, ' '))) as known from (select unnest([{_T}, 'audit outlet', 'no such term', 'zzz']) as t)",
    "concrete_terms": f"{BASE}, x as (select * from v where ngram = 1 and token like 're%' order by total desc, token limit 10) select 're*' as asked, token, ngram, total from x union all select token, token, ngram, total from v where (token = 'tobacco' and ngram = 1) or (token = 'audit outlet' and ngram = 2)",
    "units_of_terms": f"{BASE}, x as (select * from v where ngram = 1 and token like 're%' order by total desc, token limit 10) select distinct 're*' as term, unit_id from p where unit = 'docs' and ngram = 1 and token in (select token from x) union all select distinct 'audit outlet', unit_id from p where unit = 'docs' and token = 'audit outlet' union all select 'tobacco account', unit_id from p where unit = 'docs' and token in ('tobacco', 'account') group by unit_id having count(distinct token) = 2",
    "collection_breakdown_top9": f"{BASE}, {_HITS}, {_DIMS}, {_breakdown('co', 'collection', 9)} select * from b",
    "doctype_breakdown": f"{BASE}, {_HITS}, {_DIMS}, {_breakdown('td', 'doc_type', 9)} select * from b",
    "doctype_group_breakdown": f"{BASE}, {_HITS}, {_DIMS}, {_breakdown('gd', 'grp', None)} select * from b",
    "ngram_query": f"""{BASE}, e as (select * from d where coalesce(pages, 0) <= 50 and id in (select doc_id from ty where doc_type in ('letter', 'report'))),
        {_SERIES.replace("from h join y using (unit_id)", "from h join y using (unit_id) where unit_id in (select id from e)").replace("from tot join y using (unit_id)", "from tot join y using (unit_id) where unit_id in (select id from e)")},
        {_DIMS}, {_breakdown('co', 'collection', 9, 'b1', 'e')}, {_breakdown('td', 'doc_type', 9, 'b2', 'e')}, {_breakdown('gd', 'grp', None, 'b3', 'e')}
        select 'token' as kind, token as key, year, cnt, total, freq from ser union all select 'collection', * from b1 union all select 'doc_type', * from b2 union all select 'group', * from b3""",
    "zscore_vs_reference": f"""{BASE}, {_SERIES}, {_REF}, j as (select s.token, s.year, s.cnt, s.total, coalesce(ref_cnt, 0) as ref_cnt, coalesce(case when ref_cnt is not null then ref_total end, 0) as ref_total
            from series s left join rc on rc.token = s.token and rc.year = s.year left join rt on rt.year = s.year),
        q as (select *, (cnt + ref_cnt)::double / nullif(total + ref_total, 0) as p3 from j),
        s as (select *, sqrt(p3 * (1 - p3) * (1.0 / nullif(total, 0) + 1.0 / nullif(ref_total, 0))) as sd from q)
        select token, year, cnt, total, ref_cnt, ref_total, round(coalesce((cnt::double / nullif(total, 0) - ref_cnt::double / nullif(ref_total, 0)) / nullif(sd, 0), 0), 6) as z from s""",
    "moving_average_series": f"{BASE}, {_SERIES} select token, year, round(avg(freq) over (partition by token order by year rows between 3 preceding and 3 following), 9) as smooth from ser",
    "padded_reference": f"{BASE}, {_REF} select 'tobacco' as token, cal.year, last_value(ref_cnt ignore nulls) over (order by cal.year rows between unbounded preceding and current row) as ref_cnt from cal left join rc on rc.year = cal.year and rc.token = 'tobacco'",
    "doc_type_indexes": f"{BASE} select doc_type, n, cast(row_number() over (order by n desc, doc_type) - 1 as integer) as idx from (select doc_type, count(*) as n from ty group by 1 having count(*) >= 100)",
    "year_id_ranges": f"{BASE} select year, min(id) as min_id, max(id) as max_id, count(*) as n from d group by year",
    "year_range_join": f"{BASE}, r as (select year as range_year, min(id) as lo, max(id) as hi from d group by year) select range_year, count(*) as n from d join r on d.id between lo and hi group by range_year",
    "vector_bag_sum": f"{BASE}, {_HITS} select unit_id, cast(sum(tf) as bigint) as tf from h group by unit_id",
    "vector_mask": f"{BASE}, {_HITS} select unit_id, tf from h where token = 'tobacco' and unit_id in (select unit_id from h where token = 'account')",
    "vector_year_ratio": f"{BASE}, {_HITS}, c as (select token, year, sum(tf) as cnt from h join y using (unit_id) group by all) select a.year, round(coalesce(a.cnt::double / b.cnt, 0), 9) as ratio from c a left join c b on a.year = b.year and b.token = 'tobacco' where a.token = 'account'",
    "vector_statistics": f"{BASE}, {_HITS} select token, cast(sum(tf) as bigint) as total, count(*) filter (where tf <> 0) as nnz, cast(sum(case when year between 1950 and 1959 then tf else 0 end) as bigint) as fifties from h join y using (unit_id) group by token",
    "incidence_long": f"{BASE}, {_DIMS} select 'collection' as dim, collection as key, unit_id from cr union all select 'doc_type', doc_type, unit_id from td",
    "missing_years": f"{BASE} select year from cal where year not in (select year from p join y using (unit_id) where unit = 'docs' and token = 'invoice')",
}
