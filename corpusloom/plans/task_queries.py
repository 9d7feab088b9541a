"""Whole tasks and the queries of their parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequencies as fr
from ..operators import networks as ne
from ..operators import passages as pa
from ..operators import tasks as ta
from ..operators.archive import Archive
from ..operators.distinctive import STOP_WORDS
from ..operators.filters import Filters
from .common import BASE, TERMS, quoted
from .corpus_queries import _SECTIONS
from .frequency_queries import _SERIES
from .network_queries import _NET, _ONE, _TOP, MAIN, _edges, _tokens
from .passage_queries import _CIGAR, _PANEL

SECTION_FILTERS = Filters(doc_types=["letter", "memo"], max_pages=50, terms=["panel", "committee"])
TASK_FILTERS = Filters(max_pages=200)


def term_filtered_sections(spark: SparkSession, d: str) -> DataFrame:
    """A frequency query that a filter on terms switches to sections, the docs' filters carried over to them."""
    return ta.section_series(Archive(spark, d), ["cigarettes", "tobacco"], SECTION_FILTERS)


def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The docs of the sections, known by their number in the archive, that hold a term."""
    a = Archive(spark, d)
    numbers = ta.section_numbers(a)
    return ta.docs_of_sections(a, numbers.join(pa.section_hits(a, ["panel"]), ["doc_id", "section"]).select("section_id"))


def section_characters(spark: SparkSession, d: str) -> DataFrame:
    return ta.section_spans(Archive(spark, d))


def text_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Several ranges of every text at once."""
    a = Archive(spark, d)
    asked = F.explode(F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("last")) for x, y in ((0, 49), (100, 199), (40, 120))])).alias("r")
    return ta.text_ranges(a, a.raw("documents").select("doc_id", asked).select("doc_id", "r.first", "r.last"))


def display_order(spark: SparkSession, d: str) -> DataFrame:
    """Series as a chart lists them: one left out, the largest total of some years first, with their means."""
    return ta.display_series(fr.token_series(Archive(spark, d), [*TERMS, "committee"]), "token", "freq", ["invoice"], (1950, 1999))


def spline_series(spark: SparkSession, d: str) -> DataFrame:
    """A smooth curve of 1000 points through each series, never below 0."""
    return ta.resampled(fr.token_series(Archive(spark, d), TERMS).withColumn("cnt", F.col("cnt").cast("double")), "token", "cnt")


def reference_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Counts that the relative frequencies stand for in a corpus of a tenth of the size, half-even."""
    rows = fr.token_series(Archive(spark, d), TERMS)
    return rows.select("token", "year", ta.absolute_counts(F.col("freq"), F.col("total") / 10).alias("n"))


def series_point(spark: SparkSession, d: str) -> DataFrame:
    """One year of each series."""
    return fr.token_series(Archive(spark, d), TERMS).where("year = 1957").select("token", "cnt")


def cohort_series(spark: SparkSession, d: str) -> DataFrame:
    """Groups of five years met with the mean pages of docs in the years of their lives."""
    a = Archive(spark, d)
    pages = a.docs_of("id", "year", "pages").where("pages is not null").groupBy("year").agg(F.avg("pages").alias("value"))
    births = spark.createDataFrame([(y, min(y + 80, 2016)) for y in range(1900, 1990, 5)], "cohort int, until int")
    return ta.cohorts(births, pages)


def safe_doc_types(spark: SparkSession, d: str) -> DataFrame:
    return Archive(spark, d).doc_types.select("doc_type", ta.safe_name(F.col("doc_type")).alias("safe")).distinct()


def passage_snippets(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    found = pa.passages(a, "panel", ["cigar*"], 200)
    titles = a.docs_of("id", "title").withColumnRenamed("id", "doc_id")
    return found.join(titles, "doc_id").select("doc_id", "hit", ta.snippet(F.col("title"), F.col("year"), F.col("passage")).alias("html"))


def nodes_by_metric(spark: SparkSession, d: str) -> DataFrame:
    """The 50 nodes of most tokens, by name."""
    a = Archive(spark, d)
    return ta.top_metric(ne.nodes(ne.letters(a), _tokens(a)), "no_tokens")


def _top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return ta.node_pairs(ne.top_nodes(pairs, n))


def network_node_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two of the top nodes, with the letters between them either way."""
    pairs = ne.letters(Archive(spark, d))
    both = pairs.select("doc_id", F.least("author", "recipient").alias("node1"), F.greatest("author", "recipient").alias("node2")).distinct()
    n = both.groupBy("node1", "node2").agg(F.count("*").alias("n"))
    return _top_pairs(pairs, 25).join(n, ["node1", "node2"], "left").fillna(0, ["n"])


def network_edge_mentions(spark: SparkSession, d: str) -> DataFrame:
    pairs = ne.letters(Archive(spark, d))
    return ta.edge_mentions(pairs, _top_pairs(pairs, 10))


def network_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of the letters between the top nodes."""
    a = Archive(spark, d)
    pairs = ne.letters(a)
    return ta.network_sections(a, pairs, _top_pairs(pairs, 10))


def network_edge_terms(spark: SparkSession, d: str) -> DataFrame:
    """What sets the letters of each of the 10 edges of most letters apart."""
    a = Archive(spark, d)
    pairs = ne.letters(a)
    top = ne.edges(pairs, _tokens(a)).orderBy(F.desc("no_docs"), "node1", "node2").limit(10)
    return ta.edge_terms(a, pairs, top)


def network_ranked_edges(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    e = ne.edges(ne.letters(a, MAIN), _tokens(a))
    return ta.ranked_edges(ne.edge_weights(e), e, "no_docs_weighted")


def network_components(spark: SparkSession, d: str) -> DataFrame:
    """Two principal components of the top nodes."""
    a = Archive(spark, d)
    return ta.node_components(a, ne.letters(a))


def person_network(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return ta.person_network(a, MAIN, _tokens(a))


def policy_drill_down(spark: SparkSession, d: str) -> DataFrame:
    """What sets one collection's texts with a term since 1980 apart from its earlier ones."""
    return ta.drill_down(Archive(spark, d), "tobacco", 101, (1980, 2016))


def passage_task(spark: SparkSession, d: str) -> DataFrame:
    """A whole passage query: sections, runs, passages, authors, terms and what was left out."""
    return ta.passage_task(Archive(spark, d), "panel", [], TASK_FILTERS)


def passage_task_terms(spark: SparkSession, d: str) -> DataFrame:
    """The frequent and the distinctive terms of a passage query together."""
    return ta.task_vocabulary(passage_task(spark, d))


QUERIES = {f.__name__: f for f in (
    term_filtered_sections, section_lookup, section_characters, text_ranges, display_order, spline_series, reference_absolute, series_point, cohort_series,
    safe_doc_types, passage_snippets, nodes_by_metric, network_node_pairs, network_edge_mentions, network_sections, network_edge_terms, network_ranked_edges,
    network_components, person_network, policy_drill_down, passage_task, passage_task_terms,
)}

_S = quoted(STOP_WORDS)
_NUMBERS = "nb as (select row_number() over (order by doc_id, section) - 1 as section_id, doc_id, section, words from s)"
_SPANS = r"""
    pcs as (select doc_id, regexp_extract_all(text, '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+') as pieces from documents where text is not null),
    pp as (select doc_id, pos, pieces[pos + 1] as piece from (select doc_id, pieces, unnest(range(0, len(pieces))) as pos from pcs)),
    pe as (select doc_id, pos, piece, sum(length(piece)) over (partition by doc_id order by pos) as e from pp),
    sp as (select doc_id, cast(pos // 200 as integer) as section, cast(min(e - length(regexp_extract(piece, '[\p{L}\p{N}_]+$'))) as bigint) as first_char, cast(max(e) - 1 as bigint) as last_char from pe group by all)
"""
_T10 = f"{BASE}, {_NET}, {_TOP}, t10 as (select node from tn order by n desc, node limit 10), pr as (select a.node as node1, b.node as node2 from t10 a join t10 b on a.node < b.node)"
_MENTIONS = f"{_T10}, em as (select distinct node1, node2, doc_id, year from l join pr on (contains(author, node1) and contains(recipient, node2)) or (contains(author, node2) and contains(recipient, node1)))"


def _g2(keys: str) -> str:
    return f"""round(case when a = 0 or b = 0 then 0.0 else (case when a < na * (a + b) / (na + nb) then -1 else 1 end)
        * 2 * (a * ln(a / (na * (a + b) / (na + nb))) + b * ln(b / (nb * (a + b) / (na + nb)))) end, 6) as g2 from {keys}"""


_COMPARE = """
    cmp as (select token, n::double as a, coalesce(m, 0)::double as b from {here} left join (select token, n as m from {there}) using (token)),
    sm as (select (select sum(n)::double from {here}) as na, (select sum(n)::double from {there}) as nb),
    gg as (select token, cast(a as bigint) as a, cast(b as bigint) as b, {g2}),
    ws as (select * from (select * from gg where token not in ({search}) order by g2 desc, token limit 50) where token not in ({stop}) order by g2 desc, token limit 20)
"""
_TASK = f"""{BASE}, {_SECTIONS}, {_SPANS}, {_PANEL.replace("lt as (select doc_id, year, lower(text) as t from tx)", "lt as (select doc_id, year, lower(text) as t from tx where doc_id in (select id from ok))")},
    runs as (select doc_id, year, min(section) as start, max(section) as stop, count(*) as n from (select doc_id, year, section, section - row_number() over (partition by doc_id order by section) as run
        from s join ok on s.doc_id = ok.id where list_contains(words, 'panel')) group by doc_id, year, run),
    fd as (select distinct doc_id, year from runs),
    shd as (select doc_id from fd qualify row_number() over (partition by year order by md5(doc_id || '#7'), doc_id) <= 1000),
    shr as (select * from runs where doc_id in (select doc_id from shd) qualify row_number() over (partition by doc_id order by md5(doc_id || '#' || start || '#7'), doc_id, start) <= 100),
    pl as (select shr.doc_id, a.first_char, b.last_char from shr join sp a on a.doc_id = shr.doc_id and a.section = shr.start join sp b on b.doc_id = shr.doc_id and b.section = shr.stop),
    cu as (select * from (select distinct hits.doc_id, year, hit, trim(regexp_extract(substring(t, greatest(0, hit - 100) + 1, hit + 100 - greatest(0, hit - 100)), '(?s)\\s.+\\s')) as passage
        from hits join pl on hits.doc_id = pl.doc_id and hit between first_char and last_char) where passage <> ''),
    rd as (select doc_id, hit, round(avg(case when token in (select token from v where ngram = 1) then 1 else 0 end), 6) as readability from (select doc_id, hit, unnest(regexp_split_to_array(trim(passage), '\\s+')) as token from cu) group by all having round(avg(case when token in (select token from v where ngram = 1) then 1 else 0 end), 6) > 0.15),
    rb as (select * from cu join rd using (doc_id, hit)),
    shp as (select * from rb qualify row_number() over (partition by year order by md5(doc_id || '#' || hit || '#7'), doc_id, hit) <= 50),
    pw as (select token, count(*) as n from (select unnest(regexp_split_to_array(passage, '\\s+')) as token from shp) group by token),
    rw as (select token, count(*) as n from (select unnest(words) as token from w where doc_id in (select id from ok)) group by token),
    ft as (select * from (select token, n from pw order by n desc, token limit 200) where token not in ({_S}) and n >= 2),
    {_COMPARE.format(here="pw", there="rw", g2=_g2("cmp, sm"), search="'panel'", stop=_S)},
    ay as (select author, year, count(*) as n from (select distinct * from authors where trim(author) <> '') a join fd using (doc_id) group by all)
""".replace("tx as (", "ok as (select id, year from d where coalesce(pages, 0) <= 200), tx as (")
_DISPLAY = _SERIES.replace(f"token in ({quoted(TERMS)})", f"token in ({quoted([*TERMS, 'committee'])})")

SQL = {
    "term_filtered_sections": f"""{BASE}, {_SECTIONS}, e as (select id, year from d where coalesce(pages, 0) <= 50 and id in (select doc_id from ty where doc_type in ('letter', 'memo'))),
        k as (select e.year, words from s join e on s.doc_id = e.id where list_has_any(words, ['panel', 'committee'])), t as (select year, sum(len(words)) as total from k group by year),
        c as (select token, year, count(*) as cnt from (select year, unnest(words) as token from k) where token in ('cigarettes', 'tobacco') group by all)
        select token, year, cnt, cast(total as bigint) as total from c join t using (year)""",
    "section_lookup": f"{BASE}, {_SECTIONS}, {_NUMBERS} select section_id, doc_id, section from nb where list_contains(words, 'panel')",
    "section_characters": f"with {_SPANS} select * from sp",
    "text_ranges": "select doc_id, cast(a as integer) as first, cast(b as integer) as last, substring(text, a + 1, b - a + 1) as slice from documents, (values (0, 49), (100, 199), (40, 120)) as r(a, b) where text is not null",
    "display_order": f"{BASE}, {_DISPLAY}, q as (select token, round(sum(freq), 6) as total, round(avg(freq), 6) as mean from ser where token <> 'invoice' and year between 1950 and 1999 group by token) select *, cast(row_number() over (order by total desc, token) as integer) as place from q",
    "reference_absolute": f"{BASE}, {_SERIES} select token, year, cast(round_even(freq * (total / 10), 0) as bigint) as n from ser",
    "series_point": f"{BASE}, {_SERIES} select token, cnt from ser where year = 1957",
    "cohort_series": f"""{BASE}, pg as (select year, avg(pages) as value from d where pages is not null group by year),
        b as (select cast(c as integer) as cohort, least(c + 80, 2016) as until from unnest(range(1900, 1990, 5)) as u(c)),
        e as (select cohort, until, cohort + k as born from b, unnest(range(0, 5)) as u(k)), l as (select cohort, born, unnest(range(born, until + 1)) as year from e)
        select cohort, cast(year as integer) as year, round(avg(year - born), 6) as age, round(avg(value), 6) as value from l join pg using (year) group by all""",
    "safe_doc_types": f"{BASE} select distinct doc_type, replace(doc_type, '/', '_') as safe from ty",
    "passage_snippets": f"{BASE}, {_CIGAR} select doc_id, hit, '<p><b>' || case when length(title) > 50 then title[1:50] || '...' else coalesce(title, '') end || '</b> (' || coalesce(cast(year as varchar), 'n.d.') || ')<br>...' || passage || '...</p>' as html from pas join (select distinct id as doc_id, title from docs) using (doc_id)",
    "nodes_by_metric": f"{BASE}, {_NET}, {_edges('l')} select * from (select * from nd order by no_tokens desc, node limit 50)",
    "network_node_pairs": f"""{BASE}, {_NET}, {_TOP}, t as (select node from tn order by n desc, node limit 25), b as (select node1, node2, count(*) as n from (select distinct doc_id, least(author, recipient) as node1, greatest(author, recipient) as node2 from l) group by all)
        select x.node as node1, y.node as node2, coalesce(n, 0) as n from t x join t y on x.node < y.node left join b on b.node1 = x.node and b.node2 = y.node""",
    "network_edge_mentions": f"{_MENTIONS} select * from em",
    "network_sections": f"""{_MENTIONS}, {_SECTIONS}, hs as (select s.*, count(*) over (partition by doc_id) as k from s where doc_id in (select doc_id from em)),
        ns as (select row_number() over (order by doc_id, section) - 1 as section_id, doc_id, section, round(1.0 / k, 6) as weight, array_to_string(words, ' ') as text from hs)
        select section_id, node1, node2, em.doc_id, section, weight, year, text from em join ns using (doc_id)""",
    "network_edge_terms": rf"""{BASE}, {_NET}, {_edges('l')}, te as (select node1, node2 from ed order by no_docs desc, node1, node2 limit 10),
        dd as (select distinct doc_id, node1, node2 from l join te on author = node1 and recipient = node2),
        h as (select node1, node2, token, count(*)::double as a from (select node1, node2, unnest(words) as token from w join dd using (doc_id)) group by all),
        o as (select token, count(*)::double as b from (select unnest(words) as token from w where doc_id in (select doc_id from l)) group by token),
        t as (select node1, node2, sum(a) as na from h group by all), s as (select sum(b) as nb from o),
        g as (select node1, node2, token, cast(a as bigint) as a, cast(b as bigint) as b, {_g2("h join o using (token) join t using (node1, node2), s")}),
        f as (select * from g where not list_contains(regexp_extract_all(lower(node1 || ' ' || node2), '[\p{{L}}\p{{N}}_]+'), token) qualify row_number() over (partition by node1, node2 order by g2 desc, token) <= 50)
        select * from f where token not in ({_S}) qualify row_number() over (partition by node1, node2 order by g2 desc, token) <= 20""",
    "network_ranked_edges": f"{BASE}, {_NET}, {_ONE}, {_edges('lm')} select node1, node2, weight, no_docs, no_docs_weighted, no_tokens, no_tokens_weighted, cast(row_number() over (order by no_docs_weighted desc, node1, node2) as integer) as place from ew join ed using (node1, node2) where weight > 0.001",
    "person_network": f"""{BASE}, {_NET}, {_ONE}, {_edges('lm')}, tm as (select node, count(distinct doc_id) as n from nl group by node order by n desc, node limit 50)
        select 'node' as kind, node as key, null as other, n::double as value from tm union all select 'edge', node1, node2, weight from ew union all select 'year', cast(year as varchar), null, count(distinct doc_id) from lm group by year""",
    "policy_drill_down": f"""{BASE}, dr as (select distinct doc_id, year from tx where collection_id = 101 and contains(lower(text), 'tobacco')),
        hi as (select token, count(*) as n from (select unnest(words) as token from w where doc_id in (select doc_id from dr where year between 1980 and 2016)) group by token),
        lo as (select token, count(*) as n from (select unnest(words) as token from w where doc_id in (select doc_id from dr where year not between 1980 and 2016)) group by token),
        {_COMPARE.format(here="hi", there="lo", g2=_g2("cmp, sm"), search="'tobacco'", stop=_S)} select * from ws""",
    "passage_task": f"""{_TASK}
        select 'passage' as kind, doc_id || '#' || hit as key, year, readability::double as value, passage as text from shp
        union all select 'run', doc_id || '#' || start, year, n, null from shr
        union all select 'author', author, year, n, null from ay where author in (select author from ay group by author order by sum(n) desc, author limit 10)
        union all select 'term', token, null, n, null from ft union all select 'distinctive', token, null, g2, null from ws
        union all select 'documents', null, year, count(*), null from fd group by year
        union all select 'complete', null, q.year, case when q.n <= 1000 and coalesce(r.p, 0) <= 50 and u.r <= 100 then 1 else 0 end, null from (select year, count(*) as n from fd group by year) q
            left join (select year, count(*) as p from rb group by year) r using (year) join (select year, max(r) as r from (select doc_id, year, count(*) as r from runs group by all) group by year) u using (year)""",
    "passage_task_terms": f"{_TASK} select token from ft union select token from ws",
}
