"""Network and side queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frequencies as fr
from ..operators import networks as ne
from ..operators import side as si
from ..operators import topics as to
from ..operators.archive import Archive
from ..operators.distinctive import STOP_WORDS, count_words, limited_vocabulary, tfidf_smooth, winners_by, compare
from ..session import durable
from .common import BASE, quoted

MAIN = "Niatius, NR"


def _tokens(a: Archive) -> DataFrame:
    return a.docs_of("id", "no_tokens").select(F.col("id").alias("doc_id"), F.coalesce("no_tokens", F.lit(0)).cast("bigint").alias("no_tokens"))


def person_names(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return a.authors.select("doc_id", F.explode(ne.persons(F.col("author"))).alias("person"))


def network_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return ne.top_nodes(ne.letters(Archive(spark, d)))


def network_edges(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return ne.edges(ne.letters(a), _tokens(a))


def network_of_person(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return ne.edges(ne.letters(a, MAIN, (1950, 1999)), _tokens(a))


def network_nodes(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return ne.nodes(ne.letters(a), _tokens(a))


def network_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    return ne.edge_weights(ne.edges(ne.letters(a), _tokens(a)))


def network_strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The 200 strongest edges among the 25 top nodes: what a layout would draw."""
    a = Archive(spark, d)
    pairs = ne.letters(a)
    weights = ne.edge_weights(ne.edges(pairs, _tokens(a)))
    top = F.broadcast(ne.top_nodes(pairs, 25).select("node"))
    among = weights.join(top.withColumnRenamed("node", "node1"), "node1", "left_semi").join(top.withColumnRenamed("node", "node2"), "node2", "left_semi")
    return among.orderBy(F.desc("weight"), "node1", "node2").limit(200)


def network_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold one of some strings."""
    return ne.name_mentions(Archive(spark, d).authors.select(F.col("author").alias("name")), ["Niatius", "Tobacco", "Laborator"])


def network_node_share(spark: SparkSession, d: str) -> DataFrame:
    """Each author's share of a doc, 1 / authors."""
    a = Archive(spark, d)
    n = a.authors.groupBy("doc_id").agg(F.count("*").alias("n"))
    return a.authors.join(n, "doc_id").groupBy("author").agg(F.round(F.sum(1 / F.col("n")), 6).alias("weight"))


def edge_term_years(spark: SparkSession, d: str) -> DataFrame:
    """Terms by edge, and by edge and year, of the letters of one person."""
    a = Archive(spark, d)
    words = a.raw("postings").where("unit = 'docs' and ngram = 1").distinct().select(F.col("unit_id").alias("doc_id"), "token", "tf")
    return ne.term_edge_cube(ne.letters(a, MAIN), words)


def network_selection(spark: SparkSession, d: str) -> DataFrame:
    pairs = ne.letters(Archive(spark, d))
    return ne.select_letters(pairs, list(range(1960, 1990)), ["John S. Ciacken", MAIN], MAIN)


def network_years(spark: SparkSession, d: str) -> DataFrame:
    return ne.letters(Archive(spark, d), MAIN).select("year").distinct().orderBy("year")


def network_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of the docs in letters, each doc once: the top 5000, then without stop words and rare ones."""
    a = Archive(spark, d)
    docs = ne.letters(a).select("doc_id").distinct()
    return limited_vocabulary(count_words(a.words.join(docs, "doc_id", "left_semi"), []), 5000, 10)


def node_distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    """What sets the letters of each of the 10 top nodes apart from all letters."""
    a = Archive(spark, d)
    pairs = ne.letters(a)
    top = F.broadcast(ne.top_nodes(pairs, 10).select("node"))
    each = pairs.select("doc_id", F.explode(F.array_distinct(F.array("author", "recipient"))).alias("node")).distinct().join(top, "node", "left_semi")
    here = count_words(a.words.join(each, "doc_id"), ["node"])
    there = count_words(a.words.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), [])
    return winners_by(compare(here, there, ["node"]), "node")


def network_json(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    pairs = ne.letters(a)
    return ne.node_link_json(ne.nodes(pairs, _tokens(a)), ne.edges(pairs, _tokens(a)), 1)


LEXICON = [("approved", "trust", 0.4), ("cigarettes", "fear", -0.2), ("confidential", "fear", 0.6), ("improved", "joy", 0.7), ("increased", "joy", 0.2), ("missing", "fear", 0.5), ("promising", "joy", 0.9), ("rejected", "trust", -0.8), ("significant", "trust", 0.3), ("toxic", "fear", 0.8)]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "token string, emotion string, value double")
    return si.lexicon_scores(Archive(spark, d).words, lexicon)


def lexicon_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def lexicon_top5(spark: SparkSession, d: str) -> DataFrame:
    return si.top_by(_scores(spark, d), "emotion", "score", "doc_id", 5).select("emotion", "doc_id", "score")


def weighted_prices(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median price by ship mark, each line standing for its quantity."""
    return si.weighted_statistics(Archive(spark, d).raw("lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")


def pages_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each collection and some years: the pages of that year, of the next one that has any, or of the last before."""
    a = Archive(spark, d)
    known = a.docs.where("pages is not null").groupBy("collection_id", "year").agg(F.sum("pages").alias("value"))
    asked = a.docs.select("collection_id").distinct().select("collection_id", F.explode(F.array(*map(F.lit, (1880, 1903, 1931, 1950, 1999, 2016, 2040)))).alias("year"))
    return si.as_of(asked, known, "collection_id", 1901, 2016)


def interpolated_series(spark: SparkSession, d: str) -> DataFrame:
    """Docs of every collection a year, years without any filled on the line between their neighbours."""
    a = Archive(spark, d)
    known = a.docs.groupBy("collection_id", "year").agg(F.count("*").cast("double").alias("value"))
    grid = known.select("collection_id").distinct().join(F.broadcast(fr.years_of(a)))
    return si.interpolated(grid.join(known, ["collection_id", "year"], "left"), "collection_id").select("collection_id", "year", "value")


def next_words(spark: SparkSession, d: str) -> DataFrame:
    return si.continuations(Archive(spark, d), ["statistical", "questionnaire"], 3)


def place_mentions(spark: SparkSession, d: str) -> DataFrame:
    gazetteer = spark.createDataFrame([(x,) for x in ("Corvale", "Eastholm", "Kelbridge", "Vantry", "Zellwood")], "place string")
    return si.places(Archive(spark, d).words, gazetteer)


def zone_series(spark: SparkSession, d: str) -> DataFrame:
    """Term occurrences by home zone, type group and year, per million tokens: one grouped aggregate for all series."""
    a = Archive(spark, d)
    zones = a.docs_of("id", "collection_id").select(F.col("id").alias("unit_id"), "collection_id").join(F.broadcast(a.raw("collections").select("collection_id", "home_zone")), "collection_id").select("unit_id", "home_zone")
    return fr.breakdown(a, ["tobacco"], zones, "home_zone", None)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    counts = durable(count_words(a.words, ["doc_id"]))
    vocabulary = limited_vocabulary(counts.groupBy("token").agg(F.sum("n").alias("n")), 5000, 10)
    kept = counts.join(F.broadcast(vocabulary.select("token")), "token", "left_semi")
    return durable(tfidf_smooth(kept, "doc_id").select(F.col("doc_id").alias("doc"), "token", F.col("tfidf").alias("value")))


def topic_nmf(spark: SparkSession, d: str) -> DataFrame:
    """Twenty topics: their strongest terms, and the docs ranked by them."""
    return to.topics(_matrix(spark, d))


def topic_nmf_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The same with a penalty that leaves docs few topics."""
    return to.topics(_matrix(spark, d), sparsity=0.2)


def topic_nmf_local(spark: SparkSession, d: str) -> DataFrame:
    """The same over the texts since 1950, terms weighed by how they set these apart from the earlier ones."""
    a = Archive(spark, d)
    late = a.doc_years.where("year >= 1950").select(F.col("unit_id").alias("doc_id"))
    counts = durable(count_words(a.words.join(late, "doc_id", "left_semi"), ["doc_id"]))
    totals = limited_vocabulary(counts.groupBy("token").agg(F.sum("n").alias("n")), 5000, 10)
    scores = compare(totals, count_words(a.words.join(late, "doc_id", "left_anti"), []))
    return to.topics(to.local_idf(counts, "doc_id", scores))


def topic_lda(spark: SparkSession, d: str) -> DataFrame:
    a = Archive(spark, d)
    vocabulary = limited_vocabulary(count_words(a.words, []), 5000, 10)
    return to.lda(a.words, [r[0] for r in vocabulary.select("token").orderBy("token").collect()])


QUERIES = {f.__name__: f for f in (
    person_names, network_top_nodes, network_edges, network_of_person, network_nodes, network_edge_weights, network_strongest_edges, network_mentions,
    network_node_share, edge_term_years, network_selection, network_years, network_vocabulary, node_distinctive_terms, network_json,
    lexicon_scores, lexicon_top5, weighted_prices, pages_as_of, interpolated_series, next_words, place_mentions, zone_series, topic_nmf, topic_nmf_sparse, topic_nmf_local, topic_lda,
)}

_S = quoted(STOP_WORDS)
_NET = """
    au as (select distinct * from authors where trim(author) <> ''), re as (select distinct * from recipients where trim(recipient) <> ''),
    l as (select au.doc_id, year, author, recipient from au join re using (doc_id) join y on au.doc_id = y.unit_id),
    tk as (select id as doc_id, coalesce(no_tokens, 0) as no_tokens from d)
"""
_ONE = "lm as (select * from l where author = 'Niatius, NR' or recipient = 'Niatius, NR')"


def _edges(src: str) -> str:
    return f"""
    wl as (select {src}.*, 1.0 / n as weight, no_tokens from {src} join (select doc_id, count(distinct author) * count(distinct recipient) as n from {src} group by doc_id) using (doc_id) left join tk using (doc_id)),
    ed as (select author as node1, recipient as node2, count(*) as no_docs, round(sum(weight), 6) as no_docs_weighted, cast(sum(no_tokens) as bigint) as no_tokens, round(sum(no_tokens * weight), 6) as no_tokens_weighted from wl group by all),
    nl as (select distinct doc_id, author, recipient, weight, no_tokens, unnest(list_distinct([author, recipient])) as node from wl),
    nd as (select node, count(distinct doc_id) as no_docs, round(sum(weight), 6) as no_docs_weighted, cast(sum(no_tokens) as bigint) as no_tokens from nl group by node),
    ew as (select node1, node2, round((coalesce(no_docs_weighted / nullif((select sum(no_docs_weighted) from ed), 0), 0) + coalesce(no_tokens_weighted / nullif((select sum(no_tokens_weighted) from ed), 0), 0)) / 2, 6) as weight from ed)
    """


_TOP = "tn as (select node, count(*) as n from (select distinct doc_id, unnest([author, recipient]) as node from l) group by node)"
_LEX = "lx as (select * from (values " + ", ".join(f"('{t}', '{e}', {v}::double)" for t, e, v in LEXICON) + ") as x(token, emotion, value)), sc as (select doc_id, emotion, round(sum(value), 6) as score, array_to_string(list_sort(list_distinct(list(case when value > 0 then token end))), ' ') as matched from (select doc_id, unnest(words) as token from w) join lx using (token) group by all)"
_FILLED = """k as (select collection_id, year, n from (select distinct collection_id from d) cross join cal left join (select collection_id, year, count(*)::double as n from d group by all) c using (collection_id, year)),
    f as (select collection_id, year, n, last_value(case when n is not null then year end ignore nulls) over a as ya, last_value(n ignore nulls) over a as va, first_value(case when n is not null then year end ignore nulls) over b as yb, first_value(n ignore nulls) over b as vb from k
        window a as (partition by collection_id order by year rows between unbounded preceding and current row), b as (partition by collection_id order by year rows between current row and unbounded following))"""

SQL = {
    "person_names": f"{BASE} select doc_id, unnest(regexp_extract_all(author, '[A-Z][a-zA-Z]+[, -]+[A-Z]{{1,3}}')) as person from (select distinct * from authors where trim(author) <> '')",
    "network_top_nodes": f"{BASE}, {_NET}, {_TOP} select * from tn order by n desc, node limit 50",
    "network_edges": f"{BASE}, {_NET}, {_edges('l')} select * from ed",
    "network_of_person": f"{BASE}, {_NET}, lm as (select * from l where (author = 'Niatius, NR' or recipient = 'Niatius, NR') and year between 1950 and 1999), {_edges('lm')} select * from ed",
    "network_nodes": f"{BASE}, {_NET}, {_edges('l')} select * from nd",
    "network_edge_weights": f"{BASE}, {_NET}, {_edges('l')} select * from ew",
    "network_strongest_edges": f"{BASE}, {_NET}, {_edges('l')}, {_TOP}, t as (select node from tn order by n desc, node limit 25) select * from ew where node1 in (select node from t) and node2 in (select node from t) order by weight desc, node1, node2 limit 200",
    "network_mentions": "select distinct a as asked, author as name from authors, (select unnest(['Niatius', 'Tobacco', 'Laborator']) as a) where contains(author, a) and trim(author) <> ''",
    "network_node_share": f"{BASE}, {_NET} select author, round(sum(1.0 / n), 6) as weight from au join (select doc_id, count(*) as n from au group by doc_id) using (doc_id) group by author",
    "edge_term_years": f"{BASE}, {_NET}, {_ONE} select token, author as node1, recipient as node2, year, cast(sum(tf) as bigint) as n from lm join p on lm.doc_id = p.unit_id where unit = 'docs' and ngram = 1 group by grouping sets ((token, author, recipient), (token, author, recipient, year))",
    "network_selection": f"{BASE}, {_NET} select doc_id, year, author, recipient from l where year between 1960 and 1989 and author = 'Niatius, NR'",
    "network_years": f"{BASE}, {_NET}, {_ONE} select distinct year from lm",
    "network_vocabulary": f"{BASE}, {_NET} select * from (select token, count(*) as n from (select unnest(words) as token from w where doc_id in (select doc_id from l)) group by token order by n desc, token limit 5000) where token not in ({_S}) and n >= 10",
    "node_distinctive_terms": f"""{BASE}, {_NET}, {_TOP}, t10 as (select node from tn order by n desc, node limit 10),
        nd as (select distinct doc_id, node from (select doc_id, unnest([author, recipient]) as node from l) where node in (select node from t10)),
        h as (select node, token, count(*)::double as a from (select node, unnest(words) as token from w join nd using (doc_id)) group by all),
        o as (select token, count(*)::double as b from (select unnest(words) as token from w where doc_id in (select doc_id from l)) group by token),
        t as (select node, sum(a) as na from h group by node), s as (select sum(b) as nb from o),
        g as (select node, token, cast(a as bigint) as a, cast(b as bigint) as b, round((case when a < na * (a + b) / (na + nb) then -1 else 1 end) * 2 * (a * ln(a / (na * (a + b) / (na + nb))) + b * ln(b / (nb * (a + b) / (na + nb)))), 6) as g2 from h join o using (token) join t using (node), s),
        f as (select * from g qualify row_number() over (partition by node order by g2 desc, token) <= 50)
        select * from f where token not in ({_S}) qualify row_number() over (partition by node order by g2 desc, token) <= 20""",
    "network_json": f"{BASE}, {_NET}, {_edges('l')} select 'node' as kind, cast(json_object('id', node, 'no_docs', no_docs) as varchar) as json from nd union all select 'link', cast(json_object('source', node1, 'target', node2, 'no_docs', no_docs) as varchar) from ed where no_docs > 1",
    "lexicon_scores": f"{BASE}, {_LEX} select * from sc",
    "lexicon_top5": f"{BASE}, {_LEX} select emotion, doc_id, score from sc qualify row_number() over (partition by emotion order by score desc, doc_id) <= 5",
    "weighted_prices": "select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) as mean, (select round(median(l_extendedprice), 6) from lineitem x, unnest(range(0, cast(x.l_quantity as bigint))) where x.l_returnflag = o.l_returnflag) as median from lineitem o group by l_returnflag",
    "pages_as_of": f"""{BASE}, k as (select collection_id, year as y, cast(sum(pages) as bigint) as value from d where pages is not null group by all),
        a as (select distinct collection_id, cast(yr as integer) as year, greatest(1901, least(2016, yr)) as pt from d, unnest([1880, 1903, 1931, 1950, 1999, 2016, 2040]) as u(yr))
        select a.collection_id, a.year, coalesce(arg_min(value, y) filter (where y >= pt), arg_max(value, y) filter (where y < pt)) as value from a left join k using (collection_id) group by all""",
    "interpolated_series": f"{BASE}, {_FILLED} select collection_id, year, round(coalesce(n, va + (vb - va) * ((year - ya) / nullif(yb - ya, 0))), 6) as value from f",
    "next_words": f"{BASE}, f as (select * from v where ngram = 3 and token like 'statistical questionnaire %') select token, ngram, total, round(total / (select sum(total) from f), 6) as share from f",
    "place_mentions": f"{BASE} select doc_id, upper(t[1]) || t[2:] as place, count(*) as n from (select doc_id, unnest(words) as t from w) where t in ('corvale', 'eastholm', 'kelbridge', 'vantry', 'zellwood') group by all",
    "zone_series": f"""{BASE}, z as (select id as unit_id, home_zone from d join collections using (collection_id)),
        c as (select home_zone, year, sum(tf) as cnt from p join z using (unit_id) join y using (unit_id) where unit = 'docs' and token = 'tobacco' group by all),
        t as (select home_zone, year, sum(total) as total from tot join z using (unit_id) join y using (unit_id) group by all)
        select home_zone, year, cast(cnt as bigint) as cnt, cast(coalesce(total, 0) as bigint) as total, round(coalesce(cnt / nullif(total, 0), 0), 9) as freq from c left join t using (home_zone, year)""",
}
