"""Hand-made cases of operators whose queries run on the archive's tables."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.operators import corpus, distinctive, frequencies, networks, passages, side, topics
from corpusloom.operators.filters import page_predicate
from corpusloom.operators.result_cache import ResultCache, parse_filters, query_hash, split_terms


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("s", ["It's a t'est — naïve élan_1, 24th co-op", "", "?!", None])
def test_tokens(spark, s):
    want = None if s is None else [w for w in re.findall(r"\w+", s.lower())]
    assert one(spark, text.tokens(F.lit(s).cast("string"))) == want


def test_ngrams_and_sections(spark):
    words = F.lit("a b c d e").alias("w")
    assert one(spark, text.ngrams(F.split(words, " "), 2)) == ["a b", "b c", "c d", "d e"]
    assert one(spark, text.ngrams(F.split(F.lit("a"), " "), 2)) == []
    for n, k in ((1, 1), (199, 1), (200, 1), (201, 2), (400, 2)):
        assert one(spark, F.size(text.sections(F.array_repeat(F.lit("w"), n), 200))) == k
    assert one(spark, F.size(text.sections(F.array().cast("array<string>"), 200))) == 0


@pytest.mark.parametrize(("s", "out"), [("she'd", "shad / he would".replace("shad", "she had")), ("can't", "cannot"), ("i'd", "i had / i would"), ("don’t", "don’t"), ("it's", "it has / it is")])
def test_contractions_in_order(spark, s, out):
    assert one(spark, text.expand_contractions(F.lit(s))) == out


@pytest.mark.parametrize(("term", "hit", "miss"), [("addict", "an addict x", "addicted"), ("addict*", "addicted", "nonaddict"), ("*addict", "nonaddict", "addicted"), ("a*d", "and", "aard")])
def test_search_regex(spark, term, hit, miss):
    assert one(spark, F.lit(hit).rlike(text.unicode_regex(term)))
    assert not one(spark, F.lit(miss).rlike(text.unicode_regex(term)))


def test_hits_and_windows(spark):
    assert one(spark, text.hit_offsets(F.lit("xaxaaxa"), "xa")) == [0, 2, 5]
    assert one(spark, text.hit_offsets(F.lit("none"), "xa")) == []
    assert one(spark, text.hit_offsets(F.lit("aaaa"), "aa")) == [0, 2]
    assert one(spark, text.window(F.lit("one two three four five"), F.lit(8), 16)) == "two three"
    assert one(spark, text.window(F.lit("three"), F.lit(0), 4)) == ""


def test_statistics(spark):
    def g2(a, b):
        return one(spark, stats.signed_g2(F.lit(a), F.lit(b), F.lit(1000), F.lit(1000)))

    assert g2(0, 5) == g2(5, 0) == 0
    assert abs(g2(5, 5)) < 1e-12
    assert g2(10, 1) > 0 > g2(1, 10)
    assert one(spark, stats.smoothed_g2(F.lit(0), F.lit(9), F.lit(100.0), F.lit(100.0))) > 0
    assert one(spark, stats.z_score(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, stats.relative_frequency(F.lit(0), F.lit(0))) == 0
    z = one(spark, stats.z_score(F.lit(30.0), F.lit(100.0), F.lit(20.0), F.lit(100.0)))
    assert round(z, 6) == round((0.3 - 0.2) / (0.25 * 0.75 * (2 / 100)) ** 0.5, 6)


def test_islands(spark):
    rows = spark.createDataFrame([("A", k) for k in (1, 2, 3, 7, 8)] + [("B", 9)], "doc string, s int")
    assert sorted(map(tuple, passages.islands(rows, "doc", "s").collect())) == [("A", 1, 3, 3), ("A", 7, 8, 2), ("B", 9, 9, 1)]


def test_quota_is_stable_and_bounded(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("y"), "id")
    a = passages.quota(rows, ["y"], ["id"], 7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, passages.quota(rows.repartition(3), ["y"], ["id"], 7).collect()))
    assert a.groupBy("y").count().where("count <> 7").count() == 0


def test_numbers_and_running_sums(spark):
    rows = spark.createDataFrame([(k, (k * 37) % 101, k % 4 if k % 5 else None) for k in range(101)], "k int, o int, n int")
    got = {r["o"]: r["no"] for r in corpus.numbered(rows, ["o"], "no").collect()}
    assert got == {o: o for o in range(101)}
    sums = {r["o"]: r["s"] for r in corpus.numbered(rows, ["o"], "s", F.col("n")).collect()}
    by = sorted((r["o"], r["n"] or 0) for r in rows.collect())
    run, want = 0, {}
    for o, n in by:
        want[o] = run
        run += n
    assert sums == want
    assert corpus.numbered(rows.limit(0), ["o"], "no").count() == 0


def test_asof(spark):
    known = spark.createDataFrame([("a", 1970, 1.0), ("a", 1980, 2.0)], "k string, year int, value double")
    asked = spark.createDataFrame([("a", y) for y in (1950, 1975, 1990, 2020)] + [("b", 1970)], "k string, year int")
    got = {(r["k"], r["year"]): r["value"] for r in side.as_of(asked, known, "k", 1960, 2016).collect()}
    assert got == {("a", 1950): 1.0, ("a", 1975): 2.0, ("a", 1990): 2.0, ("a", 2020): 2.0, ("b", 1970): None}


def test_weighted_median(spark):
    rows = spark.createDataFrame([("x", 1.0, 3), ("x", 10.0, 2), ("x", 5.0, 4)], "k string, v double, w int")
    assert tuple(side.weighted_statistics(rows, "k", "v", "w").first()) == ("x", round(43 / 9, 6), 5.0)


def test_change_point(spark):
    rows = spark.createDataFrame([("t", 2000 + k, 0 if k < 6 else 9, 100) for k in range(12)], "token string, year int, cnt long, total long")
    best = distinctive.adoption(distinctive.change_points(rows, ["token"]), ["token"]).first()
    assert best["adopted"] in (2005, 2006)
    assert best["rise"] > 0


def test_ties_are_broken_by_key(spark):
    rows = spark.createDataFrame([(t, 5, 1, 1.0) for t in "dcba"], "token string, a long, b long, g2 double")
    assert [r["token"] for r in distinctive.winners(rows, 3, 2, stop=["a"]).orderBy("token").collect()] == ["b", "c"]


def test_person_names(spark):
    assert one(spark, networks.persons(F.lit("Green, SJ; DUNN,WL"))) == ["Green, SJ", "DUNN,WL"]
    assert one(spark, networks.persons(F.lit("Smith-AB and co"))) == ["Smith-AB"]


def test_page_filter(spark):
    rows = spark.createDataFrame([(1, None), (2, 3), (3, 9)], "id int, pages int")
    assert [r["id"] for r in rows.where(page_predicate("max_5")).collect()] == [1, 2]
    assert [r["id"] for r in rows.where(page_predicate("min_5")).collect()] == [3]


def test_unigram_validity(spark):
    cases = {"a": False, "st": False, "co-op": False, "007": False, "98465st": False, "3001": False, "3000": True, "1st": True, "word": True, "99999999999": False}
    rows = spark.createDataFrame([(w,) for w in cases], "token string")
    assert {r[0]: r[1] for r in rows.select("token", corpus.valid_unigram(F.col("token"))).collect()} == cases


def test_vectors(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "unit_id int, tf int")
    assert sorted(map(tuple, frequencies.vector_sum(a, a).collect())) == [(1, 4), (2, 6)]
    assert frequencies.vectors_equal(a, a.orderBy("tf"))
    assert not frequencies.vectors_equal(a, a.limit(1))


def test_nmf_error_falls(spark):
    rows = [(d, t, 1.0 + (d % 2 == t % 2)) for d in range(6) for t in range(8)]
    cells = spark.createDataFrame([(str(d), str(t), v) for d, t, v in rows], "doc string, token string, value double")
    errors = []
    for steps in (1, 4):
        w, h = topics.nmf(cells, 2, steps)
        assert w.where("w0 < 0 or w1 < 0").count() == 0
        errors.append(topics.nmf_error(cells, w, h, 2))
    assert errors[1] <= errors[0]
    terms = topics.topic_terms(h, 2, 3)
    assert terms.count() == 6
    assert topics.topic_docs(cells, terms, 2).count() == 4


def test_markov(spark, data):
    from corpusloom.operators.archive import Archive

    a = Archive(spark, data)
    out = side.generate(a, "statistical questionnaire", 3, 2)
    assert out.startswith("statistical questionnaire")
    assert out == side.generate(a, "statistical questionnaire", 3, 2)


def test_query_keys_and_input():
    assert query_hash({"a": 1, "b": [2]}) == query_hash({"b": [2], "a": 1}) != query_hash({"a": 2})
    assert split_terms(' Zeta, "alpha-beta" ,alpha beta') == ["alpha beta", "zeta"]
    assert split_terms("b, a", keep_first=True) == ["b", "a"]
    for bad in ("", " , ", "a;b", "x@y"):
        with pytest.raises(ValueError):
            split_terms(bad)
    assert parse_filters('{"doc_types": ["letter"]}') == {"doc_types": ["letter"]}
    for bad in ("__import__('os')", "[1]"):
        with pytest.raises(ValueError):
            parse_filters(bad)


def test_results_are_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    cache = ResultCache(spark, str(tmp_path))
    assert cache.get("k", compute).count() == cache.get("k", compute).count() == 3
    assert len(calls) == 1
    assert cache.as_json("k", compute).first()[0].startswith('{"id":')


def test_wildcards_need_one_star(spark, data):
    from corpusloom.operators.archive import Archive

    for bad in ("*x*", "x"):
        with pytest.raises(ValueError):
            frequencies.expand_wildcard(Archive(spark, data), bad)
