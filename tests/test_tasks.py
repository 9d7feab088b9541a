"""Whole tasks and their parts: what their SQL doesn't say."""

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from corpusloom.operators import tasks as ta
from corpusloom.operators import topics
from corpusloom.operators.archive import Archive
from corpusloom.operators.filters import Filters, eligible
from corpusloom.operators.frequencies import expand_wildcard, term_vector
from corpusloom.operators.packed_values import split_packed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_take_columns_and_predicates(spark, data):
    a = Archive(spark, data)
    docs = plan(eligible(a, Filters(max_pages=5)))
    assert "title" not in docs and "date_orig" not in docs
    suffix = plan(expand_wildcard(a, "*ed"))
    assert "StringStartsWith(token_reversed,de)" in suffix.partition("PushedFilters")[2] or "Or(" in suffix.partition("PushedFilters")[2]
    assert "token" in plan(term_vector(a, ["tobacco"])).partition("PushedFilters")[2]


def test_spline_goes_through_its_points(spark):
    rows = [("a", y, float(v)) for y, v in zip(range(1950, 1956), (0, 3, 1, 4, 9, 2), strict=True)] + [("a", 1960, None), ("b", 1950, 5.0)]
    got = ta.resampled(spark.createDataFrame(rows, "k string, year int, v double"), "k", "v", 101).toPandas()
    a = got[got.k == "a"]
    assert len(a) == 101 and (a.y >= 0).all()
    assert all(abs(float(a.y.iloc[i * 20]) - v) < 1e-9 for i, v in enumerate((0, 3, 1, 4, 9, 2)))
    assert got[got.k == "b"].y.tolist() == [5.0]
    line = ta.resampled(spark.createDataFrame([("l", y, 2.0 * y) for y in (1, 2, 4)], "k string, year int, v double"), "k", "v", 7).toPandas()
    assert np.allclose(line.y, 2 * line.x)


def test_half_even(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (0.5, 3.0), (0.5, 5.0), (0.25, 8.0)], "f double, t double")
    assert [r[0] for r in rows.select(ta.absolute_counts(F.col("f"), F.col("t"))).collect()] == [0, 2, 2, 2]


def test_texts_of_the_api():
    assert [ta.listed(x) for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a and b", "a, b, and c"]
    assert ta.check_type(3, (int, str)) == 3
    for value, kind in ((True, int), ("x", int), (None, (int, str))):
        with pytest.raises(TypeError, match="must be"):
            ta.check_type(value, kind)


def test_a_year_is_computed_once_for_all_spans(spark, data, tmp_path):
    api = ta.ArchiveApi(Archive(spark, data), str(tmp_path))
    one = api.passages("panel", [], Filters(), (1990, 1991)).count()
    assert len(list(tmp_path.iterdir())) == 2
    both = api.passages("panel", [], Filters(), (1990, 1992))
    assert len(list(tmp_path.iterdir())) == 3
    assert both.count() >= one
    rows = api.sections(["panel"], Filters())
    assert rows.where(~F.col("text").contains("panel")).count() == 0


def test_a_built_corpus_answers_like_the_texts(spark, data, tmp_path):
    a = Archive(spark, data)
    ta.build_corpus(a, str(tmp_path), (1, 2))
    got = ta.built_vector(a, str(tmp_path), "the panel")
    words = a.words.select("doc_id", F.array_join("words", " ").alias("t")).where(F.concat(F.lit(" "), "t", F.lit(" ")).contains(" the panel "))
    assert {r[0] for r in got.collect()} == {r[0] for r in words.select("doc_id").collect()}
    scan = plan(got).partition("PartitionFilters")[2]
    assert "ngram" in scan and "EqualTo(token,the panel)" in scan
    vocabulary = spark.read.parquet(f"{tmp_path}/vocabulary")
    assert vocabulary.where(F.reverse("token") != F.col("token_reversed")).count() == 0


def test_topics_of_planted_groups(spark):
    rows = [(d, f"t{d % 3}{j}", 1.0) for d in range(90) for j in range(5)] + [(d, "common", 0.2) for d in range(90)]
    got = topics.topics(spark.createDataFrame(rows, "doc int, token string, value double"), 3, 5, 1000, steps=40).collect()
    groups = {r["topic"]: set() for r in got}
    for r in got:
        if r["kind"] == "term":
            groups[r["topic"]].add(r["key"][:2])
    assert sorted(map(sorted, groups.values())) == [["t0"], ["t1"], ["t2"]]
    assert {r["topic"] for r in got} == {0, 1, 2}
    docs = {r["key"] for r in got if r["kind"] == "doc" and r["topic"] == 0}
    assert len({int(k) % 3 for k in docs}) == 1 and len(docs) == 30
    few = spark.createDataFrame(rows[:5], "doc int, token string, value double")
    assert topics.topics(few).count() == 0
    with pytest.raises(ValueError, match="vocabulary"):
        topics.nmf(few, 2, most_terms=3)
    w, h = topics.nmf(few.limit(0), 2)
    assert w.count() == h.count() == 0 and w.columns == ["doc", "w0", "w1"]


def test_brackets_close_by_the_delimiters_asked_for():
    assert split_packed('(x#"a)b"#c)', "#") == split_packed('(x;"a)b";c)', ";")


def _plain_lda(words, vocabulary, k, steps):
    """EM cell by cell over one matrix, from the same start."""
    rows = [(r["s"], np.array([r["words"].count(t) for t in vocabulary], float)) for r in words.select(F.xxhash64("doc_id", F.lit(7)).alias("s"), "words").collect()]
    n = np.array([c for _, c in rows if c.any()])
    given = np.zeros((*n.shape, k))
    for d, (s, c) in enumerate((s, c) for s, c in rows if c.any()):
        at = np.flatnonzero(c)
        g = np.random.default_rng(s % (1 << 64)).random((len(at), k))
        given[d, at] = g / g.sum(1, keepdims=True) * c[at, None]
    for _ in range(steps):
        doc, term = given.sum(1), given.sum(0)
        given = (doc[:, None] + 50 / k) * (term + 0.1) / (term.sum(0) + len(vocabulary) * 0.1)
        given *= (n / given.sum(2))[:, :, None]
    weights = given.sum(0) / given.sum((0, 1))
    best = [sorted(range(len(vocabulary)), key=lambda i: (-weights[i, t], i))[:6] for t in range(k)]
    return {(t, vocabulary[i]): weights[i, t] for t in range(k) for i in best[t]}


def _lda_words(spark, docs=60):
    rng = np.random.default_rng(3)
    texts = [[f"t{d % 3}{x}" for x in rng.integers(0, 9, 25)] + [f"all{x}" for x in rng.zipf(1.6, 8) % 12] + [f"only{d}"] for d in range(docs)]
    return spark.createDataFrame([*enumerate(texts), (docs, ["unknown"]), (docs + 1, [])], "doc_id bigint, words array<string>")


def test_lda_is_the_plain_em_however_docs_are_spread(spark):
    words = _lda_words(spark)
    vocabulary = sorted({w for r in words.collect() for w in r["words"]} - {"unknown"})
    want = _plain_lda(words, vocabulary, 3, 25)
    runs = (words.coalesce(1), {}), (words.repartition(5), {"docs": 7, "keep": 4}), (words.repartition(3), {"cells": 1, "partition_bytes": 1000})
    for spread, kw in runs:
        got = {(r["topic"], r["token"]): r["weight"] for r in topics.lda(spread, vocabulary, 3, 25, **kw).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    assert topics.lda(words.limit(0), vocabulary, 3, 5).count() == topics.lda(words, ["absent"], 3, 5).count() == topics.lda(words, [], 3, 5).count() == 0
    assert topics.lda(words, ["t01", "t02"], 2, 5).count() == 4


def test_lda_ends_where_sparks_own_em_ends(spark):
    words = _lda_words(spark)
    vocabulary = sorted({w for r in words.collect() for w in r["words"] if w[0] == "t"})
    fitted = LDA(k=3, maxIter=100, seed=7, optimizer="em").fit(CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="features").transform(words))
    own = sorted(sorted(zip((vocabulary[i] for i in r["termIndices"]), r["termWeights"])) for r in fitted.describeTopics(6).collect())
    got: dict[int, list] = {}
    for r in topics.lda(words, vocabulary, 3, 100).collect():
        got.setdefault(r["topic"], []).append((r["token"], r["weight"]))
    for a, b in zip(sorted(map(sorted, got.values())), own, strict=True):
        assert [x for x, _ in a] == [x for x, _ in b] and all(abs(x - y) < 1e-3 for (_, x), (_, y) in zip(a, b))


def test_a_step_of_lda_shuffles_nothing(spark):
    sc, words = spark.sparkContext, _lda_words(spark)
    stages = []
    for steps in (3, 8):
        sc.setJobGroup(f"lda {steps}", "")
        topics.lda(words, ["t00", "t01", "t12", "all1"], 2, steps)
        jobs = sc.statusTracker().getJobIdsForGroup(f"lda {steps}")
        stages.append(sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages[1] - stages[0] == 5  # one stage a step; as messages over a graph there are more


def test_sums_of_many_tasks_meet_before_the_driver(spark):
    tops = spark.createDataFrame([(np.array([i, 1.0]).tobytes(),) for i in range(20)], "top binary").repartition(9)
    assert topics._summed(tops, 9, 4).tolist() == topics._summed(tops, 9).tolist() == [190.0, 20.0]
