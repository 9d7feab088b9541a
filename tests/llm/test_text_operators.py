"""Term scores, term counts, encoding, leakage, look-alikes and name variants on small fixtures."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, distinctiveness, leakage, lookalikes, name_variants, term_frequency

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


# term scores


def test_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "c c c"), (4, ""), (5, None), (1, "a a b")], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "token string")
    wide, few = distinctiveness.term_scores(docs, vocabulary), distinctiveness.term_scores(docs, vocabulary, broadcast_rows=0)
    got = {(r["doc_id"], r["token"]): r for r in wide.collect()}
    assert set(got) == {(1, "a"), (2, "a"), (2, "c"), (3, "c")}
    assert got[1, "a"]["idf_score"] == round(2 * math.log(4 / 2), 9)
    # eligible table: 1: a2, 2: a1 c1, 3: c3; grand 7, columns a3 c4
    e = 2 * 3 / 7
    assert got[1, "a"]["residual"] == round((2 - e) / math.sqrt(e), 9)
    assert got[1, "a"]["adjusted"] == round((2 - e) / math.sqrt(e) / math.sqrt((1 - 2 / 7) * (1 - 3 / 7)), 9)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, few.collect()))
    top = {r["doc_id"]: r["token"] for r in distinctiveness.top_terms(wide, "idf_score").collect()}
    assert top == {1: "a", 2: "a", 3: "c"}  # doc 2: equal scores, the smaller token


def test_scores_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    vocabulary = spark.createDataFrame([], "token string")
    assert distinctiveness.term_scores(docs, vocabulary).count() == 0


# term counts


@pytest.mark.parametrize("budget", [0.02, 96])
def test_counts_spill_or_not(spark, budget):
    rows = [("hot", f"{k}", k, 1, 2) for k in range(3000)] + [(f"t{k % 50}", "r", 5000 + k, 1, k % 3) for k in range(400)] + [("hot", "0", 0, 1, 2), (None, None, 9, 1, None), ("n", "n", 10, 2, None)]
    tokens = spark.createDataFrame(rows, "token string, token_reversed string, id long, ngram int, total long")
    met = [("docs", 1, "hot", k % 2000, 1) for k in range(6000)] + [("docs", 1, f"t{k % 50}", k, 1) for k in range(500)] + [("sections", 1, "hot", 1, 1), ("docs", 1, "only", 1, 1), ("docs", 1, None, 4, 1)]
    postings = spark.createDataFrame(met, "unit string, ngram int, token string, unit_id long, tf int")
    got = {(r["token"], r["ngram"]): (r["total"], r["records"]) for r in term_frequency.count_terms(tokens, postings, budget_mb=budget).collect()}
    assert got["hot", 1] == (6000, 2000)
    assert got[None, 1] == (0, 1)
    assert got["n", 2] == (0, 0)
    assert ("only", 1) not in got
    assert len(got) == 53
    assert sum(v[1] for k, v in got.items() if k[0] and k[0][0] == "t") == 500


def test_marks(spark):
    rows = spark.createDataFrame([("a", 1, 100, 11), ("b", 1, 4, 10), ("c", 1, 5, 10), ("d", 1, 0, 0)], "token string, ngram int, total long, records long")
    assert {r["token"]: r["mark"] for r in term_frequency.mark_terms(rows, 200).collect()} == {"a": "common", "b": "rare", "c": None, "d": "rare"}


def test_counts_of_empty_tables(spark):
    tokens = spark.createDataFrame([], "token string, token_reversed string, id long, ngram int, total long")
    postings = spark.createDataFrame([], "unit string, ngram int, token string, unit_id long, tf int")
    assert term_frequency.count_terms(tokens, postings).count() == 0


# encoding

TEXTS = ["", None, "Hello world", " lead", "a" * 20_000, "<|endoftext|> as text", "\n\n  x \t y  ", "日本語 😀 é́", "don't I'LL 's", "1234567890 3.14", "\x00\x01", "ＦＵＬＬ", "x" + " " * 500 + "y"]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoding_equals_the_library(spark, data):
    texts = TEXTS + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    mine = bpe.ByteBPE(VOCABULARY, known=50)
    assert [x for k in range(0, len(texts), 7) for x in mine.encode(texts[k : k + 7])] == reference(texts)


def test_encoded_rows(spark):
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate([*TEXTS, "Hello world"])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()}
    assert [got[k] for k in range(len(TEXTS))] == reference(TEXTS)
    assert bpe.encode_texts(df.limit(0)).count() == 0


# leakage

ITEM = "The harmless seedling on the nitrate was examined by Corvane Tobacco Company in November while smokers in the chemical promotion preferred the adult telex to loyalty"


def leaks(spark, texts, items=((7, ITEM),), **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {tuple(r) for r in leakage.leaked_items(docs, spark.createDataFrame(list(items), "item_id long, text string"), **kw).collect()}


def test_passages(spark):
    w = ITEM.split()
    cyrillic = " ".join(w[2:23]).translate(str.maketrans("aeo", "аео"))
    texts = [
        "x " + " ".join(w[:20]) + " y",
        " ".join(w[:19]) + " other words",
        " ".join(w[3:24]).upper().replace(" ", "\n"),
        cyrillic,
        " ".join(w[2:24]).replace("m", "rn").replace("the", "tbe"),
        " ".join(w[:10]) + " inserted " + " ".join(w[10:24]),
        None,
        "",
        " ".join(w[:6] + ["exam-\nined"] + w[7:22]).replace(w[6], "examined"),
        ITEM * 2000,
    ]
    assert leaks(spark, texts) == {(k, 7) for k in (0, 2, 3, 4, 9)} | ({(8, 7)} if w[6] == "examined" else set())


def test_windows_against_brute_force(spark, data):
    docs = [(r[0], leakage.folded(r[1])) for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    want = set()
    for i, t in items:
        w = [x for x in map(leakage.folded, t.split()) if x]
        runs = {"".join(w[k : k + 20]) for k in range(len(w) - 19)}
        want |= {(d, i) for d, stream in docs if any(r in stream for r in runs)}
    found = {tuple(r) for r in leakage.leaked_items(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert want <= found
    assert len(found - want) <= len(want) // 20


def test_sets_of_items(spark):
    items = [(k, ITEM) for k in range(5)] + [(9, None), (10, "short"), (0, ITEM)]
    assert leaks(spark, [ITEM], items) == {(0, k) for k in range(5)}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_myers_is_the_edit_distance():
    assert min(leakage.myers("kitten", "xxsittingxx")) == 2
    assert min(leakage.myers("abc" * 40, "z" + "abc" * 40 + "z")) == 0
    assert leakage.myers("ab", "") == []


# look-alikes


def pairs(spark, texts):
    return {tuple(r) for r in lookalikes.alike_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_alike(spark):
    base = "The café file of a company: x² and ½"
    texts = [
        base,
        base.replace(" ", " ", 1),
        unicodedata.normalize("NFD", base),
        base.replace("file", "ﬁle"),
        base.replace("company", "com​pany"),
        base.replace("company", "соmраny"),
        base.replace(" a ", " а "),
        base.replace("The", "Ｔｈｅ"),
        base.replace("x²", "x2"),
        base.replace("½", "1/2"),
        base,
        None,
        "",
        "​",
        "a\r\nb",
        "a\nb",
    ]
    same = [0, 1, 2, 3, 4, 5, 6, 7, 10]
    want = {(a, b) for a in same for b in same if a < b and texts[a] != texts[b]} | {(14, 15)}
    assert pairs(spark, texts) == want


def test_words_of_another_script_stay(spark):
    assert pairs(spark, ["Отчёт о работе", "Oтчёт о работе", "Отчет"]) == {(0, 1)}
    assert lookalikes.repairs("xаqzб") == {}


def test_no_texts(spark):
    assert lookalikes.alike_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pairs(spark, ["е" * 50_000 + " " + "e" * 10, "x"]) == set()


# name variants

PEOPLE = ["Krurnell, HD", "KRURNELL,HD", "Krurnell-HD", "H.D. Krurnell", "Henry D. Krurnell", "Hank Krurnell", "Hen. Krurnell", "Krurnell, Henry D, Jr.", "Dr. Henry Krurnell", "Krurnekll, HD", "Krurnell,H"]
FIRMS = ["Kestrel Leaf Corporation", "KESTREL LEAF CORP.", "The Kestrel  Leaf Corporation", "Corporation, Kestrel Leaf", "Kestrl Leaf Corporation"]
OTHERS = ["Kestrel Filter Corporation", "Billin, CG", "Billin, GL", "Krurnell, ZA", "Vannius, EL"]


def test_variants(spark):
    rows = [(n,) for n in [*PEOPLE, *FIRMS, *OTHERS, *PEOPLE[:3], None, "", "  "]]
    got = {tuple(r) for r in name_variants.variant_pairs(spark.createDataFrame(rows, "name string")).collect()}
    want = {(a, b) for group in (PEOPLE, FIRMS) for a in group for b in group if a < b}
    assert got == want
    assert name_variants.variant_pairs(spark.createDataFrame([], "name string")).count() == 0


def test_near_keys_are_exact(spark):
    words = ["".join(p) for p in zip("abcabcabdabe" * 9, "xyzzyxxyzzyx" * 9, ("mnop" * 27)[::-1], "qrst" * 27, strict=True)]
    keys = sorted({w + x for w in words for x in ("", "a", "bb")})
    df = spark.createDataFrame([("person", k) for k in keys], "kind string, key string")
    got = {(r["key"], r["other"], r["d"]) for r in name_variants.near_keys(df, 2, pivots=7).collect()}
    both = df.select(F.col("key").alias("a")).join(df.select(F.col("key").alias("b"))).withColumn("d", F.levenshtein("a", "b"))
    assert got == {tuple(r) for r in both.where("d <= 2").collect()}


@pytest.mark.parametrize(
    ("name", "read"),
    [
        ("O’Fiating, YB", ("person", "o'fiating", ["y"], [], "b")),
        ("F D Dozmør", ("person", "dozmor", ["f"], [], "d")),
        ("Peggy Kuld", ("person", "kuld", ["m"], ["margaret"], None)),
        ("Kriavillick, MD", ("person", "kriavillick", ["m"], [], "d")),
        ("Preškel JR", ("person", "preskel", ["j"], [], "r")),
        ("Lianer, SR", ("person", "lianer", ["s"], [], "r")),
        ("Stistett, Nicholas J, Jr.", ("person", "stistett", ["n"], ["nicholas"], "j")),
        ("Attorneys, Aldous & Marrick", ("organisation", "aldous marrick attorneys", [], [], None)),
        ("Pomfrey, Stane & Hult Attys", ("organisation", "pomfrey stane hult attorneys", [], [], None)),
        ("X", ("person", "x", [], [], None)),
    ],
)
def test_names_read(name, read):
    assert name_variants.read_name(name) == read
