import io
import tarfile

from pyspark.sql import functions as F

from corpusloom.sources import readers, writers
from corpusloom.streaming.jobs import grow_postings


def test_text_files_and_archives(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/abcd1234.ocr").write_bytes("Caf\xe9 can't".encode("latin-1") + b"\x81")
    rows = readers.read_text_files(spark, str(tmp_path)).collect()
    assert [(r["tid"], r["text"]) for r in rows] == [("abcd1234", "Café can't")]
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, content in (("q/one.txt", b"He can't GO"), ("two.txt", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    got = readers.read_text_archives(spark, str(tmp_path)).collect()
    assert sorted((r["tid"], r["text"]) for r in got) == [("one", "he cannot go"), ("two", "")]


def test_lists(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Beta  \nab\n\nalpha\nab\n")
    assert [r[0] for r in readers.read_word_list(spark, str(tmp_path / "words.txt")).collect()] == ["ab", "beta", "alpha"]
    (tmp_path / "joy.tsv").write_text("Happy\t1.0\nsad\t0.25\n")
    assert sorted(map(tuple, readers.read_lexicons(spark, {"joy": str(tmp_path / "joy.tsv")}).collect())) == [("happy", "joy", 1.0), ("sad", "joy", -0.5)]
    (tmp_path / "places.tsv").write_text('1\tNew\r York "x\n2\tVantry\n')
    assert [tuple(r) for r in readers.read_gazetteer(spark, str(tmp_path / "places.tsv"), "id int, name string").collect()] == [(1, 'New York "x'), (2, "Vantry")]
    (tmp_path / "p.json").write_text('[{"Country Name": "A", "Year": "1970", "Value": "5"}]')
    assert tuple(readers.read_population(spark, str(tmp_path / "p.json")).first()) == ("A", 1970, 5.0)
    (tmp_path / "w.csv").write_text("year,1900,1905\n1950,1.5,\n1951,2,3\n")
    assert readers.read_wide_csv(spark, str(tmp_path / "w.csv"), "year", "cohort", "pct").count() == 3


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("docs", 1, t, k, 1) for t in ("x", "y") for k in range(5)], "unit string, ngram int, token string, unit_id long, tf int")
    writers.write_postings(rows, str(tmp_path / "p"), 2)
    again = spark.read.parquet(str(tmp_path / "p"))
    assert again.where("unit = 'docs' and ngram = 1 and token = 'x'").count() == 5
    new = spark.createDataFrame([("docs", 1, "x", 1, 9)], rows.schema)
    writers.upsert(rows.where("token = 'x'"), new, "unit_id", ["tf"], str(tmp_path / "u"))
    assert {r["unit_id"]: r["tf"] for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {0: 1, 1: 9, 2: 1, 3: 1, 4: 1}
    for h, n in (("a", 1), ("b", 2), ("a", 3)):
        writers.write_partitions(spark.range(n).withColumn("query_hash", F.lit(h)), str(tmp_path / "r"))
    assert {r["query_hash"]: r["count"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("query_hash").count().collect()} == {"a": 3, "b": 2}
    writers.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 10


def test_postings_grow(spark, tmp_path):
    schema, source = "doc_id long, text string", str(tmp_path / "in")
    args = (spark, source, schema, str(tmp_path / "out"), str(tmp_path / "state"))
    spark.createDataFrame([(1, "a b a"), (2, None)], schema).write.parquet(source)
    grow_postings(*args).awaitTermination()
    spark.createDataFrame([(3, "b")], schema).write.mode("append").parquet(source)
    grow_postings(*args).awaitTermination()
    got = sorted((r["doc_id"], r["token"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a", 2), (1, "b", 1), (3, "b", 1)]
