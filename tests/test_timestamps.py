import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow.parquet as pq
import pytest

from corpusloom.operators.timestamps import ZONES, estimate_zones, known_zones, local_to_utc, normalise_times

SOURCES = [(1, "America/New_York", "mdy"), (2, "Europe/London", "dmy"), (3, "Asia/Kolkata", "dmy"), (4, None, "mdy")]
DOCS = "id long, tid string, timestamp long, year int, date_orig string, collection_id int"


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "collection_id int, home_zone string, day_order string")


CASES = [
    ("1997-211", 1, utc(1997, 7, 30, 4)),
    ("1997-366", 1, None),
    ("19020425", 1, utc(1902, 4, 25, 5)),
    ("19320000", 2, utc(1932, 1, 1)),
    ("1969-02-30", 1, None),
    ("31 June 1957", 1, None),
    ("00000000", 1, None),
    ("undated", 1, None),
    ("", 1, None),
    (None, 1, None),
    ("03/04/1985", 1, utc(1985, 3, 4, 5)),
    ("03/04/1985", 2, utc(1985, 4, 2, 23)),
    ("1/2/79", 1, utc(1979, 1, 2, 5)),
    ("241344Z FEB 54", 1, utc(1954, 2, 24, 13, 44)),
    ("Sun, 29 Oct 1972 02:00:37 -0500", 1, utc(1972, 10, 29, 7, 0, 37)),
    ("1985-02-21 02:55:18+01:00", 1, utc(1985, 2, 21, 1, 55, 18)),
    ("6/13/1986 1:37:00 PM EDT", 1, utc(1986, 6, 13, 17, 37)),
    ("15 December 1978, 12:44 a.m.", 3, utc(1978, 12, 14, 19, 14)),
    ("1975-04-25T15:20:57.999999Z", 1, utc(1975, 4, 25, 15, 20, 57)),
    ("529322339", 1, 529322339),
    ("1996-10-27 01:30", 1, utc(1996, 10, 27, 5, 30)),  # occurs twice: the first
    ("1996-04-07 02:30", 1, utc(1996, 4, 7, 7, 30)),  # skipped: moved on by the gap
    ("Sept. 5, 1950", 1, utc(1950, 9, 5, 4)),
    ("June 1953", 1, utc(1953, 6, 1, 4)),
    ("1909", 2, utc(1909, 1, 1)),
    ("13/13/1985", 1, None),
    ("1985-01-01 25:00", 1, None),
    ("1985-01-01 10:00 XYZ", 1, None),
]


def test_forms(spark, sources):
    years = [int(y[0]) if (y := re.findall(r"\b(\d{4})\b", s or "")) else (1979 if s == "1/2/79" else 1954) for s, _, _ in CASES]
    docs = spark.createDataFrame([(i, "t", None, years[i], s, c) for i, (s, c, _) in enumerate(CASES)], DOCS)
    got = {r["id"]: r["utc_s"] for r in normalise_times(docs, sources).where("field = 'date_orig'").collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: u for i, (_, _, u) in enumerate(CASES)}


def test_counts_of_any_unit_and_repeats(spark, sources):
    s = utc(1969, 6, 13, 5)
    rows = [(1, "a", s, 1969, None, 1), (1, "b", s, 1969, None, 1), (2, "a", s * 1000 + 999, 1969, None, 1), (3, "a", s * 10**6 - 1, 1969, None, 1), (4, "a", 7 * 10**17, 1969, None, 1), (5, "a", None, 1969, None, 1), (6, "a", s, None, None, None)]
    got = sorted((r["id"], r["utc_s"]) for r in normalise_times(spark.createDataFrame(rows, DOCS), sources).where("field = 'timestamp'").collect())
    assert got == [(1, s), (2, s), (3, s - 1), (6, s)]


def test_empty(spark, sources):
    assert normalise_times(spark.createDataFrame([], DOCS), sources).count() == 0


def test_missing_zone_is_estimated(spark, sources):
    zone, rows = ZoneInfo("Asia/Kolkata"), []
    for k in range(40):
        at = datetime(1980, 1, 1, 3, tzinfo=timezone.utc) + timedelta(days=9 * k, minutes=7)
        rows.append((k, "t", int(at.timestamp()), at.astimezone(zone).year, at.astimezone(zone).strftime("%Y-%m-%d %H:%M"), 4))
    rows.append((99, "t", None, 1980, "1980-05-05 12:00", 4))
    got = {r["id"]: r["utc_s"] for r in normalise_times(spark.createDataFrame(rows, DOCS), sources).where("field = 'date_orig'").collect()}
    assert got[99] == utc(1980, 5, 5, 6, 30)


def test_zone_with_fewest_violations(spark):
    rows = spark.sql("select 1 as k, timestamp_ntz'1980-07-01 12:00:00' as l, 331315200L as i, 60L as s union all select 1, null, 0L, 60L union all select null, timestamp_ntz'1980-07-01', 0L, 60L")
    got = estimate_zones(rows, "k", "l", "i", "s", ["UTC", "America/New_York"]).collect()
    assert [tuple(r) for r in got] == [(1, "America/New_York", 1, 0)]


FORMATS = [
    "%Y-%m-%d", "%Y%m%d", "%d-%b-%y", "%d-%b-%Y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%j", "%B %d, %Y", "%b. %d, %Y", "%d %B %Y", "%A, %d %B %Y", "%Y%m%d%H%M%S",
    "%a, %d %b %Y %H:%M:%S %z", "%Y-%m-%dT%H:%M", "%B %Y", "%b. %Y", "%Y", "%Y-%m", "%d%H%MZ %b %y", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z", "%Y%m%dT%H%M%S%z",
    "%d.%m.%Y", "%d.%m.%y", "%d %B %Y, %I:%M %p", "%Y-%m-%d %H:%M UTC",
]


def by_hand(text, zone, dmy, year):
    """A plain reading with strptime: tries every format and both orders of figures by the collection's."""
    t = (text or "").strip()
    if re.fullmatch(r"[1-9]\d{8,9}", t):
        return int(t)
    t = re.sub(r"(\d)(st|nd|rd|th)\b", r"\1", t).replace("a.m.", "AM").replace("p.m.", "PM")
    offset = None
    if (m := re.search(r" ([A-Z]{3})$", t)) and m[1] in ZONES and m[1] != "UTC":
        offset, t = ZONES[m[1]], t[:-4]
    order = "%d{0}%m{0}%Y" if dmy else "%m{0}%d{0}%Y"
    figures = [f.format(s) + tail for s in "/-." for f in (order, order.replace("%Y", "%y")) for tail in ("", " %I:%M %p", " %I:%M:%S %p", " %H:%M:%S")]
    if re.fullmatch(r"\d{4}0000", t):
        t = t[:4]
    elif re.fullmatch(r"\d{6}00", t):
        t = f"{t[:4]}-{t[4:6]}"
    for f in [*FORMATS, *figures, "%d %b %Y %H:%M"]:
        if re.fullmatch(r"\d{8}", t) and f != "%Y%m%d" or re.fullmatch(r"\d{14}", t) and f != "%Y%m%d%H%M%S" or bool(re.fullmatch(r"\d{4}-\d{3}", t)) != (f == "%Y-%j"):
            continue
        try:
            d = datetime.strptime(t.replace("Sept.", "Sep."), f)
        except ValueError:
            continue
        if "%y" in f:
            d = min((d.replace(year=c + d.year % 100) for c in (1900, 2000)), key=lambda x: abs(x.year - year))
        if f.endswith("UTC") or "Z " in f:
            offset = 0
        if d.tzinfo:
            return int(d.timestamp() // 1)
        if offset is not None:
            return int(d.replace(tzinfo=timezone.utc).timestamp() // 1) - offset * 60
        return int(d.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).timestamp() // 1)
    return None


def test_against_a_plain_reading(spark, data):
    places = {r["collection_id"]: r for r in pq.read_table(f"{data}/collections.parquet").to_pylist()}
    rows = {r["id"]: r for r in pq.read_table(f"{data}/docs.parquet").to_pylist()}
    want = {i: by_hand(r["date_orig"], places[r["collection_id"]]["home_zone"], places[r["collection_id"]]["day_order"] == "dmy", r["year"]) for i, r in rows.items()}
    docs, collections = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("docs", "collections"))
    got = {r["id"]: r["utc_s"] for r in normalise_times(docs, collections).where("field = 'date_orig'").collect()}
    assert {i: got.get(i) for i in want} == want


def test_zones_are_found_without_being_stated(spark):
    """With every home zone hidden, the zones come from the whole database and the times agree with those of the stated zones."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    docs, places = spark.read.parquet(f"{folder}/docs.parquet"), spark.read.parquet(f"{folder}/collections.parquet")
    want = {tuple(r) for r in normalise_times(docs, places).collect()}
    got = {tuple(r) for r in normalise_times(docs, places.withColumn("home_zone", F.lit(None).cast("string"))).collect()}
    assert len(got & want) >= 0.97 * len(want)
    some = places.withColumn("home_zone", F.when(F.col("collection_id") % 2 == 0, F.col("home_zone")))
    assert len({tuple(r) for r in normalise_times(docs, some).collect()} & want) >= 0.97 * len(want)


def each_row_against_each_zone(df, zones):
    """(k, zone, rows, violations) without any narrowing or summing before the zones are met."""
    from pyspark.sql import functions as F

    met = df.dropna().withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(z).alias("zone")) for i, z in enumerate(zones)])))
    at = local_to_utc(F.col("l"), F.col("c.zone"))
    sums = met.groupBy("k", "c").agg(F.count("*").alias("rows"), F.sum(((F.col("i") < at) | (F.col("i") >= at + F.col("s"))).cast("bigint")).alias("v"))
    best = sums.groupBy("k").agg(F.min(F.struct("v", "c", "rows")).alias("b")).select("k", "b.c.zone", "b.rows", "b.v")
    return sorted(tuple(r) for r in best.collect())


LOCAL = "k int, l timestamp_ntz, i long, s long"


def test_no_zone_is_dropped_by_what_it_is_in_mid_month(spark):
    """Rows of days on which New York hasn't switched yet, in months in which it has by the 15th: no zone of its offsets in mid-month fits them."""
    zone, rows = ZoneInfo("America/New_York"), []
    for month in (3, 11):
        for k in range(40):
            at = datetime(2010, month, 2, 12, k, tzinfo=timezone.utc) + timedelta(days=k % 5)
            rows.append((1, at.astimezone(zone).replace(tzinfo=None), int(at.timestamp()), 60))
    df, zones = spark.createDataFrame(rows, LOCAL), known_zones(spark)
    got = [tuple(r) for r in estimate_zones(df, "k", "l", "i", "s", zones).collect()]
    assert got == each_row_against_each_zone(df, zones)
    assert got[0][2:] == (80, 0)
    assert [tuple(r) for r in estimate_zones(df, "k", "l", "i", "s", known_zones(spark, ["America/New_York"])).collect()] == [(1, "America/New_York", 80, 0)]


def test_zones_as_by_each_row_against_each_zone(spark):
    """Noise, gaps, repeated hours, every span, times before any rule and long after the last listed year."""
    import random

    draw = random.Random(4)
    names = ["America/New_York", "Europe/Dublin", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia", "America/Sao_Paulo", "Asia/Manila"]
    rows = []
    for k, name in enumerate(names):
        for n in range(120):
            year = draw.choice([1, 1583, 1840, 1883, 1918, 1943, 1972, 1990, 2011, 2024, 2087, 2100, 2486, 2487, 2488, 2888, 9998])
            at = datetime(year, draw.randint(1, 12), draw.randint(2, 28), draw.randint(0, 23), draw.randint(0, 59), draw.randint(0, 59), tzinfo=timezone.utc)
            local, span = at.astimezone(ZoneInfo(name)).replace(tzinfo=None), draw.choice([1, 60, 86400, 31 * 86400, 366 * 86400, 0])
            local = local.replace(second=0) if span == 60 else local.replace(hour=0, minute=0, second=0) if span > 60 else local
            shift = timedelta(0) if draw.random() < 0.8 else timedelta(seconds=draw.randint(-(10**5), 10**5))
            rows.append((k, local, int((at + shift - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()), span))
        for l in ("1990-04-01 02:30:00.75", "1990-10-28 01:30", "1883-11-18 12:03:57", "1883-11-18 12:03:58", "2011-12-30 10:00", "2100-03-14 02:30", "1990-03-25 01:00:00"):
            for offset in range(-12, 15):
                rows.append((k, datetime.fromisoformat(l), int((datetime.fromisoformat(l) - datetime(1970, 1, 1)).total_seconds() // 1) - offset * 3600, 60))
    rows += [(8, datetime(1980, 5, 5), 0, 60), (9, datetime(1980, 5, 5), utc(1980, 5, 5), 10**7), (9, None, 5, 5), (None, datetime(1980, 5, 5), 5, 5)]
    df, zones = spark.createDataFrame(rows, LOCAL), known_zones(spark, ["+05:30", "EST5EDT"])
    want = each_row_against_each_zone(df, zones)
    assert sorted(tuple(r) for r in estimate_zones(df, "k", "l", "i", "s", zones).collect()) == want
    assert want[8:] == [(8, "+05:30", 1, 1), (9, "+05:30", 1, 0)]


def test_switches_are_where_the_time_zone_database_has_them(spark):
    """The second before and the second of every listed switch, and the days of rules in some later years, in each zone."""
    from pyspark.sql import functions as F

    from corpusloom.operators.timestamps import seconds_ntz, zone_histories

    rows = []
    for h in zone_histories(spark, known_zones(spark)):
        assert h.starts == sorted(set(h.starts))
        rows += [(h.zone, s + d, h.offsets[k + (d >= 0)]) for k, s in enumerate(h.starts) for d in (-1, 0)]
        for year in (2088, 2096, 2100, 2399, 2487):
            start = utc(year, 1, 1)
            rows += [(h.zone, s + d, o) for s, o in h.within(year, start, utc(year + 1, 1, 1)) for d in (0, 3599)]
    df = spark.createDataFrame(rows, "zone string, at long, want int").withColumn("l", F.timestamp_seconds("at").cast("timestamp_ntz"))
    assert len(rows) > 30000 and df.where(seconds_ntz(F.col("l")) - local_to_utc(F.col("l"), F.col("zone")) != F.col("want")).limit(3).collect() == []
