"""Mixed timestamp formats and time zones: every stated time as one UTC instant.

Parsing is a list of regular expressions over one column, all inside the JVM. A stated time without a zone is local time
of its source; where a source's zone isn't known, ``estimate_zones`` finds it by aligning the local times with ingestion
times of the same rows and choosing the offset history (time zone) with the fewest violations.
"""

from __future__ import annotations

import calendar
import re
import time
from bisect import bisect_left, bisect_right
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

#: Month names, and zone abbreviations with their offset in minutes.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "BST": 60, "CET": 60, "CEST": 120, "IST": 330,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_TIME = r"(?:[t ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(?:([ap])\.?m\.?)?)?"
_ZONE = r"\s*([+-]\d{2}:?\d{2}|[a-z]{1,4})?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_DAYNAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_CLOCK = "$4~$5~$6~$7~$8"

#: (pattern over the lower-cased text, its parts as year~month~day~hour~minute~second~half~zone~day of year).
_FORMS: list[tuple[str, str]] = [
    (r"^(1[89]\d{2}|20\d{2})(\d{2})(\d{2})$", "$1~$2~$3~~~~~~"),
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + _ZONE + "$", f"$1~$2~$3~{_CLOCK}~"),
    (r"^" + _DAYNAME + _DAY + r"[ -]" + _MONTH + r",?[ -](\d{4}|\d{2})" + _TIME + _ZONE + "$", f"$3~$2~$1~{_CLOCK}~"),
    (r"^" + _DAYNAME + _MONTH + " " + _DAY + r",? (\d{4})" + _TIME + _ZONE + "$", f"$3~$1~$2~{_CLOCK}~"),
    (r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})(?:[.,]\d+)?()" + _ZONE + "$", f"$1~$2~$3~{_CLOCK}~"),
    (r"^(\d{4})-(\d{3})$", "$1~~~~~~~~$2"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1~$2~~~~~~~"),
    (r"^" + _MONTH + r",? (\d{4})$", "$2~$1~~~~~~~"),
    (r"^(\d{4})$", "$1~~~~~~~~"),
    (r"^(\d{2})(\d{2})(\d{2})(z) " + _MONTH + r" (\d{4}|\d{2})$", "$6~$5~$1~$2~$3~~~$4~"),
]
_FIGURES = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})" + _TIME + _ZONE + "$"


def stated_parts(df: DataFrame, text: str, day_first: Column, name: str) -> DataFrame:
    """Adds the text as year~month~day~hour~minute~second~half~zone~day of year, parts not stated left empty; null if it
    has none of the known forms. A count of seconds comes back as it is, without marks."""
    t = F.col("_t")
    figures = F.when(day_first, F.regexp_replace(t, _FIGURES, f"$3~$2~$1~{_CLOCK}~")).otherwise(F.regexp_replace(t, _FIGURES, f"$3~$1~$2~{_CLOCK}~"))
    chain = F.when(t.rlike(_FIGURES), figures)
    for pattern, parts in _FORMS:
        chain = chain.when(t.rlike(pattern), F.regexp_replace(t, pattern, parts))
    trimmed = df.withColumn("_t", F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))
    return trimmed.withColumn(name, chain.when(t.rlike(r"^[1-9]\d{8,9}$"), t)).drop("_t")


def parse_stated(df: DataFrame, text: str, day_first: Column, year_hint: Column) -> DataFrame:
    """Adds ``local`` (timestamp_ntz), ``offset`` (minutes east of UTC, null if not stated), ``instant`` (UTC seconds where
    the text is a count of seconds) and ``span`` (seconds of its precision).

    All are null where the text is null, blank, free text, or names a date that doesn't exist or a zone that isn't known.
    Parts that are absent or given as 00 are the first possible. ``day_first`` decides on dates in figures, ``year_hint``
    (may be null) on the century of two-figure years. Columns of these names in ``df`` are replaced.
    """
    split = stated_parts(df, text, day_first, "_x").withColumn("_x", F.split("_x", "~"))
    split = split.withColumns({f"_p{k}": F.nullif(F.get("_x", F.lit(k)), F.lit("")) for k in range(9)})
    part = [F.col(f"_p{k}") for k in range(9)]
    short = part[0].try_cast("int")
    late = F.when(year_hint.isNotNull(), F.abs(short + 2000 - year_hint) < F.abs(short + 1900 - year_hint)).otherwise(short < 17)
    year = F.when(F.length(part[0]) == 4, short).when(late, short + 2000).otherwise(short + 1900)
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(part[1], 1, 3))
    month = F.when(part[1].isNull() | (part[1].try_cast("int") == 0), 1).otherwise(F.coalesce(part[1].try_cast("int"), F.nullif(named, F.lit(0)).cast("int")))
    day = F.when(part[2].isNull() | (part[2].try_cast("int") == 0), 1).otherwise(part[2].try_cast("int"))
    hour = F.coalesce(part[3].try_cast("int"), F.lit(0))
    hour = F.when(part[6].isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(part[6] == "p", 12).otherwise(0))
    minute, second = (F.coalesce(part[k].try_cast("int"), F.lit(0)) for k in (4, 5))
    mark = F.regexp_replace(F.upper(part[7]), "[:]", "")
    sign = F.when(F.substring(mark, 1, 1) == "-", -1).otherwise(1)
    offsets = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    offset = F.when(mark.rlike(r"^[+-]\d{4}$"), sign * (F.substring(mark, 2, 2).cast("int") * 60 + F.substring(mark, 4, 2).cast("int"))).otherwise(F.try_element_at(offsets, mark))
    out = (
        split.withColumn("_day", F.col("_x").isNotNull() & (F.size("_x") == 9))
        .withColumn("offset", F.when(F.col("_day"), offset).cast("int"))
        .withColumn("local", F.when(F.col("_day") & (part[7].isNull() | F.col("offset").isNotNull()), F.try_make_timestamp_ntz(year, month, day, F.when(hour < 24, hour), minute, F.least(second, F.lit(59)).cast("decimal(16,6)"))))
        .withColumn("_nth", part[8].try_cast("int"))
    )
    nth = F.date_add(F.col("local").cast("date"), F.col("_nth") - 1)
    shifted = F.when(F.col("_nth").isNull(), F.col("local")).when((F.col("_nth") > 0) & (F.year(nth) == F.year("local")), nth.cast("timestamp_ntz"))
    span = F.when(part[5].isNotNull(), 1).when(part[3].isNotNull(), 60).when(part[2].isNotNull() | part[8].isNotNull(), 86400).when(part[1].isNotNull(), 31 * 86400).otherwise(366 * 86400)
    return (
        out.withColumn("local", shifted).withColumn("instant", F.when(~F.col("_day"), F.get("_x", F.lit(0)).try_cast("bigint"))).withColumn("span", span.cast("bigint"))
        .drop("_x", "_day", "_nth", *[f"_p{k}" for k in range(9)])
    )


def seconds_ntz(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp_ntz, fractions rounded down; independent of the session's time zone."""
    day = ts.cast("date")
    return F.unix_date(day).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.extract(F.lit("SECOND"), ts)).cast("bigint")


def local_to_utc(local: Column, zone: Column) -> Column:
    """UTC seconds of a wall-clock time. An hour that occurs twice means the first, a skipped time moves on by the gap."""
    return seconds_ntz(F.convert_timezone(zone, F.lit("UTC"), local))


def utc_to_local_year(seconds: Column, zone: Column) -> Column:
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    whole = F.date_add(start.cast("date"), F.call_function("div", seconds - F.pmod(seconds, F.lit(86400)), F.lit(86400)).cast("int")).cast("timestamp_ntz")
    at = whole + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"))
    return F.year(F.convert_timezone(F.lit("UTC"), zone, at))


def epoch_seconds(count: Column, year: Column, zone: Column) -> Column:
    """UTC seconds of a count since 1970 of unknown unit: the coarsest of s, ms, us, ns whose local year is ``year``
    (without a year: whose instant lies in 1800-2100); null if none fits."""
    units = F.array(*[F.lit(u).cast("bigint") for u in (1, 10**3, 10**6, 10**9)])
    each = F.transform(units, lambda u: F.call_function("div", count - F.pmod(count, u), u))
    fits = F.filter(each, lambda s: s.between(-5364662400, 4102444800) & (year.isNull() | (utc_to_local_year(s, zone) == year)))
    return F.get(fits, F.lit(0))


def known_zones(spark: SparkSession, first: list[str] = ()) -> list[str]:
    """Every region of the time zone database, those of ``first`` in front, then by name."""
    names = {str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()}
    regions = sorted(z for z in names if "/" in z and not z.startswith(("Etc/", "SystemV/")))
    return list(dict.fromkeys([*first, "UTC", *regions]))


_SWITCH = re.compile(r"at ([\d-]+T[\d:]+)(Z|[+-][\d:]+) to (Z|[+-][\d:]+)\]")


def _offset(text: str) -> int:
    hours, minutes, seconds = (0, 0, 0) if text == "Z" else map(int, f"{text[1:]}:0".split(":")[:3])
    return (-1 if text[0] == "-" else 1) * (hours * 3600 + minutes * 60 + seconds)


def _switches(text: str) -> list[tuple[int, int, int]]:
    """(first local second under the new offset, offset before, offset after) of the java.time transitions printed in ``text``.

    A skipped time counts by the offset before the gap, an hour that occurs twice by the first, as in ``local_to_utc``.
    """
    found = [(calendar.timegm(datetime.fromisoformat(at).timetuple()), _offset(a), _offset(b)) for at, a, b in _SWITCH.findall(text)]
    return [(at + max(0, b - a), a, b) for at, a, b in found]


class _History:
    """The offsets of a zone by local time: those that the time zone database lists, then those of its yearly rules."""

    def __init__(self, at: int, zone: str, listed: str, rules, fixed: int):
        self.at, self.zone, self.rules, self.years = at, zone, rules, {}
        switches = _switches(listed)
        self.last = time.gmtime(switches[-1][0]).tm_year if switches else None
        if rules:  # they may go on within the last listed year
            switches += [s for s in self._by_rule(self.last) if s[0] > switches[-1][0]]
        self.starts, self.offsets = [s[0] for s in switches], [switches[0][1] if switches else fixed, *(s[2] for s in switches)]

    def _by_rule(self, year: int) -> list[tuple[int, int, int]]:
        """Years of one calendar have one set of dates, so at most 14 are asked of the JVM."""
        calendars = (calendar.isleap(year), calendar.weekday(year, 1, 1))
        like = next(y for y in range(2000, 2028) if (calendar.isleap(y), calendar.weekday(y, 1, 1)) == calendars)
        if like not in self.years:
            self.years[like] = _switches("".join(r.createTransition(like).toString() for r in self.rules))
        moved = calendar.timegm((year, 1, 1, 0, 0, 0)) - calendar.timegm((like, 1, 1, 0, 0, 0))
        return [(s + moved, a, b) for s, a, b in self.years[like]]

    def within(self, year: int, start: int, end: int) -> tuple[tuple[int, int], ...]:
        """(from, offset) of the stretches of [start, end), which lies in ``year``."""
        starts, offsets = self.starts, self.offsets
        if self.rules and year > self.last:
            ruled = self._by_rule(year)
            starts, offsets = [s[0] for s in ruled], [ruled[0][1], *(s[2] for s in ruled)]
        a, b = bisect_right(starts, start), bisect_left(starts, end)
        return ((start, offsets[a]), *((starts[k], offsets[k + 1]) for k in range(a, b)))


def zone_histories(spark: SparkSession, zones: list[str]) -> list[_History]:
    """The distinct offset histories of ``zones`` in the JVM's time zone database, each under the zone first named with it."""
    read, now = spark._jvm.org.apache.spark.sql.catalyst.util.DateTimeUtils.getZoneId, spark._jvm.java.time.Instant.EPOCH
    found, same = {}, {}
    for at, zone in enumerate(zones):
        java = read(zone).getRules()
        listed, rules = java.getTransitions().toString(), java.getTransitionRules()
        ruled = rules.toString()
        fixed = 0 if listed != "[]" else _offset(java.getOffset(now).toString())
        if (listed, ruled, fixed) not in found:
            history = found[listed, ruled, fixed] = _History(at, zone, listed, list(rules) if ruled != "[]" else [], fixed)
            history.years = same.setdefault(ruled, history.years)
    return list(found.values())


def _month_start(month: int) -> int:
    return calendar.timegm((month // 12, month % 12 + 1, 1, 0, 0, 0))


def _month_tables(histories: list[_History], months: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Of each month (years * 12 + months) the histories by what they are within it.

    First (month, points, offsets, kinds): the local seconds at which any history switches, every offset in use in ascending order,
    and for each kind of history the index of its offset before the first point and from each point on. Then (month, kind, its histories).
    """
    layouts, members = [], []
    for m in months:
        start, end = _month_start(m), _month_start(m + 1)
        kinds: dict[tuple, list[int]] = {}
        for h in histories:
            kinds.setdefault(h.within(m // 12, start, end), []).append(h.at)
        points = sorted({s for kind in kinds for s, _ in kind[1:]})
        offsets = sorted({o for kind in kinds for _, o in kind})
        index = {o: i for i, o in enumerate(offsets)}
        layouts.append((m, points, offsets, [[index[next(o for s, o in reversed(kind) if s <= p)] for p in (start, *points)] for kind in kinds]))
        members += [(m, k, ats) for k, ats in enumerate(kinds.values())]
    return layouts, members


def _below(array: str, bound: Column) -> Column:
    return F.size(F.filter(array, lambda x: x < bound))


def estimate_zones(df: DataFrame, key: str, local: str, instant: str, span: str, zones: list[str]) -> DataFrame:
    """(key, zone, rows, violations): for each key the zone of ``zones`` under which the fewest rows have their ingestion
    instant outside [local, local + span). Ties go to the zone named first; rows with a null in any column don't count.

    Every row counts against every zone, exactly. A row asks for an offset in [low, low + span), so it is told by its key, by the stretch
    of local time in which no zone switches, and by the first and last of that month's offsets that it allows. Rows are
    summed by these before they meet the histories, so what meets them is bounded by keys, stretches and offsets.
    """
    spark = df.sparkSession
    histories = zone_histories(spark, zones)
    listed = [s for h in histories for s in (h.starts[:1] + h.starts[-1:])] or [0]
    first, last = (time.gmtime(f(listed)) for f in (min, max))
    rows = df.select(key, local, instant, span).dropna()
    # nothing switches before the first month; after the last listed year the calendar and with it the rules repeat every 400 years
    cycles = F.greatest(F.lit(0), F.floor((F.year(local) - (last.tm_year + 1)) / 400)).cast("bigint")
    month = F.greatest((F.year(local) - cycles * 400) * 12 + F.month(local) - 1, F.lit(first.tm_year * 12 + first.tm_mon - 2)).cast("int")
    second = seconds_ntz(F.col(local))
    placed = rows.select(key, month.alias("_m"), (second - cycles * (146097 * 86400)).alias("_s"), (second - F.col(instant)).alias("_low"), F.col(span).alias("_span"))
    months = sorted(r[0] for r in placed.select("_m").distinct().collect())
    layouts, members = _month_tables(histories, months)
    layout = spark.createDataFrame(layouts, "_m int, _points array<bigint>, _offsets array<bigint>, _kinds array<array<int>>")
    member = spark.createDataFrame(members, "_m int, _kind int, _ats array<int>")
    names = spark.createDataFrame([(h.at, h.zone) for h in histories], "_at int, zone string")

    asked = placed.join(F.broadcast(layout.drop("_kinds")), "_m").select(
        key, "_m", _below("_points", F.col("_s") + 1).alias("_cell"), _below("_offsets", F.col("_low")).alias("_i"), _below("_offsets", F.col("_low") + F.col("_span")).alias("_j"), F.size("_offsets").alias("_all")
    )
    none, every = F.col("_i") >= F.col("_j"), (F.col("_i") == 0) & (F.col("_j") == F.col("_all"))  # such rows tell no zones apart
    told = [F.when(~none & ~every, F.col(c)).alias(c) for c in ("_m", "_cell", "_i", "_j")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.select(key, *told, (every & ~none).alias("_sure")).groupBy(key, "_m", "_cell", "_i", "_j", "_sure").agg(F.count("*").alias("_n"))
    asked = durable(asked.repartition(parts, key, "_m"))  # few bytes, but many kinds to meet: spread over all tasks
    totals = asked.groupBy(key).agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("_sure"), F.col("_n")).otherwise(0)).alias("_sure"))
    met = asked.where("_m is not null").join(F.broadcast(layout.select("_m", "_kinds")), "_m").select(key, "_m", "_cell", "_i", "_j", "_n", F.posexplode("_kinds").alias("_kind", "_k"))
    offset = F.get("_k", F.col("_cell"))
    kinds = met.where((offset >= F.col("_i")) & (offset < F.col("_j"))).groupBy(key, "_m", "_kind").agg(F.sum("_n").alias("_n"))
    fits = kinds.join(F.broadcast(member), ["_m", "_kind"]).select(key, F.explode("_ats").alias("_at"), "_n").groupBy(key, "_at").agg(F.sum("_n").alias("_n"))
    # the zone named first stands for those that no such row fits
    fits = fits.unionByName(totals.select(key, F.lit(0).alias("_at"), F.lit(0).cast("bigint").alias("_n")))
    best = fits.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_at").alias("at"))).alias("_b"))
    found = totals.join(best, key).withColumn("_at", F.col("_b.at")).join(F.broadcast(names), "_at")
    return found.select(key, "zone", "rows", (F.col("rows") - F.col("_sure") + F.col("_b.n")).alias("violations"))


def normalise_times(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, field, utc_s) of every real date stated in ``docs.date_orig`` and ``docs.timestamp``.

    ``sources`` has collection_id, home_zone (may be null: then it is estimated among all zones of the time zone database) and day_order. Rows of docs that are equal
    in these columns count once; null, blank and unreal values give no row; a doc of an unknown collection is read as UTC,
    month first. Other columns are ignored.
    """
    rows = docs.select("id", "timestamp", "year", "date_orig", "collection_id")
    places = sources.select("collection_id", F.col("home_zone").alias("_home"), (F.col("day_order") == "dmy").alias("_dmy"))
    known = rows.join(places, "collection_id", "left")
    parsed = parse_stated(known, "date_orig", F.coalesce("_dmy", F.lit(False)), F.col("year"))
    # read twice below; materialised, each text is parsed once and its expressions aren't copied into every later predicate
    stated = durable(parsed.select("id", "timestamp", "year", "collection_id", "_home", "local", "offset", "instant", "span"))
    stated_zones = [r[0] for r in sources.select("home_zone").where("home_zone is not null").groupBy("home_zone").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "home_zone").collect()]
    unknown = sources.where("home_zone is null").select("collection_id")
    zoned = stated.withColumn("_guess", F.lit(None).cast("string"))
    if not unknown.isEmpty():  # the rows of a source that states its zone need no estimate
        exact = stated.join(F.broadcast(unknown), "collection_id", "left_semi").where("local is not null and offset is null and timestamp is not null").select(
            "id", "collection_id", "local", epoch_seconds(F.col("timestamp"), F.col("year"), F.lit("UTC")).alias("instant"), "span"
        )
        zones = known_zones(docs.sparkSession, stated_zones)
        guessed = estimate_zones(exact.distinct(), "collection_id", "local", "instant", "span", zones).select("collection_id", F.col("zone").alias("_guess"))
        zoned = stated.join(F.broadcast(guessed), "collection_id", "left")
    zoned = zoned.withColumn("zone", F.coalesce("_home", "_guess", F.lit("UTC")))
    from_text = F.coalesce(
        F.col("instant"),
        F.when(F.col("offset").isNotNull(), seconds_ntz(F.col("local")) - F.col("offset") * 60),
        local_to_utc(F.col("local"), F.col("zone")),
    )
    both = F.array(
        F.struct(F.lit("date_orig").alias("field"), from_text.cast("bigint").alias("utc_s")),
        F.struct(F.lit("timestamp").alias("field"), epoch_seconds(F.col("timestamp"), F.col("year"), F.col("zone")).alias("utc_s")),
    )
    return zoned.select("id", F.explode(both).alias("v")).select("id", "v.field", "v.utc_s").where("utc_s is not null").distinct()
