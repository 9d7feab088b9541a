"""Registered queries cover their whole tables: every year, collection, n-gram and unit of time."""

from datetime import date, timedelta

from corpusloom import plans
from corpusloom.plans.common import BASE

Q = plans.queries()


def test_ranges_of_every_year(spark, data, duck, same):
    ranges = "r as (select year as range_year, min(id) as lo, max(id) as hi from d group by year)"
    same(Q["year_range_join"](spark, data), duck, f"{BASE}, {ranges} select range_year, count(*) as n from d join r on d.id between lo and hi group by range_year")
    years = {r["range_year"] for r in Q["year_range_join"](spark, data).collect()}
    assert min(years) < 2010 <= max(years)


def test_policies_of_every_ngram_and_collection(spark, data, duck):
    points = Q["policy_changepoints"](spark, data).cache()
    got = {(r["collection_id"], r["token"], r["year"]): (r["before"], r["after"]) for r in points.collect()}
    want = duck.sql(f"""{BASE},
        tm as (select distinct token from v where total > 100 and not regexp_matches(token, '(^| )([^ ]|[0-9]+)($| )')),
        sh as (select distinct id as unit_id, collection_id, year from d where coalesce(pages, 0) <= 5),
        c as (select collection_id, token, year, sum(tf) as cnt from p join sh using (unit_id) where unit = 'docs' and token in (select token from tm) group by all),
        st as (select collection_id, year, sum(total) as total from tot join sh using (unit_id) group by all),
        k as (select collection_id, token, cal.year from (select distinct collection_id from sh) cross join tm cross join cal),
        wn as (select collection_id, token, year, sum(coalesce(cnt, 0)) over l as b4, sum(coalesce(cnt, 0)) over r as af, sum(coalesce(total, 0)) over l as t1, sum(coalesce(total, 0)) over r as t2, count(*) over l as n1, count(*) over r as n2
            from k left join c using (collection_id, token, year) left join st using (collection_id, year)
            window l as (partition by collection_id, token order by year range between 4 preceding and 1 preceding), r as (partition by collection_id, token order by year range between 1 following and 4 following))
        select collection_id, token, year, cast(b4 as bigint), cast(af as bigint) from wn where n1 = 4 and n2 = 4 and t1 > 0 and t2 > 0""").fetchall()
    assert got == {(c, t, y): (b, a) for c, t, y, b, a in want}
    assert {len(t.split()) for _, t, _ in got} == {1, 2, 3}
    one = Q["policy_adoptions"](spark, data).collect()
    assert len(one) == len({(r["collection_id"], r["token"]) for r in one}) == len({(c, t) for c, t, _ in got})


def test_dates_of_every_unit(spark, data, duck):
    got = {r["id"]: (r["y"], r["day"]) for r in Q["timestamps_to_dates"](spark, data).collect()}
    stated = duck.sql("select distinct id, timestamp from docs where timestamp is not null").fetchall()
    assert set(got) == {i for i, _ in stated}
    large = {i: t for i, t in stated if abs(t) > 10**11}
    for i, t in large.items():
        s = t // (10**6 if abs(t) > 10**14 else 1000) + 21600
        assert got[i][1] == str(date(1970, 1, 1) + timedelta(days=s // 86400))
