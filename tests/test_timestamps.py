from __future__ import annotations

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from stackroom.operators.timestamps import normalise_stamps, notation_weights

SHELVES = [("berlin", "Europe/Berlin", True), ("york", "America/New_York", False), ("plain", None, None), ("utc", "UTC", False)]


def norm(spark, rows, sources=True):
    df = spark.createDataFrame([(i, s, src) for i, (s, src) in enumerate(rows)], "info_id bigint, stamp string, shelf string")
    src = spark.createDataFrame(SHELVES, "shelf string, time_zone string, day_first boolean") if sources else None
    got = {r["info_id"]: r for r in normalise_stamps(df, "info_id", "stamp", "shelf", src).collect()}
    return [got[i] for i in range(len(rows))]


CASES = [
    ("2010", "2010"), (" 2011 ", "2011"), ("[1998]", "1998"), ("©1998", "1998"), ("(c) 1981", "1981"), ("cop. 1987", "1987"), ("c2008", "2008"), ("1950.", "1950"),
    ("Anno 2015", "2015"), ("MMIII", "2003"), ("MCMLXXXV", "1985"), ("MDCCCXCIX", "1899"),
    ("2010-11-00", "2010-11"), ("2010-00-00", "2010"), ("1931-00-00T00:00:00Z", "1931"), ("0000-00-00", None), ("0000", None), ("1983-02-30", None), ("2024-02-29", "2024-02-29"),
    ("1989/01", "1989-01"), ("09/1999", "1999-09"), ("1990/01/21", "1990-01-21"), ("19770422", "1977-04-22"), ("D:19470911", "1947-09-11"),
    ("27.02.1990", "1990-02-27"), ("3.9.2010", "2010-09-03"), ("04-Oct-1916", "1916-10-04"), ("Apr-1981", "1981-04"), ("SEPTEMBRE 1941", "1941-09"), ("août 2022", "2022-08"),
    ("21. Januar 1893", "1893-01-21"), ("24 de diciembre de 1998", "1998-12-24"), ("8 août 2022", "2022-08-08"), ("May 5, 1993", "1993-05-05"),
    ("08/05/1897", "1897-05-08"), ("04/19/1992", "1992-04-19"), ("31/31/2008", None),
    ("2021-03-11T15:50:29", "2021-03-11T14:50:29Z"), ("2012-01-06 12:02", "2012-01-06T11:02:00Z"), ("30.10.2011 03:34", "2011-10-30T02:34:00Z"),
    ("2021-03-28T20:00:00.161Z", "2021-03-28T20:00:00Z"), ("20091227T072934Z", "2009-12-27T07:29:34Z"), ("D:20230911235806", "2023-09-11T21:58:06Z"),
    ("D:20230320102542+05'30'", "2023-03-20T04:55:42Z"), ("2022-02-26T06:53:50+02:00", "2022-02-26T04:53:50Z"), ("2010-08-27 02:55:26 -0400", "2010-08-27T06:55:26Z"),
    ("Fri, 14 Jun 2024 07:41:56 +0900", "2024-06-13T22:41:56Z"), ("2013-05-13 13:14:07 EDT", "2013-05-13T17:14:07Z"), ("1700528989", "2023-11-21T01:09:49Z"), ("1489864150520", "2017-03-18T19:09:10Z"),
    ("December 13, 2015 7:05 PM", "2015-12-13T18:05:00Z"), ("August 5, 2020 12:10 AM", "2020-08-04T22:10:00Z"), ("August 5, 2020 12:10 PM", "2020-08-05T10:10:00Z"),
    # twice: the earlier; skipped: the offset before the change
    ("2016-10-30T02:30:00", "2016-10-30T00:30:00Z"), ("2016-03-27T02:30:00", "2016-03-27T01:30:00Z"),
    ("unknown", None), ("n.d.", None), ("-", None), ("", None), (None, None), ("x" * 100_000, None), ("2020-01-01T25:00:00", None), ("32 May 2001", None),
]


def test_notations(spark):
    got = norm(spark, [(s, "berlin") for s, _ in CASES])
    assert [(r["stamp"] and r["stamp"][:40], r["norm"]) for r in got] == [(s and s[:40], n) for s, n in CASES]
    assert all((r["status"] == "invalid") == (r["norm"] is None) for r in got)


def test_source_decides_slashes(spark):
    got = norm(spark, [("08/05/1897", "berlin"), ("08/05/1897", "york"), ("01/02/2020 23:30", "york"), ("08/05/1897", "nowhere")])
    assert [r["norm"] for r in got[:3]] == ["1897-05-08", "1897-08-05", "2020-01-03T04:30:00Z"]
    assert got[3]["status"] == "ambiguous" and got[3]["norm"] is not None


def test_values_alone_decide(spark):
    """Without a declared order the values that are valid one way only settle the others."""
    rows = [("25/12/2000", "a")] * 9 + [("12/25/2000", "b")] * 9 + [("03/04/2000", "a"), ("03/04/2000", "b"), ("03/04/2000", "c"), ("04/04/2000", "c")]
    got = norm(spark, rows, sources=False)
    assert [r["norm"] for r in got[18:20]] == ["2000-04-03", "2000-03-04"]
    assert got[20]["status"] == "ambiguous" and got[21]["status"] == "ok"


def test_weights_converge_to_the_share(spark):
    counts = spark.createDataFrame([("s", 30, 10, 100, None)], "src string, n_day int, n_month int, n_both int, prior double")
    w = notation_weights(counts, "src", "prior", rounds=200).first()["w_day"]
    assert abs(w - 31 / 42) < 0.01


def test_random_local_times_against_zoneinfo(spark):
    rng = random.Random(1)
    zone = ZoneInfo("Europe/Berlin")
    times = [dt.datetime(2000, 1, 1) + dt.timedelta(minutes=rng.randrange(12_000_000)) for _ in range(300)]
    times += [dt.datetime(y, 3, d, 2, 30) for y in range(2001, 2020) for d in (25, 26, 27, 28, 29, 30, 31)]
    got = norm(spark, [(t.strftime("%Y-%m-%d %H:%M:%S"), "berlin") for t in times])
    want = [t.replace(tzinfo=zone, fold=0).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for t in times]
    assert [r["norm"] for r in got] == want


@pytest.mark.parametrize("sources", [True, False])
def test_empty_table(spark, sources):
    assert norm(spark, [], sources) == []


def test_values_overrule_a_wrong_declaration(spark):
    """A shelf declared day first whose values are valid month first only is read month first."""
    got = norm(spark, [(f"0{1 + i % 9}/{13 + i % 16}/2001", "berlin") for i in range(300)] + [("03/04/2001", "berlin")] * 3)
    assert {r["norm"] for r in got[300:]} == {"2001-03-04"} and got[300]["p"] > 0.9 and got[300]["status"] == "ok"
    few = norm(spark, [("03/14/2001", "berlin"), ("03/04/2001", "berlin")])
    assert few[1]["norm"] == "2001-04-03"


def test_years_of_two_digits(spark):
    """The values of the source decide the order; the century stays open."""
    rows = [(f"{y:02d}-{m:02d}-{d:02d}", "plain") for y, m, d in ((99, 12, 31), (98, 1, 13), (45, 2, 20), (5, 6, 7))]
    rows += [("28/02/99", "utc"), ("30/01/04", "utc"), ("17/03/85", "utc"), ("01/02/03", "utc"), ("24.12.95", "york"), ("13/13/13", "utc"), ("28/02/99 10:30 +01:00", "utc")]
    rows += [("31/12/70", "utc")] * 20
    got = norm(spark, rows)
    assert [r["norm"] for r in got[:11]] == ["1999-12-31", "1998-01-13", "1945-02-20", "2005-06-07", "1999-02-28", "2004-01-30", "1985-03-17", "2003-02-01", "1995-12-24", None, "1999-02-28T09:30:00Z"]
    assert {r["status"] for r in got if r["norm"]} == {"ambiguous"}


def test_shared_zone_names(spark):
    """A zone name that stands for several offsets is read as the source's own where that is one of them."""
    df = spark.createDataFrame([(1, "2020-01-10 12:00:00 IST", "a"), (2, "2020-01-10 12:00:00 IST", "b"), (3, "2020-01-10 12:00:00 CST", "c"), (4, "2020-01-10 12:00:00 CET", "a"), (5, "2020-01-10 12:00:00 IST", "c")], "info_id bigint, stamp string, shelf string")
    src = spark.createDataFrame([("a", "Asia/Kolkata", True), ("b", "Europe/Berlin", True), ("c", "Asia/Shanghai", True)], "shelf string, time_zone string, day_first boolean")
    got = {r["info_id"]: (r["norm"][11:16], r["status"]) for r in normalise_stamps(df, "info_id", "stamp", "shelf", src).collect()}
    assert got == {1: ("06:30", "ok"), 2: ("11:00", "ok"), 3: ("04:00", "ok"), 4: ("11:00", "ok"), 5: ("06:30", "ambiguous")}
