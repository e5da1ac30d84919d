from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stackroom.operators import activity as a

R = "created_at timestamp, updated_at timestamp, completed_on timestamp, user_id bigint, slug string, position string, percentage int"
H = "created_at timestamp, updated_at timestamp, user_id bigint, slug string, shared_by_id bigint, comment string"
CH = "user_id bigint, slug string, position string, percentage int, at timestamp"


def ts(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def empty(spark):
    return spark.createDataFrame([], R)


def upsert(spark, df, *changes):
    for c in changes:
        df = a.upsert_positions(df, spark.createDataFrame([c], CH))
    return df


def test_upsert_golden(spark):
    got = lambda *c: rows(upsert(spark, empty(spark), *c), "slug", "position", "percentage")
    assert got((1, "slug-a", "cfi-here", 0, ts(1))) == [("slug-a", "cfi-here", 0)]
    assert got((1, "slug-b", "only-pos", None, ts(1))) == [("slug-b", "only-pos", 0)]
    assert got((1, "slug-d", "cfi-1", 60, ts(1)), (1, "slug-d", "cfi-2", None, ts(2))) == [("slug-d", "cfi-2", 60)]
    assert got((2, "slug-c", "cfi-1", 50, ts(1)), (2, "slug-c", "cfi-2", 50, ts(2))) == [("slug-c", "cfi-2", 50)]
    assert got((1, "e", "x", 70, ts(1)), (1, "e", "", None, ts(2))) == [("e", "", 0)]
    assert got((1, "c", "x", 150, ts(1)))[0][2] == 100


def test_latest_page_golden(spark):
    df = upsert(spark, empty(spark), (1, "a", "x", 42, ts(1)), (1, "b", "x", 0, ts(2)), (1, "c", "x", 150, ts(3)))
    docs = spark.createDataFrame([(s, s, 1.0) for s in "abc"], "slug string, title string, words double")
    page = [(r["slug"], r["percentage"]) for r in a.in_progress(df, docs, 1).orderBy(F.col("updated_at").desc()).collect()]
    assert page == [("c", 100), ("b", 0), ("a", 42)]
    assert a.in_progress(df, docs.where("slug = 'a'"), 1).count() == 1 and df.count() == 3


def test_latest_state_wins(spark):
    r = [
        (ts(0), ts(5), None, 1, "x", "new", 50), (ts(0), ts(1), ts(9), 1, "x", "old", 20), (ts(0), ts(5), None, 1, "x", "new", 50),
        (None, None, None, None, None, None, None), (ts(0), None, None, 2, "y", None, None),
    ]
    assert rows(a.latest_readings(spark.createDataFrame(r, R)), "user_id", "slug", "position") == sorted([(1, "x", "new"), (None, None, None), (2, "y", None)], key=repr)
    h = [(ts(0), ts(1), 1, "x", None, "a"), (ts(0), ts(2), 1, "x", 7, "b"), (None, None, 1, "x", None, None)]
    assert rows(a.latest_highlights(spark.createDataFrame(h, H)), "comment", "shared_by_id") == [("b", 7)]


def test_touch_and_completion(spark):
    df = upsert(spark, empty(spark), (1, "a", "x", 10, ts(1)))
    opened = spark.createDataFrame([(1, "a", ts(5)), (1, "b", ts(6)), (1, "b", ts(7))], "user_id bigint, slug string, at timestamp")
    out = a.touch(df, opened)
    assert rows(out, "slug", "updated_at") == [("a", ts(1)), ("b", None)]
    done = a.set_completed(out, 1, "a", "2024-02-02 00:00:00", "2024-03-01 00:00:00")
    assert rows(done, "slug", "completed_on", "updated_at")[0] == ("a", dt.datetime(2024, 2, 2), ts(1))
    assert a.set_completed(done, 1, "a", None, "x").where("completed_on IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        a.set_completed(out, 1, "a", "2025-01-01", "2024-03-01")
    flip = a.toggle_completed(done, 1, "a", "2024-03-01 00:00:00")
    assert flip.where("completed_on IS NOT NULL").count() == 0 and a.toggle_completed(flip, 1, "b", "2024-03-01 00:00:00").where("completed_on IS NOT NULL").count() == 1


def test_highlights_and_cascades(spark):
    h = spark.createDataFrame([(ts(0), None, 1, "a", None, "mine")], H)
    new = spark.createDataFrame([(ts(1), None, 1, "a", 2, "again"), (ts(2), None, 3, "a", 2, "late"), (ts(1), None, 3, "a", 2, "first"), (ts(1), None, 0, "a", 2, "nobody")], H)
    out = a.insert_highlights(h, new)
    assert rows(out, "user_id", "comment") == [(1, "mine"), (3, "first")]
    docs = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, title string")
    d, r, left = a.delete_documents(docs, empty(spark), out, spark.createDataFrame([("a",), ("a",)], "slug string"))
    assert (d.count(), r.count(), left.count()) == (1, 0, 0)
    assert rows(a.has_document(out, docs, 3), "slug") == [("a",)]


def test_statistics(spark):
    r = [(ts(0), ts(0), dt.datetime(y, 5, 1), 1, s, None, 100) for y, s in ((2022, "a"), (2022, "ghost"), (2023, "a"))]
    docs = spark.createDataFrame([("a", 25000.0)], "slug string, words double")
    got = rows(a.completed_stats(spark.createDataFrame(r, R), docs, 1, 250.0), "year", "document_count", "words", "reading_time")
    assert got == [(0, 3, 50000.0, "3h 20m"), (2022, 2, 25000.0, "1h 40m"), (2023, 1, 25000.0, "1h 40m")]
    assert rows(a.completed_stats(empty(spark), docs, 1, 250.0), "year", "document_count", "reading_time") == [(0, 0, "")]
    assert rows(a.completed_years(spark.createDataFrame(r, R), 1, 2023), "year") == [(2022,)]


USERS = "id bigint, uuid string, name string, username string, email string, role int, words_per_minute double, private_profile int, language string, last_request timestamp"


def test_users(spark):
    u = spark.createDataFrame(
        [(1, "u", "Ann", "ann_1", "ann@x.org", 1, 250.0, 0, "es", None), (2, "v", None, "bad name!", "nope", None, 0.0, 1, "xx", None), (3, "w", "Cy", "cy", "cy@x.org", 1, 100.0, 0, None, None)], USERS
    )
    bad = {r["id"]: r["problems"] for r in a.user_problems(u).collect()}
    assert bad[1] == [] and bad[2] == ["name", "username_letters", "words_per_minute", "email", "role"]
    assert rows(a.filter_users(u, "AN"), "id") == [(1,)] and rows(a.filter_users(u, "c_"), "id") == [(3,)]
    assert rows(a.share_recipients(u), "id") == [(1,), (3,)]
    h = spark.createDataFrame([(ts(0), None, 3, "a", None, None)], H)
    assert rows(a.new_recipients(u, h, "a", 9), "id") == [(1,)]
    assert rows(a.recipients_by_language(u, ["es"]), "language") == [("en",), ("es",)]
    assert rows(a.replace_by(u, u.where("id = 1").withColumn("name", F.lit("Bea")), ["id"], "last_request"), "name") == sorted([("Bea",), (None,), ("Cy",)], key=repr)
    inv = spark.createDataFrame([(1, ts(1)), (2, ts(9))], "id bigint, valid_until timestamp")
    assert rows(a.valid_invitations(inv, "2024-01-01 05:00:00"), "id") == [(2,)]
    arr = F.array(*[F.lit(x) for x in ("a@x", "A@x", "b@x", "a@x")])
    one = spark.range(1).select(a.distinct_keeping_order(arr, False).alias("x"), a.distinct_keeping_order(arr, True).alias("i")).first()
    assert one["x"] == ["a@x", "A@x", "b@x"] and one["i"] == ["a@x", "b@x"]


def test_lists_and_decoration(spark):
    h = spark.createDataFrame([(ts(i), None, 1, s, by, "") for i, (s, by) in enumerate((("a", None), ("b", 2), ("ghost", None)))], H)
    docs = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, title string")
    users = spark.createDataFrame([(2, "Bo")], "id bigint, name string")
    n = lambda k: rows(a.highlight_list(h, docs, users, 1, k), "slug", "shared_by")
    assert n("all") == [("a", None), ("b", "Bo")] and n("own") == [("a", None)] and n("shared") == [("b", "Bo")] and n("other") == n("all")
    r = spark.createDataFrame([(ts(0), ts(0), ts(3), 1, "b", None, 100)], R)
    assert rows(a.decorate(docs, h, r, 1), "slug", "highlighted", "completed_on") == [("a", True, None), ("b", True, ts(3))]
    c = rows(a.activity_counts(r, h), "user_id", "in_progress", "completed", "highlights", "shared")
    assert c == [(1, 0, 1, 3, 1)]
