from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stackroom.functions import analyze, dates, people, text


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("stamp", "precision", "cent"),
    [
        ("-0579-00-00T00:00:00Z", 7, -6), ("-0004-00-00T00:00:00Z", 9, -1), ("+1547-09-29T00:00:00Z", 11, 16), ("1981-06-12T00:00:00Z", 11, 20),
        ("1980-00-00T00:00:00Z", 8, 20), ("+0000-01-01T00:00:00Z", 9, 1), ("+0001-01-01T00:00:00Z", 9, 1), ("+0100-01-01T00:00:00Z", 9, 1),
        ("+0101-01-01T00:00:00Z", 9, 2), ("-0001-01-01T00:00:00Z", 9, -1), ("-0100-01-01T00:00:00Z", 9, -1), ("-0101-01-01T00:00:00Z", 9, -2),
        ("+2024-02-29T00:00:00Z", 11, 21),
    ],
)
def test_century(spark, stamp, precision, cent):
    got = value(spark, dates.precision_date(F.lit(stamp), F.lit(precision)))
    assert got["precision"] == precision
    assert value(spark, dates.century(dates.stated_year(F.lit(stamp)))) == cent


@pytest.mark.parametrize(("stamp", "precision"), [("invalid-date", 11), ("2024-13-01T00:00:00Z", 11), ("2024-02-30T00:00:00Z", 11), ("2024-01-01T00:00:00Z", 999), ("", 11), ("20-02-01T00:00:00Z", 11)])
def test_zero_dates(spark, stamp, precision):
    assert tuple(value(spark, dates.precision_date(F.lit(stamp), F.lit(precision)))) == (0, 0)


def test_days_follow_the_calendar(spark):
    days = [dt.date(1, 1, 1), dt.date(4, 2, 29), dt.date(1900, 3, 1), dt.date(2000, 2, 29), dt.date(9999, 12, 31)]
    rows = spark.createDataFrame([(d.year, d.month, d.day) for d in days], "y int, m int, d int")
    got = [r[0] for r in rows.select(dates._days(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [(d - dt.date(1, 1, 1)).days for d in days]
    assert value(spark, dates.precision_date(F.lit("-0001-12-31T00:00:00Z"), F.lit(11)))["days"] == -367
    assert value(spark, dates.format_date(F.lit(730119), "en")) == "2000-01-01"
    assert value(spark, dates.format_date(F.lit(730119), "es")) == "01-01-2000"


def _days(text_):
    return (dt.date.fromisoformat(text_) - dt.date(1, 1, 1)).days


def test_age(spark):
    a = lambda b, bp, d, dp, now="2025-09-19": value(spark, dates.age(F.lit(b), F.lit(bp), F.lit(d), F.lit(dp), F.lit(now).cast("date")))
    assert a(_days("1915-12-07"), 11, _days("1978-03-18"), 11) == 62
    assert a(_days("1954-09-28"), 11, 0, 0) == 70
    assert a(_days("1954-01-01"), 9, 0, 0) == 0
    assert a(_days("1954-01-01"), 11, _days("1990-01-01"), 9) == 0


@pytest.mark.parametrize(("words", "wpm", "want"), [(24000, 200, "2h 0m"), (250 * 60 * 25, 250, "1d 1h 0m"), (0, 250, ""), (100, 0, ""), (125, 250, "0h 1m"), (None, 250, "")])
def test_reading_time(spark, words, wpm, want):
    assert value(spark, dates.reading_time(F.lit(words).cast("double"), F.lit(wpm).cast("double"))) == want


def test_dates_of_records(spark):
    entry = lambda *es: F.array(*[F.struct(F.lit(s).alias("stamp"), F.lit(e).alias("event")) for s, e in es])
    got = value(spark, dates.publication_date(entry(("2001-01-01", "creation"), ("2010-10-01", "publication"))))
    assert tuple(got) == (_days("2010-10-01"), 11)
    assert tuple(value(spark, dates.publication_date(entry(("1975", ""))))) == (_days("1975-01-01"), 9)
    assert tuple(value(spark, dates.publication_date(entry(("soon", ""))))) == (0, 0)
    assert tuple(value(spark, dates.pdf_date(F.lit("D:20210203120000+00'00'"), F.lit("")))) == (_days("2021-02-03"), 11)
    assert tuple(value(spark, dates.pdf_date(F.lit(""), F.lit("D:1999")))) == (_days("1999-01-01"), 9)


def test_slugs_and_lists(spark):
    assert value(spark, text.base_slug(F.array(F.lit("Pedro Pérez")), F.lit("Test A"))) == "pedro-perez-test-a"
    assert value(spark, text.slug(F.lit("  Ça & là – l’été! "))) == "ca-and-la-lete"
    assert value(spark, text.slug(F.lit("Bücher & Ägypten"), F.lit("de"))) == "bucher-und-agypten"
    assert value(spark, text.author_list(F.lit("A & B; C,, D"))) == ["A", "B", "C", "D"]
    assert value(spark, text.author_list(F.lit(" & "))) == [""]
    assert value(spark, text.subject_list(F.lit("x, y ;z;"))) == ["x", "y", "z"]
    assert value(spark, text.subject_name(F.lit("éCOLE"))) == "École"
    assert value(spark, text.file_title(F.lit(" "), F.lit("a/b/My book.epub"))) == "My book"
    assert value(spark, text.word_count(F.lit("<p>one two</p><p>three</p>"))) == 3
    assert value(spark, text.tokens(F.lit("  Última   NIEVE, 2x  "))) == ["ultima", "nieve", "2x"]
    assert value(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_sanitizer(spark):
    s = lambda t: value(spark, text.sanitize_description(F.lit(t)))
    assert s(" plain\ntext ") == "<p>plain</p><p>text</p>"
    assert s('<p onclick="x">a<script>bad()</script><div>b</div></p>') == "<p>ab</p>"


def test_people(spark):
    ill = lambda r: value(spark, people.is_illustrator(F.lit(r)))
    assert [ill(r) for r in ("ill", "http://id.example/relators/ART", "marc:ill", "Illustrator", "trl", "", None)] == [True, True, True, True, False, False, False]
    aut = lambda r, c: value(spark, people.is_author(F.lit(r), c))
    assert [aut("aut", False), aut("", True), aut("", False), aut(None, True), aut("edt", True)] == [True, True, False, True, False]
    assert value(spark, people.birth_name_includes(F.lit("Clifford Donald Simak"), F.lit("Clifford Simak")))
    assert not value(spark, people.birth_name_includes(F.lit("Erik Blair"), F.lit("George Orwell")))
    assert value(spark, people.pseudonyms(F.array(F.lit("a"), F.lit("b")), F.lit("b"))) == ["a"]
    assert value(spark, people.code_of(people.INSTANCES, F.lit("Q5"))) == 1
    assert value(spark, people.image_url(F.lit("A b.jpg"), "u")).endswith("/A_b.jpg")
    assert len(value(spark, people.password_hash(F.lit("x")))) == 32


@pytest.mark.parametrize(
    ("lang", "a", "b"),
    [("es", "guerrero", "guerrera"), ("it", "fratello", "fratelli"), ("es", "ultimos", "ultimo"), ("en", "markets", "market"), ("en", "relational", "relate"), ("fr", "forets", "foret"), ("de", "buchern", "bucher"), ("pt", "cancoes", "cancao")],
)
def test_stems_meet(lang, a, b):
    assert analyze.analyze_tokens([a], lang, True) == analyze.analyze_tokens([b], lang, True)


def test_analyzers(spark):
    assert analyze.analyze_tokens(["the", "running", "dogs"], "en", False) == ["run", "dog"]
    assert analyze.analyze_tokens(["l", "arbre"], "fr", True) == analyze.analyze_tokens(["arbre"], "fr", True)
    df = spark.createDataFrame([("La Guerrera", "es"), (None, "es"), ("x", None)], "t string, l string")
    assert [r[0] for r in df.select(analyze.analyzed(F.col("t"), F.col("l"), False)).collect()] == [["guerrer"], [], ["x"]]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("happy", "happi"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control")])
def test_porter(word, stem):
    assert analyze.STEM["en"](word) == stem
