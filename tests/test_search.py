from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stackroom.functions.text import tokens
from stackroom.operators import catalog, related, search
from stackroom.operators.ingest import build_catalogue

EPUB = (
    "path string, title array<string>, creator array<struct<full_name:string,role:string>>, contributor array<struct<full_name:string,role:string>>, "
    "description array<string>, language array<string>, subject array<string>, date array<struct<stamp:string,event:string>>, series string, series_index string"
)


def record(path, title, author, lang="en", subjects=(), date=None, desc="", series=None, index=None):
    return (path, [title], [(author, "aut")], [], [desc], [lang], list(subjects), [(date, "publication")] if date else [], series, index)


def library(spark, rows, **cols):
    df = build_catalogue(spark.createDataFrame(rows, EPUB))
    for name, (by, kind) in cols.items():
        m = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])
        df = df.withColumn(name, F.coalesce(F.try_element_at(m, F.col("title")), F.lit(0)).cast(kind))
    for c, t in (("words", "double"), ("illustrations", "int")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0).cast(t))
    return df


@pytest.fixture(scope="module")
def lib(spark):
    rows = [
        record("a", "El infinito", "Juan Pérez", "es"), record("b", "Le livre", "Benoît Roche", "fr"), record("c", "Way Station", "Clifford D. Simak"),
        record("d", "L.A. Noir", "James Ellroy"), record("e", "La Guerrera", "Ana Luz", "es"), record("f", "Fratelli", "Ugo Neri", "it"),
        record("g", "El Infinito en un Junco", "Irene Vallejo", "es"), record("h", "Últimos días en Colditz", "Pat Reid", "es"), record("i", "Sin nombre", "&", "es"),
    ]
    return library(spark, rows).cache()


@pytest.mark.parametrize(
    ("words", "path"),
    [
        ("perez", "a"), ("benoit", "b"), ("clifford simak", "c"), ("james ellroy", "d"), (" james       ellroy ", "d"), ("guerrero", "e"), ("fratello", "f"),
        ("infinito junco", "g"), ("ultimos", "h"), ("sin nombre", "i"), ("irene junco", "g"),
    ],
)
def test_golden_keywords(lib, words, path):
    assert [r["id"] for r in search.search(lib, search.SearchFields(keywords=words)).collect()] == [path]


def test_modes(lib):
    ids = lambda k: sorted(r["id"] for r in search.search(lib, search.SearchFields(keywords=k)).collect())
    assert ids("") == list("abcdefghi")
    assert ids("AuthorsSlugs:juan-perez,pat%2Dreid") == ["a", "h"]
    assert ids("Title:infinito") == ["a", "g"] and ids("Title:infinito -Authors:Irene") == ["a"]
    assert ids('"way station"') == ["c"] and ids("Title:infin*") == ["a", "g"]
    assert ids("nothing at all") == []
    assert ids("Title:infinitu~") == ["a", "g"] and ids("Title:/infini.o/") == ["a", "g"] and ids("Title:juncos~0") == []
    assert sorted(r["id"] for r in lib.where(search.query_string("+Words:>=0 -Words:>0")).collect()) == list("abcdefghi")
    assert lib.where(search.query_string("Words:>5")).count() == 0 and lib.where(search.query_string("Title:way^3")).count() == 1


def test_language_and_subjects(spark):
    df = library(spark, [record("1", "English Book", "A", "en", ["Fiction"]), record("2", "Spanish Book", "B", "es_MX", ["Fiction"]), record("3", "French Book", "C", "fr", ["Fiction"])])
    n = lambda **k: search.search(df, search.SearchFields(**k)).count()
    assert [n(keywords="book", language="es"), n(keywords="book", language="en"), n(subjects="Fiction"), n(subjects="fiction,", language="fr"), n(subjects="Fiction, Other")] == [1, 1, 3, 1, 0]


def test_date_sorts_and_ranges(spark):
    df = library(spark, [record(str(i), f"T{i}", f"A{i}", date=d) for i, d in enumerate(["1800-01-01", "1900-06-15", "2000-12-31", "2023-03-20", None])])
    ids = lambda **k: [r["id"] for r in search.search(df, search.SearchFields(**k)).collect()]
    assert ids(sort="pub-date-older-first") == ["4", "0", "1", "2", "3"] and ids(sort="pub-date-newer-first") == ["3", "2", "1", "0", "4"]
    f, t = search.iso_days("1900-01-01"), search.iso_days("2000-12-31")
    assert ids(published_from=f, published_to=t) == ["1"] and ids(published_from=t, published_to=f) == ["1"]
    assert ids(published_to=f) == ["0", "4"]


def test_words_and_illustrations(spark):
    words = {"a": 1000.0, "b": 5000.0, "c": 15000.0, "d": 50000.0, "e": 0.0}
    df = library(spark, [record(k, k, k) for k in words], words=(words, "double"), illustrations=({"a": 0.0, "b": 2.0, "c": 5.0}, "int"))
    ids = lambda **k: [r["id"] for r in search.search(df, search.SearchFields(**k)).collect()]
    assert ids(sort="est-read-time-shorter-first") == list("eabcd") and ids(sort="est-read-time-longer-first") == list("dcbae")
    assert ids(hours_from=1, hours_to=3, words_per_minute=200) == ["c"]
    assert sorted(ids(illustrated_only=True, illustrated_min=2)) == ["b", "c"] and len(ids(illustrated_only=True, illustrated_min=0)) == 5


def test_related_golden(spark):
    rows = [
        record("1", "Test A", "Pedro Pérez", subjects=["History", "Middle age"], date="2010-10-01"), record("2", "Test B", "John Thompson", subjects=["History", "Middle age"], date="2014-03-05"),
        record("3", "Test C", "Isaac Asimov", subjects=["History", "Middle age"], date="2011-05-14"), record("4", "Test D", "Alexandre Dumas", subjects=["Novel", "Adventures"], date="1845-05-14"),
        record("5", "Test E", "Giacomo Leopardi", subjects=["History"], date="2010-11-05"), record("6", "Test F", "Marco Polo", subjects=["History", "Middle age"]),
    ]
    df = library(spark, rows)
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(related.same_subjects(df, "isaac-asimov-test-c")) == ["1", "2", "6", "5"]
    assert sorted(ids(related.same_subjects(df, "marco-polo-test-f"))) == ["1", "2", "3", "5"] and ids(related.same_subjects(df, "marco-polo-test-f"))[-1] == "5"
    assert ids(related.same_subjects(df, "none")) == [] and ids(related.same_authors(df, "isaac-asimov-test-c")) == [] and ids(related.same_series(df, "isaac-asimov-test-c")) == []


def test_series_and_authors(spark):
    df = library(spark, [record(str(i), f"V{i}", "Ann Lee", series="The Ring" if i < 3 else None, index=str(3 - i)) for i in range(5)])
    assert [r["id"] for r in related.same_series(df, "ann-lee-v0").collect()] == ["2", "1"]
    assert [r["id"] for r in related.same_authors(df, "ann-lee-v0").collect()] == ["3", "4"] or sorted(r["id"] for r in related.same_authors(df, "ann-lee-v0").collect()) == ["3", "4"]
    assert catalog.browse_author(df, "ann-lee").count() == 5 and catalog.browse_series(df, "the-ring").count() == 3 and catalog.browse_series(df, "").count() == 0


def test_postings_equal_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    postings, stats = search.build_postings(docs, "doc_id", {"text": F.col("text")})
    a = {r["doc_id"]: r["score"] for r in search.search_postings(postings, stats, "doc_id", "text", "lantern harbour").collect()}
    b = {r["doc_id"]: r["score"] for r in search.bm25(docs, F.col("text"), "lantern harbour").collect()}
    assert a == b and a
    assert search.bm25(docs, F.col("text"), " ").count() == 0 and search.search_postings(postings, stats, "doc_id", "text", "zzzz").count() == 0


def test_term_counts_equal_tokens(spark):
    texts = ["Straße, STRASSE strasse", "Œuvre œuvre oeuvre oeuvres", "Último ULTIMO últimos", "a.b", "ÆTHER aether x-æther", "", None, "ultimo" * 3, "Łódź łodz lodz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for w in ("strasse", "oeuvre", "ultimo", "aether", "lodz", "b"):
        rows = df.select(search.term_count(F.col("t"), w).alias("a"), F.size(F.filter(tokens(F.col("t")), lambda x: x == F.lit(w))).alias("b")).collect()  # noqa: B023
        assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_filters_reach_the_scan(spark, sf_dir):
    df = catalog.with_slugs(spark.read.parquet(f"{sf_dir}/library_metadata.parquet"))
    for f in search.filters(search.SearchFields(language="en", hours_from=1)):
        df = df.where(f)
    plan = df.select("slug")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(language,en)" in plan and "GreaterThanOrEqual(words" in plan
    assert "description" not in plan.split("ReadSchema")[1]


def test_pages():
    assert catalog.page_bounds(0, 500) == (1, 100) and catalog.page_bounds(3, -1) == (3, 10)
    assert catalog.total_pages(21, 10) == 3 and catalog.clamp_page(9, 21, 10) == 3 and catalog.clamp_page(1, 0, 10) == 1
    assert catalog.page_navigator(1, 10) == [1, 2, 3, 4, 5] and catalog.page_navigator(9, 10) == [6, 7, 8, 9, 10] and catalog.page_navigator(1, 2) == [1, 2]


def test_request_arguments():
    s = search.parse_request({"search": "x", "pub-date-from": "2000-01-01", "pub-date-to": "1999-01-01", "illustrated-only": "on"})
    assert s.published_from < s.published_to and s.illustrated_only
    with pytest.raises(ValueError):
        search.parse_request({"pub-date-from": "soon"})


def test_empty_catalogue(spark):
    df = library(spark, [])
    assert search.search(df, search.SearchFields(keywords="x")).count() == 0
    assert catalog.facet_languages(df).count() == 0 and tokens(F.lit("")) is not None


def test_colons_in_keywords_are_scored(lib):
    got = lambda k, **a: {r["id"]: r["score"] for r in search.search(lib, search.SearchFields(keywords=k, **a)).collect()}
    assert got("way: station")["c"] == got("way station")["c"] > 0
    assert got("Title:way")["c"] > 0 and got("Title:way^3")["c"] == pytest.approx(3 * got("Title:way")["c"], abs=1e-5)
    assert got("Title:infinito Title:junco")["g"] > got("Title:infinito Title:junco")["a"] > 0
    assert got('"way station"')["c"] > 0 and got("Title:infin*")["a"] > 0 and got("AuthorsSlugs:juan-perez") == {"a": 0.0}
    assert got("Title:way", sort="number-asc") == {"c": 0.0}


def test_added_on_ranges(spark):
    df = spark.createDataFrame([(1, "2020-05-01 10:00:00"), (2, "2021-01-01 00:00:00"), (3, None)], "id int, at string").selectExpr("id", "CAST(at AS timestamp) AS added_on")
    ids = lambda q: sorted(r["id"] for r in df.where(search.query_string(q)).collect())
    assert ids('+AddedOn:>"2020-12-31"') == [2] and ids('+AddedOn:<="2020-05-01T10:00:00"') == [1] and ids('+AddedOn:>="2020-01-01" -AddedOn:>"2020-06-01"') == [1]


@pytest.fixture(scope="module")
def indexed(lib, tmp_path_factory):
    from stackroom.operators import index

    return index.build(lib, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize(
    "words",
    ["perez", "way: station", "fratello", "infinito junco", "irene junco", "ultimos", "the of", "&", "zzz", "Title:infinito", "Title:infinito -Authors:Irene", "+Title:way^2 +Authors:simak Title:x",
     "AuthorsSlugs:juan-perez,pat-reid", "SeriesSlug:none", "Title:infin*", '"way station"', "-Title:way", "Title:infinito junco", ""],
)
@pytest.mark.parametrize("sort", ["relevance", "pub-date-newer-first"])
def test_index_equals_scan(lib, indexed, words, sort):
    rows = lambda i: [(r["id"], r["score"]) for r in search.search(lib, search.SearchFields(keywords=words, sort=sort), i).collect()]
    assert rows(indexed) == rows(None)


def test_index_reads_the_terms_rows_only(lib, indexed):
    plan = search.search(lib, search.SearchFields(keywords="infinito junco"), indexed).select("slug", "score")._jdf.queryExecution().executedPlan().toString()
    assert "In(token, " in plan or "EqualTo(token" in plan
    assert "PartitionFilters: [" in plan


def test_index_of_nothing(spark, tmp_path):
    from stackroom.operators import index

    df = library(spark, [])
    i = index.build(df, str(tmp_path / "i"))
    assert i.documents == 0 and search.search(df, search.SearchFields(keywords="x"), i).count() == 0
