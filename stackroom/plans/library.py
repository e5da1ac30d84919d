"""The core's queries over the library tables, each with its SQL twin."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import dates, people, text
from stackroom.operators import activity, catalog, index, ingest, related, search
from stackroom.plans.catalogue import query
from stackroom.plans.sqltext import BUSY, CAT, JOINED, MARK, MARKER, READ, all_terms_sql, any_term_sql, bm25_sql, fold_sql, slug_sql, toks
from stackroom.session import ensure_checkpoint_dir, table

WPM = 250.0
NOW = "2024-12-31 00:00:00"
KEYWORDS = "frozen lantern harbour"
TERMS = KEYWORDS.split()
SHOW = ["slug", "title"]


def cat(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_slugs(table(spark, d, "library_metadata"))


def busiest(df: DataFrame) -> int:
    """The user with most rows, the smallest of equals; -1 in an empty table."""
    top = df.where(F.col("user_id").isNotNull()).groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id").first()
    return top["user_id"] if top else -1


def readings(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    raw = table(spark, d, "readings")
    return activity.latest_readings(raw), busiest(raw)


def highlights(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    raw = table(spark, d, "highlights")
    return activity.latest_highlights(raw), busiest(raw)


# ---- search

_BM = f"WITH {bm25_sql('documents', 'text', TERMS, 'doc_id, lang')}"


def _bm25(spark: SparkSession, d: str, page: int) -> DataFrame:
    hits = search.bm25(table(spark, d, "documents"), F.col("text"), KEYWORDS)
    return catalog.page(hits.orderBy(F.col("score").desc(), "doc_id"), page).select("doc_id", "lang", "score")


@query("search_bm25_page1", f"{_BM} SELECT doc_id, lang, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def search_bm25_page1(spark, d):
    """Flagship: the ten best documents for three words."""
    return _bm25(spark, d, 1)


@query("search_bm25_page2", f"{_BM} SELECT doc_id, lang, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def search_bm25_page2(spark, d):
    return _bm25(spark, d, 2)


@query("search_bm25_all_scores", f"{_BM} SELECT doc_id, score FROM scored WHERE score > 0")
def search_bm25_all_scores(spark, d):
    return search.bm25(table(spark, d, "documents"), F.col("text"), KEYWORDS).select("doc_id", "score")


@query("search_postings_bm25", f"{_BM} SELECT doc_id, score FROM scored WHERE score > 0")
def search_postings_bm25(spark, d):
    """The same scores from an inverted index."""
    postings, stats = search.build_postings(table(spark, d, "documents"), "doc_id", {"text": F.col("text")})
    return search.search_postings(postings, stats, "doc_id", "text", KEYWORDS)


@query("search_bm25_language", f"{_BM} SELECT doc_id, score FROM scored WHERE score > 0 AND starts_with(lang, 'en') ORDER BY score DESC, doc_id LIMIT 10")
def search_bm25_language(spark, d):
    hits = search.bm25(table(spark, d, "documents"), F.col("text"), KEYWORDS).where(F.col("lang").startswith("en"))
    return catalog.page(hits.orderBy(F.col("score").desc(), "doc_id"), 1).select("doc_id", "score")


def _titles(spark, d, keep):
    return table(spark, d, "library_metadata").where(keep).select("file_id", "title")


@query("search_all_terms", f"SELECT file_id, title FROM library_metadata WHERE {all_terms_sql('title', ['the', 'last'])}")
def search_all_terms(spark, d):
    return _titles(spark, d, search.all_terms(text.tokens(F.col("title")), text.tokens(F.lit("the last"))))


@query("search_any_term", f"SELECT file_id, title FROM library_metadata WHERE {any_term_sql('title', ['map', 'river'])}")
def search_any_term(spark, d):
    return _titles(spark, d, search.any_term(text.tokens(F.col("title")), text.tokens(F.lit("Map, river"))))


@query("search_accent_insensitive", f"SELECT file_id, title FROM library_metadata WHERE {all_terms_sql('title', ['fabrica'])}")
def search_accent_insensitive(spark, d):
    return _titles(spark, d, search.all_terms(text.tokens(F.col("title")), text.tokens(F.lit("  FÁBRICA  "))))


@query("search_phrase", f"SELECT file_id, title FROM library_metadata WHERE contains(' ' || array_to_string({toks('title')}, ' ') || ' ', ' the last ')")
def search_phrase(spark, d):
    return _titles(spark, d, search.query_string('Title:"the last"'))


@query(
    "search_field_scoped",
    f"SELECT file_id, title FROM library_metadata WHERE {all_terms_sql('title', ['vol'])} AND NOT coalesce({all_terms_sql(JOINED('authors'), ['beatrice'])}, false)",
)
def search_field_scoped(spark, d):
    return _titles(spark, d, search.query_string("+Title:vol -Authors:Beatrice"))


@query("search_wildcard", f"SELECT file_id, title FROM library_metadata WHERE len(list_filter({toks('title')}, lambda t: regexp_matches(t, '^harb.*$'))) > 0")
def search_wildcard(spark, d):
    return _titles(spark, d, search.predicate("Title:harb*", [""]))


@query("search_fuzzy", f"SELECT file_id, title FROM library_metadata WHERE len(list_filter({toks('title')}, lambda t: levenshtein(t, 'harbor') <= 1)) > 0")
def search_fuzzy(spark, d):
    return _titles(spark, d, search.predicate("Title:harbor~1", [""]))


@query("search_regex", f"SELECT file_id, title FROM library_metadata WHERE len(list_filter({toks('title')}, lambda t: regexp_matches(t, '^(?:ma(p|rket))$'))) > 0")
def search_regex(spark, d):
    return _titles(spark, d, search.predicate("Title:/ma(p|rket)/", [""]))


@query("search_ranges", f"SELECT file_id, title FROM library_metadata WHERE words > 40000 AND illustrations <= 5 AND {all_terms_sql('title', ['the'])}")
def search_ranges(spark, d):
    return _titles(spark, d, search.query_string("+Title:the^2 +Words:>40000 +Illustrations:<=5"))


_COMPOSED = "last market"


def _composed_sql() -> str:
    q = _COMPOSED.split()
    legs = [all_terms_sql(JOINED(c), q) for c in ("authors", "illustrators")] + [all_terms_sql(c, q) for c in ("title", "series", "description")]
    both = f"({any_term_sql(JOINED('authors'), q)} AND {any_term_sql('title', q)})"
    return f"SELECT file_id, title FROM library_metadata WHERE {' OR '.join(legs)} OR {both}"


@query("search_composed", _composed_sql())
def search_composed(spark, d):
    return _titles(spark, d, search.composed(_COMPOSED, [""]))


@query("search_composed_analyzers")
def search_composed_analyzers(spark, d):
    """All analyzers of the languages present."""
    df = table(spark, d, "library_metadata")
    return _titles(spark, d, search.composed("últimos mercados", search.active_analyzers(df)))


for _lang, _words in {"en": "markets", "es": "mercado", "fr": "forêts", "de": "Gärtnereien", "it": "cortili", "pt": "canções"}.items():

    @query(f"search_stemmed_{_lang}")
    def _stemmed(spark, d, lang=_lang, words=_words):
        df = table(spark, d, "library_metadata").where(F.col("language").startswith(lang))
        hit = search.all_terms(search.analyzed(F.col("description"), lang, False), search.analyzed(F.lit(words), lang, False))
        return df.where(hit).select("file_id", "title")


@query(
    "search_author_slugs",
    f"WITH {CAT}, k AS (SELECT a AS key FROM cat, unnest(authors_slugs) u(a) GROUP BY a ORDER BY count(*) DESC, a LIMIT 2) "
    "SELECT slug, title FROM cat WHERE list_has_any(authors_slugs, (SELECT list(key) FROM k))",
)
def search_author_slugs(spark, d):
    c = cat(spark, d)
    keys = [r["a"] for r in c.select(F.explode("authors_slugs").alias("a")).groupBy("a").count().orderBy(F.col("count").desc(), "a").limit(2).collect()]
    return c.where(search.predicate("AuthorsSlugs:" + ",".join(keys), [""])).select(*SHOW)


@query(
    "search_series_slug",
    f"WITH {CAT}, k AS (SELECT series_slug AS key FROM cat WHERE series_slug <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT slug, title FROM cat WHERE series_slug = (SELECT key FROM k)",
)
def search_series_slug(spark, d):
    c = cat(spark, d)
    return c.where(search.predicate(f"SeriesSlug:{_top_series(c)}", [""])).select(*SHOW)


def _top_series(c: DataFrame) -> str:
    top = c.where("series_slug <> ''").groupBy("series_slug").count().orderBy(F.col("count").desc(), "series_slug").first()
    return top[0] if top else ""


def _top_author(c: DataFrame) -> str:
    top = c.select(F.explode("authors_slugs").alias("a")).groupBy("a").count().orderBy(F.col("count").desc(), "a").first()
    return top[0] if top else ""


@query("search_match_all", "SELECT count(*) AS hits FROM library_metadata")
def search_match_all(spark, d):
    return table(spark, d, "library_metadata").where(search.predicate("   ", [""])).agg(F.count(F.lit(1)).alias("hits"))


# ---- filters, sorts, pages

_D1980, _D2000 = search.iso_days("1980-01-01"), search.iso_days("2000-01-01")


def _filtered(name: str, where: str, request: search.SearchFields) -> None:
    @query(name, f"WITH {CAT} SELECT slug, title FROM cat WHERE {where}")
    def run(spark, d):
        c = cat(spark, d)
        for f in search.filters(request.normalised()):
            c = c.where(f)
        return c.select(*SHOW)


_filtered("filter_language_prefix", "starts_with(language, 'es')", search.SearchFields(language=" es "))
_filtered("filter_subjects_all", "list_has_all(subjects_slugs, ['poetry', 'maritime-history'])", search.SearchFields(subjects="Poetry, ,Maritime history"))
_filtered("filter_date_range", f"publication.days >= {_D1980} AND publication.days < {_D2000}", search.SearchFields(published_from=_D2000, published_to=_D1980))
_filtered("filter_date_before", f"publication.days < {_D1980}", search.SearchFields(published_to=_D1980))
_filtered("filter_read_time", "words >= 15000 AND words < 75000", search.SearchFields(hours_from=1, hours_to=5))
_filtered("filter_illustrated", "illustrations >= 2", search.SearchFields(illustrated_only=True, illustrated_min=2))
_filtered(
    "filter_combined", f"starts_with(language, 'en') AND list_contains(subjects_slugs, 'poetry') AND publication.days >= {_D1980} AND words < 75000",
    search.SearchFields(language="en", subjects="poetry", published_from=_D1980, hours_to=5),
)

_DAYS, _WORDS = "coalesce(publication.days, 0)", "coalesce(words, 0)"
_SERIES = f"coalesce({fold_sql('series')}, ''), coalesce(series_index, 0)"
for _name, _key, _order in (
    ("sort_oldest", "pub-date-older-first", _DAYS), ("sort_newest", "pub-date-newer-first", f"{_DAYS} DESC"),
    ("sort_shortest", "est-read-time-shorter-first", _WORDS), ("sort_longest", "est-read-time-longer-first", f"{_WORDS} DESC"),
    ("sort_series_number", "number-asc", "coalesce(series_index, 0)"), ("sort_series_number_desc", "number-desc", "coalesce(series_index, 0) DESC"),
):

    @query(_name, f"SELECT slug, title FROM library_metadata ORDER BY {_order}, slug LIMIT 10 OFFSET 10")
    def _sorted(spark, d, key=_key):
        return catalog.page(search.search(cat(spark, d), search.SearchFields(sort=key)), 2).select(*SHOW)


def _tf(w: str) -> str:
    body = f"concat_ws(' ', title, series, {JOINED('authors')}, {JOINED('illustrators')}, description)"
    return f"len(list_filter({toks(body)}, lambda t: t = '{w}'))"


@query(
    "search_request_page",
    f"WITH {CAT}, c AS (SELECT *, {_tf('last')} AS t0, {_tf('market')} AS t1 FROM cat), st AS (SELECT count(*)::DOUBLE AS n, "
    "sum(CASE WHEN t0 > 0 THEN 1 ELSE 0 END) AS d0, sum(CASE WHEN t1 > 0 THEN 1 ELSE 0 END) AS d1 FROM c) "
    "SELECT slug, title, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2), 6) AS score "
    f"FROM c, st WHERE starts_with(language, 'en') AND {all_terms_sql('title', ['last', 'market'])} "
    f"ORDER BY score DESC, {_SERIES}, slug LIMIT 10",
)
def search_request_page(spark, d):
    """A whole request: a field query with a language filter, scored, sorted by relevance, paged."""
    both = search.query_string("+Title:last +Title:market")
    hits = search.ranked(cat(spark, d), search.SearchFields(language="en", extra=[both]), "last market")
    return catalog.page(hits, 1).select(*SHOW, "score")


def _page_sql(catalogue: str, where: str, counts: list[tuple[str, float]]) -> str:
    """A page by relevance: the weights of `counts` (SQL of how often a term stands, boost) over the rows of `where`."""
    tf = ", ".join(f"{c} AS t{i}" for i, (c, _) in enumerate(counts))
    df = ", ".join(f"sum(CASE WHEN t{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(counts)))
    score = " + ".join(f"{b} * ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2)" for i, (_, b) in enumerate(counts))
    return (
        f"WITH {CAT}, c AS (SELECT *, {tf}, coalesce({where}, false) AS hit FROM {catalogue}), st AS (SELECT count(*)::DOUBLE AS n, {df} FROM c) "
        f"SELECT slug, title, round({score}, 6) AS score FROM c, st WHERE hit ORDER BY score DESC, {_SERIES}, slug LIMIT 10"
    )


def _count(column: str, w: str) -> str:
    return f"len(list_filter({toks(column)}, lambda t: t = '{w}'))"


def _unlabelled(c: DataFrame) -> DataFrame:
    """A library without language labels: the default analyzer alone."""
    return c.withColumn("language", F.lit(None).cast("string"))


def _or(*legs: str) -> str:
    return "(" + " OR ".join(f"coalesce({x}, false)" for x in legs) + ")"


_WORDS_HIT = _or(
    *[all_terms_sql(JOINED(c), _COMPOSED.split()) for c in ("authors", "illustrators")], *[all_terms_sql(c, _COMPOSED.split()) for c in ("title", "series", "description")],
    f"({any_term_sql(JOINED('authors'), _COMPOSED.split())} AND {any_term_sql('title', _COMPOSED.split())})",
)
_WORDS_SQL = _page_sql("cat", _WORDS_HIT, [(_tf("last"), 1.0), (_tf("market"), 1.0)])
_TITLES_SQL = _page_sql("cat", _or(all_terms_sql("title", ["last"]), all_terms_sql("title", ["market"])), [(_count("title", "last"), 1.0), (_count("title", "market"), 2.0)])
_FIELDS_SQL = _page_sql(
    "cat", f"NOT coalesce({all_terms_sql(JOINED('subjects'), ['poetry'])}, false) AND words > 40000", [(_count("title", "the"), 1.0)]
)


def _request(spark, d, keywords: str, index=None, c: DataFrame | None = None) -> DataFrame:
    hits = search.search(cat(spark, d) if c is None else c, search.SearchFields(keywords=keywords), index)
    return catalog.page(hits, 1).select(*SHOW, "score")


@query("search_keywords_colon", _WORDS_SQL)
def search_keywords_colon(spark, d):
    """Plain keywords with a colon in them, through search()."""
    return _request(spark, d, "last: market", c=_unlabelled(cat(spark, d)))


@query("search_title_terms", _TITLES_SQL)
def search_title_terms(spark, d):
    """A query string with a boost, scored by its fields, through search()."""
    return _request(spark, d, "Title:last Title:market^2")


@query("search_title_subjects_words", _FIELDS_SQL)
def search_title_subjects_words(spark, d):
    """A query string with an optional term, a forbidden subject and a range, through search()."""
    return _request(spark, d, "Title:the -Subjects:poetry +Words:>40000")


@query(
    "search_added_on",
    f"SELECT file_id, title FROM library_metadata WHERE added_on >= TIMESTAMP '2020-01-01' AND added_on < TIMESTAMP '2023-01-01' AND {all_terms_sql('title', ['the'])}",
)
def search_added_on(spark, d):
    return _titles(spark, d, search.query_string('+Title:the +AddedOn:>="2020-01-01" +AddedOn:<"2023-01-01"'))


_indexes: dict[tuple[str, str], object] = {}


def stored_index(spark: SparkSession, d: str):
    """The stored index of a data directory's catalogue, built once a session in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        folder = f"{ensure_checkpoint_dir(spark)}/index-{uuid4().hex}"
        _indexes[key] = index.build(cat(spark, d), folder)
    return _indexes[key]


@query("search_indexed_titles", _TITLES_SQL)
def search_indexed_titles(spark, d):
    """The same query string from the stored index."""
    return _request(spark, d, "Title:last Title:market^2", stored_index(spark, d))


@query("search_indexed_keywords", _WORDS_SQL)
def search_indexed_keywords(spark, d):
    """Plain keywords from a stored index."""
    c = _unlabelled(cat(spark, d))
    return _request(spark, d, _COMPOSED, index.build(c, f"{ensure_checkpoint_dir(spark)}/index-{uuid4().hex}"), c)


@query("search_indexed_analyzers")
def search_indexed_analyzers(spark, d):
    """Keywords through all analyzers of the languages present, from the stored index (tested against the scan)."""
    return _request(spark, d, "últimos mercados", stored_index(spark, d))


# ---- browsing, facets, counts


@query("document_by_slug", f"WITH {CAT} SELECT slug, title, language FROM cat WHERE slug = (SELECT min(slug) FROM library_metadata)")
def document_by_slug(spark, d):
    c = cat(spark, d)
    return catalog.by_slug(c, c.agg(F.min("slug")).first()[0]).select(*SHOW, "language")


@query("documents_by_slugs", f"WITH {CAT} SELECT slug, title FROM cat WHERE slug IN ((SELECT min(slug) FROM cat), (SELECT max(slug) FROM cat), 'no-such-slug')")
def documents_by_slugs(spark, d):
    c = cat(spark, d)
    ends = c.agg(F.min("slug"), F.max("slug")).first()
    return catalog.by_slugs(c, [ends[0], "", ends[1], "no-such-slug"]).select(*SHOW)


@query(
    "browse_author",
    f"WITH {CAT}, k AS (SELECT a FROM cat, unnest(authors_slugs) u(a) GROUP BY a ORDER BY count(*) DESC, a LIMIT 1) SELECT slug, title FROM cat "
    "WHERE list_contains(authors_slugs, (SELECT a FROM k)) OR list_contains(illustrators_slugs, (SELECT a FROM k))",
)
def browse_author(spark, d):
    c = cat(spark, d)
    return catalog.browse_author(c, _top_author(c)).select(*SHOW)


@query(
    "browse_series",
    f"WITH {CAT}, k AS (SELECT series_slug AS key FROM cat WHERE series_slug <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT slug, title, series_index FROM cat WHERE series_slug = (SELECT key FROM k)",
)
def browse_series(spark, d):
    c = cat(spark, d)
    return catalog.browse_series(c, _top_series(c)).select(*SHOW, "series_index")


@query("count_documents", "SELECT count(*) AS documents FROM library_metadata")
def count_documents(spark, d):
    return table(spark, d, "library_metadata").agg(F.count(F.lit(1)).alias("documents"))


@query("total_hits", f"SELECT count(*) AS hits FROM library_metadata WHERE {any_term_sql('title', ['map', 'river'])}")
def total_hits(spark, d):
    return search_any_term(spark, d).agg(F.count(F.lit(1)).alias("hits"))


@query("facet_languages", "SELECT DISTINCT substr(language, 1, 2) AS language FROM library_metadata WHERE language <> ''")
def facet_languages(spark, d):
    return catalog.facet_languages(table(spark, d, "library_metadata"))


@query(
    "facet_subjects",
    f"WITH o AS (SELECT file_id, unnest(subjects) AS s FROM library_metadata), q AS (SELECT file_id, {slug_sql('s')} AS subject_slug, "
    "upper(substr(trim(s), 1, 1)) || lower(substr(trim(s), 2)) AS name FROM o WHERE trim(s) <> '') "
    "SELECT subject_slug, array_to_string(list_sort(list_distinct(list(name))), '|') AS names, count(DISTINCT file_id) AS documents FROM q WHERE subject_slug <> '' "
    "GROUP BY subject_slug ORDER BY documents DESC, subject_slug LIMIT 10000",
)
def facet_subjects(spark, d):
    return catalog.facet_subjects(table(spark, d, "library_metadata")).withColumn("names", F.array_join("names", "|"))


@query("word_total", "SELECT coalesce(sum(words), 0) AS words FROM (SELECT slug FROM highlights WHERE slug IS NOT NULL) h JOIN library_metadata m USING (slug)")
def word_total(spark, d):
    keys = table(spark, d, "highlights").where("slug IS NOT NULL").select("slug")
    return catalog.word_total(table(spark, d, "library_metadata"), keys)


@query(
    "latest_added",
    f"SELECT slug, title, added_on FROM library_metadata WHERE added_on IS NOT NULL AND added_on <= TIMESTAMP '{NOW}' ORDER BY added_on DESC, slug LIMIT 6",
)
def latest_added(spark, d):
    return catalog.latest_added(table(spark, d, "library_metadata"), NOW).select(*SHOW, "added_on")


# ---- related documents


def _related_sql(kind: str, dated: bool, where: str | None = None) -> str:
    pick = "publication.days > 0" if dated else "coalesce(publication.days, 0) = 0"
    given, where = where, f"len(subjects_slugs) > 0 AND len(authors_slugs) > 0 AND {pick}"
    if kind == "authors_slugs":
        where = "list_contains(authors_slugs, (SELECT a FROM cat, unnest(authors_slugs) u(a) GROUP BY a ORDER BY count(*) DESC, a LIMIT 1))"
    where = given or where
    head = f"""WITH {CAT}, ref AS (SELECT * FROM cat WHERE {where} ORDER BY slug LIMIT 1),
 n AS (SELECT count(*)::DOUBLE AS n FROM cat), k AS (SELECT DISTINCT unnest({kind}) AS k FROM ref),
 df AS (SELECT k, (SELECT count(*) FROM cat WHERE list_contains({kind}, k))::DOUBLE AS d FROM k),
 s AS (SELECT c.slug, c.title, c.publication, c.series, c.series_index, c.authors_slugs, c.series_slug,
  round(sum(ln(1 + (n.n - df.d + 0.5) / (df.d + 0.5))), 6) AS score FROM cat c JOIN df ON list_contains(c.{kind}, df.k), n GROUP BY ALL),
 f AS (SELECT s.*, coalesce(s.publication.days, 0) AS dd, coalesce(ref.publication.days, 0) AS rd FROM s, ref WHERE s.slug <> ref.slug
  AND (ref.series_slug = '' OR s.series_slug <> ref.series_slug)"""
    if kind == "authors_slugs":
        return f"{head}) SELECT slug, title, score FROM f ORDER BY score DESC, {_SERIES}, slug LIMIT 4"
    head += " AND NOT list_has_any(s.authors_slugs, ref.authors_slugs))"
    if not dated:
        return f"{head} SELECT slug, title, score FROM f ORDER BY score DESC, slug LIMIT 4"
    o = "ORDER BY score DESC, abs(dd - rd), slug LIMIT 4"
    return (
        f"{head}, u AS ((SELECT * FROM f WHERE dd < rd {o}) UNION ALL (SELECT * FROM f WHERE dd >= rd {o})) SELECT slug, title, score FROM u {o}"
    )


def _ref(c: DataFrame, dated: bool) -> str:
    days = F.coalesce(F.col("publication.days"), F.lit(0))
    keep = (F.size("subjects_slugs") > 0) & (F.size("authors_slugs") > 0) & ((days > 0) if dated else (days == 0))
    row = c.where(keep).agg(F.min("slug")).first()
    return row[0] or ""


@query("same_subjects", _related_sql("subjects_slugs", True))
def same_subjects(spark, d):
    c = cat(spark, d)
    return related.same_subjects(c, _ref(c, True)).select(*SHOW, "score")


@query("same_subjects_undated", _related_sql("subjects_slugs", False))
def same_subjects_undated(spark, d):
    c = cat(spark, d)
    return related.same_subjects(c, _ref(c, False)).select(*SHOW, "score")


@query("same_authors", _related_sql("authors_slugs", True))
def same_authors(spark, d):
    c = cat(spark, d)
    mine = c.where(F.array_contains("authors_slugs", _top_author(c))).agg(F.min("slug")).first()
    return related.same_authors(c, mine[0] or "").select(*SHOW, "score")


@query(
    "same_series",
    f"WITH {CAT}, k AS (SELECT series_slug AS key FROM cat WHERE series_slug <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    "ref AS (SELECT min(slug) AS slug FROM cat WHERE series_slug = (SELECT key FROM k)) SELECT slug, title FROM cat "
    f"WHERE series_slug = (SELECT key FROM k) AND slug <> (SELECT slug FROM ref) ORDER BY {_SERIES}, slug LIMIT 4",
)
def same_series(spark, d):
    c = cat(spark, d)
    first = c.where(F.col("series_slug") == _top_series(c)).agg(F.min("slug")).first()[0]
    return related.same_series(c, first or "").select(*SHOW)


# ---- activity

_PCT = "greatest(0, least(100, coalesce(percentage, 0)))"


@query("readings_latest", f"WITH {READ} SELECT user_id, slug, percentage, position, completed_on FROM rd")
def readings_latest(spark, d):
    return readings(spark, d)[0].select("user_id", "slug", "percentage", "position", "completed_on")


@query(
    "reading_in_progress",
    f"WITH {READ}, p AS (SELECT * FROM rd WHERE user_id = {BUSY} AND completed_on IS NULL ORDER BY updated_at DESC NULLS LAST, slug LIMIT 10) "
    f"SELECT p.slug, m.title, m.words, {_PCT} AS percentage, p.updated_at FROM p JOIN library_metadata m ON p.slug = m.slug",
)
def reading_in_progress(spark, d):
    r, u = readings(spark, d)
    return activity.in_progress(r, table(spark, d, "library_metadata"), u)


@query("reading_in_progress_total", f"WITH {READ} SELECT count(*) AS total FROM rd WHERE user_id = {BUSY} AND completed_on IS NULL")
def reading_in_progress_total(spark, d):
    r, u = readings(spark, d)
    return r.where((F.col("user_id") == u) & F.col("completed_on").isNull()).agg(F.count(F.lit(1)).alias("total"))


@query(
    "reading_completed_page",
    f"WITH {READ}, p AS (SELECT * FROM rd WHERE user_id = {BUSY} AND completed_on BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '{NOW}' "
    "ORDER BY completed_on DESC, slug LIMIT 10 OFFSET 10) SELECT p.slug, m.title, m.words, p.completed_on FROM p JOIN library_metadata m ON p.slug = m.slug",
)
def reading_completed_page(spark, d):
    r, u = readings(spark, d)
    return activity.completed_page(r, table(spark, d, "library_metadata"), u, "2000-01-01 00:00:00", NOW, offset=10)


@query("completed_years", f"WITH {READ} SELECT DISTINCT year(completed_on) AS year FROM rd WHERE user_id = {BUSY} AND completed_on IS NOT NULL AND year(completed_on) <> 2024")
def completed_years(spark, d):
    r, u = readings(spark, d)
    return activity.completed_years(r, u, 2024)


@query(
    "completed_stats_by_year",
    f"WITH {READ}, x AS (SELECT year(rd.completed_on) AS y, m.words FROM rd LEFT JOIN library_metadata m ON rd.slug = m.slug WHERE user_id = {BUSY} AND completed_on IS NOT NULL), "
    "g AS (SELECT y AS year, count(*) AS document_count, coalesce(sum(words), 0) AS words FROM x GROUP BY y UNION ALL SELECT 0, count(*), coalesce(sum(words), 0) FROM x) "
    f"SELECT year, document_count, words, {dates.reading_time_sql('words', '250.0')} AS reading_time FROM g",
)
def completed_stats_by_year(spark, d):
    r, u = readings(spark, d)
    return activity.completed_stats(r, table(spark, d, "library_metadata"), u, WPM)


@query(
    "activity_counts",
    f"WITH {READ}, {MARK}, r AS (SELECT user_id, sum((completed_on IS NULL)::INT)::BIGINT AS a, sum((completed_on IS NOT NULL)::INT)::BIGINT AS b FROM rd GROUP BY user_id), "
    "h AS (SELECT user_id, count(*) AS c, sum((shared_by_id IS NOT NULL)::INT)::BIGINT AS e FROM hl GROUP BY user_id) SELECT coalesce(r.user_id, h.user_id) AS user_id, "
    "coalesce(a, 0) AS in_progress, coalesce(b, 0) AS completed, coalesce(c, 0) AS highlights, coalesce(e, 0) AS shared FROM r FULL JOIN h ON r.user_id = h.user_id "
    "WHERE coalesce(r.user_id, h.user_id) IS NOT NULL",
)
def activity_counts(spark, d):
    return activity.activity_counts(readings(spark, d)[0], highlights(spark, d)[0]).where("user_id IS NOT NULL")


for _kind, _where in (("all", "true"), ("own", "shared_by_id IS NULL"), ("shared", "shared_by_id IS NOT NULL")):

    @query(
        f"highlights_{_kind}",
        f"WITH {MARK}, p AS (SELECT * FROM hl WHERE user_id = {MARKER} AND {_where} ORDER BY created_at DESC NULLS LAST, slug LIMIT 10) "
        "SELECT p.slug, m.title, p.shared_by_id, u.name AS shared_by, p.comment, p.created_at FROM p JOIN library_metadata m ON p.slug = m.slug LEFT JOIN users u ON p.shared_by_id = u.id",
    )
    def _highlights(spark, d, kind=_kind):
        h, u = highlights(spark, d)
        return activity.highlight_list(h, table(spark, d, "library_metadata"), table(spark, d, "users"), u, kind)


@query(
    "search_decorated",
    f"WITH {READ}, {MARK}, p AS (SELECT slug, title FROM library_metadata WHERE {any_term_sql('title', ['map', 'river', 'last'])} ORDER BY slug LIMIT 10), "
    f"h AS (SELECT slug FROM hl WHERE user_id = {MARKER}), r AS (SELECT slug, completed_on FROM rd WHERE user_id = {MARKER} AND completed_on IS NOT NULL) "
    "SELECT p.slug, p.title, h.slug IS NOT NULL AS highlighted, r.completed_on FROM p LEFT JOIN h ON p.slug = h.slug LEFT JOIN r ON p.slug = r.slug",
)
def search_decorated(spark, d):
    h, u = highlights(spark, d)
    hit = search.any_term(text.tokens(F.col("title")), text.tokens(F.lit("map river last")))
    page = table(spark, d, "library_metadata").where(hit).select(*SHOW).orderBy("slug").limit(10)
    return activity.decorate(page, h, readings(spark, d)[0], u)


@query(
    "share_new_recipients",
    f"WITH {MARK}, k AS (SELECT slug FROM hl WHERE slug IS NOT NULL GROUP BY slug ORDER BY count(*) DESC, slug LIMIT 1) SELECT id, username, name FROM users "
    "WHERE private_profile = 0 AND id <> 1 AND NOT EXISTS (SELECT 1 FROM hl WHERE hl.user_id = users.id AND hl.slug = (SELECT slug FROM k))",
)
def share_new_recipients(spark, d):
    h, _ = highlights(spark, d)
    top = h.where("slug IS NOT NULL").groupBy("slug").count().orderBy(F.col("count").desc(), "slug").first()
    return activity.new_recipients(table(spark, d, "users"), h, top[0] if top else "", 1)


@query("documents_marked", f"SELECT slug, title FROM library_metadata m WHERE EXISTS (SELECT 1 FROM highlights h WHERE h.slug = m.slug AND h.user_id = {MARKER})")
def documents_marked(spark, d):
    raw = table(spark, d, "highlights")
    return activity.has_document(raw, table(spark, d, "library_metadata"), busiest(raw))


@query("users_filter", "SELECT id, name, email, username FROM users WHERE name ILIKE '%an%' OR email ILIKE '%an%' OR username ILIKE '%an%'")
def users_filter(spark, d):
    return activity.filter_users(table(spark, d, "users"), "an").select("id", "name", "email", "username")


@query("share_recipients", "SELECT id, username, name FROM users WHERE private_profile = 0")
def share_recipients(spark, d):
    return activity.share_recipients(table(spark, d, "users"))


@query(
    "recipients_by_language",
    "SELECT CASE WHEN language IN ('en', 'es', 'fr', 'de') THEN language ELSE 'en' END AS language, array_to_string(list_sort(list_distinct(list(email))), '|') AS emails FROM users WHERE email IS NOT NULL GROUP BY 1",
)
def recipients_by_language(spark, d):
    return activity.recipients_by_language(table(spark, d, "users"), ["en", "es", "fr", "de"]).withColumn("emails", F.array_join("emails", "|"))


@query(
    "invitees_registered",
    "SELECT upper(email) AS email FROM users i WHERE private_profile = 1 AND EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(i.email) AND u.role = 1)",
)
def invitees_registered(spark, d):
    u = table(spark, d, "users")
    return activity.registered_invitees(u.where("private_profile = 1").select(F.upper("email").alias("email")), u.where("role = 1"))


@query("admins_left", "SELECT count(*) AS admins FROM users WHERE role = 2 AND id <> 1")
def admins_left(spark, d):
    return activity.admins_left(table(spark, d, "users"), 1)


@query("distinct_people", "SELECT file_id, array_to_string(list_transform(list_filter(list_zip(p, range(1, len(p) + 1)), lambda z: list_position(l, lower(z[1])) = z[2]), lambda z: z[1]), '|') AS people FROM "
       "(SELECT file_id, list_concat(coalesce(authors, []), coalesce(illustrators, [])) AS p, list_transform(p, lambda x: lower(x)) AS l FROM library_metadata)")  # fmt: skip
def distinct_people(spark, d):
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("authors", none), F.coalesce("illustrators", none))
    return table(spark, d, "library_metadata").select("file_id", F.array_join(activity.distinct_keeping_order(both, True), "|").alias("people"))


_RULES = {
    "name": "length(coalesce(name, '')) BETWEEN 1 AND 50",
    "username_length": "length(coalesce(username, '')) BETWEEN 1 AND 20",
    "username_letters": r"regexp_matches(coalesce(username, ''), '^[A-z0-9_\-.]+$')",
    "words_per_minute": "coalesce(words_per_minute, 0) BETWEEN 1 AND 999",
    "email": r"regexp_matches(coalesce(email, ''), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AND length(coalesce(email, '')) <= 100",
    "role": "role IS NOT NULL AND role >= 1",
}


@query("user_problems", "SELECT id, coalesce(array_to_string([" + ", ".join(f"CASE WHEN NOT ({r}) THEN '{n}' END" for n, r in _RULES.items()) + "], '|'), '') AS problems FROM users")
def user_problems(spark, d):
    return activity.user_problems(table(spark, d, "users")).withColumn("problems", F.array_join("problems", "|"))


# ---- whole pages


@query(
    "home_page",
    f"WITH {READ}, l AS (SELECT slug FROM library_metadata WHERE added_on IS NOT NULL AND added_on <= TIMESTAMP '{NOW}' ORDER BY added_on DESC, slug LIMIT 6), "
    f"p AS (SELECT slug FROM rd WHERE user_id = {BUSY} AND completed_on IS NULL ORDER BY updated_at DESC NULLS LAST, slug LIMIT 10) "
    "SELECT 'count' AS section, count(*)::VARCHAR AS entry FROM library_metadata UNION ALL SELECT 'latest', slug FROM l UNION ALL SELECT 'reading', p.slug FROM p JOIN library_metadata m ON p.slug = m.slug",
)
def home_page(spark, d):
    """Number of documents, the latest ones, and what the user reads."""
    docs = table(spark, d, "library_metadata")
    r, u = readings(spark, d)
    count = docs.agg(F.count(F.lit(1)).cast("string").alias("entry")).select(F.lit("count").alias("section"), "entry")
    latest = catalog.latest_added(docs, NOW).select(F.lit("latest").alias("section"), F.col("slug").alias("entry"))
    reading = activity.in_progress(r, docs, u).select(F.lit("reading").alias("section"), F.col("slug").alias("entry"))
    return count.unionByName(latest).unionByName(reading)


@query(
    "author_page",
    f"WITH {CAT}, k AS (SELECT a FROM cat, unnest(authors_slugs) u(a) GROUP BY a ORDER BY count(*) DESC, a LIMIT 1) SELECT slug, title FROM cat "
    f"WHERE list_contains(authors_slugs, (SELECT a FROM k)) OR list_contains(illustrators_slugs, (SELECT a FROM k)) ORDER BY {_DAYS}, slug LIMIT 10",
)
def author_page(spark, d):
    """An author's documents, older first."""
    c = cat(spark, d)
    mine = catalog.browse_author(c, _top_author(c)).withColumn("score", F.lit(0.0))
    return catalog.page(mine.orderBy(*search.sort_keys("pub-date-older-first")), 1).select(*SHOW)


@query(
    "series_page",
    f"WITH {CAT}, k AS (SELECT series_slug AS key FROM cat WHERE series_slug <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT slug, title, series_index FROM cat WHERE series_slug = (SELECT key FROM k) ORDER BY coalesce(series_index, 0), slug LIMIT 10",
)
def series_page(spark, d):
    """A series by number."""
    c = cat(spark, d)
    mine = catalog.browse_series(c, _top_series(c)).withColumn("score", F.lit(0.0))
    return catalog.page(mine.orderBy(*search.sort_keys("number-asc")), 1).select(*SHOW, "series_index")


@query("document_page")
def document_page(spark, d):
    """A document's three related lists."""
    c = cat(spark, d)
    key = _ref(c, True)
    lists = {"subjects": related.same_subjects(c, key), "authors": related.same_authors(c, key), "series": related.same_series(c, key)}
    parts = [df.select(F.lit(k).alias("list"), "slug", "score") for k, df in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- changes

_AT = "TIMESTAMP '2025-01-01 00:00:00'"


def _changes(r: DataFrame) -> DataFrame:
    """Position updates made of the readings themselves: finished ones are opened again, one in three without a percentage."""
    pct = F.when(F.length("slug") % 3 == 0, F.lit(None).cast("int")).otherwise(F.col("percentage") + 7)
    pos = F.when(F.length("slug") % 5 == 0, "").otherwise("new")
    return r.where(F.col("completed_on").isNotNull()).select("user_id", "slug", pos.alias("position"), pct.alias("percentage"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("at"))


@query(
    "reading_upsert",
    f"WITH {READ} SELECT user_id, slug, CASE WHEN completed_on IS NULL THEN position WHEN length(slug) % 5 = 0 THEN '' ELSE 'new' END AS position, "
    f"CASE WHEN completed_on IS NULL THEN percentage WHEN length(slug) % 3 <> 0 AND percentage IS NOT NULL THEN greatest(0, least(100, percentage + 7)) "
    f"WHEN length(slug) % 5 = 0 THEN 0 ELSE coalesce(percentage, 0) END AS percentage, CASE WHEN completed_on IS NULL THEN updated_at ELSE {_AT} END AS updated_at "
    "FROM rd WHERE user_id IS NOT NULL AND slug IS NOT NULL",
)
def reading_upsert(spark, d):
    r = readings(spark, d)[0].where("user_id IS NOT NULL AND slug IS NOT NULL")
    return activity.upsert_positions(r, _changes(r)).select("user_id", "slug", "position", "percentage", "updated_at")


@query(
    "reading_touch",
    f"WITH {READ}, r AS (SELECT * FROM rd WHERE user_id IS NOT NULL AND slug IS NOT NULL), o AS (SELECT DISTINCT user_id, slug FROM highlights WHERE user_id IS NOT NULL AND slug IS NOT NULL) "
    f"SELECT user_id, slug, percentage, updated_at FROM r UNION ALL SELECT user_id, slug, 0, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = o.user_id AND r.slug = o.slug)",
)
def reading_touch(spark, d):
    r = readings(spark, d)[0].where("user_id IS NOT NULL AND slug IS NOT NULL")
    opened = table(spark, d, "highlights").where("user_id IS NOT NULL AND slug IS NOT NULL").select("user_id", "slug", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("at"))
    return activity.touch(r, opened).select("user_id", "slug", "percentage", "updated_at")


@query(
    "reading_toggle_complete",
    f"WITH {READ}, k AS (SELECT min(slug) AS k FROM rd WHERE user_id = {BUSY}) SELECT user_id, slug, CASE WHEN user_id = {BUSY} AND slug = (SELECT k FROM k) "
    f"THEN CASE WHEN completed_on IS NULL THEN {_AT} END ELSE completed_on END AS completed_on FROM rd",
)
def reading_toggle_complete(spark, d):
    r, u = readings(spark, d)
    key = r.where(F.col("user_id") == u).agg(F.min("slug")).first()[0] or ""
    return activity.toggle_completed(r, u, key, "2025-01-01 00:00:00").select("user_id", "slug", "completed_on")


@query(
    "highlight_insert_ignore",
    f"WITH {MARK}, h AS (SELECT user_id, slug, shared_by_id FROM hl WHERE user_id IS NOT NULL AND slug IS NOT NULL), n AS (SELECT DISTINCT user_id, slug FROM readings WHERE user_id > 0 AND slug IS NOT NULL) "
    "SELECT * FROM h UNION ALL SELECT user_id, slug, 1 FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = n.user_id AND h.slug = n.slug)",
)
def highlight_insert_ignore(spark, d):
    h = highlights(spark, d)[0].where("user_id IS NOT NULL AND slug IS NOT NULL")
    new = table(spark, d, "readings").where("slug IS NOT NULL").select(
        "created_at", F.lit(None).cast("timestamp").alias("updated_at"), "user_id", "slug", F.lit(1).cast("bigint").alias("shared_by_id"), F.lit("").alias("comment"))
    return activity.insert_highlights(h, new).select("user_id", "slug", "shared_by_id")


@query(
    "delete_document_cascade",
    "WITH g AS (SELECT slug FROM library_metadata WHERE words IS NULL OR words < 20000) SELECT 'documents' AS kind, count(*) AS n FROM library_metadata WHERE slug NOT IN (SELECT slug FROM g) "
    "UNION ALL SELECT 'readings', count(*) FROM readings r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.slug = r.slug) UNION ALL SELECT 'highlights', count(*) FROM highlights h WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.slug = h.slug)",
)
def delete_document_cascade(spark, d):
    docs = table(spark, d, "library_metadata")
    gone = docs.where("words IS NULL OR words < 20000").select("slug")
    left = activity.delete_documents(docs, table(spark, d, "readings"), table(spark, d, "highlights"), gone)
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in zip(("documents", "readings", "highlights"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "delete_user_cascade",
    "SELECT 'users' AS kind, count(*) AS n FROM users WHERE id > 100 UNION ALL SELECT 'readings', count(*) FROM readings WHERE user_id IS NULL OR user_id > 100 OR user_id NOT IN (SELECT id FROM users) "
    "UNION ALL SELECT 'highlights', count(*) FROM highlights WHERE user_id IS NULL OR user_id > 100 OR user_id NOT IN (SELECT id FROM users)",
)
def delete_user_cascade(spark, d):
    users = table(spark, d, "users")
    left = activity.delete_users(users, table(spark, d, "readings"), table(spark, d, "highlights"), users.where("id <= 100").select("id"))
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in zip(("users", "readings", "highlights"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("user_last_request", f"SELECT id, CASE WHEN role = 1 THEN {_AT} ELSE last_request END AS last_request FROM users")
def user_last_request(spark, d):
    users = table(spark, d, "users")
    new = users.where("role = 1").withColumn("last_request", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return activity.replace_by(users, new, ["id"], "last_request").select("id", "last_request")


@query("readings_missing_documents", "SELECT DISTINCT slug FROM readings r WHERE slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM library_metadata m WHERE m.slug = r.slug)")
def readings_missing_documents(spark, d):
    return table(spark, d, "readings").where("slug IS NOT NULL").select("slug").distinct().join(table(spark, d, "library_metadata").select("slug"), "slug", "left_anti")


# ---- functions over whole columns


@query("slugify", f"SELECT file_id, {slug_sql('title')} AS title_slug, {slug_sql('series')} AS series_slug FROM library_metadata")
def slugify(spark, d):
    return table(spark, d, "library_metadata").select("file_id", text.slug(F.col("title")).alias("title_slug"), text.slug(F.col("series")).alias("series_slug"))


@query(
    "slug_disambiguate",
    f"WITH b AS (SELECT file_id, id, {text.base_slug_sql('authors', 'title')} AS base FROM library_metadata), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b) "
    "SELECT file_id, CASE WHEN n = 1 THEN base ELSE base || '--' || n::VARCHAR END AS new_slug FROM n",
)
def slug_disambiguate(spark, d):
    rows = table(spark, d, "library_metadata").select("file_id", "id", "authors", "title", F.lit("").alias("language"))
    return ingest.with_unique_slugs(rows).select("file_id", F.col("slug").alias("new_slug"))


@query(
    "slug_incremental",
    f"WITH b AS (SELECT file_id, id, format, {text.base_slug_sql('authors', 'title')} AS base FROM library_metadata), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b), "
    "t AS (SELECT base, list(n) AS used FROM n WHERE format = 'EPUB' GROUP BY base), p AS (SELECT file_id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM n WHERE format = 'PDF'), "
    "f AS (SELECT file_id, p.base, list_filter(range(1, 1 + k + len(coalesce(used, []))), lambda x: NOT list_contains(coalesce(used, []), x))[k] AS f FROM p LEFT JOIN t ON p.base = t.base) "
    "SELECT file_id, CASE WHEN f = 1 THEN base ELSE base || '--' || f::VARCHAR END AS new_slug FROM f",
)
def slug_incremental(spark, d):
    """Slugs of the PDF files, loaded after the EPUB files, whose slugs leave gaps: the numbers that are free."""
    rows = table(spark, d, "library_metadata").select("file_id", "id", "authors", "title", "format", F.lit("").alias("language"))
    known = ingest.with_unique_slugs(rows).where("format = 'EPUB'")
    return ingest.with_unique_slugs(rows.where("format = 'PDF'"), known.select("slug")).select("file_id", F.col("slug").alias("new_slug"))


_SPLIT = "list_filter(list_transform(regexp_split_to_array({x}, '[{m}]'), lambda s: trim(s)), lambda s: s <> '')"


@query(
    "author_list_split",
    f"WITH e AS (SELECT info_id, unnest(creator).full_name AS f FROM epub_info), s AS (SELECT info_id, f, {_SPLIT.format(x='f', m='&,;')} AS names FROM e WHERE f IS NOT NULL) "
    "SELECT info_id, f AS full_name, array_to_string(names, '|') AS names FROM s",
)
def author_list_split(spark, d):
    e = table(spark, d, "epub_info").select("info_id", F.explode("creator.full_name").alias("full_name")).where("full_name IS NOT NULL")
    return e.select("info_id", "full_name", F.array_join(text.author_list(F.col("full_name")), "|").alias("names"))


@query("subject_list_split", f"WITH e AS (SELECT info_id, unnest(subject) AS s FROM epub_info) SELECT info_id, s AS element, array_to_string({_SPLIT.format(x='s', m=',;')}, '|') AS names FROM e WHERE s IS NOT NULL")
def subject_list_split(spark, d):
    e = table(spark, d, "epub_info").select("info_id", F.explode("subject").alias("element")).where("element IS NOT NULL")
    return e.select("info_id", "element", F.array_join(text.subject_list(F.col("element")), "|").alias("names"))


@query("subject_display_name", "SELECT subject_id, upper(substr(label, 1, 1)) || lower(substr(label, 2)) AS name FROM subject_list")
def subject_display_name(spark, d):
    return table(spark, d, "subject_list").select("subject_id", text.subject_name(F.col("label")).alias("name"))


@query("reading_time_text", f"SELECT file_id, {dates.reading_time_sql('words', '250.0')} AS reading_time FROM library_metadata WHERE words IS NOT NULL")
def reading_time_text(spark, d):
    return table(spark, d, "library_metadata").where("words IS NOT NULL").select("file_id", dates.reading_time(F.col("words"), F.lit(WPM)).alias("reading_time"))


@query("clamp_percentage", f"SELECT percentage AS raw, {_PCT} AS percentage, count(*) AS n FROM readings GROUP BY 1, 2")
def clamp_percentage(spark, d):
    r = table(spark, d, "readings")
    return r.groupBy(F.col("percentage").alias("raw"), activity.clamp_percentage(F.col("percentage")).alias("percentage")).agg(F.count(F.lit(1)).alias("n"))


@query("html_word_count", f"SELECT doc_id, {text.word_count_sql('text')} AS words FROM documents")
def html_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("publication_parts", "SELECT file_id, CASE WHEN publication.days > 0 THEN (DATE '0001-01-01' + publication.days)::VARCHAR END AS day, CASE WHEN publication.days > 0 THEN (year(DATE '0001-01-01' + publication.days) - 1) // 100 + 1 END AS century FROM library_metadata")
def publication_parts(spark, d):
    day = dates.days_to_date(F.col("publication.days"))
    return table(spark, d, "library_metadata").select("file_id", day.cast("string").alias("day"), F.when(day.isNotNull(), dates.century(F.year(day))).alias("century"))


@query(
    "precision_dates",
    "WITH p AS (SELECT o_orderkey, o_orderdate, 7 + o_orderkey % 5 AS prec FROM orders) SELECT o_orderkey, CASE WHEN prec < 10 THEN date_diff('day', DATE '0001-01-01', make_date(year(o_orderdate), 1, 1)) "
    "WHEN prec = 10 THEN date_diff('day', DATE '0001-01-01', date_trunc('month', o_orderdate)::DATE) ELSE date_diff('day', DATE '0001-01-01', o_orderdate::DATE) END AS days, prec AS precision FROM p",
)
def precision_dates(spark, d):
    stamp = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    p = dates.precision_date(stamp, (7 + F.col("o_orderkey") % 5).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", p["days"].alias("days"), p["precision"].alias("precision"))


@query("display_line", "SELECT file_id, array_to_string(list_filter(coalesce(authors, []), lambda a: a <> ''), ', ') AS line FROM library_metadata")
def display_line(spark, d):
    return table(spark, d, "library_metadata").select("file_id", text.display_authors(F.col("authors")).alias("line"))


@query("comment_preview", "SELECT user_id, slug, left(comment, 12) AS preview FROM highlights WHERE comment IS NOT NULL")
def comment_preview(spark, d):
    return table(spark, d, "highlights").where("comment IS NOT NULL").select("user_id", "slug", text.comment_preview(F.col("comment"), 12).alias("preview"))


@query(
    "person_roles",
    "WITH e AS (SELECT info_id, true AS c, unnest(creator) AS p FROM epub_info UNION ALL SELECT info_id, false, unnest(contributor) FROM epub_info), r AS (SELECT info_id, c, p.full_name AS full_name, "
    "lower(trim(coalesce(p.role, ''))) AS r FROM e) SELECT info_id, full_name, r IN ('ill', 'art') AS illustrator, r = 'aut' OR (r = '' AND c) AS author FROM r",
)
def person_roles(spark, d):
    e = table(spark, d, "epub_info")
    one = lambda c, made: e.select("info_id", F.explode(c).alias("p"), F.lit(made).alias("c"))
    rows = one("creator", True).unionByName(one("contributor", False))
    author = F.when(F.col("c"), people.is_author(F.col("p.role"), True)).otherwise(people.is_author(F.col("p.role"), False))
    return rows.select("info_id", F.col("p.full_name").alias("full_name"), people.is_illustrator(F.col("p.role")).alias("illustrator"), author.alias("author"))


@query("image_addresses", "SELECT id, 'https://img.example/' || substr(md5(replace(name, ' ', '_')), 1, 1) || '/' || substr(md5(replace(name, ' ', '_')), 1, 2) AS prefix FROM users WHERE name IS NOT NULL")
def image_addresses(spark, d):
    url = people.image_url(F.col("name"), "https://img.example")
    return table(spark, d, "users").where("name IS NOT NULL").select("id", F.substring_index(url, "/", 5).alias("prefix"))


@query("password_hashes", "SELECT id, sha256(username) AS hash FROM users WHERE username IS NOT NULL")
def password_hashes(spark, d):
    return table(spark, d, "users").where("username IS NOT NULL").select("id", F.lower(F.hex(people.password_hash(F.col("username")))).alias("hash"))


@query("sanitized_descriptions")
def sanitized_descriptions(spark, d):
    return table(spark, d, "library_metadata").where("description IS NOT NULL").select("file_id", text.sanitize_description(F.col("description")).alias("html"))


# ---- ingestion


@query("ingest_catalogue")
def ingest_catalogue(spark, d):
    """The package records as catalogue rows with unique slugs."""
    return ingest.build_catalogue(table(spark, d, "epub_info"))


@query("ingest_titles", "SELECT path AS id, CASE WHEN coalesce(trim(title[1]), '') <> '' THEN trim(title[1]) ELSE regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) END AS title, coalesce(language[1], '') AS language FROM epub_info")
def ingest_titles(spark, d):
    return ingest.catalogue_fields(table(spark, d, "epub_info")).select("id", "title", "language")


@query("ingest_incremental", "SELECT path FROM epub_info e WHERE NOT EXISTS (SELECT 1 FROM library_metadata m WHERE m.id = e.path)")
def ingest_incremental(spark, d):
    return ingest.new_records(table(spark, d, "epub_info"), table(spark, d, "library_metadata")).select("path")


@query("ingest_authors", f"WITH n AS (SELECT unnest(list_concat(coalesce(authors, []), coalesce(illustrators, []))) AS name FROM library_metadata), s AS (SELECT {slug_sql('name')} AS slug, trim(name) AS name FROM n) SELECT slug, min(name) AS name FROM s WHERE slug <> '' AND name <> '' GROUP BY slug")
def ingest_authors(spark, d):
    return ingest.author_rows(table(spark, d, "library_metadata"))


# ---- events


@query("events_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_hourly(spark, d):
    from stackroom.streaming.library import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "1 hour", "event_type")


@query("events_as_json", "SELECT event_id, event_type FROM events")
def events_as_json(spark, d):
    """Rows through the JSON sink and back."""
    from stackroom.sources.store import as_json

    js = as_json(table(spark, d, "events").select("event_id", "event_type"))
    return js.select(F.from_json("json", "event_id bigint, event_type string").alias("e")).select("e.*")
