"""Queries over functions on names, dates and people, over files, the store and streams, each with its SQL twin."""

from __future__ import annotations

import io
import zipfile
from uuid import uuid4
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import dates, people, text
from stackroom.operators import activity, catalog, enrich, ingest, related, search
from stackroom.plans.catalogue import query
from stackroom.plans.library import _related_sql, _top_author, _top_series, cat, readings
from stackroom.plans.sqltext import BUSY, CAT, READ, slug_sql
from stackroom.session import ensure_checkpoint_dir, table

_DAY0 = "DATE '0001-01-01'"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


# ---- dates


def _stamp_days_sql(y: str, m: str, d: str) -> str:
    return f"date_diff('day', {_DAY0}, make_date({y}, {m}, {d}))"


@query(
    "pdf_dates",
    "WITH e AS (SELECT info_id, date[1].stamp AS a, date[2].stamp AS b FROM epub_info), p AS (SELECT info_id, CASE WHEN regexp_matches(a, '^D:\\d{4}') THEN a ELSE b END AS s FROM e), "
    "g AS (SELECT info_id, regexp_extract(s, '^D:(\\d{4})(\\d{2})?(\\d{2})?', 1) AS y, regexp_extract(s, '^D:(\\d{4})(\\d{2})?(\\d{2})?', 2) AS m, regexp_extract(s, '^D:(\\d{4})(\\d{2})?(\\d{2})?', 3) AS d FROM p), "
    "v AS (SELECT info_id, m, d, CASE WHEN y <> '' THEN TRY_CAST(y || '-' || CASE WHEN m = '' THEN '01' ELSE m END || '-' || CASE WHEN d = '' THEN '01' ELSE d END AS DATE) END AS day FROM g) "
    f"SELECT info_id, coalesce(date_diff('day', {_DAY0}, day), 0) AS days, CASE WHEN day IS NULL THEN 0 WHEN d <> '' THEN 11 WHEN m <> '' THEN 10 ELSE 9 END AS precision FROM v",
)
def pdf_dates(spark, d):
    """The dates of PDF information dictionaries, of the first two stamps of each record."""
    p = dates.pdf_date(F.get("date", F.lit(0))["stamp"], F.get("date", F.lit(1))["stamp"])
    return table(spark, d, "epub_info").select("info_id", p["days"].alias("days"), p["precision"].alias("precision"))


@query(
    "publication_dates",
    "WITH e AS (SELECT info_id, list_filter(date, lambda e: e.event IN ('publication', ''))[1].stamp AS s FROM epub_info), v AS (SELECT info_id, "
    "CASE WHEN regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(s AS DATE) END AS day, CASE WHEN regexp_full_match(s, '\\d{4}') AND s <> '0000' THEN make_date(s::INT, 1, 1) END AS year FROM e) "
    f"SELECT info_id, coalesce(date_diff('day', {_DAY0}, day), date_diff('day', {_DAY0}, year), 0) AS days, CASE WHEN day IS NOT NULL THEN 11 WHEN year IS NOT NULL THEN 9 ELSE 0 END AS precision FROM v",
)
def publication_dates(spark, d):
    """The publication date of each package record: a full day, a year, or unknown."""
    p = dates.publication_date(F.col("date"))
    return table(spark, d, "epub_info").select("info_id", p["days"].alias("days"), p["precision"].alias("precision"))


@query(
    "ages",
    "SELECT file_id, CASE WHEN publication.precision = 11 AND publication.days <> 0 THEN floor((CASE WHEN words > 50000 THEN publication.days + 30000 "
    f"ELSE date_diff('day', {_DAY0}, DATE '2025-01-01') END - publication.days) / 365.25)::INT ELSE 0 END AS age FROM library_metadata WHERE publication.days IS NOT NULL",
)
def ages(spark, d):
    """Whole years from a first date to a last one, or to a given day where there is none."""
    c = table(spark, d, "library_metadata").where("publication.days IS NOT NULL")
    days, precision = F.col("publication.days"), F.col("publication.precision")
    last = F.when(F.col("words") > 50000, days + 30000).otherwise(0)
    return c.select("file_id", dates.age(days, precision, last, F.lit(dates.DAY), F.lit("2025-01-01").cast("date")).alias("age"))


@query("stated_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * year(o_orderdate) AS year FROM orders")
def stated_years(spark, d):
    stamp = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "orders").select("o_orderkey", dates.stated_year(stamp).alias("year"))


@query(
    "formatted_dates",
    f"SELECT file_id, CASE WHEN publication.days > 0 THEN CASE WHEN language = 'en' THEN strftime({_DAY0} + publication.days, '%Y-%m-%d') ELSE strftime({_DAY0} + publication.days, '%d-%m-%Y') END END AS day FROM library_metadata",
)
def formatted_dates(spark, d):
    days = F.col("publication.days")
    return table(spark, d, "library_metadata").select("file_id", F.when(F.col("language") == "en", dates.format_date(days, "en")).otherwise(dates.format_date(days, "es")).alias("day"))


# ---- people


@query("birth_name_includes", "SELECT file_id, list_bool_and(list_transform(string_split(series, ' '), lambda p: contains(title, p))) AS includes FROM library_metadata WHERE title IS NOT NULL AND series IS NOT NULL")
def birth_name_includes(spark, d):
    """Whether a longer name holds every part of a shorter one."""
    c = table(spark, d, "library_metadata").where("title IS NOT NULL AND series IS NOT NULL")
    return c.select("file_id", people.birth_name_includes(F.col("title"), F.col("series")).alias("includes"))


@query("birth_names", "SELECT file_id, coalesce(nullif(series, ''), nullif(title, ''), nullif(slug, '')) AS name FROM library_metadata")
def birth_names(spark, d):
    """The first name that is given, of three."""
    return table(spark, d, "library_metadata").select("file_id", people.birth_name(F.col("series"), F.col("title"), F.col("slug")).alias("name"))


@query("pseudonym_lists", "SELECT file_id, array_to_string(list_filter(authors, lambda a: a <> authors[1]), '|') AS others FROM library_metadata WHERE authors IS NOT NULL")
def pseudonym_lists(spark, d):
    """The names that differ from a person's own."""
    c = table(spark, d, "library_metadata").where("authors IS NOT NULL")
    return c.select("file_id", F.array_join(people.pseudonyms(F.col("authors"), F.get("authors", F.lit(0))), "|").alias("others"))


@query("code_maps", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS gender FROM supplier")
def code_maps(spark, d):
    """Entity codes as small numbers, unknown ones as 0."""
    code = F.element_at(F.array(F.lit("Q6581097"), F.lit("Q6581072"), F.lit("Q0"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", people.code_of(people.GENDERS, code).alias("gender"))


_RANK = "CASE s_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END"


@query(
    "ranked_pick",
    "WITH h AS (SELECT s_name AS name, unnest([s_suppkey, s_suppkey + 1, s_suppkey + 2]) AS k, unnest([0, 1, 2]) AS pos FROM supplier), "
    f"e AS (SELECT s_suppkey AS k, {_RANK} AS r, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind FROM supplier), "
    "j AS (SELECT h.name, e.k, e.kind, row_number() OVER (PARTITION BY h.name ORDER BY e.r, h.pos) AS n FROM h JOIN e ON h.k = e.k WHERE e.kind > 0) "
    f"SELECT {slug_sql('name')} AS slug, 'Q' || k AS entity_id, kind AS instance_of FROM j WHERE n = 1",
)
def ranked_pick(spark, d):
    """The entity each name is resolved to: the first hit of a known kind, best claim rank first. The suppliers stand for authors."""
    s = table(spark, d, "supplier")
    key = lambda i: F.concat(F.lit("Q"), (F.col("s_suppkey") + i).cast("string"))
    names = s.select(text.slug(F.col("s_name")).alias("slug"), F.col("s_name").alias("name"))
    found = s.select(F.col("s_name").alias("name"), F.array(key(0), key(1), key(2)).alias("ids"))
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    claim = F.struct(
        pick(F.col("s_nationkey") % 3, "normal", "preferred", "deprecated").alias("rank"), pick(F.col("s_suppkey") % 4, "Q0", "Q5", "Q61002", "Q127843").alias("value"), F.lit(0).alias("precision")
    )
    none = F.create_map().cast("map<string,string>")
    entities = s.select(key(0).alias("id"), F.create_map(F.lit(enrich.INSTANCE_OF), F.array(claim)).alias("claims"), none.alias("descriptions"), none.alias("links"))
    return enrich.resolve_authors(names, found, entities, "https://img.example").select("slug", "entity_id", "instance_of")


# ---- records


@query(
    "ingest_people",
    "WITH e AS (SELECT path, coalesce(creator, []) AS c, coalesce(contributor, []) AS k FROM epub_info), "
    "r AS (SELECT path, list_concat(list_filter(c, lambda p: lower(trim(coalesce(p.role, ''))) IN ('', 'aut')), list_filter(k, lambda p: lower(trim(coalesce(p.role, ''))) = 'aut')) AS a, "
    "list_concat(list_filter(c, lambda p: lower(trim(coalesce(p.role, ''))) IN ('ill', 'art')), list_filter(k, lambda p: lower(trim(coalesce(p.role, ''))) IN ('ill', 'art'))) AS i FROM e), "
    "n AS (SELECT path, list_filter(flatten(list_transform(a, lambda p: list_transform(regexp_split_to_array(coalesce(p.full_name, ''), '[&,;]'), lambda x: trim(x)))), lambda x: x <> '') AS a, "
    "list_filter(flatten(list_transform(i, lambda p: list_transform(regexp_split_to_array(coalesce(p.full_name, ''), '[&,;]'), lambda x: trim(x)))), lambda x: x <> '') AS i FROM r) "
    "SELECT path AS id, array_to_string(a, '|') AS authors, len(a) = 0 AS no_author, array_to_string(i, '|') AS illustrators FROM n",
)
def ingest_people(spark, d):
    """Authors and illustrators of the package records; a record without an author gets one empty name."""
    rows = ingest.catalogue_fields(table(spark, d, "epub_info"))
    none = (F.size("authors") == 1) & (F.col("authors")[0] == "")
    return rows.select("id", F.array_join("authors", "|").alias("authors"), none.alias("no_author"), F.array_join("illustrators", "|").alias("illustrators"))


@query("plain_descriptions", "SELECT file_id, CASE WHEN trim(description) = '' THEN '' ELSE '<p>' || replace(trim(description), chr(10), '</p><p>') || '</p>' END AS html FROM library_metadata WHERE NOT regexp_matches(description, '(?i)<[a-z][^>]*>')")
def plain_descriptions(spark, d):
    """Plain descriptions as paragraphs."""
    c = table(spark, d, "library_metadata").where(~F.col("description").rlike("(?i)<[a-z][^>]*>"))
    return c.select("file_id", text.sanitize_description(F.col("description")).alias("html"))


_TAGS = "|".join(text.ALLOWED_TAGS)


@query(
    "sanitized_html",
    "WITH h AS (SELECT file_id, regexp_replace(trim(description), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g') AS h FROM library_metadata WHERE regexp_matches(description, '(?i)<[a-z][^>]*>')), "
    f"k AS (SELECT file_id, regexp_replace(h, '(?i)<(/?)({_TAGS})\\b[^>]*?(/?)>', chr(1) || '\\1\\2\\3' || chr(2), 'g') AS h FROM h) "
    "SELECT file_id, replace(replace(regexp_replace(h, '(?i)</?[a-z][^>]*>', '', 'g'), chr(1), '<'), chr(2), '>') AS html FROM k",
)
def sanitized_html(spark, d):
    """Descriptions in HTML with allowed elements only, without attributes."""
    c = table(spark, d, "library_metadata").where(F.col("description").rlike("(?i)<[a-z][^>]*>"))
    return c.select("file_id", text.sanitize_description(F.col("description")).alias("html"))


# ---- pages


@query("languages_present", "SELECT DISTINCT substr(language, 1, 2) AS language FROM library_metadata WHERE length(language) >= 2 AND language <> 'default_analyzer' ORDER BY 1")
def languages_present(spark, d):
    return catalog.languages_present(table(spark, d, "library_metadata"))


_TOP = "k AS (SELECT series_slug AS key FROM cat WHERE series_slug <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
for _name, _key, _order in (
    ("series_page_by_date", "pub-date-older-first", "coalesce(publication.days, 0), coalesce(series_index, 0)"),
    ("series_page_newest", "pub-date-newer-first", "coalesce(publication.days, 0) DESC, coalesce(series_index, 0)"),
    ("series_page_last", "number-desc", "coalesce(series_index, 0) DESC"), ("series_page_number", "number", "coalesce(series_index, 0)"),
):

    @query(_name, f"WITH {CAT}, {_TOP} SELECT slug, title, series_index FROM cat WHERE series_slug = (SELECT key FROM k) ORDER BY {_order}, slug LIMIT 10")
    def _series_page(spark, d, key=_key):
        c = cat(spark, d)
        return catalog.page(catalog.browse_series(c, _top_series(c)).orderBy(*search.series_sort_keys(key)), 1).select("slug", "title", "series_index")


_REF = "(SELECT min(slug) FROM cat WHERE len(subjects_slugs) > 0 AND len(authors_slugs) > 0 AND publication.days > 0)"


def _list_sql(name: str, kind: str) -> str:
    sql = _related_sql(kind, True, where=f"slug = {_REF}")
    return f"(SELECT '{name}' AS list, slug, score FROM ({sql}))"


@query(
    "document_page_lists",
    f"{_list_sql('subjects', 'subjects_slugs')} UNION ALL {_list_sql('authors', 'authors_slugs')} UNION ALL (WITH {CAT}, r AS (SELECT series_slug, slug FROM cat WHERE slug = {_REF}) "
    "SELECT 'series', c.slug, 0.0 FROM cat c, r WHERE r.series_slug <> '' AND c.series_slug = r.series_slug AND c.slug <> r.slug ORDER BY coalesce(c.series_index, 0), c.slug LIMIT 4)",
)
def document_page_lists(spark, d):
    """The three related lists of a document's page."""
    c = cat(spark, d)
    key = c.where("size(subjects_slugs) > 0 AND size(authors_slugs) > 0 AND publication.days > 0").agg(F.min("slug")).first()[0] or ""
    lists = {"subjects": related.same_subjects(c, key), "authors": related.same_authors(c, key), "series": related.same_series(c, key)}
    parts = [df.select(F.lit(k).alias("list"), "slug", "score") for k, df in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "page_bounds",
    "SELECT id, greatest(1, id - 5) AS page, CASE WHEN (id - 3) * 7 <= 0 THEN 10 ELSE least((id - 3) * 7, 100) END AS size, ceil(id / 7.0)::BIGINT AS pages, "
    "greatest(1, least(id % 9, ceil(id / 7.0)))::BIGINT AS clamped FROM users",
)
def page_bounds(spark, d):
    """Clamped page numbers and sizes, over the users' ids as requests."""
    ids = [r["id"] for r in table(spark, d, "users").select("id").limit(10_000).collect()]
    rows = [(i, *catalog.page_bounds(i - 5, (i - 3) * 7), catalog.total_pages(i, 7), catalog.clamp_page(i % 9, i, 7)) for i in ids]
    return spark.createDataFrame(rows, "id bigint, page bigint, size bigint, pages bigint, clamped bigint")


@query("author_summary", f"WITH {CAT}, k AS (SELECT a FROM cat, unnest(authors_slugs) u(a) GROUP BY a ORDER BY count(*) DESC, a LIMIT 1) SELECT (SELECT a FROM k) AS slug, count(*) AS documents, coalesce(sum(words), 0) AS words FROM cat WHERE list_contains(authors_slugs, (SELECT a FROM k))")
def author_summary(spark, d):
    """How many documents and words an author has."""
    c = cat(spark, d)
    top = _top_author(c)
    mine = c.where(F.array_contains("authors_slugs", top))
    return mine.agg(F.lit(top).alias("slug"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0.0)).alias("words"))


@query("reading_position", f"WITH {READ} SELECT slug, position, greatest(0, least(100, coalesce(percentage, 0))) AS percentage FROM rd WHERE user_id = {BUSY} AND slug = (SELECT min(slug) FROM rd WHERE user_id = {BUSY})")
def reading_position(spark, d):
    """The stored position in one document."""
    r, u = readings(spark, d)
    mine = r.where(F.col("user_id") == u)
    return mine.where(F.col("slug") == (mine.agg(F.min("slug")).first()[0] or "")).select("slug", "position", activity.clamp_percentage(F.col("percentage")).alias("percentage"))


# ---- changes


@query(
    "reading_set_completed",
    f"WITH {READ}, k AS (SELECT min(slug) AS k FROM rd WHERE user_id = {BUSY}) SELECT user_id, slug, updated_at, CASE WHEN user_id = {BUSY} AND slug = (SELECT k FROM k) "
    "THEN TIMESTAMP '2024-02-29 00:00:00' ELSE completed_on END AS completed_on FROM rd",
)
def reading_set_completed(spark, d):
    """One reading's completion date set; nothing else changes."""
    r, u = readings(spark, d)
    key = r.where(F.col("user_id") == u).agg(F.min("slug")).first()[0] or ""
    return activity.set_completed(r, u, key, "2024-02-29", "2025-01-01T00:00:00Z").select("user_id", "slug", "updated_at", "completed_on")


_INVITE = "SELECT id, lower(email) AS email, uuid, last_request AS valid_until FROM users WHERE email IS NOT NULL"


@query(
    "invitations_upsert",
    f"WITH i AS ({_INVITE}), n AS (SELECT id + 1000 AS id, email, 'new' AS uuid, TIMESTAMP '2030-01-01 00:00:00' AS valid_until FROM i WHERE valid_until IS NULL OR valid_until <= TIMESTAMP '2024-06-01 00:00:00') "
    "SELECT * FROM i WHERE email NOT IN (SELECT email FROM n) UNION ALL SELECT * FROM n",
)
def invitations_upsert(spark, d):
    """Expired invitations renewed: one per address, the new one replaces the old."""
    i = _invitations(spark, d)
    new = activity.expired_invitations(i, "2024-06-01 00:00:00").select((F.col("id") + 1000).alias("id"), "email", F.lit("new").alias("uuid"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("valid_until"))
    return activity.replace_by(i, new, ["email"], "valid_until")


def _invitations(spark, d) -> DataFrame:
    """The users as invitations valid until their last request."""
    return table(spark, d, "users").where("email IS NOT NULL").select("id", F.lower("email").alias("email"), "uuid", F.col("last_request").alias("valid_until"))


_MID = "TIMESTAMP '2024-06-01 00:00:00'"


@query("invitations_valid", f"SELECT id, email FROM ({_INVITE}) WHERE valid_until > {_MID}")
def invitations_valid(spark, d):
    return activity.valid_invitations(_invitations(spark, d), "2024-06-01 00:00:00").select("id", "email")


@query("invitations_expired", f"SELECT id, email FROM ({_INVITE}) WHERE valid_until IS NULL OR valid_until <= {_MID}")
def invitations_expired(spark, d):
    return activity.expired_invitations(_invitations(spark, d), "2024-06-01 00:00:00").select("id", "email")


@query("recipient_rows", "SELECT DISTINCT CASE WHEN language IN ('en', 'es', 'fr', 'de') THEN language ELSE 'en' END AS language, email FROM users WHERE email IS NOT NULL")
def recipient_rows(spark, d):
    """One row per address, with the language to write in."""
    return activity.recipients(table(spark, d, "users"), ["en", "es", "fr", "de"])


@query("user_by_name", "SELECT id, username FROM users WHERE lower(username) = (SELECT min(lower(username)) FROM users)")
def user_by_name(spark, d):
    u = table(spark, d, "users")
    return activity.find_user(u, "username", u.agg(F.min(F.lower("username"))).first()[0] or "").select("id", "username")


@query(
    "authors_upsert",
    f"WITH n AS (SELECT DISTINCT {slug_sql('name')} AS slug, 'old' AS name FROM users WHERE name IS NOT NULL), f AS (SELECT slug, 'new' AS name FROM n WHERE length(slug) % 2 = 0 UNION SELECT 'added', 'new') "
    "SELECT * FROM n WHERE slug NOT IN (SELECT slug FROM f) UNION ALL SELECT * FROM f",
)
def authors_upsert(spark, d):
    """Author entries replaced by fresh ones of the same slug."""
    n = table(spark, d, "users").where("name IS NOT NULL").select(text.slug(F.col("name")).alias("slug"), F.lit("old").alias("name")).distinct()
    fresh = n.where("length(slug) % 2 = 0").select("slug", F.lit("new").alias("name")).unionByName(spark.createDataFrame([("added", "new")], "slug string, name string"))
    return activity.replace_by(n, fresh, ["slug"], "name")


# ---- the store and files


@query("store_opened", "SELECT 'first' AS at, true AS rebuild, 0 AS documents, 'admin' AS username, 2 AS role UNION ALL SELECT 'again', false, 1, 'admin', 2 UNION ALL SELECT 'changed', true, 0, 'admin', 2")
def store_opened(spark, d):
    """A store opened for the first time, again, and with another threshold: whether it must be rebuilt, and its first user."""
    from stackroom.sources.store import Store

    store, out = Store(spark, shared_folder(spark, "store")), []
    for at, least in (("first", 0.25), ("again", 0.25), ("changed", 0.5)):
        rebuild = store.open(least)
        user = store.read("users").first()
        out.append((at, rebuild, store.read("documents").count(), user["username"], user["role"]))
        store.upload(spark.createDataFrame([("a", "a")], "id string, slug string"), "2024-01-01 00:00:00")
    return spark.createDataFrame(out, "at string, rebuild boolean, documents bigint, username string, role int")


def _book(label: str, words: int) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/content.opf",
            f'<package xmlns:dc="x"><metadata><dc:title>{escape(label)}</dc:title><dc:creator>Ann Lee</dc:creator><dc:subject>{escape(label)}</dc:subject></metadata><manifest/></package>',
        )
        z.writestr("OEBPS/p.xhtml", f"<html><body><p>{'word ' * words}</p></body></html>")
    return buf.getvalue()


def _book_folder(spark: SparkSession, d: str) -> str:
    """A folder with an EPUB file per subject of the list, a PDF file and a broken file."""
    from stackroom.sources.store import Store

    folder, store = shared_folder(spark, "books"), Store(spark, shared_folder(spark, "store"))
    for r in table(spark, d, "subject_list").limit(1000).collect():
        store.write_bytes(f"{folder}/s/{r['subject_id']}.epub", _book(r["label"], r["subject_id"]))
    store.write_bytes(f"{folder}/plain.pdf", b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Title (Plain) >> endobj\ntrailer << /Info 2 0 R >>")
    store.write_bytes(f"{folder}/broken.epub", b"no archive")
    store.write_bytes(f"{folder}/notes.txt", b"not a book")
    return folder


@query("library_files", "SELECT 's/' || subject_id || '.epub' AS path FROM subject_list UNION ALL SELECT 'plain.pdf' UNION ALL SELECT 'broken.epub'")
def library_files(spark, d):
    """The readable files of a folder and the ones below it."""
    from stackroom.sources.library import listing

    return listing(spark, _book_folder(spark, d)).select("path")


@query("library_records", "SELECT 's/' || subject_id || '.epub' AS id, trim(label) AS title, 'EPUB' AS format, subject_id::DOUBLE AS words, 'Ann Lee' AS author FROM subject_list UNION ALL SELECT 'plain.pdf', 'Plain', 'PDF', 0.0, ''")
def library_records(spark, d):
    """Catalogue rows of a folder of EPUB and PDF files."""
    from stackroom.sources import library

    rows = library.metadata(library.read_records(library.scan(spark, _book_folder(spark, d))))
    return rows.select("id", "title", "format", "words", F.col("authors")[0].alias("author"))


@query("library_quarantine", "SELECT 'broken.epub' AS path, 'BadZipFile' AS kind")
def library_quarantine(spark, d):
    """The files a bulk load couldn't read, as written to the quarantine."""
    from stackroom.sources import library

    records = library.read_records(library.scan(spark, _book_folder(spark, d)))
    out = shared_folder(spark, "load")
    ingest.bulk_write(ingest.with_slug_columns(library.metadata(records)), library.failures(records), out)
    return spark.read.parquet(f"{out}/quarantine").select("path", F.substring_index("error", ":", 1).alias("kind"))


@query("library_raw_file", "SELECT 'plain.pdf' AS path, 'application/pdf' AS content_type, 103 AS bytes")
def library_raw_file(spark, d):
    from stackroom.sources import library

    return library.raw_file(library.scan(spark, _book_folder(spark, d)), "plain.pdf").select("path", "content_type", F.octet_length("content").alias("bytes"))


@query("store_upload_delete", "SELECT 'ann-lee-second' AS slug, 'b.epub' AS id, 2.0 AS words")
def store_upload_delete(spark, d):
    """Two files uploaded and one deleted again, with its file."""
    from stackroom.sources.store import Store

    folder, store = shared_folder(spark, "books"), Store(spark, shared_folder(spark, "store"))
    store.write_bytes(f"{folder}/notes.txt", b"not a book")
    store.upload_file(folder, "a.epub", _book("First", 1), "2024-01-01 00:00:00")
    store.upload_file(folder, "b.epub", _book("Second", 2), "2024-01-02 00:00:00")
    store.delete(store.read("documents").where("id = 'a.epub'").select("slug"), folder)
    return store.read("documents").select("slug", "id", "words")


@query("events_json_text", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events""")
def events_json_text(spark, d):
    """Rows as JSON objects, by their text."""
    from stackroom.sources.store import as_json

    e = table(spark, d, "events").select("event_id", "event_type")
    return as_json(e).select(F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"), "json")


# ---- streams


@query("stream_records", "SELECT path, max(series) AS series FROM epub_info GROUP BY path")
def stream_records(spark, d):
    """Package records that arrive as JSON files, read by a stream and merged batch by batch: the last of each path."""
    from stackroom.streaming.library import latest_by_key, watch_records

    e = table(spark, d, "epub_info").select("path", "series", "info_id")
    src, out = shared_folder(spark, "arrivals"), shared_folder(spark, "merged")
    e.withColumn("series", F.lit("old")).withColumn("info_id", F.lit(-1).cast("bigint")).unionByName(e).repartition(3).write.json(src)
    merge = lambda batch, i: latest_by_key(batch, ["path"], "info_id").write.mode("append").parquet(f"{out}/part={i}")
    watch_records(spark, src, "path string, series string, info_id bigint", merge, shared_folder(spark, "stream")).awaitTermination()
    return latest_by_key(spark.read.parquet(out).select("path", "series", "info_id"), ["path"], "info_id").select("path", "series")


_KIND = "CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'close_write' WHEN 2 THEN 'delete' WHEN 3 THEN 'moved_to' ELSE 'moved_from' END"


@query(
    "file_events_split",
    f"WITH f AS (SELECT 'f' || user_id AS path, {_KIND} AS event, ts, event_id FROM events), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event DESC) = 1) "
    "SELECT path, CASE WHEN event IN ('delete', 'moved_from') THEN 'remove' ELSE 'index' END AS change FROM l",
)
def file_events_split(spark, d):
    """What the last event of each file asks for: the events' users stand for files."""
    from stackroom.streaming.library import split_events

    kinds = F.array(*map(F.lit, ["create", "close_write", "delete", "moved_to", "moved_from"]))
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("event"), F.col("ts").alias("at"))
    fresh, gone = split_events(e)
    return fresh.withColumn("change", F.lit("index")).unionByName(gone.withColumn("change", F.lit("remove")))


@query("load_progress", "SELECT id, CASE WHEN id - 3 <= 0 THEN 0 ELSE least(100, floor(100 * (id - 3) / 400.0 + 0.5)) END::BIGINT AS percentage FROM users")
def load_progress(spark, d):
    """The progress of a load of 400 files after so many of them."""
    from stackroom.streaming.library import progress

    ids = [r["id"] for r in table(spark, d, "users").select("id").limit(10_000).collect()]
    return spark.createDataFrame([(i, progress(i - 3, 400, 1.0)[0]) for i in ids], "id bigint, percentage bigint")


@query(
    "events_sliding",
    "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2",
)
def events_sliding(spark, d):
    """Events in windows of two hours that slide by one."""
    from stackroom.streaming.library import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "2 hours", "event_type", slide="1 hour")


@query(
    "event_sessions",
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, s",
)
def event_sessions(spark, d):
    """Each user's events that follow each other within half an hour."""
    from stackroom.streaming.library import session_counts

    return session_counts(table(spark, d, "events"), "ts", "30 minutes", "user_id")
