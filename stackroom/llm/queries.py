"""The subpackage's queries, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackroom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-entered subjects and languages with the entry that is meant."""
    from stackroom.llm.canon import map_catalogue

    out = map_catalogue(*(table(spark, sf_dir, t) for t in ("library_metadata", "subject_list", "language_list")))
    return out.select("file_id", "field", "pos", "ref")


def _bare_sql(x: str) -> str:
    kept = f"regexp_replace({x}, '[\\x{{FE00}}-\\x{{FE0F}}\\x{{034F}}\\x{{180B}}-\\x{{180D}}]|\\p{{Cf}}', '', 'g')"
    upper = f"upper(replace({kept}, 'ß', 'ss'))"
    return f"regexp_replace(nfc_normalize({upper}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


_KEYED_SQL = (
    f"WITH k AS (SELECT file_id, {_bare_sql('title')} AS t, list_sort(list_filter(list_transform(coalesce(authors, []), lambda a: {_bare_sql('a')}), lambda a: a <> '')) AS a "
    "FROM library_metadata), g AS (SELECT file_id, min(file_id) OVER (PARTITION BY t, a) AS first_id, count(*) OVER (PARTITION BY t, a) AS copies FROM k WHERE t <> '')"
)


@query("p2_found", f"{_KEYED_SQL} SELECT first_id, file_id FROM g WHERE file_id <> first_id")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a work but the first, with the first."""
    from stackroom.llm.copies import copies

    return copies(table(spark, sf_dir, "library_metadata"))


@query("p2_works", f"{_KEYED_SQL} SELECT DISTINCT first_id, copies FROM g")
def p2_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per work with its number of copies."""
    from stackroom.llm.copies import works

    return works(table(spark, sf_dir, "library_metadata"))


def _words_sql(x: str) -> str:
    plain = f"regexp_replace({x}, '<[^<>]{{1,200}}>', ' ', 'g')"
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{mark}')"
    low = f"replace(lower(nfc_normalize({plain})), 'ß', 'ss')"
    joined = f"regexp_replace({low}, '([\\p{{L}}\\p{{N}}])[''’‘ʼ`´-]+([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')"
    joined = f"regexp_replace({joined}, '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    return f"list_filter(regexp_split_to_array({joined}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_LEAK_SQL = (
    "WITH w AS (SELECT {k} AS k, {w} AS ws FROM {t}), i AS (SELECT k, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12) "
    "SELECT k, array_to_string(list_slice(ws, i, i + 11), ' ') AS g FROM i"
)


_SPANS_SQL = (
    "WITH d AS ({d}), e AS ({e}), m AS (SELECT DISTINCT d.k AS doc_id, e.k AS item_id, d.i FROM d JOIN e ON d.g = e.g), "
    "n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 THEN 0 ELSE 1 END AS fresh FROM m), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS s FROM n), "
    "o AS (SELECT doc_id, item_id, min(i) - 1 AS first_word, max(i) + 11 AS end_word FROM s GROUP BY doc_id, item_id, s)"
).format(
    d=_LEAK_SQL.format(k="doc_id", w=_words_sql("text"), t="documents").replace("SELECT k, array", "SELECT k, i, array"),
    e=_LEAK_SQL.format(k="item_id", w=_words_sql("passage"), t="eval_items"),
)


@query("p8_spans", f"{_SPANS_SQL} SELECT * FROM o")
def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans to remove, in words of the document."""
    from stackroom.llm.leak import leaked_spans

    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p8_items", f"{_SPANS_SQL} SELECT item_id, count(DISTINCT doc_id) AS documents, sum(end_word - first_word) AS words FROM o GROUP BY item_id")
def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents and words."""
    from stackroom.llm.leak import leaked_items

    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query(
    "p8_found",
    f"SELECT DISTINCT d.k AS doc_id, e.k AS item_id FROM ({_LEAK_SQL.format(k='doc_id', w=_words_sql('text'), t='documents')}) d "
    f"JOIN ({_LEAK_SQL.format(k='item_id', w=_words_sql('passage'), t='eval_items')}) e ON d.g = e.g",
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold twelve consecutive words of a held-out item."""
    from stackroom.llm.leak import leaked

    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text was cut."""
    from stackroom.llm.cutoff import scored

    return scored(table(spark, sf_dir, "documents")).where("p_cut >= 0.5").select("doc_id")


@query("p10_rates")
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts."""
    from stackroom.llm.cutoff import cut_rates

    return cut_rates(table(spark, sf_dir, "documents"))


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles and descriptions that hold text decoded with the wrong encoding."""
    from stackroom.llm.mojibake import garbled_fields

    return garbled_fields(table(spark, sf_dir, "library_metadata")).select("file_id", "field")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of different spellings of one person or organisation."""
    from stackroom.llm.names import variant_pairs

    return variant_pairs(table(spark, sf_dir, "library_metadata"), ["authors", "illustrators"])


@query("p5_entities")
def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the representative of its person or organisation."""
    from stackroom.llm.names import named_entities

    return named_entities(table(spark, sf_dir, "library_metadata"), ["authors", "illustrators"])


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each description whose label is missing or wrong, or that mixes languages."""
    from stackroom.llm.langid import relabelled

    return relabelled(table(spark, sf_dir, "library_metadata"), table(spark, sf_dir, "language_list")).select("file_id", "lang")


@query("p4_spans")
def p4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of each description: its place in the stored text, its language and the confidence."""
    from stackroom.llm.langid import stretch_rows

    return stretch_rows(table(spark, sf_dir, "library_metadata"), table(spark, sf_dir, "language_list"))


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    from stackroom.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source reaches in the mix."""
    from stackroom.llm.mixing import shares

    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
