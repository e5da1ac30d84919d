"""SQL fragments of the twins: the catalogue with slugs, latest activity, BM25."""

from __future__ import annotations

from stackroom.functions.text import fold_sql, slug_sql, tokens_sql


def _slugs(c: str) -> str:
    return f"list_filter(list_transform(coalesce({c}, []), lambda a: {slug_sql('a')}), lambda s: s <> '')"


CAT = f"""cat AS (SELECT *, {_slugs('authors')} AS authors_slugs, {_slugs('illustrators')} AS illustrators_slugs,
 {_slugs('subjects')} AS subjects_slugs, coalesce({slug_sql('series')}, '') AS series_slug FROM library_metadata)"""

READ = """rd AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY user_id, slug ORDER BY
 coalesce(updated_at, created_at) DESC NULLS LAST, coalesce(completed_on, TIMESTAMP '0001-01-01') DESC, coalesce(percentage, -1) DESC,
 coalesce(position, '') DESC, coalesce(created_at, TIMESTAMP '0001-01-01') DESC, coalesce(updated_at, TIMESTAMP '0001-01-01') DESC) = 1)"""

MARK = """hl AS (SELECT * FROM highlights QUALIFY row_number() OVER (PARTITION BY user_id, slug ORDER BY
 coalesce(updated_at, created_at, TIMESTAMP '0001-01-01') DESC, coalesce(created_at, TIMESTAMP '0001-01-01') DESC, coalesce(shared_by_id, -1) DESC,
 coalesce(comment, '') DESC, coalesce(updated_at, TIMESTAMP '0001-01-01') DESC) = 1)"""

BUSY = "(SELECT user_id FROM readings WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"
MARKER = "(SELECT user_id FROM highlights WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"

JOINED = lambda c: f"array_to_string(coalesce({c}, []), ' ')"


def toks(x: str) -> str:
    return tokens_sql(x)


def all_terms_sql(field: str, terms: list[str]) -> str:
    return f"list_has_all({tokens_sql(field)}, {terms!r})"


def any_term_sql(field: str, terms: list[str]) -> str:
    return f"list_has_any({tokens_sql(field)}, {terms!r})"


def bm25_sql(table: str, text: str, terms: list[str], keep: str) -> str:
    """WITH clauses d, st and scored over a table; `keep` are columns to carry."""
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms))
    )
    return f"""d0 AS (SELECT {keep}, {tokens_sql(text)} AS toks FROM {table}),
 d AS (SELECT {keep}, len(toks) AS dl, {tf} FROM d0), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {dfs} FROM d),
 scored AS (SELECT {keep}, round({score}, 6) AS score FROM d, st)"""


__all__ = ["BUSY", "CAT", "JOINED", "MARK", "MARKER", "READ", "all_terms_sql", "any_term_sql", "bm25_sql", "fold_sql", "slug_sql", "toks"]
