"""Full-text search over the catalogue: keyword, slug and field query modes, filters, sorts, BM25.

A search is a predicate, a score and an order. Over a stored index (`stackroom.operators.index`) it reads the postings of
its few terms and joins what it found with the catalogue's plain columns. Without an index, and for phrases, wildcards,
fuzzy terms, regular expressions and ranges, it is one scan; the scores' statistics (documents, document frequency of the
query's terms) are then one aggregate row, read first by a job of its own and put into the plan as literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.analyze import LANGUAGES, analyzed
from stackroom.functions.text import fold, slug, tokens

K1, B = 1.2, 0.75

FIELDS = {"Authors": "authors", "Illustrators": "illustrators", "Series": "series", "Title": "title", "Subjects": "subjects"}
SLUG_FIELDS = {"AuthorsSlugs": "authors_slugs", "IllustratorsSlugs": "illustrators_slugs", "SeriesSlug": "series_slug"}


@dataclass
class SearchFields:
    """One search request. Dates are days since 0001-01-01 (0 = unbounded), reading times are hours (0 = unbounded)."""

    keywords: str = ""
    language: str = ""
    subjects: str = ""
    published_from: int = 0
    published_to: int = 0
    hours_from: float = 0
    hours_to: float = 0
    words_per_minute: float = 250
    illustrated_only: bool = False
    illustrated_min: int = 1
    sort: str = "relevance"
    extra: list[Column] = field(default_factory=list)

    def normalised(self) -> SearchFields:
        """Reversed bounds are swapped where the upper one is set."""
        out = SearchFields(**self.__dict__)
        if out.published_to and out.published_from > out.published_to:
            out.published_from, out.published_to = out.published_to, out.published_from
        if out.hours_to and out.hours_from > out.hours_to:
            out.hours_from, out.hours_to = out.hours_to, out.hours_from
        return out


def iso_days(text: str) -> int:
    """Days of an ISO date; ValueError if it is none."""
    from datetime import date

    return (date.fromisoformat(text) - date(1, 1, 1)).days if text else 0


def parse_request(args: dict[str, str]) -> SearchFields:
    """Request arguments as search fields."""
    num = lambda k: float(args.get(k) or 0)
    return SearchFields(
        keywords=args.get("search", ""), language=args.get("language", ""), subjects=args.get("subjects", ""),
        published_from=iso_days(args.get("pub-date-from", "")), published_to=iso_days(args.get("pub-date-to", "")),
        hours_from=num("est-read-time-from"), hours_to=num("est-read-time-to"),
        illustrated_only=args.get("illustrated-only", "") in ("on", "1"), sort=args.get("sort-by", "relevance"),
    ).normalised()


def filters(s: SearchFields) -> list[Column]:
    """The request's predicates; the ones on plain columns reach the Parquet scan. Ranges are half-open: from <= x < to."""
    out = list(s.extra)
    if s.language.strip():
        out.append(F.col("language").startswith(s.language.strip()))
    wanted = [x.strip() for x in s.subjects.split(",") if x.strip()]
    out += [F.array_contains("subjects_slugs", slug(F.lit(x))) for x in wanted]
    if s.published_from:
        out.append(F.col("publication.days") >= s.published_from)
    if s.published_to:
        out.append(F.col("publication.days") < s.published_to)
    if s.hours_from:
        out.append(F.col("words") >= s.hours_from * 60 * s.words_per_minute)
    if s.hours_to:
        out.append(F.col("words") < s.hours_to * 60 * s.words_per_minute)
    if s.illustrated_only and s.illustrated_min > 0:
        out.append(F.col("illustrations") >= s.illustrated_min)
    return out


def sort_keys(name: str) -> list[Column]:
    """Each order ends with the slug, so results are the same every time. Unknown dates and words sort as the smallest."""
    days, words = F.coalesce(F.col("publication.days"), F.lit(0)), F.coalesce(F.col("words"), F.lit(0.0))
    series = [F.coalesce(fold(F.col("series")), F.lit("")), F.coalesce(F.col("series_index"), F.lit(0.0))]
    return {
        "pub-date-older-first": [days.asc()], "pub-date-newer-first": [days.desc()],
        "est-read-time-shorter-first": [words.asc()], "est-read-time-longer-first": [words.desc()],
        "number-asc": [series[1].asc()], "number-desc": [series[1].desc()],
    }.get(name, [F.col("score").desc(), *(c.asc() for c in series)]) + [F.col("slug").asc()]


def series_sort_keys(name: str) -> list[Column]:
    """The orders of a series' page: by number unless named otherwise; dates that are equal go by number."""
    days, words = F.coalesce(F.col("publication.days"), F.lit(0)), F.coalesce(F.col("words"), F.lit(0.0))
    number = F.coalesce(F.col("series_index"), F.lit(0.0))
    return {
        "pub-date-older-first": [days.asc(), number.asc()], "pub-date-newer-first": [days.desc(), number.asc()],
        "number-desc": [number.desc()], "est-read-time-shorter-first": [words.asc()], "est-read-time-longer-first": [words.desc()],
    }.get(name, [number.asc()]) + [F.col("slug").asc()]


# ---- predicates on analyzed text


def all_terms(field_tokens: Column, query_tokens: Column) -> Column:
    """Every query token is in the field; no query tokens match nothing."""
    return (F.size(query_tokens) > 0) & (F.size(F.array_except(query_tokens, field_tokens)) == 0)


def any_term(field_tokens: Column, query_tokens: Column) -> Column:
    return F.arrays_overlap(field_tokens, query_tokens)


def phrase(field_tokens: Column, query_tokens: Column, n: int) -> Column:
    """The n query tokens stand in a row in the field."""
    places = F.sequence(F.lit(1), F.greatest(F.size(field_tokens) - n + 1, F.lit(1)))
    return (F.size(field_tokens) >= n) & F.exists(places, lambda i: F.slice(field_tokens, i, n) == query_tokens)


def joined(c: Column) -> Column:
    return F.concat_ws(" ", c)


def active_analyzers(df: DataFrame) -> list[str]:
    """The analyzers of the languages present, and the default one ('')."""
    here = df.select(F.substring("language", 1, 2).alias("l")).where(F.col("l").isin(*LANGUAGES)).distinct()
    return ["", *sorted(r["l"] for r in here.limit(len(LANGUAGES)).collect())]


def composed(keywords: str, analyzers: list[str]) -> Column:
    """authors(all) or illustrators(all) or, per analyzer, title(all), series(all), description(all); or an author's and a title's word.

    A document's own language picks the analyzer of its fields (none known: the default); the query runs through all.
    """
    q0 = tokens(F.lit(keywords))
    authors, illustrators = tokens(joined(F.col("authors"))), tokens(joined(F.col("illustrators")))
    legs = [all_terms(authors, q0), all_terms(illustrators, q0)]
    some = []
    for lang in analyzers:
        own = F.substring(F.coalesce(F.col("language"), F.lit("")), 1, 2)
        mine = (own == lang) if lang else ~own.isin(*[a for a in analyzers if a]) if len(analyzers) > 1 else F.lit(True)
        cut = (lambda c, keep, lang=lang: analyzed(c, lang, keep)) if lang else (lambda c, keep: tokens(c))
        q_keep, q_stop = cut(F.lit(keywords), True), cut(F.lit(keywords), False)
        title = cut(F.col("title"), True)
        legs += [
            mine & all_terms(title, q_keep), mine & all_terms(cut(F.col("series"), True), q_keep),
            mine & all_terms(cut(F.col("description"), False), q_stop),
        ]
        some.append(mine & any_term(title, q_stop))
    legs.append(any_term(authors, q0) & reduce(or_, some))
    return reduce(or_, [F.coalesce(x, F.lit(False)) for x in legs])


RANGES = {"Words": "words", "Pages": "pages", "Illustrations": "illustrations", "SeriesIndex": "series_index", "Publication.Date": "publication.days"}
DATES = {"AddedOn": "added_on"}


@dataclass
class Clause:
    """A part of a query string: its sign, what it matches, what its score counts with which boost, and, for plain terms,
    the fields (a row for each that may hold them) and tokens an index can look up."""

    sign: str
    hit: Column
    counts: list[tuple[Column, float]]
    fields: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    boost: float = 1.0


def text_of(columns: list[str]) -> Column:
    """The text of some of the catalogue's columns, one after the other."""
    return F.concat_ws(" ", *[F.col(c) if c in ("series", "title", "description") else joined(F.col(c)) for c in columns])


def clauses(text: str) -> list[Clause]:
    """The query-string language: field:term, "phrase", +must and -mustnot, wildcards * and ?, term~ or term~2 (fuzzy),
    /regex/, ranges Field:>n and the like on numbers and Field:>"2020-01-01" on times, ^boosts. A bare term looks in all text fields."""
    out = []
    for sign, name, quoted, quoted_boost, regex, regex_boost, term in re.findall(r'([+-]?)(?:([\w.]+):)?(?:"([^"]*)"(?:\^([\d.]+))?|/((?:[^/\\]|\\.)+)/(?:\^([\d.]+))?|(\S+))', text):
        m = re.search(r"\^([\d.]+)$", term)
        boost = float(quoted_boost or regex_boost or (m[1] if m else 1) or 1)
        term = term[: m.start()] if m else term
        if name in RANGES and (m := re.fullmatch(r"(>=|<=|>|<)?(-?[\d.]+)", term)):
            out.append(Clause(sign, _compared(F.col(RANGES[name]), m[1], F.lit(float(m[2]))), []))
        elif name in DATES and (m := re.fullmatch(r'(>=|<=|>|<)?"?(\d{4}-\d\d-\d\d[T\d:.Z]*)"?', term or quoted)):
            out.append(Clause(sign, _compared(F.col(DATES[name]), m[1], F.lit(m[2]).cast("timestamp")), []))
        else:
            names = [name] if name in FIELDS else [*FIELDS, "Description"]
            cols = [FIELDS.get(n, "description") for n in names]
            hit = reduce(or_, [F.coalesce(_one(text_of([c]), quoted, regex, term), F.lit(False)) for c in cols])
            plain = not quoted and not regex and not re.search(r"~\d?$|[*?]", term)
            terms = query_terms(term) if plain else []
            body = text_of(cols)
            counts = [(term_count(body, w), boost) for w in terms] if plain else [(_often(body, quoted, regex, term), boost)]
            out.append(Clause(sign, hit, counts, names if plain else [], terms, boost))
    return out


def _compared(c: Column, how: str | None, n: Column) -> Column:
    return F.coalesce({">": c > n, ">=": c >= n, "<": c < n, "<=": c <= n}.get(how or "", c == n), F.lit(False))


def combined(parts: list[tuple[str, Column]]) -> Column:
    """Signed conditions in one: all of the + ones, none of the - ones, and one of the others if there is no + one."""
    must, may, never = ([h for x, h in parts if x == k] for k in ("+", "", "-"))
    out = must + ([reduce(or_, may)] if may and not must else []) + [~x for x in never]
    return reduce(and_, out) if out else F.lit(True)


def query_string(text: str) -> Column:
    """The predicate of a query string."""
    return combined([(c.sign, c.hit) for c in clauses(text)])


def _token_test(regex: str, term: str) -> Callable[[Column], Column] | None:
    """What a token must meet for a regular expression, a fuzzy term or one with wildcards; None for a plain term."""
    if regex:
        return lambda t: t.rlike(f"^(?:{regex})$")
    if m := re.fullmatch(r"(.+?)~(\d?)", term):
        word, most = F.lit(" ".join(query_terms(m[1]))), int(m[2] or 1)
        return lambda t: F.levenshtein(t, word) <= most
    if "*" in term or "?" in term:
        pattern = "^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in term.lower()) + "$"
        return lambda t: t.rlike(pattern)
    return None


def _one(c: Column, quoted: str, regex: str, term: str) -> Column:
    if quoted:
        q = query_terms_in_order(quoted)
        return phrase(tokens(c), F.array(*[F.lit(t) for t in q]), len(q)) if q else F.lit(False)
    test = _token_test(regex, term)
    return F.exists(tokens(c), test) if test else all_terms(tokens(c), tokens(F.lit(term)))


def _often(c: Column, quoted: str, regex: str, term: str) -> Column:
    """How often a phrase, or tokens that meet a test, stand in a text."""
    t = tokens(c)
    if quoted:
        q = query_terms_in_order(quoted)
        n = len(q)
        places = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
        return F.size(F.filter(places, lambda i: F.slice(t, i, n) == F.array(*[F.lit(w) for w in q]))) if q else F.lit(0)
    return F.size(F.filter(t, _token_test(regex, term)))


def mode(keywords: str) -> str:
    """How keywords are read: 'all' (none given), 'query' (query string), 'slugs' or 'composed'."""
    text = keywords.strip()
    if not text:
        return "all"
    if re.match(r'(?:Authors|Illustrators|Series|Title|Subjects):|"', text):
        return "query"
    return "slugs" if re.match(r"(?:AuthorsSlugs|IllustratorsSlugs|SeriesSlug):", unquote_plus(text)) else "composed"


def slug_keys(keywords: str) -> tuple[str, list[str]]:
    """The field and the keys of a search by slugs."""
    name, _, keys = unquote_plus(keywords.strip()).partition(":")
    return name, [x.strip() for x in keys.split(",") if x.strip()]


def predicate(keywords: str, analyzers: list[str] | Callable[[], list[str]]) -> Column:
    """The keywords' predicate by mode. `analyzers` may be a function, called only where needed."""
    how = mode(keywords)
    if how == "all":
        return F.lit(True)
    if how == "query":
        return query_string(keywords.strip())
    if how == "slugs":
        name, keys = slug_keys(keywords)
        column = F.col(SLUG_FIELDS[name])
        return column.isin(keys) if name == "SeriesSlug" else F.arrays_overlap(column, F.array(*[F.lit(k) for k in keys]))
    return composed(keywords.strip(), analyzers() if callable(analyzers) else analyzers)


# ---- BM25


def query_terms(keywords: str) -> list[str]:
    """The distinct default-analyzer tokens of a short query."""
    return list(dict.fromkeys(query_terms_in_order(keywords)))


def query_terms_in_order(keywords: str) -> list[str]:
    """The default-analyzer tokens of a short query, computed without a job."""
    from stackroom.functions.text import FOLD_FROM, FOLD_PAIRS, FOLD_TO

    text = keywords.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    for a, b in FOLD_PAIRS:
        text = text.replace(a, b)
    return [w for w in re.split(r"[\W_]+", text) if w]


def term_pattern(term: str) -> str:
    """A regular expression for a folded term as a whole token of unfolded text: each letter in any case and with any accent.

    Counting its matches spares folding and taking apart every text; only the terms are expanded.
    """
    from stackroom.functions.text import FOLD_FROM, FOLD_PAIRS, FOLD_TO

    marked: dict[str, str] = {}
    for a, b in zip(FOLD_FROM, FOLD_TO, strict=True):
        marked[b] = marked.get(b, "") + a
    ligatures = {b: a for a, b in FOLD_PAIRS}
    out, i = [], 0
    while i < len(term):
        two, c = term[i : i + 2], term[i]
        plain = [f"[{x}{marked[x]}]" if x in marked else re.escape(x) for x in two]
        if two in ligatures:
            out.append(f"(?:{''.join(plain)}|{ligatures[two]})")
            i += 2
        else:
            out.append(f"[{c}{marked[c]}]" if c in marked else re.escape(c))
            i += 1
    return rf"(?iu)(?<![\p{{L}}\p{{N}}]){''.join(out)}(?![\p{{L}}\p{{N}}])"


def term_count(text: Column, term: str) -> Column:
    """How often a folded term stands in a text; NULL counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(term_pattern(term))), F.lit(0))


def bm25(df: DataFrame, text: Column, keywords: str, k1: float = K1, b: float = B) -> DataFrame:
    """`df` with a score column for the rows that hold a term of the query; scores are rounded to 6 digits."""
    terms = query_terms(keywords)
    if not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    tf = [term_count(text, w) for w in terms]
    length = F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")), F.lit(0))
    # one row: the collection's statistics
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("avgdl"), *[F.sum((c > 0).cast("bigint")).alias(f"df{i}") for i, c in enumerate(tf)]
    ).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    # what holds no term is dropped before its length is counted
    hits = df.withColumns({f"__tf{i}": c for i, c in enumerate(tf)}).where(reduce(or_, [F.col(f"__tf{i}") > 0 for i in range(len(terms))]))
    hits = hits.withColumn("__dl", length)
    score = F.lit(0.0)
    for i in range(len(terms)):
        d, c = stats[f"df{i}"] or 0, F.col(f"__tf{i}")
        idf = F.log(1 + (F.lit(float(n)) - d + 0.5) / (F.lit(float(d)) + 0.5))
        score = score + idf * c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("__dl") / F.lit(avgdl)))
    return hits.withColumn("score", F.round(score, 6)).drop("__dl", *[f"__tf{i}" for i in range(len(terms))])


def build_postings(df: DataFrame, key: str, fields: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """An inverted index: postings (field, token, key, tf, dl) and field statistics (field, n, avgdl).

    Written partitioned by field and sorted by token, a search reads a few row groups only. The postings shuffle once on
    (field, token, key), after partial counts.
    """
    per = [df.select(key, F.lit(f).alias("field"), tokens(c).alias("toks")) for f, c in fields.items()]
    rows = reduce(DataFrame.unionByName, per).withColumn("dl", F.size("toks"))
    postings = rows.select(key, "field", "dl", F.explode("toks").alias("token")).groupBy("field", "token", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    stats = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return postings, stats


def search_postings(postings: DataFrame, stats: DataFrame, key: str, name: str, keywords: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) from a materialised index: an equality scan on the terms, one small aggregate, one sum per document."""
    terms = query_terms(keywords)
    s = stats.where(F.col("field") == name).first()
    if s is None or not terms:
        return postings.select(key, F.lit(0.0).alias("score")).limit(0)
    hits = postings.where((F.col("field") == name) & F.col("token").isin(terms))
    dfs = {r["token"]: r["df"] for r in hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")).collect()}
    if not dfs:
        return postings.select(key, F.lit(0.0).alias("score")).limit(0)
    df = F.element_at(F.create_map(*[F.lit(x) for kv in dfs.items() for x in kv]), F.col("token"))
    idf = F.log(1 + (F.lit(float(s["n"])) - df + 0.5) / (df + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(s["avgdl"])))
    return hits.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


ALL_TEXT = ["title", "series", "authors", "illustrators", "description"]


def word_counts(words: str) -> list[tuple[Column, float]]:
    """How often each word stands in all text fields."""
    return [(term_count(text_of(ALL_TEXT), w), 1.0) for w in query_terms(words)]


def weight(tf: Column, n: float, d: float, boost: float = 1.0) -> Column:
    """BM25 without length normalisation of one term: `tf` times in this document, in `d` of `n` documents."""
    return boost * F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5))) * tf * (K1 + 1) / (tf + K1)


def ranked(df: DataFrame, s: SearchFields, words: str | list[tuple[Column, float]]) -> DataFrame:
    """The hits of the request's filters, scored by words over all text fields or by given counts with boosts, and sorted."""
    counts = word_counts(words) if isinstance(words, str) else words
    hits = df.where(reduce(and_, filters(s), F.lit(True)))
    if not counts:
        return hits.withColumn("score", F.lit(0.0)).orderBy(*sort_keys(s.sort))
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum((c > 0).cast("bigint")).alias(f"d{i}") for i, (c, _) in enumerate(counts)]).first()
    score = reduce(lambda a, b: a + b, [weight(c, float(stats["n"]), float(stats[f"d{i}"] or 0), boost) for i, (c, boost) in enumerate(counts)])
    return hits.withColumn("score", F.round(score, 6)).orderBy(*sort_keys(s.sort))


UNSCORED = ("pub-date-older-first", "pub-date-newer-first", "est-read-time-shorter-first", "est-read-time-longer-first", "number-asc", "number-desc")


def search(df: DataFrame, s: SearchFields, index=None) -> DataFrame:
    """The ordered hits of a request over a catalogue of `with_slugs`, with their score. Page them with `catalog.page`.

    Keywords are scored by their words over all text fields, a query string by the terms of its clauses that may or must
    match, each in its fields. With an `index` of that catalogue, searches by words read its postings and of the catalogue
    only the columns the filters, the order and the caller need.
    """
    s = s.normalised()
    scored = s.sort not in UNSCORED
    if index is not None and (found := index.hits(s.keywords, scored)) is not None:
        hits = df.where(reduce(and_, filters(s), F.lit(True)))
        return hits.join(found, "slug").orderBy(*sort_keys(s.sort))
    s.extra = [*s.extra, predicate(s.keywords, lambda: active_analyzers(df))]
    how = mode(s.keywords) if scored else ""
    counts = word_counts(s.keywords) if how == "composed" else []
    if how == "query":
        counts = [x for c in clauses(s.keywords.strip()) if c.sign != "-" for x in c.counts]
    return ranked(df, s, counts)
