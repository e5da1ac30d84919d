"""A stored inverted index over a catalogue: searches read the postings of their terms instead of all texts.

Tables under one folder:

* postings (field, lang, token, slug, tf): partitioned by field and sorted by token, so an equality on tokens reads a few row
  groups. A token that a third of the documents have spans several files: rows are range-partitioned by (field, token, slug).
* terms (field, token, documents): the document frequencies, stored when the index is built.
* meta: the number of documents and the languages whose analyzers are in use.

Fields: 'All' and each text field under the default analyzer, the title, series and description under the analyzer of the
document's language ('Title:own' ...), and the slugs of authors, illustrators, series and subjects.

Defined results: NULL and empty fields have no postings; repeated documents are indexed once each under their slug; a query
without tokens finds nothing; an empty catalogue gives an index without postings.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions.analyze import LANGUAGES, analyze_tokens, analyzed
from stackroom.functions.text import tokens
from stackroom.operators import search

OWN = {"Title": ("title", True), "Series": ("series", True), "Description": ("description", False)}
SLUGS = {**search.SLUG_FIELDS, "SubjectsSlugs": "subjects_slugs"}


POSTING = "token string, slug string, lang string, tf int, field string"
TERM = "token string, documents bigint, field string"


def build(df: DataFrame, folder: str) -> Index:
    """Writes the index of a catalogue of `with_slugs` into a folder: one scan, one shuffle after partial counts."""
    own = F.substring(F.coalesce(F.col("language"), F.lit("")), 1, 2)
    lang = F.when(own.isin(*LANGUAGES), own).otherwise("")
    fields = [("All", F.lit(""), tokens(search.text_of(search.ALL_TEXT)))]
    fields += [(n, F.lit(""), tokens(search.text_of([c]))) for n, c in {**search.FIELDS, "Description": "description"}.items()]
    fields += [(f"{n}:own", lang, analyzed(F.col(c), lang, keep)) for n, (c, keep) in OWN.items()]
    none = F.array().cast("array<string>")
    fields += [(n, F.lit(""), F.array(F.col(c)) if c == "series_slug" else F.coalesce(F.col(c), none)) for n, c in SLUGS.items()]
    one = F.array(*[F.struct(F.lit(n).alias("field"), k.alias("lang"), t.alias("tokens")) for n, k, t in fields])
    rows = df.select("slug", F.explode(one).alias("v")).select("slug", "v.field", "v.lang", F.explode("v.tokens").alias("token"))
    postings = rows.where(F.col("token") != "").groupBy("field", "lang", "token", "slug").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    order = ["field", "token", "slug"]
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("field").parquet(f"{folder}/postings")
    spark = df.sparkSession
    terms = spark.read.schema(POSTING).parquet(f"{folder}/postings").groupBy("field", "token").agg(F.count(F.lit(1)).alias("documents"))
    terms.repartitionByRange("field", "token").sortWithinPartitions("field", "token").write.mode("overwrite").partitionBy("field").parquet(f"{folder}/terms")
    meta = df.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(lang)).alias("languages"))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    return Index(spark, folder)


class Index:
    """A stored index, opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.postings = spark.read.schema(POSTING).parquet(f"{folder}/postings")
        self.terms = spark.read.schema(TERM).parquet(f"{folder}/terms")
        row = spark.read.parquet(f"{folder}/meta").first()
        self.documents, self.languages = row["n"], [x for x in row["languages"] if x]

    def frequencies(self, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """In how many documents each (field, token) stands."""
        if not wanted:
            return {}
        by: dict[str, list[str]] = {}
        for f, t in wanted:
            by.setdefault(f, []).append(t)
        rows = self.terms.where(reduce(or_, [(F.col("field") == f) & F.col("token").isin(ts) for f, ts in by.items()])).collect()
        return {(r["field"], r["token"]): r["documents"] for r in rows}

    def keyed(self, name: str, keys: list[str]) -> DataFrame:
        """(slug, matches): the documents that have one of the slugs `keys`, and how many of them."""
        rows = self.postings.where((F.col("field") == name) & F.col("token").isin(keys))
        return rows.groupBy("slug").agg(F.count(F.lit(1)).alias("matches"))

    def hits(self, keywords: str, scored: bool = True) -> DataFrame | None:
        """(slug, score) of what the keywords match; None for what needs the texts themselves."""
        how = search.mode(keywords)
        if how == "slugs":
            return self.keyed(*search.slug_keys(keywords)).select("slug", F.lit(0.0).alias("score"))
        if how == "composed":
            return self._composed(keywords.strip(), scored)
        if how == "query":
            return self._query(search.clauses(keywords.strip()), scored)
        return None

    def _found(self, tests: dict[str, Column], score: Column | None, hit) -> DataFrame:
        """One sum per test and document over the postings that meet any of them."""
        rows = self.postings.where(reduce(or_, tests.values()))
        sums = [F.sum(t.cast("int")).alias(k) for k, t in tests.items()]
        sums.append((F.lit(0.0) if score is None else F.sum(score)).alias("__score"))
        got = rows.groupBy("slug").agg(*sums)
        return got.where(hit).select("slug", F.round(F.coalesce("__score", F.lit(0.0)), 6).alias("score"))

    def _score(self, parts: list[tuple[str, str, float]]) -> Column | None:
        """The sum over (field, token, boost) of the weights of a posting."""
        often = self.frequencies([(f, t) for f, t, _ in parts])
        out = [
            F.when((F.col("field") == f) & (F.col("token") == t), search.weight(F.col("tf"), float(self.documents), float(often.get((f, t), 0)), boost))
            .otherwise(0.0) for f, t, boost in parts
        ]
        return reduce(lambda a, b: a + b, out) if out else None

    def _composed(self, keywords: str, scored: bool) -> DataFrame:
        plain = search.query_terms_in_order(keywords)
        tests: dict[str, Column] = {}
        legs: list[Column] = []

        def add(name: str, lang: str | None, words: list[str]) -> Column:
            """The number of distinct words of `words` a document has in a field."""
            k = f"t{len(tests)}"
            test = (F.col("field") == name) & F.col("token").isin(sorted(set(words)))
            tests[k] = test if lang is None else test & (F.col("lang") == lang)
            return F.col(k)

        def all_of(name: str, lang: str | None, words: list[str]) -> None:
            if words:
                legs.append(add(name, lang, words) == len(set(words)))

        all_of("Authors", None, plain)
        all_of("Illustrators", None, plain)
        titles = []
        for lang in ["", *self.languages]:
            keep, stop = analyze_tokens(plain, lang, True), analyze_tokens(plain, lang, False)
            all_of("Title:own", lang, keep)
            all_of("Series:own", lang, keep)
            all_of("Description:own", lang, stop)
            if stop:
                titles.append(add("Title:own", lang, stop) > 0)
        if plain and titles:
            legs.append((add("Authors", None, plain) > 0) & reduce(or_, titles))
        if not legs:
            return self.postings.select("slug", F.lit(0.0).alias("score")).limit(0)
        words = search.query_terms(keywords) if scored else []
        if words:
            add("All", None, words)
        return self._found(tests, self._score([("All", w, 1.0) for w in words]), reduce(or_, legs))

    def _query(self, parts: list[search.Clause], scored: bool) -> DataFrame | None:
        if any(not c.terms for c in parts) or not any(c.sign != "-" for c in parts):
            return None
        tests: dict[str, Column] = {}
        signed, counted = [], []
        for c in parts:
            hits = []
            for name in c.fields:
                k = f"t{len(tests)}"
                tests[k] = (F.col("field") == name) & F.col("token").isin(c.terms)
                hits.append(F.col(k) == len(c.terms))
            signed.append((c.sign, reduce(or_, hits)))
            if c.sign != "-" and scored:
                if len(c.fields) > 1:
                    return None  # a bare term's score counts it over all fields, subjects included
                counted += [(c.fields[0], w, c.boost) for w in c.terms]
        return self._found(tests, self._score(counted), search.combined(signed))
