from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackroom.llm.canon import fold, language_entries, lookup, map_catalogue, shards_of, subject_entries
from stackroom.llm.edit import BKTree, codes_of, distances, edit_distance

WORD = st.text(alphabet="abc", max_size=7)


def slow(a, b):
    """Damerau-Levenshtein by the plain recurrence over all transposed pairs."""
    inf = len(a) + len(b)
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            for k in range(1, i):
                for m in range(1, j):
                    if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                        best = min(best, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            d[i, j] = min(best, inf)
    return d[len(a), len(b)]


@settings(max_examples=150, deadline=None)
@given(WORD, WORD, WORD)
def test_metric(a, b, c):
    assert edit_distance(a, b) == slow(a, b) == edit_distance(b, a)
    assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)


@settings(max_examples=80, deadline=None)
@given(st.lists(WORD, max_size=40), WORD, st.integers(0, 3))
def test_tree_finds_all(words, q, r):
    assert sorted(BKTree(words).within(q, r)) == sorted((edit_distance(q, w), w) for w in set(words) if edit_distance(q, w) <= r)


@settings(max_examples=80, deadline=None)
@given(WORD, st.lists(WORD, min_size=1, max_size=30), st.integers(0, 3))
def test_many_at_once(word, words, r):
    assert distances(word, *codes_of(words)).tolist() == [edit_distance(word, w) for w in words]
    tree = BKTree(words)
    assert [sorted(x) for x in tree.within_many([word, *words], r)] == [sorted(tree.within(w, r)) for w in [word, *words]]


SUBJECTS = [
    {"subject_id": 1, "label": "Maritime history", "also": None}, {"subject_id": 2, "label": "Fables, animal", "also": None}, {"subject_id": 3, "label": "Customs & tariffs", "also": []},
    {"subject_id": 4, "label": "Science fiction", "also": ["Sci-fi", "SF", "Ciencia ficción"]}, {"subject_id": 5, "label": "Adventure stories", "also": None},
    {"subject_id": 6, "label": "Short stories", "also": None}, {"subject_id": 7, "label": "Labour movement", "also": None}, {"subject_id": 8, "label": "Astronomy", "also": None},
]
LANGS = [{"code": c, "code3": c3, "name": n, "native_name": nn} for c, c3, n, nn in (("en", "eng", "English", "English"), ("es", "spa", "Spanish", "español"), ("da", "dan", "Danish", "dansk"))]


@pytest.mark.parametrize("shard", [2, 100])
@pytest.mark.parametrize(
    ("value", "ref"),
    [
        ("maritime  HISTORY.", "1"), ("History, maritime", "1"), ("Maritime hist.", "1"), ("Maritmie histroy", "1"), ("#fables,animal", "2"), ("Animal fables", ""), ("Customs and tariffs", "3"),
        ("ciencia ficcion", "4"), ("sf", "4"), ("asdf", ""), ("x", ""), ("st.", ""), ("Adventure st.", "5"), ("Labour mvmt", "7"), ("Gastronomy", "8"), ("to read", ""), ("Astronmoys", "8"),
    ],
)
def test_subject(value, ref, shard):
    assert lookup(shards_of(subject_entries(SUBJECTS), False, shard), value) == ref


@pytest.mark.parametrize(
    ("value", "ref"),
    [(" en", "en"), ("en-AU", "en"), ("EN_us", "en"), ("es;", "es"), ("SPA", "es"), ("in Spanish", "es"), ("Spanish (es)", "es"), ("castellano", "es"), ("Spaniish", "es"), ("zxx", ""), ("??", ""), ("unknown", ""), ("Sanish", "es")],
)
def test_language(value, ref):
    assert lookup(shards_of(language_entries(LANGS), True, 100), value) == ref


def test_sharding_changes_nothing():
    rng = random.Random(2)
    rows = [{"subject_id": i, "label": "".join(rng.choice("abcde ") for _ in range(9)).strip() or "zz", "also": None} for i in range(60)]
    entries = subject_entries(rows)
    whole, cut = shards_of(entries, False, 1000), shards_of(entries, False, 7)
    for _ in range(200):
        q = list(rng.choice(rows)["label"])
        q[rng.randrange(len(q))] = rng.choice("abcde")
        v = "".join(q)
        best = min(((edit_distance(fold(v), fold(r["label"])), r["subject_id"]) for r in rows if len(fold(r["label"])) >= 4), default=None)
        assert lookup(whole, v) == lookup(cut, v)
        if len(fold(v)) >= 4 and best[0] <= 1:
            got = lookup(whole, v)
            assert edit_distance(fold(v), fold(rows[int(got)]["label"])) <= best[0]


META = "file_id bigint, subjects array<string>, language string, field string, pos int, ref string, value string"


def test_catalogue(spark):
    s = spark.createDataFrame(SUBJECTS, "subject_id int, label string, also array<string>")
    g = spark.createDataFrame(LANGS, "code string, code3 string, name string, native_name string")
    rows = [
        (1, ["Maritime history", "maritime history", None, " ", "asdf"], "en", "f", 9, "r", "v"), (2, None, None, None, None, None, None), (3, [], "  ", None, None, None, None),
        (4, ["x" * 20000], "xx", None, None, None, None), (1, ["SF"], "English.", None, None, None, None),
    ]
    got = sorted((r["file_id"], r["field"], r["pos"], r["ref"]) for r in map_catalogue(spark.createDataFrame(rows, META), s, g).collect())
    assert got == [(1, "language", 0, "en"), (1, "subjects", 0, "4"), (1, "subjects", 1, "1"), (1, "subjects", 4, ""), (4, "language", 0, ""), (4, "subjects", 0, "")]
    assert map_catalogue(spark.createDataFrame([], META), s, g).count() == 0
    assert {r["ref"] for r in map_catalogue(spark.createDataFrame(rows, META), s.limit(0), g.limit(0)).collect()} == {""}


def test_unusable_list_rows(spark):
    """NULL labels, names and references in the lists cost no row of the catalogue."""
    s = spark.createDataFrame([*((r["subject_id"], r["label"], r["also"]) for r in SUBJECTS), (9, None, None), (10, None, ["Gardens", None]), (None, "Ghosts", None)], "subject_id int, label string, also array<string>")
    g = spark.createDataFrame([*(tuple(r.values()) for r in LANGS), (None, "x", "Nolang", "y"), ("fr", None, None, "français")], "code string, code3 string, name string, native_name string")
    rows = [(1, ["maritime HISTORY", "gardens", "Maritime history", "ghosts"], "Francais", None, None, None, None), (2, ["nolang"], "Nolang", None, None, None, None)]
    got = sorted((r["file_id"], r["field"], r["pos"], r["ref"]) for r in map_catalogue(spark.createDataFrame(rows, META), s, g).collect())
    assert got == [(1, "language", 0, "fr"), (1, "subjects", 0, "1"), (1, "subjects", 1, "10"), (1, "subjects", 3, ""), (2, "language", 0, ""), (2, "subjects", 0, "")]


def test_long_lists_are_searched_in_shards(spark, monkeypatch):
    """Lists beyond one shard give the same references, whatever the number of shards and parts."""
    import stackroom.llm.canon as m

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(160)]
    subjects = [(i, f"{rng.choice(words)} {rng.choice(words)}".capitalize(), [rng.choice(words)] if i % 4 == 0 else None) for i in range(120)]
    s = spark.createDataFrame(subjects, "subject_id int, label string, also array<string>")
    g = spark.createDataFrame(LANGS, "code string, code3 string, name string, native_name string")

    def typed(t):
        t = list(t)
        t[rng.randrange(len(t))] = rng.choice("abxyz")
        return rng.choice(["".join(t), "".join(t).upper(), "".join(t)[:4] + ".", " ".join(x[:2] + "." for x in "".join(t).split())])

    rows = [(i, [typed(rng.choice(subjects)[1]) for _ in range(3)] + ["hot  value", None], rng.choice(["Spaniish", "en-GB", "??", None]), None, None, None, None) for i in range(150)]
    df = spark.createDataFrame(rows, META)
    ask = lambda: sorted(map(tuple, map_catalogue(df, s, g).collect()))
    whole = ask()
    monkeypatch.setattr(m, "SHARD_SIZE", 7)
    monkeypatch.setattr(m, "PART_VALUES", 50)
    assert ask() == whole and len({r[4] for r in whole}) > 40
