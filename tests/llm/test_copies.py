from __future__ import annotations

import random
import unicodedata
from collections import defaultdict

import stackroom.llm.copies as m

META = "file_id bigint, title string, authors array<string>, t string, a string, f1 int, n int"


def key(title, authors):
    def bare(x):
        x = unicodedata.normalize("NFC", x.upper() if "ǰ" not in x else x)
        return "".join(c for c in unicodedata.normalize("NFC", x) if c.isalnum() or unicodedata.category(c)[0] == "M")

    return bare(title), tuple(sorted(b for b in (bare(x) for x in authors or [] if x) if b))


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[1] and key(r[1], r[2])[0]:
            groups[key(r[1], r[2])].append(r[0])
    return sorted({(min(v), f) for v in groups.values() for f in v if f != min(v)})


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], META)
    return sorted((r["first_id"], r["file_id"]) for r in m.copies(df).collect())


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.choice(["The River of Ré", "La Straße", "Über uns", "Река"])
        t = rng.choice([str, str.upper, str.lower, str.swapcase, str.title])(t)
        t = rng.choice([t, t.replace(" ", "_"), f'"{t}"', t + "​!", unicodedata.normalize("NFD", t), "[" + t.replace(" ", "  ") + "]"])
        who = rng.sample(["Ann Lee", "Bob Roy", "Zoë Poe"], rng.randint(0, 3))
        who = [unicodedata.normalize(rng.choice(["NFC", "NFD"]), rng.choice([str, str.upper])(w)) for w in who] + rng.choice([[], [""], [" "]])
        out.append((i, t, rng.choice([who, who or None])))
    return out


def test_random_formatting(spark):
    rows = rows_of(300, 4)
    assert found(spark, rows) == brute(rows)


def test_cases(spark):
    rows = [
        (1, "A b", ["X", "Y"]), (2, "ab", ["y", "x"]), (3, "A-B", ["x"]), (4, "á b", ["x"]), (5, None, ["x"]), (6, "", None), (7, "?!", None), (8, None, None),
        (9, "Ab", None), (10, "aB", [""]), (11, "AB", [None, " "]), (12, "ab", ["x", "x"]), (13, "ab", ["x", "X "]), (14, "z" * 50_000, []), (15, "Z" * 50_000, None), (2, "ab", ["y", "x"]),
    ]
    assert found(spark, rows) == sorted([(1, 2), (1, 2), (9, 10), (9, 11), (12, 13), (14, 15)])
    assert found(spark, []) == []


def test_hot_group(spark, monkeypatch):
    """A third of all rows in one group, by way of the broadcast."""
    monkeypatch.setattr(m, "HOT_SHARE", 10)
    rows = [(i, "Hot title" if i % 3 == 0 else f"T{i // 7}", ["A"]) for i in range(4000)]
    assert found(spark, rows) == brute(rows)


def test_collisions_are_regrouped(spark, monkeypatch):
    """With hashes that always collide the fields themselves still part the works."""
    from pyspark.sql import functions as F

    one = F.lit(1).cast("decimal(38,0)")
    monkeypatch.setattr(m, "fingerprinted", lambda rows: rows.withColumns({"f1": one, "f2": one}))
    rows = [(1, "a", ["x"]), (2, "A", ["X"]), (3, "b", ["x"]), (4, "B", ["x"]), (5, "a", ["y"]), (6, "a", ["Y"])]
    assert found(spark, rows) == brute(rows)


def test_counts(spark):
    rows = [(1, "a", ["x"]), (2, "A", ["X"]), (3, "b", ["x"]), (4, None, None)]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], META)
    assert sorted(map(tuple, m.works(df).collect())) == [(1, 2), (3, 1)]


def test_counts_are_verified(spark, monkeypatch):
    """With hashes that always collide the fields themselves still part the works."""
    from pyspark.sql import functions as F

    one = F.lit(1).cast("decimal(38,0)")
    monkeypatch.setattr(m, "fingerprinted", lambda rows: rows.withColumns({"f1": one, "f2": one}))
    rows = [(1, "a", ["x"]), (2, "A", ["X"]), (2, "A", ["X"]), (3, "b", ["x"]), (4, "B", ["x"]), (5, "c", ["y", "x"])]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], META)
    assert sorted(map(tuple, m.works(df).collect())) == [(1, 3), (3, 2), (5, 1)]
