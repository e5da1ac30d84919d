from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackroom.operators.split_values import packed_epub_values, split_names, split_subjects

LABELS = ["Fables, animal", "Letters; diaries", "Maps / charts", "Poetry", "Customs & tariffs"]


def run(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Poetry; Botany", ["Poetry", "Botany"]),
        ("fables, ANIMAL, Botany", ["fables, ANIMAL", "Botany"]),
        ("Maps / charts / Botany", ["Maps / charts", "Botany"]),
        ('"Salt; roads", Geology,', ["Salt; roads", "Geology"]),
        ('["Bridge construction", "The \\"low road\\" cycle"]', ["Bridge construction", 'The "low road" cycle']),
        ('Nursing, "The ""low road"" cycle"', ["Nursing", 'The "low road" cycle']),
        ("Espionage ;; Poetry", ["Espionage", "Poetry"]),
        ("Geology\nLetters; diaries", ["Geology", "Letters; diaries"]),
        ("a|b • c", ["a", "b", "c"]),
        ("Customs & tariffs", ["Customs & tariffs"]),
        ("", []),
        (" ; ,", []),
        (None, []),
        ("x\ue0000\ue001y; z", ["x\ue0000\ue001y", "z"]),
        ("1; ", ["1", ""]),
    ],
)
def test_subjects(spark, text, want):
    assert run(spark, lambda c: split_subjects(c, LABELS), [text]) == [want]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Moxsebked, Jürgen von", ["Moxsebked, Jürgen von"]),
        ("Ann Lee, Bob K. Roy y Cy Poe", ["Ann Lee", "Bob K. Roy", "Cy Poe"]),
        ("Lee, Ann & Roy, Bob", ["Lee, Ann", "Roy, Bob"]),
        ("Lee, Ann|Roy, Bob", ["Lee, Ann", "Roy, Bob"]),
        ('"Lee, Ann","Roy, Bob"', ["Lee, Ann", "Roy, Bob"]),
        ("Lee, Ann, Roy, Bob", ["Lee, Ann", "Roy, Bob"]),
        ("Ann Lee, and Bob Roy", ["Ann Lee", "Bob Roy"]),
        ("Rome Museum of Glass & Light", ["Rome Museum of Glass & Light"]),
        ("Rome Society for Ships and Tides; Ann Lee", ["Rome Society for Ships and Tides", "Ann Lee"]),
        ("Ann Lee with Bob Roy; Cy Poe", ["Ann Lee", "Bob Roy", "Cy Poe"]),
        ("Ann Lee\nBob Roy", ["Ann Lee", "Bob Roy"]),
    ],
)
def test_names(spark, text, want):
    assert run(spark, split_names, [text]) == [want]


def test_round_trip_of_quoted_values(spark):
    """Whatever is quoted comes back whole: random values with delimiters, quotes and placeholder characters."""
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(200):
        vals = ["v" + "".join(rng.choice('ab;,|/"\\1 ') for _ in range(rng.randint(1, 8))) + "x" for _ in range(rng.randint(2, 4))]
        texts.append("; ".join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in vals))
        want.append(vals)
    assert run(spark, lambda c: split_subjects(c, []), texts) == want


SCHEMA = "info_id bigint, subject array<string>, creator array<struct<full_name:string,role:string>>, field string, pos int, vals string"


def test_records(spark):
    rows = [
        (1, ["Poetry; Botany", None, "", "Poetry"], [("Lee, Ann & Roy, Bob", "aut"), (None, "")], "x", 7, "y"),
        (2, None, None, None, None, None),
        (3, [], [], None, None, None),
        (1, ["Poetry; Botany"], None, None, None, None),
        (4, ["; ".join(f"s{i}" for i in range(5000))], None, None, None, None),
    ]
    got = packed_epub_values(spark.createDataFrame(rows, SCHEMA), LABELS)
    assert got.columns == ["info_id", "field", "elem", "pos", "val"]
    out = [tuple(r) for r in got.collect()]
    assert sorted(x for x in out if x[0] == 1) == sorted(
        [(1, "subject", 0, 0, "Poetry"), (1, "subject", 0, 1, "Botany")] * 2 + [(1, "creator", 0, 0, "Lee, Ann"), (1, "creator", 0, 1, "Roy, Bob")]
    )
    assert sum(x[0] == 4 for x in out) == 5000
    assert packed_epub_values(spark.createDataFrame([], SCHEMA), []).count() == 0


def test_plan_has_no_shuffle_or_python(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = packed_epub_values(df, LABELS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_long_label_lists_are_joined(spark, monkeypatch):
    """More labels than one pattern takes give the same values."""
    import stackroom.operators.split_values as m

    rng = random.Random(4)
    words = ["Fables", "animal", "Maps", "charts (old)", "Poetry", "roads", "Salt"]
    labels = sorted({f"{rng.choice(words)}{rng.choice([', ', '; ', ' / ', ','])}{rng.choice(words)}" for _ in range(20)}) + ["Fables, animal, roads", "Poetry", None]
    join = lambda: rng.choice(["; ", ", ", " | ", "/", "\n"]).join(rng.choice([*words, *labels[:-1], '"a; b"', " see " + labels[0]]) for _ in range(rng.randint(1, 5)))
    rows = [(i // 2, [rng.choice([str.upper, str])(join()) for _ in range(rng.randint(0, 3))] + [None], [("Lee, Ann & Roy, Bob", "aut")], "x", 7, "y") for i in range(80)]
    df, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in labels], "label string")
    whole = sorted(map(tuple, packed_epub_values(df, table).collect()))
    assert whole == sorted(map(tuple, packed_epub_values(df, [x for x in labels if x]).collect()))
    monkeypatch.setattr(m, "MAX_LABELS", 3)
    assert sorted(map(tuple, packed_epub_values(df, table).collect())) == whole and len(whole) > 150
