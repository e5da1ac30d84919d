from __future__ import annotations

import random

import pytest

from stackroom.llm.cutoff import cut_rates, features, length_limits, limits_of, looks_intact, place, scored

NOUN = "the old ship,each quiet river,that small garden,one narrow window,this silver clock,a hidden letter".split(",")
VERB = "hides follows guards measures forgets remembers".split()
PLACE = "behind the customs house,between two wars,with great patience,near Bodosugen,after the fire in Keheturob,for the sake of a promise".split(",")


def sentence(rng):
    s = f"{rng.choice(NOUN)} {rng.choice(VERB)} {rng.choice(NOUN)} {rng.choice(PLACE)}"
    return s[0].upper() + s[1:]


def intact(rng):
    return ". ".join(sentence(rng) for _ in range(rng.randint(2, 6))) + rng.choice([".", ".", ".", "?", "!", ".”"])


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(1500):
        t, src = intact(rng), rng.choice("abcd")
        if src == "a" and len(t) > 150:
            t = t[:150]
            if not t.endswith((".", "?", "!")):
                cut.add(i)
        elif src == "b" and rng.random() < 0.2:
            t = t[: rng.randint(20, len(t) - 8)]
            if not t.rstrip().endswith((".", "?", "!")):
                t = t.rstrip() + rng.choice(["…", "...", ""])
                cut.add(i)
        elif src != "a" and rng.random() < 0.15:
            t = rng.choice([t.rstrip(".”!?") + "…", t + "\n— Ann Lee, Rome", t + "\nKeywords: ships; old clocks", t + "\n* * *", t + " (Rome, 1999)", "\n".join(sentence(rng) for _ in range(3))])
        rows.append((i, t, src, len(t), 1, "x"))
    return rows, cut


SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, limit int, near string"


def test_held_out_accuracy(spark, cases):
    rows, cut = cases
    got = {r["doc_id"]: r["p_cut"] for r in scored(spark.createDataFrame(rows, SCHEMA), sample=800).collect()}
    said = {i for i, p in got.items() if p >= 0.5}
    assert len(said & cut) >= 0.97 * len(cut) and len(said & cut) >= 0.97 * len(said)


def test_rates_and_limits(spark, cases):
    rows, cut = cases
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in length_limits(df, "text", "source").collect()] == [("a", 150)]
    for r in cut_rates(df).collect():
        n = sum(x[2] == r["source"] for x in rows)
        assert r["texts"] == n and abs(r["share"] - sum(x[2] == r["source"] and x[0] in cut for x in rows) / n) < 0.03


def test_odd_input(spark, cases):
    rows = [*cases[0], (9001, None, "a", 0, 1, "x"), (9002, "", None, 0, 1, "x"), (9003, "  ", "a", 0, 1, "x"), (9004, "Word " * 50_000 + "end.", None, 0, 1, "x"), (9001, None, "a", 0, 1, "x")]
    got = [(r["doc_id"], r["p_cut"] >= 0.5) for r in scored(spark.createDataFrame(rows, SCHEMA)).where("doc_id > 9000").collect()]
    assert sorted(got) == [(9001, False), (9001, False), (9002, False), (9003, False), (9004, False)]
    assert scored(spark.createDataFrame([], SCHEMA)).count() == 0


def test_intact_forms():
    assert all(looks_intact(t) for t in ("A b.", "A b.”", "A b.</p>", "A.\n— Ann, Rome", "A.\nKeywords: a; b", "one\ntwo", "A (x)", "A.\n* * *"))
    assert not any(looks_intact(t) for t in ("", " ", "A b", "A b…", "A b...", "A. And th"))
    assert "form=signed" in features("A b.\n— Ann Lee, Rome", False, 2)


def test_limits_below_the_longest_text_and_in_bytes(spark):
    """A few longer texts hide no limit, limits in bytes are found, and repeated texts make none."""
    rng = random.Random(8)
    rows = []
    for _ in range(800):
        t = intact(rng)
        rows.append((t[:160], "a") if rng.random() < 0.97 else (t, "a"))
        rows.append((t.replace("e", "é").encode()[:200].decode(errors="ignore"), "b"))
        rows.append((t if rng.random() < 0.8 else rows[1][0], "c"))
    df = spark.createDataFrame([*rows, *[("One text many times over.", "c")] * 100], "text string, source string")
    got = {tuple(r) for r in limits_of(df, "text", "source").collect()}
    assert ("a", "chars", 160) in got and ("b", "bytes", 200) in got and not [g for g in got if g[0] == "c"]


def test_places():
    assert [place("x" * n, [10], []) for n in (5, 7, 10, 11)] == [(False, 2), (False, 1), (True, 0), (False, 2)]
    assert place("é" * 5, [], [10]) == (True, 0) and place("", [], []) == (False, 2)
