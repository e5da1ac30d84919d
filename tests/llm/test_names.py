from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import stackroom.llm.names as m
from stackroom.llm.edit import edit_distance

META = "file_id bigint, authors array<string>, illustrators array<string>, name string, entity string, node string, label string"


def pairs(spark, names, extra=()):
    rows = [(i, [n], None, "x", "y", "z", "l") for i, n in enumerate(names)] + list(extra)
    df = spark.createDataFrame(rows, META)
    return {(r["name_a"], r["name_b"]) for r in m.variant_pairs(df, ["authors", "illustrators"]).collect()}


def linked(groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_spellings(spark):
    groups = [
        ["Theodore Zecsovnix", "Zecsovnix, Theodore", "T. Zecsovnix", "Zecsovnix, T.", "Theo. Zecsovnix", "Theo Zecsovnix", "Dr. Theodore Zecsovnix", "THEODORE ZECSOVNIX", "Theodore  Zecsovnix.", "Theodore_Zecsovnix", "Theodroe Zecsovnix"],
        ["Ignacio F. Lekribden", "Nacho Lekribden", "I. F. Lekribden", "I.F. Lekribden", "Ignacio Lekribden"],
        ["Katherine de Binzecvol", "de Binzecvol, Katherine", "DE BINZECVOL, Katherine", "Kath. de Binzecvol", "Kitty Binzecvol"],
        ["Ann Katfiskat", "Katfiskat, Ann"], ["Bob Katfiskat", "Katfiskat, B.", "Bob L. Katfiskat"],
        ["Gregory B. Godpex", "Godpex, Gregory B."], ["Gregory D. Godpex"],
        ["José Rezsifgar", "Jose Rezsifgar"],
        ["Pozavuseg Museum of Glass & Light", "Museum of Glass & Light, Pozavuseg", "The Pozavuseg Museum of Glass and Light", "Pozavuseg Mus. of Glass & Light", "Pozatuseg Museum for Glass & Light"],
        ["Kikopurid Academy of Rural Crafts"],
    ]
    assert pairs(spark, [n for g in groups for n in g]) == linked(groups)


def test_turned_round_by_evidence(spark):
    names = ["Pagbaltab, Penelope", "Penelope Pagbaltab", "Pagbaltab Penelope", "Penelope R. Geslogmak", "Geslogmak Penelope"]
    assert pairs(spark, names) == linked([names[:3], names[3:]])


def test_ambiguous_initials_stay_apart(spark):
    names = ["Ann Lekribden", "Amy Lekribden", "A. Lekribden"]
    assert pairs(spark, names) == set()
    assert pairs(spark, ["Ann B. Lekribden", "Amy C. Lekribden", "A. C. Lekribden"]) == {("A. C. Lekribden", "Amy C. Lekribden")}


def test_odd_input(spark):
    extra = [(90, None, None, None, None, None, None), (91, [None, "", " ", "?"], [], None, None, None, None), (92, ["Solo"], ["solo", "SOLO "], None, None, None, None), (93, ["x" * 3000 + " Y"], None, None, None, None, None), (92, ["Solo"], None, None, None, None, None)]
    assert pairs(spark, [], extra) == linked([["Solo", "solo", "SOLO "]])
    assert pairs(spark, []) == set()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
def test_neighbours_meet_within_one_edit(a, b):
    if edit_distance(a, b) <= 1:
        assert m.neighbours(a) & m.neighbours(b)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcd", max_size=9), st.text(alphabet="abcd", max_size=9), st.lists(st.text(alphabet="abcde", max_size=9), min_size=1, max_size=9))
def test_cells_keep_near_pairs_together(a, b, pivots):
    if edit_distance(a, b) <= 1:
        ca, cb = m.Pivots(pivots).cells([a, b], 1)
        assert set(ca) & set(cb)


@pytest.mark.parametrize("cell_rows", [20_000, 40])
def test_radius_join_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(m, "CELL_ROWS", cell_rows)
    rng = random.Random(6)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(250)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r["a"], r["b"]) for r in m.radius_pairs(df).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and edit_distance(a, b) <= 1}


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    assert {r["node"]: r["label"] for r in m.components(nodes, edges).collect()} == dict(zip("abcdxyz", "aaaaxxz", strict=True))


def test_components_of_long_chains(spark):
    """Chains of many more hops than rounds, in order and shuffled, are one component each."""
    order = list(range(90))
    random.Random(3).shuffle(order)
    chains = [[f"a{i:03d}" for i in range(90)], [f"b{i:03d}" for i in order]]
    edges = spark.createDataFrame([(min(x, y), max(x, y)) for c in chains for x, y in zip(c, c[1:], strict=False)], "a string, b string")
    nodes = spark.createDataFrame([(n,) for c in chains for n in c], "node string")
    got = {r["node"]: r["label"] for r in m.components(nodes, edges).collect()}
    assert got == {n: min(c) for c in chains for n in c}


def test_rare_given_names_turn_names_round(spark):
    """One given name of rank beyond any capped list still turns its 'Surname Given' spelling round."""
    from itertools import product

    often = ["".join(x) for x in product("abcdefgh", repeat=5)][:20_500]
    df = spark.createDataFrame([(f"{s}, {g}",) for g in often for s in ("Qua", "Quo")] + [("Pagbaltab, Zzyzx",), ("Pagbaltab Zzyzx",)], "name string")
    got = {r["name"]: r["known"] for r in m._with_given(df).where("name LIKE 'Pag%'").collect()}
    assert got == {"Pagbaltab, Zzyzx": None, "Pagbaltab Zzyzx": ["zzyzx"]}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", max_size=8), st.text(alphabet="abcd", max_size=8), st.lists(st.text(alphabet="abcde", max_size=9), min_size=1, max_size=9), st.integers(1, 2))
def test_any_radius_keeps_pairs(a, b, pivots, r):
    if edit_distance(a, b) <= r:
        assert m.neighbours(a, r) & m.neighbours(b, r)
        ca, cb = m.Pivots(pivots).cells([a, b], r)
        assert set(ca) & set(cb)


@pytest.mark.parametrize("cell_rows", [20_000, 40])
def test_radius_two_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(m, "CELL_ROWS", cell_rows)
    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(200)}
    got = {tuple(r) for r in m.radius_pairs(spark.createDataFrame([(w,) for w in words], "word string"), 2).collect()}
    assert got == {(a, b, edit_distance(a, b)) for a in words for b in words if a < b and edit_distance(a, b) <= 2}


def test_two_typos_and_short_keys(spark):
    names = ["Christopher Tivdomsox", "Cristopher Tivdomsxo", "Ann Lee", "Anm Lee", "Bol", "Bom", "Anastasia Gidtampex", "Anastasia Hidtabpex"]
    assert pairs(spark, names) == linked([names[:2], names[2:4]])


def test_organisations(spark):
    groups = [["Siemens AG", "SIEMENS AG", "Siemens GmbH"], ["Universität Wien", "Universitat Wien"], ["Acme Corporation", "Acme, Inc."], ["Verlag Roter Stern"], ["Ag Siemens"], ["Inc, Ann"]]
    assert pairs(spark, [n for g in groups for n in g]) == linked(groups)
    assert [m.organisation_key(n) for n in ("A. G. Siemens", "Corp", "Ann Ltd Lee", "limited")] == [None] * 4


def test_entities_and_nicknames_given(spark):
    df = spark.createDataFrame([(["Quincey Lekribden", "Zaz Lekribden", None, "Ann Poe"], ["Poe, Ann"])], "authors array<string>, illustrators array<string>")
    got = lambda **k: sorted(map(tuple, m.named_entities(df, ["authors", "illustrators"], **k).collect()))
    apart = [("Ann Poe", "Ann Poe", 2), ("Poe, Ann", "Ann Poe", 2), ("Quincey Lekribden", "Quincey Lekribden", 1), ("Zaz Lekribden", "Zaz Lekribden", 1)]
    assert got() == apart
    assert got(nicknames={"Quincey": "zaz"})[2:] == [("Quincey Lekribden", "Quincey Lekribden", 2), ("Zaz Lekribden", "Quincey Lekribden", 2)]


@pytest.mark.parametrize("radius", [1, 2])
def test_long_words_share_a_piece(monkeypatch, radius):
    monkeypatch.setattr(m, "LONG", 20)
    rng = random.Random(radius)
    for _ in range(3000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(18, 34)))
        b = list(a)
        for _ in range(radius):
            i, how = rng.randrange(len(b) - 1), rng.randrange(4)
            b[i : i + 2] = [[b[i + 1], b[i]], [b[i]], [b[i], "x", b[i + 1]], ["y", b[i + 1]]][how]
        b = "".join(b)
        if edit_distance(a, b) <= radius:
            assert m.neighbours(a, radius) & m.neighbours(b, radius)


def test_very_long_names(spark):
    """Names of thousands of letters have few keys and are still linked."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(2000)).capitalize()
    assert len(m.neighbours(long, 2)) < 200
    assert pairs(spark, [f"Ann {long}", f"Ann {long[:900]}x{long[900:]}", "Bob Katfiskat"]) == linked([[f"Ann {long}", f"Ann {long[:900]}x{long[900:]}"]])


def test_typos_are_joined_by_words(spark, monkeypatch):
    """The radius join runs over the distinct words of the keys, within one edit, not over the keys."""
    joined, plain = [], m.radius_pairs
    monkeypatch.setattr(m, "radius_pairs", lambda words, radius=1: joined.append((words.count(), radius)) or plain(words, radius))
    rng = random.Random(8)
    first, last = ([f"{kind}{''.join(rng.choice('abcdefghijklm') for _ in range(9))}" for _ in range(20)] for kind in ("person:", ""))
    first.append(first[0][:-1] + "z")
    last.append("z" + last[0][1:])
    nodes = [f"{x} {y}" for x in first for y in last]
    got = {tuple(r) for r in m.typo_pairs(spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert joined == [(42, 1)]
    near = [{first[0], first[-1]}, {last[0], last[-1]}]
    alike = lambda a, b: all(x == y or {x, y} in near for x, y in zip(a.split(), b.split(), strict=True))
    assert got == {(a, b) for a in nodes for b in nodes if a < b and alike(a, b)}


@pytest.mark.parametrize("letters", [(5, 16), (2, 6), (0, 3)])
def test_typos_against_brute_force(spark, monkeypatch, letters):
    """Also where edits put in, take out or move blanks, and where two edits change more than two words."""
    monkeypatch.setattr(m, "LETTERS", letters)
    rng = random.Random(9)
    keys = {" ".join("".join(rng.choice("ab") for _ in range(rng.choice([1, 1, 2, 2, 3, 7]))) for _ in range(rng.choice([1, 2, 2, 3, 4, 5]))) for _ in range(420)}
    keys |= {"a b cc", "ab c c", "xb ab y", "x ba by", "xa bc d", "x abc ed", "ab cd xef", "ab cdx ef", "annmarie lee", "ann marie lee", "ann arie lee"}
    nodes = sorted(f"{kind}:{k}" for k in keys for kind in ("person", "org"))

    def near(a, b):
        x, y = (len(n.split(":")[1]) for n in (a, b))
        if min(x, y) < letters[0] or a[:3] != b[:3] or (d := edit_distance(a, b)) > 2:
            return False
        if d < 2 or min(x, y) < letters[1]:
            return d < 2
        v, w = a.split(" "), b.split(" ")
        return len(v) == len(w) and all(edit_distance(p, q) <= 1 for p, q in zip(v, w, strict=True))

    got = {tuple(r) for r in m.typo_pairs(spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert got == {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if near(a, b)}
