from __future__ import annotations

import random

import numpy as np
import pytest

from stackroom.llm.leak import FMIndex, Windows, leaked, leaked_items, leaked_spans, words_of


@pytest.mark.parametrize("sigma", [2, 3, 9, 40])
def test_index_against_brute_force(sigma):
    rng = np.random.default_rng(sigma)
    seq = rng.integers(1, sigma, 600)
    seq[300:360] = seq[100:160]  # a long repeat
    fm = FMIndex(seq, sample=7)
    text = [*seq.tolist(), 0]
    for n in (1, 3, 8):
        pats = np.array([seq[i : i + n] for i in rng.integers(0, 590, 20)] + [rng.integers(1, sigma + 2, n) for _ in range(20)])
        lo, hi = fm.search(pats)
        for p, a, b in zip(pats.tolist(), lo, hi, strict=True):
            want = [i for i in range(len(text) - n + 1) if text[i : i + n] == p]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want
    assert FMIndex(np.array([1])).search(np.array([[2]]))[1][0] == 0


def test_words():
    assert words_of("<p>Every­one’s “CAFÉ”, mill-stone</p>\n&amp; Straße_2") == ["everyones", "café", "millstone", "strasse", "2"]
    assert words_of("") == []


def brute(docs, items, n):
    out = set()
    for item, p in items:
        w = words_of(p)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for d, t in docs:
            v = words_of(t or "")
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, item))
    return out


def corpus(seed, n_docs=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab ba cab dab é Der die x1".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 40)))) for i in range(12)]
    docs = []
    for d in range(n_docs):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        w = rng.choice(items)[1].split()
        k = rng.randint(1, len(w))
        parts.append(rng.choice(["{}", "<b>{}</b>", "“{}”,", "{}\n"]).format(" ".join(w[:k]).upper()))
        docs.append((d, rng.choice([None, " zzz ".join(parts), " ".join(parts)])))
    return docs, items


@pytest.mark.parametrize("shard", [50, 100_000])
@pytest.mark.parametrize("n", [6, 12])
def test_against_brute_force(spark, n, shard):
    docs, items = corpus(n)
    d = spark.createDataFrame([(*x, "e", 5) for x in docs], "doc_id bigint, text string, spans string, item_id int")
    i = spark.createDataFrame([(*x, "t") for x in items], "item_id bigint, passage string, text string")
    got = leaked(d, i, n=n, shard_words=shard).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items, n) and len(got) == len({(r[0], r[1]) for r in got})
    passages = dict(items)
    for r in got:
        w, p = words_of(dict(docs)[r["doc_id"]]), words_of(passages[r["item_id"]])
        grams = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}
        inside = {k for a, b in r["spans"] for k in range(a, b)}
        assert inside == {j for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for j in range(k, k + n)}


def test_odd_input(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, None), (3, "too short")], "item_id bigint, passage string")
    long = "y " * 50_000 + " ".join(f"W{i}" for i in range(12)) + " z" * 50_000
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (1, long), (4, " ".join(f"w{i}" for i in range(11)))], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaked(docs, items).collect()) == [(1, 1), (1, 1)]
    assert leaked(docs.limit(0), items).count() == 0 and leaked(docs, items.limit(0)).count() == 0
    assert Windows([], 12).patterns.shape == (0, 12)


def test_slices_and_long_tags_change_nothing(spark):
    docs, items = corpus(5)
    d = spark.createDataFrame([(k, t and t.replace("<b>", f'<b class="{"x" * 400}">')) for k, t in docs], "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    whole = sorted(map(str, leaked(d, i, n=6).collect()))
    assert sorted(map(str, leaked(d, i, n=6, slice_bytes=300).collect())) == whole
    assert {(r["doc_id"], r["item_id"]) for r in leaked(d, i, n=6).collect()} == brute(docs, items, 6)


def test_many_passages_one_scan(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20_000)]
    docs = [(d, " ".join(word() for _ in range(100)) + " " + " ".join(items[d * 60][1].split()[3:20])) for d in range(300)]
    got = leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {(r["doc_id"], r["item_id"]): r["spans"] for r in got.collect()} == {(d, d * 60): [[100, 117]] for d in range(300)}


def test_items_and_spans(spark):
    w = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(w[:30])), (2, " ".join(w[30:])), (3, "none")], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, " ".join([*w[:14], "x", *w[5:17]])), (2, " ".join(w))], "doc_id bigint, text string")
    assert sorted(map(tuple, leaked_spans(docs, items).collect())) == [(1, 1, 0, 14), (1, 1, 15, 27), (2, 1, 0, 30), (2, 2, 30, 60)]
    assert sorted(map(tuple, leaked_items(docs, items).collect())) == [(1, 2, 56), (2, 1, 30)]
