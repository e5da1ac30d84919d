from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest

from stackroom.llm.mixing import encoder, default_vocabulary, fit_budget, mixture, shares


def test_budget_is_met_as_well_as_any_choice_can():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(2, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        total = int((lengths * counts).sum())
        most = rng.randint(1, 3)
        budget = rng.randint(0, max(1, total * most))
        passes, extra = fit_budget(lengths, counts, budget, most)
        used = passes * total + int((extra * lengths).sum())
        assert used <= max(budget, 0) and passes + (extra.max() > 0) <= most and (extra <= counts).all()
        if total and passes < most:
            left = budget - passes * total
            best = max(s for s in (int(np.dot(c, lengths)) for c in product(*[range(k + 1) for k in counts])) if s <= left)
            # the equal fraction comes first, so at most the shortest text's length may be missed on tiny sources
            assert best - (used - passes * total) <= int(lengths.max())


def test_large_budget_is_met_to_the_token():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(20, 900, 400))
    counts = rng.integers(1, 400, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (total // 3, total + total // 7, 12345):
        passes, extra = fit_budget(lengths, counts, budget, 3)
        assert passes * total + int((extra * lengths).sum()) == budget


DOCS = "doc_id bigint, text string, source string, n_tokens int, copies int, src string"


def corpus(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice(["big"] * 6 + ["mid", "mid", "tiny", None, "other"]), 1, 2, "s") for i in range(900)]
    rows += [(9000, None, "big", 1, 2, "s"), (9001, "", "tiny", 1, 2, "s"), (9002, "long " * 20_000, "other", 1, 2, "s")]
    return spark.createDataFrame(rows, DOCS)


def test_shares(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 3), ("tiny", 0.3, 4), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    docs = corpus(spark)
    got = {r["source"]: r for r in shares(docs, targets).collect()}
    assert all(abs(got[s]["share"] - t) < 0.003 for s, t in (("big", 0.5), ("mid", 0.2), ("tiny", 0.3)))
    assert got["none"]["tokens"] == 0 and all(r["copies_max"] <= r["max_repeats"] for r in got.values())
    mix = mixture(docs, targets)
    assert mix.columns == ["doc_id", "source", "n_tokens", "copies"]
    rows = mix.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    enc = encoder(default_vocabulary())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(len(enc.encode_ordinary(text[r["doc_id"]])) == r["n_tokens"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture(docs, targets).collect()))


@pytest.mark.parametrize("total", [500, 5000])
def test_given_total(spark, total):
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.4, 2)], "source string, target_share double, max_repeats int")
    used = {r["source"]: r["tokens"] for r in shares(corpus(spark), targets, total=total).collect()}
    assert abs(used["big"] - 0.6 * total) <= 61 and abs(used["mid"] - 0.4 * total) <= 61


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixture(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mixture(corpus(spark), targets.limit(0)).count() == 0
    missing = spark.createDataFrame([("big", 0.5, 2), ("ghost", 0.5, 2)], "source string, target_share double, max_repeats int")
    assert mixture(corpus(spark), missing).count() == 0


def test_repeated_targets_and_whole_window(spark):
    """A source stated twice keeps its smallest share; a window of the whole budget meets it to the token."""
    targets = spark.createDataFrame([("mid", 0.5, 2), ("big", 0.5, 1), ("mid", 0.9, 9)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in shares(corpus(spark), targets, total=4000, window=10**9).collect()}
    assert {s: r["target_share"] for s, r in got.items()} == {"mid": 0.5, "big": 0.5} and got["mid"]["max_repeats"] == 2
    assert {r["tokens"] for r in got.values()} == {2000}
