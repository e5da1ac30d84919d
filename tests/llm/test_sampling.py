from __future__ import annotations

from stackroom.llm.sampling import smallest_hashes, smallest_hashes_by


def test_same_rows_at_every_size(spark):
    df = spark.range(5000).selectExpr("id AS k", "concat('t', id) AS t")
    got = smallest_hashes(df, "k", 50, 5000).collect()
    everything = smallest_hashes(df, "k", 50, 1).collect()
    assert got == everything and len({r["k"] for r in got}) == 50 and df.columns == ["k", "t"]
    assert smallest_hashes(df.limit(0), "k", 50, 0).count() == 0 and smallest_hashes(df, "k", 9000, 5000).count() == 5000


def test_sparse_and_rare_labels_are_sampled(spark):
    """The bounds follow the rows sampled from, and a rare label has its least rows."""
    df = spark.range(20_000).selectExpr("id AS k", "CASE WHEN id % 4000 = 7 THEN 'rare' WHEN id % 100 = 0 THEN 'odd' ELSE 'often' END AS code")
    got = [(r["k"], r["code"]) for r in smallest_hashes_by(df, "k", "code", 100, 30).collect()]
    by = {c: sum(x == c for _, x in got) for c in ("rare", "odd", "often")}
    assert len(set(got)) == len(got) and by["rare"] == 5 and by["odd"] >= 30 and by["often"] >= 60 and len(got) <= 100 + 60
    first = {r["k"] for r in smallest_hashes(df, "k", 100, 20_000).collect()}
    assert first <= {k for k, _ in got}
    assert smallest_hashes_by(df.limit(0), "k", "code", 10, 5).count() == 0
