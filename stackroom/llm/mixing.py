"""Sources mixed to target shares of the tokens (problem 9).

Method: subset-sum budget fitting. Documents are counted by exact token length per source; the total is the largest the
repeat caps allow (or `total`), a source's budget its share of it. Whole passes over the source come first; of the rest every
length gives the same fraction of its documents; what then remains (less than one document per length) is filled
by a bounded-knapsack dynamic programme over the leftover counts, so the budget is met to the token where any
combination does. Documents of a length are chosen by a seeded hash.

`window` is the budget the programme works on in one piece: what is left above it is first filled with single documents in
seeded order. A window of the whole budget leaves everything to the programme.

Scale: token counts are made once and written to the shared checkpoint folder. Only histograms (source, length, count) are
gathered, one source per task; the driver sees one number. Of a length's documents the hash's buckets are taken whole in
order, and only the one bucket on the border is ranked, so no task ranks all documents of a length.

Defined results: NULL texts, texts without tokens and documents of sources that aren't targets are left out; a source without
documents makes every mix empty unless its share is 0; repeated documents count each; a source named twice in the targets
keeps its smallest share; a share of 0 takes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.operators.joins import broadcast_checked
from stackroom.session import ensure_checkpoint_dir, spread

BUCKETS = 1024
WINDOW = 20_000

_encoders: dict[str, object] = {}


def default_vocabulary() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The tokenizer of a vocabulary file of ranks; one a worker."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, text: str, path: str):
    @F.pandas_udf("int")
    def count(t: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([len(x) for x in enc.encode_ordinary_batch(t.tolist(), num_threads=1)])

    return count(F.col(text))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int, seed: int = 1,
               window: int = WINDOW) -> tuple[int, np.ndarray]:
    """(whole passes, documents of each length that are used once more) whose tokens come closest to `budget` from below."""
    tokens = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), dtype=np.int64)
    if tokens <= 0 or budget <= 0:
        return 0, extra
    passes = int(min(max_repeats, budget // tokens))
    left = int(budget - passes * tokens)
    if passes >= max_repeats or left <= 0:
        return passes, extra
    # the same fraction of every length, in whole documents
    extra = np.array([c * left // tokens for c in counts.tolist()], dtype=np.int64)
    left -= int((extra * lengths).sum())
    free = counts - extra
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:  # single documents in seeded order until the rest fits the programme's window
        n = int(lengths[i])
        if left <= window:
            break
        take = min(int(free[i]), max(1, (left - window) // (n * len(lengths))))
        if n <= left and take:
            extra[i] += take
            free[i] -= take
            left -= take * n
    # bounded knapsack: reachable sums as the bits of one integer, kept before each length for the way back
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for i in order:
        n, c = int(lengths[i]), int(min(free[i], left // max(1, int(lengths[i]))))
        if c <= 0:
            continue
        steps.append((i, n, c, reach))
        k = 1
        while c > 0:
            piece = min(k, c)
            reach |= (reach << (piece * n)) & mask
            c -= piece
            k *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, n, c, before in reversed(steps):
        used = next(k for k in range(c + 1) if at >= k * n and before >> (at - k * n) & 1)
        extra[i] += used
        at -= used * n
    return passes, extra


def stated(targets: DataFrame, source: str) -> DataFrame:
    """(source, target_share, max_repeats), one row per source: the smallest share stated for it."""
    goals = targets.groupBy(F.col("source").alias(source)).agg(F.min(F.struct("target_share", F.col("max_repeats").cast("int").alias("max_repeats"))).alias("g"))
    return goals.select(source, "g.*")


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            total: int | None = None, vocabulary: str | None = None, seed: int = 1, window: int = WINDOW) -> DataFrame:
    """(key, source, n_tokens, copies) of the documents the mix uses. `vocabulary` is the path of a byte-level rank file."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = vocabulary or default_vocabulary()
    goals = stated(targets, "src").where("target_share > 0").checkpoint()
    rows = docs.select(F.col(key), F.col(text).alias("__t"), F.col(source).alias("src")).where(F.col("__t").isNotNull())
    rows = rows.join(broadcast_checked(goals.select("src")), "src", "left_semi")
    counted = spread(rows).select(key, "src", token_counts(rows, "__t", path).alias("n_tokens")).where("n_tokens > 0").checkpoint()
    hist = counted.groupBy("src", "n_tokens").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    # the total: as large as the source that runs out first allows
    sizes = hist.groupBy("src").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("size"))
    reach = goals.join(sizes, "src", "left").agg(F.min(F.coalesce("size", F.lit(0)) * F.col("max_repeats") / F.col("target_share")).alias("r")).first()["r"]
    whole = int(min(reach or 0.0, total) if total is not None else reach or 0.0)
    budgets = goals.select("src", F.rint(F.lit(float(whole)) * F.col("target_share")).cast("bigint").alias("budget"), F.col("max_repeats").alias("most"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        goal = pdf.iloc[0]
        passes, extra = fit_budget(pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(goal["budget"]), int(goal["most"]), seed, window)
        return pd.DataFrame({"src": goal["src"], "n_tokens": pdf["n_tokens"].to_numpy(), "base": passes, "extra": extra})

    fitted = hist.join(broadcast_checked(budgets), "src").groupBy("src").applyInPandas(fit, "src string, n_tokens int, base int, extra bigint").checkpoint()
    hashed = counted.withColumn("h", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).withColumn("hb", F.pmod("h", F.lit(BUCKETS)))
    buckets = hashed.groupBy("src", "n_tokens", "hb").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("src", "n_tokens").orderBy("hb")) - F.col("n")
    border = (
        buckets.withColumn("before", before)
        .join(fitted, ["src", "n_tokens"])
        .withColumn("want", F.col("extra") - F.col("before"))
        .select("src", "n_tokens", "hb", "base", "want", ((F.col("want") > 0) & (F.col("want") < F.col("n"))).alias("split"))
    )
    placed = hashed.join(border, ["src", "n_tokens", "hb"])
    whole_buckets = placed.where(~F.col("split")).withColumn("more", (F.col("want") > 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy("src", "n_tokens", "hb").orderBy("h", key))
    ranked = placed.where("split").withColumn("more", (rank <= F.col("want")).cast("int"))
    chosen = whole_buckets.unionByName(ranked).withColumn("copies", F.col("base") + F.col("more")).where("copies > 0")
    return chosen.select(key, F.col("src").alias(source), "n_tokens", "copies")


def shares(docs: DataFrame, targets: DataFrame, **names) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, share, copies_max): what each source really gives."""
    mix = mixture(docs, targets, **names)
    source = mix.columns[1]
    per = mix.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies_max")
    )
    per = per.withColumn("one", F.lit(1))
    all_tokens = per.groupBy("one").agg(F.sum("tokens").alias("all"))  # one row
    per = per.join(F.broadcast(all_tokens), "one").drop("one")
    return stated(targets, "source").join(per, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"),
        F.coalesce("copies_max", F.lit(0)).alias("copies_max"),
    )
