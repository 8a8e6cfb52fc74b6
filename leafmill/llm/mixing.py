"""Problem 7: mixing sources to target weights.

Each source's documents get an exact place, in tokens, in a random order of the source: hash
buckets are summed first, so that no source is ever sorted in one task. A document is taken once
for each round of its source in which its middle lies before the source's quota. The quotas are
cut into blocks of tokens; a multivariate-hypergeometric splitting tree deals each source's block
count out among the shards, halving the shards at each node, and permuted blocks are drawn, disjoint,
to fill them. Rows are then shuffled within their shard. The tree is grown FAN shards at a time,
each node in its own task, so neither sources nor shards nor offsets ever come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from leafmill.llm import bpe
from leafmill.plans import cut

#: Documents aimed at in a bucket, tokens in a block and in a shard, children of a node of the tree dealt out in one step.
BUCKET_ROWS = 20_000
BLOCK_TOKENS = 1 << 13
SHARD_TOKENS = 1 << 18
FAN = 256
SEED = 20


def splitting_tree(counts: np.ndarray, first: int, last: int, fan: int, rng: np.random.Generator) -> list[tuple[int, int, np.ndarray]]:
    """counts of each source dealt out exactly among the shards first..last-1, down to at most `fan` ranges of them: (first, last, counts) of each."""
    work, depth = [(first, last, counts.astype(np.int64))], 0
    while 2 << depth <= fan and any(b - a > 1 for a, b, _ in work):
        halves = []
        for a, b, c in work:
            if b - a == 1:
                halves.append((a, b, c))
                continue
            m = (a + b) // 2
            left = int(c.sum()) * (m - a) // (b - a)
            got = rng.multivariate_hypergeometric(c, left, method="count" if c.sum() < 1_000_000 else "marginals")
            halves += [(a, m, got), (m, b, c - got)]
        work, depth = halves, depth + 1
    return work


def permuted(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Pseudo-random permutations of range(n) at the places k, one for each seed: Feistel networks with cycle walking."""
    k, n, seed = (np.atleast_1d(np.asarray(x)).astype(np.uint64) for x in np.broadcast_arrays(k, n, seed))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        h, m = half[at], mask[at]
        left, right = x >> h, x & m
        for r in range(4):
            mix = (right + seed[at] * np.uint64(1000003) + np.uint64(r * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((mix ^ (mix >> np.uint64(29))) >> np.uint64(13) & m)
        return left << h | right

    every = np.arange(len(k))
    x = once(k, every)
    while len(over := every[x[every] >= n[every]]):
        x[over] = once(x[over], over)
        every = over
    return x.astype(np.int64)


def _quotas(counted: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """source, whole (its tokens), quota (those it gives) and blocks of each target source that has tokens.

    Without `total` the mixture is the largest in which every source that has tokens gets its
    share; with it, a source whose cap is less than its share of `total` gives its cap.
    """
    want = _targets(targets).where("target_share > 0")
    tokens = counted.groupBy("source").agg(F.sum("n_tokens").alias("whole"))
    live = want.join(tokens, "source").withColumn("most", F.col("whole") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).where("most > 0")
    live = cut(live)
    scale = live.agg(F.sum("target_share").alias("all"), F.min(F.col("most") / F.col("target_share")).alias("room")).first()
    size = (total if total is not None else (scale.room or 0.0) * (scale["all"] or 0.0)) / (scale["all"] or 1.0)
    quota = F.least(F.floor(F.col("target_share") * F.lit(float(size)) + 1e-6), F.col("most")).cast("bigint")
    return live.select("source", "whole", quota.alias("quota")).where("quota > 0").withColumn("blocks", F.ceil(F.col("quota") / BLOCK_TOKENS).cast("bigint"))


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _dealt(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, place (of a block in the source's permuted order) and shard, one row for each block."""
    tree = quotas.select(F.lit(0).cast("bigint").alias("a"), F.lit(shards).cast("bigint").alias("b"), "source", F.lit(0).cast("bigint").alias("begin"), F.col("blocks").alias("n"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", kind="stable")
        a, b = int(pdf.a.iloc[0]), int(pdf.b.iloc[0])
        begin, out = pdf.begin.to_numpy().copy(), []
        for x, y, c in splitting_tree(pdf.n.to_numpy(), a, b, FAN, np.random.default_rng([seed, a, b])):
            some = c > 0
            out.append(pd.DataFrame({"a": x, "b": y, "source": pdf.source.to_numpy()[some], "begin": begin[some], "n": c[some]}))
            begin += c
        return pd.concat(out)

    # A step cuts each range of shards into FAN; a range has no more rows than blocks or sources.
    for _ in range(max(1, math.ceil(math.log(max(shards, 2), FAN) - 1e-9))):
        tree = cut(tree.groupBy("a", "b").applyInPandas(split, "a bigint, b bigint, source string, `begin` bigint, n bigint"))
    return tree.select("source", F.col("a").cast("int").alias("shard"), F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("place"))


@F.pandas_udf(LongType())
def _permuted(k: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permuted(k.to_numpy(), n.to_numpy(), seed.to_numpy()))


def _bucket(buckets: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).cast("bigint")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, path: str | None = None) -> DataFrame:
    """The mixture: shard, pos (from 0 in its shard), doc_id, source, copy (from 0) and n_tokens of each row.

    A source's tokens differ from its quota by at most half of its longest document. Documents
    without tokens (null or empty text), of null source or of a source without target don't come
    in; a target source without tokens gives nothing and the others keep their ratio. A null
    max_repeats is 1. Repeated rows of `documents` are documents of their own. Without targets or
    documents the result is empty.
    """
    drawn, quotas = _drawn(documents, targets, total_tokens, seed, path)
    shards = max(1, -(-(quotas.agg(F.sum("quota")).first()[0] or 0) // SHARD_TOKENS))
    key = F.xxhash64("source", F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.least(F.floor(F.col("at") / BLOCK_TOKENS).cast("bigint"), F.col("blocks") - 1)
    placed = drawn.withColumn("place", _permuted(block, F.col("blocks"), key)).join(_dealt(quotas, shards, seed), ["source", "place"])
    w = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed + 1)), "doc_id", "copy")
    return placed.select("shard", (F.row_number().over(w) - 1).cast("long").alias("pos"), "doc_id", "source", "copy", "n_tokens")


def _drawn(documents: DataFrame, targets: DataFrame, total: int | None, seed: int, path: str | None) -> tuple[DataFrame, DataFrame]:
    """The copies taken, each with its place `at` in its source and the blocks of the source, and the quotas."""
    known = documents.select("doc_id", "source", "text").where(F.col("source").isNotNull() & (F.length("text") > 0))
    counted = cut(bpe.count_tokens(known, path=path).where("n_tokens > 0"))
    quotas = cut(_quotas(counted, targets, total))
    buckets = max(1, math.ceil(counted.count() / BUCKET_ROWS))
    bucketed = counted.withColumn("bucket", _bucket(buckets, seed))
    # Offsets of the buckets of each source: sums by bucket first, then one small row a bucket in order.
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).join(quotas, "source")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"), "quota", "whole", "blocks")
    w = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id")
    before = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bucketed.withColumn("before", before).join(offsets, ["source", "bucket"]).withColumn("first", F.col("offset") + F.col("before"))
    last = F.floor((F.col("quota") - F.col("first") - F.col("n_tokens") / 2) / F.col("whole")).cast("int")
    copies = placed.where("first + n_tokens / 2 <= quota").withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    return copies.select("doc_id", "source", "copy", "n_tokens", "blocks", (F.col("first") + F.col("copy") * F.col("whole")).alias("at")), quotas


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Per target source: its target, and the documents, tokens, share and most copies it really got (0 where it gave nothing)."""
    drawn, _ = _drawn(documents, targets, total_tokens, seed, path)
    got = cut(drawn.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (F.max("copy") + 1).alias("most_copies")))
    all_tokens = F.lit(got.agg(F.sum("n_tokens")).first()[0] or 0)
    both = _targets(targets).join(got, "source", "left").fillna(0, ["n_docs", "n_tokens", "most_copies"])
    return both.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", F.when(all_tokens > 0, F.col("n_tokens") / all_tokens).otherwise(0.0).alias("actual_share"), "most_copies")
