import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import mixing as M


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=8), st.integers(1, 20), st.integers(0, 9))
def test_tree_is_exact(counts, shards, seed):
    out = M.splitting_tree(np.array(counts), 5, 5 + shards, 256, np.random.default_rng(seed))
    assert [(a, b) for a, b, _ in out] == [(5 + i, 6 + i) for i in range(shards)]
    got = np.array([c for *_, c in out])
    assert got.sum(0).tolist() == counts and (got >= 0).all()
    assert np.ptp(got.sum(1)) <= np.ceil(np.log2(shards)) + 1
    few = M.splitting_tree(np.array(counts), 0, shards, 4, np.random.default_rng(seed))
    assert len(few) == min(4, shards) or shards == 3
    assert few[0][0] == 0 and few[-1][1] == shards and sum(c.sum() for *_, c in few) == sum(counts)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 99))
def test_permutation(n, seed):
    assert sorted(M.permuted(np.arange(n), n, seed)) == list(range(n))
    both = M.permuted(np.arange(n).repeat(2), np.array([n, n + 7] * n), np.array([seed, 5] * n))
    assert both[::2].tolist() == M.permuted(np.arange(n), n, seed).tolist() and both[1::2].tolist() == M.permuted(np.arange(n), n + 7, 5).tolist()


def test_quotas(spark):
    def quotas(rows, total=None):
        counted = spark.createDataFrame([(s, t) for s, t, *_ in rows if t], "source string, n_tokens bigint")
        targets = spark.createDataFrame([(s, w, r) for s, _, w, r in rows], "source string, target_share double, max_repeats int")
        return {r.source: r.quota for r in M._quotas(counted, targets, total).collect()}

    assert quotas([("a", 100, 0.5, 2), ("b", 1000, 0.5, 1), ("c", 0, 0.1, 3), ("d", 50, 0.0, 1)]) == {"a": 200, "b": 200}
    assert quotas([("a", 0, 1.0, 1)]) == {}
    assert quotas([("a", 10, 0.5, 1), ("b", 10, 0.5, 9)], 60) == {"a": 10, "b": 30}


def test_many_sources_and_shards(spark, monkeypatch):
    """50,000 sources dealt out over a tree of several steps: every block once, shards of even size."""
    monkeypatch.setattr(M, "FAN", 8)
    q = spark.range(50_000).select(F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 4 + 1).alias("blocks"))
    got = M._dealt(q, 300, 1).toPandas()
    assert len(got) == 125_000 and not got.duplicated(["source", "place"]).any()
    size = got.groupby("shard").size()
    assert len(size) == 300 and np.ptp(size) <= 10
    want = q.toPandas().set_index("source").blocks.sort_index()
    assert (got.groupby("source").place.max() + 1 == want).all() and (got.groupby("source").size() == want).all()


def test_mixture(spark):
    docs = [(i, "abc"[i % 3] if i % 10 else None, "word " * (1 + i % 17) if i % 7 else None) for i in range(3000)] + [(0, "a", "hot " * 50)] * 40
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.3, 1), ("c", 0.1, 2), ("none", 0.2, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = M.mixture(df, targets).toPandas()
    rep = {r.source: r for r in M.shares(df, targets).collect()}
    assert set(rep) == {"a", "b", "c", "none"} and rep["none"].n_docs == 0
    for s, want in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert abs(rep[s].actual_share - want) < 0.01 and rep[s].n_tokens == mix[mix.source == s].n_tokens.sum()
        assert rep[s].most_copies <= rep[s].max_repeats
    once = mix[mix.doc_id > 0]
    assert not once.duplicated(["doc_id", "copy"]).any()
    assert all(sorted(g.pos) == list(range(len(g))) for _, g in mix.groupby("shard"))
    assert M.mixture(df.limit(0), targets).count() == 0 and M.mixture(df, targets.limit(0)).count() == 0
