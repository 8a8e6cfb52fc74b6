import itertools
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import spans as S
from leafmill.llm.codepoints import to_codepoints
from leafmill.llm.fmindex import FMIndex, WaveletMatrix


def brute_pairs(texts, n):
    have = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in texts.items() if t}
    return {(a, b) for a, b in itertools.combinations(sorted(have), 2) if have[a] & have[b]}


def brute_chars(texts, n):
    have = {i: [t[k : k + n] for k in range(len(t) - n + 1)] for i, t in texts.items() if t}
    out = {}
    for i, w in have.items():
        others = set().union(*(set(x) for j, x in have.items() if j != i))
        cover = np.zeros(len(texts[i]), bool)
        for k, x in enumerate(w):
            if x in others:
                cover[k : k + n] = True
        out[i] = int(cover.sum())
    return out


def code(t):
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab中"), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.text(st.sampled_from("ab中d"), max_size=30), max_size=4), st.integers(2, 9))
def test_matching_statistics_of_foreign_patterns(texts, patterns, depth):
    """At each place the longest match that occurs in any indexed text, and all its places, for texts that aren't in the index."""
    index = FMIndex([code(t) for t in texts], depth)
    before = {}
    for who, where, length, low, high, moved in index.matching_statistics([code(p) for p in patterns]):
        for p, i, m, lo, hi, same in zip(who, where, length, low, high, moved, strict=True):
            t = patterns[p]
            assert m == max(k for k in range(min(depth, len(t) - i) + 1) if any(t[i : i + k] in u for u in texts))
            if m:
                got = sorted(index.locate(np.arange(lo, hi)).tolist())
                assert got == [int(index.at[f]) + k for f, u in enumerate(texts) for k in range(len(u)) if u.startswith(t[i : i + m], k)]
                assert not same or got == [k - 1 for k in before[p]]
                before[p] = got


def test_match_keeps_its_longest_rest():
    index = FMIndex([code("abcab")], 5)
    got = {int(i): int(m) for _, where, length, *_ in index.matching_statistics([code("cbab")]) for i, m in zip(where, length, strict=True)}
    assert got == {3: 1, 2: 2, 1: 1, 0: 1}


def test_links_hang_on_the_index(monkeypatch):
    """Without ranks the wavelet matrix finds nothing, so no link comes about beside it."""
    texts = ["x" * 10 + "abcdefghij" * 3, "abcdefghij" * 3 + "y" * 10, "z" * 40]
    args = np.array([1, 1, 1]), np.array([1, 2, 3]), np.array([1, 2, 3]), texts, 30
    assert S.shard_links(*args)[0].tolist() == [[0, 1]]
    monkeypatch.setattr(WaveletMatrix, "rank", lambda self, code, i: np.zeros(len(i), np.int64))
    assert S.shard_links(*args)[0].tolist() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=0, max_size=60), max_size=5), st.integers(0, 3))
def test_winnowing_meets(texts, seed):
    random.seed(seed)
    span, gram = 12, 6
    common = "".join(random.choice("ab") for _ in range(span))
    texts = [t[: len(t) // 2] + common + t[len(t) // 2 :] for t in texts]
    row, fp, pos, _ = S.fingerprints(*to_codepoints(pa.array(texts, pa.string())), span, gram)
    by = [{(int(f)) for r, f in zip(row, fp, strict=True) if r == i} for i in range(len(texts))]
    assert all(a & b for a, b in itertools.combinations(by, 2))
    for r, p in zip(row, pos, strict=True):
        assert 0 <= p <= len(texts[r]) - gram


def corpus():
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghij éü中") for _ in range(7))
    text = lambda n: "".join(word() for _ in range(n))
    a, b = text(60), text(36)
    docs = {i: text(random.randrange(20, 120)) for i in range(1, 40)}
    for i in (3, 9, 17):
        docs[i] = docs[i][:100] + a + docs[i][100:]
    for i, n in ((4, 239), (5, 240), (6, 241), (7, 252)):
        docs[i] = docs[i][:50] + b[:n] + docs[i][50:]
    docs[20] = docs[21] = "x" * 3000
    docs[22] = text(10) + "x" * 250 + text(10)
    docs[23] = docs[24] = docs[3]
    docs[25], docs[26], docs[27] = None, "", "short"
    docs[28] = docs[29] = "ab" * 700
    return docs


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    rows = [*docs.items(), (3, docs[3]), (None, docs[3])]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    want = brute_pairs(docs, 240)
    assert {tuple(r) for r in S.found(df).collect()} == want
    chars = brute_chars(docs, 240)
    got = {r.doc_id: r.shared_chars for r in S.shared(df.where("doc_id is not null").distinct()).collect()}
    assert set(got) == set(docs) and {k: v for k, v in got.items() if v} == {k: v for k, v in chars.items() if v}
    # The same with every group split into blocks.
    monkeypatch.setattr(S, "BLOCK", 6)
    assert {tuple(r) for r in S.found(df).collect()} == want
    assert S.found(df.limit(0)).count() == 0 and S.shared(df.limit(0)).count() == 0


def test_fingerprints_differ():
    random.seed(8)
    texts = ["".join(random.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    row, fp, pos, _ = S.fingerprints(*to_codepoints(pa.array(texts)))
    assert len(np.unique(fp)) == len(fp) > 20 * 20
    assert all(np.diff(pos[row == i]).max() <= 121 for i in range(20))
