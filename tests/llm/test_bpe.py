import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe

PIECES = ["'s", "'t", "'re", "'ll", "''", " '", "a", "B", " ", "  ", "\n", "\t", "1", "²", "é", "中", "文。", "🔍", " ", "́", ".", "-", "<|endoftext|>", " the", "'d", "'m", "ve", "\x00", "\x85", "​", "ing", "=" * 9, "Quilros"]


@pytest.fixture(scope="module")
def exact():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def ids_of(texts):
    ids, at = bpe.encoder(bpe.vocabulary_path()).batch(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join) | st.text(max_size=20), max_size=6))
def test_equals_the_tokenizer(exact, texts):
    assert ids_of(texts) == [exact(t) for t in texts]


def test_long_words(exact):
    random.seed(5)
    texts = ["".join(random.choice("etaoins") for _ in range(3000)), "中" * 500, " " * 2000 + "x", "ab" * 1500]
    assert ids_of(texts) == [exact(t) for t in texts]


def test_state_limit(exact, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    for t in ["some words here", "quite other words", "", "some words"]:
        assert ids_of([t]) == [exact(t)]


def test_utf8_stream():
    for raw in ["aé中🔍".encode(), b"a\xffb", b"\xe4\xb8", b"\xed\xa0\x80", b"\xc0\xafx"]:
        s = bpe.Utf8Stream()
        got = "".join(s.feed(raw[i : i + 1]) for i in range(len(raw))) + s.close()
        assert got.replace("�", "") == raw.decode("utf-8", "ignore") and ("�" in got) == ("�" in raw.decode("utf-8", "replace"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"\xff", b"\x80", b"\xc3", b"\xa9", b"\xe4\xb8\xad", b"\xe4", b"\xed\xa0\x80", b"\xf0\x9f\x94\x8d", b"\xf0", b"\xc0", b"\xf4\x90\x80\x80", b"\xe0\x80\x80"]), max_size=8).map(b"".join), max_size=5))
def test_all_states_at_once(rows):
    """The decoder on whole arrays gives what the incremental one gives byte by byte."""
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    cp, edge = bpe.utf8_decoded(np.frombuffer(b"".join(rows), np.uint8), at)
    for k, raw in enumerate(rows):
        s = bpe.Utf8Stream()
        assert "".join(map(chr, cp[edge[k] : edge[k + 1]])) == "".join(s.feed(raw[i : i + 1]) for i in range(len(raw))) + s.close()


def test_broken_bytes_are_replaced():
    raw, at = bpe.mended_bytes(b"ab\xffc", np.array([0, 2, 4]))
    assert raw.decode() == "ab�c" and at.tolist() == [0, 2, 6]


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "Hello, 中文 🔍", 7), (3, "Hello, 中文 🔍", 7)], "doc_id long, text string, ids int")
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "ids"] and dict(got.dtypes)["ids"] == "array<int>"
    rows = got.collect()
    assert [r.ids for r in rows if r.doc_id < 3] == [[], []]
    back = [r.text for r in bpe.decode(got).collect() if r.doc_id == 3]
    assert back == ["Hello, 中文 🔍"] * 2
    assert [r.n_tokens for r in bpe.count_tokens(df).collect()] == [len(r.ids) for r in rows]
    assert bpe.encode(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6, -4]), (4, rows[-1].ids)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd).collect()} == {1: None, 2: "", 3: "��", 4: "Hello, 中文 🔍"}
