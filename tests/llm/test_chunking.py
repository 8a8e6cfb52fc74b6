import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import chunking as C


def points(t):
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x" * 90, "Satz. ", "\n\n", "中文。", "\t", "é", "🔍" * 50]), max_size=400))
def test_pieces_cover_the_text_and_overlap(parts):
    t = "".join(parts)
    pieces, _ = C.cuts(points(t), 600, 20, 300, 63)
    assert all(b - a <= 600 for a, b, _ in pieces)
    assert all(y[0] == x[1] - 20 for x, y in zip(pieces, pieces[1:], strict=False))
    assert "".join(t[a + 20 * (i > 0) : b] for i, (a, b, _) in enumerate(pieces)) == t
    for _, b, edge in pieces[:-1]:
        assert (t[b - 1] in C.BREAKS) == (edge != "forced")


def test_forced_only_without_break():
    assert C.cuts(points("x" * 7000))[1] == 7000
    assert [e for _, _, e in C.cuts(points("x" * 7000))[0]] == ["forced", "end"]


def test_an_edit_moves_neighbouring_cuts_only():
    rng = np.random.default_rng(3)
    t = "".join(f"word{rng.integers(1000)}" + (". " if rng.random() < 0.1 else " ") for _ in range(12000))
    u = t[:20000] + "inserted " + t[20000:]
    a = {e for _, e, _ in C.cuts(points(t))[0]}
    b = {e if e < 20000 else e - 9 for _, e, _ in C.cuts(points(u))[0]}
    assert len(a ^ b) <= 6


def test_frame(spark):
    rows = [(1, None, "p"), (2, "", "p"), (3, "short", "p"), (4, "y" * 6001, "p"), (4, "y" * 6001, "p"), (5, "wort " * 3000, None)]
    df = spark.createDataFrame(rows, "row_id long, text string, cut string")
    out = C.split_oversized(df).collect()
    assert {r.row_id for r in out} == {4, 5}
    assert sum(r.row_id == 4 and r.piece == 1 for r in out) == 2
    assert {(r.row_id, r.cut) for r in out} == {(4, "forced"), (5, "natural")}
    assert C.split_oversized(df.limit(0)).count() == 0


def test_real_pages():
    """On real long pages: pieces within bounds that overlap and give back the text; an edit in the middle moves two cuts at most, mostly none."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet", columns=["text"]).text.dropna()
    long = [t for t in pages if len(t) > C.MAX_CHARS]
    assert len(long) > 20
    moved = []
    for t in long:
        pieces, _ = C.cuts(points(t))
        assert all(b - a <= C.MAX_CHARS for a, b, _ in pieces)
        assert "".join(t[a + C.OVERLAP * (i > 0) : b] for i, (a, b, _) in enumerate(pieces)) == t
        k = len(t) // 2
        after = {e if e <= k else e - 9 for _, e, _ in C.cuts(points(t[:k] + "inserted " + t[k:]))[0]}
        moved.append(len({e for _, e, _ in pieces} - after))
    assert max(moved) <= 2 and np.mean(np.array(moved) == 0) > 0.7
