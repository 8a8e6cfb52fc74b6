"""Problem 1: cutting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over 64 code points marks landmarks, about one in 1,024 positions. A piece ends at
the natural boundary nearest to the first landmark past its minimum size, so the cuts hang on the
text around them: an edit moves the cuts beside it only, and the later ones fall where they fell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.codepoints import doubled_hash

MAX_CHARS = 6000
OVERLAP = 200
MIN_CHARS = 3000
LANDMARK_MASK = 1023

#: Characters after which a text may be cut.
BREAKS = " \t\n。！？"
STOPS = ".!?。！？…"

PIECES = "piece int, start int, end int, edge string, cut string"


def boundaries(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions before which a cut is natural, and the rank of each: 3 paragraph, 2 line or sentence, 1 word."""
    brk = np.isin(cp, [ord(c) for c in BREAKS])
    pos = np.flatnonzero(brk) + 1
    last = cp[pos - 1]
    before = cp[np.maximum(pos - 2, 0)]
    rank = np.ones(len(pos), np.int8)
    rank[(last == 10) | (last > 0x7F) | np.isin(before, [ord(c) for c in STOPS])] = 2
    rank[(last == 10) & (before == 10)] = 3
    return pos, rank


def longest_unbroken(pos: np.ndarray, n: int) -> int:
    """Most characters in a row of which none is a break character."""
    edge = np.concatenate([[0], pos, [n + 1]])
    return int(np.max(np.diff(edge))) - 1


def _nearest(pos: np.ndarray, to: int, lo: int, hi: int) -> int | None:
    i, j = np.searchsorted(pos, lo), np.searchsorted(pos, hi, "right")
    if i == j:
        return None
    k = i + int(np.searchsorted(pos[i:j], to))
    near = [int(pos[x]) for x in (k - 1, k) if i <= x < j]
    return min(near, key=lambda p: (abs(p - to), p))


def cuts(cp: np.ndarray, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, mask: int = LANDMARK_MASK) -> tuple[list[tuple[int, int, str]], int]:
    """[start, end) and edge kind of each piece of one text, and its longest unbroken run.

    Every piece but the first begins `overlap` characters before the end of the one before it. A
    text of at most `max_chars` is one piece; an empty text has none. Where no natural boundary
    lies in reach the edge is `forced`, set back so as not to part a letter from combining marks.
    """
    n = len(cp)
    if n == 0:
        return [], 0
    pos, rank = boundaries(cp)
    run = longest_unbroken(pos, n)
    if n <= max_chars:
        return [(0, n, "end")], run
    marks = np.flatnonzero((doubled_hash(cp) >> np.uint64(20)) & np.uint64(mask) == 0) + 1
    strong, best = pos[rank >= 2], pos[rank == 3]
    out, s = [], 0
    while n - s > max_chars:
        lo, hi = s + min_chars, s + max_chars
        i = int(np.searchsorted(marks, lo))
        to = int(marks[i]) if i < len(marks) and marks[i] <= hi else (lo + hi) // 2
        e, edge = None, "forced"
        for kind, where, low, high in (
            ("paragraph", best, max(lo, to - 256), min(hi, to + 256)),
            ("sentence", strong, lo, hi),
            ("word", pos, lo, hi),
            ("word", pos, s + overlap + 1, hi),
        ):
            if (e := _nearest(where, to if low >= lo else hi, low, high)) is not None:
                edge = kind
                break
        if e is None:
            e = hi
            while e > hi - 64 and 0x300 <= cp[e] < 0x370:
                e -= 1
        out.append((s, e, edge))
        s = e - overlap
    out.append((s, n, "end"))
    return out, run


def split_oversized(pages: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each row whose text has more than `max_chars` characters, as its pieces.

    Columns: those of `pages` (its text replaced by the piece's) and piece (from 1), start, end (in
    characters of the whole text), edge (what the piece ends at: paragraph, sentence, word, forced,
    or end of text) and cut of the row: `forced` if more than `max_chars` characters in a row hold
    no break character, else `natural`. Rows with shorter, empty or null texts do not come out;
    repeated rows come out each. A column of `pages` named like a new one is replaced. The filter
    runs before Python, and nothing is shuffled.
    """
    if not 0 <= overlap < min_chars <= max_chars:
        raise ValueError("0 <= overlap < min_chars <= max_chars must hold")
    new = ["piece", "start", "end", "edge", "cut"]
    keep = [c for c in pages.columns if c not in new]
    long = pages.select(*keep).where(F.length(text) > max_chars)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema] + [PIECES.replace("end int", "`end` int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(batch.num_rows):
                s = batch.column(at)[i].as_py()
                cp = np.frombuffer(s.encode("utf-32-le"), np.uint32)
                pieces, unbroken = cuts(cp, max_chars, overlap, min_chars)
                m = len(pieces)
                row = pa.Table.from_batches([batch.slice(i, 1)]).take(pa.array([0] * m))
                row = row.set_column(at, text, pa.array([s[a:b] for a, b, _ in pieces], batch.schema.field(at).type))
                cut = "forced" if unbroken > max_chars else "natural"
                for name, values, kind in (
                    ("piece", range(1, m + 1), pa.int32()),
                    ("start", [p[0] for p in pieces], pa.int32()),
                    ("end", [p[1] for p in pieces], pa.int32()),
                    ("edge", [p[2] for p in pieces], pa.string()),
                    ("cut", [cut] * m, pa.string()),
                ):
                    row = row.append_column(name, pa.array(list(values), kind))
                yield from row.combine_chunks().to_batches()

    return long.mapInArrow(run, schema)


def found(pages: DataFrame) -> DataFrame:
    """row_id and cut of each page that is split, read off the first piece of each."""
    pieces = split_oversized(pages.select("row_id", "text"))
    return pieces.where("piece = 1").select("row_id", "cut")
