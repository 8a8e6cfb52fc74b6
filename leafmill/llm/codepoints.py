"""Arrow string arrays as numpy code-point arrays and back, without per-row string calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; a single longer text is handled alone.
SLICE_BYTES = 4 << 20


def text_bytes(arr: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all rows on end and the n + 1 byte offsets; null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return b"", np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, arr.offset * 8)
    raw = b"" if data is None else data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    return raw, at - at[0]


def to_codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the rows on end (uint32) and the n + 1 offsets into them."""
    raw, at = text_bytes(arr)
    cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, at
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
    return cp, lead[at]


def from_codepoints(cp: np.ndarray, at: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string array with the rows cp[at[i]:at[i + 1]]; rows where `valid` is false are null."""
    data = cp.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) != len(cp):
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        total = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=total[1:])
        at = total[at]
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    out = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [mask, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)])
    return out.cast(pa.string())


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose texts have at most `limit` bytes together."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    if total[-1] <= limit:
        yield batch
        return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def doubled_hash(codes: np.ndarray, width_log2: int = 6, seed: int = 7) -> np.ndarray:
    """Rolling hash of the 2**width_log2 code points that end at each position (fewer at the start)."""
    table = np.random.default_rng(seed).integers(0, 2**63, 1 << 16, dtype=np.uint64)
    h = table[(codes ^ (codes >> 16) * 40503) & 0xFFFF].copy()
    m = 1
    for _ in range(width_log2):
        if m < len(h):
            h[m:] += h[:-m].copy() << np.uint64(m)
        m *= 2
    return h
