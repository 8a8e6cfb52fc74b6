"""Problem 6: encoding by a byte-level BPE, compiled to a lazily determinised transducer.

The merges of a byte-level BPE are a rule on neighbours: a split of a word into tokens is the
tokenizer's own exactly if each two neighbouring tokens, encoded alone, come back as they are. So
the last token of every prefix follows from the last tokens of shorter ones, and a transducer can
read a word byte by byte. Its state is the last token sent and the bytes read since. Once all ways
a word may go on share a cut, the tokens up to it are sent and forgotten; the lookahead is bounded
by the longest token. States and transitions come about when first needed (lazy determinisation)
and are kept by each Python worker. All words of a batch walk the transducer at once, one byte a step.

Words are found by array steps too: runs of letters, digits, other signs and white space, with the
rules of the tokenizer's pattern for single spaces and contractions.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from leafmill.llm.codepoints import from_codepoints, slices, text_bytes

TOKENIZER = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary file lies: LEAFMILL_TOKENIZERS, else the installed package of public files, else /opt/tokenizers."""
    if folder := os.environ.get("LEAFMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers  # noqa: PLC0415

        return str(public_tokenizers.path(name))
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: States kept by a worker; with more it starts afresh before the next batch.
MAX_STATES = 400_000
HASH, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Transducer:
    """Deterministic transducer of one vocabulary; state 0 is the start of a word."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.prefixes: set[bytes] = set()
        for t in ranks:
            self.prefixes.update(t[:i] for i in range(1, len(t)))
        self.token = {i: t for t, i in ranks.items()}
        self._apart: dict[tuple[int, int], bool] = {}
        self.state: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.key: list[tuple[int, bytes]] = [(-1, b"")]
        #: of each state, the places where its bytes may be cut: (start, id) of the token that ends there
        self.cuts: list[dict[int, tuple[int, int]]] = [{0: (0, -1)}]
        # Transitions: an open hash table of state << 8 | byte, at most an eighth full.
        self.bits = 16
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_to = np.zeros(1 << self.bits, np.int32)
        #: emission of each transition (index into the pool of token lists) and of each state at a word's end
        self.slot_sent = np.zeros(1 << self.bits, np.int32)
        self.transitions = 0
        self.final = np.full(1 << 12, -1, np.int32)
        self.lists: dict[tuple[int, ...], int] = {(): 0}
        self.start: list[int] = [0]
        self.size: list[int] = [0]
        self.pool: list[int] = []

    def merge(self, word: bytes) -> list[int]:
        """Merging by rank, the definition of the encoding."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, a: int, b: int) -> bool:
        """Whether token a may stand before token b."""
        if a < 0:
            return True
        if (a, b) not in self._apart:
            self._apart[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return self._apart[a, b]

    def _path(self, last: dict[int, tuple[int, int]], end: int) -> list[tuple[int, int]]:
        """(end, id) of the tokens of the prefix up to `end`, in order."""
        out = []
        while end:
            j, t = last[end]
            out.append((end, t))
            end = j
        return out[::-1]

    def _list(self, ids: Iterable[int]) -> int:
        ids = tuple(ids)
        if ids not in self.lists:
            self.lists[ids] = len(self.start)
            self.start.append(len(self.pool))
            self.size.append(len(ids))
            self.pool += ids
        return self.lists[ids]

    def step(self, q: int, byte: int) -> None:
        """Adds the transition of state q on a byte."""
        before, pending = self.key[q]
        text = pending + bytes([byte])
        n = len(text)
        # Only cuts after which the text may still be within one token matter from here on.
        open_ = {j: x for j, x in self.cuts[q].items() if text[j:] in self.prefixes}
        for j in sorted(self.cuts[q]):
            t = self.ranks.get(text[j:])
            if t is not None and self.apart(self.cuts[q][j][1], t):
                last = self.cuts[q] | {n: (j, t)}
                open_[n] = (j, t)
                break
        else:
            last = self.cuts[q]
        paths = [self._path(last, j) for j in open_]
        same = 0
        if all(paths):
            while all(len(p) > same for p in paths) and len({p[same] for p in paths}) == 1:
                same += 1
        sent = paths[0][:same]
        cut = sent[-1][0] if sent else 0
        key = (sent[-1][1] if sent else before, text[cut:])
        if key not in self.state:
            on_way = {e for p in paths for e, _ in p} | {0}
            self.state[key] = len(self.key)
            self.key.append(key)
            self.cuts.append({e - cut: (last[e][0] - cut, last[e][1]) if e > cut else (0, key[0]) for e in sorted(on_way) if e >= cut})
            if len(self.key) > len(self.final):
                self.final = np.concatenate([self.final, np.full(len(self.final), -1, np.int32)])
        self._add(q << 8 | byte, self.state[key], self._list(t for _, t in sent))

    def _add(self, key: int, to: int, sent: int) -> None:
        if self.transitions * 8 >= len(self.slot_key):
            old = np.flatnonzero(self.slot_key >= 0)
            keys, tos, sents = self.slot_key[old].tolist(), self.slot_to[old].tolist(), self.slot_sent[old].tolist()
            self.bits += 2
            self.slot_key = np.full(1 << self.bits, -1, np.int64)
            self.slot_to = np.zeros(1 << self.bits, np.int32)
            self.slot_sent = np.zeros(1 << self.bits, np.int32)
            self.transitions = 0
            for x in zip(keys, tos, sents, strict=True):
                self._add(*x)
        i = (key * HASH & MASK) >> (64 - self.bits)
        while self.slot_key[i] >= 0:
            i = (i + 1) & (len(self.slot_key) - 1)
        self.slot_key[i], self.slot_to[i], self.slot_sent[i] = key, to, sent
        self.transitions += 1

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where there is none."""
        i = ((key.view(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slot_key[i]
        off = np.flatnonzero(got != key)
        while len(off):
            gone = got[off] < 0
            i[off[gone]] = -1
            off = off[~gone]
            i[off] = (i[off] + 1) & (len(self.slot_key) - 1)
            got[off] = self.slot_key[i[off]]
            off = off[got[off] != key[off]]
        return i

    def finish(self, q: int) -> None:
        """Adds the emission at the end of a word in state q."""
        self.final[q] = self._list(t for _, t in self._path(self.cuts[q], len(self.key[q][1])))

    def run(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words data[begin:begin + length], all in order, and the number of each word's."""
        n = len(begin)
        counts = np.zeros(n, np.int32)
        # Long words first, so that those still going are always a leading part.
        order = np.argsort(-length, kind="stable").astype(np.int32)
        begin, length = begin[order], length[order]
        state = np.zeros(n, np.int32)
        events: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if n else 1), "right")
        size = np.asarray(self.size, np.int32)
        ended = np.zeros(n, np.int32)
        for i in range(int(length[0]) if n else 0):
            m = int(left[i])
            key = state[:m].astype(np.int64) << 8 | data[begin[:m] + i]
            slot = self._find(key)
            new = slot < 0
            if new.any():
                for k in np.unique(key[new]).tolist():
                    self.step(k >> 8, k & 255)
                slot = self._find(key)
                size = np.asarray(self.size, np.int32)
            sent = self.slot_sent[slot]
            who = np.flatnonzero(sent)
            if len(who):
                lists = sent[who]
                counts[who] += size[lists]
                events.append((who, lists))
            state[:m] = self.slot_to[slot]
        for q in np.unique(state[self.final[state] < 0]).tolist():
            self.finish(q)
        ended = self.final[state]
        size, start, pool = np.asarray(self.size, np.int32), np.asarray(self.start, np.int64), np.asarray(self.pool, np.int32)
        counts += size[ended]
        events.append((np.arange(n), ended))
        per_word = np.empty(n, np.int32)
        per_word[order] = counts
        off = np.zeros(n + 1, np.int64)
        np.cumsum(per_word, out=off[1:])
        at = off[:-1][order]
        out = np.empty(int(off[-1]), np.int32)
        for who, lists in events:
            k = size[lists]
            where, first = at[who], start[lists]
            at[who] += k
            j = 0
            while len(where):
                live = k > j
                if not live.all():
                    where, first, k = where[live], first[live], k[live]
                    if not len(where):
                        break
                out[where + j] = pool[first + j]
                j += 1
        return out, per_word


LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
_class: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point as the tokenizer's pattern has it."""
    global _class
    if _class is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                out[a : b + 1] = kind
        out[0xD800:0xE000] = OTHER
        _class = out
    return _class


def words(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Start of each word (index of its first code point) of the texts cp[at[i]:at[i + 1]]."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    k = classes()[cp]
    head = np.zeros(n + 1, bool)
    head[at] = True
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (k[1:] != k[:-1]) | head[1:n]
    # The last sign of a run of white space before more text stands alone, or joins that text if it is a plain space.
    last = np.zeros(n, bool)
    last[:-1] = (k[:-1] == SPACE) & (k[1:] != SPACE) & ~head[1:n]
    new |= last
    after = np.flatnonzero(last) + 1
    new[after] = cp[after - 1] != 0x20
    # Contractions: an apostrophe alone between signs, not after a plain space, and the letters that it takes.
    quote = np.flatnonzero((cp[:-1] == 0x27) & new[:-1] & (k[1:] == LETTER) & ~head[1:n])
    if len(quote):
        end = at[np.searchsorted(at, quote, "right")]
        c1 = cp[quote + 1]
        c2 = np.where(quote + 2 < end, cp[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for hit, m in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            new[q + 1] = False
            if m == 3:
                new[q + 2] = False
            stop = q + m
            stop = stop[stop < n]
            new[stop] = True
    return np.flatnonzero(new)


class Encoder:
    """Encodes batches of texts; an empty or null text gives no ids."""

    def __init__(self, path: str) -> None:
        self.fst = Transducer(read_ranks(path))

    def batch(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end and the n + 1 offsets of the rows."""
        raw, at = text_bytes(arr)
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        if len(self.fst.key) > MAX_STATES:
            self.fst = Transducer(self.fst.ranks)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            raw, at = mended_bytes(raw, at)
            text = raw.decode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        plain = len(cp) == len(data)
        row = at if plain else np.searchsorted(lead, at)
        start = words(cp, row)
        begin = start if plain else lead[start]
        ids, per_word = self.fst.run(data, begin, np.diff(np.append(begin, len(data))))
        total = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(per_word, out=total[1:])
        return ids, total[np.searchsorted(begin, at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of the vocabulary at `path`; its states stay from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """`df` without `text`, with the token ids of `text` in column `out` (array<int>).

    Special tokens are neither added nor recognised: their strings are ordinary text. Null and
    empty texts give an empty list. Repeated rows each come out; a column named `out` is replaced.
    `path` names the vocabulary file, which every executor must have. Nothing is shuffled.
    """
    return _mapped(df, text, out, "array<int>", path or vocabulary_path(), lambda ids, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """As `encode`, with the number of tokens (long, 0 for null and empty texts) in place of the ids."""
    return _mapped(df, text, out, "bigint", path or vocabulary_path(), lambda ids, at: pa.array(np.diff(at)))


def _mapped(df: DataFrame, text: str, out: str, kind: str, path: str, made) -> DataFrame:
    rest = [c for c in df.columns if c not in (text, out)]
    df = df.select(*rest, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + [f"`{out}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text):
                ids, at = enc.batch(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made(ids, at)], [*rest, out])

    return df.mapInArrow(run, schema)


class Utf8Stream:
    """Incremental UTF-8 decoder: bytes in, the characters complete so far out; broken bytes give U+FFFD."""

    def __init__(self) -> None:
        self.need = self.value = self.low = 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if b & 0xC0 == 0x80:
                    self.value, self.need = self.value << 6 | b & 0x3F, self.need - 1
                    if not self.need:
                        bad = self.value < self.low or 0xD800 <= self.value < 0xE000 or self.value > 0x10FFFF
                        out.append("�" if bad else chr(self.value))
                    continue
                out.append("�")
                self.need = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xF5:
                self.need = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.value = b & (0x3F >> self.need)
                self.low = (0, 0x80, 0x800, 0x10000)[self.need]
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self.need = "�" * bool(self.need), 0
        return rest


def mended_bytes(raw: bytes, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes and offsets of rows of text with broken bytes made U+FFFD."""
    rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(at[:-1], at[1:], strict=True)]
    return b"".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def utf8_decoded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of rows of bytes, as `Utf8Stream` gives them, all states of the machine at once."""
    n = len(data)
    follows = (data & 0xC0) == 0x80
    need = np.select([data < 0x80, (data >= 0xC2) & (data < 0xE0), (data >= 0xE0) & (data < 0xF0), (data >= 0xF0) & (data < 0xF5)], [0, 1, 2, 3], -1)
    heads = np.flatnonzero(~follows)
    # What may follow a head ends before the next head and before the next row.
    stop = np.minimum(np.append(heads[1:], n), at[np.searchsorted(at, heads, "right")]) if len(heads) else heads
    want = need[heads]
    have = np.minimum(np.maximum(want, 0), stop - heads - 1)
    value = np.where(want == 0, data[heads], data[heads] & (0x3F >> np.maximum(want, 0))).astype(np.int64)
    taken = np.zeros(n, bool)
    for k in (1, 2, 3):
        some = have >= k
        place = heads[some] + k
        value[some] = value[some] << 6 | data[place] & 0x3F
        taken[place] = True
    least = np.array([0, 0x80, 0x800, 0x10000])[np.maximum(want, 0)]
    bad = (want < 0) | (have < want) | (value < least) | ((value >= 0xD800) & (value < 0xE000)) | (value > 0x10FFFF)
    out = np.full(n, 0xFFFD, np.int64)
    out[heads] = np.where(bad, 0xFFFD, value)
    kept = ~taken
    count = np.concatenate([[0], np.cumsum(kept)])
    return out[kept].astype(np.uint32), count[at]


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """`df` without `ids`, with the decoded text in column `out`: the streaming inverse of `encode`.

    A null list gives null, an empty list an empty text, unknown ids give U+FFFD.
    """
    path = path or vocabulary_path()
    rest = [c for c in df.columns if c not in (ids, out)]
    df = df.select(*rest, ids)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(path).fst.token
        # Unknown ids stand for a byte that begins nothing.
        most = max(token, default=0) + 1
        words = [token.get(i, b"\xff") for i in range(most)] + [b"\xff"]
        pool = np.frombuffer(b"".join(words), np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            flat = col.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            per_row = np.asarray(pc.list_value_length(col).fill_null(0)).astype(np.int64)
            i = np.where((flat >= 0) & (flat < most), flat, most)
            size = edge[i + 1] - edge[i]
            total = np.concatenate([[0], np.cumsum(size)])
            data = pool[np.repeat(edge[i] - total[:-1], size) + np.arange(total[-1])]
            cp, at = utf8_decoded(data, total[np.concatenate([[0], np.cumsum(per_row)])])
            made = from_codepoints(cp, at, np.asarray(pc.is_valid(col)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*rest, out])

    return df.mapInArrow(run, schema)
