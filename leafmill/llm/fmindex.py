"""FM-index of a shard of text fragments: wavelet matrix over the BWT, sampled suffix array, matching statistics of many patterns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: One text position in this many is kept.
SAMPLE = 16


class WaveletMatrix:
    """Rank over a sequence of small codes: one bit vector per bit of a code, packed into 64-bit words with running counts."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(codes)
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        seq = codes
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros((self.n + 64) // 64 * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each code before position i, plus a start that depends on the code alone."""
        i = i.astype(np.int64)
        for k in range(self.bits):
            w = i >> 6
            ones = self.before[k][w] + np.bitwise_count(self.words[k][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(code >> (self.bits - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> np.ndarray:
        """The codes at positions i."""
        i, code = i.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(self.bits):
            w, at = i >> 6, (i & 63).astype(np.uint64)
            bit = (self.words[k][w] >> at & np.uint64(1)).astype(np.int64)
            ones = self.before[k][w] + np.bitwise_count(self.words[k][w] & ((np.uint64(1) << at) - np.uint64(1)))
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
            code = code << 1 | bit
        return code


class FMIndex:
    """Compressed index of `fragments` (arrays of code points) for matches of up to `depth` characters.

    After construction it holds the wavelet matrix of the Burrows-Wheeler transform, the longest
    common prefixes of neighbouring suffixes up to `depth`, and every SAMPLE-th text position of the
    suffix array; neither text nor suffix array are kept.
    """

    def __init__(self, fragments: list[np.ndarray], depth: int) -> None:
        self.depth = depth
        size = np.array([len(f) for f in fragments], np.int64)
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        n = self.n = int(self.at[-1])
        flat = np.concatenate(fragments) if fragments else np.zeros(0, np.uint32)
        self.alphabet, dense = np.unique(flat, return_inverse=True)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.at[1:] - 1] = False
        text[inside] = dense + 1
        sa = self._sort(text)
        self.wavelet = WaveletMatrix(text[sa - 1], max(1, int(len(self.alphabet)).bit_length()))
        codes = np.arange(len(self.alphabet) + 1)
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(codes)))[:-1]])
        #: what to add to a wavelet rank to get a row of the suffix array
        self.base = first - self.wavelet.rank(codes, np.zeros(len(codes), np.int64))
        # Rows whose text position is known: each SAMPLE-th, and the first of each fragment, before
        # which the transform has an end mark that stands for no place.
        known = sa % SAMPLE == 0
        start = np.zeros(n, bool)
        start[self.at[:-1]] = True
        known |= start[sa]
        self.known = np.concatenate([[0], np.cumsum(known)]).astype(np.int32)
        self.sample = sa[known].astype(np.int32)

    def _sort(self, text: np.ndarray) -> np.ndarray:
        """The suffixes in order, each ending at its fragment's end mark and equal ones by place, by prefix doubling; sets the common prefixes and the smaller ones beside each."""
        n = self.n
        to_end = np.repeat(self.at[1:] - 1, np.diff(self.at)) - np.arange(n)
        bits = int(len(self.alphabet) + 1).bit_length()
        h = max(1, 62 // bits)
        packed = np.zeros(n, np.int64)
        for i in range(h):
            packed <<= bits
            packed[: max(0, n - i)] |= np.where(to_end[: max(0, n - i)] > i, text[i:], 0)
        ranks, key = [], packed
        while True:
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) if n else 0
            ranks.append((h, rank.astype(np.int32)))
            if n == 0 or h > to_end.max():
                break
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - h)] = np.where(to_end[: max(0, n - h)] >= h, rank[h:] + 1, 0)
            key = rank * (n + 1) + nxt
            h *= 2
        # Common prefixes of neighbours: agreeing pieces from the longest to the shortest, then signs of packed keys.
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
        for size, rank in reversed(ranks):
            ok = (a < n) & (b < n)
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            step = np.where(ok, size, 0)
            a, b, common = a + step, b + step, common + step
        ok = np.flatnonzero((a < n) & (b < n))
        differ = packed[a[ok]] ^ packed[b[ok]]
        top = np.frexp(differ.astype(np.float64))[1].astype(np.int64)
        top -= (differ > 0) & (differ < np.left_shift(1, np.maximum(top - 1, 0)))  # rounded up to the next power of two
        common[ok] += ranks[0][0] - -(-top // bits)
        common = np.minimum(common, np.minimum(to_end[order[:-1]], self.depth))
        self.lcp = np.concatenate([[-1], common, [-1]]).astype(np.int32) if n else np.full(1, -1, np.int32)
        self.smaller_before, self.smaller_after = _smaller(self.lcp)
        same = self.lcp[1:-1] >= self.depth
        self.run_of = np.concatenate([[0], np.cumsum(~same)]).astype(np.int32) if n else np.zeros(0, np.int32)
        self.run_start = np.flatnonzero(np.concatenate([[True], ~same]))
        self.run_end = np.append(self.run_start[1:], n)
        return order

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes begin with code and then with what rows low..high begin with."""
        both = self.wavelet.rank(np.concatenate([code, code]), np.concatenate([low, high])) + self.base[np.concatenate([code, code])]
        return both[: len(low)], both[len(low) :]

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least wider interval of rows that share a shorter prefix, and that prefix's length."""
        left, right = self.lcp[low], self.lcp[high]
        to = np.maximum(left, right)
        return np.where(left == to, self.smaller_before[low], low), np.where(right == to, self.smaller_after[high], high), to.astype(np.int64)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: steps back to the next sampled row, all rows at once."""
        out, moved = np.empty(len(rows), np.int64), 0
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            hit = self.known[at + 1] > self.known[at]
            out[live[hit]] = self.sample[self.known[at[hit]]] + moved
            live, at = live[~hit], at[~hit]
            if len(live):
                at = self.wavelet.rank(code := self.wavelet.access(at), at) + self.base[code]
                moved += 1
        return out

    def matching_statistics(self, patterns: list[np.ndarray], least: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
        """For each step of reading all patterns from their ends: (pattern numbers, positions, matched length up to `depth`, low, high, moved).

        The matched length is that of the longest prefix of what was read that occurs in the index:
        where the next character doesn't occur before the present match, the match is cut at its
        end, from one interval of common prefixes to the next wider, until it does. `moved` says that
        the rows are those of the step before, each one character earlier. A pattern that can't
        reach `least` any more is left, its further positions are not reported.
        """
        size = np.array([len(p) for p in patterns], np.int64)
        live = np.argsort(-size, kind="stable")
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.concatenate(patterns) if patterns else np.zeros(0, np.uint32)
        slot = np.searchsorted(self.alphabet, flat)
        known = (slot < len(self.alphabet)) & (self.alphabet[np.minimum(slot, len(self.alphabet) - 1)] == flat) if len(self.alphabet) else np.zeros(len(flat), bool)
        codes = np.where(known, slot + 1, 0)
        low, high, length = np.zeros(len(size), np.int64), np.full(len(size), self.n), np.zeros(len(size), np.int64)
        where = size.copy()
        live = live[size[live] > 0]
        while len(live):
            where[live] -= 1
            code = codes[at[live] + where[live]]
            lo, hi, ln = low[live], high[live], length[live]
            width = hi - lo
            new_lo, new_hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
            new_ln = np.zeros(len(live), np.int64)
            todo = np.flatnonzero(code > 0)
            while len(todo):
                x, y = self.step(code[todo], lo[todo], hi[todo])
                ok = y > x
                done = todo[ok]
                new_lo[done], new_hi[done], new_ln[done] = x[ok], y[ok], ln[done] + 1
                todo = todo[~ok]
                todo = todo[ln[todo] > 0]
                lo[todo], hi[todo], ln[todo] = self.parent(lo[todo], hi[todo])
            moved = (new_ln == length[live] + 1) & (new_hi - new_lo == width)
            full = np.flatnonzero(new_ln > self.depth)
            run = self.run_of[new_lo[full]]
            moved[full] &= self.run_end[run] - self.run_start[run] == width[full]
            new_lo[full], new_hi[full], new_ln[full] = self.run_start[run], self.run_end[run], self.depth
            low[live], high[live], length[live] = new_lo, new_hi, new_ln
            yield live, where[live], new_ln, new_lo, new_hi, moved
            live = live[(where[live] > 0) & (np.minimum(new_ln, self.depth) + where[live] >= least)]


def _smaller(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest before and after it with a smaller value (the ends where there is none), by jumping over places known to be no smaller."""
    n = len(v)
    out = []
    for x in (v, v[::-1]):
        near = np.maximum(np.arange(n) - 1, 0)
        todo = np.arange(1, n)
        while len(todo):
            todo = todo[(x[near[todo]] >= x[todo]) & (near[todo] > 0)]
            near[todo] = near[near[todo]]
        out.append(near)
    return out[0].astype(np.int32), (n - 1 - out[1][::-1]).astype(np.int32)
