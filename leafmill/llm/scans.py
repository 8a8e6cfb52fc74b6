"""Problem 5: noise in texts of scanned pages, and their repair.

A first pass counts the words of all pages and the words broken over lines. Forms meet the words
they may have been through an inverted join on character q-grams: each word is posted under all its
q-grams, each form under its rarest ones, of which one mistake can't touch all. The q-grams are those
of skeletons, in which signs that are commonly mistaken for each other fall together, so that such
mistakes don't count. Boosted trees rank each candidate against keeping the form, on counts, a
character model, the shapes of the signs and the kind of mistake, trained on words made wrong.
Boosted trees on pairs of lines judge each broken word by the counts of all words. A second pass
reads the lines: page numbers and first and last lines are noted, and lines that return on three
pages of a file are running lines. Words and broken words are matched to what was found by joins.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import boosting
from leafmill.llm.canonical import fold
from leafmill.llm.codepoints import slices, to_codepoints
from leafmill.plans import cut

#: Most frequent words that go along with the tasks and make up the character model.
COMMON_WORDS = 30_000
#: Pages taken at most to train the line-pair trees.
TRAIN_PAGES = 1500
RUNNING_PAGES = 3
RUNNING_LINES = 3
#: Grams that a form is posted under: one mistake of up to two signs touches four of them at most.
POSTED = 5
#: Signs of a skeleton from which on its 4-grams are taken; a mistake touches one more of them.
LONG_SKELETON = 9
#: Classes of hashed grams whose numbers of words are known to all tasks.
GRAM_CLASSES = 1 << 15
#: A form on this share of all pages, or on three, may be a mistake of a word nobody knows.
RARE_SHARE = 2e-5
#: What a candidate must come up to if no common confusion explains the form: one edit in at least so many letters, how much more frequent, and the score.
UNUSUAL_LETTERS, UNUSUAL_RATIO, UNUSUAL = 5, 100, 2.0
SALT = 16
SEED = 17

#: What scanners commonly make (right) of signs (left).
CONFUSIONS = [
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("in", "m"), ("w", "vv"), ("li", "h"), ("h", "b"), ("t", "f"), ("e", "c"),
    ("s", "5"), ("g", "9"), ("o", "0"), ("i", "1"), ("l", "1"), ("b", "8"), ("é", "6"), ("ä", "a'"), ("ö", "o'"), ("ü", "ii"), ("o", "c"), ("n", "ri"), ("ri", "n"), ("h", "li"), ("z", "2"), ("q", "9"),
]
#: Letters whose printed shapes are alike.
SHAPES = ["aceosuv", "nmurhbk", "iltfjr", "vwyxk", "bdpqgo", "ceozs", "hnb", "uvn"]
_SKELETON = str.maketrans({"0": "o", "5": "s", "9": "g", "1": "l", "i": "l", "c": "e", "f": "t", "h": "ll", "b": "ll", "8": "ll", "u": "ll", "d": "el", "m": "ln", "w": "vv", "|": "l", "2": "z", "é": "6", "ä": "a'", "ö": "o'", "ü": "ll"})
#: Words for `page` before or after a page number, and for `of`.
_PAGE = r"(?:page|pages|pag\.?|pág\.?|pagina|página|p\.?|seite|s\.?|blatt|folio|n[o°º]\.?|第)"
_OF = r"(?:/|\||of|von|de|sur|di|共|从)"
_PAGENUM = re.compile(rf"^[\s\-–—_=~.•·*\[\](){{}}<>|#]*(?:{_PAGE}\s*)?(\d+)(?:\s*页)?(?:\s*{_OF}\s*(\d+)(?:\s*页)?)?[\s\-–—_=~.•·*\[\](){{}}<>|]*$")
_NUMBERED = re.compile(rf"\b{_PAGE}?\s*([0-9]+)\b", re.I)
_DIGITS = str.maketrans({"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "S": "5", "s": "5", "g": "9", "q": "9", "B": "8", "Z": "2", "z": "2", "G": "6", "b": "6"})

#: Words and numbers of a line: the page's number has no more than the words for page and of, and two numbers.
_NUMBER_PARTS = re.compile(r"\w+")
_MANY_PARTS = re.compile(r"\W*+(?:\w++\W++){5}\w")
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"[{_L}0-9]++(?:['’\-][{_L}0-9]++)*+")
_BREAK = re.compile(r"([-‐¬])[ \t]*\n[ \t]*\n?[ \t]*")
_LEFT = re.compile(rf"[{_L}0-9]++(?:['’\-][{_L}0-9]++)*+$")
_LETTER = re.compile(rf"[{_L}]")
_ENDS = ".!?。！？…:;"
_BREAK_MARK = "¬"


def skeleton(word: str) -> str:
    return word.translate(_SKELETON).replace("rn", "ln")


def plain_texts(col: pa.Array) -> list[str]:
    """Canonical forms of the texts; a soft hyphen at a line's end becomes a sign that stays."""
    col = pc.replace_substring_regex(col.fill_null(""), "­([ \t   ]*\r?\n)", f"{_BREAK_MARK}\\1")
    cp, at = fold(*to_codepoints(col))
    whole = cp.astype("<u4", copy=False).tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def broken_at(text: str) -> list[tuple[int, int, str, str, str]]:
    """Start, end, first part, sign and second part of each word that may be broken over two lines; parts beyond 60 signs are no words."""
    out = []
    for m in _BREAK.finditer(text):
        i, j = m.start(), m.end()
        if not i or not text[i - 1].isalpha() or not text[j : j + 1].isalpha():
            continue
        left, right = _LEFT.search(text[max(0, i - 60) : i]), _WORD.match(text[j : j + 60])
        if left and right:
            out.append((i - len(left[0]), j + len(right[0]), left[0], m[1], right[0]))
    return out


def _broken_key(m: tuple[int, int, str, str, str], text: str) -> str:
    """What a broken word is judged by: its parts, its sign and whether a blank line lies between."""
    return f"{m[2]}\t{m[3]}\t{m[4]}\t{int(chr(10) * 2 in text[m[0] : m[1]])}"


def _like(old: str, new: str) -> str:
    """`new` in the capitals of `old`."""
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() or (old[:1].isdigit() and old[1:2].isupper()) else new


def _wordlike(w: str) -> bool:
    return 2 <= len(w) <= 40 and bool(_LETTER.search(w)) and not re.match(r"\d\d", w) and sum(c.isdigit() for c in w) * 2 < len(w) + 1


@lru_cache(1 << 16)
def _bare(w: str) -> str:
    """A word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _cased(w: str) -> bool:
    """Whether a form is in small letters, in capitals, or has one capital at its head: keys and units mix them otherwise."""
    return w.islower() or w.isupper() or w[1:].islower() or all(x[1:].islower() or len(x) < 2 for x in re.split("['’-]", w))


def words_of(text: str, broken: list[tuple[int, int, str, str, str]]) -> list[str]:
    """Words and numbers of a text, those broken over lines left out."""
    if broken:
        cuts = [0, *(x for b in broken for x in b[:2]), len(text)]
        text = " ".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    return _WORD.findall(text)


def lexicon(pages: DataFrame) -> DataFrame:
    """broken, word and n, the number of pages that have it: words, and the keys of words broken over lines. Each batch counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raw: Counter[str] = Counter()
            broken: Counter[str] = Counter()
            for batch in slices(whole, "text"):
                for t in plain_texts(batch.column(0)):
                    found = broken_at(t)
                    broken.update({_broken_key(m, t) for m in found})
                    raw.update(set(words_of(t, found)))
            count: Counter[str] = Counter()
            for w, n in raw.items():
                if _cased(w) and _wordlike(w.lower()):
                    count[w.lower()] += n
            kind = np.repeat([False, True], [len(count), len(broken)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array([*count, *broken], pa.string()), pa.array([*count.values(), *broken.values()], pa.int64())], ["broken", "word", "n"])

    return pages.where("text is not null").select("text").mapInArrow(run, "broken boolean, word string, n bigint").groupBy("broken", "word").agg(F.sum("n").alias("n"))


class Characters:
    """Trigram model of words: mean log-probability of their characters."""

    SIZE = 64

    def __init__(self, words: dict[str, int]) -> None:
        n = self.SIZE
        self.table = np.zeros((n, n, n))
        codes, who = self._codes(list(words))
        weight = np.log1p(np.fromiter(words.values(), float, len(words)))[who[2:]]
        ok = (who[2:] == who[:-2]) if len(who) > 2 else np.zeros(0, bool)
        if len(codes) > 2:
            np.add.at(self.table, (codes[:-2][ok], codes[1:-1][ok], codes[2:][ok]), weight[ok])
        two = self.table.sum(0) + 0.1
        back = two / two.sum(1, keepdims=True)
        self.table = np.log((self.table + 3 * back[None]) / (self.table.sum(2, keepdims=True) + 3))

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(f"\x02\x02{w}\x03" for w in words)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        code = np.where(cp < 4, cp, np.where((cp >= 97) & (cp < 123), cp - 93, np.where((cp >= 48) & (cp < 58), 32 + (cp - 48) // 10, 34 + cp % 30)))
        return code, np.repeat(np.arange(len(words)), [len(w) + 3 for w in words])

    def score(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        c, who = self._codes(words)
        ok = who[2:] == who[:-2]
        return np.bincount(who[2:][ok], self.table[c[:-2][ok], c[1:-1][ok], c[2:][ok]], len(words)) / (np.array([len(w) for w in words]) + 1)

    def least(self, words: list[str]) -> np.ndarray:
        """The log-probability of the least likely character of each word."""
        if not words:
            return np.zeros(0)
        c, who = self._codes(words)
        ok = who[2:] == who[:-2]
        out = np.zeros(len(words))
        np.minimum.at(out, who[2:][ok], self.table[c[:-2][ok], c[1:-1][ok], c[2:][ok]])
        return out


def mistakes(s: str, t: str) -> tuple[int, int, int] | None:
    """How s may have come of t: the number of confusions, of digits among them, and the first place; None if it can't."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {(0, 0): (0, 0, 99)}
    for i in range(len(t) + 1):
        for j in range(len(s) + 1):
            if (i, j) not in best:
                continue
            n, d, f = best[i, j]
            if n > 3:
                continue
            if i < len(t) and j < len(s) and t[i] == s[j]:
                best.setdefault((i + 1, j + 1), (n, d, f))
                if best[i + 1, j + 1][0] > n:
                    best[i + 1, j + 1] = (n, d, f)
            for a, b in CONFUSIONS:
                if t.startswith(a, i) and s.startswith(b, j):
                    key, val = (i + len(a), j + len(b)), (n + 1, d + b.isdigit(), min(f, j))
                    if key not in best or best[key][0] > val[0]:
                        best[key] = val
    return best.get((len(t), len(s)))


@lru_cache(1 << 16)
def _core_mistakes(s: str, t: str) -> tuple[int, int, int] | None:
    return mistakes(s, t)


@lru_cache(1 << 16)
def _alike(s: str, t: str) -> tuple[int, float]:
    """Edits between two short strings, and the share of their signs of one shape."""
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        diag, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            diag, row[j] = row[j], min(diag + (c != d), row[j] + 1, row[j - 1] + 1)
    same = sum(c == d or any(c in g and d in g for g in SHAPES) for c, d in zip(s, t, strict=False))
    return row[-1], same / max(len(s), len(t), 1)


def _difference(s: str, t: str) -> tuple[int, int, int, int, float, int]:
    """How s differs from t: confusions (9 if they don't explain it), digits among them, first place, edits, likeness of the shapes, signs behind it."""
    i, n = 0, min(len(s), len(t))
    while i < n and s[i] == t[i]:
        i += 1
    k = 0
    while k < n - i and s[len(s) - 1 - k] == t[len(t) - 1 - k]:
        k += 1
    m = _core_mistakes(s[i : len(s) - k], t[i : len(t) - k])
    if m is None:
        # A confusion may begin or end in the part that agrees.
        a, z = max(0, i - 1), max(0, k - 1)
        m = _core_mistakes(s[a : len(s) - z], t[a : len(t) - z])
    edits, alike = _alike(s[i : len(s) - k], t[i : len(t) - k])
    return (*(m[:2] if m else (9, 0)), i, edits, alike, k)


FEATURES = 20


def _rank_features(chars: Characters, rows: list[tuple[str, int, str, int]]) -> np.ndarray:
    """Features of (form, its count, candidate, its count)."""
    forms, words = [r[0] for r in rows], [r[2] for r in rows]
    a, b, least_a, least_b = chars.score(forms), chars.score(words), chars.least(forms), chars.least(words)
    diff = np.array([_difference(s, t) for s, _, t, _ in rows], float).reshape(-1, 6)
    digits_s, digits_t = (np.array([sum(c.isdigit() for c in w) for w in ws], float) for ws in (forms, words))
    size_s, size_t = (np.array([len(w) for w in ws], float) for ws in (forms, words))
    ns, nt = np.array([r[1] for r in rows], float), np.array([r[3] for r in rows], float)
    n, d, first, edits, alike, behind = diff.T.reshape(6, -1)
    out = [np.log1p(ns), np.log1p(nt), np.log((nt + 0.5) / ns), n, d, digits_s - d, first == 0, size_s, a, b, (b - a) * (size_t + 1), digits_t, np.minimum(n, 9) / size_s, edits, alike, behind, size_s - size_t, least_a, least_b, least_b - least_a]
    return np.stack(out, 1).reshape(-1, FEATURES)


def variants(s: str, chars: Characters | None = None) -> list[str]:
    """What a form may have been: one confusion undone, or all digits among its letters at once, each as the characters around it have it."""
    out = {s[:i] + a + s[i + len(b) :] for a, b in CONFUSIONS for i in range(len(s)) if s.startswith(b, i)}
    if chars is not None and sum(c.isdigit() for c in s) > 1:
        form = s
        while any(c.isdigit() for c in form):
            i = next(i for i, c in enumerate(form) if c.isdigit())
            back = [a for a, b in CONFUSIONS if b == form[i]]
            if not back:
                break
            tries = [form[:i] + x + form[i + 1 :] for x in back]
            form = tries[int(chars.score([t[: i + 3] for t in tries]).argmax())]
        out.add(form)
    return sorted(out - {s})


def _neighbours(words: list[str]) -> dict[str, set[str]]:
    """For each word those one edit away."""
    by: dict[str, list[str]] = {}
    for w in words:
        for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(d, []).append(w)
    out: dict[str, set[str]] = {w: set() for w in words}
    for ws in by.values():
        if 1 < len(ws) <= 50:
            for w in ws:
                out[w].update(ws)
    return out


def train_ranker(common: dict[str, int], chars: Characters, seed: int = SEED) -> boosting.Boosted | None:
    """Trees that tell a mistake and its right form from two right forms, from words made wrong."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[str]] = {}
    for w in common:
        if len(w) >= 3:
            by.setdefault(skeleton(w), []).append(w)
    # Forms beside which one of the same skeleton is much more frequent may be mistakes themselves.
    words = [w for ws in by.values() for w in ws if not any(c.isdigit() for c in w) and common[w] * 20 > max(common[x] for x in ws)]
    if len(words) < 20:
        return None
    near = _neighbours(words)
    alike = {c: sorted({d for g in SHAPES if c in g for d in g} - {c}) for g in SHAPES for c in g}
    rows, y = [], []
    taken = [words[i] for i in rng.permutation(len(words))[:4000]]

    def add(s: str, n: int, t: str, nt: int, label: int) -> None:
        rows.append((s, n, t, nt))
        y.append(label)

    for t in taken:
        made = [(i, a, b) for a, b in CONFUSIONS for i in range(len(t)) if t.startswith(a, i)]
        shaped = [(i, c, d) for i, c in enumerate(t) for d in alike.get(c, ())]
        for k in range(3):
            among = made if k < 2 else shaped
            if not among:
                continue
            i, a, b = among[int(rng.integers(len(among)))]
            s = t[:i] + b + t[i + len(a) :]
            if k == 2 and s in common:
                continue
            add(s, common.get(s, 0) + max(1, rng.binomial(common[t], 10 ** rng.uniform(-4, -2.3))), t, 0 if k < 2 and rng.random() < 0.3 else common[t], 1)
            # Wrong ways to undo what was made.
            for u in rng.permutation(variants(s))[:3]:
                if u != t:
                    add(s, rows[-1][1], str(u), common.get(str(u), 0), 0)
        # Right words as they are, at counts small and large, against what they might have been.
        for u in by[skeleton(t)]:
            if u != t and mistakes(t, u):
                add(t, common[t], u, common[u], 0)
        for u in rng.permutation(sorted(near[t] - {t}))[:4]:
            add(t, common[t] if rng.random() < 0.3 else int(rng.integers(1, 6)), str(u), common[str(u)], 0)
        for u in rng.permutation(variants(t))[:4]:
            if not common.get(str(u)):
                add(t, common[t] if rng.random() < 0.5 else int(rng.integers(1, 6)), str(u), 0, 0)
    # Keys and the like: not words, and no mistakes either.
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    for k in range(900):
        s = "".join(signs[i] for i in rng.integers(0, 26 if k % 3 == 0 else len(signs), int(rng.integers(2, 20))))
        for u in rng.permutation(variants(s))[:3] if len(s) < 20 else []:
            add(s, 1, str(u), common.get(str(u), 0), 0)
    return boosting.fit(_rank_features(chars, rows), np.array(y, float)) if 0 < sum(y) < len(y) else None


def _grams(k: str) -> list[tuple[int, int]]:
    """Hashes of the q-grams of a skeleton, its ends marked, each with its place from the start and from the end: 4-grams of long ones, 3-grams of others.

    What stands before a mistake keeps its place from the start, what stands behind it that from the end.
    """
    k = f"^{k}$"
    q = 4 if len(k) > LONG_SKELETON + 1 else 3
    at = lambda side, i, g: xxhash.xxh64_intdigest(f"{side}{i}{g}".encode("utf-8", "replace")) >> 1
    return [(at("^", i, k[i : i + q]), at("$", len(k) - i, k[i : i + q])) for i in range(len(k) - q + 1)]


def _all_grams(k: str) -> list[int]:
    """The hashes that a word is posted under; near the bound of long skeletons both kinds, as its forms may be on either side of it."""
    out = {g for gs in _grams(k) for g in gs}
    if abs(len(k) - LONG_SKELETON) <= 3:
        q = 4 if len(k) < LONG_SKELETON else 3
        k = f"^{k}$"
        for i in range(len(k) - q + 1):
            for side, j in (("^", i), ("$", len(k) - i)):
                out.add(xxhash.xxh64_intdigest(f"{side}{j}{k[i : i + q]}".encode("utf-8", "replace")) >> 1)
    return sorted(out)


def candidates(words: DataFrame, forms: DataFrame) -> DataFrame:
    """s, n0, t, nt: the forms with each word that a mistake may have made them of, by q-grams and an edit bound.

    Words are seen three times as often as the form and have no digit. A word of the form's skeleton
    shares all its grams, so such words meet under the rarest one. Words UNUSUAL_RATIO times as
    frequent may differ by any one mistake; they meet under one of the rarest POSTED grams. The
    numbers of words by class of hashed grams, of fixed size, say which grams are rare.
    """
    spark = words.sparkSession

    def spread(df: pd.DataFrame, keys: list[str], grams: list[list[int]], names: list[str]) -> pd.DataFrame:
        size = [len(g) for g in grams]
        return pd.DataFrame(dict(zip(names, (np.array([g for gs in grams for g in gs], np.int64), np.repeat(df.word.to_numpy(object), size), np.repeat(np.array(keys, object), size), np.repeat(df.n.to_numpy(np.int64), size)), strict=True)))

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            keys = [skeleton(w) for w in df.word]
            yield spread(df, keys, [_all_grams(k) for k in keys], ["gram", "t", "kt", "nt"])

    parts = spark.sparkContext.defaultParallelism
    right = cut(words.where("n >= 3 and not word rlike '[0-9]'").repartition(parts).mapInPandas(post, "gram bigint, t string, kt string, nt bigint"))
    count = np.zeros(GRAM_CLASSES, np.int64)
    for r in right.groupBy(F.pmod("gram", F.lit(GRAM_CLASSES)).alias("c")).count().collect():
        count[r.c] = r["count"]
    shared = spark.sparkContext.broadcast(count)

    def post_rarest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = shared.value
        for df in frames:
            keys, first, rest = [skeleton(w) for w in df.word], [], []
            for k in keys:
                grams = sorted(_grams(k), key=lambda g: count[g[0] % GRAM_CLASSES] + count[g[1] % GRAM_CLASSES])
                first.append([min(g, key=lambda x: count[x % GRAM_CLASSES]) for g in grams[:1]])
                rest.append([x for g in grams[: POSTED + (len(k) >= LONG_SKELETON)] for x in g])
            for grams, only in ((first, False), (rest, True)):
                out = spread(df, keys, grams, ["gram", "s", "ks", "n0"])
                out["frequent"] = only
                yield out

    wrong = cut(forms.repartition(parts).mapInPandas(post_rarest, "gram bigint, s string, ks string, n0 bigint, frequent boolean"))
    near = (F.abs(F.length("ks") - F.length("kt")) <= 3) & (F.col("s") != F.col("t"))
    equal = wrong.where("not frequent").join(right, "gram").where(near & (F.col("nt") >= 3 * F.col("n0")) & (F.levenshtein("ks", "kt", 1) >= 0))
    # One edit of whatever signs, or what confusions level.
    other = wrong.where("frequent").join(right.where(F.col("nt") >= UNUSUAL_RATIO), "gram").where(near & (F.col("nt") >= UNUSUAL_RATIO * F.col("n0")))
    other = other.where((F.levenshtein("ks", "kt", 1) >= 0) | (F.levenshtein("s", "t", 1) >= 0))
    return equal.unionByName(other).select("s", "n0", "t", "nt").distinct()


def corrections(words: DataFrame, forms: DataFrame, rare: int, chars: Characters, ranker: boosting.Boosted | None) -> DataFrame:
    """word, fix, score of the forms judged to be mistakes.

    Each form is ranked against its candidates, and forms with digits, or rare ones that no word
    looks like, also against what they may have been by the character model alone.
    """
    met = candidates(words, forms)
    alone = forms.where(F.col("word").rlike("[0-9]") | (F.col("n") <= rare)).select(F.col("word").alias("s"), F.col("n").alias("n0"), F.lit(None).cast("string").alias("t"), F.lit(0).cast("long").alias("nt"))
    # Ranking is long work on few bytes: rows are spread out by number.
    both = cut(met.unionByName(alone))
    both = both.repartition(max(words.sparkSession.sparkContext.defaultParallelism, both.count() // 20_000))
    shared = words.sparkSession.sparkContext.broadcast((chars, ranker))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, ranker = shared.value
        for df in frames:
            rows: list[tuple[str, int, str, int]] = []
            plaus = chars.score(df.s.tolist())
            for s, n, t, nt, p in zip(df.s, df.n0, df.t, df.nt, plaus, strict=True):
                if t is not None:
                    rows.append((s, int(n), t, int(nt)))
                elif len(s) > 2 and (any(ch.isdigit() for ch in s) or p < -2.6):
                    rows += [(s, int(n), v, 0) for v in variants(s, chars)]
            if not rows or ranker is None:
                continue
            x = _rank_features(chars, rows)
            unusual = x[:, 3] > 8
            # One sign that looks like another, or a digit among letters; an accent more or less is spelling.
            like = (x[:, 13] <= 1) & ((x[:, 14] == 1) | (x[:, 5] > x[:, 11])) & np.array([_bare(r[0]) != _bare(r[2]) for r in rows])
            out_of_reach = unusual & (~like | (x[:, 7] < UNUSUAL_LETTERS) | (x[:, 2] < np.log(UNUSUAL_RATIO)))
            score = np.where(out_of_reach, -9.0, ranker.score(x) - UNUSUAL * unusual)
            out = pd.DataFrame({"word": [r[0] for r in rows], "fix": [r[2] for r in rows], "score": score, "known": np.where(unusual, 0, [r[3] for r in rows])})
            yield out[out.score > 0]

    # Of the likely candidates the most frequent: others may be mistakes of it themselves.
    best = F.max_by("fix", F.struct("known", "score", "fix"))
    return both.mapInPandas(run, "word string, fix string, score double, known long").groupBy("word").agg(best.alias("fix"), F.max_by("score", F.struct("known", "score", "fix")).alias("score"))


def pair_features(a: str, b: str, blank: bool, common: dict[str, int], width: int) -> list[float]:
    """Of two lines, one under the other, without their outer spaces."""
    m = next(iter(broken_at(f"{a[-70:].rsplit(' ', 1)[-1]}\n{b[:70].split(' ', 1)[0]}")), None)
    whole = hyphened = left = right = 0.0
    sign = 0
    if m:
        x, y = m[2].lower(), m[4].lower()
        sign = 1 + (m[3] != "-")
        whole, hyphened = np.log1p(common.get(x + y, 0)), np.log1p(common.get(f"{x}-{y}", 0))
        left, right = np.log1p(common.get(x, 0)), np.log1p(common.get(y, 0))
    return [
        float(a[-1:] in _ENDS), float(a[-1:].isalpha()), float(a[-1:] in ",("), float(b[:1].islower()), float(b[:1].isupper()), float(b[:1].isdigit()), float(blank),
        len(a) / max(width, 1), (len(a) + len(b.split(" ", 1)[0]) + 1) / max(width, 1), len(b) / max(width, 1), sign, whole, hyphened, whole - hyphened, left, right,
        float(bool(m) and m[4][:1].isupper() and not m[2].isupper()), float(a[:1] in "#|"), float(b[:1] in "#|-*"), float(a[:1].isupper() and a.istitle()), float(a.isupper()), float("㐀" <= a[-1:] < "鿿" and "㐀" <= b[:1] < "鿿"),
    ]


def train_pairs(texts: list[str], common: dict[str, int], seed: int = SEED) -> tuple[boosting.Boosted | None, boosting.Boosted | None]:
    """Trees for `the second line goes on with the first` and for `the hyphen isn't part of the word`, from paragraphs wrapped anew."""
    rng = np.random.default_rng(seed)
    go, gy, hy, hyy = [], [], [], []
    paras = [p for t in texts for p in re.split(r"\n\s*\n", t) if "\n" not in p.strip() and len(p) > 60 and p[:1] not in "#|-*"]
    compounds = [w for w in common if re.fullmatch(rf"[{_L}]{{2,}}-[{_L}]{{2,}}(?:-[{_L}]+)*", w)]
    for n, p in enumerate(paras[:3000]):
        width = int(rng.integers(45, 90))
        line, lines = "", []
        for w in p.split():
            if rng.random() < 0.02 and compounds:
                w = compounds[int(rng.integers(len(compounds)))]
            if len(line) + len(w) + 1 > width:
                k = int(rng.integers(2, max(3, len(w) - 1)))
                if len(w) > 6 and w.isalpha() and rng.random() < 0.4:
                    sign = "-‐¬-"[int(rng.integers(4))]
                    lines.append((f"{line} {w[:k]}{sign}".strip(), 1))
                    line = w[k:]
                    continue
                if "-" in w and rng.random() < 0.8:
                    h = w.index("-") + 1
                    lines.append((f"{line} {w[:h]}".strip(), 2))
                    line = w[h:]
                    continue
                lines.append((line, 0))
                line = w
            else:
                line = f"{line} {w}".strip()
        lines.append((line, 0))
        for (a, kind), (b, _) in zip(lines, lines[1:], strict=False):
            go.append(pair_features(a, b, False, {}, width))
            gy.append(1)
            if kind:
                hy.append(pair_features(a, b, False, common, width))
                hyy.append(float(kind == 1))
        nxt = paras[(n + 1) % len(paras)]
        title = " ".join(w.capitalize() for w in p.split()[2:5])
        for a, b, blank in ((lines[-1][0], nxt[:width], bool(rng.integers(2))), (title, nxt[:width], bool(rng.integers(2))), (lines[-1][0], title, bool(rng.integers(2))), (title.upper(), lines[0][0], False)):
            go.append(pair_features(a, b, blank, {}, width))
            gy.append(0)
    make = lambda x, y: boosting.fit(np.array(x), np.array(y, float), trees=40) if 0 < sum(y) < len(y) else None
    return make(go, gy), make(hy, hyy)


def judge_broken(broken: DataFrame, words: DataFrame, hyphen: boosting.Boosted | None) -> DataFrame:
    """key of each broken word whose sign isn't part of the word, by the counts of the words it may be in all pages."""
    part = F.split("key", "\t")
    x, y = F.lower(part[0]), F.lower(part[2])
    looks = broken.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("role"), w.alias("word")) for i, w in enumerate((F.concat(x, y), F.concat(x, F.lit("-"), y), x, y))])).alias("l")).select("key", "l.*")
    counted = looks.join(words, "word", "left").groupBy("key").agg(*[F.max(F.when(F.col("role") == i, F.coalesce("n", F.lit(0)))).alias(f"n{i}") for i in range(4)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            feats = []
            for key, *n in zip(df.key, df.n0, df.n1, df.n2, df.n3, strict=True):
                left, sign, right, blank = key.split("\t")
                a, b = left.lower(), right.lower()
                feats.append(pair_features(f"{left}{sign}", right, blank == "1", {f"{a}{b}": n[0], f"{a}-{b}": n[1], a: n[2], b: n[3]}, 60))
            if feats:
                yield pd.DataFrame({"key": df.key[is_noise(np.array(feats), hyphen)]})

    return counted.mapInPandas(run, "key string")


def is_noise(x: np.ndarray, hyphen: boosting.Boosted | None) -> np.ndarray:
    """Whether the sign of each broken word isn't part of it."""
    noise = hyphen.score(x) > 0 if hyphen is not None else x[:, 11] >= x[:, 12]
    noise |= (x[:, 10] == 2) & (x[:, 12] == 0)  # signs that no word has
    noise &= ~((x[:, 12] > 0) & (x[:, 12] >= x[:, 11]))  # words that have a hyphen here
    return noise & ~((x[:, 16] > 0) & (x[:, 11] == 0) & (x[:, 10] == 1))


Edge = tuple[str, str, int, list[float] | None]


@dataclass
class Reader:
    """Frequent words that are no mistakes, in all capitals they may have (others are looked up), and the trees that say whether a line goes on."""

    common: set[str]
    goes_on: boosting.Boosted | None

    def repaired(self, text: str, page: int | None, fixes: dict[str, str], runs: set[str], noisy: set[str]) -> str:
        """The text as paragraphs: page number and running lines out, words made whole (without the sign where their key is among `noisy`) and right, lines that go on joined. Lines are judged as they stand, before words move over."""
        number, _, edges = self.edges(text, page)
        out = {number} | {i for where, key, i, _ in edges if f"{where}:{key}" in runs}
        raw = [x for i, x in enumerate(text.split("\n")) if i not in out]
        lines = [x.strip() for x in raw]
        width = max((len(x) for x in lines), default=0)
        pairs = [i for i in range(len(lines) - 1) if lines[i] and lines[i + 1] and lines[i][:1] not in "#|" and lines[i + 1][:1] not in "#|"]
        on: list[int] = []
        if pairs and self.goes_on is not None:
            score = self.goes_on.score(np.array([pair_features(lines[i], lines[i + 1], False, {}, width) for i in pairs]))
            on = [i for i, x in zip(pairs, score, strict=True) if x > 0]
        text = "\n".join(raw)
        edits = [(m[0], m[1], f"{m[2]}{m[4]}" if _broken_key(m, text) in noisy else f"{m[2]}-{m[4]}") for m in broken_at(text)]
        feed = np.cumsum([len(x) + 1 for x in raw]) - 1
        broken = {i for start, end, _ in edits for i in range(int(np.searchsorted(feed, start)), int(np.searchsorted(feed, end)))}
        for i in on:
            if i not in broken:
                chinese = "㐀" <= lines[i][-1:] and "㐀" <= lines[i + 1][:1]
                edits.append((int(feed[i]) - len(raw[i]) + len(raw[i].rstrip()), int(feed[i]) + 1 + len(raw[i + 1]) - len(raw[i + 1].lstrip()), "" if chinese else " "))
        parts, at = [], 0
        for start, end, to in sorted(edits):
            parts.append(text[at : max(at, start)])
            parts.append(to)
            at = max(at, end)
        text = "".join([*parts, text[at:]])
        if fixes:
            text = _WORD.sub(lambda m: _like(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], text)
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.split("\n"))).strip()

    def edges(self, text: str, page: int | None) -> tuple[int | None, bool, list[Edge]]:
        """Index of the line with the page's number, whether it is misread, and the (position, key, line, features) that may be running lines: with features, unless the trees say that the line goes on."""
        lines = text.split("\n")
        live = [i for i, x in enumerate(lines) if x.strip()]
        number, wrong = None, False
        if not live:
            return None, False, []
        spots = list(dict.fromkeys([live[0], live[-1], *(live[1:2] if len(live) > 2 else []), *(live[-2:-1] if len(live) > 2 else [])]))
        for i in spots:
            at = page_number(lines[i], page)
            if at is not None:
                number, wrong = i, at
                break
        out: list[Edge] = []
        if len(live) >= RUNNING_LINES:
            rest = [i for i in live if i != number] if number in (live[0], live[1], live[-1], live[-2]) else live
            for where, i, inner in (("top", rest[0], rest[1] if len(rest) > 1 else None), ("bottom", rest[-1], rest[-2] if len(rest) > 1 else None)):
                key = self.running_key(lines[i], page)
                if key:
                    part, f = self.in_sentence(lines, i, inner, where)
                    if not part:
                        out.append((where, key, i, f))
        return number, wrong, out

    def running_key(self, line: str, page: int | None) -> str | None:
        x = line.strip()
        if not x or x[0] in "#|" or x[-1] in ".。!?！？…":
            return None
        x = re.sub(r"</?[a-z]+>|[*_`]+", "", x).strip()
        if not x or x[0] in "#|" or x[-1] in ".。!?！？…,;，；" or re.match(r"[-+•]\s", x):
            return None
        if page is not None:
            ends = re.sub(r"^[^\w]+|[^\w]+$", "", x)
            for pattern in (r"^(\S{1,12})[\s|·•\-–—]+", r"[\s|·•\-–—]+(\S{1,12})$"):
                if (m := re.search(pattern, ends)) and m[1].translate(_DIGITS) == str(page):
                    ends = ends[: m.start()] + ends[m.end() :] if m.start() else ends[m.end() :]
            x = _NUMBERED.sub(lambda m: " " if int(m[1]) == page else m[0], ends)
        key = re.sub(r"[^\w]+", " ", skeleton(x.lower())).strip()
        return key if len(key) > 2 and not key.isdigit() else None

    def in_sentence(self, lines: list[str], i: int, inner: int | None, where: str) -> tuple[bool, list[float] | None]:
        """Whether an edge line is part of a sentence; where the trees are to say so, their features."""
        a = lines[i].strip()
        if a[-1:] in _ENDS[:6] or inner is None:
            return True, None
        if where == "top":
            return a[:1].islower() and not a.islower(), None
        if a[:1].islower():
            return True, None
        width = max(len(x) for x in lines)
        f = pair_features(lines[inner].strip(), a, inner < i - 1, {}, width)
        return False, f if self.goes_on is not None and inner == i - 1 and f[0] == 0 and f[6] == 0 and not a.istitle() and not a.isupper() else None

    def settled(self, edges: list[list[Edge]]) -> list[list[Edge]]:
        """The edges of many pages without lines that go on, all scored at once."""
        feats = [f for page in edges for *_, f in page if f is not None]
        on = iter(self.goes_on.score(np.array(feats)) > 0) if feats and self.goes_on is not None else iter(())
        return [[e for e in page if e[3] is None or not next(on)] for page in edges]


def roman(n: int) -> str:
    """A positive number in small Roman numerals, '' for others."""
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def page_number(line: str, page: int | None) -> bool | None:
    """Whether the line's page number is misread, None if it isn't the page's number."""
    line = line.strip()
    if page is None or ("<" not in line and _MANY_PARTS.match(line)):
        return None
    x = unicodedata.normalize("NFKC", re.sub(r"</?[a-z]+>|[*_`]+", "", line)).strip().lower()
    if not x or x.count("|") > 2 or len(_NUMBER_PARTS.findall(x)) > 5:
        return None
    if (m := _PAGENUM.match(x)) and int(m[1]) == page:
        return False
    if re.fullmatch(r"[\W_]*([ivxlcdm]+)[\W_]*", x) and re.sub(r"[\W_]", "", x) == roman(page):
        return False
    raw = re.sub(r"</?[a-z]+>|[*_`]+", "", line).strip()
    parts = re.findall(r"[^\s\-–—_=~.•·\[\](){}<>/|]+|/|\|", raw)
    for k, p in enumerate(parts):
        if p.translate(_DIGITS) == str(page) and (p != str(page) or len(parts) > 1):
            rest = [q for j, q in enumerate(parts) if j != k]
            fixed = " ".join([str(page) if j == k else skeleton(q.lower()) if not q.translate(_DIGITS).isdigit() else q.translate(_DIGITS) for j, q in enumerate(parts)])
            words = {skeleton(w) for w in ("page", "pages", "pag", "pág", "pagina", "página", "p", "seite", "s", "of", "von", "de", "sur", "di", "/", "|", "blatt", "folio")}
            if all(q.translate(_DIGITS).isdigit() or skeleton(q.lower()) in words for q in rest) and len(rest) <= 3 and (p != str(page) or any(q.lower() not in ("page", "pagina", "página", "seite", "of", "von", "de", "sur", "di", "/", "|") and not q.isdigit() for q in rest)):
                del fixed
                return True
    return None


NOTES = "row_id bigint, path string, page int, kind string, key string"


def notes(pages: DataFrame, reader: Reader) -> DataFrame:
    """One row for each thing noted on a page: pagenum, misread (of its number), top and bottom (lines that may run), word (uncommon words), broken (words over two lines)."""
    shared = pages.sparkSession.sparkContext.broadcast(reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, paths, nums = (batch.column(i).to_pylist() for i in range(3))
                texts = plain_texts(batch.column(3))
                seen = [reader.edges(t, page) for t, page in zip(texts, nums, strict=True)]
                out = []
                for r, path, page, t, (number, wrong, _), edges in zip(ids, paths, nums, texts, seen, reader.settled([e for *_, e in seen]), strict=True):
                    found = broken_at(t)
                    out += [(r, None, None, "broken", k) for k in {_broken_key(m, t) for m in found}]
                    if number is not None:
                        out.append((r, None, None, "pagenum", None))
                        if wrong:
                            out.append((r, None, None, "misread", None))
                    if path is not None and page is not None:
                        out += [(r, path, page, where, key) for where, key, *_ in edges]
                    forms = {*words_of(t, found), *(x for m in found for x in (m[2] + m[4], f"{m[2]}-{m[4]}"))} - reader.common
                    out += [(r, None, None, "word", w) for w in {w.lower() for w in forms if _cased(w)} - reader.common if _wordlike(w)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["row_id", "path", "page", "kind", "key"])

    return pages.where("text is not null").select("row_id", "path", F.col("page").cast("int").alias("page"), "text").mapInArrow(run, NOTES)


def most_frequent(words: DataFrame, most: int = COMMON_WORDS) -> dict[str, int]:
    """At most about `most` words with their counts, the most frequent ones; of the step of frequency in which the bound falls a part by hash.

    A histogram of a few hundred steps is collected first, then the words above the cut alone.
    """
    step = F.floor(F.log2("n") * 16)
    kept, cutoff, part = 0, None, 0.0
    for r in sorted(words.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):
        cutoff = r.s
        if kept + r["count"] > most:
            part = (most - kept) / r["count"]
            break
        kept, part = kept + r["count"], 1.0
    if cutoff is None:
        return {}
    some = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(part * (1 << 20))
    return {r.word: int(r.n) for r in words.where((step > cutoff) | ((step == cutoff) & some)).collect()}


_models: dict[bytes, object] = {}


def _kept(inputs: tuple, train: Callable[[], tuple]) -> tuple:
    """What `train` makes of these inputs, kept by the driver for the next query on the same ones."""
    h = xxhash.xxh3_128()
    for part in inputs:
        h.update(repr(sorted(part.items()) if isinstance(part, dict) else part).encode("utf-8", "replace"))
    key = h.digest()
    if key not in _models:
        while len(_models) > 5:
            _models.pop(next(iter(_models)))
        _models[key] = train()
    return _models[key]


def _ranker_of(counted: dict[str, int]) -> tuple[Characters, boosting.Boosted | None]:
    chars = Characters({w: n for w, n in counted.items() if not any(c.isdigit() for c in w) and n > 1} or counted)
    return chars, train_ranker(counted, chars)


@dataclass
class Studied:
    reader: Reader
    fixes: DataFrame
    noisy: DataFrame


def study(pages: DataFrame) -> Studied:
    """The reader, the corrections and the broken words for a table of pages; all words of all pages are counted."""
    counts = cut(lexicon(pages))
    words, broken = counts.where("not broken").select("word", "n"), counts.where("broken").select(F.col("word").alias("key"))
    counted = most_frequent(words)
    chars, ranker = _kept(("words", counted), lambda: _ranker_of(counted))
    # Words that were only seen broken may be mistakes, too.
    part = F.split("key", "\t")
    whole = broken.select(F.lower(F.concat(part[0], part[2])).alias("word")).where("length(word) between 2 and 40").distinct()
    forms = words.unionByName(whole.join(words, "word", "left_anti").select("word", F.lit(1).cast("bigint").alias("n")))
    n_pages = pages.count()
    fixes = cut(corrections(words, forms, max(3, int(n_pages * RARE_SHARE)), chars, ranker))
    # Mistakes among the most frequent forms aren't common words.
    wrong = {r.word for r in fixes.join(pages.sparkSession.createDataFrame([(w,) for w in counted], "word string"), "word").select("word").collect()} if counted else set()
    common = {w: n for w, n in counted.items() if w not in wrong and n > 1}
    every = max(1, -(-n_pages // TRAIN_PAGES))
    drawn = pages.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0)).select("text", F.xxhash64("row_id", "text").alias("h"))
    sample = drawn.orderBy("h").limit(TRAIN_PAGES).collect()
    texts = plain_texts(pa.array([r.text for r in sample], pa.string()))
    goes_on, hyphen = _kept(("lines", common, texts), lambda: train_pairs(texts, common))
    right = words.where("n > 1").join(fixes.select("word"), "word", "left_anti")
    # A broken word that is misread counts as what it was.
    mended = fixes.select("word", F.col("fix").alias("_fix")).join(words.select(F.col("word").alias("_fix"), "n"), "_fix").select("word", "n")
    right = right.unionByName(mended)
    spelled = {x for w in common for x in (w, w.capitalize(), w.upper())}
    return Studied(Reader(spelled, goes_on), fixes, judge_broken(broken, right, hyphen))


def _running(noted: DataFrame) -> DataFrame:
    """row_id, kind and key of the lines that return; one header may be on a great part of all pages, so both sides are salted."""
    edges = noted.where("kind in ('top', 'bottom')")
    often = edges.groupBy("path", "kind", "key").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= RUNNING_PAGES).select("path", "kind", "key")
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALT)).cast("int")).join(salted, ["path", "kind", "key", "salt"]).select("row_id", "kind", "key")


def found(pages: DataFrame) -> DataFrame:
    """row_id and noise (hyphen, misread, running, pagenum) of each kind of noise on each page. Null, empty and blank texts have none."""
    known = study(pages)
    noted = cut(notes(pages, known.reader))
    plain = noted.where("kind in ('pagenum', 'misread')").select("row_id", F.col("kind").alias("noise"))
    hyphen = noted.where("kind = 'broken'").join(known.noisy, "key").select("row_id", F.lit("hyphen").alias("noise"))
    wrong = noted.where("kind = 'word'").select("row_id", F.col("key").alias("word")).join(known.fixes.select("word"), "word").select("row_id", F.lit("misread").alias("noise"))
    running = _running(noted).select("row_id", F.lit("running").alias("noise"))
    return plain.unionByName(hyphen).unionByName(wrong).unionByName(running).distinct()


def repair(pages: DataFrame) -> DataFrame:
    """row_id, path, page and the repaired text of each page, as paragraphs. Null texts stay null, blank ones become empty; repeated rows come out each."""
    known = study(pages)
    noted = cut(notes(pages, known.reader))
    words = noted.where("kind = 'word'").select("row_id", F.col("key").alias("word")).distinct().join(known.fixes.select("word", "fix"), "word")
    found = words.select("row_id", F.lit("fixes").alias("what"), F.concat_ws("\t", "word", "fix").alias("x"))
    found = found.unionByName(_running(noted).select("row_id", F.lit("runs").alias("what"), F.concat_ws(":", "kind", "key").alias("x")))
    found = found.unionByName(noted.where("kind = 'broken'").join(known.noisy, "key").select("row_id", F.lit("noisy").alias("what"), F.col("key").alias("x")))
    by_page = found.groupBy("row_id").agg(*[F.collect_set(F.when(F.col("what") == w, F.col("x"))).alias(w) for w in ("fixes", "runs", "noisy")])
    shared = pages.sparkSession.sparkContext.broadcast(known.reader)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: x if x is not None else ()
        for df in frames:
            plain = plain_texts(pa.array(df.text, pa.string()))
            out = []
            for t, raw, page, fixes, runs, noisy in zip(plain, df.text, df.page, df.fixes, df.runs, df.noisy, strict=True):
                fix = dict(x.split("\t") for x in some(fixes))
                out.append(None if raw is None else shared.value.repaired(t, None if pd.isna(page) else int(page), fix, set(some(runs)), set(some(noisy))))
            yield pd.DataFrame({"row_id": df.row_id, "path": df.path, "page": df.page, "text": out})

    base = pages.select("row_id", "path", F.col("page").cast("int").alias("page"), "text")
    return base.join(by_page, "row_id", "left").mapInPandas(run, "row_id bigint, path string, page int, text string")
