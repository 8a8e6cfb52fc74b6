"""Problem 2: one form for texts that look the same.

Texts are handled as code-point arrays. A gather table, filled for the code points that turn up,
gives each its expansion: compatibility decomposition, invisible characters to nothing, kinds of
space to a space, look-alike letters of other scripts to Latin. Expansions are placed by offsets,
combining marks are ordered and composed by array steps over all texts at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.codepoints import from_codepoints, slices, to_codepoints

#: Letters of other scripts that look like the Latin letter beside them.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухѕіјԁԛԝһҮӀӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ" "ՕօսոԼ" "ᎪᏴᏟᎠᎬᎻᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ" "ꓐꓚꓓꓰꓝꓖꓧꓡꓟꓠꓳꓑꓣꓢꓔꓬꓜ",
        "ABESIJKMHOPCTYXaeopcyxsijdqwhYIl" "ABEZHIKMNOPTYXocj" "OounL" "ABCDEHKLMPRSTVWZ" "BCDEFGHLMNOPRSTYZ",
        strict=True,
    )
)
LOOKALIKES |= dict(zip("Ɩɑɡᴏᴠᴡᴢνѵѡԍ", "lagovwzvvwG", strict=True))

#: Default-ignorable code points that are not of category Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

TOP = 0x110000


def _fold(c: int) -> list[int]:
    """Expansion of one code point. Precomposed Hangul stays whole."""
    if 0xAC00 <= c < 0xD7A4:
        return [c]
    if c in (0x0D, 0x0A, 0x09):
        return [0x0A] if c == 0x0D else [c]
    out = []
    for ch in unicodedata.normalize("NFKD", chr(c)):
        kind = unicodedata.category(ch)
        if ord(ch) in INVISIBLE or kind in ("Cf", "Cc"):
            if ch in "\n\t":
                out.append(ord(ch))
            continue
        if kind in ("Zl", "Zp"):
            ch = "\n"
        elif kind == "Zs":
            ch = " "
        out.append(ord(LOOKALIKES.get(ch, ch)))
    return out


class Folder:
    """Gather tables that fill up as code points turn up."""

    def __init__(self) -> None:
        self.known = np.zeros(TOP, bool)
        self.start = np.zeros(TOP, np.int32)
        self.size = np.ones(TOP, np.int8)
        self.pool: list[int] = []
        self.ccc = np.zeros(TOP, np.uint8)
        pairs: dict[int, int] = {}
        for c in range(0xC0, TOP):
            if 0xAC00 <= c < 0xD7A4 or 0x3400 <= c < 0xA000 or c >= 0x1E000:
                continue
            d = unicodedata.decomposition(chr(c))
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
                a, b = (int(x, 16) for x in d.split())
                pairs[a << 21 | b] = c
        self.pair = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[int(k)] for k in self.pair], np.uint32)

    def learn(self, cp: np.ndarray) -> None:
        new = np.unique(cp[~self.known[cp]])
        for c in new.tolist():
            out = _fold(c)
            self.start[c], self.size[c] = len(self.pool), len(out)
            self.pool += out
            for x in out:
                self.ccc[x] = unicodedata.combining(chr(x))
        self.known[new] = True

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composed code point of each pair, 0 where there is none."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key = a << 21 | b
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        out = np.where(self.pair[i] == key, self.made[i], 0).astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, out)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        return np.where(lvt, a + b - 0x11A7, out)


_folder: Folder | None = None


def folder() -> Folder:
    global _folder
    if _folder is None:
        _folder = Folder()
    return _folder


#: What is known of code points: a text of stable ones alone is in canonical form.
_state = np.zeros(0x110000, np.uint8)
_STABLE, _UNSTABLE = 1, 2


def _learn_stable(cp: np.ndarray) -> None:
    """Enter code points not seen before: stable are those that fold to themselves and join with none before them."""
    new = np.unique(cp[_state[cp] == 0])
    if len(new):
        out, at = _fold_all(new, np.arange(len(new) + 1))
        same = np.diff(at) == 1
        same[same] = out[at[:-1][same]] == new[same]
        same &= (folder().ccc[new] == 0) & (new != 0x0D) & ~((new >= 0x1100) & (new < 0x1200))
        same &= np.array([unicodedata.category(chr(c))[0] != "M" for c in new])
        _state[new] = np.where(same, _STABLE, _UNSTABLE)


def fold(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code points and offsets of the texts cp[at[i]:at[i + 1]]; texts that are in canonical form are passed over."""
    odd = np.flatnonzero((cp >= 0x7F) | (cp < 0x20))
    if len(odd) == 0:
        return cp, at
    _learn_stable(cp[odd])
    rows = np.unique(np.searchsorted(at, odd[_state[cp[odd]] != _STABLE], "right") - 1)
    if len(rows) == 0:
        return cp, at
    if 2 * len(rows) > len(at) - 1:
        return _fold_all(cp, at)
    size = np.diff(at)
    sub_at = np.concatenate([[0], np.cumsum(size[rows])])
    out, out_at = _fold_all(np.concatenate([cp[at[r] : at[r + 1]] for r in rows]), sub_at)
    parts, last = [], 0
    for k, r in enumerate(rows):
        parts += [cp[last : at[r]], out[out_at[k] : out_at[k + 1]]]
        last = at[r + 1]
    size = size.copy()
    size[rows] = np.diff(out_at)
    return np.concatenate([*parts, cp[last:]]), np.concatenate([[0], np.cumsum(size)])


def _fold_all(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`fold` of every text."""
    f = folder()
    odd = np.flatnonzero((cp >= 0x7F) | (cp < 0x20))
    if len(odd) == 0:
        return cp, at
    f.learn(cp[odd])
    # A carriage return before a line feed goes; alone it is a line feed.
    cr = odd[cp[odd] == 0x0D]
    size = np.ones(len(cp), np.int64)
    size[odd] = f.size[cp[odd]]
    if len(cr):
        ends = np.isin(cr + 1, at)
        size[cr[(np.take(cp, np.minimum(cr + 1, len(cp) - 1)) == 0x0A) & ~ends]] = 0
    to = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    out = np.repeat(cp, size)
    pool = np.asarray(f.pool, np.uint32)
    live = odd[size[odd] > 0]
    n = size[live]
    first = np.repeat(f.start[cp[live]].astype(np.int64), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to[live], n) + within] = pool[first + within]
    at = to[at]

    # Marks: canonical order within each run, then composition round by round.
    ccc = f.ccc[out]
    mark = np.flatnonzero(ccc > 0)
    jamo = np.flatnonzero((out >= 0x1161) & (out < 0x11C3)) if len(out) else mark
    if len(mark) == 0 and len(jamo) == 0:
        return out, at
    if len(mark):
        run = np.cumsum(np.concatenate([[True], (np.diff(mark) != 1) | np.isin(mark[1:], at)]))
        order = np.lexsort((np.arange(len(mark)), ccc[mark], run))
        out[mark] = out[mark[order]]
    keep = np.ones(len(out), bool)
    first_of = np.zeros(len(out), bool)
    first_of[at[:-1][at[:-1] < len(out)]] = True
    while True:
        live = np.flatnonzero(keep)
        code, klass = out[live], f.ccc[out[live]]
        starter = np.where(klass == 0, np.arange(len(live)), -1)
        np.maximum.accumulate(starter, out=starter)
        # Marks at the head of a text have no starter of their own text.
        text_head = np.where(first_of[live], np.arange(len(live)), 0)
        np.maximum.accumulate(text_head, out=text_head)
        cand = np.flatnonzero(((klass > 0) | ((code >= 0x1161) & (code < 0x11C3))) & (np.arange(len(live)) > 0))
        base = np.where(klass[cand] > 0, starter[cand], cand - 1)
        prev = klass[cand - 1]
        ok = (base >= text_head[cand]) & ~first_of[live[cand]] & ((cand - 1 == base) | ((prev > 0) & (prev < klass[cand])))
        cand, base = cand[ok], base[ok]
        made = f.compose(code[base], code[cand]) if len(cand) else np.zeros(0, np.int64)
        cand, base, made = cand[made > 0], base[made > 0], made[made > 0]
        if len(cand) == 0:
            break
        base, pick = np.unique(base, return_index=True)
        # A jamo that is itself a base this round waits for the next one.
        free = ~np.isin(base, cand[pick])
        base, pick = base[free], pick[free]
        out[live[base]] = made[pick]
        keep[live[cand[pick]]] = False
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[at]


def canonical_form(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """`df` with the canonical form of `text` in column `out` (replaced if it is there).

    Two texts get equal forms exactly if they differ in compatibility forms, composed and combining
    accents, invisible characters, kinds of space or look-alike letters only. Null stays null, an
    empty text or one of invisible characters only becomes empty. Line breaks stay apart from
    spaces; CR LF, CR and the Unicode separators count as a line feed. Nothing is shuffled.
    """
    df = df.drop(out)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                col = batch.column(batch.schema.get_field_index(text))
                cp, at = fold(*to_codepoints(col))
                made = from_codepoints(cp, at, np.asarray(col.is_valid()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def rows_of(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """kind, path, page, row_id and text of both tables."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "path", "page", "row_id", "text")
    return one(pages, "page").unionByName(one(marks, "mark"))


def found(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs of rows of one kind, path and page whose texts differ but have the same form.

    Texts travel as hashes: 128 bits of the form and 128 of the raw text, of two seeds each. Rows with null path or page
    pair with none; rows blank in their canonical form are left out.
    """
    forms = canonical_form(rows_of(pages, marks).where(F.col("text").isNotNull() & F.col("path").isNotNull() & F.col("page").isNotNull()))
    keyed = forms.where(F.col("canonical").rlike(r"[^\s]")).select(
        "kind", "path", "page", "row_id", *[h.alias(n) for n, h in (("f", F.xxhash64("canonical")), ("g", F.xxhash64(F.lit(1), "canonical")), ("raw", F.xxhash64("text")), ("more", F.xxhash64(F.lit(1), "text")))]
    )
    key = ["kind", "path", "page", "f", "g"]
    a = keyed.withColumnsRenamed({"row_id": "row_a", "raw": "raw_a", "more": "more_a"})
    b = keyed.withColumnsRenamed({"row_id": "row_b", "raw": "raw_b", "more": "more_b"})
    return a.join(b, key).where("row_a < row_b and (raw_a <> raw_b or more_a <> more_b)").select("kind", "row_a", "row_b")
