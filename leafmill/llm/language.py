"""Problem 4: languages of pages and of the segments of mixed pages.

The model averages hashed subword embeddings (a word and its 2- to 4-grams) and puts a linear softmax
on the mean; both are trained by stochastic gradient descent in numpy on the clean samples and on
fragments of them. Confidence is calibrated on samples held out, by a temperature that depends on the
length, and a threshold on it rejects sentences that are better left to their neighbours. For use,
embeddings and softmax are fused to one small table of scores per hash; each batch scores every
distinct word once, adds the scores up by sentence, and finds the cheapest chain of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.codepoints import slices, to_codepoints

BUCKETS = 1 << 15
DIM = 16
EPOCHS = 24
#: At most so many labelled samples are taken to the driver for training.
MAX_SAMPLES = 20_000
#: Cost in log-likelihood of a change of language between two sentences.
SWITCH = 4.0
WHOLE_WORDS, WHOLE_HAN = 4, 8
SEED = 11

#: The ways in which labels name the six languages; labels outside are missing ones.
LABELS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "it": ["it", "ita", "italian", "italiano"],
    "zh": ["zh", "zho", "chi", "chinese", "cmn", "mandarin", "中文", "汉语"],
}

_LOWER = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
_LOWER[0x30:0x3A] = 0
_LOWER[0x2019] = 0x27
_PLAIN = np.zeros(0x110000, bool)  # letters that count as text
for _c in range(0x250):
    _PLAIN[_c] = chr(_c).isalpha()
_PLAIN[0x300:0x370] = True
_PLAIN[0x370:0x530] = True
_HAN = np.zeros(0x110000, bool)
_HAN[0x3400:0xA000] = _HAN[0x20000:0x32000] = _HAN[0x2E80:0x2FE0] = _HAN[0xF900:0xFB00] = True
_SPACE = np.zeros(0x110000, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_UPPER = np.zeros(0x110000, bool)
for _c in range(0x530):
    _UPPER[_c] = chr(_c).isupper()
_UPPER[[ord(c) for c in "¿¡“„«\"'（("]] = True
_UPPER |= _HAN
_TABLE = np.random.default_rng(1).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(4096, 0x5851F42D4C957F2D, np.uint64))


def _codes(cp: np.ndarray) -> np.ndarray:
    return _TABLE[(cp ^ (cp >> 16) * 40503) & 0xFFFF]


def tokens(cp: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word: a run of letters or of Han signs; `heads` are places where a word can't go on."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = _PLAIN[cp].astype(np.int8) + 2 * _HAN[cp]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new[heads[heads < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    word = kind[start] > 0
    off = np.arange(n) - np.repeat(start, end - start)
    h = np.add.reduceat(_codes(_LOWER[cp]) * _POWER[np.minimum(off, 4095)], start)
    return start[word], end[word], h[word]


def grams(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of each feature of the words: the padded word and its 2- to 4-grams."""
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    buf = np.full(int(at[-1]), ord("_"), np.uint32)
    inner = np.arange(int((end - start).sum())) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
    buf[np.repeat(at[:-1] + 1, end - start) + inner] = _LOWER[cp[np.repeat(start, end - start) + inner]]
    who = np.repeat(np.arange(len(start)), size)
    code = _codes(buf)
    out, owner = [], []
    for g in (2, 3, 4):
        if len(buf) < g:
            continue
        h = np.zeros(len(buf) - g + 1, np.uint64)
        for i in range(g):
            h += code[i : len(buf) - g + 1 + i] * _POWER[i]
        ok = who[: len(h)] == who[g - 1 :]
        out.append(h[ok])
        owner.append(who[: len(h)][ok])
    whole = np.add.reduceat(code * _POWER[np.minimum(np.arange(len(buf)) - np.repeat(at[:-1], size), 4095)], at[:-1]) * np.uint64(3) if len(start) else np.zeros(0, np.uint64)
    h = np.concatenate([*out, whole])
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int32), np.concatenate([*owner, np.arange(len(start))])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages, float32
    scale: float
    power: float
    reject: float

    def words(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per word the sums of scores, and in the last column the number of features."""
        b, who = grams(cp, start, end)
        k = len(self.langs)
        out = np.empty((len(start), k + 1))
        s = self.scores[b]
        for j in range(k):
            out[:, j] = np.bincount(who, s[:, j], len(start))
        out[:, k] = np.bincount(who, minlength=len(start))
        return out

    def log_probs(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated log-probabilities of rows of summed scores and counts."""
        n = np.maximum(sums[:, -1:], 1)
        x = sums[:, :-1] / n * self.scale * np.minimum(n, 400) ** self.power
        x -= x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))


def _features(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    start, end, _ = tokens(cp, np.zeros(0, np.int64))
    return grams(cp, start, end)[0]


def _fragments(text: str, rng: np.random.Generator, times: int) -> list[str]:
    unit = text.split(" ") if " " in text else list(text)
    glue = " " if " " in text else ""
    out = []
    for _ in range(times):
        m = min(len(unit), int(rng.integers(3, 14) * (1 if glue else 2)))
        i = int(rng.integers(0, len(unit) - m + 1))
        out.append(glue.join(unit[i : i + m]))
    return out


def train(samples: list[tuple[str, str]], seed: int = SEED) -> Model:
    """The model of samples (language, text). One sample in five is held out for calibration, then all are trained on."""
    samples = sorted((lang, text) for lang, text in samples if lang and text and text.strip())
    if not samples:
        raise ValueError("no labelled samples")
    langs = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = [samples[i] for i in order[: len(samples) // 5]]
    rest = [samples[i] for i in order[len(samples) // 5 :]]

    def fit(rows: list[tuple[str, str]]) -> np.ndarray:
        data = [(langs.index(lang), f) for lang, t in rows for s in [t, *_fragments(t, rng, 2)] if len(f := _features(s))]
        emb = rng.normal(0, 0.1, (BUCKETS, DIM))
        soft = np.zeros((DIM, len(langs)))
        for epoch in range(EPOCHS):
            rate = 0.5 * (1 - epoch / EPOCHS)
            for i in rng.permutation(len(data)):
                y, f = data[i]
                mean = emb[f].mean(0)
                x = mean @ soft
                p = np.exp(x - x.max())
                p /= p.sum()
                p[y] -= 1
                grad = soft @ p
                soft -= rate * np.outer(mean, p)
                np.subtract.at(emb, f, rate * 8 / len(f) * grad)
        return (emb @ soft).astype(np.float32)

    model = Model(langs, fit(rest), 1.0, 0.0, 0.0)
    rows = [(langs.index(lang), s) for lang, t in (held or rest) for s in [t, *_fragments(t, rng, 4)]]
    sums, y = [], []
    for lang, s in rows:
        if len(f := _features(s)):
            sums.append([*model.scores[f].sum(0), len(f)])
            y.append(lang)
    sums, y = np.array(sums), np.array(y)
    best = np.inf
    for scale in (0.5, 1, 2, 4, 8):
        for power in (0.0, 0.25, 0.5):
            loss = -Model(langs, model.scores, scale, power, 0).log_probs(sums)[np.arange(len(y)), y].mean()
            if loss < best:
                best, model.scale, model.power = loss, scale, power
    lp = model.log_probs(sums)
    right, conf = lp.argmax(1) == y, np.exp(lp.max(1))
    # The least confidence above which at most 0.2 % of the held-out fragments are wrong.
    order = np.argsort(-conf)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(wrong <= 0.002)
    model.reject = float(min(0.9, conf[order][ok[-1]])) if len(ok) else 0.9
    model.scores = fit(samples)
    return model


_models: dict[bytes, Model] = {}


def digest(*parts: list[tuple[str, str]]) -> bytes:
    """A hash of lists of pairs of texts."""
    h = xxhash.xxh3_128()
    for part in parts:
        for pair in part:
            for t in pair:
                h.update(t.encode("utf-8", "replace") + b"\0")
        h.update(b"\1")
    return h.digest()


def trained(samples: list[tuple[str, str]]) -> Model:
    """The model of these samples, kept by the driver for the next query on the same ones."""
    key = digest(samples)
    if key not in _models:
        while len(_models) > 3:
            _models.pop(next(iter(_models)))
        _models[key] = train(samples)
    return _models[key]


def samples_of(samples: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of a table of labelled samples; of more than MAX_SAMPLES rows a sample by hash, rows without either are left out."""
    known = samples.where("lang is not null and text is not null").select("lang", "text")
    rows = known.orderBy(F.xxhash64("text"), "lang", "text").limit(MAX_SAMPLES).collect()
    return [(r.lang, r.text) for r in rows]


def model_of(samples: DataFrame) -> Model:
    """The model of a table of labelled samples."""
    return trained(samples_of(samples))


def sentences(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each sentence of the texts, and whether it is furniture (heading or table row).

    A sentence ends after a full stop before space and a capital, after a Chinese stop, at a blank
    line, and at the bounds of headings, table rows and list items.
    """
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    space = _SPACE[cp]
    nxt = np.where(space, n, np.arange(n))
    nxt = np.append(np.minimum.accumulate(nxt[::-1])[::-1], n)
    head = np.zeros(n + 1, bool)
    head[at] = True
    first = np.append(cp, 0)[nxt]  # the next sign that is no space
    stop = np.isin(cp, [ord(c) for c in ".!?…"])
    end = np.zeros(n, bool)
    i = np.flatnonzero(stop[:-1] & space[1:] & ~head[1:n])
    end[i] = _UPPER[first[i + 1]]
    close = np.flatnonzero(stop[:-2] & np.isin(cp[1:-1], [0x201D, 0x22, 0x29, 0xBB]) & space[2:]) if n > 2 else i[:0]
    end[close + 1] = _UPPER[first[close + 2]]
    end |= np.isin(cp, [ord(c) for c in "。！？"])
    lines = np.unique(np.concatenate([np.flatnonzero(cp == 10) + 1, at]))
    lines = lines[lines < n]
    k = first[lines]
    after = np.append(cp, 0)[np.minimum(nxt[lines] + 1, n)]
    title = (k == ord("#")) | (k == ord("|"))
    item = np.isin(k, [ord(c) for c in "-*•"]) & (after == 32)
    feeds = np.concatenate([[0], np.cumsum(cp == 10)])
    blank = feeds[np.minimum(nxt[lines], n)] > feeds[lines]
    cut = title | item | blank
    cut[1:] |= title[:-1] | blank[:-1]
    begin = np.zeros(n, bool)
    begin[at[at < n]] = True
    begin[np.flatnonzero(end[:-1]) + 1] = True
    begin[lines[cut]] = True
    start = np.flatnonzero(begin)
    line_of = np.searchsorted(lines, nxt[start] if len(start) else start, "right") - 1
    return start, title[np.maximum(line_of, 0)]


def chain(lp: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The cheapest languages of the sentences of one page, with a cost for each change."""
    n, k = lp.shape
    cost, back = -lp[0] * weight[0], np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(cost.argmin())
        move = cost[best] + SWITCH < cost
        back[i] = np.where(move, best, np.arange(k))
        cost = np.where(move, cost[best] + SWITCH, cost) - lp[i] * weight[i]
    out = np.empty(n, np.int64)
    out[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _quotes(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 where a quotation opens and -1 where it closes, in the signs of the six languages: “ ”, « », „ “ and 「 」."""
    out = np.isin(cp, (0x201C, 0xAB, 0x300C)).astype(np.int8) - np.isin(cp, (0x201D, 0xBB, 0x300D))
    low = np.flatnonzero(cp == 0x201E)
    if len(low):
        # What opens below closes with the next sign above of the same text, whichever way it turns.
        close = np.flatnonzero((cp == 0x201C) | (cp == 0x201D))
        k = np.searchsorted(close, low)
        end = at[np.searchsorted(at, low, "right")]
        ok = k < len(close)
        ok[ok] = close[k[ok]] < end[ok]
        out[low[ok]] = 1
        out[close[k[ok]]] = -1
    return out


SEGMENTS = "seg int, start int, `end` int, lang string, confidence double"


def segment_batch(model: Model, cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Rows (row, seg, start, end, lang, confidence): seg 0 for each text with letters, 1.. for segments of mixed ones."""
    k = len(model.langs)
    start, title = sentences(cp, at)
    row = np.searchsorted(at, start, "right") - 1
    ts, te, th = tokens(cp, start)
    if len(ts) == 0:
        return np.zeros(0, np.int64), []
    _, index, inverse = np.unique(th, return_index=True, return_inverse=True)
    per_word = model.words(cp, ts[index], te[index])
    sent = np.searchsorted(start, ts, "right") - 1
    # Quoted words, foreign names and titles, don't speak for the sentence around them.
    quote = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(_quotes(cp, at), out=quote[1:])
    base = quote[start][sent]
    quoted = quote[ts] > base
    share = np.bincount(sent, quoted * (te - ts), len(start)) / np.maximum(np.bincount(sent, te - ts, len(start)), 1)
    use = ~quoted | (share[sent] > 0.8)
    sums = np.stack([np.bincount(sent[use], per_word[inverse[use], j], len(start)) for j in range(k + 1)], 1)
    words = np.bincount(sent, minlength=len(start))
    letters = np.bincount(sent, te - ts, len(start))
    han = np.bincount(sent[_HAN[cp[ts]]], (te - ts)[_HAN[cp[ts]]], len(start))
    lp = model.log_probs(sums)
    conf = np.exp(lp.max(1))
    best = lp.argmax(1)
    solid = ~title & ((words >= WHOLE_WORDS) | (han >= WHOLE_HAN)) & (sums[:, k] > 0)
    sure = solid & (conf >= model.reject)
    out, rows = [], []
    has = letters > 0
    edges = np.searchsorted(row, np.arange(len(at)))
    low, high = np.full(len(at) - 1, k), np.full(len(at) - 1, -1)
    np.minimum.at(low, row[sure], best[sure])
    np.maximum.at(high, row[sure], best[sure])
    weight = np.where(sure, 1.0, np.where(solid, 0.5, np.where(title, 0.1, 0.25))) * has
    for r in range(len(at) - 1):
        a, b = int(edges[r]), int(edges[r + 1])
        if a == b or not has[a:b].any():
            continue
        n_letters = letters[a:b]
        if low[r] >= high[r]:
            # One language at most is sure: the whole text is of one language.
            lang = int(low[r]) if high[r] >= 0 else int((lp[a:b] * (weight[a:b] * np.sqrt(n_letters))[:, None]).sum(0).argmax())
            w = n_letters * weight[a:b]
            rows.append(r)
            out.append((0, 0, int(at[r + 1] - at[r]), model.langs[lang], float((np.exp(lp[a:b, lang]) * w).sum() / w.sum())))
            continue
        path = chain(lp[a:b], weight[a:b])
        # A language stays only where a whole sentence is surely of it.
        for lang in set(path.tolist()):
            if not (sure[a:b] & (path == lang) & (best[a:b] == lang)).any():
                path[path == lang] = -1
        if (path < 0).any():
            ok = np.flatnonzero(path >= 0)
            path = path[ok[np.abs(np.arange(b - a)[:, None] - ok).argmin(1)]]
        # Furniture goes with what follows it, at the end of a page with what comes before.
        free = ~has[a:b] | (title[a:b] & (weight[a:b] < 1))
        for i in range(b - a - 2, -1, -1):
            if free[i] and not free[i + 1 :].all():
                path[i] = path[i + 1]
        for i in range(1, b - a):
            if free[i:].all():
                path[i] = path[i - 1]
        prob = np.exp(lp[a:b][np.arange(b - a), path])
        size = np.bincount(path, n_letters, k)
        main = int(size.argmax())
        of_main = path == main
        w = n_letters * weight[a:b]
        rows.append(r)
        out.append((0, 0, int(at[r + 1] - at[r]), model.langs[main], float((prob * w)[of_main].sum() / max(w[of_main].sum(), 1e-9))))
        cuts = np.flatnonzero(np.diff(path)) + 1
        if len(cuts):
            for s, (i, j) in enumerate(zip([0, *cuts], [*cuts, b - a], strict=True), 1):
                begin = int(start[a + i] - at[r]) if i else 0
                end = int(start[a + j] - at[r]) if j < b - a else int(at[r + 1] - at[r])
                wi = w[i:j]
                rows.append(r)
                out.append((s, begin, end, model.langs[int(path[i])], float((prob[i:j] * wi).sum() / max(wi.sum(), 1e-9))))
    return np.array(rows, np.int64), out


def segments(pages: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The language of each text and of the segments of mixed ones.

    Columns: those of `pages` but `text`, and seg, start, end (in characters), lang and confidence
    (0 to 1). seg 0 is the whole text with the language of most of it; texts with whole sentences in
    several languages also have rows for seg 1, 2, ..., the longest runs of sentences in one. Null,
    empty and letterless texts have no row; repeated rows come out each. Columns named like new
    ones are replaced. Nothing is shuffled; the model, of fixed size, goes along with the tasks.
    """
    new = ["seg", "start", "end", "lang", "confidence"]
    rest = [c for c in pages.columns if c not in (*new, text)]
    df = pages.select(*rest, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + [SEGMENTS])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                rows, out = segment_batch(shared.value, *to_codepoints(batch.column(batch.num_columns - 1)))
                if not out:
                    continue
                kept = batch.select(rest).take(pa.array(rows))
                made = [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*rest, *new])

    return df.mapInArrow(run, schema)


def label_code(label: str):
    """Column: the code that a label names (its case, region and spelling aside), null where it names none of the six."""
    base = F.regexp_extract(F.lower(F.trim(F.col(label))), r"^([^\s_\-]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LABELS.items():
        out = F.when(base.isin(names), F.lit(code)).otherwise(out)
    return out


def found(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """row_id, seg, lang: seg 0 where the label is missing or wrong, seg 1.. of mixed pages; texts of at least 20 characters after trimming."""
    long = pages.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= 20).select("row_id", label_code("lang").alias("label"), "text")
    got = segments(long, model_of(samples))
    return got.where("seg > 0 or label is null or label <> lang").select("row_id", "seg", "lang")
