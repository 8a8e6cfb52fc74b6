"""Problem 3: broken pairs of a prompt and its answer.

Pairs are read off the threads without sorting a thread in one task: rows are dealt into buckets of
seq, each bucket finds its own last prompts, and only the buckets' summaries are ordered by path. A
multi-label linear classifier on hashed n-grams and pair features then names the defect. It is
trained on a bounded sample of the pairs at hand, taken as sound but for those it comes to distrust,
and on answers made broken from them: cut off, copied from the prompt, swapped with one in another
language, or replaced by a refusal. Thresholds are calibrated on made pairs held out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import language
from leafmill.llm.codepoints import to_codepoints
from leafmill.plans import cut

#: Sound pairs that training takes at most.
TRAIN_PAIRS = 1200
HASH = 1 << 15
#: Distinct n-grams from which on each keeps its weight.
FULL = 60
SEQ_BUCKET = 1024
SEED = 3
LABELS = ("truncated", "refusal", "copy", "language")

#: Names of the languages in each of them, as used to ask for an answer.
NAMES = {
    "en": ["english", "englisch", "anglais", "inglés", "ingles", "inglese", "英语", "英文"],
    "de": ["german", "deutsch", "allemand", "alemán", "aleman", "tedesco", "德语", "德文"],
    "fr": ["french", "französisch", "français", "francés", "frances", "francese", "法语", "法文"],
    "es": ["spanish", "spanisch", "espagnol", "español", "espanol", "castellano", "spagnolo", "西班牙语", "西班牙文"],
    "it": ["italian", "italienisch", "italien", "italiano", "意大利语", "意大利文"],
    "zh": ["chinese", "chinesisch", "chinois", "chino", "cinese", "中文", "汉语"],
}

#: Synthetic refusals, in parts: an opening, the refusal, a reason or an offer.
REFUSALS = {
    "en": (
        ["I'm sorry, but ", "Sorry, ", "I apologise, but ", "Unfortunately ", "Thank you for asking. However, ", "As an assistant, ", ""],
        ["I cannot help with that.", "I can't answer questions about this file.", "I am unable to assist with this request.", "I must decline to comment on this document.", "I am not allowed to discuss this file.", "answering this would go beyond what I may do.", "I won't be able to do that.", "I'd rather not answer this question.", "I'd rather not talk about this subject."],
        ["", " My guidelines do not allow it.", " That is against my rules.", " Is there something else I can do for you?", " Please ask something else."],
    ),
    "de": (
        ["Es tut mir leid, aber ", "Entschuldigung: ", "Leider ", "Danke für die Frage. Allerdings ", "Als Assistent ", ""],
        ["kann ich dabei nicht helfen.", "ich kann dazu nichts sagen.", "darf ich zu dieser Datei keine Auskunft geben.", "muss ich es ablehnen, dieses Dokument zu kommentieren.", "bin ich nicht in der Lage, Fragen zu dieser Datei zu beantworten.", "diese Anfrage möchte ich nicht beantworten.", "möchte ich über dieses Thema nicht sprechen.", "das geht über das hinaus, was ich tun darf."],
        ["", " Meine Vorgaben lassen das nicht zu.", " Das verstößt gegen meine Regeln.", " Kann ich sonst etwas für Sie lesen?"],
    ),
    "fr": (
        ["Je suis désolé, mais ", "Désolé, ", "Malheureusement, ", "Merci pour la question. Cependant, ", "En tant qu'assistant, ", ""],
        ["je ne peux pas vous aider sur ce point.", "je ne peux pas répondre à cette question.", "je ne suis pas autorisé à parler de ce fichier.", "je dois refuser de commenter ce document.", "je ne suis pas en mesure de répondre à cette demande.", "je préfère ne pas parler de ce sujet.", "répondre irait au-delà de ce que j'ai le droit de faire."],
        ["", " Mes consignes ne le permettent pas.", " Cela est contraire à mes règles.", " Puis-je faire autre chose pour vous ?"],
    ),
    "es": (
        ["Lo siento, pero ", "Lo lamento, ", "Por desgracia, ", "Gracias por la pregunta. Sin embargo, ", "Como asistente, ", ""],
        ["no puedo ayudar con eso.", "no puedo responder a preguntas sobre este archivo.", "no se me permite hablar de este archivo.", "debo negarme a comentar este documento.", "no estoy en condiciones de atender esta petición.", "prefiero no hablar de este tema.", "responder a esto iría más allá de lo que puedo hacer."],
        ["", " Mis normas no lo permiten.", " Eso va contra mis reglas.", " ¿Puedo hacer otra cosa por usted?"],
    ),
    "it": (
        ["Mi dispiace, ma ", "Spiacente, ", "Purtroppo ", "Grazie per la domanda. Tuttavia ", "In quanto assistente ", ""],
        ["non posso aiutare su questo punto.", "non posso rispondere a domande su questo file.", "non mi è permesso parlare di questo file.", "devo rifiutarmi di commentare il documento.", "non sono in grado di rispondere a questa richiesta.", "preferisco non parlare di questo argomento.", "rispondere andrebbe oltre ciò che mi è consentito."],
        ["", " Le mie regole non lo consentono.", " Ciò è contrario alle mie regole.", " Posso fare altro per lei?"],
    ),
    "zh": (
        ["抱歉，", "很抱歉，", "对不起，", "谢谢您的提问。不过，", "作为助手，", ""],
        ["我无法帮助您。", "我不能回答关于这份文件的问题。", "我不被允许谈论这份文件。", "我必须拒绝评论这份文件。", "我无法处理这个请求。", "我不想谈论这个话题。", "回答这个问题超出了我的权限。"],
        ["", "我的规定不允许这样做。", "这违反了我的准则。", "您还想读些别的吗？"],
    ),
}

#: Synthetic answers that say the file has nothing on the question: sound ones.
ABSENT = {
    "en": ["The document does not mention this.", "I could not find it on the pages read; page {n} could not be opened.", "There is nothing about it in the file; the supplier refused to deliver page {n}."],
    "de": ["Das Dokument erwähnt das nicht.", "Auf den gelesenen Seiten steht nichts dazu; Seite {n} konnte nicht geöffnet werden.", "Dazu steht nichts in der Datei; der Lieferant lehnte es ab, Seite {n} zu liefern."],
    "fr": ["Le document n'en parle pas.", "Rien à ce sujet dans les pages lues ; la page {n} n'a pas pu être ouverte.", "Le fichier n'en dit rien ; le fournisseur a refusé de livrer la page {n}."],
    "es": ["El documento no lo menciona.", "No hay nada al respecto en las páginas leídas; no se pudo abrir la página {n}.", "El archivo no dice nada; el proveedor se negó a entregar la página {n}."],
    "it": ["Il documento non ne parla.", "Non c'è nulla al riguardo nelle pagine lette; la pagina {n} non si è potuta aprire.", "Il file non ne dice nulla; il fornitore ha rifiutato di consegnare la pagina {n}."],
    "zh": ["文件没有提到这一点。", "已读的页面没有相关内容；第{n}页无法打开。", "文件里没有相关内容；供应商拒绝提供第{n}页。"],
}
ASKS = {"en": " Please answer in {}.", "de": " Bitte auf {} antworten.", "fr": " Répondez en {}, s'il vous plaît.", "es": " Responde en {}, por favor.", "it": " Rispondi in {}, per favore.", "zh": "请用{}回答。"}
ECHOES = ["You asked: ", "Your question: ", "Question: ", "Sie fragen: ", "Ihre Frage: ", "Frage: ", "Vous demandez : ", "Votre question : ", "Su pregunta: ", "Usted pregunta: ", "La sua domanda: ", "Lei chiede: ", "您问：", "您的问题：", "**", "> ", "# "]

_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」|\"[^\"\n]*\"|(?m:^>.*$)")
_WORDS = re.compile(r"[㐀-鿿]|[^\W\d_]+|\d+")
_DIGITS = re.compile(r"\d+")
_BRACKETS = re.compile(r"[()（）]")
_CLOSERS = "*_`\"'”’»)]}）】」』 \n\t~​‌‍⁠﻿"
_ENDS = ".!?。！？…"
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)]|#{1,6}|\|)\s?")


def pairs(messages: DataFrame) -> DataFrame:
    """path, prompt_id, prompt and answer of each user message with the assistant messages up to the next one.

    Visible text is that of parts of type `text`, joined by line feeds; repeated rows count once, null
    parts count as empty, messages of other roles stand between without ending a pair. A pair
    without assistant message has an empty answer. Rows of null path or seq are left out.
    """
    text = F.concat_ws("\n", F.transform(F.filter("parts", lambda p: (p.type == "text") & (p.text != "")), lambda p: p.text))
    rows = (
        messages.where("path is not null and seq is not null and role in ('user', 'assistant')")
        .select("path", F.col("seq").cast("long").alias("seq"), "id", "role", text.alias("text"))
        .dropDuplicates(["path", "seq", "id", "role"])
        .withColumn("bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    )
    prompt = F.when(F.col("role") == "user", F.col("seq"))
    # Before the first prompt of its bucket a row belongs to the last prompt of earlier buckets.
    every = rows.groupBy("path", "bucket").agg(F.max(prompt).alias("top"))
    before = F.last("top", True).over(Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select("path", "bucket", before.alias("carried"))
    own = F.max(prompt).over(Window.partitionBy("path", "bucket").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0))
    keyed = rows.withColumn("own", own).join(carried, ["path", "bucket"], "left").withColumn("turn", F.coalesce("own", "carried")).where("turn is not null")
    answer = F.array_sort(F.collect_list(F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.struct("seq", "id", "text"))))
    asked = F.min(F.when(F.col("role") == "user", F.struct("id", "text")))
    return keyed.groupBy("path", "turn").agg(asked.alias("asked"), answer.alias("said")).select("path", F.col("asked.id").alias("prompt_id"), F.col("asked.text").alias("prompt"), F.concat_ws("\n", "said.text").alias("answer"))


def _lang(model: language.Model, texts: list[str]) -> np.ndarray:
    """Log-probabilities of the languages of whole texts; a flat row for texts without letters."""
    cp, at = to_codepoints(pa.array(texts, pa.string()))
    ts, te, th = language.tokens(cp, at[:-1])
    k = len(model.langs)
    sums = np.zeros((len(texts), k + 1))
    if len(ts):
        # Words are scored once each, however often they return.
        _, index, inverse = np.unique(th, return_index=True, return_inverse=True)
        per_word, row = model.words(cp, ts[index], te[index]), np.searchsorted(at, ts, "right") - 1
        sums = np.stack([np.bincount(row, per_word[inverse, j], len(texts)) for j in range(k + 1)], 1)
    return model.log_probs(sums)


_hashes: dict[str, int] = {}


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts on end, and the offsets of the texts; numbers keep their own hashes."""
    if len(_hashes) > 1 << 20:
        _hashes.clear()
    flat, at, have = [], [0], _hashes.get
    for t in texts:
        words = _WORDS.findall(t.lower())
        hashes = list(map(have, words))
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = _hashes[words[i]] = xxhash.xxh64_intdigest(words[i].encode("utf-8", "replace"))
        flat += hashes
        at.append(len(flat))
    return np.array(flat, np.uint64), np.array(at, np.int64)


_NUMBER = np.uint64(xxhash.xxh64_intdigest(b"0"))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mix(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, in which their order counts."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p) * _MIX[0]
        out ^= out >> np.uint64(29)
    return out * _MIX[1]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % HASH


def _open(a: str) -> bool:
    """Whether a bracket is left open; closing ones that nothing opened, as in `1)`, close nothing."""
    depth = 0
    for c in _BRACKETS.findall(a):
        depth = depth + 1 if c in "(（" else max(0, depth - 1)
    return depth > 0


def _dense(q: str, a: str, lq: np.ndarray, la: np.ndarray, langs: list[str], n_grams: int, fresh: int, cover: float, n_words: int) -> list[float]:
    body = a.rstrip(_CLOSERS)
    tail = a.rstrip(" \n\t​‌‍⁠﻿")
    last = body[-1:] or " "
    line = tail.rsplit("\n", 1)[-1]
    item = bool(_ITEM.match(line))
    ended = last in _ENDS
    opened = _open(tail)
    quoted = tail.count("“") > tail.count("”")
    bold = tail.count("**") % 2 == 1
    fence = a.count("```") % 2 == 1
    closed = tail[-1:] in ")）]”»\"*|`"
    known = 1 - fresh / max(1, n_grams)
    i, j = int(lq.argmax()), int(la.argmax())
    low = q.lower()
    asked = any(n in low for n in NAMES.get(langs[j], ()))
    differ = float(i != j)
    sure = float(np.exp(la[j]) - np.exp(la[i]))
    return [
        1.0, float(ended and not opened and not quoted and not bold), float(item), float(item and closed), float(item and not closed and not ended),
        float(opened), float(quoted), float(bold), float(not ended and not item), float(last in ",;:，；：、-–—(（"), float(last.isdigit()), float(last.isalpha() and not item),
        min(len(a), 400) / 400, float(n_grams < 12), known, cover, float(known > 0.75 and cover > 0.75), float(fresh > 6), min(fresh, 12) / 12, float(known > 0.9),
        differ * sure * (not asked), differ * asked, float(differ and sure > 0.6 and not asked), float(asked), float(n_words > 8) * differ * (not asked), float(fence),
    ]


DENSE = 26


def _grams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the pairs of neighbouring words of each text; of a text of one word, that word."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[1:] == row[:-1]
    alone = np.diff(at) == 1
    rows = np.concatenate([row[:-1][inside], np.flatnonzero(alone)])
    grams = np.concatenate([_mix(h[:-1], h[1:])[inside] if len(h) else h, _mix(h[at[:-1][alone]])])
    return rows, grams


def _overlap(q: tuple[np.ndarray, np.ndarray], a: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: word pairs of the answer, those of them that the prompt doesn't have, and the share of the prompt's that the answer has."""
    n = len(q[1]) - 1
    qr, qg = _grams(*q)
    some = np.flatnonzero(np.diff(q[1]) > 1)  # the first word stands for itself, too
    qr, qg = np.concatenate([qr, some]), np.concatenate([qg, _mix(q[0][q[1][:-1][some]])])
    ar, ag = _grams(*a)
    in_row = lambda r, g: _mix(r.astype(np.uint64), g)
    asked, index = np.unique(in_row(qr, qg), return_index=True)
    said = in_row(ar, ag)
    fresh = np.bincount(ar, ~np.isin(said, asked), n).astype(np.int64)
    both = np.bincount(qr[index], np.isin(asked, said), n)
    return np.bincount(ar, minlength=n), fresh, both / np.maximum(1, np.bincount(qr[index], minlength=n))


LAST_WORDS = 24


def _sparse(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words of each answer, and again, under a tag, those of its last words: there the place matters. Distinct ones by row, with the offsets of the rows."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    place = np.arange(len(h))
    tail = place >= at[1:][row] - LAST_WORDS
    keys = []
    for size in (1, 2, 3):
        if len(h) < size:
            break
        ok = row[size - 1 :] == row[: len(row) - size + 1]
        g = _mix(*[h[i : len(h) - size + 1 + i] for i in range(size)])[ok]
        r, t = row[: len(row) - size + 1][ok], tail[: len(row) - size + 1][ok]
        keys += [r * HASH + _bucket(g), r[t] * HASH + _bucket(g[t] * _MIX[2] ^ _MIX[3])]
    key = np.sort(np.concatenate([*keys, np.zeros(0, np.int64)]))
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    return key % HASH, np.searchsorted(key, np.arange(n + 1) * HASH)


@dataclass
class Matrix:
    """Dense pair features, and the hashed n-grams of each row, all of one weight."""

    dense: np.ndarray
    grams: np.ndarray
    edge: np.ndarray

    def _weight(self) -> np.ndarray:
        """The weight of a row's n-grams; it falls no further past FULL of them, so that a phrase counts in long answers too."""
        return 1 / np.sqrt(np.clip(np.diff(self.edge), 1, FULL))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        weight = self._weight()
        total = np.concatenate([np.zeros((1, w.shape[1]), np.float32), np.cumsum(w[DENSE + self.grams], 0, dtype=np.float64)])
        return self.dense @ w[:DENSE] + (total[self.edge[1:]] - total[self.edge[:-1]]) * weight[:, None]

    def gradient(self, error: np.ndarray) -> np.ndarray:
        """The product of the transposed matrix with `error`."""
        size = np.diff(self.edge)
        spread = error * self._weight()[:, None]
        out = np.empty((DENSE + HASH, error.shape[1]))
        out[:DENSE] = self.dense.T @ error
        for k in range(error.shape[1]):
            out[DENSE:, k] = np.bincount(self.grams, np.repeat(spread[:, k], size), HASH)
        return out

    def rows(self, which: np.ndarray) -> Matrix:
        at = np.flatnonzero(which)
        size = np.diff(self.edge)
        keep = np.repeat(which, size)
        return Matrix(self.dense[at], self.grams[keep], np.concatenate([[0], np.cumsum(size[at])]))


def features(rows: list[tuple[str, str]], lang: language.Model) -> Matrix:
    """The feature matrix of pairs (prompt, answer)."""
    lq = _lang(lang, [q for q, _ in rows])
    bare = [_QUOTED.sub(" ", a) for _, a in rows]
    la = _lang(lang, [b if len(b) == len(a) or len(_WORDS.findall(b)) > 2 else a for b, (_, a) in zip(bare, rows, strict=True)])
    q, a = _words([q for q, _ in rows]), _words([a for _, a in rows])
    n_words = np.diff(a[1])
    numbers = [int(w) for w in _hashes_of_numbers(rows)]
    grams, fresh, cover = _overlap(q, a)
    dense = np.array([_dense(*rows[i], lq[i], la[i], lang.langs, int(grams[i]), int(fresh[i]), float(cover[i]), int(n_words[i])) for i in range(len(rows))]).reshape(-1, DENSE)
    flat = np.where(np.isin(a[0], np.array(numbers, np.uint64)), _NUMBER, a[0])
    return Matrix(dense, *_sparse(flat, a[1]))


def _hashes_of_numbers(rows: list[tuple[str, str]]) -> set[int]:
    return {_hashes[w] for _, a in rows for w in _DIGITS.findall(a)}


@dataclass
class Classifier:
    weights: np.ndarray
    thresholds: np.ndarray
    lang: language.Model

    def probabilities(self, rows: list[tuple[str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(features(rows, self.lang) @ self.weights)))

    def name(self, rows: list[tuple[str, str]]) -> list[str | None]:
        """The defect of each pair, None for a sound one."""
        out: list[str | None] = [None if a.strip(_CLOSERS) else "empty" for _, a in rows]
        some = [i for i, x in enumerate(out) if x is None]
        if some:
            p = self.probabilities([rows[i] for i in some])
            margin = np.log(np.maximum(p, 1e-9)) - np.log(self.thresholds)
            for i, m in zip(some, margin, strict=True):
                if m.max() >= 0:
                    out[i] = LABELS[int(m.argmax())]
        return out


def _fit(x: Matrix, y: np.ndarray, epochs: int = 14, parts: int = 10, seed: int = SEED) -> np.ndarray:
    """Weights of independent logistic regressions, by Adam on parts of the matrix drawn once."""
    w = np.zeros((DENSE + HASH, y.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    decay = np.full((DENSE + HASH, 1), 1e-4)
    decay[:DENSE] = 2e-5
    part = np.random.default_rng(seed).permutation(len(y)) % parts
    batches = [(x.rows(part == k), y[part == k]) for k in range(parts)]
    for t in range(1, epochs * parts + 1):
        bx, by = batches[t % parts]
        if len(by) == 0:
            continue
        p = 1 / (1 + np.exp(-np.clip(bx @ w, -40, 40)))
        g = bx.gradient(p - by) / len(by) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.12 * (1 - 0.8 * t / (epochs * parts)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def make(rows: list[tuple[str, str]], langs: list[str], codes: list[str], rng: np.random.Generator) -> list[tuple[str, str, int]]:
    """Pairs with labels (-1 sound) made of sound pairs; `langs` are those of their answers."""
    out = []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    by = {c: [i for i, x in enumerate(langs) if x == c] for c in codes}
    for i, (q, a) in enumerate(rows):
        lang = langs[i]
        places = [k for k in range(max(3, len(a) // 6), len(a) - 1) if a[k - 1] not in _ENDS + _CLOSERS + "|-#" and (a[k - 1].isalnum() or a[k - 1] in ",(（，:")]
        for _ in range(2):
            if places:
                out.append((q, a[: pick(places)], 0))
        if rng.random() < 0.25 and (cut := [m.end() for m in re.finditer(r"\s[（(](?:p\.|S\.|pag\.|pág\.|see|siehe|voir|vedi|第)?", a)]):
            out.append((q, a[: pick(cut)].rstrip(), 0))
        form = int(rng.integers(6))
        bare = q.rstrip("?？.。! ")
        out.append((q, [q, bare, f"{q}\n\n{q}", pick(ECHOES) + q, f"{bare}.", f"{pick(ECHOES)}{bare}"][form], 2))
        out.append((q, pick([f"{bare}: {a}", f"{q} {a}", f"{pick(ECHOES)}{q}\n\n{a}"]), -1))
        other = [c for c in codes if c != lang and by[c]]
        if other:
            c = pick(other)
            b = rows[pick(by[c])][1]
            out.append((q, b, 3))
            names = NAMES.get(c, [c])
            out.append((q + ASKS.get(lang, ASKS["en"]).format(pick(names)), b, -1))
            if rng.random() < 0.5:
                out.append((q, f"{a} “{b[:160]}”.", -1))
        if lang in REFUSALS:
            out.append((q, "".join(pick(p) for p in REFUSALS[lang]), 1))
            out.append((q, "".join(pick(p) for p in REFUSALS[lang]), 1))
            out.append((q, pick(ABSENT[lang]).format(n=int(rng.integers(1, 400))) + (" " + a if rng.random() < 0.4 else ""), -1))
    return out


def make_long(rows: list[tuple[str, str]], langs: list[str], rng: np.random.Generator) -> list[tuple[str, str, int]]:
    """Refusals that talk round the subject at any length before and after they refuse, and sound answers as long."""
    out = []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    # Answers of whole sentences: an open end in the middle of a made answer would teach that open ends are sound.
    whole = [a.rstrip()[-1:] in _ENDS and "```" not in a for _, a in rows]
    for i, (q, a) in enumerate(rows):
        if (lang := langs[i]) in REFUSALS and whole[i]:
            same = [rows[int(k)][1] for k in rng.integers(len(rows), size=8) if langs[k] == lang and whole[k]]
            round_ = [" ".join([pick(ECHOES) + q, *same[: len(same) // 2]]), " ".join(same[len(same) // 2 :] or [q])]
            out.append((q, f"{round_[0]} {''.join(pick(p) for p in REFUSALS[lang])} {round_[1]}", 1))
            out.append((q, f"{round_[0]} {a} {round_[1]}", -1))
    return out


def adapted(samples: list[tuple[str, str]], sample: list[tuple[str, str]]) -> language.Model:
    """A language model that also knows prompts and short answers: trained again on `samples` and on short texts of the pairs, under the language of the prompt."""
    first = language.trained(samples)
    short = [(q, a) for q, a in sample if q and a and len(a) < 80]
    if not short:
        return first
    lq = _lang(first, [q for q, _ in short])
    more = [(first.langs[int(p.argmax())], t) for p, (q, a) in zip(lq, short, strict=True) if np.exp(p.max()) > 0.9 for t in {q, a}]
    return language.trained(samples + more)


def train(sample: list[tuple[str, str]], lang: language.Model, seed: int = SEED) -> Classifier:
    """The classifier of a sample of pairs, mostly sound. Without usable pairs every threshold is out of reach, and only empty answers are named."""
    rng = np.random.default_rng(seed)
    rows = [(q, a) for q, a in sample if q and a and a.strip(_CLOSERS)]
    if len(rows) < 20:
        return Classifier(np.zeros((DENSE + HASH, len(LABELS))), np.full(len(LABELS), 2.0), lang)
    sound = np.ones(len(rows), bool)
    weights = thresholds = None
    for _ in range(2):
        kept = [r for r, ok in zip(rows, sound, strict=True) if ok]
        codes = [lang.langs[i] for i in _lang(lang, [_QUOTED.sub(" ", a) for _, a in kept]).argmax(1)]
        made = [(q, a, -1) for q, a in kept] + make(kept, codes, lang.langs, rng) + make_long(kept, codes, np.random.default_rng(seed + 1))
        y = np.zeros((len(made), len(LABELS)), np.float32)
        for i, (_, _, k) in enumerate(made):
            if k >= 0:
                y[i, k] = 1
        x = features([(q, a) for q, a, _ in made], lang)
        held = rng.random(len(made)) < 0.2
        weights = _fit(x.rows(~held), y[~held])
        p = 1 / (1 + np.exp(-(x.rows(held) @ weights)))
        thresholds = np.array([_threshold(p[:, k], y[held][:, k]) for k in range(len(LABELS))])
        now = Classifier(weights, thresholds, lang)
        sound = np.array([d is None for d in now.name(rows)])
        if sound.sum() < 20:
            break
    return Classifier(weights, thresholds, lang)


_models: dict[bytes, Classifier] = {}


def _trained(sample: list[tuple[str, str]], samples: list[tuple[str, str]]) -> Classifier:
    """The classifier of these inputs, kept by the driver for the next query on the same ones."""
    key = language.digest(sample, samples)
    if key not in _models:
        while len(_models) > 3:
            _models.pop(next(iter(_models)))
        _models[key] = train(sample, adapted(samples, sample))
    return _models[key]


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on F1 is best on held-out pairs, in the middle of the gap to the next one."""
    order = np.argsort(-p)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.2, 0.9))


def flag(messages: DataFrame, samples: DataFrame) -> DataFrame:
    """Every pair with its defect: path, prompt_id, defect (null for a sound pair)."""
    built = cut(pairs(messages))
    every = max(1, math.ceil(built.count() / TRAIN_PAIRS))
    # A sample by hash, about TRAIN_PAIRS rows at most; those over are cut by hash as well.
    drawn = built.where(F.pmod(F.xxhash64("path", "prompt_id"), F.lit(every)) == 0).orderBy(F.xxhash64("prompt_id", "path"), "prompt_id", "path").limit(TRAIN_PAIRS)
    taken = sorted((r.prompt or "", r.answer or "") for r in drawn.collect())
    shared = messages.sparkSession.sparkContext.broadcast(_trained(taken, language.samples_of(samples)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                rows = [(q or "", a or "") for q, a in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.name(rows), pa.string())], ["path", "prompt_id", "defect"])

    return built.select("path", "prompt_id", "prompt", "answer").mapInArrow(run, "path string, prompt_id string, defect string")


def found(messages: DataFrame, samples: DataFrame) -> DataFrame:
    """prompt_id and defect of each defective pair."""
    return flag(messages, samples).where("defect is not null").select("prompt_id", "defect")
