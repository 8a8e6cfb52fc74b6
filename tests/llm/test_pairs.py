import numpy as np
import pandas as pd
import pytest

from leafmill.llm import language
from leafmill.llm import pairs as P

PART = "array<struct<type: string, text: string, tool_name: string, tool_call_id: string, state: string, input: string, output: string>>"
SCHEMA = f"path string, seq int, id string, role string, parts {PART}, own int"


def msg(path, seq, role, *texts, id=None):
    return (path, seq, id or f"{path}{seq}", role, None if texts == (None,) else [("text", t, *[None] * 5) for t in texts], 1)


def test_pairs(spark, monkeypatch):
    rows = [
        msg("a", 0, "assistant", "before any prompt"),
        msg("a", 1, "user", "q1"), msg("a", 2, "assistant", "x", "y"), msg("a", 3, "system", "s"), msg("a", 4, "assistant", "z"),
        msg("a", 5, "user", "q5"), msg("a", 6, "user", "q6"), msg("a", 7, "assistant", None), msg("a", 40, "assistant", "late"),
        msg("b", 9, "user", None), msg("b", 9, "user", None), msg("b", 10, "assistant", "b"), msg("b", 10, "assistant", "b"),
        (None, 1, "n", "user", None, 1), ("c", None, "n", "user", None, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {("a1", "q1", "x\ny\nz"), ("a5", "q5", ""), ("a6", "q6", "late"), ("b9", "", "b")}
    for bucket in (1024, 3):
        monkeypatch.setattr(P, "SEQ_BUCKET", bucket)
        assert {(r.prompt_id, r.prompt, r.answer) for r in P.pairs(df).collect()} == want
        assert P.pairs(df).count() == 4
    samples = spark.createDataFrame([("en", "some text here"), ("de", "ein Text hier")], "lang string, text string")
    assert {tuple(r) for r in P.found(df, samples).collect()} == {("a5", "empty")}
    assert P.found(df.limit(0), samples).count() == 0


@pytest.fixture(scope="module")
def clean():
    s = pd.read_parquet("/root/testdata/sf0.01/lang_samples.parquet")
    rng = np.random.default_rng(0)
    asks = {"en": "What does the file say about {}?", "de": "Was sagt die Datei über {}?", "fr": "Que dit le fichier sur {} ?", "es": "¿Qué dice el archivo sobre {}?", "it": "Che cosa dice il file su {}?", "zh": "文件对{}是怎么说的？"}
    rows = []
    for lang, g in s.groupby("lang"):
        t = list(g.text)
        for i, x in enumerate(t):
            topic = x[10:30]
            rows.append((asks[lang].format(topic), " ".join([x, t[(i + 7) % len(t)]]) if rng.random() < 0.7 else x))
    return rows, list(zip(s.lang, s.text, strict=True))


def test_held_out(clean):
    rows, samples = clean
    rng = np.random.default_rng(1)
    order = rng.permutation(len(rows))
    fit, rest = [rows[i] for i in order[:250]], [rows[i] for i in order[250:]]
    lang = P.adapted(samples, fit)
    c = P.train(fit, lang)
    codes = [lang.langs[i] for i in P._lang(lang, [a for _, a in rest]).argmax(1)]
    made = P.make(rest, codes, lang.langs, np.random.default_rng(9)) + [(q, a, -1) for q, a in rest]
    got = c.name([(q, a) for q, a, _ in made])
    right = [(P.LABELS[k] if k >= 0 else None) == g for (_, _, k), g in zip(made, got, strict=True)]
    assert np.mean(right) > 0.93
    assert c.name([("q", ""), ("q", " \n​")]) == ["empty", "empty"]


def test_middle_of_long_answers(clean):
    """Every word of an answer counts, and a bracket opened anywhere."""
    head, end = " ".join(f"word{chr(97 + i % 26)} starts" for i in range(40)), " ".join(f"sign{chr(97 + i % 26)} ends" for i in range(40))
    grams, at = P._sparse(*P._words([f"{head} {end}", f"{head} I cannot help with that {end}", "", "I cannot help"]))
    plain, other, empty, short = (set(grams[a:b].tolist()) for a, b in zip(at, at[1:], strict=False))
    assert other - plain and not empty
    h, _ = P._words(["I cannot help"])
    assert {int(P._bucket(P._mix(*[h[k : k + 1] for k in part]))[0]) for part in ((1,), (0, 1), (0, 1, 2))} <= other & short
    assert P._open(f"see (section 3 {head}") and not P._open(f"1) see (section 3) {head}") and P._open("1) see (section 3")
    rows, samples = clean
    lang = P.language.train(samples)
    made = P.make_long(rows[:60], ["en"] * 60, np.random.default_rng(2))
    assert {k for *_, k in made} == {1, -1} and any(len(a.split()) > 60 for _, a, k in made if k == 1)
    assert P.features([("q", f"({head} {end}")], lang).dense[0, 5] == 1


def brute_overlap(q, a):
    qw, aw = P._WORDS.findall(q.lower()), P._WORDS.findall(a.lower())
    qs = set(zip(qw, qw[1:], strict=False)) | {(w,) for w in qw[:1]}
    both = list(zip(aw, aw[1:], strict=False)) or [(w,) for w in aw]
    return len(both), sum(g not in qs for g in both), len(qs & set(both)) / max(1, len(qs))


def test_overlap_is_that_of_single_pairs():
    rng = np.random.default_rng(0)
    word = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "12", "中"], int(rng.integers(0, n))))
    rows = [(word(6), word(9)) for _ in range(300)] + [("", ""), ("a", "a"), ("a b", "a"), ("a", "")]
    got = P._overlap(P._words([q for q, _ in rows]), P._words([a for _, a in rows]))
    for i, (q, a) in enumerate(rows):
        assert tuple(float(x[i]) for x in got) == tuple(map(float, brute_overlap(q, a))), (q, a)


#: Defects in other words than those the training pairs are made of.
REAL = [
    ("refusal", "What does page 3 say about the lease?", "I have to pass on this one, since discussing the contents of this file isn't something I am permitted to do."),
    ("refusal", "Was steht auf Seite 3 zur Miete?", "Darauf darf ich leider nicht eingehen; meine Richtlinien untersagen mir Auskünfte über diese Datei."),
    ("refusal", "Que dit la page 3 sur le bail ?", "Il m'est impossible de vous répondre : on ne m'autorise pas à parler de ce fichier."),
    ("truncated", "What does page 3 say about the lease?", "Page 3 says that the lease starts in March, that the deposit is due within two weeks and that the"),
    ("truncated", "Was steht auf Seite 3 zur Miete?", "Auf Seite 3 steht, dass die Miete im März beginnt und dass die Kaution innerhalb von"),
    ("copy", "What does page 3 say about the lease?", "You want to know: what does page 3 say about the lease"),
    ("language", "What does page 3 say about the lease?", "Auf Seite 3 steht, dass die Miete im März beginnt und die Kaution innerhalb von zwei Wochen fällig ist."),
    ("language", "Was steht auf Seite 3 zur Miete?", "La page 3 dit que le bail commence en mars et que la caution est due sous deux semaines."),
    (None, "What does page 3 say about the lease?", "Page 3 says that the lease starts in March and that the deposit is due within two weeks."),
    (None, "Was steht auf Seite 3 zur Miete?", "Die Miete beginnt im März; die Kaution ist innerhalb von zwei Wochen fällig."),
    (None, "Que dit la page 3 sur le bail ?", "Le bail commence en mars et la caution est due sous deux semaines."),
    (None, "What does page 3 say about the lease?", "The file does not say anything about a lease."),
]


def test_defects_from_elsewhere(clean):
    rows, samples = clean
    c = P.train(rows, P.adapted(samples, rows))
    got = c.name([(q, a) for _, q, a in REAL])
    assert sum(g == d for g, (d, *_) in zip(got, REAL, strict=True)) >= 10, list(zip(got, [d for d, *_ in REAL], strict=True))
