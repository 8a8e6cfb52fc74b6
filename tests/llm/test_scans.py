import itertools

import numpy as np
import pytest

from leafmill.llm import boosting
from leafmill.llm import scans as S


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    m = boosting.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_mistakes():
    assert S.mistakes("g1ass", "glass")[:2] == (1, 1)
    assert S.mistakes("recluces", "reduces")[0] == 1
    assert S.mistakes("glass", "grass") is None
    for a, b in (("g1ass", "glass"), ("recluces", "reduces"), ("furtber", "further"), ("nofice", "notice"), ("margm", "margin"), ("niveaii", "niveau"), ("vvater", "water"), ("fumace", "furnace"), ("pr6avis", "préavis"), ("geza'hlt", "gezählt"), ("iiber", "über"), ("dause", "clause")):
        assert S.skeleton(a) == S.skeleton(b) and S.mistakes(a, b)[0] == 1


def test_page_number():
    for line in ("- 167 -", "167", "— 167 —", "[167]", "Page 167", "167 / 180", "Seite 167", "第 167 页", "**167**", "１６７", "clxvii", "- CLXVII -"):
        assert S.page_number(line, 167) is False, line
    for line in ("- l67 -", "Pa9e 167", "16７ / I80"[1:] and "- I67 -"):
        assert S.page_number(line, 167) is True, line
    for line in ("168", "26.4", "word 167 word", "| 167 | 3 | 4 |", "", "167 kg"):
        assert S.page_number(line, 167) is None, line


LINES = ["The timber report reduces the long-term monitoring of the older furnace", "for every warehouse in the southern district, so that many days remain."]


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(1)
    words = "report furnace notice reduces glass storage margin further water section contract district monitoring warehouse remain because library catalogue harvest number".split()
    rows, n = [], 0
    for path in ("a", "b", "c"):
        for page in range(1, 41):
            body = "\n".join(" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(6))
            rows.append((n := n + 1, path, page, body))
    for page in range(1, 6):
        head = "NORTH HARBOUR BINDER" if page % 2 else "North Harb0ur Binder"
        rows.append((1000 + page, "s", page, f"{head}\nReport of the g1ass and the ware-\nhouse contract because.\nThe library catalogue notice.\n- {page} -"))
    rows += [(2000, "t", 1, None), (2001, "t", 2, ""), (2002, None, None, " \n"), (2003, "t", 4, "x")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "row_id long, path string, page int, text string, noise string")


def test_found(pages):
    got = {(r.row_id, r.noise) for r in S.found(pages).collect()}
    scans = {(1000 + p, k) for p in range(1, 6) for k in ("hyphen", "pagenum", "running")}
    assert scans <= got
    assert {x for x in got if x[0] < 1000} == set()
    assert {x for x in got if x[1] == "misread"} >= {(1000 + p, "misread") for p in range(1, 6)}
    assert not {x for x in got if x[0] >= 2000}
    assert S.found(pages.limit(0)).count() == 0


def test_repair(pages):
    out = {r.row_id: r.text for r in S.repair(pages.where("row_id < 2003")).collect()}
    assert out[1003] == "Report of the glass and the warehouse contract because.\nThe library catalogue notice."
    assert out[2000] is None and out[2001] == "" and out[2002] == ""


def test_repair_of_one_text():
    reader = S.Reader(set(), None)
    text = "Binder North\nThe g1ass in the ware-\nhouse and the long-\nterm view.\n\n- 7 -"
    assert reader.repaired(text, 7, {"g1ass": "glass"}, {"top:" + reader.running_key("Binder North", 7)}, {"ware\t-\thouse\t0"}) == "The glass in the warehouse and the long-term view."
    assert reader.repaired("O5LO", 1, {"o5lo": "oslo"}, set(), set()) == "OSLO"


def test_broken_words_are_judged_by_all_counts(spark):
    words = spark.createDataFrame([("warehouse", 3), ("long-term", 2), ("longterm", 2), ("ware", 9)], "word string, n long")
    broken = spark.createDataFrame([("ware\t-\thouse\t0",), ("long\t-\tterm\t0",), ("un\t¬\tknown\t0",)], "key string")
    assert {r.key for r in S.judge_broken(broken, words, None).collect()} == {"ware\t-\thouse\t0", "un\t¬\tknown\t0"}


def test_running_lines_of_any_length(spark):
    head = "Report on the storage of timber and glass in the northern district, second and enlarged edition with tables, figures and an index of all names and places"
    rows = [(i, "a", i, f"{head}\nThe first line of page {i} ends here.\nThe second line, too.") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "row_id long, path string, page int, text string")
    assert {(r.row_id, r.noise) for r in S.found(df).collect()} >= {(i, "running") for i in range(1, 6)}


def frequent_wins():
    """A ranker that takes every frequent candidate."""
    bins = [np.zeros(0)] * S.FEATURES
    bins[1] = np.array([3.0])
    return boosting.Boosted(bins, [(np.array([1]), np.array([0]), np.array([-9.0, 9.0]))], 0.0)


def fixes(spark, rows, words):
    df = spark.createDataFrame(rows, "word string, n long")
    return {r.word: r.fix for r in S.corrections(df, df, 3, S.Characters(words), frequent_wins()).collect()}


def test_candidates_come_by_grams(spark):
    """Mistakes of the table meet their words, and so do those outside it, of whatever sign."""
    right = ["furnace", "préavis", "gezählt", "clause", "margin", "niveau", "water", "notice", "seals", "calibration", "binder", "harbour", "depository", "contract", "warehouse"]
    wrong = ["fumace", "pr6avis", "geza'hlt", "dause", "margm", "niveaii", "vvater", "nofice", "sea1s", "ca1ibration", "8inder", "harbonr", "depositcry", "ccntract", "warehovse"]
    got = fixes(spark, [(w, 500) for w in right] + [(w, 1) for w in wrong], {w: 500 for w in right})
    assert {w: got.get(w) for w in wrong} == dict(zip(wrong, right, strict=True))


def test_every_single_mistake_is_retrieved(spark):
    """Any sign of a word made another, lost or doubled: the word is among the candidates, with 2,000 words around it."""
    rng = np.random.default_rng(3)
    signs = list("abcdefghijklmnopqrstuvwxyz")
    words = sorted({"".join(rng.choice(signs, int(rng.integers(4, 11)))) for _ in range(2000)})
    made = {}
    for w in words[::4]:
        i = int(rng.integers(len(w)))
        made[w[:i] + str(rng.choice(signs)) + w[i + 1 :]] = w
    made = {s: t for s, t in made.items() if s not in words}
    df = spark.createDataFrame([(w, 100) for w in words] + [(s, 1) for s in made], "word string, n long")
    met = {(r.s, r.t) for r in S.candidates(df, df).collect()}
    assert np.mean([(s, t) in met for s, t in made.items()]) > 0.99


def test_no_candidate_is_cut(spark):
    """A form meets its right word though many frequent words of its skeleton can't have become it."""
    pool = ["".join(x) for x in itertools.product("il", repeat=6)]
    wrong = "1" + "i" * 5
    twins = [w for w in pool if S.mistakes(wrong, w) is None]
    right = next(w for w in pool if S.mistakes(wrong, w))
    df = spark.createDataFrame([(w, 5000) for w in twins] + [(right, 500), (wrong, 1)], "word string, n long")
    assert (wrong, right) in {(r.s, r.t) for r in S.candidates(df, df).collect()}


def test_most_frequent_is_never_empty(spark):
    df = spark.createDataFrame([(f"w{i}", 5) for i in range(4000)], "word string, n long")
    assert 500 < len(S.most_frequent(df, 1000)) < 1500 and S.most_frequent(df.limit(0)) == {}


def test_repair_gives_back_paragraphs(spark):
    """Clean paragraphs set as scanned pages (wrapped, hyphenated, misread, with header and number): the repair gives most of them back as they were."""
    import difflib

    import pandas as pd

    rng = np.random.default_rng(4)
    samples = pd.read_parquet("/root/testdata/sf0.01/lang_samples.parquet")
    texts = [t for t in samples[samples.lang != "zh"].text if len(t) > 80 and "\n" not in t]
    rows, want, n = [], {}, 0
    for path in range(8):
        for page in range(1, 26):
            n += 1
            paras = [" ".join(str(texts[int(i)]) for i in rng.integers(len(texts), size=2)) for _ in range(2)]
            want[n] = "\n\n".join(paras)
            set_ = []
            for p in paras:
                line = ""
                for w in p.split(" "):
                    if len(line) + len(w) + 1 > 62:
                        k = min(60 - len(line), len(w) - 3)
                        if w.isalpha() and len(w) > 7 and k > 2 and rng.random() < 0.5:
                            set_.append(f"{line} {w[:k]}-".strip())
                            line = w[k:]
                            continue
                        set_.append(line)
                        line = w
                    else:
                        line = f"{line} {w}".strip()
                set_ += [line, ""]
            body = "\n".join(set_).strip()
            if page % 3 == 0 and "m" in body:
                i = body.index("m", 30)
                body = f"{body[:i]}rn{body[i + 1 :]}"
            rows.append((n, f"s{path}", page, f"Harbour Records {'ABCDEFGH'[path] * 3}\n{body}\n- {page} -"))
    clean = [(10_000 + i, f"c{i % 9}", i, " ".join(str(texts[int(k)]) for k in rng.integers(len(texts), size=5))) for i in range(400)]
    df = spark.createDataFrame(rows + clean, "row_id long, path string, page int, text string")
    got = {r.row_id: r.text for r in S.repair(df).collect()}
    same = np.array([difflib.SequenceMatcher(None, got[i].split(), want[i].split(), autojunk=False).ratio() for i in want])
    whole = np.array([got[i] == want[i] for i in want])
    print("words given back", same.mean(), "pages whole", whole.mean(), "left", [got[i][:60] for i in want if "Harbour Records" in got[i]][:4])
    assert same.mean() > 0.99 and whole.mean() > 0.5 and not any("Harbour Records" in got[i] for i in want)
