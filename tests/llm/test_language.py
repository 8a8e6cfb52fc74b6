import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from leafmill.llm import language as L
from leafmill.llm.codepoints import to_codepoints

EN = "The board approves the new schedule for the depot, because only 12 copies were returned."
DE = "Der Wasserverband bestätigt die Lage der Bojen, während der Pegel um 5 Zentimeter fiel."
FR = "Le comité de lecture définit la réparation de la vanne basse, comme le montrent 866 relevés."
ZH = "水务部门批准了新员工的培训，地点在泽原榆附近。"


@pytest.fixture(scope="module")
def samples():
    s = pd.read_parquet("/root/testdata/sf0.01/lang_samples.parquet")
    return list(zip(s.lang, s.text, strict=True))


@pytest.fixture(scope="module")
def model(samples):
    return L.train(samples)


def segs(model, texts):
    rows, out = L.segment_batch(model, *to_codepoints(pa.array(texts, pa.string())))
    return [(int(r), *o) for r, o in zip(rows, out, strict=True)]


def test_held_out_accuracy(samples):
    rng = np.random.default_rng(2)
    order = rng.permutation(len(samples))
    m = L.train([samples[i] for i in order[:240]])
    rest = [samples[i] for i in order[240:]]
    got = {r: lang for r, seg, _, _, lang, _ in segs(m, [t for _, t in rest]) if seg == 0}
    assert np.mean([got[i] == lang for i, (lang, _) in enumerate(rest)]) > 0.98


def test_mixed(model):
    text = f"## Anhang\n\n{EN} {EN}\n\n{DE}\n\n{ZH}{ZH}"
    out = segs(model, [text, EN, None, "", "~ 12 -", f"{EN[:-1]} (“{'Anmerkungen'}”)."])
    mixed = [(seg, lang) for r, seg, _, _, lang, _ in out if r == 0]
    assert mixed == [(0, "en"), (1, "en"), (2, "de"), (3, "zh")]
    spans = [(a, b) for r, seg, a, b, _, _ in out if r == 0 and seg]
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert {r for r, *_ in out} == {0, 1, 5} and [o[1] for o in out if o[0] in (1, 5)] == [0, 0]
    assert all(0 <= o[5] <= 1 for o in out)


def test_found(spark, samples):
    pages = spark.createDataFrame(
        [(1, "en", EN, 0), (2, "ENGLISH", EN, 0), (3, "en-GB", EN, 0), (4, "und", DE, 0), (5, "en", FR, 0), (6, None, None, 0), (7, "", "short", 0), (8, "de", f"{DE} {FR}", 0)],
        "row_id long, lang string, text string, seg int",
    )
    s = spark.createDataFrame(samples, "lang string, text string")
    got = {tuple(r) for r in L.found(pages, s).collect()}
    assert {x for x in got if x[0] < 8} == {(4, 0, "de"), (5, 0, "fr")}
    assert {x for x in got if x[0] == 8 and x[1]} == {(8, 1, "de"), (8, 2, "fr")}
    assert L.found(pages.limit(0), s).count() == 0


def test_quotations_of_all_languages():
    """Words between the quotation marks of any of the languages don't speak for the sentence around them."""
    import numpy as np
    import pyarrow as pa

    from leafmill.llm import language as N
    from leafmill.llm.codepoints import to_codepoints

    texts = ["a “b” c", "a « b » c", "a „b“ c „d” e", "a 「b」 c", "„ open", "b“ c"]
    cp, at = to_codepoints(pa.array(texts))
    q = N._quotes(cp, at)
    for i, t in enumerate(texts[:4]):
        depth = np.cumsum(q[at[i] : at[i + 1]])
        assert [int(depth[k]) for k, c in enumerate(t) if c in "bd"] == [1] * sum(c in "bd" for c in t) and depth[-1] == 0
        assert all(depth[k] == 0 for k, c in enumerate(t) if c in "ace")
    assert q[at[4]] == 0
