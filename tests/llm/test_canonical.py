import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import canonical as N
from leafmill.llm.codepoints import from_codepoints, to_codepoints


def forms(texts):
    return from_codepoints(*N.fold(*to_codepoints(pa.array(texts, pa.string())))).to_pylist()


def one_by_one(t):
    t = t.replace("\r\n", "\n")
    d = "".join(chr(x) for c in unicodedata.normalize("NFD", t) for x in N._fold(ord(c)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", d))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeAeо̧̣́̈̂ｅﬁ각가각 ​­öṩệ\r\n 한🔍"), max_size=14), max_size=8))
def test_equals_the_string_way(texts):
    assert forms(texts) == [one_by_one(t) for t in texts]


def test_what_looks_the_same_and_what_does_not():
    same = [("ｅｌ", "el"), ("café", "café"), ("a​b", "ab"), ("a b c d", "a b c d"), ("сорор", "copop"), ("ﬁn", "fin"), ("５.２", "5.2"), ("℃", "°C"), ("⼀", "一")]
    for a, b in same:
        x, y = forms([a, b])
        assert x == y == b, (a, b)
    for a, b in [("é", "e"), ("A", "a"), ("1", "l"), ("O", "0"), ("-", "—"), ("a.", "a,"), ("593", "893"), ("a b", "ab"), ("a\nb", "a b"), ("ı", "i")]:
        x, y = forms([a, b])
        assert x != y, (a, b)


def test_found(spark):
    pages = spark.createDataFrame(
        [(1, "a", 1, "café"), (2, "a", 1, "café"), (3, "a", 1, "café"), (4, "a", 2, "café"), (5, "a", 1, None), (6, "a", 1, " "), (7, "a", 1, " "), (8, None, 1, "x"), (9, None, 1, "х")],
        "row_id long, path string, page int, text string",
    )
    marks = pages.where("row_id = 1")
    got = {(r.kind, r.row_a, r.row_b) for r in N.found(pages, marks).collect()}
    assert got == {("page", 1, 2), ("page", 2, 3)}
    assert N.found(pages.limit(0), marks.limit(0)).count() == 0
    kept = N.canonical_form(pages).select("canonical").collect()
    assert sum(r.canonical is None for r in kept) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé é ａ中\r\n​ﬁ한하ö!"), max_size=12), max_size=9))
def test_texts_in_form_are_passed_over(texts):
    """Passing over texts in canonical form changes nothing."""
    cp, at = to_codepoints(pa.array(texts, pa.string()))
    got, want = N.fold(cp, at), N._fold_all(cp, at)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
