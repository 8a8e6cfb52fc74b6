"""Literal cases: what each operator gives for small inputs, nulls, ties and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chat as C
from leafmill.operators import pages as P
from leafmill.operators import reading as R
from leafmill.operators import search as S
from leafmill.operators import stores as K
from leafmill.operators import structure as O
from leafmill.streaming import settle

PAGES = "path string, page int, text string, source string"
TABLE = "|项目|本期|上年同期|\n|---|---|---|\n|营业收入|1,284|1,141|"


def pages(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else None) for r in rows], PAGES)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (TABLE, "项目 本期 上年同期\n营业收入 1,284 1,141"),
        ("## 1.2 Metrische Räume", "1.2 Metrische Räume"),
        ("- first\n* second", "first\nsecond"),
        ("a **bold** and *italic* word", "a bold and italic word"),
        ("`code` and <u>underlined</u>", "code and underlined"),
        ("see [the spec](https://example.com/spec) now", "see the spec now"),
        ("Revenue rose 12.5% — see note (a), b*c, and 3 * 4.", "Revenue rose 12.5% — see note (a), b*c, and 3 * 4."),
        ("", ""),
        (None, None),
    ],
)
def test_plain_text(spark, given, want):
    assert one(spark, T.plain_text(F.col("t")), t=given) == want if given is not None else one(spark, T.plain_text(F.col("t").cast("string")), t=None) is None


@pytest.mark.parametrize(
    ("texts", "query", "want"),
    [
        (["The Quick brown FOX"], "fox", [(1, 16, "FOX")]),
        (["aa aa aa"], "aa", [(1, 0, "aa"), (1, 3, "aa"), (1, 6, "aa")]),
        (["aaaa"], "aa", [(1, 0, "aa"), (1, 2, "aa")]),
        (["café"], "café", [(1, 0, "café")]),
        (["这是一个测试文档，测试搜索功能"], "测试", [(1, 4, "测试"), (1, 9, "测试")]),
        (["alpha", "beta target", "target again"], "target", [(2, 5, "target"), (3, 0, "target")]),
        (["a.b a+b (a|b)"], "a|b", [(1, 9, "a|b")]),
        (["any", None, ""], "  ", []),
    ],
)
def test_search(spark, texts, query, want):
    df = pages(spark, *[("d", i, t) for i, t in enumerate(texts, 1)])
    assert sorted((r.page, r.idx, r.match) for r in S.hits(df, query).collect()) == want


def test_snippet_and_limit(spark):
    df = pages(spark, ("d", 1, "0123456789" * 20 + "needle tail"), ("d", 2, "x x x x"))
    assert S.hits(df, "needle").first().snippet.startswith("…")
    top = S.top_hits(df, "x", 3).collect()
    assert len(top) == 3 and all(r.truncated for r in top)
    assert S.hits(df.limit(0), "x").count() == 0


@pytest.mark.parametrize(("given", "want"), [([7], "7"), ([51, 52, 53], "51-53"), ([51, 52, 53, 80, 95, 96], "51-53, 80, 95-96"), ([53, 51, 52, 52, None], "51-53")])
def test_ranges(spark, given, want):
    df = spark.createDataFrame([("d", p) for p in given], "path string, page int")
    assert P.ranges(df).first().pages == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (("x" * 25, None), ("short", None), "a"),
        (("tiny", None), ("y" * 30, None), "b"),
        (("v" * 40, "vision"), ("n" * 400, "native"), "a"),
        (("n" * 400, "native"), ("v" * 40, "vision"), "b"),
        (("n" * 40, "native"), ("m" * 400, "native"), "b"),
        (("n" * 40, "native"), ("m" * 50, "native"), "a"),
    ],
)
def test_merge(spark, a, b, want):
    out = P.merge_reload(pages(spark, ("d", 1, *a), ("d", 2, "kept page of thirty characters")), pages(spark, ("d", 1, *b), ("d", 3, None))).orderBy("page").collect()
    assert (out[0].text, out[0].source) == (a if want == "a" else b)
    assert [r.page for r in out] == [1, 2, 3]


def test_running_lines(spark):
    body = "\nbody one\nbody two\n"
    head = ["<u>1.2. METRISCHE RÄUME</u>", "<u>1.2. METRISCHE RÄUME</u>", "**1.2. Metrische Räume**"]
    df = pages(spark, *[("a", i, h + body + f"end {i}") for i, h in enumerate(head)], *[("b", i, "Shared" + body + f"e{i}") for i in range(2)], *[("c", i, "| Year | Revenue |" + body + f"e{i}") for i in range(4)], *[("d", i, "header") for i in range(3)], *[("e", i, "x" * 81 + body + f"e{i}") for i in range(3)], ("f", 1, None))
    out = {(r.path, r.page): r.text for r in P.strip_running(df).collect()}
    assert all(out["a", i].startswith("body one") for i in range(3))
    assert out["b", 0].startswith("Shared") and out["c", 0].startswith("| Year") and out["d", 0] == "header" and out["e", 0].startswith("xxx") and out["f", 1] is None


def test_outline(spark):
    text = "## 1.2 Metrische Räume\n## Abbildung 2.4:Kartenwechsel\n## 4 2 2 4 6 8\n## ) Widerspruch\n## Dann ist stetig.\n## U = R n N\n### Too deep"
    df = pages(spark, ("d", 1, "# Introduction\n\nbody text\n"), ("d", 2, text), ("e", 1, "# Anhang"), ("e", 2, "# Anhang"), ("f", 1, "# <u>Vorwort</u>"), ("g", 1, None))
    assert [(r.path, r.ord, r.title, r.page, r.level) for r in O.synthesize(df).orderBy("path", "ord").collect()] == [("d", 0, "Introduction", 1, 1), ("d", 1, "1.2 Metrische Räume", 2, 2), ("e", 0, "Anhang", 1, 1), ("f", 0, "Vorwort", 1, 1)]


OUTLINE = [("1 Topologische Grundbegriffe", 6, 1), ("1.1 Topologische Räume", 6, 2), ("1.2 Metrische Räume", 10, 2), ("1.5 Kompaktheit", 18, 1), ("Übungsaufgaben", 26, 1)]


def test_sections(spark):
    df = spark.createDataFrame([("d", i, *x) for i, x in enumerate(OUTLINE)], "path string, ord int, title string, page int, level int")
    total = lambda n: spark.createDataFrame([("d", n)], "path string, total int")
    got = {r.ord: (r.start_page, r.end_page) for r in O.section_ranges(O.usable(df, total(117))).collect()}
    assert got == {0: (6, 17), 1: (6, 9), 2: (10, 17), 3: (18, 25), 4: (26, 117)}
    assert {r.ord for r in O.usable(df, total(20)).collect()} == {0, 1, 2, 3}
    for q, want in (("1.2 Metrische Räume", 2), ("Metrische Räume", 2), ("  ÜBUNGSAUFGABEN ", 4), ("Topologische Räume", 1), ("Fourieranalyse", None)):
        row = O.find_section(df, q).first()
        assert (row.ord if row else None) == want
    at = O.active_heading(spark.createDataFrame([("d", p) for p in (5, 6, 9, 10, 25, 99)], "path string, page int"), df)
    assert [r.ord for r in at.orderBy("page").collect()] == [None, 1, 1, 2, 3, 4]


def test_reading(spark):
    long = "".join(f"{i:06d}" for i in range(2000))
    df = pages(spark, ("d", 1, long), ("d", 2, "second"), ("e", 1, None))
    cut = R.page_slices(df, 1000).where("path = 'd' and page = 1").orderBy("offset").collect()
    assert len(cut) == 12 and "".join(r.text for r in cut) == long
    assert [r.next_offset for r in cut] == [*range(1000, 12000, 1000), None] and [r.truncated for r in cut] == [True] * 11 + [False]
    assert [(r.text, r.chars, r.next_offset) for r in R.page_slices(df).where("path = 'e'").collect()] == [("", 0, None)]
    got = {r.path: r for r in R.read_range(df, 1, 2, 500).collect()}
    assert got["d"].charged == 500 - len("--- Page 1 ---\n") and (got["d"].next_page, got["d"].next_offset) == (1, got["d"].charged)
    assert got["e"].text == "--- Page 1 ---\n" and got["e"].next_page is None


def test_greedy_skips(spark):
    df = spark.createDataFrame([("k", "a", 5_999_995, 30), ("k", "b", 10, 20), ("k", "c", 4, 10)], "k string, item string, size long, t long")
    assert {r.item for r in R.evict_greedy(df, "k", "item", "size", "t", 24, 6_000_000).collect()} == {"a", "c"}
    assert R.evict_greedy(df.limit(0), "k", "item", "size", "t", 24, 1).count() == 0


def test_prefix_stops(spark):
    df = spark.createDataFrame([("k", 3, 5), ("k", 2, 9), ("k", 1, 1)], "k string, t int, c int")
    assert [r.t for r in R.keep_prefix(df, "k", [F.desc("t")], F.col("c"), 10).collect()] == [3]
    assert len(R.keep_prefix(df, "k", [F.desc("t")], F.col("c"), 0, 1).collect()) == 1


FINDINGS = "path string, id string, pages array<int>, claim string, supersedes string, struck boolean"


def test_findings(spark):
    store = spark.createDataFrame([("d", "a", [2], "x", None, None), ("d", "b", [2], "y", "a", None), ("d", "c", [1], "z", None, True), ("d", "e", None, "w", None, None), ("d", "f", [1], "v", "e", True)], FINDINGS)
    assert {r.id for r in K.active(store).collect()} == {"b"}
    new = spark.createDataFrame([("d", "n1", [], "x", None, None), ("d", "n2", [3, 3, 1, 0], " x ", None, None), ("d", "n3", [1], " ", None, None), ("d", "n4", [1], "x", "a", None), ("d", "n5", [1], "x", "zz", None), ("d", "n6", [1], "x", "b", None), ("d", "n7", list(range(1, 40)), "x", None, None)], FINDINGS)
    got = {r.id: r.pages for r in K.add_findings(store, new).collect()}
    assert got == {"n2": [1, 3], "n6": [1], "n7": list(range(1, 21))}


def test_stale_and_filter(spark):
    rows = spark.createDataFrame([("d", "s1", "Alpha", None), ("e", "s1", None, "beta"), ("f", "s0", None, None)], "path string, stamp string, a string, b string")
    now = spark.createDataFrame([("d", "s1"), ("e", "s2"), ("f", "")], "path string, now string")
    assert {r.path: r.stale for r in K.stale(rows, now).collect()} == {"d": False, "e": True, "f": False}
    assert [r.path for r in K.filter_rows(rows, ["a", "b"], " BETA ").collect()] == ["e"] and K.filter_rows(rows, ["a"], " ").count() == 3


MSG = "path string, seq int, id string, role string, parts array<struct<type: string, text: string, tool_name: string, tool_call_id: string, state: string, input: string, output: string>>, metadata struct<started_at: long, finished_at: long, input_tokens: int, output_tokens: int>"


def turns(spark, n):
    rows = []
    for i in range(n):
        rows += [("d", 2 * i, f"u{i}", "user", [("text", f"q{i}", *[None] * 5)], None), ("d", 2 * i + 1, f"a{i}", "assistant", [("text", f"r{i}", *[None] * 5)], None)]
    return spark.createDataFrame(rows, MSG)


@pytest.mark.parametrize(("n", "keep", "step", "dropped"), [(20, 5, 1, 15), (200, 12, 4, 188), (41, 12, 4, 28), (42, 12, 4, 28), (5, 12, 4, 0)])
def test_window(spark, n, keep, step, dropped):
    got = C.history_window(turns(spark, n), keep, step).collect()
    assert len(got) == 2 * (n - dropped) and {r.dropped for r in got} == {dropped}


def test_tools(spark):
    part = lambda tool, state, i, o: (f"tool-{tool}", None, tool, None, state, i, o)
    parts = [part("read_pdf_page", "output-available", '{"page": 3}', '{"charCount": 5234}'), part("read_pdf_range", "output-available", '{"start": 4, "end": 5}', "x" * 7), part("search_in_document", "input-available", '{"query": "q"}', None), part("read_figure", "input-streaming", "{}", None), part("read_pdf_page", "output-available", '{"page": 3}', "[cancelled]"), ("reasoning", "t", *[None] * 5)]
    m = spark.createDataFrame([("d", 1, "a", "assistant", parts, None), ("d", 2, "b", "assistant", None, None)], MSG)
    steps = C.tool_steps(m)
    out = [r.output for r in C.compact_outputs(steps).orderBy("pos").collect()]
    assert out == ["[Read page 3, 5234 chars — omitted from chat history]", "[Read pages 4–5, 7 chars — omitted from chat history]", "[cancelled]"]
    again = C.compact_outputs(steps.join(C.compact_outputs(steps).withColumnRenamed("output", "o"), ["path", "seq", "id", "pos"]).drop("output").withColumnRenamed("o", "output"))
    assert [r.output for r in again.orderBy("pos").collect()] == out
    assert sorted(r.page for r in C.read_trail(m).collect()) == [3, 4, 5]
    assert C.bucket_counts(steps).first().asDict() == {"path": "d", "search": 1, "read": 3, "index": 0, "other": 1}
    assert [(r.key, r.n, r.page) for r in C.step_details(steps).orderBy("ord").collect()] == [("read:3", 2, 3), ("range:4-5", 1, 4), ("search:q", 1, None), ("other:read_figure", 1, None)]
    assert [r.label for r in C.step_details(steps).orderBy("ord").collect()] == ["Read page 3", "Read pages 4-5", "Search q", "read_figure"]
    assert [(r.phase, r.steps, r.state) for r in C.run_plan(steps).orderBy("ord").collect()] == [("survey", 0, "done"), ("locate", 1, "done"), ("read", 4, "done"), ("answer", 0, "done")]
    fixed = C.repair_dangling(m).first().parts
    assert [p.state for p in fixed] == ["output-available"] * 4 + [None] and fixed[2].output == "[cancelled]" and fixed[2].input == '{"query": "q"}'
    assert len(C.strip_reasoning(m).collect()[0].parts) == 5


def test_claim_and_refs(spark):
    text = "A" * 300 + ". " + "B" * 300 + ". " + "C" * 300 + "."
    assert one(spark, C.claim(F.col("t")), t=text) == "A" * 300 + "."
    assert one(spark, C.claim(F.col("t"), 20), t="several words without end") == "several words…"
    df = spark.createDataFrame([("see pages 3-5 and p. 12, 第 7 页",), ("none",), (None,)], "text string")
    assert [r.refs for r in C.page_refs(df).collect()] == [[3, 12, 7], [], None]
    flags = C.intents(spark.createDataFrame([("what is on this page",), ("whole document please",)], "text string")).collect()
    assert [(r.current_page, r.whole_document, r.factual) for r in flags] == [(True, False, True), (False, True, False)]


def test_settled(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    rows = [("k", t(0), "a", 1), ("k", t(1), "b", 2), ("k", t(20), "b", 3), ("k", t(40), "c", 4)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v string, n int")
    assert [r.v for r in settle.settled(df, "k", "ts", "v", "n", 600).orderBy("ts").collect()] == ["b", "c"]
