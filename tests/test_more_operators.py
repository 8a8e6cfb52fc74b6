"""Literal cases of the further operators: nulls, ties, empty tables, bounds."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chat as C
from leafmill.operators import documents as D
from leafmill.operators import geometry as G
from leafmill.operators import messages as M
from leafmill.operators import pages as P
from leafmill.operators import reading as R
from leafmill.operators import search as S
from leafmill.operators import stores as K
from leafmill.operators import structure as O
from leafmill.operators import usage as U

PAGES = "path string, page int, text string, source string"
MSG = "path string, seq int, id string, role string, parts array<struct<type: string, text: string, tool_name: string, tool_call_id: string, state: string, input: string, output: string>>, metadata struct<started_at: long, finished_at: long, input_tokens: int, output_tokens: int>"
RECT = "struct<x: float, y: float, width: float, height: float>"


def pages(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else None) for r in rows], PAGES)


def values(spark, column, given, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, t {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def text(t):
    return ("text", t, *[None] * 5)


def tool(name, state="output-available", input="{}", output=None):
    return (f"tool-{name}", None, name, "c", state, input, output)


# Searches


@pytest.mark.parametrize(
    ("given", "query", "want"),
    [
        ("İstanbul", "stanbul", [(1, "stanbul")]),
        ("İİ ab", "ab", [(3, "ab")]),
        ("café", "café", [(0, "café")]),
        ("café", "café", [(0, "café")]),
        ("café bar", "cafe", []),
        ("café bar", "bar", [(5, "bar")]),
        ("ΣΑΣ", "σ", [(0, "Σ"), (2, "Σ")]),
        ("| a | b |\n|---|---|\n| 1,284 | x |", "1,284 x", [(4, "1,284 x")]),
        ("# Head [link](http://a)", "head link", [(0, "Head link")]),
    ],
)
def test_search_folds_with_places(spark, given, query, want):
    assert [(r.idx, r.match) for r in S.hits(pages(spark, ("d", 1, given)), query).orderBy("idx").collect()] == want


def test_search_preview_steps_and_items(spark):
    df = pages(spark, ("d", 1, "x" * 60 + " rent"), ("d", 2, "rent"), ("d", 3, "rent"), ("d", 4, ""))
    row = S.preview(S.hits(df, "rent")).first()
    assert row.pages == 3 and row.snippets == f"p.1: {'x' * 48}…; p.2: rent" and row.message.startswith("Matches on 3 page(s) — ")
    assert {(r.unindexed_count, r.unindexed_pages) for r in S.with_unindexed(S.hits(df, "rent"), df).collect()} == {(3, "2-4")}
    steps = spark.createDataFrame([(3, 2), (3, 0), (0, 0)], "n int, c int")
    assert [r.x for r in steps.select(S.step_match(F.col("n"), F.col("c"), 1).alias("x")).collect()] == [0, 1, -1]
    assert [r.x for r in steps.select(S.step_match(F.col("n"), F.col("c"), -1).alias("x")).collect()] == [1, 2, -1]
    items = spark.createDataFrame([("d", 1, i, "The LEASE" if i % 2 else "none") for i in range(300)], "path string, page int, ord int, text string")
    asked = spark.createDataFrame([("d", 1, " lease "), ("d", 1, " ")], "path string, page int, query string")
    assert len(S.items_matching(items, asked).collect()) == 60
    commands = spark.createDataFrame([("Scan all pages", "Document", "ocr", False), ("Scan page", "View", None, True), ("Export", "Document", "save file", None)], "label string, section string, keywords string, disabled boolean")
    assert [r.label for r in S.commands_matching(commands, "document SCAN").collect()] == ["Scan all pages"] and S.commands_matching(commands, " ").count() == 2


# Texts


def test_small_texts(spark):
    t = F.col("t")
    assert values(spark, T.for_prompt(t, 12), ['re"port\n`a`', "x" * 13, None]) == ["re'port 'a'", "x" * 12 + "…", None]
    leaked = '让我先读取整份文档\n<|DSML|tool_calls><|DSML|invoke name="list_documents"></|DSML|invoke></|DSML|tool_calls>'
    spaced = '< | | DSML | | tool_calls> < | | DSML | | invoke name="list_documents">\n</ | | DSML | | invoke></ | | DSML | | tool_calls>'
    prose = "The DSML format is a leaked markup where a model writes invoke name= itself."
    assert values(spark, T.without_leaked_markup(t), [leaked, spaced, prose, None]) == ["让我先读取整份文档", "", prose, None]
    assert values(spark, T.display_url(t), [" http://a ", "h" * 73]) == ["http://a", "h" * 71 + "…"]
    assert values(spark, T.safe_link(t), ["https://a", "HTTP://A", "mailto:x@y", "javascript:alert(1)", "file:///x", "page.html", "", None]) == [True] * 3 + [False] * 5
    assert values(spark, T.link_label(t, F.lit("u")), ["c", "", None]) == ["c — u", "u", "u"]
    assert values(spark, T.region_text(F.lit(None).cast("string"), t), ["[Image: X4]", " a\n b ", "x" * 501]) == ["", "a b", "x" * 500 + "…"]
    assert values(spark, T.region_text(F.lit("|a|\n|b|"), t), ["z"]) == ["|a|\n|b|"] and values(spark, T.quote(F.lit(" "), t), ["a  b"]) == ["a b"]
    assert values(spark, T.document_kind(t), ["/a/B.PDF", "x.jpeg", "x.tar.gz", "noext", "/a.pdf/b"]) == ["pdf", "image", None, None, None]
    assert values(spark, T.base_name(t), ["/a/b.pdf", "c\\d.pdf", "e"]) == ["b.pdf", "d.pdf", "e"]
    keys = values(spark, T.page_cache_key(t), ["/a|b.pdf|3|w640|high|2", "a|1|2|3"])
    assert tuple(keys[0]) == ("/a|b.pdf", "3", "w640", "high", "2") and keys[1] is None
    assert values(spark, T.duration(t), [None, -1, 850, 1300], "int") == ["—", "—", "850ms", "1.3s"]
    assert values(spark, T.compact_count(t), [None, 850, 2500, 25000, 999], "int") == ["—", "850", "2.5k", "25k", "999"]
    assert values(spark, T.speed(t), [None, 0.0, 472.0], "double") == ["—", "—", "472.0 T/s"]
    assert values(spark, T.clamp(t, 50, 200), [None, -3.0, 7.9, 999.0, float("nan")], "double") == [50, 0, 7, 200, 50]


@pytest.mark.parametrize(
    ("given", "want"),
    [("请看第3页", [3]), ("第一百二十三页", [123]), ("第１２页", [12]), ("第3到5页", [3, 4, 5]), ("see pages 3-5", [3, 4, 5]), ("pages 7 to 9", [7, 8, 9]), ("see p. 12", [12]), ("第3页 and page 3", [3]), ("summarize this", []), ("第十页", [10]), ("第二十页", [20]), ("pages 1-500", [1, 500]), ("第0页", []), ("", [])],
)
def test_pages_named(spark, given, want):
    assert T.pages_named(given) == want
    assert values(spark, T.page_numbers(F.col("t")), [given, None]) == [want, None]


def test_page_references(spark):
    df = spark.createDataFrame([("page 12345, pp. 3–4, 第 5–9 页",), ("mypage 4",)], "text string")
    assert [r.refs for r in C.page_refs(df).collect()] == [[12345, 3, 5], []]


# Outlines


def test_headings_out_of_order(spark):
    outline = spark.createDataFrame([("d", 0, "A", 1, 1), ("d", 1, "B", 9, 1), ("d", 2, "C", 2, 1)], "path string, ord int, title string, page int, level int")
    at = O.active_heading(spark.createDataFrame([("d", p) for p in (0, 5, 9)], "path string, page int"), outline)
    assert [r.title for r in at.orderBy("page").collect()] == [None, "A", "C"]
    odd = spark.createDataFrame([("d", 0, "a", -3, 1), ("d", 1, "b", 0, 1), ("d", 2, " ", 3, 1), ("d", 3, "c", None, 1), ("d", 4, "e", 7, 9), ("d", 5, "f", 9, 8)], outline.schema)
    for total in (None, 0):
        u = O.usable(odd, spark.createDataFrame([("d", total)], "path string, total int"))
        assert [r.ord for r in u.orderBy("ord").collect()] == [4, 5]
        assert {r.ord: (r.start_page, r.end_page) for r in O.section_ranges(u).collect()} == {4: (7, 7), 5: (9, 9)}
    deep = O.section_ranges(O.usable(odd, spark.createDataFrame([("d", 20)], "path string, total int")))
    assert {r.ord: r.end_page for r in deep.collect()} == {4: 8, 5: 20}
    assert O.next_section(outline, spark.createDataFrame([("d", 1), ("e", 2)], "path string, page int")).first().section == "B"
    flat = O.flattened(spark.createDataFrame([("d", i, f" t\n {i} ", None, 0) for i in range(120)], "path string, ord int, title string, page int, level int")).collect()
    assert len(flat) == 100 and flat[0].title == "t 0"


# Reading


def body(n, chars):
    return (f"PAGE-{n}-START " + "x" * chars)[:chars]


def read(spark, df, *args, **kw):
    return R.read_range(df, *args, **kw).where("path = 'd'").first()


def test_reading_contract(spark):
    df = pages(spark, *[("d", n, body(n, 400)) for n in range(1, 6)])
    got = read(spark, df, 2, 4, 6000)
    assert got.pages == [2, 3, 4] and all(f"PAGE-{n}-START" in got.text for n in (2, 3, 4)) and "PAGE-5" not in got.text
    assert got.charged == 1200 and got.char_count == len(got.text) and not got.truncated
    assert read(spark, df, 4, 2, 6000).pages == [2, 3, 4] and read(spark, df, 4, 99, 6000).end_page == 5
    long = pages(spark, ("d", 1, body(1, 12000)))
    texts, offset = "", 0
    for _ in range(20):
        r = read(spark, long, 1, 1, 1000 + (16 if not offset else 24), offset=offset)
        texts += r.text.split("\n", 1)[1]
        assert ("(cont.)" in r.text) == (offset > 0)
        if not r.truncated:
            break
        assert r.next_page == 1
        offset = r.next_offset
    assert texts == body(1, 12000)


def test_reading_under_a_budget(spark):
    df = pages(spark, *[("d", n, body(n, 4800)) for n in range(1, 7)])
    known = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "path string, page int")
    again = read(spark, df, 2, 3, 50_000, delivered=known)
    assert again.text.count(R.ALREADY_READ) == 2 and again.charged == 0 and again.pages == []
    mixed = read(spark, df, 1, 3, 50_000, delivered=known.where("page = 2"))
    assert mixed.pages == [1, 3] and mixed.text.count(R.ALREADY_READ) == 1 and mixed.charged == 9600
    # A delivered page that doesn't fit is cut again, not pointed at.
    assert read(spark, df, 1, 1, 1000, delivered=known).charged == 1000 - 15
    spent = read(spark, df, 1, 3, 50_000, used=200_000)
    assert (spent.text, spent.budget_exceeded, spent.next_page, spent.next_offset, spent.end_page) == ("", True, 1, 0, None)
    tight = read(spark, df, 1, 3, 50_000, used=195_000)
    assert tight.budget_exceeded and tight.pages == [1, 2] and tight.next_page == 2 and tight.charged == 4800 + tight.next_offset
    assert read(spark, df, 3, 3, 50_000, used=200_000, offset=70).next_offset == 70
    cost = spark.createDataFrame([("d", 1, 100), ("d", 5, 9)], "path string, page int, chars long")
    assert read(spark, df, 1, 2, 50_000, attached=cost).charged == 9700


def test_reading_scans(spark):
    df = pages(spark, ("d", 1, ""), ("d", 2, body(2, 400)), ("d", 3, None), ("d", 4, " "), ("d", 5, body(5, 400)))
    got = read(spark, df, 1, 5, 6000, scans=1)
    assert got.unscanned == "3-4" and got.pages == [1, 2, 5] and got.text.startswith("--- Page 1 ---\n\n\n--- Page 2 ---\n")
    assert read(spark, df, 1, 5, 6000).unscanned == "" and R.read_range(df.limit(0), 1, 5).count() == 0


def test_read_section(spark):
    df = pages(spark, *[("d", n, body(n, 100)) for n in range(1, 31)], ("e", 1, "x"))
    outline = spark.createDataFrame([("d", 0, "Intro", 1, 1, 30), ("d", 1, "Metric spaces", 10, 2, 30), ("d", 2, "End", 13, 1, 30)], "path string, ord int, title string, page int, level int, total int")
    got = R.read_section(df, outline, "metric").collect()
    assert [(r.path, r.section, r.pages) for r in got] == [("d", "Metric spaces", [10, 11, 12])]
    assert R.read_section(df, outline, "nothing").count() == 0


def test_protected_item_stays(spark):
    df = spark.createDataFrame([("k", f"/doc-{i}.pdf", 10, i) for i in range(25)], "k string, item string, size long, t long")
    got = {r.item for r in R.evict_greedy(df, "k", "item", "size", "t", 24, 6_000_000, "/doc-0.pdf").collect()}
    assert len(got) == 25 and "/doc-0.pdf" not in {r.item for r in R.evict_greedy(df, "k", "item", "size", "t", 24, 6_000_000).collect()}


# Pages and stores


def test_latest_and_recovery(spark):
    rows = spark.createDataFrame([(1, "d", 1, "a"), (2, "d", 1, "b"), (3, None, None, "n"), (4, None, None, "m")], "row_id long, path string, page int, text string")
    assert sorted(r.text for r in P.latest(rows, ["path", "page"], "row_id").collect()) == ["b", "m"]
    assert sorted(r.text for r in P.earliest(rows, ["path", "page"], "row_id").collect()) == ["a", "n"]
    df = pages(spark, ("d", 1, "kept"), ("d", 2, " "), ("d", 3, None))
    got = P.recovered(df, pages(spark, ("d", 1, "other"), ("d", 2, " found "), ("d", 3, " ")))
    assert {r.page: r.text for r in got.collect()} == {1: "kept", 2: "found", 3: None}
    assert sorted(r.page for r in P.empty_pages(df).collect()) == [2, 3]
    assert [r.page for r in P.sparse(df, 0).collect()] == [] and P.sparse(df, 2).count() == 2 and P.sparse(df, None).count() == 3
    assert P.previews(pages(spark, ("d", 1, " a\n b " + "x" * 99))).first().preview == ("a b " + "x" * 99)[:60]


def test_survey_of_all_kinds(spark):
    df = pages(spark, *[("d", n, "x" * (2000 if n < 4 else 5)) for n in range(1, 8)], ("e", 1, None))
    extra = spark.createDataFrame([("d", 2), ("d", 3)], "path string, page int")
    got = {r.path: r for r in P.survey(P.sizes(df), extra, extra, extra.limit(0)).collect()}
    assert (got["d"].densest_pages, got["d"].link_pages, got["d"].figure_pages, got["d"].unindexed_pages) == ("1-5", "2-3", "", "4-7")
    assert got["d"].needs_chunking and got["e"].total_chars == 0 and "link_pages" not in P.survey(P.sizes(df), extra).columns


def test_changes_in_pages_added_and_gone(spark):
    a, b = pages(spark, ("d", 1, "x"), ("e", 1, "x"), ("f", 1, None)), pages(spark, ("d", 1, "x"), ("d", 2, ""), ("f", 1, ""))
    assert {r.path: r.changed for r in P.changed(a, b).collect()} == {"d": True, "e": True, "f": False}


def test_revisions_in_one_batch(spark):
    schema = "path string, id string, pages array<int>, claim string, supersedes string, struck boolean, created_at long"
    store = spark.createDataFrame([("d", "a", [1], "x", None, None, 1)], schema)
    new = spark.createDataFrame([("d", "r1", [1], "y", "a", None, 5), ("d", "r2", [1], "z", "a", None, 4), ("d", None, [1], "n", None, None, 6)], schema)
    got = K.add_findings(store, new).collect()
    assert {r.id for r in got if r.id in ("r1", "r2")} == {"r2"} and len(got) == 2 and all(r.id for r in got)
    assert len(K.add_findings(store, new, 2).collect()) == 1 and K.add_findings(store, new, 1).count() == 0


def test_prune_keeps_recents(spark):
    chats = spark.createDataFrame([(f"p{i:03d}", i) for i in range(130)], "path string, inserted int")
    keep = spark.createDataFrame([("p000",), ("p001",), ("gone",)], "path string")
    got = {r.path for r in K.prune_chats(chats, keep).collect()}
    assert got == {"p000", "p001", *(f"p{i:03d}" for i in range(32, 130))}
    assert K.prune_chats(chats.limit(5), keep).count() == 5 and K.prune_chats(chats.limit(0), keep).count() == 0


def test_stored_index(spark):
    page = "array<struct<page: int, text: string>>"
    rows = [(1, "a", "s", 2, [(1, "x"), (2, "")], 5, 0), (1, "a", "s", 2, [(1, "later")], 6, 1), (2, "b", "s", 1, [(1, "x")], 5, 2), (1, "c", None, 1, [(1, "x")], 5, 3), (1, "e", "s", 1, [(0, "x")], 5, 4), (1, "e", "s", 1, [(1, "good")], 5, 5), (1, "", "s", 1, [(1, "x")], 5, 6), (1, "f", "s", 1, None, 5, 7)]
    got = K.sanitize_index(spark.createDataFrame(rows, f"version int, path string, stamp string, total_pages int, pages {page}, saved_at long, ord int")).collect()
    assert [(r.path, [(p.page, p.text) for p in r.pages]) for r in got] == [("a", [(1, "x")])]


def test_reindex_and_lists(spark):
    df = pages(spark, ("d", 1, "v", "vision"), ("d", 2, "n", "native"), ("d", 3, "v", "vision"))
    fresh, cache = K.reindexed(df, df.select("path", "page"), 2)
    assert {r.page: r.text for r in fresh.collect()} == {1: "", 2: "n", 3: "v"} and [r.page for r in cache.collect()] == [3]
    assert K.reindexed(df, df.select("path", "page"), 0)[1].count() == 3 and K.forgotten(df, df.select("path").limit(1)).count() == 0
    lst = lambda *p: spark.createDataFrame(list(enumerate(p)), "ord int, path string")
    assert [r.path for r in K.path_list(lst("a", "b"), lst("b", "c")).orderBy("ord").collect()] == ["a", "b", "c"]
    assert [r.path for r in K.path_list(lst("a", "b"), lst("b", "c"), 2).orderBy("ord").collect()] == ["b", "c"]


def test_record_and_export(spark, tmp_path):
    rows = [("d", f"f{i}", [i], f"claim {i} " + "x" * 50, None, False, i) for i in range(1, 6)]
    found = spark.createDataFrame(rows, "path string, id string, pages array<int>, claim string, supersedes string, struck boolean, created_at long")
    got = K.record_lines(found, 150).first()
    assert got.omitted == 3 and [x.split()[2] for x in got.lines.split("\n")] == ["4", "5"]
    docs = spark.createDataFrame([("d", "d.pdf", " Title "), ("e", "e.pdf", None)], "path string, name string, title string")
    marks = spark.createDataFrame([("d", "m1", 2, "quoted", "my note", 1), ("d", "m0", 1, "", None, 9)], "path string, id string, page int, text string, note string, created_at long")
    blocks = K.export_blocks(pages(spark, ("d", 2, " two "), ("d", 1, "one"), ("d", 3, " ")), docs, marks)
    whole = "\n\n".join(r.block for r in blocks.where("path = 'd'").orderBy("part", "ord").collect())
    assert whole == "# Title\n\n**Source:** d.pdf\n\n## Marks\n\n- **p. 1** — (no text)\n\n- **p. 2** — quoted\n  - my note\n\n<!-- page 1 -->\n\none\n\n<!-- page 2 -->\n\ntwo"
    K.write_blocks(blocks, str(tmp_path / "out"))
    text_of = "".join(f.read_text() for f in sorted((tmp_path / "out" / "document=64").glob("*.txt")))
    assert text_of.index("# Title") < text_of.index("quoted") < text_of.index("one") < text_of.index("two")
    assert values(spark, K.summary_markdown(F.lit("T"), F.col("t"), F.array(F.lit("a"), F.lit("b"))), ["o", None]) == ["# T\n\no\n\n- a\n- b", "# T\n\n- a\n- b"]


# Messages


def thread(spark, *rows):
    return spark.createDataFrame([("d", i, f"m{i}", role, parts, None) for i, (role, parts) in enumerate(rows)], MSG)


def test_messages_are_made_valid(spark):
    m = thread(spark, ("user", None), ("user", []), ("robot", [text("x")]), ("user", [text("x")]))
    assert [r.seq for r in M.normalized(m).collect()] == [3]
    old = m.withColumn("content", F.when(F.col("seq") == 0, "from before"))
    assert {r.seq: r.parts[0].text for r in M.normalized(old).collect()} == {0: "from before", 3: "x"}
    shot = ("file", None, *[None] * 5)
    m = thread(spark, ("user", [shot]), ("user", [text("a"), shot]), ("assistant", [shot]), ("user", [shot, text("b")]))
    bare = {r.seq: [p.text for p in r.parts] for r in M.strip_files(m).collect()}
    assert bare == {0: [" "], 1: ["a"], 2: [None], 3: ["b"]}
    assert len([r for r in M.strip_files(m, True).collect() if r.seq == 3][0].parts) == 2
    sent = thread(spark, ("user", [text("q")]), ("assistant", [tool("read_pdf_page", "input-streaming")]), ("assistant", [tool("read_pdf_page", "input-available")]))
    got = M.for_send(sent).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 2] and got[1].parts[0].output == "[cancelled]"


def test_last_and_texts(spark):
    m = thread(spark, ("user", [text("q"), text(" "), text("r ")]), ("assistant", [("reasoning", " why ", *[None] * 5), text("because of it"), tool("a", output="x" * 2000), tool("b", output="[cancelled]"), tool("c", output="y")]))
    a = M.awaiting(m).first()
    assert (a.awaits, a.in_flight) == (False, "m1") and M.last_messages(m, "user").first().id == "m0" and M.awaiting(m.where("seq = 0")).first().awaits
    got = m.select("seq", M.user_text().alias("u"), M.assistant_text().alias("a"), M.tool_excerpts().alias("e"), M.substantial().alias("s")).orderBy("seq").collect()
    assert got[0].u == "q\nr" and got[1].a == "why\n\nbecause of it" and got[1].e == "x" * 1200 + "\n---\ny" and [r.s for r in got] == [False, True]
    assert [(r.prev_id, r.next_id) for r in M.neighbours(m).orderBy("seq").collect()] == [(None, "m1"), ("m0", None)]
    hinted = M.with_context(m, spark.createDataFrame([("d", "look at page 3")], "path string, hint string")).orderBy("seq").collect()
    assert hinted[0].parts[-1].text == "look at page 3" and len(hinted[1].parts) == 5
    src = lambda url, t=None: ("source-url", t, None, None, None, url, None)
    s = M.sources(thread(spark, ("assistant", [src("https://a", "A"), src("https://a", "again"), src("javascript:x"), src("http://b")]))).orderBy("ord").collect()
    assert [(r.url, r.title) for r in s] == [("https://a", "A"), ("http://b", None)]
    before = M.signature(m).first().signature
    assert M.signature(m.orderBy(F.desc("seq"))).first().signature == before != M.signature(m.where("seq = 0")).first().signature


def test_compaction_in_a_run(spark):
    read_ = lambda n: tool("read_pdf_page", input=f'{{"page": {n}}}', output="x" * 6000)
    m = thread(spark, *[("assistant", [read_(n)]) for n in range(1, 11)], ("assistant", [tool("read_figure", output="f" * 9000)]))
    got = [r.output for r in C.compact_run(C.tool_steps(m)).orderBy("seq", "pos").collect()]
    assert [len(o) == 6000 for o in got[:10]] == [False] * 8 + [True] * 2 and got[0] == "[Read page 1, 6000 chars — omitted from chat history]" and len(got[10]) == 9000
    one = C.compact_run(C.tool_steps(thread(spark, ("assistant", [tool("read_pdf_range", input="{}", output="x" * 99_000)])))).first().output
    assert len(one) == 99_000
    outs = [tool("search_in_document", input='{"query": "%s"}' % ("q" * 50), output='{"hits": [1, 2, 3]}'), tool("search_in_document", output="[1, 2]"), tool("read_section", input='{"title": "Scope"}', output='{"text": "abcd"}'), tool("search_in_document", output='{"hits": [], "budgetExceeded": true}')]
    got = [r.output for r in C.compact_outputs(C.tool_steps(thread(spark, ("assistant", outs)))).orderBy("pos").collect()]
    end = " — omitted from chat history]"
    assert got == [f'[Search "{"q" * 40}", 3 hits{end}', f'[Search "query", 2 hits{end}', f'[Read section "Scope", 4 chars{end}', '{"hits": [], "budgetExceeded": true}']


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ([tool("read_pdf_page", input='{"page": 5}', output="t"), tool("read_pdf_page", input='{"page": 2}', output="t")], [2, 5]),
        ([tool("read_pdf_range", input='{"start": 3, "end": 6}', output="t")], [3, 4, 5, 6]),
        ([tool("read_pdf_range", input='{"start": 1, "end": 100}', output='{"startPage": 1, "endPage": 3}')], [1, 2, 3]),
        ([tool("read_pdf_page", input='{"page": 3}', output='{"budgetExceeded": true, "charCount": 0}')], []),
        ([tool("read_pdf_page", input='{"page": 3}', output="[cancelled]")], []),
        ([tool("read_pdf_page", "input-streaming", '{"page": 3}')], []),
        ([tool("read_pdf_page", "input-available", '{"page": 3}')], [3]),
        ([tool("read_section", input='{"title": "x"}', output='{"startPage": 4, "endPage": 5}')], [4, 5]),
        ([tool("read_section", input='{"title": "x"}', output="t")], []),
        ([tool("read_pdf_range", input='{"start": 9, "end": 2}', output="t")], [9]),
        ([tool("read_pdf_range", input='{"start": 1, "end": 900}', output="t")], list(range(1, 301))),
        ([text("x")], []),
        (None, []),
    ],
)
def test_pages_read(spark, parts, want):
    assert [r.x for r in thread(spark, ("assistant", parts)).select(C.read_pages().alias("x")).collect()] == [want]


def test_plans_loops_segments_follow(spark):
    steps = C.tool_steps(thread(spark, *[("assistant", [tool(n)]) for n in ("search_in_document", "read_pdf_page", "search_in_document")]))
    going = spark.createDataFrame([("d", True, False), ("new", True, False)], "path string, running boolean, answering boolean")
    got = {(r.path, r.phase): r.state for r in C.run_plan(steps, going).collect()}
    assert [got["d", p] for p in C.PHASES] == ["done", "active", "done", "pending"] and [got["new", p] for p in C.PHASES] == ["active", "pending", "pending", "pending"]
    calls = lambda *c: spark.createDataFrame([("r", i, t, q) for i, (t, q) in enumerate(c)], "run string, step int, tool string, input string")
    o, s = "document_outline", "search_in_document"
    loop = lambda c, w=3: C.meta_loops(calls(*c), w).first().loop
    assert loop([(o, None), (o, None), (s, None)]) and loop([(o, None), (o, None)], 2) and not loop([(o, None), (o, None)])
    assert not loop([("read_pdf_page", None), (s, "a"), (s, "b"), (s, "c")]) and not loop([(o, None), (s, None), (None, None)])
    assert loop([("read_pdf_page", None), (o, None), (s, "x"), (o, None)]) and not loop([(s, None), ("read_pdf_page", None), (s, None)])
    think = ("reasoning", "why", *[None] * 5)
    seg = C.segments(thread(spark, ("assistant", [tool("a"), ("step-start", *[None] * 6), think, text(" "), tool("b"), text("answer"), tool("c")]))).orderBy("segment").collect()
    assert [(r.kind, r.first, r.n) for r in seg] == [("tools", 0, 2), ("reasoning", 2, 1), ("text", 5, 1), ("tools", 6, 1)]
    asks = [None, "whole document please", "what is on this page", "see page 7", "why"]
    assert values(spark, C.follows(F.lit(7), F.col("t"), F.lit(3)), asks) == [True, False, False, True, False]


def test_steering(spark):
    notes = spark.createDataFrame([("r", i, t) for i, t in enumerate([" one ", " ", "two", "three", "four", "five"])] + [("s", 0, "x" * 700)], "run string, at int, text string")
    taken = M.steer_notes(notes)
    assert {r.run: r.body for r in M.steer_body(taken).collect()} == {"r": "- one\n- two\n- three\n- four", "s": "x" * 600}


# Usage


def test_usage(spark):
    rows = [("m", 0, 100, None, None, ["a"], 1100), ("m", 0, 100, 20, 5, None, 1200), ("m", 1, 250, 90, None, None, 1900), ("m", 1, None, None, None, None, 2000)]
    e = spark.createDataFrame(rows, "msg string, step int, input_tokens int, output_tokens int, cached_tokens int, tool_names array<string>, ts long")
    steps = U.step_usage(e)
    t = U.message_usage(steps).first()
    assert (t.steps, t.input_tokens, t.output_tokens, t.cached_tokens) == (2, 350, 110, 5)
    timed = U.step_times(steps, spark.createDataFrame([("m", 1000)], "msg string, started_at long"))
    assert [r.duration_ms for r in timed.orderBy("step").collect()] == [200, 800] and timed.orderBy("step").first().tool_names == ["a"]
    runs = spark.createDataFrame([("a", 1000, 2300, 4300, 10), ("b", 0, 1000, 2000, 472), ("c", None, None, 5, 3), ("d", 0, None, 1000, 0)], "msg string, started_at long, first_token_at long, finished_at long, output_tokens int")
    got = {r.msg: r for r in U.timings(runs).collect()}
    assert got["a"].first_token_ms == 1300 and got["b"].tokens_per_s == 472.0 and got["c"].total_ms is None and got["d"].tokens_per_s is None and got["d"].total_ms == 1000
    calls = spark.createDataFrame([("p", 10, None), ("p", 5, 7)], "path string, input_tokens int, output_tokens int")
    index = U.index_usage(calls)
    assert tuple(index.first()) == ("p", 2, 15, 7)
    totals = spark.createDataFrame([("p", 100, 3), ("q", 9, 9)], "path string, input_tokens long, output_tokens long")
    assert {tuple(r) for r in U.agent_totals(totals, index).collect()} == {("p", 85, 0), ("q", 9, 9)}
    assert values(spark, U.most_steps(F.col("t")), [None, 3, 25, 99], "int") == [20, 20, 25, 30]


# Documents, links, other services


def test_links_and_marks_of_a_read(spark):
    schema = "path string, ord int, page int, url string, context string"
    links = spark.createDataFrame([("d", 0, 1, "https://a/", "See the spec"), ("d", 1, 1, "https://a/", ""), ("d", 2, 1, "javascript:alert(1)", ""), ("d", 3, 2, "https://a/", ""), *[("d", 10 + i, 3, f"https://a/{i}", "") for i in range(200)]], schema)
    on = lambda *p: spark.createDataFrame([("d", x) for x in p], "path string, page int")
    assert [(r.page, r.url, r.context) for r in D.links_on(links, on(1, 2)).orderBy("page").collect()] == [(1, "https://a/", "See the spec"), (2, "https://a/", None)]
    assert D.links_on(links, on(3)).count() == 40 and sorted(r.page for r in D.linked_pages(links).collect()) == [1, 2, 3]
    marks = spark.createDataFrame([("d", "b", 1, "x" * 130, "n" * 200, 2), ("d", "a", 1, None, "", 1), ("d", "c", 9, "z", None, 1)], "path string, id string, page int, text string, note string, created_at long")
    got = D.marks_on(marks, on(1)).orderBy("ord").collect()
    assert [(r.text, r.note) for r in got] == [("", None), ("x" * 120 + "…", "n" * 200)]
    cost = D.attachment_chars(D.links_on(links, on(1)), D.marks_on(marks, on(1))).first()
    assert cost.chars > 330


def test_loading(spark, tmp_path):
    docs = spark.createDataFrame([("a.pdf", "s1"), ("b.png", "s1"), ("c.txt", "s1"), ("e.pdf", "")], "path string, stamp string")
    fresh = pages(spark, ("a.pdf", 1, "short"), ("a.pdf", 2, "n" * 30, "native"), ("e.pdf", 1, "fresh"), ("c.txt", 1, "no"))
    cache = spark.createDataFrame([("a.pdf", 1, "v" * 40, "s1"), ("a.pdf", 2, "w" * 40, "s0"), ("e.pdf", 1, "v" * 40, "")], "path string, page int, text string, stamp string")
    got = {(r.path, r.page): (r.text, r.source) for r in D.load(fresh, docs, cache).collect()}
    assert got == {("a.pdf", 1): ("v" * 40, "vision"), ("a.pdf", 2): ("n" * 30, "native"), ("b.png", 1): ("", None), ("e.pdf", 1): ("fresh", None)}
    (tmp_path / "x.PDF").write_bytes(b"12345")
    (tmp_path / "y.txt").write_bytes(b"1")
    (tmp_path / "z.gif").write_bytes(b"1" * 50)
    rows = D.files(spark, str(tmp_path), most_bytes=10).collect()
    assert [r.kind for r in rows] == ["pdf"] and rows[0].stamp.endswith(":5") and rows[0].content == b"12345"
    assert "content" not in D.files(spark, str(tmp_path), content=False).columns
    seen = D.recognised(pages(spark, ("d", 1, ""), ("d", 2, "x" * 30), ("d", 3, None)), lambda k: F.concat(F.lit("page "), k.page.cast("string")), 1)
    assert {r.page: (r.text, r.source) for r in seen.collect()} == {1: ("page 1", "vision"), 2: ("x" * 30, None), 3: (None, None)}


def test_models_and_answers(spark):
    known = spark.createDataFrame([("qwen2.5", False, True), ("qwen2.5-vl", True, False), ("a/b:free", True, True)], "key string, vision boolean, tools boolean")
    models = spark.createDataFrame([("o", "qwen2.5:7b"), ("o", "Qwen2.5-VL-72b"), ("o", "qwen2.5-coder"), ("o", "a/b:free"), ("o", "qwen2.5vl"), ("o", "qwen")], "provider string, model string")
    got = {r.model: (r.vision, r.tools) for r in D.abilities(models, known).collect()}
    assert got == {"qwen2.5:7b": (False, True), "Qwen2.5-VL-72b": (True, False), "qwen2.5-coder": (False, True), "a/b:free": (True, True), "qwen2.5vl": (None, None), "qwen": (None, None)}
    assert values(spark, D.looks_visual(F.col("t")), ["x/pixtral-12b", "gpt", "my-vl:7b"]) == [True, False, True]
    bodies = ['{"choices":[{"message":{"content":" hi "}}]}', '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"x"},{"text":"b"}]}}]}', "{}", None]
    assert values(spark, D.completion_text(F.col("t")), bodies) == ["hi", "ab", "", ""]
    use = values(spark, D.completion_usage(F.col("t")), ['{"usage":{"prompt_tokens":3,"completion_tokens":4}}', '{"usage":{"input_tokens":5}}', "{}"])
    assert [tuple(u) for u in use] == [(3, 4), (5, None), (None, None)]
    errors = ['{"error":{"message":"m","metadata":{"raw":" own words "}}}', '{"error":{"message":"Provider returned error","metadata":{"raw":"provider returned error","provider_name":"P"}}}', '{"message":"plain"}', "not json", ""]
    assert values(spark, D.error_text(F.col("t")), errors) == ["own words", "Provider returned error (P)", "plain", None, None]
    inputs = values(spark, D.tool_input(F.col("t")), ['{"page": "12"}', '{"start": 9, "end": "4", "offset": 70}', "broken"])
    assert inputs[0].page == 12 and (inputs[1].start, inputs[1].end, inputs[1].offset) == (4, 9, 0) and inputs[2].page is None
    facts = spark.createDataFrame([("a", "Scope", 3, 2, 1, 100), ("b", None, 0, 0, 1, 100), ("c", "", None, None, 9, 10)], "path string, section string, unindexed_count int, mark_count int, read_count int, total_pages int")
    assert {(r.path, r.kind) for r in D.follow_ups(facts).collect()} == {("a", "nextSection"), ("a", "scanUnindexed"), ("a", "compareMarks"), ("b", "wholeDocument")}


# Geometry


def test_layout_and_views(spark):
    sizes = [(600, 800), (600, 300), (600, 800), (1000, 600), (600, 800), (600, 250), (600, 800), (600, 800), (600, 1200), (600, 260)]
    df = spark.createDataFrame([("d", i, float(w), float(h)) for i, (w, h) in enumerate(sizes, 1)], "path string, page int, width double, height double")
    laid = G.layout(df, 1.0)
    total = 16 + sum(h + 16 for _, h in sizes)
    views = spark.createDataFrame([("d", s, s, 860) for s in range(0, total, 20)], "path string, view int, scroll int, height int")
    at = [r.page for r in G.page_at(laid, views).orderBy("view").collect()]
    assert at == sorted(at) and set(at) == set(range(1, 11)) and len(at) == len(range(0, total, 20))
    seen = {r.view: (r.first, r.last) for r in G.visible_pages(laid, views).collect()}
    assert seen[0] == (1, 3) and seen[max(seen)][1] == 10
    to = {r.page: r.scroll for r in G.page_offset(laid, spark.createDataFrame([("d", p) for p in (0, 1, 2, 99)], "path string, page int")).collect()}
    assert to[1] == 0 == to[0] and to[2] == 816 and to[99] == max(r.top for r in laid.collect()) - 16
    twice = G.layout(df, 2.0)
    shift = {r.view: r.shift for r in G.relayout_shift(laid, twice, views).collect()}
    assert shift[0] == 0 and shift[820] == 800 and set(r.shift for r in G.relayout_shift(laid, twice.where("page < 5"), views).collect()) == {0}
    odd = G.layout(spark.createDataFrame([("d", 1, None, None), ("d", 2, 100.0, 200.0), ("e", 1, None, None)], df.schema), 1.0)
    assert {(r.path, r.page): (r.width, r.height) for r in odd.collect()} == {("d", 1): (100, 200), ("d", 2): (100, 200), ("e", 1): (612, 792)}
    assert G.fit_scale(df, 1100, 50).first().scale == 1.0 and values(spark, G.quantized_width(F.col("t")), [5, 50, 640], "int") == [32, 64, 640]


def test_boxes(spark):
    rect = lambda x, y, w, h: (float(x), float(y), float(w), float(h))
    links = spark.createDataFrame([("d", 0, 1, "u", rect(30, 81, 40, 10)), ("d", 1, 2, "u", rect(30, 81, 40, 10))], f"path string, ord int, page int, url string, rect_bl {RECT}")
    lines = lambda *r: spark.createDataFrame([("d", 1, i, t, b) for i, (t, b) in enumerate(r)], f"path string, page int, ord int, text string, rect_bl {RECT}")
    near = lines(("the line above", rect(0, 100, 300, 12)), ("See <u>the spec</u>  for details", rect(0, 80, 300, 12)), ("same place", rect(0, 80, 300, 12)))
    assert {r.ord: r.context for r in G.link_context(links, near).collect()} == {0: "See the spec for details", 1: ""}
    long = G.link_context(links, lines(("word " * 80, rect(0, 80, 300, 12)))).where("ord = 0").first().context
    assert len(long) == 201 and long.endswith("…") and G.link_context(links, lines(("far", rect(0, 400, 300, 12)))).where("ord = 0").first().context == ""
    flip = spark.createDataFrame([(rect(10, 20, 100, 12),)], f"r {RECT}").select(G.flipped(F.col("r"), F.lit(800.0)).alias("f"), G.share_box(F.col("r"), F.lit(600.0), F.lit(800.0)).alias("s")).first()
    assert flip.f.y == 768 and flip.s.top == 0.025
    items = lines(("in", rect(10, 10, 10, 10)), ("", rect(0, 0, 5, 5)), ("flat", rect(0, 0, 0, 5)), ("out", rect(500, 10, 10, 10)))
    assert sorted(r.text for r in G.live_items(items).collect()) == ["in", "out"]
    regions = spark.createDataFrame([("d", "a", 1, rect(0, 0, 50, 50)), ("d", "b", 1, rect(800, 0, 5, 5)), ("d", "c", 0, rect(0, 0, 50, 50))], f"path string, region string, page int, rect_bl {RECT}")
    assert {r.region: r.text for r in G.region_texts(regions, G.live_items(items)).collect()} == {"a": "in", "b": ""}
    figures = spark.createDataFrame([("d", 0, 1, rect(0, 0, 30, 30)), ("d", 1, 1, rect(0, 0, 60, 60)), ("d", 2, 1, rect(0, 0, 23, 900)), ("d", 3, 1, rect(9, 9, 60, 60))], f"path string, ord int, page int, rect_bl {RECT}")
    assert [(r.ord, r["index"]) for r in G.figures_on(figures).orderBy("index").collect()] == [(1, 1), (3, 2), (0, 3)]
    assert G.read_figure(figures, 1, 3, lambda r: F.concat(F.lit("w "), r.width.cast("int").cast("string"))).first().description == "w 30" and G.read_figure(figures, 1, 4).count() == 0
    boxes = spark.createDataFrame([("s", i, rect(0, 0, i, 9), rect(1, 1, 1, 1)) for i in range(4)] + [("t", 0, rect(0, 0, 1, 1), rect(2, 2, 2, 2))], f"selection string, ord int, rect {RECT}, bound {RECT}")
    got = [(r.selection, r.rect.width) for r in G.line_boxes(boxes).orderBy("selection", "ord").collect()]
    assert got == [("s", 2.0), ("s", 3.0), ("t", 2.0)]


def test_effort_and_queue(spark):
    rows = spark.createDataFrame([(None, True), ("high", False), ("high", True)], "c string, m boolean")
    assert [r.x for r in rows.select(U.reasoning_effort(F.col("c"), F.col("m")).alias("x")).collect()] == [None, "low", "high"]
    jobs = spark.createDataFrame([("q", 1, "low"), ("q", 2, "high"), ("q", 3, None), ("q", 4, "high")], "queue string, at int, priority string")
    assert [r["at"] for r in U.queue_order(jobs).orderBy("ord").collect()] == [4, 2, 1, 3]
