"""Conversations: visible text, windows, tool steps, usage, compaction, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import collapse, page_numbers

OMITTED = " — omitted from chat history]"

#: The patterns that tell what a prompt asks for.
CURRENT_PAGE = "(?i)这一页|当前页|本页|此页|这页|this page|current page|the page (?:i'?m|I'?m|I'm) (?:viewing|on|reading)"
WHOLE_DOCUMENT = "(?i)全文|整份|整个文档|整篇|所有页|全书|whole document|entire document|full document|all pages|document summary|(?:总结|分析)(?:一下)?(?:(?:这份|这个)(?:文档|文件|报告|论文|书|资料|材料|PDF)|整|全)"
FACTUAL = "(?i)有哪些|是什么|多少|几个|哪些|列出|日期|时间|谁|何时|何地|where|when|what|which|how many|list all|find all"
PAGE_REF = r"(?i)\b(?:pages?|pp?\.)\s*([0-9]{1,5})(?:\s*[-–—~]\s*[0-9]{1,5})?|第\s*([0-9]{1,5})\s*(?:[-–—~至到]\s*[0-9]{1,5}\s*)?页"
#: Tools whose outputs are compacted, and those that only survey.
COMPACTED = ("document_outline", "search_in_document", "read_pdf_page", "read_pdf_range", "read_section")
META = ("document_outline", "search_in_document")
CANCELLED = "[cancelled]"


def once(messages: DataFrame) -> DataFrame:
    """Valid messages, one for each path, seq and id: known role and an id; of rows that differ the first to arrive, and of these the least."""
    ok = messages.where("path is not null and id <> '' and role in ('user', 'assistant', 'system')")
    rest = [c for c in ok.columns if c not in ("path", "seq", "id")]
    order = [F.to_json(F.struct(*[c for c in rest if c != "arrived_at"]))]
    first = F.struct("arrived_at", *order) if "arrived_at" in rest else F.struct(*order)
    return ok.groupBy("path", "seq", "id").agg(F.min_by(F.struct(*rest), first).alias("_r")).select("path", "seq", "id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def visible(parts: str = "parts") -> Column:
    """Text parts joined by line feeds; null parts are empty."""
    return F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: p.text), "\n"), F.lit(""))


def dropped_turns(total: Column, keep: int = 12, step: int = 4) -> Column:
    """Turns cut from a history: none up to `keep`, then in whole steps so that the cut rarely moves."""
    if step < 1:
        return F.greatest(F.lit(0), total - keep).cast("bigint")
    return F.when(total <= keep, 0).otherwise(F.floor((total - keep) / step) * step).cast("bigint")


def history_window(messages: DataFrame, keep: int = 12, step: int = 4) -> DataFrame:
    """path, seq, id, turn of the messages in the window of their thread, and how many turns were cut."""
    user = (F.col("role") == "user").cast("int")
    turn = F.sum(user).over(Window.partitionBy("path").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(user).over(Window.partitionBy("path"))
    w = messages.withColumn("turn", turn).withColumn("dropped", dropped_turns(total, keep, step))
    return w.where("turn > dropped").select("path", "seq", "id", "turn", "dropped")


def tool_steps(messages: DataFrame) -> DataFrame:
    """One row per tool part: path, seq, pos, tool, bucket, key, page."""
    parts = messages.select("path", "seq", "id", F.posexplode("parts").alias("pos", "p")).where(F.startswith("p.type", F.lit("tool-")))
    tool = F.substring("p.type", F.lit(6), F.length("p.type"))
    s = parts.select("path", "seq", "id", "pos", tool.alias("tool"), "p.state", "p.input", "p.output", "p.tool_call_id")
    arg = lambda k: F.get_json_object("input", f"$.{k}")
    bucket = F.when(F.col("tool") == "search_in_document", "search").when(F.col("tool").isin("read_pdf_page", "read_pdf_range"), "read").when(F.col("tool") == "document_outline", "index").otherwise("other")
    or_q = lambda c: F.coalesce(c, F.lit("?"))
    key = (
        F.when(F.col("tool") == "read_pdf_page", F.concat(F.lit("read:"), or_q(arg("page"))))
        .when(F.col("tool") == "read_pdf_range", F.concat(F.lit("range:"), or_q(arg("start")), F.lit("-"), or_q(arg("end"))))
        .when(F.col("tool") == "search_in_document", F.concat(F.lit("search:"), F.coalesce(arg("query"), F.lit(""))))
        .when(F.col("tool") == "document_outline", "index")
        .otherwise(F.concat(F.lit("other:"), F.col("tool")))
    )
    page = F.when(F.col("tool") == "read_pdf_page", arg("page")).when(F.col("tool") == "read_pdf_range", arg("start")).try_cast("int")
    return s.withColumns({"bucket": bucket, "key": key, "page": page})


def bucket_counts(steps: DataFrame) -> DataFrame:
    """Per path the tool steps of each bucket."""
    return steps.groupBy("path").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("search", "read", "index", "other")])


def step_details(steps: DataFrame) -> DataFrame:
    """Per path and key the count, the label and page of the first step, and the place of the first, in order of first sight."""
    at = F.struct("seq", "pos")
    d = steps.groupBy("path", "key").agg(F.count("*").alias("n"), F.min_by(step_label(), at).alias("label"), F.min_by("page", at).alias("page"), F.min(at).alias("first"))
    return d.select("path", "key", "n", "label", "page", F.row_number().over(Window.partitionBy("path").orderBy("first")).alias("ord"))


def step_label() -> Column:
    """What a tool step is called."""
    key = F.col("key")
    tail = F.regexp_extract(key, ":(.*)$", 1)
    return (
        F.when(F.col("tool") == "read_pdf_page", F.concat(F.lit("Read page "), tail))
        .when(F.col("tool") == "read_pdf_range", F.concat(F.lit("Read pages "), tail))
        .when(F.col("bucket") == "search", F.concat(F.lit("Search "), tail))
        .when(F.col("bucket") == "index", "Survey")
        .otherwise(F.col("tool"))
    )


PHASES = ("survey", "locate", "read", "answer")


def run_plan(steps: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Per path the four phases survey, locate, read, answer with their steps and state (done, active, pending); all four always.

    `running` (path, running, answering) names runs that go on; others are finished. The phase of the
    last step is active, or the answer while it is written; a run without a step is surveying.
    """
    phase = F.when(F.col("bucket") == "index", 0).when(F.col("bucket") == "search", 1).otherwise(2)
    counted = steps.groupBy("path").agg(*[F.count_if(phase == i).alias(p) for i, p in enumerate(PHASES[:3])], F.max_by(phase, F.struct("seq", "pos")).alias("last"))
    if running is None:
        counted = counted.withColumns({"running": F.lit(False), "answering": F.lit(False)})
    else:
        counted = counted.join(running, "path", "full_outer").fillna(0, list(PHASES[:3])).fillna(False, ["running", "answering"])
    active = F.when(F.col("running"), F.when(F.col("answering"), 3).otherwise(F.coalesce("last", F.lit(0))))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phase"), (F.col(p) if i < 3 else F.lit(0)).cast("bigint").alias("steps")) for i, p in enumerate(PHASES)]))
    flat = counted.withColumn("active", active).select("path", "running", "answering", "active", rows.alias("x")).select("*", "x.*")
    done = (F.col("steps") > 0) | (F.col("ord") < F.col("active")) | ~F.col("running") | ((F.col("ord") == 3) & F.col("answering"))
    state = F.when(F.col("active") == F.col("ord"), "active").when(F.coalesce(done, F.lit(False)), "done").otherwise("pending")
    return flat.select("path", "ord", "phase", "steps", state.alias("state"))


def usage_totals(messages: DataFrame) -> DataFrame:
    """Per path the token sums (null is 0), the time answers took and the speed in tokens a second (null where unknown)."""
    m = F.col("metadata")
    ms = F.when(m.finished_at.isNotNull() & m.started_at.isNotNull(), F.greatest(F.lit(0), m.finished_at - m.started_at))
    t = messages.groupBy("path").agg(
        F.sum(F.coalesce(m.input_tokens, F.lit(0))).cast("bigint").alias("input_tokens"),
        F.sum(F.coalesce(m.output_tokens, F.lit(0))).cast("bigint").alias("output_tokens"),
        F.sum(F.coalesce(ms, F.lit(0))).cast("bigint").alias("duration_ms"),
        F.sum(F.when(ms > 0, m.output_tokens)).cast("bigint").alias("timed_tokens"),
    )
    speed = F.when((F.col("timed_tokens") > 0) & (F.col("duration_ms") > 0), F.round(F.col("timed_tokens") * 1000.0 / F.col("duration_ms"), 1))
    return t.select("path", "input_tokens", "output_tokens", "duration_ms", speed.alias("tokens_per_s"))


def message_gaps(messages: DataFrame) -> DataFrame:
    """path, seq, id of each answer and the milliseconds since the answer before in its thread, at least 0; of the first since it was begun; null where a time is missing."""
    done, begun = F.col("metadata.finished_at"), F.col("metadata.started_at")
    w = Window.partitionBy("path").orderBy("seq", "id")
    gap = done - F.when(F.row_number().over(w) == 1, begun).otherwise(F.lag(done).over(w))
    return messages.where("role = 'assistant'").select("path", "seq", "id", F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)).alias("gap_ms"))


def text_length(output: str = "output") -> Column:
    """Characters of a tool output: its text if it is an object with one, else its charCount, else its own length; 0 for null."""
    return F.coalesce(F.length(F.get_json_object(output, "$.text")), F.get_json_object(output, "$.charCount").try_cast("int"), F.length(output), F.lit(0))


def compacted_output() -> Column:
    """The one line that stands for a tool output (columns tool, input, output): reads, searches, sections and outlines; compacted, cancelled and refused ones and other tools' as they are."""
    n = text_length().cast("string")
    arg = lambda k: F.get_json_object("input", f"$.{k}")
    end = F.lit(OMITTED)
    chars = lambda *head: F.concat(*head, F.lit(", "), n, F.lit(" chars"), end)
    span = F.when(arg("start").isNull() | arg("end").isNull(), "page range").when(arg("start") == arg("end"), F.concat(F.lit("page "), arg("start"))).otherwise(F.concat(F.lit("pages "), arg("start"), F.lit("–"), arg("end")))
    listed = F.coalesce(F.json_array_length(F.get_json_object("output", "$.hits")), F.when(F.col("output").startswith("["), F.json_array_length("output")))
    hits = F.coalesce(listed.cast("string"), n)
    tool = F.col("tool")
    line = (
        F.when((tool == "read_pdf_page") & arg("page").isNotNull(), chars(F.lit("[Read page "), arg("page")))
        .when(tool == "read_pdf_range", chars(F.lit("[Read "), span))
        .when(tool == "search_in_document", F.concat(F.lit('[Search "'), F.substring(F.coalesce(arg("query"), F.lit("query")), 1, 40), F.lit('", '), hits, F.lit(" hits"), end))
        .when(tool == "read_section", chars(F.lit('[Read section "'), F.substring(F.coalesce(arg("title"), F.lit("section")), 1, 60), F.lit('"')))
        .when(tool == "document_outline", chars(F.lit("[Document index")))
        .otherwise(F.col("output"))
    )
    same = F.endswith("output", end) | (F.col("output") == CANCELLED) | (F.get_json_object("output", "$.budgetExceeded") == "true")
    return F.when(F.coalesce(same, F.lit(False)), F.col("output")).otherwise(line)


def compact_outputs(steps: DataFrame) -> DataFrame:
    """path, seq, pos and the output as kept in history."""
    return steps.where("output is not null").select("path", "seq", "id", "pos", compacted_output().alias("output"))


def compact_run(steps: DataFrame, keep_chars: int = 16_000, keep_least: int = 1) -> DataFrame:
    """path, seq, pos and output of a run's tool outputs: the newest whole ones within `keep_chars` stay, `keep_least` of them always; older ones become one line."""
    known = steps.where("output is not null")
    w = Window.partitionBy("path").orderBy(F.desc("seq"), F.desc("pos"))
    sized = known.where(F.col("tool").isin(*COMPACTED)).select("path", "seq", "pos", text_length().alias("n"))
    ranked = sized.withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    older = ranked.where((F.col("total") > keep_chars) & (F.col("rn") > keep_least)).select("path", "seq", "pos", F.lit(True).alias("older"))
    both = known.join(older, ["path", "seq", "pos"], "left")
    return both.select("path", "seq", "id", "pos", F.when(F.col("older"), compacted_output()).otherwise(F.col("output")).alias("output"))


def repaired_parts(c: str = "parts") -> Column:
    """Parts without unfinished tool inputs; calls that wait for their output get `[cancelled]` as one."""
    tool = lambda p: F.startswith(p.type, F.lit("tool-"))
    kept = F.filter(c, lambda p: ~(tool(p) & F.coalesce(p.state == "input-streaming", F.lit(False))))
    waits = lambda p: tool(p) & F.coalesce(p.state == "input-available", F.lit(False))
    return F.transform(kept, lambda p: F.when(waits(p), p.withField("state", F.lit("output-available")).withField("output", F.lit(CANCELLED))).otherwise(p))


def repair_dangling(messages: DataFrame) -> DataFrame:
    """Messages with repaired parts; those left empty go."""
    return messages.withColumn("parts", repaired_parts()).where(F.size("parts") > 0)


def shown_parts(c: str = "parts") -> Column:
    """Parts as one line of text: type, state, text and output of each."""
    return F.array_join(F.transform(c, lambda p: F.concat_ws("|", p.type, p.state, p.text, p.output)), "¶")


def strip_reasoning(messages: DataFrame) -> DataFrame:
    """Messages without reasoning parts of assistants; messages left or come empty go."""
    kept = F.when(F.col("role") == "assistant", F.filter("parts", lambda p: p.type != "reasoning")).otherwise(F.col("parts"))
    return messages.withColumn("parts", kept).where(F.size("parts") > 0)


def read_pages(parts: str = "parts", cap: int = 300) -> Column:
    """The distinct pages that a message's read tools delivered, in order, the first `cap` of them.

    Only calls with a complete input count. Cancelled reads and refused ones without characters
    delivered nothing. A range is what the output reports, else what was asked for; a section only
    what the output reports.
    """

    def pages(p: Column) -> Column:
        given = lambda k: F.get_json_object(p.input, f"$.{k}").try_cast("int")
        told = lambda k: F.get_json_object(p.output, f"$.{k}").try_cast("int")
        live = F.coalesce(p.state.isin("input-available", "output-available"), F.lit(False))
        refused = (F.get_json_object(p.output, "$.budgetExceeded") == "true") & (told("charCount") == 0)
        nothing = F.coalesce((p.output == CANCELLED) | refused, F.lit(False))
        reported = F.coalesce(told("endPage") >= told("startPage"), F.lit(False))
        a, b = F.when(reported, told("startPage")).otherwise(given("start")), F.when(reported, told("endPage")).otherwise(F.greatest(given("start"), given("end")))
        spread = F.sequence(a, F.least(b, a + cap))
        # A null bound gives no pages.
        ranged = F.when((a >= 1) & (b >= a), spread)
        got = F.when(p.type == "tool-read_pdf_page", F.when(given("page") >= 1, F.array(given("page")))).when(p.type == "tool-read_pdf_range", ranged).when((p.type == "tool-read_section") & reported, ranged)
        return F.coalesce(F.when(live & ~nothing, got), F.array().cast("array<int>"))

    every = F.array_distinct(F.flatten(F.transform(F.coalesce(parts, F.expr(f"cast(array() as {PARTS})")), pages)))
    return F.array_sort(F.slice(every, 1, cap))


PARTS = "array<struct<type: string, text: string, tool_name: string, tool_call_id: string, state: string, input: string, output: string>>"


def read_trail(messages: DataFrame) -> DataFrame:
    """path, seq, id and page of each page that an assistant's message delivered."""
    return messages.where("role = 'assistant'").select("path", "seq", "id", F.explode(read_pages()).alias("page"))


def segments(messages: DataFrame) -> DataFrame:
    """path, seq, id, segment, kind (text, reasoning, tools), first part and number of parts: contiguous runs of tool parts are one segment.

    Step marks and blank texts stand between without ending a run; reasoning within a run comes after it.
    """
    each = messages.select("path", "seq", "id", F.posexplode("parts").alias("pos", "p"))
    kind = F.when(F.startswith("p.type", F.lit("tool-")), "tools").when((F.col("p.type") == "reasoning") & (F.length(F.trim(F.coalesce("p.text", F.lit("")))) > 0), "reasoning").when((F.col("p.type") == "text") & (F.length(F.trim(F.coalesce("p.text", F.lit("")))) > 0), "text")
    live = each.withColumn("kind", kind).where("kind is not null")
    w = Window.partitionBy("path", "seq", "id").orderBy("pos")
    # A run of tools begins where no text came since the last tool; reasoning between is put behind it.
    texts = F.count_if(F.col("kind") == "text").over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = F.min(F.when(F.col("kind") == "tools", F.col("pos"))).over(Window.partitionBy("path", "seq", "id", "texts"))
    last = F.max(F.when(F.col("kind") == "tools", F.col("pos"))).over(Window.partitionBy("path", "seq", "id", "texts"))
    spot = F.when(F.col("kind") == "tools", F.struct(F.col("run").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))).when((F.col("kind") == "reasoning") & F.col("pos").between(F.col("run"), F.col("last")), F.struct(F.col("run").alias("a"), F.lit(1).alias("b"), F.col("pos").alias("c"))).otherwise(F.struct(F.col("pos").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")))
    placed = live.withColumn("texts", texts).withColumn("run", run).withColumn("last", last).withColumn("spot", spot)
    runs = placed.groupBy("path", "seq", "id", "kind", "spot").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return runs.select("path", "seq", "id", F.row_number().over(Window.partitionBy("path", "seq", "id").orderBy("spot")).alias("segment"), "kind", "first", "n")


def meta_loops(calls: DataFrame, window: int = 3) -> DataFrame:
    """Per run whether its last `window` steps call nothing but surveys and searches and one of these calls repeats (run, step, tool, input; a step without a call has a null tool)."""
    steps = calls.groupBy("run", "step").agg(F.bool_and(F.coalesce(F.col("tool").isin(*META), F.lit(False))).alias("meta"))
    ranked = steps.withColumn("rn", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step")))).where(F.col("rn") <= window)
    near = ranked.groupBy("run").agg((F.bool_and("meta") & (F.count("*") == window)).alias("meta"), F.min("step").alias("since"))
    seen = calls.join(near, "run").where((F.col("step") >= F.col("since")) & F.col("tool").isin(*META)).groupBy("run", "tool", F.coalesce("input", F.lit("")).alias("input")).count()
    repeats = seen.groupBy("run").agg((F.max("count") > 1).alias("again"))
    return near.join(repeats, "run", "left").select("run", (F.col("meta") & F.coalesce("again", F.lit(False))).alias("loop"))


def intents(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Adds current_page, whole_document and factual: what the text asks for."""
    whole = F.col(text).rlike(WHOLE_DOCUMENT)
    return prompts.withColumns({"current_page": F.col(text).rlike(CURRENT_PAGE), "whole_document": whole, "factual": ~whole & F.col(text).rlike(FACTUAL)})


def page_refs(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds refs: the page numbers that a text names, in order of mention."""
    a = F.regexp_extract_all(text, F.lit(PAGE_REF), F.lit(1))
    b = F.regexp_extract_all(text, F.lit(PAGE_REF), F.lit(2))
    refs = F.zip_with(a, b, lambda x, y: F.concat(x, y).cast("int"))
    return rows.withColumn("refs", F.filter(refs, lambda n: n >= 1))


def follows(read_page: Column, text: Column, viewing: Column) -> Column:
    """Whether a preview should go to a page just read: never for questions on the whole document, to the page in view for one on this page, to pages that the prompt names; a null prompt always."""
    named = page_numbers(text)
    return F.when(text.isNull(), True).when(text.rlike(WHOLE_DOCUMENT), False).when(text.rlike(CURRENT_PAGE) | (F.size(named) == 0), read_page == viewing).otherwise(F.array_contains(named, read_page))


def claim(text: Column, most: int = 500) -> Column:
    """An answer cut to whole sentences within `most` characters, else to whole words with an ellipsis."""
    clean = collapse(text)
    parts = F.regexp_extract_all(clean, F.lit("[^.!?。！？]+[.!?。！？]+|[^.!?。！？]+$"), F.lit(0))
    zero = F.struct(F.lit("").alias("s"), F.lit(True).alias("go"))
    fold = F.aggregate(parts, zero, lambda a, x: F.struct(F.when(a.go & (F.length(a.s) + F.length(x) <= most), F.concat(a.s, x)).otherwise(a.s).alias("s"), (a.go & (F.length(a.s) + F.length(x) <= most)).alias("go")))
    whole = F.trim(fold.s)
    room = most - 1
    head = F.substring(clean, 1, room)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    words = F.when((F.locate(" ", head) > 0) & (last > room * 0.6), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(clean) <= most, clean).when(F.length(whole) > 0, whole).otherwise(F.concat(F.rtrim(words), F.lit("…")))
