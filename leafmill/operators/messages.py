"""Messages of a thread: validity, repair before they are sent or stored, texts, what comes last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import trim
from leafmill.operators.chat import CANCELLED, OMITTED, PARTS, repair_dangling

STEER_CHARS, STEER_NOTES = 600, 4
SUBSTANTIAL = 8


def _part(kind: str, text: Column) -> Column:
    none = F.lit(None).cast("string")
    fields = [F.lit(kind).alias("type"), text.alias("text"), *[none.alias(n) for n in ("tool_name", "tool_call_id", "state", "input", "output")]]
    return F.array(F.struct(*fields)).cast(PARTS)


def normalized(messages: DataFrame) -> DataFrame:
    """Messages of a known role with an id and parts; one without parts but with `content`, if there is such a column, has that as its text part."""
    parts = F.col("parts")
    if "content" in messages.columns:
        parts = F.coalesce(parts, F.when(F.length("content") > 0, _part("text", F.col("content"))))
    kept = messages.withColumn("parts", parts).where("path is not null and id <> '' and role in ('user', 'assistant', 'system')").where(F.size("parts") > 0)
    return kept.drop("content")


def strip_files(messages: DataFrame, keep_last_user: bool = False) -> DataFrame:
    """User messages without file parts; one left without parts says a blank. With `keep_last_user` the last user message of a path keeps its own."""
    bare = F.filter("parts", lambda p: p.type != "file")
    some = F.when(F.size(bare) > 0, bare).otherwise(_part("text", F.lit(" ")))
    change = (F.col("role") == "user") & (F.size(bare) < F.size("parts"))
    if keep_last_user:
        last = F.max(F.when(F.col("role") == "user", F.struct("seq", "id"))).over(Window.partitionBy("path"))
        messages = messages.withColumn("_last", last)
        change &= ~F.coalesce(F.struct("seq", "id") == F.col("_last"), F.lit(False))
    return messages.withColumn("parts", F.when(change, some).otherwise(F.col("parts"))).drop("_last")


def last_messages(messages: DataFrame, role: str | None = None) -> DataFrame:
    """The last message of each path, or its last one of a role."""
    rows = messages if role is None else messages.where(F.col("role") == role)
    rest = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("seq", "id")).alias("_r")).select("path", "_r.*")


def awaiting(messages: DataFrame) -> DataFrame:
    """Per path whether it ends with a question, and the id of the answer it ends with, if it does."""
    last = last_messages(messages)
    return last.select("path", (F.col("role") == "user").alias("awaits"), F.when(F.col("role") == "assistant", F.col("id")).alias("in_flight"))


def substantial(parts: str = "parts", reasoning: bool = False, least: int = SUBSTANTIAL) -> Column:
    """Whether a text part (with `reasoning` also a reasoning part) has `least` characters after trimming; null parts have none."""
    kinds = ("text", "reasoning") if reasoning else ("text",)
    return F.coalesce(F.exists(parts, lambda p: p.type.isin(*kinds) & (F.length(trim(F.coalesce(p.text, F.lit("")))) >= least)), F.lit(False))


def user_text(parts: str = "parts") -> Column:
    """Text parts, trimmed, blank ones left out, line by line."""
    return _joined(parts, ("text",), "\n")


def assistant_text(parts: str = "parts") -> Column:
    """Text and reasoning parts, trimmed, blank ones left out, as paragraphs."""
    return _joined(parts, ("text", "reasoning"), "\n\n")


def _joined(parts: str, kinds: tuple[str, ...], sep: str) -> Column:
    texts = F.transform(F.filter(parts, lambda p: p.type.isin(*kinds)), lambda p: trim(F.coalesce(p.text, F.lit(""))))
    return F.coalesce(F.array_join(F.filter(texts, lambda t: F.length(t) > 0), sep), F.lit(""))


def tool_excerpts(parts: str = "parts", each: int = 1200, most: int = 6000) -> Column:
    """The first characters of each tool output, placeholders left out, between rules."""
    outs = F.transform(F.filter(parts, lambda p: F.startswith(p.type, F.lit("tool-")) & p.output.isNotNull()), lambda p: trim(p.output))
    live = F.filter(outs, lambda o: (F.length(o) > 0) & (o != CANCELLED) & ~F.endswith(o, F.lit(OMITTED)))
    return F.coalesce(F.substring(F.array_join(F.transform(live, lambda o: F.substring(o, 1, each)), "\n---\n"), 1, most), F.lit(""))


def for_send(messages: DataFrame) -> DataFrame:
    """Messages as they may be sent: valid, tool calls repaired, stale files out, and no answer without parts at the end. User messages always stay."""
    return strip_files(repair_dangling(normalized(messages)))


def sources(messages: DataFrame) -> DataFrame:
    """path, seq, id, ord, url and title of the distinct sources (parts of type source-url, the url in `input`, the title in `text`) of each message that may be opened, the first of each."""
    from leafmill.functions.text import safe_link  # noqa: PLC0415

    each = messages.select("path", "seq", "id", F.posexplode("parts").alias("ord", "p")).where("p.type = 'source-url'").select("path", "seq", "id", "ord", F.col("p.input").alias("url"), F.col("p.text").alias("title"))
    first = F.row_number().over(Window.partitionBy("path", "seq", "id", "url").orderBy("ord"))
    return each.where(safe_link(F.col("url"))).withColumn("rn", first).where("rn = 1").drop("rn")


def with_context(messages: DataFrame, hints: DataFrame) -> DataFrame:
    """Messages with each path's hint (path, hint) put behind the text of its newest user message, as a part of its own."""
    last = F.max(F.when(F.col("role") == "user", F.struct("seq", "id"))).over(Window.partitionBy("path"))
    both = messages.withColumn("_last", last).join(hints, "path", "left")
    here = F.coalesce(F.struct("seq", "id") == F.col("_last"), F.lit(False)) & (F.length("hint") > 0)
    return both.withColumn("parts", F.when(here, F.concat("parts", _part("text", F.col("hint")))).otherwise(F.col("parts"))).drop("_last", "hint")


def neighbours(messages: DataFrame) -> DataFrame:
    """path, seq, id and the ids before and after in the thread; null at its ends."""
    w = Window.partitionBy("path").orderBy("seq", "id")
    return messages.select("path", "seq", "id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def steer_notes(notes: DataFrame) -> DataFrame:
    """run, ord and text of the notes (run, at, text) that a run takes: trimmed, cut to 600, blank ones refused, the first four."""
    text = F.substring(trim(F.col("text")), 1, STEER_CHARS)
    live = notes.select("run", "at", text.alias("text")).where(F.length("text") > 0)
    return live.withColumn("ord", F.row_number().over(Window.partitionBy("run").orderBy("at", "text"))).where(F.col("ord") <= STEER_NOTES).select("run", "ord", "text")


def steer_body(notes: DataFrame) -> DataFrame:
    """Per run its notes as one text: one note as it is, several as a list."""
    every = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x.text)
    listed = notes.groupBy("run").agg(every.alias("xs"))
    return listed.select("run", F.when(F.size("xs") == 1, F.col("xs")[0]).otherwise(F.array_join(F.transform("xs", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("body"))


def signature(messages: DataFrame, head: int = 64) -> DataFrame:
    """Per path a fingerprint that changes when a message or part is added, goes, grows or begins otherwise."""
    part = lambda p: F.struct(p.type, p.state, F.length(p.text), F.substring(p.text, 1, head), F.length(p.output), F.substring(p.output, 1, head))
    each = messages.select("path", F.xxhash64("seq", "id", "role", F.to_json(F.transform("parts", part))).alias("h"))
    # A sum doesn't hang on the order of rows, and partial sums go before the shuffle.
    return each.groupBy("path").agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("signature"))
