"""Marks, findings, caches and recents: validation, order, revisions, staleness, export."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import collapse, cut, document_kind, has_text, nfc, trim

FINDING_PAGES, CLAIM_CHARS, EVIDENCE_CHARS = 20, 500, 1000
MARK_TEXT, MARK_NOTE, MARKS_PER_DOC = 500, 2000, 2000


def sanitize_marks(marks: DataFrame) -> DataFrame:
    """Valid marks once per path and id (the first to arrive), texts cut, in order of page and time, at most 2,000 a path."""
    ok = marks.where("path is not null and id is not null and id <> '' and page >= 1 and size(rects) > 0 and (kind is null or kind = 'region')")
    first = ok.withColumn("rn", F.row_number().over(Window.partitionBy("path", "id").orderBy("row_id"))).where("rn = 1")
    w = Window.partitionBy("path").orderBy("page", "created_at", "row_id")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= MARKS_PER_DOC).select("path", "pos", "id", "page", F.substring("text", 1, MARK_TEXT).alias("text"), F.substring("note", 1, MARK_NOTE).alias("note"), F.coalesce("kind", F.lit("text")).alias("kind"))


def findings_once(findings: DataFrame) -> DataFrame:
    """Findings, one for each path and id: of rows that differ the first made, and of these the least. Absent author and struck get their defaults."""
    rest = [c for c in findings.columns if c not in ("path", "id")]
    first = F.struct("created_at", F.to_json(F.struct(*rest)))
    one = findings.groupBy("path", "id").agg(F.min_by(F.struct(*rest), first).alias("_r")).select("path", "id", *[F.col(f"_r.{c}").alias(c) for c in rest])
    return one.withColumns({"struck": F.coalesce("struck", F.lit(False)), "author": F.coalesce("author", F.lit("assistant"))})


def sanitize_findings(findings: DataFrame, most: int = 500) -> DataFrame:
    """Valid findings (an id, a claim, pages) with texts cut and pages normal, the first `most` of a path by time."""
    ok = findings_once(findings.where("path is not null and id <> ''")).withColumn("pages", normal_pages()).where((F.size("pages") > 0) & (F.length(trim(F.col("claim"))) > 0))
    w = Window.partitionBy("path").orderBy("created_at", "id")
    cut = ok.withColumns({"claim": F.substring("claim", 1, CLAIM_CHARS), "evidence": F.substring("evidence", 1, EVIDENCE_CHARS), "pos": F.row_number().over(w)})
    return cut.where(F.col("pos") <= most)


def sanitize_index(docs: DataFrame, version: int = 1) -> DataFrame:
    """Stored page texts (version, path, stamp, total_pages, pages array<struct<page, text>>, saved_at, ord) that can be used.

    Other versions and rows without path, stamp or pages go; of a repeated path the first valid row
    counts, and goes too if none of its pages has a text.
    """
    ok = docs.where((F.col("version") == version) & (F.length("path") > 0) & F.col("stamp").isNotNull() & F.col("pages").isNotNull() & F.col("saved_at").isNotNull())
    rest = [c for c in ok.columns if c not in ("path", "version", "ord")]
    first = ok.groupBy("path").agg(F.min_by(F.struct(*rest), "ord").alias("_r")).select("path", "_r.*")
    live = F.filter("pages", lambda p: (p.page >= 1) & (F.length(p.text) > 0))
    return first.withColumn("pages", live).where(F.size("pages") > 0)


def marks_stale(marks: DataFrame, current: DataFrame) -> DataFrame:
    """`stale` for marks."""
    return stale(marks, current)


def on_page(rows: DataFrame, page: int) -> DataFrame:
    """Marks on a page (column page), or findings on it (column pages)."""
    return rows.where(F.array_contains("pages", page)) if "pages" in rows.columns else rows.where(F.col("page") == page)


def ordered(rows: DataFrame) -> DataFrame:
    """Marks by page and time, findings by time, each with its place `pos` in its path."""
    by = ["created_at", "id"] if "pages" in rows.columns else ["page", "created_at", "id"]
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy(*by)))


def active(findings: DataFrame) -> DataFrame:
    """Findings not struck and not superseded; a struck revision still hides what it revised."""
    newer = findings.where("supersedes is not null").select("path", F.col("supersedes").alias("id")).distinct()
    return findings.where(~F.coalesce("struck", F.lit(False))).join(newer, ["path", "id"], "left_anti")


def normal_pages(c: str = "pages"):
    """Column: the distinct pages from 1 in order, at most 20; null counts as none."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda p: p.isNotNull() & (p >= 1)))), 1, FINDING_PAGES)


def add_findings(store: DataFrame, new: DataFrame, most: int = 500) -> DataFrame:
    """New rows (path, id, pages, claim, supersedes, created_at) that may be recorded.

    Pages and claim must not be empty; a revision must be of an id known before and not revised yet,
    and of several in `new` the first by time counts; a path takes no more than `most` in all. A null
    id is made of the row.
    """
    known = store.select("path", F.col("id").alias("supersedes")).distinct()
    taken = store.where("supersedes is not null").select("path", "supersedes").distinct()
    order = [F.col("created_at") if "created_at" in new.columns else F.lit(0), F.col("id")]
    made = F.concat(F.lit("f_"), F.hex(F.xxhash64("path", "claim", F.to_json("pages"), "supersedes")))
    ok = new.withColumn("id", F.coalesce("id", made)).withColumn("pages", normal_pages()).where((F.size("pages") > 0) & (F.length(trim(F.col("claim"))) > 0)).withColumn("claim", F.substring(trim(F.col("claim")), 1, CLAIM_CHARS))
    first = F.row_number().over(Window.partitionBy("path", "supersedes").orderBy(*order))
    revised = ok.where("supersedes is not null").join(known, ["path", "supersedes"], "left_semi").join(taken, ["path", "supersedes"], "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")
    every = ok.where("supersedes is null").unionByName(revised)
    held = store.groupBy("path").agg(F.count("*").alias("_held"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    return every.withColumn("_n", place).join(held, "path", "left").where(F.col("_n") + F.coalesce("_held", F.lit(0)) <= most).drop("_n", "_held")


def stale(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Per path whether any row has another stamp than the file's; without a stamp nothing is stale."""
    return rows.join(current, "path").groupBy("path").agg(F.bool_or((F.col("now") != "") & (F.col("stamp") != F.col("now"))).alias("stale"))


def filter_rows(rows: DataFrame, columns: list[str], query: str, page: int | None = None) -> DataFrame:
    """Rows with `query` in the joined columns, composed and case ignored, with `page` only those on it; a blank query keeps all."""
    if page is not None:
        rows = on_page(rows, page)
    q = unicodedata.normalize("NFC", query.strip()).lower()
    return rows if not q else rows.where(F.contains(F.lower(nfc(F.concat_ws("\n", *columns))), F.lit(q)))


def recents(opened: DataFrame, cap: int = 10) -> DataFrame:
    """The `cap` paths opened last."""
    return opened.groupBy("path").agg(F.max("opened_at").alias("opened_at")).orderBy(F.desc("opened_at"), "path").limit(cap)


def openable(rows: DataFrame) -> DataFrame:
    """Rows whose path is of a type that can be opened."""
    return rows.where(document_kind(F.col("path")).isNotNull())


def path_list(first: DataFrame, second: DataFrame, most: int = 64) -> DataFrame:
    """path and ord of two lists (path, ord) one after the other, each path at its first place, the last `most` of them."""
    both = first.select("path", F.struct(F.lit(0), "ord").alias("o")).unionByName(second.select("path", F.struct(F.lit(1), "ord").alias("o")))
    tail = both.groupBy("path").agg(F.min("o").alias("o")).orderBy(F.desc("o")).limit(most)
    return tail.select("path", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("o")).alias("ord"))  # `most` rows


def prune_chats(chats: DataFrame, keep: DataFrame, cap: int = 100) -> DataFrame:
    """Chats (path, inserted) that stay: those of `keep`, and of the others the newest until there are `cap` in all.

    Each task keeps its own `cap` newest, so neither a count nor a growing list comes to one place.
    """
    known = chats.join(keep.select("path"), "path", "left_semi").withColumn("kept", F.lit(True))
    newest = chats.join(keep.select("path"), "path", "left_anti").orderBy(F.desc("inserted"), F.desc("path")).limit(cap).withColumn("kept", F.lit(False))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("kept"), F.desc("inserted"), F.desc("path"))  # `cap` rows and those of `keep`
    return known.unionByName(newest).withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= cap) | F.col("kept")).drop("rn", "kept")


def forgotten(index: DataFrame, dropped: DataFrame) -> DataFrame:
    """Cached pages without those of `dropped` (path, and page unless whole documents go)."""
    return index.join(dropped, [c for c in ("path", "page") if c in dropped.columns], "left_anti")


def reindexed(pages: DataFrame, index: DataFrame, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """Pages and cached pages when documents are indexed anew: of the first `cap` pages of a path texts that came by vision are cleared, and the cache loses just these pages."""
    w = Window.partitionBy("path").orderBy("page")
    ranked = pages.withColumn("_n", F.row_number().over(w))
    window = ranked.where(F.col("_n") <= cap).select("path", "page")
    cleared = ranked.withColumn("text", F.when((F.col("_n") <= cap) & F.col("source").eqNullSafe("vision"), "").otherwise(F.col("text"))).drop("_n")
    return cleared, forgotten(index, window)


def cache_totals(pages: DataFrame) -> DataFrame:
    """docs, pages and chars of cached pages (path, chars)."""
    return pages.agg(F.count_distinct("path").alias("docs"), F.count("*").alias("pages"), F.sum("chars").alias("chars"))


def outline_marks(marks: DataFrame, most: int = 100, chars: int = 120) -> DataFrame:
    """path, pos, page, text (cut) and note of the marks of paths that have no more than `most`."""
    counted = marks.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("path")
    return ordered(marks.join(counted, "path", "left_semi")).select("path", "pos", "page", cut(F.col("text"), chars).alias("text"), "note")


def record_lines(findings: DataFrame, budget: int = 2000, chars: int = 300) -> DataFrame:
    """Per path the newest active findings that fit a prompt, as lines in order of time, and how many older ones were left out."""
    line = F.concat(F.lit("- "), cut(collapse(F.col("claim")), chars), F.lit(" (p. "), F.array_join("pages", ", "), F.lit(")"))
    rows = active(findings).select("path", "id", "created_at", line.alias("line"))
    w = Window.partitionBy("path").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("used", F.sum(F.length("line") + 1).over(w)).withColumn("fits", F.col("used") <= budget)
    lines = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("created_at", "id", "line"))))
    return kept.groupBy("path").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("lines"), F.count_if(~F.col("fits")).alias("omitted"))


def export_blocks(pages: DataFrame, documents: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """path, ord and block of the Markdown of each document, in order: heading, marks, non-blank pages under page comments.

    One row a block, so no document is ever one value; `documents` (path, name, title) gives the headings.
    """
    body = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"), trim(F.col("text")))
    out = pages.where(has_text(F.col("text"))).select("path", F.struct(F.lit(2).alias("a"), F.col("page").cast("bigint").alias("b")).alias("o"), body.alias("block"))
    if documents is not None:
        title = F.nullif(trim(F.coalesce("title", F.lit(""))), F.lit(""))
        head = F.concat(F.lit("# "), F.coalesce(title, F.col("name")), F.when(title != F.col("name"), F.concat(F.lit("\n\n**Source:** "), "name")).otherwise(""))
        out = out.unionByName(documents.select("path", F.struct(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b")).alias("o"), head.alias("block")))
    if marks is not None:
        item = F.concat(F.when(F.col("pos") == 1, "## Marks\n\n").otherwise(""), F.lit("- **p. "), F.col("page").cast("string"), F.lit("** — "), F.coalesce(F.nullif("text", F.lit("")), F.lit("(no text)")), F.when(F.length("note") > 0, F.concat(F.lit("\n  - "), "note")).otherwise(""))
        out = out.unionByName(ordered(marks).select("path", F.struct(F.lit(1).alias("a"), F.col("pos").cast("bigint").alias("b")).alias("o"), item.alias("block")))
    return out.select("path", F.col("o.a").alias("part"), F.col("o.b").alias("ord"), "block")


def chat_blocks(messages: DataFrame) -> DataFrame:
    """path, seq, id and block of the Markdown of each thread: a heading for who speaks and the text; tool steps or an image where there is none; other empty messages are left out."""
    from leafmill.operators.messages import user_text  # noqa: PLC0415

    text = user_text()
    tools = F.size(F.filter("parts", lambda p: F.startswith(p.type, F.lit("tool-"))))
    image = F.exists("parts", lambda p: p.type == "file")
    who = F.when(F.col("role") == "user", "You").otherwise("Assistant")
    body = F.when(F.length(text) > 0, text).when((F.col("role") == "assistant") & (tools > 0), F.concat(F.lit("_"), tools.cast("string"), F.lit(" tool step(s)_"))).when((F.col("role") == "user") & image, "_(image attachment)_")
    return messages.select("path", "seq", "id", who.alias("who"), body.alias("body")).where("body is not null").select("path", "seq", "id", F.concat(F.lit("## "), "who", F.lit("\n\n"), "body").alias("block"))


def summary_markdown(title: Column, overview: Column, bullets: Column) -> Column:
    """A summary as Markdown: heading, overview, points; absent parts are left out."""
    points = F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), overview, F.nullif(points, F.lit("")))


def write_blocks(blocks: DataFrame, target: str) -> None:
    """Writes blocks (path, part, ord, block) as text, one folder a path; the files of a folder in the order of their names are the document. A long document is spread over several tasks."""
    parts = blocks.withColumn("document", F.hex(F.encode("path", "utf-8")))
    parts.repartitionByRange("document", "part", "ord").sortWithinPartitions("document", "part", "ord").select("document", F.concat("block", F.lit("\n")).alias("value")).write.partitionBy("document").mode("overwrite").text(target)
