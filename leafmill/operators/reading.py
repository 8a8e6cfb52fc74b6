"""Budgeted selection: a prefix with a partial last row, whole rows until one does not fit, and greedy with skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import has_text
from leafmill.operators.pages import MIN_TEXT_CHARS, ranges

RANGE_CHARS = 6000
RUN_CHARS = 200_000
SEPARATOR = 2
ALREADY_READ = "[already returned in full earlier in this turn]"


def page_slices(pages: DataFrame, max_chars: int = RANGE_CHARS) -> DataFrame:
    """Every page of each path in slices of `max_chars`: path, page, offset, text, chars, truncated and next_offset (null at the end). Null and empty texts are one empty slice."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    each = pages.select("path", "page", t.alias("t"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(max_chars))).alias("offset"))
    part = F.substring(F.col("t"), F.col("offset") + 1, F.lit(max_chars))
    more = F.length("t") > F.col("offset") + max_chars
    return each.select("path", "page", "offset", part.alias("text"), F.length(part).alias("chars"), more.alias("truncated"), F.when(more, F.col("offset") + max_chars).alias("next_offset"))


def read_ranges(pages: DataFrame, asked: DataFrame, max_chars: int = RANGE_CHARS, used: int = 0, budget: int = RUN_CHARS, delivered: DataFrame | None = None, scans: int | None = None, attached: DataFrame | None = None) -> DataFrame:
    """Reads pages first_page..last_page of each path of `asked` (path, first_page, last_page, offset) in order, within `max_chars` and what is left of the run's `budget`.

    Columns: path, text, char_count (with headers and separators), charged (texts and attachments
    alone), end_page, next_page and next_offset (where to go on; null if all came), truncated,
    budget_exceeded, unscanned (ranges of pages skipped since their scan was not allowed) and pages
    (those whose text came). Each page has a header, `(cont.)` in it where it begins at an offset. The
    first page that doesn't fit is cut and ends the result. Whole pages of `delivered` (path, page)
    are pointed at, for no charge. Pages of fewer than 20 trimmed characters need a scan; beyond
    `scans` of them they are skipped and the walk goes on. `attached` (path, page, chars) is what links
    and marks of a page cost; it is charged at the end. Only sizes take part in the running sums;
    texts are fetched for the pages that fit.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    blank = ~has_text(F.col("text"), MIN_TEXT_CHARS)
    rows = pages.select("path", "page", n.alias("n"), blank.alias("blank")).join(asked, "path").where(F.col("page").between(F.col("first_page"), F.col("last_page")))
    if delivered is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        rows = rows.join(delivered.select("path", "page", F.lit(True).alias("known")).distinct(), ["path", "page"], "left").fillna(False, ["known"])
    w = Window.partitionBy("path").orderBy("page")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    scan = F.sum(F.col("blank").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("skip", F.lit(False) if scans is None else F.col("blank") & (scan > scans))
    shift = F.when(F.col("page") == F.col("first_page"), F.least("offset", "n")).otherwise(0)
    rows = rows.withColumn("shift", shift).withColumn("rest", F.col("n") - F.col("shift")).withColumn("known", F.col("known") & (F.col("shift") == 0))
    frame = F.length(F.col("page").cast("string")) + len("--- Page  ---\n") + F.when(F.col("shift") > 0, len(" (cont.)")).otherwise(0)
    before = F.coalesce(F.sum((~F.col("skip")).cast("int")).over(earlier), F.lit(0))
    rows = rows.withColumn("frame", F.when(F.col("skip"), 0).otherwise(frame + F.when(before > 0, SEPARATOR).otherwise(0)))
    body = F.when(F.col("skip"), 0).when(F.col("known"), len(ALREADY_READ)).otherwise(F.col("rest"))
    charge = F.when(F.col("skip") | F.col("known"), 0).otherwise(F.col("rest"))
    rows = rows.withColumn("so_far", F.coalesce(F.sum(F.col("frame") + body).over(earlier), F.lit(0))).withColumn("spent", F.lit(used) + F.coalesce(F.sum(charge).over(earlier), F.lit(0)))
    by_size, by_budget = F.lit(max_chars) - F.col("so_far") - F.col("frame"), F.lit(budget) - F.col("spent") - F.col("frame")
    rows = rows.withColumn("room", F.least(by_size, by_budget)).withColumn("tight", by_budget <= by_size).withColumn("over", F.col("spent") >= budget)
    # Sums before the first page that ends the walk are right, whatever they are behind it.
    ends = F.col("over") | (~F.col("skip") & ((F.col("room") <= 0) | (F.col("rest") > F.col("room"))))
    stop = F.min(F.when(ends, F.col("page"))).over(Window.partitionBy("path"))
    rows = rows.withColumn("ends", ends).withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
    out = F.col("ends") & (F.col("over") | (F.col("room") <= 0))
    rows = rows.withColumn("took", F.when(F.col("skip") | out, F.lit(None)).when(F.col("ends"), F.col("room")).when(F.col("known"), 0).otherwise(F.col("rest"))).withColumn("known", F.col("known") & ~F.col("ends"))
    fits = rows.where("took is not null").select("path", "page", "shift", "took", "known", "frame", "ends")
    header = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.when(F.col("shift") > 0, " (cont.)").otherwise(""), F.lit(" ---\n"))
    part = F.when(F.col("known"), F.lit(ALREADY_READ)).otherwise(F.substring(F.coalesce("text", F.lit("")), F.col("shift") + 1, F.col("took").cast("int")))
    fetched = fits.join(pages.select("path", "page", "text"), ["path", "page"]).select("*", F.concat(header, part).alias("x"), F.length(part).alias("m"))
    got = fetched.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "x"))), lambda p: p.x), "\n\n").alias("text"),
        F.sum(F.col("frame") + F.col("m")).alias("char_count"),
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("m"))).alias("charged"),
        F.max("page").alias("end_page"),
        F.array_sort(F.collect_list(F.when(~F.col("known"), F.col("page")))).alias("pages"),
    )
    end = rows.where("ends").select("path", F.col("page").alias("next_page"), F.when(F.col("over"), F.when(F.col("page") == F.col("first_page"), F.col("offset")).otherwise(0)).otherwise(F.col("shift") + F.coalesce("took", F.lit(0))).cast("int").alias("next_offset"), (F.col("over") | F.col("tight")).alias("budget_exceeded"))
    skipped = ranges(rows.where("skip and not (ends and over)"), out="unscanned")
    both = asked.select("path").distinct().join(got, "path", "left").join(end, "path", "left").join(skipped, "path", "left")
    if attached is not None:
        cost = both.select("path", F.explode("pages").alias("page")).join(attached, ["path", "page"]).groupBy("path").agg(F.sum("chars").alias("_a"))
        both = both.join(cost, "path", "left").withColumn("charged", F.coalesce("charged", F.lit(0)) + F.coalesce("_a", F.lit(0))).drop("_a")
    zero = F.lit(0).cast("bigint")
    return both.select("path", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("char_count", zero).alias("char_count"), F.coalesce("charged", zero).alias("charged"), "end_page", "next_page", "next_offset", F.col("next_page").isNotNull().alias("truncated"), F.coalesce("budget_exceeded", F.lit(False)).alias("budget_exceeded"), F.coalesce("unscanned", F.lit("")).alias("unscanned"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))


def read_range(pages: DataFrame, first: int, last: int, max_chars: int = RANGE_CHARS, offset: int = 0, **limits) -> DataFrame:
    """`read_ranges` of the same pages of each path; an inverted range is turned round and begins at its first page's start."""
    if first > last:
        first, last, offset = last, first, 0
    asked = pages.select("path").where("path is not null").distinct().select("path", F.lit(first).alias("first_page"), F.lit(last).alias("last_page"), F.lit(offset).alias("offset"))
    return read_ranges(pages, asked, max_chars, **limits)


def read_section(pages: DataFrame, outline: DataFrame, title: str, max_chars: int = RANGE_CHARS, offset: int = 0, **limits) -> DataFrame:
    """Reads the section that `title` names in each path: the columns of `read_ranges` and section, its title. Paths without it have no row."""
    from leafmill.operators.structure import find_section, section_ranges  # noqa: PLC0415

    named = find_section(outline, title).join(section_ranges(outline), ["path", "ord"]).where("start_page is not null")
    asked = named.select("path", F.col("start_page").alias("first_page"), F.col("end_page").alias("last_page"), F.lit(offset).alias("offset"))
    return read_ranges(pages, asked, max_chars, **limits).join(named.select("path", F.col("title").alias("section")), "path")


def keep_prefix(rows: DataFrame, key: str, order: list[Column], cost: Column, budget: int, min_keep: int = 0) -> DataFrame:
    """Rows of each key in `order` while the running cost is within `budget`; the first `min_keep` always."""
    w = Window.partitionBy(key).orderBy(*order)
    total = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_t", total).withColumn("_n", F.row_number().over(w)).where((F.col("_t") <= budget) | (F.col("_n") <= min_keep)).drop("_t", "_n")


def evict_greedy(rows: DataFrame, key: str, item: str, size: str, newest: str, max_items: int, max_chars: int, protected: str | None = None) -> DataFrame:
    """Items of each key that stay, newest first: one that does not fit is skipped and later smaller ones are tried; the item `protected` always stays and counts.

    The choice depends on each earlier one, so it is a fold; it looks at (item, size, time) alone, not at contents.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(newest)).alias("o"), F.col(item).alias("i"), F.col(size).cast("bigint").alias("s"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("c"), F.array().cast("array<string>").alias("k"))

    def step(acc: Column, x: Column) -> Column:
        fits = ((acc.n < max_items) & (acc.c + x.s <= max_chars)) | (x.i == F.lit(protected or ""))
        return F.struct(F.when(fits, acc.n + 1).otherwise(acc.n).alias("n"), F.when(fits, acc.c + x.s).otherwise(acc.c).alias("c"), F.when(fits, F.concat(acc.k, F.array(x.i))).otherwise(acc.k).alias("k"))

    return rows.groupBy(key).agg(ordered.alias("xs")).select(key, F.explode(F.aggregate("xs", zero, step).k).alias(item))
