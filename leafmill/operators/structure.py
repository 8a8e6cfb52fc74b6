"""Outlines: synthesis from headings, section ranges, the heading in force, lookup by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_heading, collapse, trim

MAX_ENTRIES = 1000


def plausible_heading(title: Column, level: Column) -> Column:
    """Whether a line marked as heading is one: 2 to 120 characters, begins with a letter or digit, has a letter; level 2 is held to more."""
    first = F.element_at(F.split(title, r"[ \t]+"), 1)
    return (
        F.length(title).between(2, 120)
        & title.rlike(r"^[\p{L}\p{N}]")
        & title.rlike(r"\p{L}")
        & ((level == 1) | first.rlike(r"^[0-9][0-9.]*$") | (~title.rlike("[:=]") & ~title.endswith(".") & (F.length(title) <= 80)))
    )


def synthesize(pages: DataFrame) -> DataFrame:
    """path, ord, title, page, level of the headings found in page texts; equal neighbours count once."""
    lines = pages.where(F.contains("text", F.lit("#"))).select("path", "page", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    marks = F.regexp_extract(F.col("raw"), r"^[ \t]*(#+)", 1)
    heads = lines.withColumn("level", F.length(marks)).where("level between 1 and 2").withColumn("title", clean_heading(F.regexp_replace("raw", r"^[ \t]*#+", "")))
    heads = heads.where(plausible_heading(F.col("title"), F.col("level")))
    w = Window.partitionBy("path").orderBy("page", "i")
    kept = heads.withColumn("before", F.lag("title").over(w)).where("before is null or before <> title")
    return kept.withColumn("ord", F.row_number().over(w) - 1).where(F.col("ord") < MAX_ENTRIES).select("path", "ord", "title", "page", "level")


def usable(outline: DataFrame, totals: DataFrame) -> DataFrame:
    """Entries with a title and a page from 1 on within the document; documents of unknown length (null or 0) set no end."""
    t = F.coalesce("total", F.lit(0))
    return outline.join(totals, "path", "left").where((F.length(trim(F.col("title"))) > 0) & (F.col("page") >= 1) & ((t <= 0) | (F.col("page") <= t))).select("path", "ord", "title", "page", "level", t.alias("total"))


def preferred(authored: DataFrame, synthesized: DataFrame) -> DataFrame:
    """Per path the authored outline if it has any entry, else the synthesized one."""
    cols = ["path", "ord", "title", "page", "level"]
    rest = synthesized.join(authored.select("path").distinct(), "path", "left_anti")
    return authored.select(*cols).unionByName(rest.select(*cols))


def section_ranges(outline: DataFrame) -> DataFrame:
    """path, ord, title, start_page, end_page; a section ends before the next entry of its level or above.

    Past the end of the document both are null; where its length is unknown a section ends on its own page.
    """
    # The next entry of a level no deeper: one window for each level that can end a section.
    w = Window.partitionBy("path").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    nxt = [F.first(F.when(F.col("level") <= k, F.col("page")), ignorenulls=True).over(w) for k in range(0, 7)]
    deepest = F.first("page", ignorenulls=True).over(w)
    by_level = F.when(F.col("level") > 6, deepest).otherwise(F.element_at(F.array(*nxt), F.greatest("level", F.lit(0)) + 1))
    total = F.col("total")
    end = F.when(total > 0, F.greatest(F.col("page"), F.least(F.coalesce(F.when(by_level.isNotNull(), F.greatest(F.col("page"), by_level - 1)), total), total))).otherwise(F.col("page"))
    past = (total > 0) & (F.col("page") > total)
    return outline.withColumn("e", end).select("path", "ord", "title", F.when(~past, F.col("page")).alias("start_page"), F.when(~past, F.col("e")).alias("end_page"))


def active_heading(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """path, page, ord and title of the heading in force on each page; null before the first.

    The outline is read in its order up to the first entry past the page, so entries that go back,
    as appendices bound in front, count only where nothing before them is past the page.
    """
    none = lambda t: F.lit(None).cast(t)
    # An entry is reached once the page is no lower than any entry before it or itself.
    reach = F.max("page").over(Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    h = outline.where("page is not null").withColumn("at", reach).select("path", F.col("at").alias("page"), F.lit(0).alias("side"), "ord", "title")
    p = pages.select("path", "page", F.lit(1).alias("side"), none("int").alias("ord"), none("string").alias("title"))
    w = Window.partitionBy("path").orderBy("page", "side", "ord").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("ord", "title")), ignorenulls=True).over(w)
    return h.unionByName(p).withColumn("h", last).where("side = 1").select("path", "page", "h.ord", "h.title")


def next_section(outline: DataFrame, read: DataFrame, chars: int = 60) -> DataFrame:
    """Per path of `read` (path, page) the title of the first entry past the last page read; paths without one have no row."""
    last = read.groupBy("path").agg(F.max("page").alias("last"))
    nxt = outline.join(last, "path").where("page > last").groupBy("path").agg(F.min_by("title", "ord").alias("title"))
    return nxt.where(F.length(trim(F.col("title"))) > 0).select("path", F.substring(trim(F.col("title")), 1, chars).alias("section"))


def flattened(bookmarks: DataFrame, most: int = 100) -> DataFrame:
    """Native bookmarks (path, ord in order of the walk, title, page, level) with titles collapsed and cut to 200, the first `most` of a path; pages may be null."""
    w = Window.partitionBy("path").orderBy("ord")
    t = F.substring(collapse(F.col("title")), 1, 200)
    kept = bookmarks.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return kept.select("path", (F.col("rn") - 1).alias("ord"), t.alias("title"), "page", "level")


def find_section(outline: DataFrame, query: str) -> DataFrame:
    """path and ord of the section that a title names: the first equal one, else the shortest that holds it or is held by it; blank titles never."""
    needle = query.strip().lower()
    title = F.lower(trim(F.col("title")))
    near = outline.withColumn("t", title).where((F.length("t") > 0) & (F.contains("t", F.lit(needle)) | F.contains(F.lit(needle), F.col("t"))))
    rank = F.struct((F.col("t") != needle).cast("int").alias("a"), F.when(F.col("t") == needle, 0).otherwise(F.length("title")).alias("b"), F.col("ord").alias("c"))
    return near.groupBy("path").agg(F.min_by("ord", rank).alias("ord"))
