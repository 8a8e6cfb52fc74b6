"""Page tables: latest state, flags, surveys, ranges, merges, running lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_heading, collapse, has_text, trim
from leafmill.plans import cut

MIN_TEXT_CHARS = 20
RASTER_CHARS = 48
CHUNK_CHARS = 6000
DENSEST = 5
SWEEP_CAP = 50
REPLACE_RATIO = 1.25
RUNNING_MIN_PAGES, RUNNING_MAX_CHARS = 3, 80


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by `order`, which no two rows share, of each key; keys may be null.

    The winners are found on keys and order alone, by a hash aggregate; their rows are then picked by
    a hash of the winners, so texts are shuffled once and never sorted.
    """
    return _picked(rows, rows.groupBy(*keys).agg(F.max(order).alias(order)).select(order), order)


def earliest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As `latest`, the first row."""
    return _picked(rows, rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order), order)


def _picked(rows: DataFrame, winners: DataFrame, order: str) -> DataFrame:
    return rows.join(winners.hint("shuffle_hash"), order, "left_semi")


def flags(pages: DataFrame) -> DataFrame:
    """Whether each row's text can be indexed, is that of a raster-heavy page, or holds a table; null text is empty."""
    return pages.select("row_id", has_text(F.col("text"), MIN_TEXT_CHARS).alias("indexable"), (F.coalesce(F.length("text"), F.lit(0)) < RASTER_CHARS).alias("raster_heavy"), F.coalesce(F.contains("text", F.lit("|---")), F.lit(False)).alias("table"))


def sparse(pages: DataFrame, cap: int | None = SWEEP_CAP) -> DataFrame:
    """The first `cap` pages of each path with fewer than 20 trimmed characters; None is no cap."""
    few = pages.where(~has_text(F.col("text"), MIN_TEXT_CHARS)).select("path", "page")
    if cap is None:
        return few
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("page"))).where(F.col("rn") <= cap).drop("rn")


def ranges(rows: DataFrame, key: str = "path", page: str = "page", out: str = "pages") -> DataFrame:
    """Per key the distinct pages as text, runs compressed: `51-53, 80`. Null pages don't count."""
    distinct = rows.where(F.col(page).isNotNull()).select(key, F.col(page).alias("_p")).distinct()
    runs = distinct.withColumn("_g", F.col("_p") - F.row_number().over(Window.partitionBy(key).orderBy("_p"))).groupBy(key, "_g").agg(F.min("_p").alias("a"), F.max("_p").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("t")))), lambda x: x.t), ", ").alias(out))


def sizes(pages: DataFrame) -> DataFrame:
    """Pages without their texts: chars, sparse and table in place of `text`; null text is empty."""
    measured = pages.withColumns({"chars": F.coalesce(F.length("text"), F.lit(0)), "sparse": ~has_text(F.col("text"), MIN_TEXT_CHARS), "table": F.coalesce(F.contains("text", F.lit("|---")), F.lit(False))})
    return measured.drop("text")


def densest(pages: DataFrame, k: int = DENSEST) -> DataFrame:
    """path, page, chars of the k longest pages of each path; ties go to the lower page. Each task keeps its own k of a path before rows are shuffled."""
    sized = pages if "chars" in pages.columns else sizes(pages)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("chars"), "page"))
    return sized.select("path", "page", "chars").withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


def survey(pages: DataFrame, marked: DataFrame, linked: DataFrame | None = None, figured: DataFrame | None = None) -> DataFrame:
    """Per path: pages, characters, need of chunking, and unindexed, densest, table and marked pages as ranges ('' if none); with `linked` and `figured` (path, page) also those.

    `pages` are those of `sizes`: no text takes part. They are written once, since three parts of the
    survey read them.
    """
    pages = cut(pages)
    base = pages.groupBy("path").agg(F.count("*").alias("total_pages"), F.sum("chars").alias("total_chars"), F.count_if("sparse").alias("unindexed_count"))
    kinds = F.array_compact(F.array(*[F.when(F.col(c), F.lit(k)) for c, k in (("sparse", 0), ("table", 2))]))
    each = pages.select("path", "page", F.explode(kinds).alias("kind")).unionByName(densest(pages).select("path", "page", F.lit(1).alias("kind")))
    for k, extra in ((3, marked), (4, linked), (5, figured)):
        if extra is not None:
            each = each.unionByName(extra.select("path", "page", F.lit(k).alias("kind")))
    found = ranges(each.where("path is not null").select(F.struct("path", "kind").alias("k"), "page"), "k")
    order = {"unindexed_pages": 0, "densest_pages": 1, "table_pages": 2, "marked_pages": 3, "link_pages": 4, "figure_pages": 5}
    names = [n for n, e in zip(order, (pages, pages, pages, marked, linked, figured), strict=True) if e is not None]
    wide = found.groupBy(F.col("k.path").alias("path")).agg(*[F.max(F.when(F.col("k.kind") == order[n], F.col("pages"))).alias(n) for n in names])
    return base.join(wide, "path", "left").select("path", "total_pages", "total_chars", (F.col("total_chars") > CHUNK_CHARS).alias("needs_chunking"), "unindexed_count", *[F.coalesce(n, F.lit("")).alias(n) for n in names])


def previews(pages: DataFrame, most: int = 200, chars: int = 60) -> DataFrame:
    """path, page, chars and the first characters, collapsed, of the first `most` pages of each path."""
    w = Window.partitionBy("path").orderBy("page")
    head = pages.select("path", "page", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.substring(collapse(F.substring(F.coalesce("text", F.lit("")), 1, 20 * chars)), 1, chars).alias("preview"))
    return head.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def recovered(pages: DataFrame, fallback: DataFrame) -> DataFrame:
    """Pages whose text is blank get that of the second extraction (path, page, text) if it has any; other pages stay untouched and don't meet it."""
    blank = pages.where(~has_text(F.col("text")))
    other = fallback.select("path", "page", F.nullif(trim(F.col("text")), F.lit("")).alias("_t"))
    mended = blank.join(other, ["path", "page"], "left").withColumn("text", F.coalesce("_t", "text")).drop("_t")
    return pages.where(has_text(F.col("text"))).unionByName(mended)


def empty_pages(pages: DataFrame) -> DataFrame:
    """path and page of the pages that an export leaves out: those of null or blank text."""
    return pages.where(~has_text(F.col("text"))).select("path", "page")


def better_text(a: Column, b: Column, a_source: Column, b_source: Column) -> Column:
    """Whether incoming text b beats existing text a: paid text first, then usable text, then 1.25 times the length."""
    n, m = F.length(trim(a)), F.length(trim(b))
    paid_a, paid_b = a_source.eqNullSafe("vision") & (n >= MIN_TEXT_CHARS), b_source.eqNullSafe("vision") & (m >= MIN_TEXT_CHARS)
    return (
        F.when(paid_a != paid_b, paid_b)
        .when((n >= MIN_TEXT_CHARS) & (m < MIN_TEXT_CHARS), False)
        .when((m >= MIN_TEXT_CHARS) & (n < MIN_TEXT_CHARS), True)
        .when((n >= MIN_TEXT_CHARS) & (m >= MIN_TEXT_CHARS), m > n * REPLACE_RATIO)
        .otherwise(m >= n)
    )


def merge_reload(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pages after a reload: path, page, text, source. The winner keeps its source; pages gone stay if they have usable text."""
    e = existing.select("path", "page", F.col("text").alias("et"), F.col("source").alias("es"), F.lit(True).alias("old"))
    i = incoming.select("path", "page", F.coalesce("text", F.lit("")).alias("it"), F.col("source").alias("is"), F.lit(True).alias("new"))
    both = e.join(i, ["path", "page"], "full_outer").withColumn("et", F.coalesce("et", F.lit("")))
    wins = better_text(F.col("et"), F.col("it"), F.col("es"), F.col("is"))
    text = F.when(F.col("new").isNull(), F.col("et")).when(wins, F.col("it")).otherwise(F.col("et"))
    kept = both.where(F.col("new").isNotNull() | (F.length(trim(F.col("et"))) >= MIN_TEXT_CHARS)).withColumn("text", text)
    source = F.when(F.col("new").isNull() | (F.col("old").isNotNull() & (F.col("text") == F.col("et"))), F.col("es")).otherwise(F.col("is"))
    return kept.select("path", "page", "text", source.alias("source"))


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per path whether two states of its pages differ in text or in which pages there are."""
    x = a.select("path", "page", F.coalesce("text", F.lit("")).alias("x"))
    y = b.select("path", "page", F.coalesce("text", F.lit("")).alias("y"))
    return x.join(y, ["path", "page"], "full_outer").groupBy("path").agg(F.bool_or(~F.col("x").eqNullSafe(F.col("y"))).alias("changed"))


def _edges(pages: DataFrame) -> DataFrame:
    """path, page, pos (first, last) and key of the lines that may run: of pages with three live lines, no headings or table rows, keys of 1 to 80 characters."""
    live = F.filter(F.split("text", "\n"), lambda x: has_text(x))
    lines = pages.select("path", "page", live.alias("live")).where(F.size("live") >= 3)
    edges = lines.select("path", "page", F.explode(F.array(F.struct(F.lit("first").alias("pos"), F.element_at("live", 1).alias("line")), F.struct(F.lit("last").alias("pos"), F.element_at("live", -1).alias("line")))).alias("e"))
    key = F.lower(clean_heading(F.col("e.line")))
    return edges.where(~F.col("e.line").rlike(r"^[ \t]*[#|]")).select("path", "page", "e.pos", key.alias("key")).where(F.length("key").between(1, RUNNING_MAX_CHARS))


def _running(edges: DataFrame) -> DataFrame:
    return edges.groupBy("path", "pos", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= RUNNING_MIN_PAGES)


def running_keys(pages: DataFrame) -> DataFrame:
    """path, position (first, last), key and pages of lines that open or close three pages of a path or more."""
    return _running(_edges(pages))


def strip_running(pages: DataFrame) -> DataFrame:
    """path, page, text without running first and last lines; other pages keep their text untouched.

    The edges of all pages, without their texts, are written once; running ones are joined back by
    path, position and key, and only pages that lose a line are then rewritten.
    """
    edges = cut(_edges(pages))
    lost = edges.join(_running(edges).select("path", "pos", "key"), ["path", "pos", "key"]).groupBy("path", "page").agg(F.bool_or(F.col("pos") == "first").alias("h"), F.bool_or(F.col("pos") == "last").alias("f"))
    lines = F.split("text", "\n")
    where = F.filter(F.transform(lines, lambda x, i: F.when(has_text(x), i)), lambda i: i.isNotNull())
    both = pages.join(lost, ["path", "page"], "left")
    kept = F.transform(F.array(where), lambda at: F.filter(lines, lambda x, i: ~((F.col("h") & (i == F.element_at(at, 1))) | (F.col("f") & (i == F.element_at(at, -1))))))[0]
    return both.select("path", "page", F.when(F.col("h").isNotNull(), trim(F.array_join(kept, "\n"))).otherwise(F.col("text")).alias("text"))
