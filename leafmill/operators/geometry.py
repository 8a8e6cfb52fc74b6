"""Places on pages: layouts, viewports, boxes, the text under links and regions.

Rectangles are structs of x, y, width and height in points. Those of links, figures and text items
are measured from the bottom left (rect_bl), those of marks and regions from the top left (rect_tl).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_heading, collapse, cut, trim

GAP = 16
PAGE_SIZE = (612.0, 792.0)
MIN_OVERLAP = 0.3
CONTEXT_CHARS = 200
MIN_FIGURE = 24
WIDTH_STEP = 32


def layout(sizes: DataFrame, scale: float, gap: int = GAP) -> DataFrame:
    """path, page, top, height, width of pages (path, page, width, height) set one under the other; a page that wasn't measured (null) has the size of the first that was."""
    every = Window.partitionBy("path")
    known = F.first(F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct("width", "height")), True).over(every.orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Half-way sizes are rounded up, as scripts in browsers do.
    px = lambda c, i: F.greatest(F.lit(1), F.floor(F.coalesce(c, known[("width", "height")[i]], F.lit(PAGE_SIZE[i])) * scale + 0.5)).cast("int")
    sized = sizes.select("path", "page", px(F.col("height"), 1).alias("height"), px(F.col("width"), 0).alias("width"))
    before = F.sum(F.col("height") + gap).over(every.orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return sized.select("path", "page", (F.coalesce(before, F.lit(0)) + gap).cast("int").alias("top"), "height", "width")


def _seen(laid: DataFrame, views: DataFrame, gap: int) -> DataFrame:
    """Views (path, view, scroll, height) with the pages of their path and how much of each is seen."""
    total = laid.groupBy("path").agg(F.max(F.col("top") + F.col("height") + gap).alias("total"), F.max("page").alias("pages"))
    v = views.select("path", "view", "scroll", F.greatest(F.lit(1), "height").alias("vh")).join(total, "path")
    end = F.col("top") + F.col("height")
    bottom = F.col("scroll") + F.col("vh")
    both = v.join(laid, "path").withColumn("seen", F.least(end, bottom) - F.greatest("top", "scroll"))
    return both.withColumn("whole", (F.col("top") >= F.col("scroll")) & (end <= bottom))


def page_at(laid: DataFrame, views: DataFrame, gap: int = GAP) -> DataFrame:
    """path, view and the page a view is on: the last at the end of the column, else the first seen as a whole, else the one seen most, the upper of equals."""
    seen = _seen(laid, views, gap)
    at_end = (F.col("total") > F.col("vh")) & (F.col("scroll") >= F.col("total") - F.col("vh") - 1)
    best = seen.groupBy("path", "view").agg(
        F.max(F.when(at_end, F.col("pages"))).alias("end"),
        F.min(F.when(F.col("whole") & (F.col("seen") > 0), F.col("page"))).alias("whole"),
        F.max_by("page", F.when(F.col("seen") > 0, F.struct("seen", (-F.col("page")).alias("p")))).alias("most"),
        F.max(F.when((F.col("page") == F.col("pages")) & (F.col("scroll") >= F.col("top")), F.col("pages"))).alias("past"),
    )
    return best.select("path", "view", F.coalesce("end", "whole", "most", "past", F.lit(1)).alias("page"))


def visible_pages(laid: DataFrame, views: DataFrame, overscan: int = 1, gap: int = GAP) -> DataFrame:
    """path, view, first and last page to draw: those seen, or the page a view is on, and `overscan` pages around."""
    seen = _seen(laid, views, gap).groupBy("path", "view").agg(F.min(F.when(F.col("seen") > 0, F.col("page"))).alias("a"), F.max(F.when(F.col("seen") > 0, F.col("page"))).alias("b"), F.max("pages").alias("pages"))
    both = seen.join(page_at(laid, views, gap), ["path", "view"])
    return both.select("path", "view", F.greatest(F.lit(1), F.coalesce("a", "page") - overscan).alias("first"), F.least("pages", F.coalesce("b", "page") + overscan).alias("last"))


def relayout_shift(before: DataFrame, after: DataFrame, views: DataFrame, gap: int = GAP) -> DataFrame:
    """path, view and how far to scroll after a new layout so that the page a view was on stays; 0 where the number of pages changed."""
    counts = before.groupBy("path").agg(F.count("*").alias("n")).join(after.groupBy("path").agg(F.count("*").alias("m")), "path")
    tops = before.select("path", "page", F.col("top").alias("t0")).join(after.select("path", "page", F.col("top").alias("t1")), ["path", "page"])
    at = page_at(before, views, gap).join(views.select("path", "view", "scroll"), ["path", "view"]).join(counts, "path").join(tops, ["path", "page"], "left")
    return at.select("path", "view", F.when((F.col("n") == F.col("m")) & F.col("t0").isNotNull() & F.col("t1").isNotNull(), F.greatest(-F.col("scroll"), F.col("t1") - F.col("t0"))).otherwise(0).alias("shift"))


def page_offset(laid: DataFrame, targets: DataFrame, gap: int = GAP) -> DataFrame:
    """path, page and the scroll that brings the page (the nearest one there is) to the top."""
    ends = laid.groupBy("path").agg(F.max("page").alias("pages"))
    near = targets.join(ends, "path").withColumn("at", F.least("pages", F.greatest(F.lit(1), "page")))
    return near.join(laid.select("path", F.col("page").alias("at"), "top"), ["path", "at"]).select("path", "page", F.greatest(F.lit(0), F.col("top") - gap).alias("scroll"))


def fit_scale(sizes: DataFrame, container: float, padding: float) -> DataFrame:
    """path and the scale at which its widest page fills the container; 1 where no page was measured."""
    widest = sizes.groupBy("path").agg(F.max("width").alias("w"))
    return widest.select("path", F.when(F.col("w") > 0, F.greatest(F.lit(1.0), F.lit(float(container - 2 * padding))) / F.col("w")).otherwise(1.0).alias("scale"))


def quantized_width(width: Column, step: int = WIDTH_STEP) -> Column:
    """A width rounded to whole steps, one at least."""
    return F.greatest(F.lit(step), (F.floor(width / step + 0.5) * step).cast("int"))


def flipped(rect: Column, view_top: Column) -> Column:
    """A rectangle measured from the other end of the page: top left to bottom left and back."""
    return F.struct(rect.x.alias("x"), (view_top - rect.y - rect.height).alias("y"), rect.width.alias("width"), rect.height.alias("height"))


def share_box(rect: Column, width: Column, height: Column) -> Column:
    """A rectangle from the top left as shares of the page, within 0 to 1."""
    clamp = lambda v: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double"))), F.lit(0.0))
    return F.struct(clamp(rect.x / width).alias("left"), clamp(rect.y / height).alias("top"), clamp(rect.width / width).alias("width"), clamp(rect.height / height).alias("height"))


def covered_share(a: Column, b: Column) -> Column:
    """How much of rectangle a lies in b, as a share of a's area; 0 where they don't meet or a is empty."""
    w = F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y)
    area = a.width * a.height
    return F.when((w > 0) & (h > 0) & (area > 0), (w * h / area).cast("double")).otherwise(0.0)


def link_context(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links (path, ord, page, url, rect_bl) with the line of text (path, page, ord, text, rect_bl) that covers most of them, three tenths at least, the first of equals; cleaned and cut. No line gives ''."""
    lines = items.select("path", "page", F.col("ord").alias("line"), "text", F.col("rect_bl").alias("box"))
    met = links.select("path", "page", "ord", "rect_bl").join(lines, ["path", "page"]).withColumn("share", covered_share(F.col("rect_bl"), F.col("box"))).where(F.col("share") >= MIN_OVERLAP)
    best = met.groupBy("path", "ord").agg(F.max_by("text", F.struct("share", (-F.col("line")).alias("l"))).alias("text"))
    text = cut(collapse(clean_heading(F.col("text"))), CONTEXT_CHARS)
    return links.join(best.select("path", "ord", text.alias("context")), ["path", "ord"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def live_items(items: DataFrame) -> DataFrame:
    """Text items that say something: non-blank, with a width and a height."""
    return items.where((F.length(trim(F.col("text"))) > 0) & (F.col("rect_bl.width") > 0) & (F.col("rect_bl.height") > 0))


def region_texts(regions: DataFrame, items: DataFrame) -> DataFrame:
    """path, region and the text of the items whose middle lies in the region (path, region, page, rect_bl), line by line; '' where there is none. Pages count from 1."""
    x, y = F.col("i.x") + F.col("i.width") / 2, F.col("i.y") + F.col("i.height") / 2
    r = F.col("rect_bl")
    met = regions.where("page >= 1").join(items.select("path", "page", "ord", "text", F.col("rect_bl").alias("i")), ["path", "page"]).where((x >= r.x) & (x <= r.x + r.width) & (y >= r.y) & (y <= r.y + r.height))
    got = met.groupBy("path", "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda t: t.text), "\n").alias("text"))
    return regions.where("page >= 1").select("path", "region").join(got, ["path", "region"], "left").fillna("", ["text"])


def figures_on(figures: DataFrame) -> DataFrame:
    """Figures (path, ord, page, rect_bl) large enough to be some, numbered on their page from the largest, the first of equals."""
    big = figures.where((F.col("rect_bl.width") >= MIN_FIGURE) & (F.col("rect_bl.height") >= MIN_FIGURE))
    w = Window.partitionBy("path", "page").orderBy(F.desc(F.col("rect_bl.width") * F.col("rect_bl.height")), "ord")
    return big.withColumn("index", F.row_number().over(w))


def read_figure(figures: DataFrame, page: int, index: int, describe=None) -> DataFrame:
    """path, page, index and the description of one figure of each path; `describe` is a column function of its rectangle, since images are described elsewhere."""
    one = figures_on(figures).where((F.col("page") == page) & (F.col("index") == index))
    text = describe(F.col("rect_bl")) if describe is not None else F.lit("")
    return one.select("path", "page", "index", text.alias("description"))


def line_boxes(rects: DataFrame, least: float = 1.0, most: int = 200) -> DataFrame:
    """Of each selection (selection, ord, rect, bound) the first `most` rectangles larger than a point, or its bounding box where there are none."""
    w = Window.partitionBy("selection").orderBy("ord")
    live = rects.where((F.col("rect.width") > least) & (F.col("rect.height") > least)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("selection", "ord", "rect")
    rest = rects.join(live.select("selection").distinct(), "selection", "left_anti").groupBy("selection").agg(F.min_by("bound", "ord").alias("rect")).select("selection", F.lit(0).alias("ord"), "rect")
    return live.unionByName(rest)
