"""Full-text search over pages and messages."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import SPACE, SPACES, collapse, nfc, plain_text, trim
from leafmill.operators.pages import ranges, sparse


#: What may not be in composed form, or grows in small letters: marks, old Hangul, letters that stand for others.
UNCOMPOSED = "[\\p{M}İ\u1100-\u11ff\u1f71-\u1ffd\u2126\u212a\u212b\u2329\u232a\uf900-\ufaff]"
HIT = "array<struct<idx: int, match: string, snippet: string>>"
_SPACES = re.compile(f"[{SPACE}]+")


def fold(text: str) -> tuple[str, list[int] | None]:
    """`text` in small letters, each sign by itself, and for each of its signs the place in `text`; None where the places agree."""
    low = "".join([c.lower() for c in text]) if not text.isascii() else text.lower()
    if len(low) == len(text):
        return low, None
    return low, [i for i, c in enumerate(text) for _ in c.lower()]


def hits_in(text: str, needle: str, radius: int = 80) -> list[tuple[int, str, str]]:
    """Place (from 0), match and snippet of each hit in a composed text; hits don't overlap."""
    low, places = fold(text)
    out, at = [], low.find(needle)
    while at >= 0:
        end = at + len(needle)
        i, j = (at, end) if places is None else (places[at], places[end - 1] + 1)
        start = max(0, i - radius)
        out.append((i, text[i:j], ("…" if start else "") + _SPACES.sub(" ", text[start : j + radius]).strip(SPACES)))
        at = low.find(needle, end)
    return out


def hits(pages: DataFrame, query: str) -> DataFrame:
    """path, page, idx (from 0), match and snippet of each hit of `query` in the plain text of the pages.

    Texts are composed, whatever the query, and case is ignored sign by sign; places are those in the
    composed text, also where small letters are longer (İ). Hits don't overlap. A blank query and
    null texts have no hits. Pages without the query are dropped before Python sees them.
    """
    q = "".join([c.lower() for c in unicodedata.normalize("NFC", query.strip())])
    if not q:
        return pages.sparkSession.createDataFrame([], "path string, page int, idx int, match string, snippet string")

    @F.pandas_udf(HIT)
    def found(plain: pd.Series) -> pd.Series:
        return plain.map(lambda t: [{"idx": i, "match": m, "snippet": s} for i, m, s in hits_in(unicodedata.normalize("NFC", t), q)])

    def may(x: Column) -> Column:
        return F.contains(F.lower(x), F.lit(q)) | ((F.octet_length(x) > F.length(x)) & x.rlike(UNCOMPOSED))

    # Inside the array a text is made plain once, however often the test looks at it.
    kept = F.filter(F.array(plain_text(F.col("text"))), may)
    some = pages.where("text is not null").select("path", "page", F.explode(kept).alias("plain"))
    return some.select("path", "page", F.explode(found("plain")).alias("h")).select("path", "page", "h.*")


def count_hits(pages: DataFrame, query: str) -> DataFrame:
    """Per path the hits and the distinct pages with one."""
    return hits(pages, query).groupBy("path").agg(F.count("*").alias("hits"), F.count_distinct("page").alias("pages"))


def top_hits(pages: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """The first `limit` hits of each path in reading order, and whether it has more."""
    w = Window.partitionBy("path").orderBy("page", "idx")
    probed = hits(pages, query).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit + 1)
    more = F.max("rn").over(Window.partitionBy("path")) > limit
    return probed.withColumn("truncated", more).where(F.col("rn") <= limit).select("path", "rn", "page", "idx", "match", "snippet", "truncated")


def message_hits(messages: DataFrame, query: str, before: int = 30, after: int = 60) -> DataFrame:
    """path, seq, id, idx and excerpt of the first hit in each message's visible text."""
    needle = unicodedata.normalize("NFC", query.strip()).lower()
    text = nfc(F.array_join(F.transform(F.filter("parts", lambda p: p.type == "text"), lambda p: p.text), "\n"))
    at = messages.select("path", "seq", "id", text.alias("t")).withColumn("idx", F.locate(needle, F.lower("t")) - 1).where((F.col("idx") >= 0) & F.lit(bool(needle)))
    start = F.greatest(F.lit(0), F.col("idx") - before)
    end = F.least(F.length("t"), F.col("idx") + len(needle) + after)
    cut = trim(F.substring("t", start + 1, end - start))
    return at.select("path", "seq", "id", "idx", F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length("t"), "…").otherwise("")).alias("excerpt"))


def preview(found: DataFrame, most: int = 2, chars: int = 48) -> DataFrame:
    """Per path the pages with hits and its first hits as one line: `p.3: the lease…; p.5: ...`."""
    raw = collapse(F.col("snippet"))
    bit = F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(": "), F.substring(raw, 1, chars), F.when(F.length(raw) > chars, "…").otherwise(""))
    w = Window.partitionBy("path").orderBy("page", "idx")
    first = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", bit.alias("b")))), lambda x: x.b), "; ").alias("snippets"))
    pages = found.groupBy("path").agg(F.count_distinct("page").alias("pages"))
    return pages.join(first, "path").select("path", "pages", "snippets", F.concat(F.lit("Matches on "), F.col("pages").cast("string"), F.lit(" page(s) — "), "snippets").alias("message"))


def with_unindexed(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds to hits the number and ranges of the pages of their path that hold no text to search."""
    blank = sparse(pages, None)
    missing = ranges(blank, out="unindexed_pages").join(blank.groupBy("path").agg(F.count("*").alias("unindexed_count")), "path")
    both = found.join(missing, "path", "left")
    return both.withColumns({"unindexed_count": F.coalesce("unindexed_count", F.lit(0).cast("bigint")), "unindexed_pages": F.coalesce("unindexed_pages", F.lit(""))})


def step_match(count: Column, current: Column, direction: int) -> Column:
    """The next match in a direction (1 or -1), from the other end past the last; -1 where there is none."""
    to = current + direction
    return F.when(count == 0, -1).when(to < 0, count - 1).when(to >= count, 0).otherwise(to)


def items_matching(items: DataFrame, queries: DataFrame, most: int = 60) -> DataFrame:
    """Of each path and page the first `most` text items (path, page, ord, text) that hold the page's query (path, page, query), case ignored; blank queries have none."""
    q = F.lower(trim(F.col("query")))
    met = items.join(queries, ["path", "page"]).where((F.length(q) > 0) & F.contains(F.lower("text"), q))
    w = Window.partitionBy("path", "page", "query").orderBy("ord")
    return met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def commands_matching(commands: DataFrame, query: str) -> DataFrame:
    """Commands (label, section, keywords, disabled) that are not disabled and hold every word of the query."""
    hay = F.lower(F.concat_ws(" ", "label", "section", "keywords"))
    live = commands.where(~F.coalesce("disabled", F.lit(False)))
    for token in query.lower().split():
        live = live.where(F.contains(hay, F.lit(token)))
    return live
