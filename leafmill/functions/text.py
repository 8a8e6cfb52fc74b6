"""Text columns: trimming, Markdown, snippets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as scripts in browsers have it; valid inside a class in Java and RE2 patterns.
SPACE = " \t\n\r\f\v\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same signs one by one.
SPACES = SPACE.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def has_text(c: Column, least: int = 1) -> Column:
    """Whether a text has `least` characters between its first and last that are no white space; null counts as empty. Stops at the first that show it, without trimming."""
    pattern = f"[^{SPACE}]" if least < 2 else f"(?s)[^{SPACE}].{{{least - 2},}}?[^{SPACE}]"
    return F.coalesce(c.rlike(pattern), F.lit(False))


def collapse(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form; null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def clean_heading(c: Column) -> Column:
    """A heading without underline tags, bold marks and backticks."""
    for mark in ("<u>", "</u>", "**", "`"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return trim(c)


def plain_line(c: Column) -> Column:
    """One Markdown line as plain text; null for a table row without content."""
    t = trim(c)
    inner = F.when(t.endswith("|") & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.substring(t, F.lit(2), F.length(t)))
    cells = F.split(inner, r"\|")
    row = F.when(F.forall(cells, lambda x: x.rlike(r"^[ \t]*:?-+:?[ \t]*$")), F.lit(None).cast("string")).otherwise(F.nullif(F.array_join(F.transform(cells, trim), " "), F.lit("")))
    x = c
    # What Markdown marks a line with, in the order in which it goes.
    for pattern, to in (
        (r"^[ \t]{0,3}#{1,6}[ \t]+", ""),
        (r"^[ \t]{0,3}[-*+][ \t]+", ""),
        (r"^[ \t]{0,3}>[ \t]?", ""),
        (r"\*\*(.*?)\*\*", "$1"),
        (r"(^|\W)\*(\S(?:.*?\S)?)\*(?=\W|$)", "$1$2"),
        (r"`([^`]*)`", "$1"),
        (r"</?u>", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.when(t.startswith("|"), row).otherwise(x)


def plain_text(c: Column) -> Column:
    """Markdown as plain text: table rows become cells joined by spaces, syntax goes, prose stays; null stays null."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), plain_line), lambda x: x.isNotNull()), "\n")


def snippet(text: Column, index: Column, size: Column, radius: int = 80) -> Column:
    """`radius` characters around a match (index from 0), collapsed; an ellipsis leads if text was cut before it."""
    start = F.greatest(F.lit(0), index - radius)
    chunk = collapse(F.substring(text, start + 1, index + size + radius - start))
    return F.when(start > 0, F.concat(F.lit("…"), chunk)).otherwise(chunk)


def cut(c: Column, most: int) -> Column:
    """At most `most` characters, with an ellipsis behind what was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def for_prompt(c: Column, most: int = 200) -> Column:
    """A name that can stand between quotes in a prompt: no control signs, plain quotes, collapsed, cut with an ellipsis."""
    x = F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f]", " ")
    quotes = "\"“”„‟`"
    return cut(collapse(F.translate(x, quotes, "'" * len(quotes))), most)


def without_leaked_markup(c: Column) -> Column:
    """Text without tool markup that a model leaked: from the first such tag on to the last one; prose that names it stays."""
    tag = r"</?\s*(?:[|｜]\s*)+DSML\s*(?:[|｜]\s*)+[^>]*>"
    return trim(F.regexp_replace(c, rf"(?s){tag}(?:.*{tag})?", ""))


def display_url(c: Column, most: int = 72) -> Column:
    """A URL for display, its head kept."""
    t = trim(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def safe_link(url: Column) -> Column:
    """Whether a URL has a scheme that may be opened: http, https or mailto; relative and null ones have none."""
    return F.coalesce(F.lower(F.regexp_extract(trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin("http", "https", "mailto"), F.lit(False))


def link_label(context: Column, url: Column) -> Column:
    """What a link is shown as: its context and URL, or the URL alone."""
    return F.when(F.length(F.coalesce(context, F.lit(""))) > 0, F.concat(context, F.lit(" — "), url)).otherwise(url)


def region_text(table: Column, text: Column, most: int = 500) -> Column:
    """What a boxed region says: its table as it is, else its text without image marks, collapsed; cut with an ellipsis."""
    t = trim(F.coalesce(table, F.lit("")))
    prose = collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[Image:[^\]]*\]", " "))
    return cut(F.when(F.length(t) > 0, t).otherwise(prose), most)


def quote(table: Column, selected: Column, most: int = 500) -> Column:
    """What a selection is quoted as: the table under it as it is, else the selected text."""
    t = trim(F.coalesce(table, F.lit("")))
    return cut(F.when(F.length(t) > 0, t).otherwise(collapse(F.coalesce(selected, F.lit("")))), most)


#: File types that can be opened, and those of them that are images.
IMAGES = ("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "gif")
TYPES = ("pdf", *IMAGES)


def extension(path: Column) -> Column:
    """The file type in small letters, '' without a dot in the name."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\\\]*)$", 1))


def document_kind(path: Column) -> Column:
    """pdf, image, or null for what can't be opened."""
    e = extension(path)
    return F.when(e == "pdf", "pdf").when(e.isin(*IMAGES), "image")


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\\\]*)$", 1)


def page_cache_key(key: Column) -> Column:
    """path, page, scale, quality and dpr of a cache key, read from its end, as paths may hold its sign; null for a key of less than five parts."""
    parts = F.split(key, r"\|")
    n = F.size(parts)
    at = lambda k: F.try_element_at(parts, F.lit(-k))
    path = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 4, F.lit(0))), "|")
    return F.when(n >= 5, F.struct(path.alias("path"), at(4).alias("page"), at(3).alias("scale"), at(2).alias("quality"), at(1).alias("dpr")))


def duration(ms: Column) -> Column:
    """Milliseconds as `850ms` or `1.3s`, halves rounded up; a dash for null and negative ones."""
    return F.when(ms.isNull() | (ms < 0), "—").when(ms < 1000, F.concat(F.round(ms).cast("bigint").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms.cast("double") / 1000))


def compact_count(n: Column) -> Column:
    """A count as `850`, `2.5k` or `25k`, halves rounded up; a dash for null."""
    r = F.round(n).cast("bigint")
    return F.when(n.isNull(), "—").when(r < 1000, r.cast("string")).when(r < 10_000, F.format_string("%.1fk", r.cast("double") / 1000)).otherwise(F.concat(F.floor(r.cast("double") / 1000 + 0.5).cast("string"), F.lit("k")))


def speed(tokens_per_s: Column) -> Column:
    """Tokens a second as `472.0 T/s`; a dash where unknown."""
    return F.when(tokens_per_s > 0, F.format_string("%.1f T/s", tokens_per_s.cast("double"))).otherwise("—")


def clamp(value: Column, fallback: int, most: int) -> Column:
    """A stored setting as a whole number from 0 to `most`; `fallback` for null and what is no number."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v), fallback).otherwise(F.greatest(F.lit(0), F.least(F.floor(v), F.lit(most)))).cast("int")


#: Chinese digits and units.
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
_NUM = f"[0-9０-９{''.join([*CN_DIGITS, *CN_UNITS])}]+"
#: How prompts name ranges of pages and single pages.
PAGE_RANGES = (re.compile(rf"第\s*({_NUM})\s*(?:到|至|-|~|—|－)\s*({_NUM})\s*页"), re.compile(r"pages?\s*([0-9]{1,4})\s*(?:-|–|—|~|to)\s*([0-9]{1,4})", re.I))
PAGE_SINGLES = (re.compile(rf"第\s*({_NUM})\s*页"), re.compile(r"pages?\s*([0-9]{1,4})", re.I), re.compile(r"\bp\.\s*([0-9]{1,4})\b", re.I), re.compile(r"\bp\s*([0-9]{1,4})\b", re.I))
MOST_SPAN = 200


def number_of(token: str) -> int | None:
    """A number in digits, full-width ones too, or in Chinese numerals; null for others."""
    plain = token.translate({0xFF10 + i: str(i) for i in range(10)})
    if plain.isascii() and plain.isdigit():
        return int(plain)
    total = last = 0
    for c in token:
        if c in CN_DIGITS:
            last = CN_DIGITS[c]
        elif c in CN_UNITS:
            total, last = total + (last or 1) * CN_UNITS[c], 0
        else:
            return None
    return total + last if token else None


def pages_named(text: str) -> list[int]:
    """The pages a prompt names, each once: ranges first, then single ones; of ranges of more than 200 pages and of inverted ones the ends."""
    out: dict[int, None] = {}
    for pattern in PAGE_RANGES:
        for m in pattern.finditer(text):
            a, b = number_of(m[1]), number_of(m[2])
            whole = a is not None and b is not None and 0 < a <= b <= a + MOST_SPAN
            out.update(dict.fromkeys(range(a, b + 1) if whole else (n for n in (a, b) if n)))
    for pattern in PAGE_SINGLES:
        out.update(dict.fromkeys(n for m in pattern.finditer(text) if (n := number_of(m[1]))))
    return list(out)


def page_numbers(c: Column) -> Column:
    """Column of `pages_named`; null stays null. Texts without a digit or numeral don't reach Python."""

    @F.pandas_udf("array<int>")
    def named(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else pages_named(t))

    some = c.rlike("(?i)page|p\\.|p\\s*[0-9]|页")
    return F.when(c.isNotNull(), F.coalesce(named(F.when(some, c)), F.array().cast("array<int>")))
