"""Documents as a whole: loading, stamps, links, what a read brings along, model abilities, answers of other services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import cut, document_kind, has_text, safe_link
from leafmill.operators.pages import MIN_TEXT_CHARS, merge_reload

MAX_FILE_BYTES = 256 << 20
LINKS_A_PAGE = 40
SNIPPET = 120


def files(spark: SparkSession, folder: str, most_bytes: int = MAX_FILE_BYTES, content: bool = True) -> DataFrame:
    """path, kind, stamp and content of the files below a folder that can be opened; larger ones are refused before they are read. Without `content` only stamps are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    known = raw.where(F.col("length") <= most_bytes).select("path", document_kind(F.col("path")).alias("kind"), stamp(F.col("modificationTime"), F.col("length")).alias("stamp"), *(["content"] if content else []))
    return known.where("kind is not null")


def stamp(modified: Column, size: Column) -> Column:
    """What tells one state of a file from another: time of its last change and its size; '' where either is unknown."""
    return F.coalesce(F.concat(F.unix_millis(modified).cast("string"), F.lit(":"), size.cast("string")), F.lit(""))


def load(pages: DataFrame, documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages (path, page, text, source) of documents (path, stamp) that can be opened, with the cached texts (path, page, text, stamp) of the same state merged in.

    Images are one empty page. A document without a stamp bypasses the cache.
    """
    known = documents.select("path", "stamp").dropDuplicates(["path"]).withColumn("kind", document_kind(F.col("path"))).where("kind is not null")
    images = known.where("kind = 'image'").select("path", F.lit(1).alias("page"), F.lit("").alias("text"), F.lit(None).cast("string").alias("source"))
    fresh = pages.select("path", "page", "text", "source").join(known.where("kind = 'pdf'").select("path"), "path", "left_semi").unionByName(images)
    kept = cache.join(known.where("stamp <> ''").select("path", "stamp"), ["path", "stamp"], "left_semi").select("path", "page", "text", F.lit("vision").alias("source"))
    return merge_reload(kept, fresh)


def recognised(pages: DataFrame, read: Callable[[Column], Column], cap: int | None = None) -> DataFrame:
    """Pages with the texts that a reader of images gives for those of fewer than 20 characters, at most `cap` of a path; `read` is a column function of the page's key, as the images are read elsewhere."""
    need = ~has_text(F.col("text"), MIN_TEXT_CHARS)
    w = Window.partitionBy("path").orderBy("page")
    turn = F.sum(need.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    chosen = need if cap is None else need & (turn <= cap)
    marked = pages.withColumn("_c", chosen).withColumn("_r", F.when(F.col("_c"), read(F.struct("path", "page"))))
    got = F.col("_c") & (F.length(F.coalesce("_r", F.lit(""))) > 0)
    return marked.withColumns({"text": F.when(got, F.col("_r")).otherwise(F.col("text")), "source": F.when(got, "vision").otherwise(F.col("source"))}).drop("_c", "_r")


def links_on(links: DataFrame, pages: DataFrame, most: int = LINKS_A_PAGE) -> DataFrame:
    """path, page, url and context of the links (path, ord, page, url, context) on the pages (path, page) that a read delivered: safe ones, each url once a page, `most` of a page; an empty context is null."""
    once = F.row_number().over(Window.partitionBy("path", "page", "url").orderBy("ord"))
    place = F.row_number().over(Window.partitionBy("path", "page").orderBy("ord"))
    met = links.where(safe_link(F.col("url"))).join(pages.select("path", "page").distinct(), ["path", "page"], "left_semi").withColumn("n", once).where("n = 1")
    return met.withColumn("n", place).where(F.col("n") <= most).select("path", "page", F.col("n").alias("ord"), "url", F.nullif("context", F.lit("")).alias("context"))


def linked_pages(links: DataFrame) -> DataFrame:
    """path and page of pages with a link that may be opened."""
    return links.where(safe_link(F.col("url"))).select("path", "page").distinct()


def marks_on(marks: DataFrame, pages: DataFrame, chars: int = SNIPPET) -> DataFrame:
    """path, page, ord, text (cut) and note (whole) of the marks on the pages that a read delivered."""
    met = marks.join(pages.select("path", "page").distinct(), ["path", "page"], "left_semi")
    place = F.row_number().over(Window.partitionBy("path", "page").orderBy("created_at", "id"))
    return met.select("path", "page", place.alias("ord"), cut(F.coalesce("text", F.lit("")), chars).alias("text"), F.nullif("note", F.lit("")).alias("note"))


def attachment_chars(links: DataFrame, marks: DataFrame) -> DataFrame:
    """path, page and chars: what the links and marks of each page cost a read, as the length of their JSON."""
    cost = lambda df, *cols: df.select("path", "page", (F.length(F.to_json(F.struct("page", *cols))) + 1).alias("chars"))
    return cost(links, "url", "context").unionByName(cost(marks, "text", "note")).groupBy("path", "page").agg(F.sum("chars").alias("chars"))


def json_chars(*columns: str) -> Column:
    """Characters of the JSON of some columns, null ones left out: what a result costs."""
    return F.length(F.to_json(F.struct(*columns)))


def abilities(models: DataFrame, known: DataFrame) -> DataFrame:
    """provider, model, vision and tools of models by what is known (key, vision, tools): the model itself, its name without its tag, or the longest known family that its name begins with; null where unknown.

    Families end at a hyphen, so a name is looked up under its beginnings and joined by equality.
    """
    low = F.lower(F.trim(F.regexp_replace("model", ":.*$", "")))
    parts = F.split(low, "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    keys = F.concat(F.array(F.struct(F.lit(1).alias("exact"), F.col("model").alias("key"))), F.transform(heads, lambda h: F.struct(F.lit(0).alias("exact"), h.alias("key"))))
    met = models.select("provider", "model", F.explode(keys).alias("k")).select("provider", "model", "k.*").join(known, "key")
    best = met.groupBy("provider", "model").agg(F.max_by(F.struct("vision", "tools"), F.struct("exact", F.length("key"))).alias("b")).select("provider", "model", "b.*")
    return models.select("provider", "model").distinct().join(best, ["provider", "model"], "left")


def looks_visual(model: Column) -> Column:
    """Whether the name of an unknown model says that it sees."""
    return F.lower(F.regexp_replace(model, ":.*$", "")).rlike("(^|[-_/])(vl|vision|llava|bakllava|minicpm-v|pixtral|moondream|gemma)")


def completion_text(body: Column) -> Column:
    """The answer in a completion: its content as a string, or the texts of its parts on end; '' where there is none."""
    content = F.get_json_object(body, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text: string>>")
    return F.trim(F.coalesce(F.when(content.startswith("["), F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, F.lit(""))), "")), content, F.lit("")))


def completion_usage(body: Column) -> Column:
    """Input and output tokens of a completion, under either spelling; null where not told."""
    at = lambda k: F.get_json_object(body, f"$.usage.{k}").try_cast("int")
    return F.struct(F.coalesce(at("prompt_tokens"), at("input_tokens")).alias("input_tokens"), F.coalesce(at("completion_tokens"), at("output_tokens")).alias("output_tokens"))


def error_text(body: Column) -> Column:
    """What an error body says: the provider's own words, else its message (with the provider's name where it says nothing); null for others."""
    at = lambda p: F.nullif(F.trim(F.get_json_object(body, p)), F.lit(""))
    empty = "provider returned error"
    raw, said, who = at("$.error.metadata.raw"), F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.message")), at("$.error.metadata.provider_name")
    said = F.nullif(F.trim(said), F.lit(""))
    named = F.when((F.lower(said) == empty) & who.isNotNull(), F.concat(said, F.lit(" ("), who, F.lit(")"))).otherwise(said)
    return F.coalesce(F.when(F.lower(raw) != empty, raw), named)


#: Arguments of tools that are numbers.
NUMERIC = ("page", "start", "end", "offset", "maxChars", "maxResults", "index")


def tool_input(input: Column) -> Column:
    """The numbers of a tool's input, written as numbers or as strings, with an inverted range turned round and its offset dropped; null for what isn't given or no number."""
    n = {k: F.get_json_object(input, f"$.{k}").try_cast("double").cast("int") for k in NUMERIC}
    turned = F.coalesce(n["start"] > n["end"], F.lit(False))
    fixed = {**n, "start": F.when(turned, n["end"]).otherwise(n["start"]), "end": F.when(turned, n["start"]).otherwise(n["end"]), "offset": F.when(turned, 0).otherwise(n["offset"])}
    return F.struct(*[c.alias(k) for k, c in fixed.items()])


def follow_ups(facts: DataFrame, most: int = 3, share: float = 0.25) -> DataFrame:
    """path, ord and kind of what may be asked next (path, section, unindexed_count, mark_count, read_count, total_pages): the next section, a scan, a look at the marks, the whole document; `most` of them."""
    n = lambda c: F.coalesce(c, F.lit(0))
    seen = F.when(n("total_pages") > 0, n("read_count") / F.col("total_pages")).otherwise(1.0)
    kinds = F.array_compact(F.array(F.when(F.length("section") > 0, "nextSection"), F.when(n("unindexed_count") > 0, "scanUnindexed"), F.when(n("mark_count") > 0, "compareMarks"), F.when((n("total_pages") > 1) & (seen < share), "wholeDocument")))
    return facts.select("path", F.posexplode(F.slice(kinds, 1, most)).alias("ord", "kind"))
