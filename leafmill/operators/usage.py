"""Token usage and times of runs: steps, totals, index calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import compact_count, duration, speed


def step_usage(events: DataFrame) -> DataFrame:
    """One row for each message and step of usage events (msg, step, input_tokens, output_tokens, cached_tokens, tool_names, ts): the last known value of each column."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return events.groupBy("msg", "step").agg(last("input_tokens"), last("output_tokens"), last("cached_tokens"), last("tool_names"), F.max("ts").alias("ended_at"))


def step_times(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds duration_ms: since the step before, of the first step since the run began (msg, started_at); never below 0."""
    w = Window.partitionBy("msg").orderBy("step")
    both = steps.join(starts, "msg", "left")
    before = F.coalesce(F.lag("ended_at").over(w), "started_at", "ended_at")
    return both.withColumn("duration_ms", F.greatest(F.lit(0), F.col("ended_at") - before)).drop("started_at")


def message_usage(steps: DataFrame) -> DataFrame:
    """Per message its steps and token sums; null counts as 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return steps.groupBy("msg").agg(F.count("*").alias("steps"), total("input_tokens"), total("output_tokens"), total("cached_tokens"))


def index_usage(calls: DataFrame) -> DataFrame:
    """Per path the image calls of indexing and the tokens they took (path, input_tokens, output_tokens); null counts as 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return calls.groupBy("path").agg(F.count("*").alias("calls"), total("input_tokens"), total("output_tokens"))


def agent_totals(totals: DataFrame, index: DataFrame) -> DataFrame:
    """Tokens of the agent alone: those of a path's totals less those of indexing, never below 0."""
    i = index.select("path", F.col("input_tokens").alias("_i"), F.col("output_tokens").alias("_o"))
    both = totals.join(i, "path", "left")
    less = lambda c, d: F.greatest(F.lit(0), F.col(c) - F.coalesce(d, F.lit(0))).alias(c)
    return both.select("path", less("input_tokens", "_i"), less("output_tokens", "_o"))


def timings(runs: DataFrame) -> DataFrame:
    """msg, total_ms, first_token_ms and tokens_per_s of runs (msg, started_at, first_token_at, finished_at, output_tokens); null where a time is missing or no token came."""
    since = F.coalesce("first_token_at", "started_at")
    ms = F.col("finished_at") - since
    return runs.select(
        "msg",
        F.when(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(), F.greatest(F.lit(0), F.col("finished_at") - F.col("started_at"))).alias("total_ms"),
        F.when(F.col("started_at").isNotNull() & F.col("first_token_at").isNotNull(), F.greatest(F.lit(0), F.col("first_token_at") - F.col("started_at"))).alias("first_token_ms"),
        F.when(F.col("started_at").isNotNull() & (F.col("output_tokens") > 0) & (ms > 0), F.col("output_tokens") / (ms / 1000)).alias("tokens_per_s"),
    )


def stamp_finished(messages: DataFrame, now: int) -> DataFrame:
    """Messages whose answers were begun and never finished get `now` as their end."""
    m = F.col("metadata")
    open_ = (F.col("role") == "assistant") & m.started_at.isNotNull() & m.finished_at.isNull()
    return messages.withColumn("metadata", F.when(open_, m.withField("finished_at", F.lit(now).cast("bigint"))).otherwise(m))


def labels(totals: DataFrame) -> DataFrame:
    """Totals of paths as they are shown: input, output, time and speed."""
    return totals.select("path", compact_count(F.col("input_tokens")).alias("input"), compact_count(F.col("output_tokens")).alias("output"), duration(F.col("duration_ms")).alias("time"), speed(F.col("tokens_per_s")).alias("speed"))


def most_steps(pages, floor: int = 20, ceiling: int = 30):
    """Column: the steps a run on a document of so many pages may take."""
    return F.least(F.lit(ceiling), F.greatest(F.lit(floor), F.coalesce(pages, F.lit(0))))


def reasoning_effort(configured, has_material):
    """Column: the effort of a step: none where none is configured, low while there is nothing to reason on, else as configured."""
    return F.when(configured.isNull(), F.lit(None)).when(~has_material, "low").otherwise(configured)


def queue_order(jobs: DataFrame) -> DataFrame:
    """Adds ord to queued jobs (queue, at, priority): high ones first, the newest of them in front, others in the order they came."""
    high = F.coalesce(F.col("priority") == "high", F.lit(False))
    w = Window.partitionBy("queue").orderBy(F.desc(high), F.when(high, -F.col("at")).otherwise(F.col("at")))
    return jobs.withColumn("ord", F.row_number().over(w))
