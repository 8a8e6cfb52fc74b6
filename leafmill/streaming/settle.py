"""Stateful behaviours on event streams and their batch forms.

The quiet period is in event time: a timer in processing time has no counterpart in a batch. Late
rows within the watermark are counted, later ones dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

BUCKETS = 32


def settled(events: DataFrame, key: str, ts: str, value: str, tie: str, quiet_s: int) -> DataFrame:
    """Values that stayed for `quiet_s` seconds, without those equal to the settled one before."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    nxt = F.lead(ts).over(w)
    calm = events.withColumn("_n", nxt).where(F.col("_n").isNull() | (F.col("_n") >= F.col(ts) + F.expr(f"interval {quiet_s} seconds")))
    return calm.withColumn("_b", F.lag(value).over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).select(key, ts, value)


def settled_stream(events: DataFrame, key: str, ts: str, value: str, quiet_s: int, watermark: str) -> DataFrame:
    """Streaming form, for string keys and values: key, settled_at and value once a value has stayed for `quiet_s` seconds of event time, unless it equals the one settled before.

    A key's state is its last value and time and the value settled last. A timer at the end of the
    quiet period settles values that no later row follows.
    """
    quiet = int(quiet_s * 1000)

    def run(k: tuple[Any], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last_ms, last, before = state.get if state.exists else (None, None, None)
        out = []

        def settle() -> None:
            nonlocal before
            if last_ms is not None and last != before:
                out.append((k[0], pd.Timestamp(last_ms + quiet, unit="ms"), last))
                before = last

        if state.hasTimedOut:
            settle()
            state.update((None, None, before))
        else:
            rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
            for at, v in zip(rows[ts], rows[value], strict=True):
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                if last_ms is not None and ms - last_ms >= quiet:
                    settle()
                if last_ms is None or ms >= last_ms:
                    last_ms, last = ms, v
            if last_ms is not None and last_ms + quiet <= state.getCurrentWatermarkMs():
                settle()
                last_ms = last = None
            state.update((last_ms, last, before))
        if last_ms is not None and not state.hasTimedOut:
            state.setTimeoutTimestamp(last_ms + quiet)
        yield pd.DataFrame(out, columns=[key, "settled_at", value])

    rows = events.select(key, ts, value).withWatermark(ts, watermark)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, settled_at timestamp, {value} string", "last_ms long, last string, before string", "append", GroupStateTimeout.EventTimeTimeout)


def current_generation(events: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of the newest generation of their key: results of work that was superseded go."""
    newest = events.groupBy(key).agg(F.max(generation).alias(generation))
    return events.join(newest, [key, generation], "left_semi")


def current_generation_stream(events: DataFrame, key: str, generation: str) -> DataFrame:
    """Streaming form: rows whose generation is no older than any seen for their key; the state of a key is that one number. Keys are strings, generations long."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(k: tuple[Any], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))
        top = int(rows[generation].max())
        newest = top if newest is None else max(newest, top)
        state.update((newest,))
        yield rows[rows[generation] >= newest]

    return events.groupBy(key).applyInPandasWithState(run, fields, "newest long", "append", GroupStateTimeout.NoTimeout)


def in_flight_once(events: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """Requests of a stream without those that repeat one whose watermark hasn't passed: they ride along with it."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def first_notes_stream(notes: DataFrame, run: str, text: str, most: int = 4, chars: int = 600) -> DataFrame:
    """Streaming form of a run's notes: trimmed, cut, blank ones refused, the first `most` of a run; its state is how many it took. Runs are strings."""

    def take(k: tuple[Any], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        took = state.get[0] if state.exists else 0
        texts = [t for df in frames for x in df[text] if x is not None and (t := x.strip()[:chars])]
        kept = texts[: max(0, most - took)]
        state.update((took + len(kept),))
        yield pd.DataFrame({run: k[0], "ord": range(took + 1, took + 1 + len(kept)), text: kept})

    return notes.select(run, text).groupBy(run).applyInPandasWithState(take, f"{run} string, ord int, {text} string", "took int", "append", GroupStateTimeout.NoTimeout)


def newest_rows(rows: DataFrame, key: str, order: str, most: int = 16) -> DataFrame:
    """The newest `most` rows of each key: a bounded queue that drops its oldest."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def injected(main: DataFrame, side: DataFrame, key: str, order: str) -> DataFrame:
    """Two streams of rows as one, without rows that repeat the one before them in their key."""
    both = main.unionByName(side)
    rest = [c for c in both.columns if c not in (key, order)]
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(F.struct(*rest)).over(w)
    return both.withColumn("_b", before).where(F.col("_b").isNull() | ~F.struct(*rest).eqNullSafe(F.col("_b"))).drop("_b")


def latest_state(events: DataFrame, key: str, state: str, order: str, idle: str) -> DataFrame:
    """The last state of each key; keys whose last state is `idle` are gone."""
    return events.groupBy(key).agg(F.max_by(state, order).alias("state")).where(F.col("state") != idle)


def changes(spark: SparkSession, folder: str, schema: str, paths: list[str] | None = None) -> DataFrame:
    """A stream of the rows that arrive below a folder, of some paths or all."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows if paths is None else rows.where(F.col("path").isin(*paths))


def drained(query: Any, deadline_s: float = 10.0) -> bool:
    """Waits until a streaming query ends; False if it still runs at the deadline."""
    return bool(query.awaitTermination(deadline_s))


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, str]:
    """For each bucket the folder of its newest complete version, of those before `below` if given."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    out: dict[int, tuple[int, str]] = {}
    for done in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "v=*/_SUCCESS")) or []:
        version = done.getPath().getParent()
        number = int(version.getName().split("=")[1])
        if below is not None and number >= below:
            continue
        for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(version, "b=*")) or []:
            b = int(part.getPath().getName().split("=")[1])
            if b not in out or out[b][0] < number:
                out[b] = (number, part.getPath().toString())
    return {b: path for b, (_, path) in out.items()}


def upsert_sink(target: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key in the table `target`.

    Rows are dealt into buckets by key; a batch writes a new version of the buckets it touches, made
    of its rows and those of the newest version before it, whatever epochs lie between. A replayed
    batch overwrites its own version. Errors of reading earlier versions are raised, never taken for
    an empty table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        batch = batch.withColumn("b", _bucket(keys)).persist()
        try:
            touched = [r.b for r in batch.select("b").distinct().collect()]  # BUCKETS at most
            before = _versions(spark, target, epoch)
            old = [before[b] for b in touched if b in before]
            rows = batch
            if old:
                rows = rows.unionByName(spark.read.parquet(*old).withColumn("b", _bucket(keys)))
            merged = rows.groupBy(*keys, "b").agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "b")
            merged.write.partitionBy("b").mode("overwrite").parquet(f"{target}/v={epoch}")
        finally:
            batch.unpersist()

    return write


def upserted(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The table that `upsert_sink` keeps; empty, of `schema`, before the first batch."""
    newest = _versions(spark, target)
    return spark.read.parquet(*newest.values()) if newest else spark.createDataFrame([], schema)
