"""Streams: what settles, what is superseded, what is kept; and the table that batches keep up."""

import datetime as dt

import pytest

from leafmill.streaming import settle as E

SCHEMA = "k string, ts timestamp, v string, g long"


def at(m):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)


def streamed(spark, tmp_path, batches, make, schema=SCHEMA, order=None):
    """The rows that a query over a stream of batches puts out."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"b{i}"))
    import shutil

    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(src).writeStream.outputMode("append").format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(len(batches)):
            for f in (tmp_path / f"b{i}").glob("*.parquet"):
                shutil.copy(f, tmp_path / "in" / f"{i}-{f.name}")
            q.processAllAvailable()
        q.processAllAvailable()
        return spark.sql("select * from out").collect()
    finally:
        q.stop()


def test_settled_stream_leaves_out_equal_values(spark, tmp_path):
    rows = [[("k", at(0), "a", 0), ("k", at(1), "b", 0)], [("k", at(20), "b", 0)], [("k", at(40), "c", 0)], [("k", at(60), "b", 0), ("x", at(90), "z", 0)], [("y", at(200), "z", 0)]]
    got = streamed(spark, tmp_path, rows, lambda s: E.settled_stream(s, "k", "ts", "v", 600, "1 minute"))
    assert [r.v for r in sorted(got, key=lambda r: r.settled_at) if r.k == "k"] == ["b", "c", "b"]


def test_superseded_generations_go(spark, tmp_path):
    batches = [[("k", at(0), "old", 1), ("k", at(1), "new", 2), ("x", at(1), "x", 1)], [("k", at(2), "late", 1), ("k", at(3), "now", 2)], [("k", at(4), "next", 3)]]
    got = streamed(spark, tmp_path, batches, lambda s: E.current_generation_stream(s, "k", "g"))
    assert sorted(r.v for r in got) == ["new", "next", "now", "x"]
    df = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert sorted(r.v for r in E.current_generation(df, "k", "g").collect()) == ["next", "x"]


def test_requests_in_flight_once(spark, tmp_path):
    batches = [[("p", at(0), "a", 1), ("p", at(1), "a", 1)], [("p", at(2), "a", 1), ("q", at(2), "a", 1)]]
    got = streamed(spark, tmp_path, batches, lambda s: E.in_flight_once(s, ["k", "g"], "ts", "10 minutes"))
    assert sorted(r.k for r in got) == ["p", "q"]


def test_notes_of_a_run(spark, tmp_path):
    batches = [[("r", at(0), " one ", 0), ("r", at(0), "  ", 0), ("r", at(0), "two", 0)], [("r", at(1), "three", 0), ("r", at(1), "four", 0), ("r", at(1), "five", 0)]]
    got = streamed(spark, tmp_path, batches, lambda s: E.first_notes_stream(s, "k", "v"))
    assert [r.v for r in sorted(got, key=lambda r: r.ord)] == ["one", "two", "three", "four"]


def test_upserts_survive_gaps_and_replays(spark, tmp_path):
    target = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, v string, n int")
    sink = E.upsert_sink(target, ["k"], "n")
    now = lambda: {r.k: r.v for r in E.upserted(spark, target, "k string, v string, n int").collect()}
    assert now() == {}
    sink(df(("a", "1", 1), ("b", "1", 1), ("c", "1", 1)), 0)
    sink(df(("a", "3", 3)), 2)
    assert now() == {"a": "3", "b": "1", "c": "1"}
    sink(df(("a", "3", 3)), 2)
    sink(df(("a", "2", 2), ("d", "4", 4)), 5)
    assert now() == {"a": "3", "b": "1", "c": "1", "d": "4"}
    (tmp_path / "t" / "v=5").rename(tmp_path / "t" / "v=x5")
    with pytest.raises(Exception):
        sink(df(("a", "9", 9)), 9)


def test_queue_and_injection(spark):
    df = spark.createDataFrame([("k", i, "x") for i in range(20)], "k string, n int, v string")
    assert sorted(r.n for r in E.newest_rows(df, "k", "n").collect()) == list(range(4, 20))
    main = spark.createDataFrame([("k", 1, "a"), ("k", 4, "b")], "k string, n int, v string")
    side = spark.createDataFrame([("k", 2, "p"), ("k", 3, "p"), ("k", 5, "b")], "k string, n int, v string")
    assert [r.n for r in E.injected(main, side, "k", "n").orderBy("n").collect()] == [1, 2, 4]


def test_changes_and_deadline(spark, tmp_path):
    (tmp_path / "c").mkdir()
    spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    q = E.changes(spark, str(tmp_path / "c"), "path string, n int", ["a"]).writeStream.format("memory").queryName("chg").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    assert E.drained(q, 0.1) is False
    q.stop()
    assert E.drained(q, 5) is True
    assert [r.n for r in spark.sql("select * from chg").collect()] == [1]
