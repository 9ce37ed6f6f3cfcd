"""Keyed monitors and tails: state between micro-batches, restarts, torn lines, timers."""

import os

import pytest
from pyspark.sql import functions as F

from tracemill.jobs import files
from tracemill.operators.eventlog import parse_jsonl
from tracemill.sources.tail import Range, TailReader, tail_jsonl
from tracemill.streaming import keyed, monitors


def in_batches(spark, tmp_path, batches, schema, build):
    """Rows of a stream that is started anew, from its checkpoint, for each batch."""
    place, out = f"{tmp_path}/run", None
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn("ts", F.to_timestamp("ts")) if "ts" in df.columns else df
        df.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        out = monitors.run(build(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), "monitor", place=place)
    return out


at = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
REPEATS = [("d", 1, at(0)), ("d", 1, at(1)), ("e", 1, at(1)), ("d", 1, at(2)), ("d", 2, at(3)), ("d", 2, at(4)), ("e", 2, at(4)), ("d", 2, at(5)), ("d", 1, at(6)), ("d", 1, at(7)), *[("d", 1, at(8 + i)) for i in range(5)]]


@pytest.mark.parametrize("cuts", [[15], [4, 11], [1, 2, 3, 9]])
def test_duplicates_are_told_alike_in_any_batches(spark, tmp_path, cuts):
    batches = [REPEATS[i:j] for i, j in zip([0, *cuts], [*cuts, 15]) if i < j]
    rows = in_batches(spark, tmp_path, batches, "who string, design int, ts string", lambda s: keyed.duplicate_monitor(s, "who", ["design"], "ts"))
    assert sorted((r["who"], r["n_duplicate"]) for r in rows.collect()) == [("d", 3), ("d", 6)]


def test_a_teller_cools_down(spark, tmp_path):
    rows = [("d", 1, f"2024-01-01 00:00:{i:02}") for i in range(10)] + [("d", 1, at(2))]
    got = in_batches(spark, tmp_path, [rows], "who string, design int, ts string", lambda s: keyed.duplicate_monitor(s, "who", ["design"], "ts")).collect()
    assert sorted(r["n_duplicate"] for r in got) == [3, 10]  # the second one a minute later


def test_changes_over_batches(spark, tmp_path):
    batches = [[(1, 1, "a"), (1, 2, "a"), (2, 3, "b"), (4, 3, None)], [(1, 4, "a"), (1, 5, "c"), (2, 6, "b"), (4, 7, None)], [(1, 7, "c"), (3, 8, "a"), (4, 9, "x")]]
    rows = in_batches(spark, tmp_path, batches, "user_id long, event_id long, event_type string", keyed.changes)
    assert sorted((r["user_id"], r["event_id"]) for r in rows.collect()) == [(1, 1), (1, 5), (2, 3), (3, 8), (4, 3), (4, 9)]


def test_state_is_written_for_a_batch_alone(spark, tmp_path):
    """A batch of one key among many touches that key's state alone."""
    schema = "user_id long, event_id long, event_type string"
    touched = []
    for i, rows in enumerate([[(k, k, "a") for k in range(200)], [(7, 1000, "b")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = keyed.changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        touched.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    assert touched == [200, 1]


def test_a_delegation_that_has_been_told_costs_no_state(spark, tmp_path):
    """Behind the last telling nothing is counted, and a key's state is one row however many designs it has."""
    schema = "who long, design int, ts timestamp"
    build = lambda s: keyed.duplicate_monitor(s, "who", ["design"], "ts", cool=0.0)
    touched, told = [], []
    for base, designs in ((0, 9), (100, 1), (200, 1)):
        rows = spark.range(40).selectExpr("id AS who", "explode(sequence(0, 9)) AS i").selectExpr("who", f"IF(i < {designs}, i, 0) AS design", f"timestamp_seconds({base} + i) AS ts")
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        query = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        touched.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
        told.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert touched == [40, 40, 0] and told == [0, 80, 80]


def test_a_monitor_forgets_designs_after_their_time(spark, tmp_path):
    build = lambda keep: lambda s: keyed.duplicate_monitor(s, "who", ["design"], "ts", threshold=1, cool=0.0, keep_ms=keep)
    batches = [[("a", 1, at(0)), ("b", 2, at(0))], [("a", 1, at(1)), ("b", 3, at(1))]]
    for keep, want in ((1, []), (3_600_000, ["a"])):
        got = in_batches(spark, tmp_path / str(keep), batches, "who string, design int, ts string", build(keep))
        assert [r["who"] for r in got.collect()] == want


def test_stalls_by_rows_and_by_timers(spark, tmp_path):
    batches = [[("a", at(0)), ("a", at(10)), ("b", at(0)), ("c", at(5))], [("a", at(50)), ("c", at(24))], [("a", at(55)), ("d", at(100))]]
    rows = in_batches(spark, tmp_path, batches, "who string, ts string", lambda s: keyed.stalls(s, "who", "ts", 1200.0))
    minutes = sorted((r["who"], r["since_ms"] // 60_000 % 1440) for r in rows.collect())
    assert minutes == [("a", 10), ("a", 55), ("b", 0), ("c", 24)]


def drained(spark, tmp_path, start="start", range_bytes=40):
    stream = parse_jsonl(tail_jsonl(spark, f"{tmp_path}/logs/events.*.jsonl", start, range_bytes), "n long, t string")
    return sorted((r["n"], r["t"]) for r in monitors.run(stream, "tail", place=f"{tmp_path}/run-{start}").collect())


def test_tail_of_growing_files(spark, tmp_path):
    """Torn lines wait, restarts neither lose nor repeat one, files may come and vanish."""
    os.makedirs(tmp_path / "logs")
    a, b = tmp_path / "logs/events.a.jsonl", tmp_path / "logs/events.b.jsonl"
    line = lambda n: f'{{"n": {n}, "t": "é{"x" * (n % 50)}"}}\n'
    row = lambda n: (n, "é" + "x" * (n % 50))
    a.write_text("".join(map(line, range(30))) + line(30)[:7])
    assert drained(spark, tmp_path) == [row(n) for n in range(30)]
    with a.open("a") as f:
        f.write(line(30)[7:] + "\n damaged }\n" + line(31))
    b.write_text(line(100))
    assert drained(spark, tmp_path) == [*[row(n) for n in range(32)], row(100)]
    assert drained(spark, tmp_path) == [*[row(n) for n in range(32)], row(100)]
    assert drained(spark, tmp_path, "end") == []
    a.unlink()
    with b.open("a") as f:
        f.write(line(101))
    assert drained(spark, tmp_path) == [*[row(n) for n in range(32)], row(100), row(101)]
    assert drained(spark, tmp_path, "end") == [row(101)]
    (tmp_path / "logs/other.jsonl").write_text(line(7))
    assert len(drained(spark, tmp_path)) == 34


@pytest.mark.parametrize("name", ["live_fan_in", "jsonl_tail"])
def test_long_logs_are_dealt_over_files(spark, same, monkeypatch, name):
    """No task writes a whole log, and the rows are those of one file."""
    written = []
    grow = files._grow
    monkeypatch.setattr(files, "LINES", 100)
    monkeypatch.setattr(files, "_grow", lambda rows, root, cut: (written.append(rows.groupBy("log").count().agg(F.max("count")).first()[0]), grow(rows, root, cut)))
    same(files.QUERIES[name], files.SQL[name])
    assert max(written) < 200


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_ranges_share_out_lines(tmp_path, size):
    """Every line is read by one range, whatever the ranges' size."""
    path = tmp_path / "x.jsonl"
    lines = ["", "a", "bb" * 30, "", "c", "é" * 9, "last"]
    path.write_text("\n".join(lines) + "\ntorn")
    reader = TailReader({"path": str(path), "range": str(size)})
    end = reader.latestOffset()
    assert end == {str(path): len(path.read_bytes()) - 4}
    got = [v for p in reader.partitions({}, end) for batch in reader.read(p) for v in zip(*(c.to_pylist() for c in batch.columns[1:]))]
    places = [0]
    for x in lines:
        places.append(places[-1] + len(x.encode()) + 1)
    assert got == list(zip(places, lines))
    path.unlink()
    assert list(reader.read(Range(str(path), 0, 5, 5, True))) == [] and reader.latestOffset() == {}
