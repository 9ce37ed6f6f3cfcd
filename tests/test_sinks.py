"""Appends and claims by writers at the same time."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracemill.functions.markers import Markers
from tracemill.operators import sinks


def test_one_writer_puts_a_marker(spark, tmp_path):
    lists = [Markers(spark, f"file://{tmp_path}/m") for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        won = [sum(pool.map(lambda m: m[1].put(n, {"by": m[0]}), enumerate(lists))) for n in range(5)]
    assert won == [1] * 5 and len(lists[0].all()) == 5


def test_writers_at_the_same_time_lose_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/kpi"
    rows = [spark.range(10 * i, 10 * i + 10).withColumn(f"c{i % 3}", F.lit(i)) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda r: sinks.append_kpi(path, r), rows))
    table = sinks.read(spark, path)
    assert table.count() == 60 and {*table.columns} == {"id", "c0", "c1", "c2"} and table.select("id").distinct().count() == 60
    with pytest.raises(ValueError, match="another type"):
        sinks.append_kpi(path, spark.createDataFrame([("x",)], "id string"))


def test_an_append_leaves_old_files_alone(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    stamp = {"_delegation_id": F.lit("D1")}
    for i in range(3):
        sinks.append_rows(path, spark.range(i * 5, i * 5 + 5).withColumn("f", F.lit(1.0)), ["id"], stamp)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    sinks.append_rows(path, spark.range(7, 8).withColumn("f", F.lit(9.0)), ["id"], stamp, replace_stale=True)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert len(Markers(spark, f"{path}/{sinks.MARK}").all()[-1]["drop"]) == 1  # the folder of row 7 alone
    rows = {r["id"]: r["f"] for r in sinks.read(spark, path).collect()}
    assert rows == {i: 9.0 if i == 7 else 1.0 for i in range(15)}


def test_each_note_goes_to_one_reader(spark, tmp_path):
    notes, place = spark.range(100).withColumnRenamed("id", "n").cache(), f"file://{tmp_path}/claims"

    def reader(name):
        out = []
        while rows := [r["n"] for r in sinks.claim(notes, place, name, "n", 9).collect()]:
            out += rows
        return name, out

    with ThreadPoolExecutor(2) as pool:
        got = dict(pool.map(reader, ["a", "b"]))
    assert sorted(got["a"] + got["b"]) == list(range(100))
    again = {r["n"]: r["reader"] for r in sinks.claimed(notes, place, "n").collect()}
    assert again == {n: name for name, rows in got.items() for n in rows}
    more = notes.unionByName(spark.range(100, 103).withColumnRenamed("id", "n"))
    assert sorted(r["n"] for r in sinks.claim(more, place, "c", "n").collect()) == [100, 101, 102]
    assert sinks.claim(more.limit(0), f"{place}-none", "c", "n").count() == 0
