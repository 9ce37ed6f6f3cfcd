"""Scans, medians, additive hashes and pool lookups over groups of any size, against plain forms."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators import eventlog, ledger, ordered, pool
from tracemill.streaming import monitors


@pytest.fixture(scope="module")
def rows(spark):
    """One group of most rows, small ones, a null group; ties of nothing, as at is a key."""
    rnd = random.Random(4)
    data = [(i, rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice([None, rnd.uniform(-5, 5), 1e9, float(rnd.randrange(3))])) for i in range(6000)]
    return spark.createDataFrame(data, "at long, g string, v double").repartition(5).cache()


@pytest.fixture(autouse=True, scope="module")
def parts_stay_apart(spark):
    """Small ranges would be put together, and no value carried from one to the next."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("most", [10, 10**6])
def test_scans_equal_windows(rows, most):
    w = Window.partitionBy("g").orderBy("at")
    low = F.min(F.when(F.abs("v") < 1e8, F.col("v"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    assert pairs(ledger.best_so_far(rows, "v", ["g"], ["at"], most), "at", "best_so_far") == pairs(rows.withColumn("best_so_far", low), "at", "best_so_far")
    assert pairs(ordered.running_count(rows, "n", ["g"], ["at"], most), "at", "n") == pairs(rows.withColumn("n", F.row_number().over(w)), "at", "n")
    assert pairs(ordered.previous(rows, "p", "v", ["g"], ["at"], most), "at", "p") == pairs(rows.withColumn("p", F.lag("v").over(w)), "at", "p")


def test_a_hot_group_lies_in_many_tasks(rows):
    parts = ordered.in_parts(rows.filter("g = 'hot'"), ["g"], ["at"])
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    bounds = parts.groupBy("_part").agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy("_part").collect()
    assert all(a["high"] < b["low"] for a, b in zip(bounds, bounds[1:]))


def test_gaps_alignment_and_bands_over_parts(spark, rows):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("at") * 7))
    assert pairs(eventlog.gaps(timed, "g", "ts", "at", 10), "at", "gap_us") == pairs(eventlog.gaps(timed, "g", "ts", "at"), "at", "gap_us")
    align = lambda most: eventlog.align_calls(rows.filter("g is not null"), "g", "at", F.col("at") % 3 == 0, F.col("at") % 3 == 1, "v", most)
    assert pairs(align(10), "g", "n", "call_at", "result_at") == pairs(align(10**6), "g", "n", "call_at", "result_at")
    bands = lambda most: monitors.bands(rows, "g", "at", 1000, most_rows=most)
    assert pairs(bands(10), "g", "at", "band") == pairs(bands(10**6), "g", "at", "band") and bands(10).count() >= 4


@pytest.mark.parametrize("most, buckets", [(10, 64), (1000, 1024), (10**6, 1024)])
def test_medians_are_exact(rows, most, buckets):
    by = {}
    for r in rows.collect():
        if r["v"] is not None:
            by.setdefault(r["g"], []).append(r["v"])
    got = {r["g"]: r["median"] for r in ordered.medians(rows, ["g"], "v", most, buckets).collect()}
    assert got == {g: statistics.median(v) for g, v in by.items()}


def test_medians_of_awkward_values(spark):
    values = {"same": [3.0] * 50, "two": [1.0, 2.0] * 25, "wide": [-1.7e308, 1.7e308] * 20 + [5e-324] * 21, "near": [1.0 + k * 2**-52 for k in range(41)], "inf": [float("inf")] * 15 + [0.0] * 30}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("none", None)], "g string, v double")
    got = {r["g"]: r["median"] for r in ordered.medians(df, ["g"], "v", 10).collect()}
    assert got == {g: statistics.median(v) for g, v in values.items()}
    assert ordered.medians(df.limit(0), ["g"], "v").count() == 0


def test_one_delegation_of_all_rows(spark, rows):
    store = rows.select(F.lit("D1").alias("_delegation_id"), F.lit("x").alias("_source"), F.col("v").alias("_wall_ms"))
    few, all_ = (ledger.wall_per_group(store, most_rows=m).first() for m in (100, 10**6))
    assert few == all_ and few["median_ms"] is not None


def test_hashes_add_up(spark, rows):
    """Order, parts and other groups make no difference; a batch is added to a stored state."""
    of = lambda df: {r["g"]: (r["n_rows"], r["content_hash"]) for r in ledger.content_hash(df, ["at", "v"], ["g"]).collect()}
    whole = of(rows)
    assert of(rows.orderBy(F.desc("v")).repartition(2)) == whole
    assert of(rows.filter("g = 'a'"))["a"] == whole["a"]
    assert of(rows.filter("at <> 17"))[rows.filter("at = 17").first()["g"]] != whole[rows.filter("at = 17").first()["g"]]
    assert of(rows.unionByName(rows.filter("g = 'a'")))["a"] != whole["a"]  # repeats count
    parts = [ledger.content_state(rows.filter(F.col("at") % 3 == k), ["at", "v"], ["g"]) for k in range(3)]
    both = ledger.merged(ledger.merged(parts[0].unionByName(parts[1]), ["g"]).unionByName(parts[2]), ["g"])
    assert {r["g"]: (r["n_rows"], r["content_hash"]) for r in ledger.state_hash(both, ["g"]).collect()} == whole
    one = ledger.content_hash(rows.limit(0), ["at"]).first()
    assert one["n_rows"] == 0 and len(one["content_hash"]) == 64


def test_hash_at_the_old_boundary(spark):
    """Another group that grows leaves a group's hash as it is."""
    small = spark.range(10).select(F.lit("s").alias("g"), F.col("id").cast("double").alias("v"))
    large = spark.range(300_000).select(F.lit("l").alias("g"), F.col("id").cast("double").alias("v"))
    alone, beside = ledger.content_hash(small, ["v"], ["g"]), ledger.content_hash(small.unionByName(large), ["v"], ["g"])
    assert alone.first()["content_hash"] == beside.filter("g = 's'").first()["content_hash"]


def brute(candidates, rows):
    x = np.array([r[1:] for r in rows], float)
    spread = x.max(0) - x.min(0)
    spread[spread == 0] = 1
    out = {}
    for k, *c in candidates:
        d = np.round((((np.array(c) - x) / spread) ** 2).sum(1), 12)
        best = min((d[i], rows[i][0]) for i in range(len(rows)))
        out[k] = best[1]
    return out


@pytest.mark.parametrize("cell", [4, 64, 10**6])
def test_nearest_rows_equal_all_pairs(spark, cell):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), 3.0) for i, (a, b) in enumerate(np.round(rng.normal(size=(700, 2)), 1))] + [(1000 + i, 0.5, 0.5, 3.0) for i in range(300)]
    asked = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(np.round(rng.normal(size=(200, 3)) * 2, 2))] + [(900, 0.5, 0.5, 3.0)]
    schema = "k long, a double, b double, c double"
    p = spark.createDataFrame([*rows, (5000, None, 1.0, 3.0)], schema.replace("k long", "p long"))
    q = spark.createDataFrame([*asked, (901, None, 0.0, 0.0)], schema)
    got = {r["k"]: r["p"] for r in pool.nearest_pool_row(q, p, ["a", "b", "c"], "k", "p", cell).collect()}
    assert got == brute(asked, rows)
    assert pool.nearest_pool_row(q, p.limit(0), ["a", "b", "c"], "k", "p", cell).count() == 0


def test_few_pairs_are_compared(spark):
    rows = spark.range(20_000).select(F.col("id").alias("p"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    asked = spark.range(500).select(F.col("id").alias("k"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    rows, asked = rows.cache(), asked.cache()
    found, pairs = pool.searched(asked, rows, ["a", "b"], "k", "p")
    assert pairs.agg(F.sum("n")).first()[0] < 0.05 * 20_000 * 500
    assert {r["k"]: r["p"] for r in found.collect()} == brute([tuple(r) for r in asked.collect()], [tuple(r) for r in rows.collect()])


def test_copies_of_pool_rows_and_empty_cells(spark):
    """Few places, each of a hundred rows: cells of the tree stay empty, and no candidate meets all others for that."""
    rows = spark.range(30_000).select(F.col("id").alias("p"), (F.col("id") % 300 % 17).cast("double").alias("a"), F.sqrt(F.col("id") % 300).alias("b"))
    asked = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 19 - 0.6).alias("a"), (F.rand(4) * 20 - 1).alias("b"))
    asked = asked.cache()
    found, pairs = pool.searched(asked, rows, ["a", "b"], "k", "p", 8)
    assert pairs.agg(F.sum("n")).first()[0] < 500 * 150
    assert {r["k"]: r["p"] for r in found.collect()} == brute([tuple(r) for r in asked.collect()], [tuple(r) for r in rows.filter("p < 300").collect()])


def test_repeats_of_pool_rows(spark):
    found = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 7)], "k long, p long")
    assert {r["k"] for r in pool.repeated(found, "p", ["k"]).filter("repeated").collect()} == {2, 4}
