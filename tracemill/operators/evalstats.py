"""Retrieval quality and its statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.shipping import ship


def metrics(ranked: DataFrame, gold: DataFrame, query: str, key: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Of each query with gold: its size, recall at each k and the reciprocal of the first hit's rank (0 without one)."""
    hits = gold.join(ranked.select(query, key, "rank"), [query, key], "left")
    out = hits.groupBy(query).agg(F.count("*").alias("n_gold"), *[(F.count_if(F.col("rank") < k) / F.count("*")).alias(f"recall_{k}") for k in ks], F.coalesce(1 / (F.min("rank") + 1), F.lit(0.0)).alias("rr"))
    return out


def summary(scored: DataFrame, tier: str) -> DataFrame:
    """Means over queries by tier and over all."""
    columns = [c for c in scored.columns if c.startswith("recall_") or c == "rr"]
    return scored.groupingSets([[], [tier]], tier).agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in columns]).withColumn(tier, F.coalesce(tier, F.lit("all")))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Exact McNemar test of two paired outcomes: the discordant counts and twice the binomial tail, at most 1."""
    counts = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).cast("int").alias("only_a"), F.count_if(~F.col(a) & F.col(b)).cast("int").alias("only_b"))
    n, m = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # one pass over i: the logarithm of C(n, i) / 2^n from that of i - 1, so that large counts don't overflow, with what its rounding has lost, and the sum
    first = F.struct((-n * F.ln(F.lit(2.0))).alias("log"), F.lit(0.0).alias("lost"), F.exp(-n * F.ln(F.lit(2.0))).alias("tail"))

    def add(s: Column, i: Column) -> Column:
        step = F.ln((n - i + 1).cast("double") / i.cast("double")) - s["lost"]
        log = s["log"] + step
        return F.struct(log.alias("log"), ((log - s["log"]) - step).alias("lost"), (s["tail"] + F.exp(log)).alias("tail"))

    tail = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), first, add, lambda s: s["tail"])
    return counts.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share by Wilson's interval, within 0 and 1."""
    p = hits / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest(F.lit(0.0), (centre - spread) / scale), F.least(F.lit(1.0), (centre + spread) / scale)


def pearson(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """Correlation; null for fewer than two rows or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.filter(both).groupBy(*group).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"))
    return out.withColumn("r", F.when((F.col("n") > 1) & (F.col("_x") > 0) & (F.col("_y") > 0), F.col("r"))).drop("_x", "_y")


def bootstrap_difference(pairs: DataFrame, a: str, b: str, key: str, resamples: int = 5000, seed: int = 1234) -> DataFrame:
    """95 % interval of the mean difference of paired scores by the Poisson bootstrap: order statistics of the resamples' means.

    A row's weight in each resample is Poisson with mean 1, drawn by a
    generator that the row's key seeds, so that the result doesn't depend on
    partitioning. A task adds its rows' weights up in one array for all
    resamples; only these sums are shuffled.
    """
    ship(pairs.sparkSession)

    def run(batches):
        total, weight = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for h, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d is not None:
                    w = np.random.default_rng([seed, h & (2**64 - 1)]).poisson(1.0, resamples)
                    total += w * d
                    weight += w
        yield pa.RecordBatch.from_pydict({"i": np.arange(resamples), "total": total, "weight": weight})

    each = pairs.select(F.xxhash64(key).alias("h"), (F.col(a) - F.col(b)).cast("double").alias("d")).mapInArrow(run, "i long, total double, weight double")
    means = each.groupBy("i").agg((F.sum("total") / F.sum("weight")).alias("mean"))
    listed = means.agg(F.array_sort(F.collect_list("mean")).alias("m"))  # one value for each resample
    return listed.select(F.get("m", F.lit(int(0.025 * resamples))).alias("low"), F.get("m", F.lit(min(resamples - 1, int(0.975 * resamples)))).alias("high"))


def power_note(n: Column, share: Column, z_alpha: float = 1.96, z_beta: float = 0.8416) -> Column:
    """Least difference of two paired shares that n queries show with a power of 80 %, if `share` of them are discordant."""
    return (z_alpha + z_beta) * F.sqrt(share / F.greatest(n, F.lit(1)))


def lost_evidence(metrics_a: DataFrame, metrics_b: DataFrame, query: str, measure: str) -> DataFrame:
    """Queries with gold that one arm finds and the other doesn't, of each direction, and the mean difference."""
    both = metrics_a.select(query, F.col(measure).alias("a")).join(metrics_b.select(query, F.col(measure).alias("b")), query)
    return both.agg(F.count("*").alias("n"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("lost"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("gained"), F.avg(F.col("b") - F.col("a")).alias("change"))
