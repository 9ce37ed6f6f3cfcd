"""Running values and ranks over groups of any size: scans in two levels, and selection by histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.scratch import stored

#: Rows of a group that one task walks through in order, or whose values it holds; larger groups are spread.
MOST_ROWS = 1_000_000
#: Buckets of a histogram.
BUCKETS = 1024


def in_parts(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with _part: rows lie in ranges of group and order, so that a group's parts follow each other. Stored, so that parts stay as they are."""
    dealt = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    return stored(dealt, "ranges")


def large(df: DataFrame, group: list[str], most_rows: int) -> bool:
    """Whether some group has more rows than that."""
    top = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    return (top or 0) > most_rows


def _same(group: list[str]) -> list[Column]:
    return [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in [*group, "_part"]]


def scanned(df: DataFrame, group: list[str], order: list[str], local: dict[str, Column], of_part: dict[str, Column], before: dict[str, Column], joined: dict[str, Column], most_rows: int = MOST_ROWS) -> DataFrame:
    """df with the columns `joined` of a scan along each group's order.

    local are window expressions within a part (use within()), of_part
    aggregates that stand for a part, before windows over the parts of a group
    in front of one (use ahead()), and joined what follows from a row's local
    values and those before its part. Where no group has more than most_rows
    rows, each is one part.
    """
    rows = in_parts(df, group, order) if large(df, group, most_rows) else df.withColumn("_part", F.lit(0))
    here = rows.withColumns(local)
    if not of_part:
        return here.drop("_part")
    parts = rows.groupBy(*group, "_part").agg(*[v.alias(k) for k, v in of_part.items()])
    carried = stored(parts.withColumns(before).select(*group, "_part", *before), "carries")  # a row for each group and part
    out = here.alias("_l").join(carried.alias("_r"), _same(group), "left").select("_l.*", *[F.col(f"_r.{k}").alias(k) for k in before])
    return out.withColumns(joined).drop("_part", *local, *before)


def within(group: list[str], order: list[str]):
    """Window of a part's rows in order."""
    return Window.partitionBy(*group, "_part").orderBy(*order)


def ahead(group: list[str]):
    """Window of the parts of a group in front of one."""
    return Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def running_min(df: DataFrame, name: str, value: Column, group: list[str], order: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """df with the least value so far in each group."""
    so_far = F.min(value).over(within(group, order).rowsBetween(Window.unboundedPreceding, 0))
    return scanned(df, group, order, {"_local": so_far}, {"_least": F.min(value)}, {"_before": F.min("_least").over(ahead(group))}, {name: F.least("_local", "_before")}, most_rows)


def running_count(df: DataFrame, name: str, group: list[str], order: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """df with each row's number in its group, from 1."""
    return scanned(df, group, order, {"_local": F.row_number().over(within(group, order))}, {"_n": F.count("*")}, {"_before": F.sum("_n").over(ahead(group))}, {name: (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("int")}, most_rows)


def previous(df: DataFrame, name: str, value: str, group: list[str], order: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """df with the value of the row before in each group; null in the first."""
    w = within(group, order)
    local = {"_local": F.lag(value).over(w), "_first": F.row_number().over(w) == 1}
    last = {"_last": F.max_by(F.struct(value), F.struct(*order))}
    before = {"_before": F.last("_last").over(ahead(group))}
    return scanned(df, group, order, local, last, before, {name: F.when(F.col("_first"), F.col(f"_before.{value}")).otherwise(F.col("_local"))}, most_rows)


def medians(df: DataFrame, group: list[str], value: str, most_rows: int = MOST_ROWS, buckets: int = BUCKETS, most_rounds: int = 200) -> DataFrame:
    """group and median of the values of each group, exactly; nulls and NaN don't count.

    Groups of up to most_rows values are sorted each in a task. In larger ones
    the one or two middle ranks are found by histograms between a least and a
    largest value: each round counts the values of every bucket, keeps the one that
    holds the rank, and goes on between its own least and largest value until these
    are equal. Only counts leave a round, and no task holds a group.
    """
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    big = stored(sizes.filter(F.col("_n") > most_rows), "large-groups")
    if not big.head(1):
        return rows.groupBy(*group).agg(F.median("_v").alias("median"))
    same = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in group]
    small = rows.alias("_a").join(big.alias("_b"), same, "left_anti").groupBy(*group).agg(F.median("_v").alias("median"))
    rows = stored(rows.alias("_a").join(big.alias("_b"), same, "left_semi"), "large-groups-values")
    now = big.select(*group, "_lo", "_hi", F.explode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))).alias("_rank")).withColumn("_at", F.col("_rank"))
    done = None
    for _ in range(most_rounds):
        now = stored(now, "ranks")
        found = now.filter("_lo = _hi")
        done = found if done is None else done.unionByName(found)
        now = now.filter("_lo < _hi")
        if not now.head(1):
            break
        # halves keep the range from overflowing; the ends have buckets of their own, so that each round takes values off, infinite ones too
        share = F.nanvl(F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.0)), F.lit(0.0))
        bucket = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), buckets).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)))
        inside = rows.alias("_a").join(now.alias("_b"), [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))]).select(*[F.col(f"_a.{c}").alias(c) for c in group], "_at", "_rank", bucket.alias("_bucket"), "_v")
        each = inside.groupBy(*group, "_at", "_rank", "_bucket").agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        below = F.coalesce(F.sum("_m").over(Window.partitionBy(*group, "_at").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # rows of the buckets
        now = each.withColumn("_below", below).filter((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_m"))).select(*group, "_lo", "_hi", (F.col("_rank") - F.col("_below")).alias("_rank"), "_at")
    else:
        raise RuntimeError(f"ranks have not settled after {most_rounds} rounds")
    return small.unionByName(done.groupBy(*group).agg(F.avg("_lo").alias("median")))
