"""Evaluation ledgers: filters, best rows, grouped statistics, duplicates, guards."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.columns import SENTINEL, nan_to_null, round_half_even, stamped
from tracemill.functions.predicate import where
from tracemill.operators.ordered import MOST_ROWS, medians, running_min

POOL_ID, POOL_SOURCE = "D000", "precomputed_pool"


def union_stores(stores: dict[str, DataFrame]) -> DataFrame:
    """Rows of several stores under `_namespace`; columns that a store lacks are null."""
    tagged = [nan_to_null(df).withColumn("_namespace", F.lit(name)) for name, df in stores.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def provenance_filter(df: DataFrame, delegation_ids: list[str] | None = None, source: str | None = None, namespace: str | None = None) -> DataFrame:
    """Rows of the given provenance; a filter on a column that the frame lacks is left out."""
    for column, wanted in (("_delegation_id", delegation_ids), ("_source", source and [source]), ("_namespace", namespace and [namespace])):
        if wanted is not None and column in df.columns:
            df = df.filter(F.col(column).isin(wanted))
    return df


def narrow(df: DataFrame, columns: list[str], always: str = "_namespace") -> DataFrame:
    """The named columns in the frame's order; `always` stays; an unknown name is an error that lists the columns."""
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unknown columns {unknown}. Available columns: {', '.join(df.columns)}")
    return df.select(*[c for c in df.columns if c in columns or c == always])


def feasible(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is a number below the sentinel in size."""
    value = F.col(column).try_cast("double")
    return df.filter(F.when(~F.isnan(value), F.abs(value) < SENTINEL))


def best_n(df: DataFrame, column: str, n: int, keys: list[str], minimise: bool = True) -> DataFrame:
    """The n best feasible rows, ties by keys."""
    order = F.col(column).asc() if minimise else F.col(column).desc()
    return feasible(df, column).orderBy(order, *keys).limit(n)


def capped(df: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """The first rows by keys, each with how many there are and how many are left out."""
    total = df.agg(F.count("*").alias("n_total"))
    out = df.orderBy(*keys).limit(limit).join(F.broadcast(total))  # one row
    return out.withColumn("n_left_out", F.greatest(F.col("n_total") - limit, F.lit(0)))


def real(df: DataFrame) -> DataFrame:
    """Rows stamped by a delegation, without the precomputed pool's."""
    return df.filter(stamped("_delegation_id") & (F.col("_delegation_id") != POOL_ID))


def rows_per_group(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows for each value of each column; nulls don't count, empty strings do."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))).alias("column", "value"))
    return long.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n_rows"))


def output_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least, largest and mean value of each numeric column; what isn't a number doesn't count."""
    values = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).try_cast("double") for c in columns]))
    long = df.select(F.explode(values).alias("output", "value")).filter("value is not null and not isnan(value)")
    return long.groupBy("output").agg(F.min("value").alias("least"), F.max("value").alias("largest"), F.avg("value").alias("mean"))


def wall_per_group(df: DataFrame, group: str = "_delegation_id", wall: str = "_wall_ms", most_rows: int = MOST_ROWS) -> DataFrame:
    """Count, exact median, maximum and sum of wall times; the pool's rows and unstamped ones are left out."""
    rows = df.filter(stamped(group) & (F.col(group) != POOL_ID) & (F.coalesce(F.col("_source"), F.lit("")) != POOL_SOURCE))
    stats = rows.groupBy(group).agg(F.count(wall).alias("n"), F.max(wall).alias("max_ms"), F.sum(wall).alias("sum_ms"))
    middle = medians(rows, [group], wall, most_rows).withColumnRenamed("median", "median_ms")
    return stats.join(middle, group, "left").select(group, "n", "median_ms", "max_ms", "sum_ms")


def total_evaluations(df: DataFrame) -> DataFrame:
    return real(df).agg(F.count("*").alias("n_evals"))


def unstamped(df: DataFrame) -> DataFrame:
    """All rows, and those whose id is null or empty."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~stamped("_delegation_id")).alias("n_unstamped"))


def breakdown(df: DataFrame) -> DataFrame:
    """Of each namespace, its total and the rows of each delegation, as a map."""
    each = df.filter("_delegation_id is not null").groupBy("_namespace", "_delegation_id").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("_delegation_id", "n")))
    return each.groupBy("_namespace").agg(F.sum("n").alias("n_total"), F.map_from_entries(pairs).alias("per_delegation"))


def design(inputs: list[str]) -> list[Column]:
    """Coordinates rounded to ten places, half to even."""
    return [round_half_even(F.col(c).cast("double")).alias(c) for c in sorted(inputs)]


def duplicate_stats(df: DataFrame, inputs: list[str], order: list[str], group: str = "_delegation_id") -> DataFrame:
    """Of each delegation: evaluations, distinct designs, repeated ones, and the design evaluated most with its evaluations.

    Of designs evaluated equally often the one that comes first by `order` is the worst.
    """
    names = sorted(inputs)
    each = df.filter(stamped(group)).groupBy(group, *design(inputs)).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    worst = F.min_by(F.struct("n", F.concat_ws(";", *[F.format_string(f"{c}=%.4f", c) for c in names]).alias("design")), F.struct((-F.col("n")).alias("n"), "_first"))
    out = each.groupBy(group).agg(F.sum("n").alias("n_total"), F.count("*").alias("n_unique"), (F.sum("n") - F.count("*")).alias("n_duplicate"), worst.alias("_w"))
    return out.select(group, "n_total", "n_unique", "n_duplicate", F.col("_w.n").alias("worst"), F.col("_w.design").alias("worst_design"))


def explained(df: DataFrame, predicate: str | None = None, delegation_ids: list[str] | None = None, source: str | None = None, namespace: str | None = None) -> DataFrame:
    """What a query found, in one row: rows scanned and matched, the filters applied, and a verdict on an empty answer.

    An empty answer is a true zero, as unknown columns are errors, unless the
    predicate compares a floating-point column for equality, which may miss
    rows by a rounding error.
    """
    given = [f"delegation_ids={delegation_ids}" if delegation_ids is not None else "", f"source={source!r}" if source else "", f"namespace={namespace!r}" if namespace else "", f"where={predicate!r}" if predicate else ""]
    rows = provenance_filter(df, delegation_ids, source, namespace)
    rows = where(rows, predicate) if predicate else rows
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    loose = bool(predicate) and any(re.search(rf"\b{re.escape(c)}\b\s*==(?!=)|==\s*\b{re.escape(c)}\b", predicate) for c in floats)
    counts = df.agg(F.count("*").alias("n_scanned")).join(F.broadcast(rows.agg(F.count("*").alias("n_matched"))))  # one row each
    verdict = F.when(F.col("n_matched") > 0, "found").otherwise("not necessarily a true zero: equality of floating-point numbers" if loose else "true zero")
    return counts.select("n_scanned", "n_matched", F.lit("; ".join(g for g in given if g) or "(no filter)").alias("filters"), verdict.alias("verdict"))


def shown_columns(columns: list[str], inputs: list[str], output: str) -> list[str]:
    """What a listing shows unless columns are named: inputs without provenance, the ranked output, delegation and namespace."""
    wanted = [c for c in inputs if not c.startswith("_")] + [output, "_delegation_id", "_namespace"]
    return [c for c in wanted if c in columns]


def without_provenance(df: DataFrame) -> DataFrame:
    """The columns whose name has no underscore in front."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def objective_range(df: DataFrame, group: list[str]) -> DataFrame:
    """Least and largest feasible value of the first numeric column that is no provenance, by group."""
    first = next(f.name for f in df.schema if not f.name.startswith("_") and f.name not in group and f.dataType.simpleString() in ("double", "float", "int", "bigint"))
    return feasible(df, first).groupBy(*group).agg(F.lit(first).alias("objective"), F.min(first).alias("least"), F.max(first).alias("largest"))


def subset_match(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that some key matches on the key's own non-null columns, numbers rounded to ten places.

    Keys with the same columns present join by equality; there is one join for
    each such set of columns, not one for each key.
    """
    present = keys.select(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull()).alias("own")).distinct().collect()  # at most 2^columns sets
    rounded = {c: round_half_even(F.col(c).cast("double")) for c in columns}
    wide = rows.withColumns({f"_r_{c}": v for c, v in rounded.items()})
    out = None
    for (own,) in present:
        if not own:
            return rows
        some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() if c in own else F.col(c).isNull() for c in columns])
        named = keys.filter(some).select(*[rounded[c].alias(f"_r_{c}") for c in own]).distinct()
        hit = wide.join(named, [f"_r_{c}" for c in own], "left_semi").select(*rows.columns)
        out = hit if out is None else out.unionByName(hit)
    return rows.limit(0) if out is None else out.distinct()


def keep_first(batch: DataFrame, history: DataFrame, inputs: list[str], order: list[str], scope: list[str] | None = None) -> DataFrame:
    """Rows of a batch whose design is new: not in the history and the first of its kind in the batch, within `scope`."""
    key = [f"_k_{c}" for c in sorted(inputs)] + (scope or [])
    coordinates = {f"_k_{c.strip()}": round_half_even(F.col(c).cast("double")) for c in inputs}
    new = batch.withColumns(coordinates)
    old = history.withColumns(coordinates).select(*key).distinct()
    first = Window.partitionBy(*key).orderBy(*order)
    fresh = new.join(old, key, "left_anti").withColumn("_n", F.row_number().over(first))
    return fresh.filter("_n = 1").select(*batch.columns)


def store_guard(old: DataFrame, new: DataFrame, keys: list[str], status: str = "status", done: str = "FINISHED") -> DataFrame:
    """Whether a write may replace a store: one row of both counts, rows that lose their finished status, and the verdict."""
    counts = old.agg(F.count("*").alias("n_old")).join(F.broadcast(new.agg(F.count("*").alias("n_new"))))
    lost = old.filter(F.col(status) == done).join(new.filter(F.col(status) == done), keys, "left_anti").agg(F.count("*").alias("n_unfinished"))
    out = counts.join(F.broadcast(lost))
    return out.withColumn("allowed", (F.col("n_new") >= F.col("n_old")) & (F.col("n_unfinished") == 0))


def supersede(store: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the fresh rows in place of those of equal keys; columns that one side lacks are null there."""
    return store.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


#: Words of 32 bits of a row's digest that are added up.
WORDS = 16


def content_state(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Of each group n rows and sums (modulo 2^64) of the 32-bit words of the SHA-256 of its rows, rounded, behind `a` and behind `b`.

    Sums are combined before the shuffle and don't depend on order, on parts
    or on other groups; states of two sets of rows add up to that of both (merged()).
    """
    row = F.concat_ws("|", *[F.coalesce(F.format_string("%.10f", round_half_even(F.col(c).cast("double"))), F.lit("null")) for c in columns])
    digest = F.concat(*[F.sha2(F.concat(F.lit(x), row), 256) for x in "ab"])
    hashed = df.select(*(group or []), digest.alias("_h"))
    sums = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(WORDS)]
    return _wrapped(hashed.groupBy(*(group or [])), F.count("*"), sums, group or [])


def merged(states: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One state for each group of several sets of rows."""
    return _wrapped(states.groupBy(*(group or [])), F.sum("n"), [F.sum(F.element_at("sums", i + 1)) for i in range(WORDS)], group or [])


def _wrapped(grouped, n: Column, sums: list[Column], group: list[str]) -> DataFrame:
    out = grouped.agg(n.alias("n"), *[F.coalesce(s, F.lit(0)).cast("decimal(38,0)").alias(f"_s{i}") for i, s in enumerate(sums)])
    return out.select(*group, F.coalesce("n", F.lit(0)).alias("n"), F.array(*[(F.col(f"_s{i}") % F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)") for i in range(WORDS)]).alias("sums"))


def state_hash(state: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The hash that stands for a state: SHA-256 of its count and sums."""
    text = F.concat_ws(",", F.col("n").cast("string"), F.transform("sums", lambda s: s.cast("string")))
    return state.select(*(group or []), F.col("n").alias("n_rows"), F.sha2(text, 256).alias("content_hash"))


def content_hash(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """A hash of each group's rows, rounded, whatever their order, that follows from these rows alone."""
    return state_hash(content_state(df, columns, group), group)


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column: binary if all its values are 0, 1 or truth words, numeric if all are numbers, else label."""
    text = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))
    long = df.select(F.explode(text).alias("column", "text")).filter("text is not null")
    value = F.when(F.lower("text") == "true", 1.0).when(F.lower("text") == "false", 0.0).otherwise(F.col("text").try_cast("double"))
    seen = long.withColumn("value", value).groupBy("column").agg(F.count("*").alias("n"), F.count("value").alias("n_number"), F.count_if(F.col("value").isin(0.0, 1.0)).alias("n_binary"))
    return seen.select("column", F.when(F.col("n_binary") == F.col("n"), "binary").when(F.col("n_number") == F.col("n"), "numeric").otherwise("label").alias("kind"), "n")


def orphans(ledger: DataFrame, log: DataFrame, group: str = "_delegation_id", key: str = "id") -> DataFrame:
    """Stamped delegations, with their rows, that the log doesn't know."""
    return real(ledger).groupBy(group).agg(F.count("*").alias("n_rows")).join(log.select(F.col(key).alias(group)).distinct(), group, "left_anti")


def reconcile(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Claimed against stamped evaluations of each id: stamps win, a claim without any is off the ledger, if it is registered."""
    counts = real(ledger).groupBy(F.col("_delegation_id").alias("id")).agg(F.count("*").alias("n_stamped"))
    out = claims.join(counts, "id", "left").withColumn("n_stamped", F.coalesce("n_stamped", F.lit(0)))
    off = (F.col("claimed") > 0) & (F.col("n_stamped") == 0) & F.col("registered")
    return out.select("id", "claimed", "n_stamped", F.when(F.col("n_stamped") > 0, F.col("n_stamped")).when(off, 0).otherwise(F.col("claimed")).cast("long").alias("n_evals"), off.alias("off_ledger"))


def best_so_far(df: DataFrame, value: str, group: list[str], order: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """Running minimum of the feasible values of each group, which may have any number of rows."""
    return running_min(df, "best_so_far", F.when(F.abs(value) < SENTINEL, F.col(value)), group, order, most_rows)


def budget_snapshot(df: DataFrame, group: str, budget: int) -> DataFrame:
    """Used and remaining evaluations of each group, and whether the budget is spent."""
    used = real(df).groupBy(group).agg(F.count("*").alias("used"))
    return used.select(group, "used", F.greatest(F.lit(budget) - F.col("used"), F.lit(0)).cast("long").alias("remaining"), (F.col("used") >= budget).alias("exhausted"))


def append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, by the columns both have, that are missing from the new table; none means that it was only added to."""
    common = [c for c in old.columns if c in new.columns]
    return old.select(*common).exceptAll(new.select(*common))
