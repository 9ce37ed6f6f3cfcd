"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.shared import WORD, stored

TREE = ("domain", "lang", "source")
#: Parts of a leaf by hash; only the part that holds the end of a prefix is sorted.
PARTS = 1024
#: Leaves up to which the plan of leaves is broadcast; beyond, it is joined by a shuffle.
BROADCAST_LEAVES = 20_000


def token_count(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def allot(nodes: DataFrame, parents: list[str], weight: str = "weight") -> DataFrame:
    """Shares each parent's `budget` among its children by weight, none above its `room`; adds `share`.

    What a full child leaves is dealt to its siblings, again by weight: the
    share is least(room, level * weight) for the one level at which the shares
    add up to the budget (or to all the room). A weight of null or below 0 is 0.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    by = Window.partitionBy(*parents)
    ordered = by.orderBy("_need", *[c for c in nodes.columns if c in TREE])
    full = F.coalesce(F.sum("room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = nodes.withColumn("_w", w).withColumn("_need", F.when(F.col("_w") > 0, F.col("room") / F.col("_w")).otherwise(F.lit(float("inf"))))
    out = out.withColumn("_level", F.when(rest > 0, (F.col("budget") - full) / rest))
    # the children in order of need fill up until the level that is left falls below their need
    level = F.max(F.when(F.col("_level") <= F.col("_need"), F.col("_level"))).over(by)
    share = F.when(F.col("_w") == 0, 0.0).when(level.isNull(), F.col("room")).otherwise(F.least(F.col("room"), F.greatest(level, F.lit(0.0)) * F.col("_w")))
    return out.withColumn("share", share).drop("_w", "_need", "_level")


def leaf_budgets(leaves: DataFrame, weights: dict[str, DataFrame], budget: float, epochs: float) -> DataFrame:
    """The tree's columns, tokens and target for each leaf.

    leaves has the tree's columns and tokens. weights gives for a level a table
    of its columns so far and weight; a node without a row there weighs 1. A
    leaf takes its tokens `epochs` times at most. Going down level by level
    with the room of whole subtrees, shortages go to siblings first and only
    what those can't take to the siblings of an ancestor.
    """
    out = leaves.withColumn("room", F.col("tokens") * F.lit(float(epochs))).withColumn("share", F.lit(float(budget)))
    for depth, level in enumerate(TREE):
        path, parents = list(TREE[: depth + 1]), list(TREE[:depth])
        nodes = out.groupBy(*path).agg(F.sum("room").alias("room"), F.first("share").alias("budget"))
        if level in weights:
            given = weights[level].select(*[F.col(c).alias(f"_{c}") for c in path], "weight").dropDuplicates([f"_{c}" for c in path])
            on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path]
            nodes = nodes.join(given, on, "left").drop(*[f"_{c}" for c in path]).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        shares = allot(nodes, parents).select(*[F.col(c).alias(f"_{c}") for c in path], F.col("share").alias("_share"))
        out = out.join(shares, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path]).drop("share", *[f"_{c}" for c in path]).withColumnRenamed("_share", "share")
    return out.select(*TREE, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("target"))


def order_key(key: Column, seed: int) -> Column:
    """Place of a document in an epoch's seeded order."""
    return F.xxhash64(key, F.col("epoch"), F.lit(seed))


def mix(docs: DataFrame, weights: dict[str, DataFrame], budget: Column | float, epochs: int = 2, seed: int = 17, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Documents chosen to the leaves' targets: the tree's columns, the key, `keep`, n_tokens and epoch (from 0).

    docs has the tree's columns, the key and n_tokens; budget is a number of
    tokens or a share of all (a Column over sum of n_tokens as `total`). A
    leaf's target is filled with whole epochs, then with the longest prefix of
    the next epoch's seeded order that doesn't exceed it. Ties of the order
    fall by key; rows that repeat a key and its place are taken or left in any
    order. Texts without tokens go with their leaf's epochs and with prefixes that
    pass their place; a leaf of such texts alone has no epochs and no rows. Null tree columns are nodes of their own. Empty tables give no rows.
    """
    keep = keep or []
    leaves = stored(docs.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    if isinstance(budget, Column):
        budget = leaves.agg(F.sum("tokens").alias("total")).select(budget.cast("double")).first()[0] or 0.0
    plan = leaf_budgets(leaves, weights, budget, epochs)
    tokens = F.greatest(F.col("tokens"), F.lit(1))
    plan = stored(plan.select(*[F.col(c).alias(f"_{c}") for c in TREE], F.expr("target div greatest(tokens, 1)").cast("int").alias("whole"), (F.col("target") % tokens).alias("over")), "leaf-plan")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TREE]

    part = F.pmod(F.shiftright("place", 40), F.lit(PARTS)).cast("int")
    rows = docs.join(plan, on).withColumn("epoch", F.col("whole")).withColumn("place", order_key(F.col(key), seed).bitwiseAND(F.lit(2**50 - 1))).withColumn("part", part)
    sums = rows.groupBy(*[f"_{c}" for c in TREE], "part").agg(F.sum("n_tokens").alias("sum"), F.first("over").alias("over"))
    up_to = F.sum("sum").over(Window.partitionBy(*[f"_{c}" for c in TREE]).orderBy("part"))
    cut = sums.withColumn("before", up_to - F.col("sum")).filter((F.col("before") + F.col("sum")) > F.col("over"))
    cut = cut.groupBy(*[F.col(f"_{c}").alias(f"c_{c}") for c in TREE]).agg(F.min(F.struct("part", "before")).alias("cut"))
    cut = stored(cut.select(*[f"c_{c}" for c in TREE], F.col("cut.part").alias("cut"), F.col("cut.before").alias("before")), "leaf-cuts")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_LEAVES else cut
    placed = rows.join(cut, [F.col(f"_{c}").eqNullSafe(F.col(f"c_{c}")) for c in TREE], "left")

    columns = [*TREE, key, *keep, "n_tokens"]
    whole = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    clear = F.when((F.col("over") > 0) & (F.col("part") < F.col("cut")), F.concat(whole, F.array("epoch"))).otherwise(whole)
    certain = placed.select(*columns, F.explode(clear).alias("epoch"))
    sorted_ = Window.partitionBy(*[f"_{c}" for c in TREE]).orderBy("place", key)
    edge = placed.filter((F.col("over") > 0) & (F.col("part") == F.col("cut"))).withColumn("sum", F.col("before") + F.sum("n_tokens").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    return certain.unionByName(edge.filter(F.col("sum") <= F.col("over")).select(*columns, "epoch"))


def domain_of(source: str = "source") -> Column:
    """The query's rule for domains: sources fall into four by the crc32 of their name."""
    return F.concat(F.lit("domain"), F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")) % 4)


def target_weights(spark: SparkSession) -> dict[str, DataFrame]:
    """The query's weights: domain n weighs n + 1, English as much as the other languages of a domain together, sources alike."""
    domain = F.concat(F.lit("domain"), "id").alias("domain")
    lang = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("en", "de", "fr", "es"))), F.array(*map(F.lit, (3.0, 1.0, 1.0, 1.0))))).alias("lang", "weight")
    return {"domain": spark.range(4).select(domain, (F.col("id") + 1.0).alias("weight")), "lang": spark.range(4).select(domain, lang)}


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", domain_of().alias("domain"), token_count().alias("n_tokens"))
    return mix(docs, target_weights(spark), F.col("total") * 0.6, epochs=2)


