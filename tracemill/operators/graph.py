"""Graphs as edge tables: components, closure, layers, trees, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.scratch import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v")
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Columns node and root, the smallest node reachable, for every node that has an edge to another.

    Each round is stored in the shared folder; only counts and checksums come
    to the driver. Nodes are longs; nulls, loops and repeated edges are ignored.
    """
    now = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()
    now = stored(now, "edges")
    mark = None
    for _ in range(most_rounds):
        new = stored(_small_star(_large_star(now)), "edges")
        drop_stored(now)
        now, was = new, mark
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def closure(edges: DataFrame, start: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """Every node (column dst) that each start node (src) reaches; cycles are fine. Only newly reached pairs are joined again."""
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("next")).distinct()
    seen = edges.select("src", "dst") if start is None else edges.join(start.select("src").distinct(), "src", "left_semi").select("src", "dst")
    seen = fresh = stored(seen.distinct(), "closure")
    for _ in range(most_rounds):
        more = fresh.join(step, F.col("dst") == F.col("mid")).select("src", F.col("next").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")
        fresh = stored(more, "closure")
        if not fresh.head(1):
            return seen
        seen = seen.unionByName(fresh)  # each round's pairs are written once
    raise RuntimeError(f"the closure has not settled after {most_rounds} rounds")


def layers(nodes: DataFrame, edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Steps from the nearest root to each node; what no root reaches is one layer behind the last."""
    seen = fresh = stored(roots.select("node").distinct().withColumn("layer", F.lit(0)), "layers")
    for n in range(1, most_rounds):
        more = edges.join(fresh, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        fresh = stored(more.withColumn("layer", F.lit(n)), "layers")
        if not fresh.head(1):
            return nodes.select("node").distinct().join(seen, "node", "left").withColumn("layer", F.coalesce("layer", F.lit(n)))
        seen = stored(seen.unionByName(fresh), "layers")
    raise RuntimeError(f"more than {most_rounds} layers")


def tree_paths(nodes: DataFrame, separator: str = " > ", most_depth: int = 64) -> DataFrame:
    """node, depth and path of labels from the root, for a tree given as node, parent (null at the roots) and label."""
    level = nodes.filter("parent is null").select("node", F.lit(0).alias("depth"), F.col("label").alias("path"))
    out = level
    for _ in range(most_depth):
        above = level.select(F.col("node").alias("parent"), "depth", "path")
        level = stored(nodes.join(above, "parent").select("node", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit(separator), "label").alias("path")), "tree")
        if not level.head(1):
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"deeper than {most_depth}")


def pair_counts(cases: DataFrame, case: str, item: str) -> DataFrame:
    """How many cases hold both of two items (a < b). A case's distinct items are few: its size is that of one order or one file."""
    held = cases.select(case, item).distinct()
    left = held.select(case, F.col(item).alias("a"))
    return left.join(held.select(case, F.col(item).alias("b")), case).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def partners(pairs: DataFrame, k: int) -> DataFrame:
    """Each item's k most frequent partners, ties by name."""
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner"), "n").unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("partner"), "n"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "partner"))).filter(F.col("rank") <= k)


def never_paired(cases: DataFrame, case: str, item: str, least: int, edges: DataFrame | None = None, k: int = 6) -> DataFrame:
    """item, other, n and rank: the k best-known items (in `least` cases or more) that no case holds beside an item.

    Left out are items that come along anyway: those that the item, or one it
    stands beside in some case, reaches by edges (src, dst). Candidates of an
    item are the best-known ones, as many as it could have to leave out and k
    more, so that nothing is lost and pairs aren't all made.
    """
    known = cases.groupBy(item).agg(F.countDistinct(case).alias("n")).filter(F.col("n") >= least).select(F.col(item).alias("other"), "n")
    known = stored(known.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "other"))), "known-items")  # the vocabulary, not the cases
    items = cases.select(F.col(item).alias("item")).distinct()
    pairs = pair_counts(cases, case, item)
    beside = pairs.select(F.col("a").alias("item"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("other")))
    own = items.select("item", F.col("item").alias("other"))
    out = beside.unionByName(own)
    if edges is not None:
        reach = closure(edges)
        out = out.unionByName(out.join(reach, F.col("other") == F.col("src")).select("item", F.col("dst").alias("other")))
    out = stored(out.join(known.select("other"), "other", "left_semi").select("item", "other").distinct(), "not-candidates")
    need = items.join(out.groupBy("item").agg(F.count("*").alias("m")), "item", "left").select("item", (F.coalesce("m", F.lit(0)) + k).alias("m"))
    candidates = need.select("item", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("place")).join(known, "place")
    left = candidates.join(out, ["item", "other"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("place"))).filter(F.col("rank") <= k).select("item", "other", "n", "rank")


def merge_records(records: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key and cluster, the least key among the records that shared names link (null names link nothing).

    Each name is tied to the least key that has it, so a name in n records
    costs n links. A record that shares names with two clusters joins them.
    """
    named = records.select(key, F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ":"), F.col(c))) for c in names])).alias("name")).filter("name is not null")
    least = named.groupBy("name").agg(F.min(key).alias("least"))
    links = named.join(least, "name").select(F.col(key).alias("a"), F.col("least").alias("b"))
    found = components(links)
    return records.select(key).distinct().join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", key).alias("cluster"))
