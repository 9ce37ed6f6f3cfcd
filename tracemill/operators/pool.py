"""The nearest row of a pool, by cells of a tree over its scaled columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scratch import stored
from tracemill.functions.shipping import ship

#: Pool rows of a cell; rows of the sample that the tree is cut by; levels of the tree (65,536 cells at most, 2 MB of boxes for two columns).
CELL, SAMPLE, DEEPEST = 256, 200_000, 16
#: Candidates that are led through the tree at a time.
TOGETHER = 2048
#: Places to which squared distances are rounded.
DIGITS = 12


@dataclass
class Tree:
    """Planes of a balanced tree: node i is cut at planes[i] in columns[i]; its children are 2 i + 1 and 2 i + 2; cells are the nodes of the last level."""

    depth: int
    columns: np.ndarray
    planes: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, depth: int) -> Tree:
        """Cuts at medians of the column that is spread most there."""
        n = 2**depth - 1
        columns, planes = np.zeros(n, np.int64), np.zeros(n)
        parts = {0: sample}
        for i in range(n):
            x = parts.pop(i)
            if len(x):
                c = int(np.argmax(x.max(0) - x.min(0)))
                columns[i], planes[i] = c, np.median(x[:, c])
            left = x[:, columns[i]] <= planes[i]
            if 2 * i + 2 < n:
                parts[2 * i + 1], parts[2 * i + 2] = x[left], x[~left]
        return cls(depth, columns, planes)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.columns[at]] > self.planes[at])
        return at - (2**self.depth - 1)

    def closest(self, x: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """A cell with rows for each row, near it: down to the child whose box is nearer, of equal ones that on its side of the plane."""
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            far = [(np.maximum(np.maximum(lows[c] - x, x - highs[c]), 0) ** 2).sum(1) for c in (2 * at + 1, 2 * at + 2)]
            right = x[every, self.columns[at]] > self.planes[at]
            at = 2 * at + 1 + np.where(far[0] == far[1], right, far[1] < far[0])
        return at - (2**self.depth - 1)

    def boxes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of all nodes from those of the cells; empty ones are inside out."""
        n = 2**self.depth - 1
        lows, highs = np.full((2 * n + 1, low.shape[1]), np.inf), np.full((2 * n + 1, low.shape[1]), -np.inf)
        lows[n:], highs[n:] = low, high
        for i in range(n - 1, -1, -1):
            lows[i], highs[i] = np.minimum(lows[2 * i + 1], lows[2 * i + 2]), np.maximum(highs[2 * i + 1], highs[2 * i + 2])
        return lows, highs

    def within(self, x: np.ndarray, reach: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells whose squared distance from the row is at most its reach; a node out of reach is not entered."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth + 1):
            off = np.maximum(np.maximum(lows[node] - x[row], x[row] - highs[node]), 0)
            near = (off**2).sum(1) <= reach[row]
            row, node = row[near], node[near]
            if level < self.depth:
                row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
        return row, node - (2**self.depth - 1)


def _numbers(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]], 1).astype(float)


def nearest_pool_row(candidates: DataFrame, pool: DataFrame, columns: list[str], key: str, pool_key: str, cell: int = CELL) -> DataFrame:
    """key, pool_key and distance2 of the pool row nearest to each candidate, each column scaled to the pool's range (one without spread by 1); ties of the rounded distance go to the smaller pool_key.

    Of pool rows that are equal in all columns the one of the smallest pool_key
    stands for all. They lie in the cells of a tree cut by a bounded sample. A
    candidate is compared with a near cell that has rows first; of the others
    it meets only cells whose box (of their real rows) is no farther than what
    it has found.
    Candidates and pool rows without a value in some column are left out; an
    empty pool gives none.
    """
    return searched(candidates, pool, columns, key, pool_key, cell)[0]


def searched(candidates: DataFrame, pool: DataFrame, columns: list[str], key: str, pool_key: str, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The result of nearest_pool_row(), and key and cell of all comparisons made."""
    spark = pool.sparkSession
    ship(spark)
    whole = lambda df, k: df.select(F.col(k).alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna(subset=[f"x{i}" for i in range(len(columns))])
    names = [f"x{i}" for i in range(len(columns))]
    asked = whole(candidates, key)
    rows = stored(whole(pool, pool_key).groupBy(*names).agg(F.min("k").alias("k")).select("k", *names), "pool-points")
    stats = rows.agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names]).first()
    n = stats["n"]
    spread = np.array([(stats[f"hi_{c}"] - stats[f"lo_{c}"]) or 1.0 for c in names]) if n else np.ones(len(names))
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, n) / cell)))))
    # a bounded sample: the smallest hashes of pool keys
    taken = rows.filter(F.pmod(F.xxhash64("k"), F.lit(max(1, n // SAMPLE))) == 0).select(*names).limit(2 * SAMPLE).toArrow() if n else None
    sample = np.stack([taken.column(c).to_numpy() for c in names], 1) / spread if n else np.zeros((0, len(names)))
    tree = Tree.of(sample, depth)
    kind, pool_kind = candidates.schema[key].dataType.simpleString(), pool.schema[pool_key].dataType.simpleString()

    def celled(df: DataFrame, kind: str, cells_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        def run(batches):
            for batch in batches:
                cells = cells_of(_numbers(batch, 1) / spread)
                yield pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns], names=["cell", "k", *names])

        return df.mapInArrow(run, f"cell long, k {kind}, " + ", ".join(f"{c} double" for c in names))

    placed = stored(celled(rows, pool_kind, tree.cells), "pool-cells")
    boxes = placed.groupBy("cell").agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names]).toArrow()  # 2 ** DEEPEST rows at most
    low, high = np.full((2**depth, len(names)), np.inf), np.full((2**depth, len(names)), -np.inf)
    at = boxes.column("cell").to_numpy()
    low[at] = np.stack([boxes.column(f"lo_{c}").to_numpy() for c in names], 1).reshape(-1, len(names)) / spread
    high[at] = np.stack([boxes.column(f"hi_{c}").to_numpy() for c in names], 1).reshape(-1, len(names)) / spread
    shared = spark.sparkContext.broadcast((tree, *tree.boxes(low, high)))

    def near(x: np.ndarray) -> np.ndarray:
        tree, lows, highs = shared.value
        return tree.closest(x, lows, highs)

    square = sum((((F.col(f"c.{c}") - F.col(f"p.{c}")) / F.lit(float(s))) ** 2 for c, s in zip(names, spread)), F.lit(0.0))

    def compared(pairs: DataFrame) -> DataFrame:
        """The best of each candidate's cells. Both sides are dealt by cell; a cell that many candidates meet is split by Spark's skew join."""
        met = pairs.alias("c").join(placed.alias("p"), F.col("c.cell") == F.col("p.cell"))
        return met.groupBy(F.col("c.k").alias("k")).agg(F.min(F.struct(F.round(square, DIGITS).alias("d"), F.col("p.k").alias("p"))).alias("s"))

    own = stored(celled(asked, kind, near), "candidate-cells")
    first = compared(own).select("k", F.col("s.d").alias("reach"))
    reached = stored(own.join(first, "k", "left"), "candidate-reach")

    def others(batches):
        tree, lows, highs = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                reach = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                reach = np.where(np.isnan(reach), np.inf, reach + 2 * 10.0**-DIGITS)  # an empty pool
                row, cells = tree.within(_numbers(part, 3) / spread, reach, lows, highs)
                away = cells != part.column(0).to_numpy()[row]
                row, cells = pa.array(row[away]), pa.array(cells[away])
                yield pa.RecordBatch.from_arrays([cells, *[c.take(row) for c in (part.column(1), *part.columns[3:])]], names=["cell", "k", *names])

    more = reached.select("cell", "k", "reach", *names).mapInArrow(others, f"cell long, k {kind}, " + ", ".join(f"{c} double" for c in names))
    pairs = stored(own.unionByName(more), "candidate-pairs")
    found = compared(pairs)
    out = found.select(F.col("k").alias(key), F.col("s.p").alias(pool_key), F.col("s.d").alias("distance2"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    return out, pairs.select("k", "cell").join(sizes, "cell")


def repeated(found: DataFrame, pool_key: str, order: list[str]) -> DataFrame:
    """found with repeated: whether an earlier lookup, by order, had the same pool row."""
    first = found.groupBy(pool_key).agg(F.min(F.struct(*order)).alias("_first"))
    return found.join(first, pool_key).withColumn("repeated", F.struct(*order) != F.col("_first")).drop("_first")
