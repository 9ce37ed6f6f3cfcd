"""Exact top-k inner products by a three-phase uniform threshold over lists of local scores (operator 10)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.shared import ship, stored, tidied
from tracemill.llm.vectors import Best, in_groups, matrix, queries_of, ranked, resolved, steps, usable

#: Lists of local scores: a score is the sum of the inner products over so many runs of dimensions.
LISTS = 8
#: Most queries of a group.
QUERIES = 2048
_LOW, _HIGH = -(2**63), 2**63 - 1


def whole(x: np.ndarray, scale: float = 1024.0) -> np.ndarray:
    """floor(scale * x) as exact numbers: doubles while all sums stay exact, else Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not y.size or np.abs(y).max() ** 2 * y.shape[1] < 2**53:
        return y
    return np.array([[int(v) if np.isfinite(v) else int(scale) * int(w) for v, w in zip(r, s)] for r, s in zip(y, x)], object)


def _alike(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are if their products are exact, else both as Python integers."""
    if q.dtype == object or x.dtype == object or q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2**53:
        return tuple(y if y.dtype == object else np.array([[int(v) for v in r] for r in y], object).reshape(y.shape) for y in (q, x))
    return q, x


def _below(x: np.ndarray) -> np.ndarray:
    """Doubles no greater than exact numbers."""
    if x.dtype != object:
        return x
    return np.array([-np.inf if v < -(10**300) else np.nextafter(float(min(v, 10**300)), -np.inf) for v in x.ravel()]).reshape(x.shape)


def local_scores(q: np.ndarray, x: np.ndarray, lists: int) -> np.ndarray:
    """lists x queries x rows: doubles, exact or (where numbers are too large for that) slightly less."""
    q, x = _alike(q, x)
    cut = np.linspace(0, q.shape[1], lists + 1).astype(int)
    return np.stack([_below(q[:, a:b] @ x[:, a:b].T) if b > a else np.zeros((len(q), len(x))) for a, b in zip(cut, cut[1:])])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row as longs; what lies beyond them is held at the ends of their range."""
    q, x = _alike(whole(q), whole(x))
    if q.dtype != object:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([min(max(v, _LOW), _HIGH) for v in (q * x).sum(1)], np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int, lists: int = LISTS, seen: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest sums of floor(1024 x) floor(1024 y), exactly.

    rows and queries have the columns id and v, vectors of one length; queries
    come in groups, which are broadcast. Every run of dimensions is a list of
    local scores, counted from the list's least score so that none is
    negative. Phase 1 gathers the k best of each list; the k-th best sum of
    what is known is a first bound. Phase 2 broadcasts its share for each list
    as a cutoff: a row below it in all lists can't reach the bound. The sums of
    entries above it give a better bound, and rows whose best possible sum
    reaches that are candidates. Phase 3 adds up a candidate's other lists where
    it stands, by which a task keeps k for each query, of equal sums those of
    smaller ids (`seen` gets the table of a group's), and joins their vectors
    by key for scores in whole numbers.

    Rows with the query's id are its own and no candidates; ties go to the
    smaller vec_id; rows that repeat an id are candidates each for itself. A
    score beyond the range of longs is held at its end and ties there. Empty
    tables give an empty result.
    """
    spark = rows.sparkSession
    ship(spark)

    def one(ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
        group = spark.sparkContext.broadcast((ids, vectors))

        def locals_of(batches):
            """For each batch its ids and, for a few queries at a time, their places, local scores and which rows are their own."""
            ids, vectors = group.value
            whole_q = [whole(vectors[at]) for at in steps(len(ids))]
            for b in batches:
                if b.num_rows:
                    id_, x = b.column(0).to_numpy(), whole(matrix(b.column(1), b.num_rows))
                    yield id_, ((at, local_scores(q, x, lists), ids[at, None] == id_[None, :]) for at, q in zip(steps(len(ids)), whole_q))

        def gather(batches):
            n = len(group.value[0])
            best = [Best(n, k) for _ in range(lists)]
            least = np.full((lists, n), np.inf)
            for id_, parts in locals_of(batches):
                for at, local, own in parts:
                    for j in range(lists):
                        least[j, at] = np.minimum(least[j, at], np.where(own, np.inf, local[j]).min(1))
                        best[j].add(np.where(own, -np.inf, local[j]), id_)
                for b in best:
                    b.merge()
            for j, b in enumerate(best):
                q, id_, local = b.rows()
                yield pa.RecordBatch.from_pydict({"q": q, "list": np.full(len(q), j, np.int32), "vec_id": id_, "local": local, "least": least[j, q]})

        heads = stored(rows.select("id", "v").mapInArrow(tidied(gather), "q int, list int, vec_id long, local double, least double"), "heads")
        floors = heads.groupBy("q", "list").agg(F.min("least").alias("floor"))
        # a list's entry counts once for rows that repeat an id, so a sum is never above that of one row
        known = heads.groupBy("q", "list", "vec_id").agg(F.min("local").alias("local")).join(floors, ["q", "list"])
        sums = known.groupBy("q", "vec_id").agg(F.sum(F.col("local") - F.col("floor")).alias("sum"))
        kth = sums.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sum")))).filter(F.col("n") == k).select("q", F.col("sum").alias("first"))
        # a few numbers for each query of the group
        first, floor = np.zeros(len(ids)), np.zeros((lists, len(ids)))
        for r in kth.toArrow().to_pylist():
            first[r["q"]] = r["first"] if r["first"] < 2**53 else r["first"] * (1 - 1e-12)
        for r in floors.toArrow().to_pylist():
            floor[r["list"], r["q"]] = r["floor"]
        cutoffs = spark.sparkContext.broadcast((np.nan_to_num(first, nan=0.0, posinf=0.0), floor))

        def collect(batches):
            first, floor = cutoffs.value
            second = first.copy()  # the k-th best sum of entries above the cutoff, so far
            best = Best(len(first), k)
            kept: list[list] = [[], [], [], []]
            for id_, parts in locals_of(batches):
                for at, local, own in parts:
                    with np.errstate(invalid="ignore"):
                        above = np.nan_to_num(local - floor[:, at, None], nan=np.inf)
                    over = above * lists >= first[None, at, None]
                    sums = np.where(over, above, 0).sum(0)
                    most = sums + (lists - over.sum(0)) * (first[at, None] / lists)
                    best.add(np.where(own, -np.inf, sums), id_)
                    q, r = np.nonzero(over.any(0) & ~own & (most * (1 + 1e-12) >= second[at, None]))
                    total = above[:, q, r].sum(0)  # the candidates' other lists stand here too
                    each, low = local[:, q, r], floor[:, q + at.start]
                    exact = (total < 2**53) & np.all([(y == np.floor(y)) & (np.abs(y) < 2**52) for y in (each, low)], axis=(0, 1))
                    for c, v in zip(kept, (q + at.start, id_[r], np.where(exact, total, sums[q, r]), np.where(exact, total, most[q, r]))):
                        c.append(v)
                best.merge()
                if best.score.shape[1] == k:
                    second = np.maximum(second, np.where(np.isfinite(best.score.min(1)), best.score.min(1), 0))
                kept = [[c] for c in leading([np.concatenate(c) for c in kept], second)]
            if kept[0]:
                q, id_, sums, most = (c[0] for c in kept)
                yield pa.RecordBatch.from_pydict({"q": q.astype(np.int32), "vec_id": id_, "sum": sums, "most": most})

        def leading(kept: list[np.ndarray], second: np.ndarray) -> list[np.ndarray]:
            """Of candidates with known sums each query's k best by sum and id, whose k-th raises its bound; of others those that may reach the bound."""
            q, id_, sums, most = kept
            order = np.lexsort([id_, -sums, sums != most, q])
            known = (sums == most)[order]
            group = q[order] * 2 + ~known
            starts = np.searchsorted(group, group)
            place = np.arange(len(order)) - starts
            at_k = known & (place == k - 1)
            second[q[order[at_k]]] = np.maximum(second[q[order[at_k]]], sums[order[at_k]])
            still = np.where(known, place < k, True) & (most[order] * (1 + 1e-12) >= second[q[order]])
            return [c[order[still]] for c in kept]

        entries = stored(rows.select("id", "v").mapInArrow(tidied(collect), "q int, vec_id long, sum double, most double"), "entries")
        best_sums = Window.partitionBy("q").orderBy(F.desc("sum"))
        second = entries.withColumn("n", F.row_number().over(best_sums)).filter(F.col("n") == k).select("q", F.col("sum").alias("second"))
        found = entries.join(second, "q", "left").filter(F.col("second").isNull() | (F.col("most") * (1 + 1e-12) >= F.col("second")))
        if seen:
            seen(found)
        return ranked(resolved(rows, found.select("q", "vec_id"), group, exact_scores, "long"), k)

    return in_groups(queries, one, "long", QUERIES)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", zero=True)
    return top_k(rows, queries_of(rows, 100), 10)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
