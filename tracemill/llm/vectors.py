"""Vector tables, and scans of all rows for stated queries in groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.shared import scratch, stored, tidied

#: A group of queries, which a scan broadcasts: so many at most, and so many bytes of their vectors.
GROUP, GROUP_BYTES = 4096, 16 << 20
#: Queries whose scores a task holds at a time.
STEP = 64


def usable(vectors: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """Columns id and v (array<double>) of the vectors that take part.

    Left out are rows without an id, vectors that are null or empty, that hold
    a null or non-finite component or are not of the commonest length (of equal
    counts the smaller) and, unless `zero`, those of zeros only.
    """
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = v.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    if not zero:
        kept = kept.filter(F.exists("v", lambda x: x != 0))
    common = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("v") == (common["n"] if common else 0))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by `every`, one for each id (of several the least vector)."""
    return rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 1))


def query_groups(queries: DataFrame, most: int = GROUP, size: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, dealt by hash into groups of about `most` at most or `size` bytes, one after another."""
    queries = stored(queries, "queries")
    count, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    groups = max(-(-count // most), -(-count * width * 8 // size))
    for g in range(groups):
        t = queries.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()  # about `size` bytes
        if t.num_rows:
            yield t["id"].to_numpy(), matrix(t["v"], t.num_rows)


class Best:
    """The k best candidates of each of some queries, over batches: scores and ids, of equal scores those of smaller ids. -inf is no candidate."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.ids = np.zeros((queries, 0)), np.zeros((queries, 0), np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []

    def _top(self, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if score.shape[1] <= self.k:
            return score, ids
        top = np.argpartition(score, score.shape[1] - self.k, axis=1)[:, -self.k :]
        kth = np.take_along_axis(score, top[:, :1], 1)  # where the partition is cut
        ties = (score == kth).sum(1)
        for i in np.flatnonzero((ties > (np.take_along_axis(score, top, 1) == kth).sum(1)) & (kth[:, 0] > -np.inf)):
            above, same = np.flatnonzero(score[i] > kth[i]), np.flatnonzero(score[i] == kth[i])
            top[i] = np.append(above, same[np.argsort(ids[i, same], kind="stable")[: self.k - len(above)]])
        return np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries x candidates) of the next queries of a batch, and the candidates' ids."""
        self._new.append(self._top(score, np.broadcast_to(ids, score.shape)))

    def merge(self) -> None:
        """Joins a batch, of which all queries have been added, with what was best so far."""
        score, ids = (np.concatenate(x) for x in zip(*self._new))
        self.score, self.ids = self._top(np.concatenate([self.score, score], 1), np.concatenate([self.ids, ids], 1))
        self._new = []

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of all that is kept."""
        q, at = np.nonzero(self.score > -np.inf)
        return q.astype(np.int32), self.ids[q, at], self.score[q, at]


def steps(n: int, size: int = STEP) -> Iterator[slice]:
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def resolved(rows: DataFrame, found: DataFrame, group: Broadcast, score: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """query_id, vec_id and score of candidates found (columns q and vec_id): their vectors alone are needed again.

    q is a place in the group, a broadcast of the ids and vectors of queries.
    score takes a matrix of queries and one of candidates, row by row.
    """
    of = found.groupBy("vec_id").agg(F.collect_set("q").alias("q"))

    def run(batches):
        ids, vectors = group.value
        for b in batches:
            many = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            q = b.column(2).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), many)
            x, id_ = matrix(b.column(1), b.num_rows), b.column(0).to_numpy(zero_copy_only=False)
            for at in steps(len(q), 65536):
                yield pa.RecordBatch.from_pydict({"query_id": ids[q[at]], "vec_id": id_[row[at]], "score": score(vectors[q[at]], x[row[at]])})

    joined = rows.join(of, rows["id"] == of["vec_id"]).select("id", "v", "q")
    return joined.mapInArrow(tidied(run), f"query_id long, vec_id long, score {kind}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def in_groups(queries: DataFrame, search: Callable[[np.ndarray, np.ndarray], DataFrame], kind: str, most: int = GROUP) -> DataFrame:
    """Results of search(ids, vectors) for each group of queries, in one stored table."""
    spark = queries.sparkSession
    path = scratch(spark, "found")
    schema = f"query_id long, rank int, vec_id long, score {kind}"
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, vectors in query_groups(queries, most):
        search(ids, vectors).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
