"""Approximate nearest neighbours by score-aware anisotropic quantisation (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import ship, stored, tidied
from tracemill.llm.vectors import Best, in_groups, matrix, queries_of, ranked, steps, usable

#: Most vectors that the codebooks are fitted on: those with the smallest hashes of their id. All vectors are indexed.
SAMPLE = 16_000
#: Vectors of the sample against each other, by which the error of estimates is measured.
PROBES = 256
CENTROIDS = 16
#: Rows of a step of the scan, and what single precision may lose of a cosine.
BATCH, ROUNDED = 8192, 1e-5


@dataclass
class Quantiser:
    """A codebook of 16 centroids (four bits) for each pair of dimensions.

    The loss of a vector x with residual r is |r|^2 + (eta - 1) (r . x/|x|)^2:
    residuals along x count eta times, as they change high inner products most.
    """

    books: np.ndarray  # subspaces x 16 x 2
    eta: float

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Nearest centroids, then coordinate descent on the loss."""
        parts, unit = self.split(x)
        code = ((parts[:, :, None] - self.books[None]) ** 2).sum(3).argmin(2)
        at = np.arange(len(self.books))
        along = ((parts - self.books[at, code]) * unit).sum(2).sum(1)
        for _ in range(sweeps):
            for m in range(len(self.books)):
                r = parts[:, m, None] - self.books[m][None]
                p = (r * unit[:, m, None]).sum(2)
                rest = along - p[np.arange(len(x)), code[:, m]]
                code[:, m] = ((r**2).sum(2) + (self.eta - 1) * (rest[:, None] + p) ** 2).argmin(1)
                along = rest + p[np.arange(len(x)), code[:, m]]
        return code.astype(np.uint8)

    def residuals(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Vectors less what their codes stand for."""
        parts, _ = self.split(x)
        return (parts - self.books[np.arange(len(self.books)), code]).reshape(len(x), -1)[:, : x.shape[1]]

    @staticmethod
    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and their unit vectors in parts of two dimensions, an even number of parts."""
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return x.reshape(len(x), -1, 2), unit.reshape(len(x), -1, 2)

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 3) -> Quantiser:
        """Alternates codes and least-squares centroids; `threshold` is the cosine from which scores matter."""
        if not len(x):
            return cls(np.zeros((2, CENTROIDS, 2)), 1.0)
        d = x.shape[1]
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        parts, unit = cls.split(x)
        pick = np.random.default_rng(seed).integers(0, len(x), CENTROIDS)
        own = cls(parts[pick].transpose(1, 0, 2).copy(), eta)
        at = np.arange(parts.shape[1])
        for _ in range(rounds):
            code = own.codes(x, 1)
            along = ((parts - own.books[at, code]) * unit).sum(2)
            for m in at:
                u, rest = unit[:, m], along.sum(1) - along[:, m]
                want = parts[:, m] + (eta - 1) * u * (rest + (parts[:, m] * u).sum(1))[:, None]
                for c in range(CENTROIDS):
                    if (mine := code[:, m] == c).any():
                        a = mine.sum() * np.eye(2) + (eta - 1) * u[mine].T @ u[mine]
                        own.books[m, c] = np.linalg.solve(a, want[mine].sum(0))
                along[:, m] = ((parts[:, m] - own.books[m, code[:, m]]) * u).sum(1)
        return own

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of two codes, the 256 sums of its centroids' inner products."""
        parts, _ = self.split(q)
        one = np.einsum("qmd,mcd->qmc", parts, self.books).astype(np.float32)
        low, high = one[:, 0::2], one[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), low.shape[1], 256)


def pack4(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte, a row for each vector."""
    return np.ascontiguousarray(code[:, 0::2] | code[:, 1::2] << 4)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their lengths, and the lengths; vectors of zeros stay."""
    top = np.maximum(np.abs(x).max(1, initial=0.0), 1e-300)
    n = np.linalg.norm(x / top[:, None], axis=1)
    return x / top[:, None] / np.maximum(n, 1e-300)[:, None], top * n


def index(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Quantiser, float]:
    """id, codes (four bits for two dimensions of the unit vector), length, residual (its length, for the unit vector) and v of every vector; the codebooks; and
    the largest error of an estimated cosine over the residual's length. Books and error are those of `sample` vectors."""
    ship(rows.sparkSession)
    fitted = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toArrow()
    x = unit(matrix(fitted["v"], fitted.num_rows))[0]
    quantiser = Quantiser.fit(x)
    slack = 0.0
    if len(x):
        for at in steps(len(x), 4096):
            rest = quantiser.residuals(x[at], quantiser.codes(x[at]))
            probes = x[:: max(1, len(x) // PROBES)]
            error = np.maximum(np.abs(probes @ rest.T).max(0), np.abs((x[at] * rest).sum(1)))  # with others, and with itself
            slack = max(slack, float((error / np.maximum(np.linalg.norm(rest, axis=1), 1e-12)).max()))

    def run(batches):
        for b in batches:
            for at in steps(b.num_rows, 4096):
                part = b.slice(at.start, at.stop - at.start)
                x, length = unit(matrix(part.column(1), part.num_rows))
                code = quantiser.codes(x)
                residual = np.linalg.norm(quantiser.residuals(x, code), axis=1)
                codes = pack4(code)
                offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets.buffers()[1], pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.array(length), pa.array(residual), part.column(1)], names=["id", "codes", "length", "residual", "v"])

    return rows.select("id", "v").mapInArrow(tidied(run), "id long, codes binary, length double, residual double, v array<double>"), quantiser, min(slack, 1.0)


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, v) its k rows of largest inner product.

    rows and queries have the columns id and v, vectors of one length. Every
    row is coded. For groups of queries, which are broadcast, a scan of the
    codes by four-bit tables estimates all inner products. Exact ones in double
    precision are taken of the k rows of highest estimates of a batch, and then
    of all whose estimate, with the largest error that the sample has shown for
    residuals of that length, reaches the k-th best so far: as many as the rows
    need, whatever their lengths and however close they lie. Rows with the
    query's id are its own and no candidates; ties go to the smaller vec_id; a
    query with fewer candidates than k has them all. Rows that repeat an id
    are candidates each for itself. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    coded, quantiser, slack = index(rows)
    coded = stored(coded, "vector-index")

    def one(ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
        group = spark.sparkContext.broadcast((ids, vectors))

        def scan(batches):
            ids, vectors = group.value
            units, lengths = unit(vectors)
            best = Best(len(ids), k)
            for batch in batches:
                for part in steps(batch.num_rows, BATCH):
                    b = batch.slice(part.start, part.stop - part.start)
                    id_, length, residual = (b.column(c).to_numpy() for c in (0, 2, 3))
                    x = matrix(b.column(4), b.num_rows)
                    codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1).T.copy()
                    room = residual * slack + ROUNDED  # of an estimated cosine
                    for at in steps(len(ids)):
                        near = np.empty((at.stop - at.start, b.num_rows), np.float32)
                        for out, table in zip(near, quantiser.tables(units[at])):
                            np.take(table[0], codes[0], out=out)
                            for t, c in zip(table[1:], codes[1:]):
                                out += t[c]
                        own = ids[at, None] == id_[None, :]
                        exact = np.full(near.shape, -np.inf)
                        most = (near + room) * length  # over the query's length
                        most[own] = -np.inf
                        if b.num_rows > k:
                            first = np.argpartition(most, b.num_rows - k, axis=1)[:, -k:]
                            q, c = np.repeat(np.arange(len(near)), k), first.ravel()
                        else:
                            q, c = np.nonzero(~own)
                        inner(exact, vectors[at], x, q, c)
                        exact[own] = -np.inf
                        # the k-th best so far, here or in earlier batches
                        floor = np.partition(exact, -k, axis=1)[:, -k] if b.num_rows >= k else np.full(len(exact), -np.inf)
                        if best.score.shape[1] >= k:
                            floor = np.maximum(floor, best.score[at].min(1))
                        least = floor / np.maximum(lengths[at], 1e-300)
                        q, c = np.nonzero((most >= (least - np.abs(least) * ROUNDED)[:, None]) & (exact == -np.inf) & ~own)
                        inner(exact, vectors[at], x, q, c)
                        best.add(exact, id_)
                    best.merge()
            q, id_, score = best.rows()
            yield pa.RecordBatch.from_pydict({"query_id": ids[q], "vec_id": id_, "score": score})

        found = coded.mapInArrow(tidied(scan), "query_id long, vec_id long, score double")
        return ranked(found, k)

    return in_groups(queries, one, "double")


def inner(out: np.ndarray, queries: np.ndarray, x: np.ndarray, q: np.ndarray, c: np.ndarray) -> None:
    """Sets the inner products of pairs of queries q and candidates c, by one sum for all, so that copies tie."""
    for at in steps(len(q), max(1, (1 << 20) // queries.shape[1])):
        out[q[at], c[at]] = np.einsum("ij,ij->i", queries[q[at]], x[c[at]])


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", zero=False)
    return search(rows, queries_of(rows, 20), 20)
