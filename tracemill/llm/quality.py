"""Quality classifier: a factorisation machine over hashed words, text structure and size (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import LOWER, give_back, ship, stored, tidied

#: Slots for hashed words; the slots of the structure statistics follow them.
SLOTS = 1 << 17
BINS = 16
RANK = 8
#: Most labelled rows that the model is fitted on: those with the smallest hashes of their doc_id.
MAX_TRAIN = 24_000
#: Bytes of features that the driver fits on.
MAX_BYTES = 256 << 20

_LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 0xC3 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,'-" for b in range(256)])
STATS = 13


def structure(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Size and structure statistics of a text; the words are lower-cased."""
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, n = max(1, int(hist[_LETTERS].sum())), max(1, len(words))
    lines = raw.split(b"\n")
    return [
        np.log2(len(raw) + 1),
        len(raw) / n,
        hist[_UPPER].sum() / letters,
        hist[_MARK].sum() / max(1, len(raw)),
        hist[_DIGIT].sum() / max(1, len(raw)),
        hist[0x80:].sum() / max(1, len(raw)),
        np.log2(distinct + 1) - 0.8 * np.log2(n + 1),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(w[-1:] in b"!$%&*#@|~^?" for w in words) / n,
        sum(w.isdigit() or not w[:1].isalpha() and w[0] < 128 for w in words) / n,
        len(words) / len(lines),
        1 - len({*lines}) / len(lines),
        (hist[46] + hist[44]) / n,
    ]


def text_features(text: bytes | None) -> tuple[np.ndarray, list[float]]:
    """Slots of the distinct words of a whole text, and its statistics."""
    raw = text or b""
    words = raw.translate(LOWER).split()
    distinct = {*words}
    slots = np.unique(np.fromiter(map(crc32, distinct), np.int64, len(distinct)) % SLOTS)
    return slots, structure(raw, words, len(distinct))


@dataclass
class FactorisationMachine:
    """score(x) = sigmoid(bias + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2))."""

    edges: np.ndarray  # STATS x (BINS - 1)
    bias: float
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def width() -> int:
        return SLOTS + STATS * BINS

    def rows(self, slots: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of texts, one after another, and where each text starts."""
        bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats.T)], 1)
        own = SLOTS + np.arange(STATS) * BINS + bins
        sizes = np.array([len(s) for s in slots], np.int64)
        index = np.concatenate([x for s, o in zip(slots, own) for x in (s, o)])
        value = np.concatenate([x for n in sizes for x in (np.full(n, 1 / np.sqrt(max(n, 1)), np.float32), np.ones(STATS, np.float32))])
        return index, value, np.concatenate([[0], np.cumsum(sizes + STATS)[:-1]])

    def margins(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin of each text, the factor sums and the weighted factors, in time linear in the features."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, start, axis=0)
        pairs = (sums**2 - np.add.reduceat(vx**2, start, axis=0)).sum(1) / 2
        return self.bias + np.add.reduceat(self.w[index] * value, start) + pairs, sums, vx

    def score(self, slots: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        if not slots:
            return np.zeros(0)
        m = self.margins(*self.rows(slots, stats))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


def fit(slots: list[np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 2e-5, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by AdaGrad over mini-batches. Without rows of both labels the scores are the share of label 1 (1/2 without rows)."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    n = FactorisationMachine.width()
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(y) else np.zeros((STATS, BINS - 1))
    model = FactorisationMachine(edges, float(np.log(share / (1 - share))), np.zeros(n, np.float32), np.zeros((n, RANK), np.float32))
    if len({*y.tolist()}) < 2:
        return model
    model.v = rng.normal(0, 0.02, (n, RANK)).astype(np.float32)
    gw, gv, gb = np.full(n, 1e-2, np.float32), np.full((n, RANK), 1e-2, np.float32), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            index, value, start = model.rows([slots[i] for i in take], stats[take])
            m, sums, vx = model.margins(index, value, start)
            slope = ((1 / (1 + np.exp(-np.clip(m, -40, 40))) - y[take]) / len(take)).astype(np.float32)
            of = np.repeat(np.arange(len(take)), np.diff(np.append(start, len(index))))
            each = slope[of] * value
            by = np.argsort(index, kind="stable")
            own, first = np.unique(index[by], return_index=True)
            dw = np.add.reduceat(each[by], first) + decay * model.w[own]
            dv = np.add.reduceat((each[:, None] * (sums[of] - vx))[by], first, axis=0) + decay * model.v[own]
            gw[own] += dw**2
            gv[own] += dv**2
            db = float(slope.sum())
            gb += db**2
            model.w[own] -= rate * dw / np.sqrt(gw[own])
            model.v[own] -= rate * dv / np.sqrt(gv[own])
            model.bias -= rate * db / gb**0.5
    return model


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, folds: int = 5) -> FactorisationMachine:
    """Fits on at most `most` labelled rows outside fold 0, a bounded sample by hash; repeated labels of a document count once.

    Of repeated labels the highest quality counts. Rows that repeat a doc_id
    with other texts are examples of their own, rows that are alike are one; of
    all these the `most` of smallest hashes, and features of MAX_BYTES, are taken. Null and empty texts are examples;
    labels without a doc_id or a quality are none. Without rows of both labels
    every score is the share of label 1 (1/2 for empty tables). Other columns don't matter.
    """
    ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(fold(F.col("doc_id"), folds) != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches):
        for batch in batches:
            found = [text_features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.float64())), batch.column(2).cast(pa.int32())], names=["h", "slots", "stats", "y"])

    chosen = docs.join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "quality")
    found = stored(chosen.mapInArrow(tidied(run), "h long, slots binary, stats array<double>, y int"), "training-features")
    sizes = found.groupBy("h").agg(F.max(F.octet_length("slots")).alias("n")).orderBy("h").limit(most).toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), MAX_BYTES, "right"))  # a doc_id may repeat, and texts may be long
    some = found.filter(F.col("h") <= int(sizes["h"][fits - 1].as_py())) if fits else found.limit(0)
    rows = some.dropDuplicates(["h"]).select("slots", "stats", "y").toArrow()
    slots = [np.frombuffer(s, np.int32) for s in rows["slots"].to_pylist()]
    stats = np.array(rows["stats"].to_pylist(), np.float64).reshape(-1, STATS)
    y = (rows["y"].to_numpy() > 0).astype(np.float32)
    by = np.lexsort([y, *stats.T])  # the order of arrival must not matter
    model = fit([slots[i] for i in by], stats[by], y[by])
    del rows, slots, stats
    give_back()
    return model


def scored(docs: DataFrame, model: FactorisationMachine, floor: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 if score >= floor) for every whole text; null counts as empty.

    `names` names the two; columns of docs that have these names are replaced.
    Rows that repeat are scored each for themselves; a tie with the floor is
    predicted 1; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c not in names]
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            scores = []
            for i in range(0, len(texts), 512):
                found = [text_features(t) for t in texts.slice(i, 512).to_pylist()]
                scores.append(model.score([s for s, _ in found], np.array([x for _, x in found])))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= floor).astype(np.int32))], names=[*columns, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns).mapInArrow(tidied(run), f"{schema}, `{names[0]}` double, `{names[1]}` int")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
