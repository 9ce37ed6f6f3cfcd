"""Alignment of two tokenizers' tokens by products of token-byte incidence matrices (operator 12)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import ship, stored, tidied
from tracemill.llm.tokens import byte_of, encoder, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Bytes of text whose matrices are made at a time.
CHUNK = 500_000
#: Id pairs up to which their counts (32 bytes each) are sent to all tasks; more meet the documents by a shuffled join.
MOST_PAIRS = 500_000
#: An id pair as one number: A's id times this and B's id; vocabularies are smaller.
RADIX = 1 << 20


class Csr:
    """A sparse matrix of small counts in compressed rows: the columns of row i are columns[starts[i] : starts[i + 1]], ascending."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int, values: np.ndarray | None = None):
        self.starts, self.columns, self.width = starts, columns, width
        self.values = np.ones(len(columns), np.int64) if values is None else values

    @classmethod
    def of_spans(cls, ends: np.ndarray) -> Csr:
        """Incidence of spans that cover 0, 1, ... without gaps: row i has the places from the end of the one before it to its own end."""
        width = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(width), width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts, self.rows()[order], self.height, self.values[order])

    def times(self, other: Csr) -> Csr:
        """The product, row by row after Gustavson: an entry (i, k) adds its multiple of the other's row k to row i. All rows' sums are gathered at once and equal columns added up."""
        sizes = np.diff(other.starts)
        if len(sizes) and sizes.min() == sizes.max() == 1:  # a byte is in one token: an entry meets one other
            row, column, value = self.rows(), other.columns[self.columns], self.values * other.values[self.columns]
        else:
            sizes = sizes[self.columns]
            inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            source = np.repeat(other.starts[self.columns], sizes) + inside
            row, column = np.repeat(self.rows(), sizes), other.columns[source]
            value = np.repeat(self.values, sizes) * other.values[source]
        key = row * max(1, other.width) + column
        if len(key) and (key[1:] < key[:-1]).any():  # rows of spans come in order
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, value = key[first], np.add.reduceat(value, first) if len(first) else value
        row, column = key // max(1, other.width), key % max(1, other.width)
        return Csr(np.searchsorted(row, np.arange(self.height + 1)), column, other.width, value)

    def sums(self, vector: np.ndarray | None = None) -> np.ndarray:
        """The product with a vector, of ones where none is given."""
        total = np.concatenate([[0], np.cumsum(self.values if vector is None else self.values * vector[self.columns])])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[Csr, Csr]:
    """Incidence of groups with A's and with B's tokens: a group ends where tokens of both end."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return tuple(Csr.of_spans(np.searchsorted(ends, cuts, "right")) for ends in (a_ends, b_ends))


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """How many bytes each token of A shares with each of B: incidence of A with bytes times that of bytes with B."""
    return Csr.of_spans(a_ends).times(Csr.of_spans(b_ends).transposed())


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """Tokens of A and B that stand in one group: incidence of A with groups times that of groups with B. Its entries grow with the product of a group's sides; sums need only the factors."""
    a, b = groups_of(a_ends, b_ends)
    return a.transposed().times(b)


class Pieces:
    """Ids and bytes of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)


class ByteLevel:
    """Ids and bytes of a byte-level vocabulary."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        byte = byte_of()
        entries = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.encoder.model.get_vocab().items()}
        self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)


_models: dict[tuple[str, str], ByteLevel | Pieces] = {}


def model(kind: type, path: str):
    """This worker's model for a file."""
    if (kind.__name__, path) not in _models:
        _models[kind.__name__, path] = kind(path)
    return _models[kind.__name__, path]


def encode_both(texts: list[str | None], a: ByteLevel, b: Pieces) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Both tokenizers' ids of each text behind a space; None for null and empty texts and those that either doesn't give back byte for byte."""
    spaced = [" " + t if t else None for t in texts]
    out = []
    for s, t, ids in zip(spaced, texts, a.encoder.encode_all(spaced)):
        if s is None:
            out.append(None)
            continue
        raw, own, others = s.encode(), ids.tolist(), b.model.encode(t)
        whole = b"".join([a.bytes[i] for i in own]) == raw and b"".join([b.bytes[i] for i in others]) == raw
        out.append((ids.astype(np.int64), np.asarray(others, np.int64)) if whole else None)
    return out


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


#: What stands behind a token's id in a list of groups: the next of its side, B's side, the next group.
MARKS = ",|;"


@cache
def marked(n: int) -> list[str]:
    """Every id below n with every mark, at 3 * id + mark."""
    return [f"{i}{m}" for i in range(n) for m in MARKS]


def in_groups(a_ids: np.ndarray, b_ids: np.ndarray, a: Csr, b: Csr) -> np.ndarray:
    """The ids of groups `a1,a2|b1;...` in writing order, as places in marked()."""
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    left, right = 3 * a_ids, 3 * b_ids
    left[a.starts[1:] - 1] += 1
    right[b.starts[1:] - 1] += 2
    out[np.arange(len(a_ids)) + np.repeat(b.starts[:-1], np.diff(a.starts))] = left
    out[np.arange(len(b_ids)) + np.repeat(a.starts[1:], np.diff(b.starts))] = right
    return out


def alignments(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_a, n_b, n_groups, n_links, n_shared, groups, pairs and times of every row of docs.

    Texts are encoded whole, behind a space, by a byte-level BPE vocabulary (A)
    and a sentencepiece model (B); strings of special tokens are plain text.
    groups are the stretches between byte offsets at which tokens of both end,
    `a1,a2|b1;a3|b2,b3` of ids in order. n_links is the number of A-B pairs of
    tokens that share a byte, n_shared of those that share a group. pairs are the
    distinct linked pairs of ids (A's times RADIX and B's), times how many
    links each has. Null and empty texts and those that one of the tokenizers
    doesn't give back byte for byte have zeros, an empty string and empty
    arrays. Rows that repeat come back as they are; an empty table gives no
    rows; other columns are left out, whatever their names. Matrices are made
    for some texts at a time; a long text is one.
    """
    ship(docs.sparkSession)
    byte_path, piece_path = byte_path or vocabulary_path(), piece_path or pieces_path()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]

    def some(found: list[tuple[np.ndarray, np.ndarray]], a: ByteLevel, b: Pieces) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts, groups, and runs of pairs and times of texts put one behind another: where a text ends, tokens of both do."""
        a_ids, b_ids = (np.concatenate([f[s] for f in found]) for s in (0, 1))
        n_a, n_b = (np.array([len(f[s]) for f in found]) for s in (0, 1))
        a_ends, b_ends = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
        links = overlaps(a_ends, b_ends)
        in_a, in_b = groups_of(a_ends, b_ends)
        last_a = np.concatenate([[0], np.cumsum(n_a)])
        cut = np.searchsorted(in_a.starts, last_a)  # the first group of each text, and the end
        name, ends = marked(max(len(a.bytes), len(b.bytes))), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        written = in_groups(a_ids, b_ids, in_a, in_b).tolist()
        groups = ["".join([name[k] for k in written[i:j]])[:-1] for i, j in zip(ends, ends[1:])]
        shared = np.add.reduceat(in_a.sums() * in_b.sums(), cut[:-1])
        n_links = np.diff(links.starts[last_a])
        text_of = np.repeat(np.arange(len(found)), n_links)
        pair = np.sort(text_of * RADIX**2 + a_ids[links.rows()] * RADIX + b_ids[links.columns])
        text_of, pair = np.divmod(pair, RADIX**2)
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text_of[1:] != text_of[:-1])]))
        times = np.diff(np.append(first, len(pair)))
        counts = np.stack([n_a, n_b, np.diff(cut), n_links, shared])
        return counts, groups, pair[first], times, np.bincount(text_of[first], minlength=len(found))

    def run(batches):
        a, b = model(ByteLevel, byte_path), model(Pieces, piece_path)
        for batch in batches:
            begun, size = 0, 0
            texts: list[str | None] = []
            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size <= CHUNK and i < batch.num_rows - 1:
                    continue
                both = encode_both(texts, a, b)
                real = [k for k, f in enumerate(both) if f is not None]
                counts, groups, sizes = np.zeros((5, len(both)), np.int64), [""] * len(both), np.zeros(len(both), np.int64)
                pair = times = np.zeros(0, np.int64)
                if real:
                    counts[:, real], own, pair, times, sizes[real] = some([both[k] for k in real], a, b)
                    for k, g in zip(real, own):
                        groups[k] = g
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*[c.slice(begun, len(both)) for c in batch.columns[:-1]], *map(pa.array, counts), pa.array(groups, pa.string()), *lists], names=[*keys, *names, "groups", "pairs", "times"])
                texts, size, begun = [], 0, i + 1

    schema = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys) + "".join(f"{n} long, " for n in names)
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(tidied(run), f"{schema}groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (rows of aligned that hold it linked) and best: whether no other pair of A's id has more."""
    n = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "id-pairs")
    a = lambda: F.expr(f"pair div {RADIX}")
    most = n.groupBy(a().alias("a")).agg(F.max("n").alias("most"))
    return stored(n.withColumn("a", a()).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def link_scores(aligned: DataFrame, counts: DataFrame, key: str, most: int = MOST_PAIRS) -> DataFrame:
    """key, n_best (links whose pair is its A id's most frequent, ties included) and count_sum (of the pairs' counts over links) of rows with links.

    counts go to all tasks where they are `most` rows at most; beyond, links
    and counts meet by a join that Spark splits where pairs are hot.
    """
    if counts.count() <= most:
        counts = F.broadcast(counts)
    links = aligned.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(key, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    joined = links.join(counts, "pair")
    return joined.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.monotonically_increasing_id().alias("id"), "text")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = alignments(docs, keys=("doc_id", "id")).select("doc_id", "id", "n_a", "n_b", "n_groups", "n_links", "n_shared", digest, "pairs", "times")
    aligned = stored(aligned, "aligned")
    scores = link_scores(aligned, pair_counts(aligned), "id")
    out = aligned.drop("pairs", "times").join(scores, "id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256", "n_shared")
