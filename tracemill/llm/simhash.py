"""SimHash near-duplicates over pivot distance tables (operator 2)."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import ship, stored, tidied, words_of
from tracemill.operators.graph import components

BITS = 64
#: Reference fingerprints of the distance tables.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(24)], np.uint64)
#: Fingerprints that one group compares; larger groups are dealt into pairs of parts.
GROUP = 4096
#: Hashes whose bits are added up at a time.
CHUNK = 150_000


def shingle_hashes(text: bytes | None, n: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each n-word shingle, repeats included; a shorter text is one shingle, an empty one none."""
    words = words_of(text)
    if not words:
        return []
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, seed)]
    starts = [0, *[e + 1 for e in ends]]
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], seed) for s, e in zip(starts, ends[n - 1 :])]


def _flush(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """Fingerprints of consecutive texts that have so many hashes each (none at 0)."""
    out = np.zeros(len(sizes), np.uint64)
    n = np.asarray(sizes)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row; null and empty texts have 0."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found, hashes, sizes = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(t, n)
                hashes += h
                sizes.append(len(h))
                if len(hashes) > CHUNK:
                    found.append(_flush(hashes, sizes))
                    hashes, sizes = [], []
            found.append(_flush(hashes, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, fp long")


def block_count(n: int, bits: int, per_group: int = 8) -> int:
    """Into how many blocks to cut fingerprints, so that n of them share a key of all but `bits` blocks with few others by chance."""
    for m in range(bits + 2, bits + 6):
        if n / 2 ** (BITS * (m - bits) // m) <= per_group:
            return m
    return bits + 6


def block_keys(fp: str, m: int, bits: int) -> list:
    """A column for each choice of m - bits blocks. Two fingerprints at most `bits` apart agree in all of one choice."""
    edges = [BITS * i // m for i in range(m + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(m), m - bits)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(mask).cast("long"))))
    return keys


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _near(fps: np.ndarray, table: np.ndarray, i, j, bits: int) -> np.ndarray:
    """Of index pairs, a mask of those within `bits`: first the largest coordinate difference, then the fingerprints."""
    keep = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=-1) <= bits)
    a, b = (x[keep] if np.ndim(x) else x for x in (i, j))
    out = np.zeros(np.broadcast(i, j).shape, bool)
    out[keep[np.bitwise_count(fps[a] ^ fps[b]) <= bits]] = True
    return out


def link_group(fps: np.ndarray, table: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect a group's fingerprints just as all its links would: each is reached once, from one nearby.

    A fingerprint that has been reached leaves the list, so that a dense group costs little more than its size.
    """
    links = []
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(fps, table, at, left, bits)
            found = left[near]
            left = left[~near]
            queue += list(found)
            links += [(at, x) for x in found]
    return links


def link_runs(key: np.ndarray, fps: np.ndarray, tables: np.ndarray, bits: int, short: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that stand together under equal keys (sorted), given their distance tables."""
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [], []
    some = np.repeat((sizes > 1) & (sizes <= short), sizes)
    if some.any():
        run = np.repeat(np.arange(len(starts)), sizes)[some]
        f, t = fps[some], tables[some]
        for lag in range(1, short):
            i = np.flatnonzero(run[lag:] == run[:-lag])
            if not len(i):
                break
            i = i[_near(f, t, i, i + lag, bits)]
            a.append(f[i]), b.append(f[i + lag])
    for s, n in zip(starts[sizes > short], sizes[sizes > short]):
        f = fps[s : s + n]
        if links := link_group(f, tables[s : s + n], bits):
            i, j = np.array(links).T
            a.append(f[i]), b.append(f[j])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def with_tables(nodes: DataFrame) -> DataFrame:
    """Adds pivots, the distances of each fingerprint (column fp) to all pivots, a byte each."""
    ship(nodes.sparkSession)
    schema = nodes.schema.simpleString()[len("struct<") : -1]

    def run(batches):
        for batch in batches:
            table = pivot_table(batch.column(batch.schema.get_field_index("fp")).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in table], pa.binary())], names=[*batch.schema.names, "pivots"])

    return nodes.mapInArrow(tidied(run), f"{schema.replace(':', ' ')}, pivots binary")


def near_links(nodes: DataFrame, bits: int = 4, group: int = GROUP) -> DataFrame:
    """Links a, b between distinct fingerprints (columns fp, and pivots from with_tables()) that connect all within `bits`.

    Candidates agree in some choice of fingerprint blocks; the stored distance
    tables discard most of them, the fingerprints decide. A group of more than
    `group` is dealt into parts, and each pair of parts is compared by itself.
    """
    ship(nodes.sparkSession)
    m = block_count(nodes.count(), bits)
    keyed = nodes.select("fp", "pivots", F.explode(F.array(*block_keys("fp", m, bits))).alias("key"))
    large = keyed.groupBy("key").count().filter(F.col("count") > group).select("key", F.ceil(F.col("count") * 2 / group).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(part, o) * F.col("parts") + F.greatest(part, o))
    dealt = keyed.join(large, "key", "left").select("key", "fp", "pivots", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(others)).alias("pair"))

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            key = np.stack([t.column("key").to_numpy(), t.column("pair").to_numpy()], 1)
            last = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))[-1])  # the last run may go on
            if last:
                yield links(key[:last], t.slice(0, last))
            rest = t.slice(last).combine_chunks().to_batches()[0]
        if rest is not None:
            t = pa.Table.from_batches([rest])
            yield links(np.stack([t.column("key").to_numpy(), t.column("pair").to_numpy()], 1), t)

    def links(key, t):
        tables = np.frombuffer(b"".join(t.column("pivots").to_pylist()), np.int8).reshape(len(key), -1)
        a, b = link_runs(key, t.column("fp").to_numpy().view(np.uint64), tables, bits)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    shuffled = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return shuffled.select("key", F.col("pair").cast("long").alias("pair"), "fp", "pivots").mapInArrow(tidied(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = 4, n: int = 4) -> DataFrame:
    """doc_id, fp and component_id for every row of docs.

    Fingerprints at most `bits` apart are linked; component_id is the smallest
    doc_id that links reach, the row's own included. Equal texts share a
    fingerprint, and null and empty texts share fingerprint zero. Long texts
    count whole. Rows without a doc_id take part; component_id is null only
    where nothing else is reached. Rows that repeat come back as they are;
    other columns are left out, whatever their names; an empty table gives no
    rows.
    """
    prints = stored(fingerprints(docs, n), "fingerprints")
    nodes = stored(with_tables(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))), "fp-nodes")
    roots = components(near_links(nodes, bits))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
