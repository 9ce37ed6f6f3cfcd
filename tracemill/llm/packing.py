"""Packing documents into sequences of bounded length by swap-based local search (operator 8)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import ship, stored, tidied
from tracemill.llm.tokens import encoder, vocabulary_path

#: Pieces that one task packs; a group of this size loses about one part-filled sequence.
GROUP = 40_000
END = 2


def pieces(docs: DataFrame, size: int = 1024, path: str | None = None) -> DataFrame:
    """Each document's ids and a last id 2, cut into pieces of `size`, of which the first takes what is over.

    A row for each piece: doc_id, piece, start, length, ids_crc32. Null texts
    count as empty and give the one id 2.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            row, first, counts, crc = [], [], [], []
            for r, ids in enumerate(encoder(path).encode_all(t.as_py() for t in batch.column(1))):
                raw = np.append(ids, END).astype("<u4").tobytes()
                n = len(raw) // 4
                head = n % size or size
                row.append(r), first.append(head), counts.append(1 + (n - head) // size)
                crc.append(zlib.crc32(raw[: 4 * head]))
                crc += [zlib.crc32(raw[4 * at : 4 * (at + size)]) for at in range(head, n, size)]
            if row:
                piece = np.arange(len(crc)) - np.repeat(np.cumsum(counts) - counts, counts)
                head = np.repeat(first, counts)
                start, length = np.where(piece > 0, head + (piece - 1) * size, 0), np.where(piece > 0, size, head)
                ints = [pa.array(x, kind) for x, kind in ((piece.astype(np.int32), pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(row, counts))), *ints], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def arrival(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers in the order of arrival: an item opens a bin where it doesn't fit into the last one."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = size
        bins[-1].append(i)
        room -= n
    return bins


class _Index:
    """Places of underfull bins by a number and a gap, for the largest gap under a number.

    Entries name a bin and its version; those of an earlier version are
    dropped when they come up.
    """

    def __init__(self, size: int):
        self.width = (1 << (size + 1)) - 1
        self.numbers = 0  # bit s: some entry has the number s
        self.gaps: dict[int, int] = {}  # of each number, bit g: some entry has the gap g
        self.entries: dict[tuple[int, int], list[tuple]] = {}

    def put(self, s: int, g: int, entry: tuple) -> None:
        self.numbers |= 1 << s
        self.gaps[s] = self.gaps.get(s, 0) | 1 << g
        self.entries.setdefault((s, g), []).append(entry)

    def find(self, n: int, most: int, version: list[int]) -> tuple | None:
        """The entry of the least number s in n to most, and of its largest gap above s - n: what takes n then has a gap of s - n left."""
        left = (self.numbers & self.width >> max(0, self.width.bit_length() - 1 - most)) >> n
        s = n
        while left:
            skip = (left & -left).bit_length() - 1
            s += skip
            left >>= skip
            while (gaps := self.gaps.get(s, 0)) >> (s - n + 1):
                g = gaps.bit_length() - 1
                stack = self.entries[s, g]
                while stack and version[stack[-1][0]] != stack[-1][1]:
                    stack.pop()
                if stack:
                    return stack[-1]
                self.gaps[s] = gaps & ~(1 << g)
            if not self.gaps.get(s):
                self.numbers &= ~(1 << s)
            left >>= 1
            s += 1
        return None


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search over all underfull bins, in which every step raises the sum of squared fills, so that the emptiest run empty.

    A round takes the lengths from the longest and, of one length, the bins
    from the emptiest. An item moves to another bin, or takes the place of one
    or of two shorter items of another, whichever leaves that bin nearest to
    full; where no item has such a step, two items take the place of a shorter
    one. The search ends when a round changes nothing. Bins are found by
    their gaps and by the lengths they hold, so that a step costs about the same with few
    bins and with many; a bin holds few different lengths, as their sum is
    bounded.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    held: list[dict[int, list[int]]] = []  # items of each bin by length
    for b in bins:
        held.append({})
        for i in b:
            held[-1].setdefault(lengths[i], []).append(i)
    version = [0] * len(bins)
    by_fill: list[set[int]] = [set() for _ in range(size + 1)]
    fills = 0  # bit f: some underfull bin has the fill f
    ones, twos = _Index(size), _Index(size)

    def show(b: int) -> None:
        """Puts an underfull bin into the indexes: an item of length m + g, or a shorter one, can take the place of m if the gap is g."""
        nonlocal fills
        f = fill[b]
        if not 0 < f < size:
            return
        by_fill[f].add(b)
        fills |= 1 << f
        g, v = size - f, version[b]
        own = list(held[b])
        for x, m in enumerate(own):
            ones.put(m + g, g, (b, v, m))
            if len(held[b][m]) > 1:
                twos.put(2 * m + g, g, (b, v, m, m))
            for o in own[x + 1 :]:
                twos.put(m + o + g, g, (b, v, m, o))

    def hide(b: int) -> None:
        nonlocal fills
        version[b] += 1
        by_fill[fill[b]].discard(b)
        if not by_fill[fill[b]]:
            fills &= ~(1 << fill[b])

    def shift(n: int, a: int, b: int) -> None:
        items = held[a][n]
        held[b].setdefault(n, []).append(items.pop())
        if not items:
            del held[a][n]
        fill[a] -= n
        fill[b] += n

    def exchange(b: int, t: int, mine: tuple, theirs: tuple) -> None:
        hide(t)
        for n in mine:
            shift(n, b, t)
        for m in theirs:
            shift(m, t, b)
        show(t)

    # squares rise if the other bin ends fuller than b was, that is with a gap below size - fill[b]

    def step(b: int, n: int) -> bool:
        """The exchange of one item of length n of the hidden bin b that leaves the least gap, if any is allowed."""
        best, gap = None, size - fill[b]
        room = fills & ((1 << (size - n + 1)) - 1)
        if room and size - n - (f := room.bit_length() - 1) < gap:
            best, gap = (next(iter(by_fill[f])), (n,), ()), size - n - f
        for index in (ones, twos):
            if gap > 0 and (hit := index.find(n, min(size, n + gap - 1), version)):
                best, gap = (hit[0], (n,), hit[2:]), sum(hit[2:]) + size - fill[hit[0]] - n
        if best:
            exchange(b, *best)
        return best is not None

    def two_for_one(b: int) -> bool:
        own = sorted(held[b], reverse=True)
        for x, n in enumerate(own):
            for o in own[x if len(held[b][n]) > 1 else x + 1 :]:
                if n + o <= size and (hit := ones.find(n + o, min(size, size + n + o - fill[b] - 1), version)):
                    exchange(b, hit[0], (n, o), hit[2:])
                    return True
        return False

    def underfull() -> list[int]:
        return sorted((b for b in range(len(bins)) if 0 < fill[b] < size), key=fill.__getitem__)

    for b in range(len(bins)):
        show(b)
    changed = True
    while changed:
        changed = False
        todo: dict[int, list[int]] = {}
        for b in underfull():
            for n in held[b]:
                todo.setdefault(n, []).append(b)
        for n in range(size, 0, -1):
            for b in todo.pop(n, []):
                while n in held[b] and 0 < fill[b] < size:
                    hide(b)
                    before = {*held[b]}
                    done = step(b, n)
                    show(b)
                    if not done:
                        break
                    changed = True
                    for m in held[b].keys() - before:  # what came for n has its turn in this round
                        todo.setdefault(m, []).append(b)
        if not changed:
            for b in underfull():
                if 0 < fill[b] < size:
                    hide(b)
                    while fill[b] and two_for_one(b):
                        changed = True
                    show(b)
    return [[i for items in h.values() for i in items] for h in held if h]


def pack(parts: DataFrame, size: int = 1024, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `size` tokens.

    Full pieces have a sequence to themselves. The rest are dealt at random
    into groups of about `group` pieces, which are packed side by side: the
    local search of improve() starts from bins in the order of row numbers and
    from a bin for each piece, and the packing of fewer bins stands. Rows repeat freely; an empty table
    gives an empty result. parts must be a stored table, as row numbers deal
    its rows.
    """
    numbered = parts.withColumn("row_no", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") >= size)
    rest = numbered.filter(F.col("length") < size)
    groups = max(1, -(-rest.count() // group))
    columns = [c for c in parts.columns]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_no", ignore_index=True)
        lengths = frame["length"].tolist()
        starts = arrival(lengths, size), [[i] for i in range(len(lengths))]
        bins = min((improve(start, lengths, size) for start in starts), key=len)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = int(frame["pack_group"].iloc[0]) << 32
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = base + k, at
                at += lengths[i]
        return frame[columns].assign(sequence_id=seq, offset=off)

    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"
    packed = rest.withColumn("pack_group", F.pmod(F.xxhash64("row_no"), F.lit(groups))).groupBy("pack_group").applyInPandas(run, schema)
    alone = full.select(*columns, (-1 - F.col("row_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, size: int = 1024, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `size` tokens.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are one end token; a null doc_id stays null; rows that
    repeat are packed each for themselves; other columns are left out, whatever
    their names; an empty table gives no rows.
    """
    return pack(stored(pieces(docs, size, path), "pieces"), size)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
