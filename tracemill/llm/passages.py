"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds (operator 6)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import LOWER, WORD, drop_stored, ship, stored, tidied

K = 5
#: Of so many k-mers in a row the one of least hash is a seed: two texts that share K + WINDOW - 1 words share a seed.
WINDOW = 10
#: Shortest passage in words, and least share of equal words in its alignment.
LEAST, SIMILAR = 50, 0.8
#: Largest gap between chained seeds in words, and what a word of difference between the gaps costs.
GAP, COST = 60, 0.5

#: Turns in which seeds are matched, each with its share of the hashes, so that the exchanges of one turn are on disk at a time.
TURNS = 2

#: Bytes that hashed_words works on at a time, whatever the length of a text.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word of texts one after another, and the number of words of each text."""
    joined = b" ".join([t or b"" for t in texts]).translate(LOWER)
    raw = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    # each byte times a number for its place in the word: equal words have equal sums
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(stop, start[first] + CHUNK, "right")))
        a, b = start[first], stop[last - 1]
        begin = start[first:last] - a
        place = np.arange(b - a) - np.repeat(begin, np.diff(np.append(begin, b - a)))
        value = (raw[a:b].astype(np.uint64) + np.uint64(1)) * mix((place.astype(np.uint64) + np.uint64(1)) * _MUL)
        value[~inside[a:b]] = 0
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        out[first:last] = mix(sums[stop[first:last] - a] - sums[begin])
        first = last
    return out, counts


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's seeds. A text of under K words has none, one of fewer k-mers than WINDOW one."""
    n = len(words) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = h * _MUL + words[j : j + n]
    h = mix(h)
    if n <= WINDOW:
        at = np.array([int(h.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.unique(np.arange(len(view)) + view.argmin(1))
    return at, h[at]


def numbered(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds for a text's second and later places of a hash a key of hash and number, so that periodic passages match place by place."""
    by = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]]) if len(h) else np.zeros(0, bool)
    if new.all():
        return at, h
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    more = by[run > 0]
    return np.concatenate([at, at[more]]), np.concatenate([h, mix(h[more] + run[run > 0].astype(np.uint64) * _MUL)])


def _powers(of: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, of, np.uint64))])


def run_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place, 0 where the text ends before."""
    out = np.zeros(len(at), np.uint64)
    some = np.flatnonzero(at + n <= len(words))
    if len(some):
        # word j counts with the power j of an odd number; dividing by that of the first word makes equal runs equal
        odd = int(_MUL)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(odd, len(words))[:-1], dtype=np.uint64)])
        start = at[some]
        out[some] = mix((sums[start + n] - sums[start]) * _powers(pow(odd, -1, 1 << 64), len(words))[start]) | np.uint64(1)
    return out


def one_text(docs: DataFrame) -> DataFrame:
    """doc_id and text, once for each doc_id: of rows that repeat one the longest text (of equal ones the last); no null doc_id."""
    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    again = stored(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if not again.head(1):
        return rows
    longest = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", F.struct(F.coalesce(F.length("text"), F.lit(-1)), "text")).alias("text"))
    return rows.join(again, "doc_id", "left_anti").unionByName(longest)


def seeds(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc, pos and hash of every seed of every whole text of `least` words or more, and run, the hash of the `least` words from it (0 past the end)."""
    ship(docs.sparkSession)

    def of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, h = numbered(*minimisers(words if len(words) >= least else words[:0]))
        return at, h, run_hashes(words, at, least)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i in range(0, len(texts), 256):
                words, counts = hashed_words(texts.slice(i, 256).to_pylist())
                ends = np.cumsum(counts)
                found = [of(words[a:b]) for a, b in zip(ends - counts, ends)]
                doc = batch.column(0).take(pa.array(np.repeat(np.arange(i, i + len(found)), [len(a) for a, _, _ in found])))
                at, h, runs = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([doc, pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(runs.view(np.int64))], names=["doc", "pos", "hash", "run"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc long, pos int, hash long, run long")


class _Highest:
    """Fenwick tree of the highest score among places up to one."""

    def __init__(self, n: int):
        self.best = [0.0] * (n + 1)

    def put(self, i: int, score: float) -> None:
        i += 1
        while i < len(self.best):
            if self.best[i] < score:
                self.best[i] = score
            i += i & -i

    def below(self, i: int) -> float:
        """The highest score of places before i."""
        out = 0.0
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of anchors (x, y), sorted by x then y: lists of anchor numbers, both coordinates rising.

    A chain gains the new words of each anchor and pays COST for each word by
    which the gaps in x and y differ; a predecessor is at most GAP behind in x
    and in y. Predecessors are tried from the nearest in x on. A Fenwick tree
    over y holds the highest score of those so far, which bounds what is left:
    the search ends when nothing could exceed what it has, and at the end of
    the reach, so that the best one in reach is always found.
    The best chain is taken first, and then the best of what is left.
    """
    xs, ys = x.tolist(), y.tolist()
    n = len(xs)
    score, back = [float(K)] * n, [-1] * n
    place = {v: i for i, v in enumerate(sorted({*ys}))}
    highest = _Highest(len(place))
    for i in range(n):
        xi, yi = xs[i], ys[i]
        most = highest.below(place[yi]) + K
        best, of = float(K), -1
        for j in range(i - 1, -1, -1):
            dx, dy = xi - xs[j], yi - ys[j]
            if dx > GAP or best >= most:
                break
            if dx > 0 and 0 < dy <= GAP:
                value = score[j] + min(K, dx, dy) - COST * abs(dx - dy)
                if value > best:
                    best, of = value, j
        score[i], back[i] = best, of
        highest.put(place[yi], best)
    out = []
    used = [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def chained(matches: DataFrame) -> DataFrame:
    """Chains of each pair: doc, other, and the anchors' places in both (arrays xs and ys)."""

    def of_pairs(t: pd.DataFrame) -> list[tuple]:
        rows = []
        docs, others = t["doc"].to_numpy(), t["other"].to_numpy()
        cut = np.flatnonzero((docs[1:] != docs[:-1]) | (others[1:] != others[:-1])) + 1
        x, y = t["pos"].to_numpy(), t["other_pos"].to_numpy()
        for a, b in zip([0, *cut], [*cut, len(t)]):
            if b - a > 1:  # the least passage holds several seeds
                for c in chains(x[a:b], y[a:b]):
                    if len(c) > 1:
                        rows.append((docs[a], others[a], x[a:b][c].tolist(), y[a:b][c].tolist()))
        return rows

    names = ["doc", "other", "xs", "ys"]

    def run(batches):
        parts: list[pd.DataFrame] = []  # of a text that may go on
        for t in batches:
            last = t["doc"].searchsorted(t["doc"].iloc[-1]) if len(t) else 0
            if last or parts and len(t) and parts[-1]["doc"].iloc[-1] != t["doc"].iloc[-1]:
                yield pd.DataFrame(of_pairs(pd.concat([*parts, t.iloc[:last]], ignore_index=True)), columns=names)
                parts = []
            if len(t):
                parts.append(t.iloc[last:])
        if parts:
            yield pd.DataFrame(of_pairs(pd.concat(parts, ignore_index=True)), columns=names)

    dealt = matches.repartition("doc").sortWithinPartitions("doc", "other", "pos", "other_pos")
    return dealt.mapInPandas(tidied(run), "doc long, other long, xs array<int>, ys array<int>")


def reach(same: np.ndarray) -> int:
    """How far an alignment goes on while it gains, a word that differs costing two equal ones."""
    gain = np.cumsum(np.where(same, 1, -2))
    fall = np.flatnonzero(np.maximum.accumulate(np.maximum(gain, 0)) - gain > 16)
    gain = gain[: fall[0]] if len(fall) else gain
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 0 else 0


def align(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """The alignment of words a and b along a chain and on to the ends of the shorter sides: for each of its columns
    the place in both (that of the next word, where a side has none) and whether the words are equal; and the first
    column and the one behind the last of the chain with what it reaches on either side.

    Between seeds, words are compared along the diagonal, with the surplus of
    the longer gap left out where that loses least.
    """
    before, after = min(xs[0], ys[0]), min(len(a) - xs[-1], len(b) - ys[-1])
    px, py = [np.arange(xs[0] - before, xs[0])], [np.arange(ys[0] - before, ys[0])]
    put = [np.ones(before, bool)]
    turn = [i for i in range(len(xs) - 1) if xs[i + 1] - xs[i] != ys[i + 1] - ys[i]]
    for first, i in zip([0, *(i + 1 for i in turn)], turn):
        x0, x1, y0, y1 = xs[i], xs[i + 1], ys[i], ys[i + 1]
        n, over = min(x1 - x0, y1 - y0), abs((x1 - x0) - (y1 - y0))
        head = np.concatenate([[0], np.cumsum(a[x0 : x0 + n] == b[y0 : y0 + n])])
        tail = np.concatenate([[0], np.cumsum((a[x1 - n : x1] == b[y1 - n : y1])[::-1])])
        k = int((head + tail[::-1]).argmax())
        # from the last turn to here and k words on, then the surplus, then the rest up to the next seed
        wide = x1 - x0 > y1 - y0
        px += [np.arange(xs[first], x0 + k), x0 + k + np.arange(over) * wide, np.arange(x1 - n + k, x1)]
        py += [np.arange(ys[first], y0 + k), y0 + k + np.arange(over) * (not wide), np.arange(y1 - n + k, y1)]
        put += [np.ones(len(px[-3]), bool), np.zeros(over, bool), np.ones(n - k, bool)]
    first = turn[-1] + 1 if turn else 0
    px.append(np.arange(xs[first], xs[-1] + after)), py.append(np.arange(ys[first], ys[-1] + after))
    put.append(np.ones(len(px[-1]), bool))
    px, py, put = np.concatenate(px), np.concatenate(py), np.concatenate(put)
    same = put.copy()
    same[put] = a[px[put]] == b[py[put]]
    end = len(same) - after + K
    return px, py, same, before - reach(same[:before][::-1]), end + reach(same[end:])


def segments(px: np.ndarray, py: np.ndarray, same: np.ndarray, lo: int, hi: int, least: int, similar: float) -> list[tuple[int, int, int, int, int]]:
    """The passages in an alignment with a chain in columns lo to hi: start and stop in both texts, and the equal words.

    A stretch, from its first equal word to its last, is a passage if it is
    long enough on both sides and its share of equal words is high enough. Else
    its segment of most gain, a word that differs costing two equal ones, and
    what lies on either side are searched in the same way; a stretch that is
    such a segment is split where it loses most.
    """
    gain = np.where(same, 1, -2)
    total = np.concatenate([[0], np.cumsum(gain)])
    equal = np.concatenate([[0], np.cumsum(same)])
    at = np.flatnonzero(same)
    out, todo = [], [(0, lo), (lo, hi), (hi, len(same))]
    while todo:
        lo, hi = todo.pop()
        n = int(equal[hi] - equal[lo])
        if hi - lo < least or n < similar * least:
            continue
        lo, hi = int(at[equal[lo]]), int(at[equal[hi] - 1]) + 1
        x0, x1, y0, y1 = int(px[lo]), int(px[hi - 1]) + 1, int(py[lo]), int(py[hi - 1]) + 1
        if min(x1 - x0, y1 - y0) < least:
            continue
        if n >= similar * max(x1 - x0, y1 - y0):
            out.append((x0, x1, y0, y1, n))
            continue
        sums = total[lo : hi + 1]
        stop = int((sums - np.minimum.accumulate(sums)).argmax())
        start = int(sums[: stop + 1].argmin())
        if (start, stop) != (0, hi - lo):
            todo += [(lo, lo + start), (lo + start, lo + stop), (lo + stop, hi)]
            continue
        stop = int((np.maximum.accumulate(sums) - sums).argmax())
        start = int(sums[: stop + 1].argmax())
        todo += [(lo, lo + start), (lo + stop, hi)]
    return sorted(out)


#: Words kept on either side of a chain for its alignment; a passage without a seed in so many words has ended.
MARGIN = 64


def owners(rows: DataFrame, key: str) -> DataFrame:
    """key, other and other_pos: the first of the texts that have a key in common, and its place.

    Stored, so that a join has exchanges of its own and a frequent key's rows can be split among tasks.
    """
    owner = rows.groupBy(key).agg(F.min(F.struct("doc", "pos")).alias("own"), F.max("doc").alias("most")).filter("most > own.doc")
    return stored(owner.select(key, F.col("own.doc").alias("other"), F.col("own.pos").alias("other_pos")), "owners")


def matched(shared: DataFrame) -> DataFrame:
    """doc, pos, other and other_pos of each seed with its owner, and with the owner of the words from it on.

    A seed has one owner and its run one: each row of shared (doc, pos, run, other, other_pos) meets one row at most, and comes out once.
    """
    again = shared.filter("run != 0")
    own = owners(again.select("run", "doc", "pos"), "run").withColumnsRenamed({"other": "run_owner", "other_pos": "run_pos"})
    # mostly they are the same
    both = F.array_distinct(F.array(F.struct("other", "other_pos"), F.struct(F.col("run_owner").alias("other"), F.col("run_pos").alias("other_pos"))))
    met = again.join(own, "run", "left").select("doc", "pos", F.explode(both).alias("own")).select("doc", "pos", "own.other", "own.other_pos")
    return shared.filter("run = 0").select("doc", "pos", "other", "other_pos").unionByName(met).filter("doc > other").distinct()


def repeated_passages(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """Passages that repeat one of an earlier text: doc_id, start, stop, other_id, other_start, other_stop, equal.

    Places are words (cut at x20 and x09-x0D, A-Z lower-cased). A seed's owner
    is the text of least doc_id that has it, and so is that of the `least`
    words from a seed on; every later text's seeds are matched with their
    owners' alone, so that a passage in n texts costs n matches. Texts of
    fewer than `least` words own nothing. A text that owns a seed may hold too
    little of a passage; the owner of the words from it on has them all, so
    equal runs of `least` + WINDOW words or more are never
    lost. Matches chain by text and owner, chains are aligned on the words,
    and a segment of an alignment of `least` words or more on both sides with
    a share of equal words of `similar` or more is a passage: alignments are
    split where they match poorly. Passages may overlap.

    Rows without a doc_id take no part; rows that repeat one count as one
    text, the longest; null and empty texts have no passages; of texts that
    repeat a passage as often, all but the one of least doc_id have it. Other
    columns are left out, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = one_text(docs)
    found = stored(seeds(docs, least), "seeds")

    parts = [found.filter(F.pmod("hash", F.lit(TURNS)) == i) for i in range(TURNS)]
    turns = [stored(part.join(owners(part, "hash"), "hash").select("doc", "pos", "run", "other", "other_pos"), "shared-seeds") for part in parts]
    drop_stored(found)  # the largest table, which nothing reads any more
    matches = matched(reduce(DataFrame.unionByName, turns))
    spans = stored(chained(matches), "chains")

    used = spans.select(F.col("doc").alias("id")).unionByName(spans.select(F.col("other").alias("id"))).distinct()
    texts = docs.withColumnRenamed("doc_id", "id").join(used, "id", "left_semi")

    def tokens(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words, counts = hashed_words(part.column(1).cast(pa.binary()).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                short = (words & np.uint64(0x7FFFFFFF)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(short))], names=["id", "words"])

    words = stored(texts.mapInArrow(tidied(tokens), "id long, words array<int>"), "words")

    def cut(at: str) -> list:
        """From which word of a side its slice starts, and the slice."""
        first = F.greatest(F.element_at(at, 1) - MARGIN, F.lit(0))
        return [first.alias(f"{at}_first"), F.slice("words", first + 1, F.element_at(at, -1) + K + MARGIN - first).alias(f"{at}_words")]

    mine = spans.join(words.withColumnRenamed("id", "doc"), "doc").select("doc", "other", "xs", "ys", *cut("xs"))
    both = mine.join(words.withColumnRenamed("id", "other"), "other").select("doc", "other", "xs", "ys", "xs_first", "xs_words", *cut("ys"))

    def aligned(batches):
        for t in batches:
            rows = []
            for r in t.itertuples(index=False):
                columns = align(np.asarray(r.xs_words), np.asarray(r.ys_words), (r.xs - r.xs_first).tolist(), (r.ys - r.ys_first).tolist())
                for x0, x1, y0, y1, equal in segments(*columns, least, similar):
                    rows.append((r.doc, x0 + r.xs_first, x1 + r.xs_first, r.other, y0 + r.ys_first, y1 + r.ys_first, equal))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "other_id", "other_start", "other_stop", "equal"])

    return both.mapInPandas(tidied(aligned), "doc_id long, start int, stop int, other_id long, other_start int, other_stop int, equal int")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the words of their passages cut out, each cut closing to what stood before it; other rows as they are.

    n_chars, where there is one, follows the text. A text that loses all its
    words becomes empty. Of rows that repeat a doc_id, those with the text that
    one_text() takes lose them.
    """
    ship(docs.sparkSession)
    cuts = passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_passages"))
    columns = docs.columns
    texts = one_text(docs).select("doc_id", F.xxhash64("text").alias("hash"))
    spans = texts.join(cuts, "doc_id").select(F.col("doc_id").alias("id"), "hash", "_passages")
    joined = docs.join(spans, (docs["doc_id"] == spans["id"]) & (F.xxhash64(docs["text"]) == spans["hash"]), "left").select(*[docs[c] for c in columns], spans["_passages"])
    at = columns.index("text")
    import re

    word = re.compile(WORD.encode())

    def shorten(text: str | None, spans) -> str | None:
        if text is None or spans is None:
            return text
        raw = text.encode()
        at = [m.span() for m in word.finditer(raw)]
        out, last = [], 0
        for s in spans:
            a, b = s["start"], min(s["stop"], len(at))
            if a < b and at[b - 1][1] > last:
                out.append(raw[last : max(last, at[a][0])])
                last = at[b - 1][1]
        out.append(raw[last:])
        return b"".join(out).decode().strip()

    def run(batches):
        for batch in batches:
            texts = [shorten(t, c) for t, c in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist())]
            cols = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    out = joined.mapInArrow(tidied(run), schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
