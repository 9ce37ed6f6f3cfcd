"""Benchmark passages in documents, by a prefix-filtered join of word shingles (operator 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.passages import mix
from tracemill.llm.shared import ship, stored, tidied

#: Words of a window, and of a shingle; windows of fewer words are one shingle.
WINDOW, SHINGLE = 10, 5
#: Bits of the filter that documents meet: at least, at most (16 MB), and for each benchmark shingle.
LEAST_BITS, MOST_BITS, BITS_EACH = 20, 27, 1024
#: Bytes of text whose words are hashed at a time.
CHUNK = 1_000_000

#: Lower-cases A-Z and blanks what separates words: all of ASCII but letters and digits.
PLAIN = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ODD = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_ODD, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of texts (plain words, one space between), and the word each starts at, words counted through all texts.

    A hash is the difference of two sums over the bytes: whoever meets it looks at the words themselves.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    if len(ends) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_of = np.cumsum(raw[ends] == 10) - (raw[ends] == 10)  # of each word
    whole = (text_of[n - 1 :] == text_of[: len(text_of) - n + 1]) & (ends > starts)[n - 1 :]
    at = np.flatnonzero(whole)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(raw)), dtype=np.uint64)])
    begin, end = starts[at], ends[at + n - 1]
    return mix((sums[end] - sums[begin]) * _powers(_BACK, len(raw))[begin] + np.uint64(n)), at


def plain(text: bytes | None) -> bytes:
    """The words of a text, one space between."""
    return b" ".join(text.translate(PLAIN).split()) if text else b""


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (a string) and words (joined by spaces) of the distinct windows of each item; one row of all words where they are fewer."""
    ship(items.sparkSession)

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = plain(t).split()
                own = {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else ()
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()), "words": pa.array(found, pa.binary()).cast(pa.string())})

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").mapInArrow(tidied(run), "item_id string, words string").distinct()


def shingles_of(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """key, size, place (a word's number in it) and hash of every shingle of the given sizes, of rows with key and words."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            firsts = np.cumsum([0, *[t.count(b" ") + 1 for t in texts]])
            for n in sizes:
                hashes, at = shingle_hashes(texts, n)
                row = np.searchsorted(firsts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(np.full(len(at), n, np.int32)), pa.array((at - firsts[row]).astype(np.int32)), pa.array(hashes.view(np.int64))], names=["key", "size", "place", "hash"])

    return rows.select("key", "words").mapInArrow(tidied(run), "key long, size int, place int, hash long")


def filter_bits(hashes: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the first bits of n hashes, a power of two long: 16 MB at most, however many there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH).bit_length()))
    bit = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit"))
    rows = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    table = rows.toArrow()  # 2 ** (MOST_BITS - 6) rows at most
    out = np.zeros(2 ** (bits - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
    return out


def _met(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(65 - (len(bitmap) * 64).bit_length())
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _runs(at: np.ndarray, text_of: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of runs of shingles that stand one behind another in a text, of `least` words or more."""
    if not len(at):
        return at, at
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(text_of) != 0)]))
    last = np.append(first[1:], len(at)) - 1
    low, high = at[first], at[last] + n
    return low[high - low >= least], high[high - low >= least]


def scanned(docs: DataFrame, bitmap, lengths: list[int], shingle: int = SHINGLE) -> DataFrame:
    """docs with n_words and runs (start, words): stretches of a text all of whose shingles are in the filter.

    A window stands whole in some run, so shorter runs than the shortest window are dropped here.
    docs has the key columns and, last, text. bitmap is a broadcast of filter_bits().
    """
    ship(docs.sparkSession)
    sizes = {min(n, shingle): n for n in sorted(lengths, reverse=True)}  # shingle and shortest window
    kept = docs.columns[:-1]

    def some(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, bytes]]]]:
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts])
        firsts = np.cumsum(np.maximum(counts, 1)) - np.maximum(counts, 1)  # an empty text takes the place of a word
        runs: list[list[tuple[int, bytes]]] = [[] for _ in texts]
        for n, least in sizes.items():
            hashes, at = shingle_hashes(texts, n)
            at = at[_met(bitmap.value, hashes)]
            where = np.searchsorted(firsts, at, "right") - 1
            low, high = _runs(at, where, n, least)
            words: list[bytes] = []
            was = -1
            for a, b, t in zip(low, high, np.searchsorted(firsts, low, "right") - 1):
                if t != was:
                    words, was = texts[t].split(b" "), t
                a, b = a - firsts[t], b - firsts[t]
                runs[t].append((int(a), b" ".join(words[a:b])))
        return counts.tolist(), runs

    def run(batches):
        for batch in batches:
            texts: list[bytes] = []
            size, begun = 0, 0
            for i, t in enumerate(batch.column(len(kept))):
                texts.append(plain(t.cast(pa.binary()).as_py()))
                size += len(texts[-1])
                if size > CHUNK or i == batch.num_rows - 1:
                    counts, runs = some(texts)
                    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                    start = pa.array([a for r in runs for a, _ in r], pa.int32())
                    words = pa.array([w for r in runs for _, w in r], pa.binary()).cast(pa.string())
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([start, words], names=["start", "words"]))
                    yield pa.RecordBatch.from_arrays([*[c.slice(begun, i + 1 - begun) for c in batch.columns[:-1]], pa.array(counts, pa.int64()), lists], names=[*kept, "n_words", "runs"])
                    texts, size, begun = [], 0, i + 1

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1])
    return docs.mapInArrow(tidied(run), f"{schema}, n_words long, runs array<struct<start: int, words: string>>")


def joined_spans(spans: Column) -> Column:
    """Spans (low, high) in order, those that overlap or touch made one."""
    none = F.array().cast("array<struct<low:int,high:int>>")
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["low"].alias("low"), F.greatest(last(a)["high"], s["high"]).alias("high"))))
    return F.aggregate(F.array_sort(spans), none, lambda a, s: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["high"] >= s["low"]), grown(a, s)).otherwise(F.concat(a, F.array(s))))


def matches(texts: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """key, spans (low, high) and windows (their keys): where windows (key, words, length) stand whole in texts (key, words, times).

    Shingles are ordered by how often the texts have them, times counted, ties
    by hash. A window that a text holds whole shares all its shingles with it,
    so its necessary prefix is the rarest one, which alone is joined. By the
    shingle's place in both, the window must fit into the text (position and
    length), and the text's words there must be the window's.
    """
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most a window's words
    sizes = sorted({min(n, shingle) for n in lengths})
    own = shingles_of(windows, sizes).join(windows.select("key", "length"), "key").filter(F.col("size") == F.least("length", F.lit(shingle)))
    whole = stored(shingles_of(texts, sizes), "run-shingles")
    often = whole.join(texts.select("key", "times"), "key").groupBy("hash").agg(F.sum("times").alias("often"))
    rarest = own.join(often, "hash").groupBy("key", "length").agg(F.min(F.struct("often", "hash", "place")).alias("rarest"))
    prefix = stored(rarest.select(F.col("key").alias("window"), "length", F.col("rarest.hash").alias("hash"), F.col("rarest.place").alias("offset")), "window-prefixes")
    start = F.col("place") - F.col("offset")
    found = whole.join(prefix, "hash").select("key", start.alias("start"), "length", "window").filter("start >= 0")
    found = found.join(windows.select(F.col("key").alias("window"), F.col("words").alias("these")), "window")
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "length", "window", "these")).alias("found"))  # at most ten for each word of a text

    def run(batches):
        for batch in batches:
            spans, held = [], []
            for text, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split(" ")
                real = [x for x in some if x["start"] + x["length"] <= len(words) and " ".join(words[x["start"] : x["start"] + x["length"]]) == x["these"]]
                spans.append([{"low": x["start"], "high": x["start"] + x["length"]} for x in real])
                held.append(list({x["window"] for x in real}))
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(held, pa.list_(pa.int64()))], names=["key", "spans", "windows"])

    out = texts.select("key", "words").join(found, "key").mapInArrow(tidied(run), "key long, spans array<struct<low: int, high: int>>, windows array<long>")
    return out.filter(F.size("spans") > 0).withColumn("spans", joined_spans(F.col("spans")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, spans and item_ids of every row of docs (doc_id, text), given the benchmark's items (item_id, text).

    A window is `window` consecutive words of an item, all of them where an item
    has fewer; spans (low, high, in words) are what occurrences of windows cover
    of a text, in order and apart; item_ids (strings, sorted) are the items whose
    windows occur. Words are runs of ASCII letters (A-Z lower-cased), digits and
    all characters beyond ASCII.

    Each text is read once, whole: shingles pass a filter of the benchmark's,
    and stretches of shingles that all pass, as long as the shortest window,
    are kept. Equal stretches are matched once, however many texts hold them.
    Null and empty texts have no words; null and empty items no windows; an item
    without an id is the empty string, and rows that repeat an item_id are one
    item. Rows of docs that repeat come back as they are. Other columns are left
    out, whatever their names. Empty tables are fine on either side.
    """
    spark = docs.sparkSession
    named = stored(windows_of(items, window), "windows")
    wins = stored(named.select("words").distinct().select(F.monotonically_increasing_id().alias("key"), "words", F.size(F.split("words", " ")).alias("length")), "window-keys")
    lengths = [r["length"] for r in wins.select("length").distinct().collect()]  # at most `window` of them
    each = stored(shingles_of(wins, sorted({min(n, shingle) for n in lengths})).select("hash").distinct(), "window-shingles")
    bitmap = spark.sparkContext.broadcast(filter_bits(each, each.count()))
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text")
    rows = stored(scanned(rows, bitmap, lengths, shingle), "scanned")
    bitmap.unpersist()
    runs = rows.select("id", F.explode("runs").alias("run")).select("id", "run.*")
    texts = stored(runs.groupBy("words").agg(F.count("*").alias("times")).withColumn("key", F.monotonically_increasing_id()), "run-texts")
    met = stored(matches(texts, wins, shingle), "run-matches")
    whose = met.select("key", F.explode("windows").alias("window")).join(wins.select(F.col("key").alias("window"), "words"), "window").join(named, "words")
    whose = whose.groupBy("key").agg(F.collect_set("item_id").alias("item_ids"))
    met = stored(met.select("key", "spans").join(whose, "key").join(texts.select("key", "words"), "key").select("words", "spans", "item_ids"), "run-items")
    shifted = F.transform("spans", lambda s: F.struct((s["low"] + F.col("start")).alias("low"), (s["high"] + F.col("start")).alias("high")))
    hit = runs.join(met, "words").select("id", shifted.alias("spans"), "item_ids")
    hit = hit.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    hit = hit.select("id", joined_spans(F.col("spans")).alias("spans"), "item_ids")
    none = [F.array().cast("array<struct<low:int,high:int>>").alias("spans"), F.array().cast("array<string>").alias("item_ids")]
    with_runs = rows.filter(F.size("runs") > 0).select("id", "doc_id", "n_words").join(hit, "id", "left")
    with_runs = with_runs.select("doc_id", "n_words", *[F.coalesce(c, e).alias(c) for c, e in zip(("spans", "item_ids"), none)])
    return rows.filter(F.size("runs") == 0).select("doc_id", "n_words", *none).unionByName(with_runs)


def without_contamination(docs: DataFrame, items: DataFrame, most: float = 0.0, window: int = WINDOW) -> DataFrame:
    """doc_id of the rows of docs of whose words at most the share `most` is hit; texts without words stay."""
    found = contamination(docs, items, window)
    return found.filter(_hit() <= F.col("n_words") * most).select("doc_id")


def _hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = _hit()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k : k + least(len(w), {WINDOW}) - 1], ' ') AS words
        FROM i, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS words FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
occ AS (SELECT doc_id, k, n, item_id FROM dw JOIN win USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM occ), unnest(range(k, k + n)) AS u(p) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
