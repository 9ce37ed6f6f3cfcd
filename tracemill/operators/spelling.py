"""Did you mean: words of a vocabulary near a misspelt one, by an index of what deletions leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.shipping import ship

#: Letters from which a word may differ in one and in two places. Longer words are compared as they are.
ONE, TWO, LONGEST = 3, 6, 40
#: Bits of the filter that the vocabulary's leftovers meet (16 MB), and leftovers hashed at a time.
BITS, TOGETHER = 27, 500_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def allowed(word: Column) -> Column:
    """Edits that a word may have: none below ONE letters, one below TWO, then two; none in words beyond LONGEST."""
    n = F.char_length(word)
    return F.when((n < ONE) | (n > LONGEST), 0).when(n < TWO, 1).otherwise(2)


def _hashes(letters: np.ndarray, edits: int) -> np.ndarray:
    """Hashes, a row for each word, of words of one length (rows of code points) and of what up to so many deletions leave of them.

    A hash is a sum over the letters by their places; letters behind a deleted one move up by one.
    """
    n, length = letters.shape
    powers = np.full(length, _BASE, np.uint64)
    powers[:1] = 1
    sums = np.zeros((n, length + 1), np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers), axis=1, out=sums[:, 1:])
    once = sums * np.uint64(_BACK)
    out = [sums[:, length:] + np.uint64(length)]
    if edits > 0 and length > 0:
        out.append(sums[:, :-1] + once[:, length:] - once[:, 1:] + np.uint64(length - 1))
    if edits > 1 and length > 1:
        twice = once * np.uint64(_BACK)
        i, j = np.triu_indices(length, 1)
        out.append((sums[:, :-1] - once[:, 1:])[:, i] + (once[:, :-1] + twice[:, length:] - twice[:, 1:])[:, j] + np.uint64(length - 2))
    h = np.concatenate(out, axis=1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _leftovers(words: list[str], edits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words, and the hashes of what up to so many deletions leave of each: a row for each word, words of one length and number of edits at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length, e in np.unique(np.stack([lengths, edits], 1), axis=0):
        own = np.flatnonzero((lengths == length) & (edits == e))
        step = max(1, TOGETHER // (1 + (length if e > 0 else 0) + (length * (length - 1) // 2 if e > 1 else 0)))
        for at in np.split(own, range(step, len(own), step)):
            raw = "".join(words[i] for i in at).encode("utf-32-le", "surrogatepass")
            yield at, _hashes(np.frombuffer(raw, np.uint32).reshape(len(at), length), int(e))


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the first bits of the hashes _v: of 2**BITS bits, however many there are."""
    bit = hashes.select(F.shiftrightunsigned("_v", 64 - BITS).alias("bit"))
    table = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(2 ** (BITS - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
    return out


def _indexed(words: DataFrame, edits: Column, bitmap=None) -> DataFrame:
    """words, whose first column are they, once for each hash (_v) of what up to so many deletions leave of them.

    Given a broadcast of _bits(), hashes that aren't in it are left out where they are made.
    """
    ship(words.sparkSession)
    word = words.columns[0]

    def run(batches):
        for batch in batches:
            kept = batch.drop_columns(["_e"])
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).cast(pa.binary()).to_pylist()]
            for at, h in _leftovers(texts, batch.column("_e").to_numpy()):
                if bitmap is None:
                    row, v = np.repeat(at, h.shape[1]), h.ravel()
                else:
                    bit = h >> np.uint64(64 - BITS)
                    found = np.nonzero(bitmap.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                    row, v = at[found[0]], h[found]
                yield pa.RecordBatch.from_arrays([*kept.take(pa.array(row)).columns, pa.array(v.view(np.int64))], names=[*kept.schema.names, "_v"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.filter(F.col(word).isNotNull()).withColumn("_e", edits.cast("long")).mapInArrow(run, f"{schema}, _v long")


def _near(asked: DataFrame, words: DataFrame) -> DataFrame:
    """query and the columns of words, of which the first is theirs: pairs that leave the same when deletions are made, once for each thing left.

    words are read once, and only what meets the filter of asked leftovers leaves their tasks.
    """
    word = F.col(words.columns[0])
    sought = _indexed(asked.select(F.col(asked.columns[0]).alias("query")).distinct(), allowed(F.col("query")))
    bitmap = asked.sparkSession.sparkContext.broadcast(_bits(sought))
    index = _indexed(words, F.when(F.char_length(word) <= LONGEST + 2, 2).otherwise(0), bitmap)
    near = F.abs(F.char_length("query") - F.char_length(word)) <= allowed(F.col("query"))
    return sought.join(index, "_v").filter(near).select("query", *words.columns)


def candidates(asked: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """query and word of words that leave the same when deletions are made (by hashes of 64 bits).

    asked and vocabulary have the column of words. A vocabulary's word is indexed
    for two edits, as the query's length decides.
    """
    return _near(asked.select(word), vocabulary.select(F.col(word).alias("word")).distinct()).distinct()


def did_you_mean(asked: DataFrame, vocabulary: DataFrame, k: int = 3, word: str = "word", weight: str = "n") -> DataFrame:
    """query, rank (from 1), word and distance of the k nearest words to each asked word that the vocabulary lacks.

    A word is near within allowed() edits (Levenshtein's); nearer ones come
    first, then those of more weight, then by the alphabet. Null words are left out.
    """
    known = vocabulary.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.sum(weight).alias("_n"))
    pairs = _near(asked.select(word), known).withColumn("distance", F.levenshtein("query", "word"))
    close = pairs.filter(F.col("distance") <= allowed(F.col("query"))).distinct()
    order = Window.partitionBy("query").orderBy("distance", F.desc("_n"), "word")  # words within two edits of one
    ranked = close.withColumns({"rank": F.row_number().over(order), "_least": F.first("distance").over(order)})
    return ranked.filter((F.col("rank") <= k) & (F.col("_least") > 0)).select("query", "rank", "word", "distance")  # at 0 the vocabulary has the word


def keyword_notes(asked: DataFrame, keywords: DataFrame, query: str, keyword: str, k: int = 4) -> DataFrame:
    """query and note of queries that begin with a `*KEYWORD` which is none: that it isn't there, and the nearest that are."""
    first = F.regexp_extract(F.trim(query), r"^\*(\S+)", 1)
    named = asked.select(query, F.lower(first).alias("word")).filter("word <> ''")
    own = keywords.select(F.lower(keyword).alias("word")).distinct()
    absent = named.join(own, "word", "left_anti")
    near = did_you_mean(absent, own.withColumn("n", F.lit(1)), k)
    listed = near.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("_near"))
    out = absent.join(listed.withColumnRenamed("query", "word"), "word", "left")
    note = F.concat(F.lit("no keyword *"), "word", F.when(F.col("_near").isNotNull(), F.concat(F.lit("; nearest: "), "_near")).otherwise(F.lit("")))
    return out.select(query, note.alias("note"))


def gaps(declared: DataFrame, held: DataFrame, asked: DataFrame, key: str, title: str, query: str, terms: str, k: int = 5) -> DataFrame:
    """query, title and rank of titles that are declared but not held and hold every one of a query's two or more terms as words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    absent = declared.join(held.select(key).distinct(), key, "left_anti").groupBy(title).agg(F.min(key).alias(key))
    index = absent.select(title, F.explode(words(F.col(title))).alias("_t"))
    sought = asked.select(query, F.array_distinct(F.transform(terms, lambda t: F.lower(t))).alias("_ts")).filter(F.size("_ts") > 1)
    each = sought.select(query, F.size("_ts").alias("_m"), F.explode("_ts").alias("_t"))
    full = each.join(index, "_t").groupBy(query, title, "_m").agg(F.count("*").alias("_n")).filter("_n = _m")
    return full.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(title))).filter(F.col("rank") <= k).select(query, title, "rank")
