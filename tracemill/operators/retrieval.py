"""Text chunks, lexical and dense ranking, fusion and pooling."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.columns import words
from tracemill.functions.scratch import stored
from tracemill.functions.shipping import ship

K1, B = 1.5, 0.75
FUSION = 60
#: Scores of queries and rows that a task of cosine() holds at a time.
SCORES = 250_000


def chunks(df: DataFrame, key: str, text: str, size: int = 150, stride: int = 100) -> DataFrame:
    """Overlapping windows of words: starts 0, stride, ... below the number of words, short tails included."""
    tokens = df.select(key, F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("_w")).filter("size(_w) > 0")
    starts = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(stride)), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("_w", s + 1, size), " ").alias("chunk")))
    return tokens.select(key, F.posexplode(starts).alias("chunk_id", "_c")).select(key, "chunk_id", "_c.start", "_c.chunk")


def bm25(docs: DataFrame, queries: DataFrame, key: str, tokens: str, query: str = "query_id", terms: str = "terms") -> DataFrame:
    """BM25 of every document that shares a term with a query: query, key, score.

    docs has a key and an array of tokens, queries an id and an array of terms
    (repeats count). The tokens are read once: the queries' terms of a document
    are counted, and with them an empty one that stands for the document, and
    this table is stored.
    """
    wanted = queries.select(query, F.explode(terms).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    wanted = stored(wanted, "wanted")
    named = wanted.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    each = docs.select(key, F.size(tokens).alias("dl"), F.explode(F.array_append(tokens, F.lit(""))).alias("term")).join(named, "term", "left_semi")
    counted = stored(each.groupBy(key, "dl", "term").agg(F.count("*").alias("tf")), "postings")
    sizes = counted.filter("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    postings = counted.filter("term <> ''")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg")))
    scored = postings.join(df, "term").join(wanted, "term").join(F.broadcast(sizes))  # one row
    return scored.groupBy(query, key).agg(F.sum(weight).alias("score"))


def ranked(scores: DataFrame, query: str, key: str, k: int | None = None, score: str = "score", digits: int = 9) -> DataFrame:
    """Adds rank (from 0) by the rounded score, ties by key; the first k of each query."""
    w = Window.partitionBy(query).orderBy(F.desc(F.round(score, digits)), key)
    out = scores.withColumn("rank", F.row_number().over(w) - 1)
    return out if k is None else out.filter(F.col("rank") < k)


def citation_prior(score: Column, citations: Column) -> Column:
    return score * (1 + F.log10(citations + 1))


def cosine(rows: DataFrame, queries: DataFrame, key: str, vector: str, query: str = "query_id", k: int = 40, block: int = 4096, digits: int = 6) -> DataFrame:
    """query, key and score of the k rows of highest cosine to each query; ties of the rounded score go to smaller keys.

    Vectors that are null, hold nulls or have not the length of the queries'
    take no part. Queries are dealt into blocks of about `block`, which are
    broadcast one by one; each batch of rows is one matrix product, of which
    only a query's k best go on.
    """
    ship(rows.sparkSession)
    whole = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
    kinds = {query: queries.schema[query].dataType, key: rows.schema[key].dataType}
    schema = f"`{query}` {kinds[query].simpleString()}, `{key}` {kinds[key].simpleString()}, score double"
    asked = stored(queries.filter(whole(vector)).select(query, F.col(vector).cast("array<double>").alias("_q")), "cosine-queries")
    have = rows.filter(whole(vector)).select(key, F.col(vector).cast("array<double>").alias("_v"))
    count = max(1, -(-asked.count() // block))
    unit = 10.0**digits
    found = None
    for b in range(count):
        some = asked.filter(F.pmod(F.xxhash64(query), F.lit(count)) == b).toArrow()  # about `block` rows
        shared = rows.sparkSession.sparkContext.broadcast(some)

        def run(batches, shared=shared):
            some = shared.value
            names = some.column(query).combine_chunks()
            q = some.column("_q").combine_chunks()
            dim = len(q[0]) if len(q) else 0
            pick = np.flatnonzero(q.value_lengths().to_numpy(zero_copy_only=False) == dim)
            names = names.take(pa.array(pick))
            q = q.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).reshape(len(pick), dim) if dim else np.zeros((0, 1))
            q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-9)
            for batch in batches:
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(lengths == dim))
                batch = batch.take(pc.sort_indices(batch.column(0)))
                n = batch.num_rows
                if not n or not len(q):
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
                least = min(k, n)
                step = max(1, SCORES // n)
                for i in range(0, len(q), step):
                    scores = q[i : i + step] @ v.T
                    # rounded score first, place among the batch's sorted keys second: no two are equal
                    order = np.floor(scores * unit + 0.5).astype(np.int64) * n + np.arange(n - 1, -1, -1)
                    at = np.argpartition(order, n - least, axis=1)[:, n - least :]
                    of = np.repeat(np.arange(len(scores)), least) + i
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), batch.column(0).take(pa.array(at.ravel())), pa.array(np.take_along_axis(scores, at, 1).ravel())], names=[query, key, "score"])

        part = have.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", digits)), key)
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def fuse(dense: DataFrame, lexical: DataFrame, query: str, key: str, n: int) -> DataFrame:
    """Reciprocal ranks, dense ones twice as heavy; a row absent from a list has rank n there."""
    d = dense.select(query, key, F.col("rank").alias("dense_rank"))
    b = lexical.select(query, key, F.col("rank").alias("lexical_rank"))
    both = d.join(b, [query, key], "full")
    part = lambda c, w: F.lit(w) / (FUSION + F.coalesce(c, F.lit(n)))
    return both.withColumn("score", part("dense_rank", 2 / 3) + part("lexical_rank", 1 / 3))


def key_boost(scores: DataFrame, key_terms: Column, query_terms: Column) -> Column:
    """1 + 1.5 times the share of a key's terms that the query has."""
    share = F.size(F.array_intersect(query_terms, key_terms)) / F.greatest(F.size(F.array_distinct(key_terms)), F.lit(1))
    return 1 + 1.5 * share


def overlap(query: Column, fields: dict[Column, float] | list[tuple[Column, float]]) -> Column:
    """Weighted number of distinct query tokens in each field."""
    return reduce(lambda a, b: a + b, [w * F.size(F.array_intersect(query, f)) for f, w in fields])


def line_hits(df: DataFrame, key: str, text: str, needle: str, context: int = 1) -> DataFrame:
    """Lines that hold a substring, in any case, with the lines around them."""
    lines = df.filter(F.contains(F.lower(text), F.lit(needle.lower()))).select(key, F.split(text, "\n").alias("_l"))
    hits = lines.select(key, "_l", F.posexplode("_l").alias("line", "hit")).filter(F.contains(F.lower("hit"), F.lit(needle.lower())))
    first = F.greatest(F.col("line") - context, F.lit(0))
    return hits.select(key, "line", "hit", F.array_join(F.slice("_l", first + 1, F.col("line") + context - first + 1), "\n").alias("context"))


def pooled(scores: DataFrame, query: str, group: str, how: str = "sum") -> DataFrame:
    """Scores of a group's chunks as one: first, sum, max, mean or sum_norm (sum over the root of their number)."""
    agg = {"first": F.max_by("score", -F.col("rank")), "sum": F.sum("score"), "max": F.max("score"), "mean": F.avg("score"), "sum_norm": F.sum("score") / F.sqrt(F.count("*"))}[how]
    return scores.groupBy(query, group).agg(agg.alias("score"), F.min("rank").alias("first_rank"))


def all_terms(text: Column, query: str) -> Column:
    """Whether a text holds every word of a query of two words or more, in any case and place; never for one word."""
    terms = re.findall(r"[A-Za-z0-9_]+", query.lower())
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(t)) for t in terms], F.lit(len(terms) > 1))


#: Words of a passage from which its inner words are looked up by their hash, and how many of these; characters of shorter passages that are sought at a time.
LONG, RUN, BLOCK = 10, 8, 1_000_000
GAP = r"[ \n]+"


def holders(docs: DataFrame, passages: DataFrame, key: str, text: str, query: str, passage: str) -> DataFrame:
    """query and key of the texts that hold a passage, letter by letter; empty passages are in none.

    Of a passage of LONG words or more the RUN words behind its first have to
    be words of a text, found by their hash; shorter ones are sought in every
    text, a block of BLOCK characters of them at a time, by an automaton.
    """
    ship(docs.sparkSession)
    asked = stored(passages.filter(F.length(passage) > 0).select(query, F.col(passage).alias("_p"), F.split(passage, GAP).alias("_w")), "passages")
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    run = lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(RUN)])
    seeds = asked.filter(F.size("_w") >= LONG).select(query, hashes(F.slice("_w", 2, RUN)).alias("_h")).select(query, run(F.lit(0)).alias("_s"))
    words_of = docs.select(key, hashes(F.split(text, GAP)).alias("_h")).filter(F.size("_h") >= RUN)
    runs = words_of.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("_h") - RUN), run)).alias("_s"))
    near = runs.join(seeds, "_s").select(query, key).distinct()
    found = near.join(docs.select(key, text), key).join(asked.select(query, "_p"), query).filter(F.contains(text, F.col("_p"))).select(query, key)
    short = asked.filter(F.size("_w") < LONG).select(query, "_p")
    size = short.agg(F.sum(F.length("_p"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query, passages), (key, docs))}
    for b in range(blocks):
        some = short.filter(F.pmod(F.xxhash64("_p"), F.lit(blocks)) == b).toArrow()  # about BLOCK characters
        of: dict[str, list] = {}
        for q, p in zip(some.column(query).to_pylist(), some.column("_p").to_pylist()):
            of.setdefault(p, []).append(q)

        def seek(batches, of=of):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in of:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for batch in batches:
                hits = [(q, k) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for p in {p for _, p in automaton.iter(t)} for q in of[p]]
                yield pa.RecordBatch.from_pydict({query: [q for q, _ in hits], key: [k for _, k in hits]}, schema=pa.schema([(query, some.schema.field(query).type), (key, batch.schema.field(0).type)]))

        found = found.unionByName(docs.select(key, text).mapInArrow(seek, f"`{query}` {kinds[query]}, `{key}` {kinds[key]}"))
    return found.distinct()


def matches_per_size(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Matches of a pattern, and matches for each 1000 characters."""
    n = F.regexp_count(text, F.lit(pattern))
    return df.withColumn("n_matches", n).withColumn("per_thousand", n * 1000.0 / F.greatest(F.char_length(text), F.lit(1)))


def profile(df: DataFrame, text: str, marker: str) -> DataFrame:
    """Texts, lines, share of lines that are prose (five words or more), and lines with a marker."""
    lines = df.select(F.explode(F.split(text, "\n")).alias("line"))
    n = F.size(words("line"))
    counted = lines.agg(F.count("*").alias("n_lines"), F.count_if(n >= 5).alias("n_prose"), F.count_if(F.contains(F.col("line"), F.lit(marker))).alias("n_marked"))
    return df.agg(F.count("*").alias("n_texts")).join(F.broadcast(counted)).select("n_texts", "n_lines", (F.col("n_prose") / F.greatest("n_lines", F.lit(1))).alias("prose"), "n_marked")


def inverted(index: Column, most: int = 400) -> Column:
    """Text of an inverted index, a map of word to positions, its first `most` characters."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.left(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(most))


def drifted(now: DataFrame, before: DataFrame, most: float = 0.5) -> DataFrame:
    """measure, before, now and drifted of two one-row profiles: whether a measure has changed by more than a share of what it was."""
    each = lambda df, name: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.col(c).cast("double") for c in df.columns]))).alias("measure", name))
    out = each(before, "before").join(each(now, "now"), "measure")
    return out.withColumn("drifted", F.abs(F.col("now") - F.col("before")) > most * F.greatest(F.abs("before"), F.lit(1e-9)))
