"""Run summaries, text fields and registered evaluators."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracemill.functions.shipping import ship


def kpi_rows(runs: DataFrame, sources: dict[str, tuple[DataFrame, dict[str, Column]]], key: str, prefer: dict[str, list[str]]) -> DataFrame:
    """One wide row for each run: aggregates of each source joined by key, then each name in `prefer` from the first source that has it."""
    out = runs
    for name, (df, aggregates) in sources.items():
        out = out.join(df.groupBy(key).agg(*[c.alias(f"{name}_{k}") for k, c in aggregates.items()]), key, "left")
    return out.withColumns({k: F.coalesce(*choices) for k, choices in prefer.items()})


def highest_number(df: DataFrame, column: str, prefix: str = "D") -> DataFrame:
    """Largest number of ids that are the prefix and digits alone."""
    return df.agg(F.max(F.regexp_extract(column, rf"^{prefix}(\d+)$", 1).try_cast("long")).alias("highest"))


def digest(df: DataFrame, group: str, order: str, text: str, last: int = 6, most: int = 6000) -> DataFrame:
    """Of each group its last rows, the oldest left out until their texts fit."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    newest = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    return newest.withColumn("used", F.sum(F.char_length(text)).over(w)).filter(F.col("used") <= most).drop("_n")


def merged_ranks(lists: DataFrame, key: str, source: str, rank: str) -> DataFrame:
    """Of each record its best rank and the number of lists that hold it."""
    return lists.groupBy(key).agg(F.min(rank).alias("best_rank"), F.countDistinct(source).alias("n_lists"))


def cut_at_section(text: Column, cap: int) -> tuple[Column, Column]:
    """A text's first `cap` characters, cut before its last heading (`## `) there if that is in their second half, and the headings that are left out."""
    head = F.substring(text, 1, cap)
    back = F.locate(" ##\n", F.reverse(head))
    at = F.when(back > 0, F.char_length(head) - back - 3).otherwise(0)
    cut = F.when(F.char_length(text) <= cap, F.char_length(text)).when(at >= cap // 2, at).otherwise(cap)
    rest = F.substring(text, cut + 1, F.char_length(text))
    return F.left(text, cut), F.transform(F.regexp_extract_all(rest, F.lit(r"(?m)^## (.*)$"), 1), lambda x: F.trim(x))


def duration(seconds: Column) -> Column:
    """Seconds below 90, minutes below 90, else hours."""
    return F.when(seconds < 90, F.format_string("%ds", F.floor(seconds))).when(seconds < 5400, F.format_string("%dmin", F.floor(seconds / 60))).otherwise(F.format_string("%.1fh", F.floor(seconds / 360) / 10))


def agrees(a: Column, b: Column) -> Column:
    """Whether two numbers are the same to a thousandth."""
    return F.abs(a - b) <= 1e-9 + 1e-3 * F.abs(b)


def head_and_tail(text: Column, cap: int) -> Column:
    """A text that is too long as its two ends, with how much is gone between."""
    half, n = cap // 2, F.char_length(text)
    return F.when(n <= cap, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(" ["), (n - 2 * half).cast("string"), F.lit(" left out] "), F.right(text, F.lit(half))))


def first_line(text: Column, cap: int = 140) -> Column:
    """The first line that isn't blank."""
    return F.left(F.trim(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(1))), F.lit(cap))


def field(text: Column, name: str) -> Column:
    """The value after `name:` on a line of its own or in a table row `| name | value |`, empty if there is neither."""
    line, cell = F.regexp_extract(text, rf"(?m)^{name}: *([^\n]*)$", 1), F.regexp_extract(text, rf"(?m)^\| *{name} *\| *([^|\n]*)\|", 1)
    return F.trim(F.when(line != "", line).otherwise(cell))


def seconds_of(text: str | Column) -> Column:
    """Seconds of `HH:MM:SS`, `MM:SS` or a plain number; null for anything else."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(c, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p)
    return F.when(c.rlike(r"^\d+(:[0-5]?\d){0,2}$"), total)


def terminal_state(asked: str, halted: Column, reviewed: Column) -> Column:
    """GATED, UNGATED or FAILED as asked; anything else is UNGATED, and so is GATED on a halt or without a review."""
    known = F.col(asked).isin("GATED", "UNGATED", "FAILED")
    return F.when(~known | ((F.col(asked) == "GATED") & (halted | ~reviewed)), "UNGATED").otherwise(F.col(asked))


def statement_key(text: str | Column) -> Column:
    """A statement in lower case with single spaces: equal keys are the same statement."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def evidence(delegations: DataFrame, commits: DataFrame, key: str, file: str) -> DataFrame:
    """Every delegation with the files of its commits, sorted, each once; null without any."""
    return delegations.join(commits.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(file)).alias("files")), key, "left")


def is_compound(text: Column) -> Column:
    """Whether a claim is numbered, (1) and (2) or 1. and 2., or says something with a number or a comparison on both sides of its first ` and ` or `; `."""
    numbered = text.rlike(r"(?s)\(1\).*\(2\)|\b1\.\s.*\b2\.\s")

    def halves(connector: str) -> Column:
        left = F.substring_index(text, connector, 1)
        right = F.substring(text, F.char_length(left) + len(connector) + 1, F.char_length(text))
        return F.contains(text, F.lit(connector)) & left.rlike(r"[<>=≤≥]|\d") & right.rlike(r"[<>=≤≥]|\d")

    return numbered | halves(" and ") | halves("; ")


def close_titles(asked: DataFrame, vocabulary: DataFrame, key: str, query: str, title: str, k: int = 5, least: float = 0.6, least_word: float = 0.75) -> DataFrame:
    """key, title, ratio and rank: for each query the k titles nearest to it, then those nearest to one of its words.

    Nearness is the share of matching blocks, `least` or more for the whole
    query and `least_word` or more for a word. Only titles that share two
    letters in a row with it, and that are not too long or too short to reach
    the ratio, are compared.
    """
    ship(asked.sparkSession)
    text = F.trim(F.regexp_replace(F.lower(F.col(query)), r"[^a-z0-9_]+", " "))
    whole = asked.select(F.col(key).alias("_key"), text.alias("_q"), F.lit(0).alias("_part"), F.lit(least).alias("_least"))
    word = whole.filter(F.contains("_q", F.lit(" "))).select("_key", F.explode(F.split("_q", " ")).alias("_q"), F.lit(1).alias("_part"), F.lit(least_word).alias("_least"))
    titles = vocabulary.select(F.trim(F.regexp_replace(F.lower(F.col(title)), r"\s+", " ")).alias("_t")).filter("_t != ''").distinct()
    pairs_of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    q = whole.unionByName(word).filter("_q != ''").distinct().withColumn("_n", F.size(pairs_of(F.col("_q"))))
    shared = q.select("*", F.explode(pairs_of(F.col("_q"))).alias("_g")).join(titles.select("_t", F.explode(pairs_of(F.col("_t"))).alias("_g")), "_g")
    # matching blocks are twice their length over both lengths at most
    most = 2.0 * F.least(F.char_length("_q"), F.char_length("_t")) / (F.char_length("_q") + F.char_length("_t"))
    near = shared.filter(most >= F.col("_least")).select("_key", "_q", "_part", "_least", "_t").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            # the title stands second, as blocks are sought in the order of what is asked
            yield t.assign(ratio=[difflib.SequenceMatcher(None, b, a).ratio() for a, b in zip(t["_q"], t["_t"])])

    kind = asked.schema[key].dataType.simpleString()
    rated = near.mapInPandas(run, f"_key {kind}, _q string, _part int, _least double, _t string, ratio double").filter("ratio >= _least")
    by_word = Window.partitionBy("_key", "_part", "_q").orderBy(F.desc("ratio"), "_t")
    few = rated.withColumn("_n", F.row_number().over(by_word)).filter((F.col("_part") == 0) | (F.col("_n") <= 2))
    best = few.groupBy("_key", "_t").agg(F.min(F.struct("_part", (-F.col("ratio")).alias("d"))).alias("_b"))
    w = Window.partitionBy("_key").orderBy("_b._part", "_b.d", "_t")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("_key").alias(key), F.col("_t").alias(title), (-F.col("_b.d")).alias("ratio"), "rank")


def evaluated(df: DataFrame, evaluator: Callable[..., pd.Series | dict[str, pd.Series]], inputs: list[str], outputs: list[str], delegation_id: str, source: str) -> DataFrame:
    """Runs a registered evaluator over rows, in batches: inputs by name, outputs by name or alone, rows stamped and FINISHED."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs], T.StructField("_delegation_id", T.StringType()), T.StructField("_source", T.StringType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            found = evaluator(**{c: t[c] for c in inputs})
            found = found if isinstance(found, dict) else {outputs[0]: found}
            yield t.assign(**{o: found[o].astype(float) for o in outputs}, _delegation_id=delegation_id, _source=source, status="FINISHED")

    return df.mapInPandas(run, schema)


def within_ttl(cache: DataFrame, key: str, at: str, now: Column, ttl: int, status: str) -> DataFrame:
    """The newest entry of each key that was stored with status 200 and has not expired (times in seconds); of entries of one time always the same."""
    good = cache.filter((F.col(status) == 200) & (now - F.col(at) <= ttl))
    rest = [c for c in cache.columns if c != key]
    return good.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.xxhash64(*rest))).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def add_papers(corpus: DataFrame, fresh: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """New papers of enough text whose id the corpus doesn't have, each once (the longest text, of several the last in the alphabet)."""
    rest = [c for c in fresh.columns if c != key]
    new = fresh.filter(F.char_length(text) > least).join(corpus.select(key).distinct(), key, "left_anti")
    return new.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.char_length(text), text)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
