"""Retrieval arms side by side over one labelled set: means, and paired sign tests against a control."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Answer:
    """What an arm found: query, key and rank (from 0), and the mode that it really ran in."""

    mode: str
    ranked: DataFrame


class MislabelledArm(ValueError):
    """An arm that ran as something else."""


def run_arms(arms: dict[str, Callable[[], Answer]], query: str, key: str) -> DataFrame:
    """arm, query, key and rank of all arms in one frame; an arm that ran in another mode than it is named for is refused."""
    out = []
    for name, arm in arms.items():
        answer = arm()
        if answer.mode != name:
            raise MislabelledArm(f"{name} ran as {answer.mode}")
        out.append(answer.ranked.select(F.lit(name).alias("arm"), query, key, "rank"))
    return reduce(lambda a, b: a.unionByName(b), out)


def checked(gold: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The labels; one that names a text which isn't there stops the job, as a score without it would be of another set."""
    known = texts.select(key).distinct().withColumn("_there", F.lit(True))
    there = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("a label names an unknown text: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return gold.join(known, key, "left").withColumn(key, there).select(*gold.columns)


def held_out(query: Column, n: int = 5) -> Column:
    """Whether a query is held out: every nth by the hash of its id, so that a set that grows keeps its split."""
    return F.pmod(F.xxhash64(query), F.lit(n)) == 0


def sign_test(better: Column, worse: Column) -> Column:
    """Twice the binomial tail of the smaller of two counts at one half, at most 1; 1 without any."""
    n, m = better + worse, F.least(better, worse)
    # each term from the one before, as a logarithm: C(n, i) = C(n, i - 1) (n - i + 1) / i
    step = lambda s, i: F.struct((s["log"] + F.when(i > 0, F.ln(n - i + 1) - F.ln(F.greatest(i, F.lit(1)))).otherwise(0.0)).alias("log"), (s["sum"] + F.exp(s["log"] + F.when(i > 0, F.ln(n - i + 1) - F.ln(F.greatest(i, F.lit(1)))).otherwise(0.0))).alias("sum"))
    first = F.struct((-n * F.ln(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), m), first, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def compared(answers: DataFrame, gold: DataFrame, query: str, key: str, control: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Of each arm over all labelled queries: their number, mean recall at each k and reciprocal rank, and against the control how many queries it serves better and worse by recall at the last k, with the sign test's p_value.

    A query that an arm answers nothing for counts 0. All arms are scored in one plan: labels times arms, joined once with the answers.
    """
    names = answers.select("arm").distinct()
    wanted = gold.select(query, key).distinct().join(F.broadcast(names))  # a row for each arm
    hits = wanted.join(answers, ["arm", query, key], "left").groupBy("arm", query)
    each = hits.agg(*[(F.count_if(F.col("rank") < k) / F.count("*")).alias(f"recall_{k}") for k in ks], F.coalesce(1 / (F.min("rank") + 1), F.lit(0.0)).alias("rr"))
    last = f"recall_{ks[-1]}"
    base = each.filter(F.col("arm") == control).select(query, F.col(last).alias("_base"))
    both = each.join(base, query)
    out = both.groupBy("arm").agg(F.count("*").alias("n_queries"), *[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks], F.avg("rr").alias("rr"), F.count_if(F.col(last) > F.col("_base")).alias("better"), F.count_if(F.col(last) < F.col("_base")).alias("worse"))
    return out.withColumn("p_value", sign_test(F.col("better"), F.col("worse")))



def summary(answers: DataFrame, walls: DataFrame, gold: DataFrame, query: str, key: str, ks: tuple[int, ...] = (5, 10, 20), costed: int = 10) -> DataFrame:
    """Of each arm over all queries that it was asked (walls: arm, query, wall): n, wall_mean, recall, lost evidence and hit rate at each k, hit_1, rr, and the seconds that a hit among the first `costed` costs.

    Recall is that of queries with labels; a query without any is no hit.
    Without a hit the cost is infinite.
    """
    wanted = walls.join(gold.select(query, key).distinct(), query, "left")
    each = wanted.join(answers, ["arm", query, key], "left").groupBy("arm", query).agg(
        F.first("wall").alias("wall"), F.count(key).alias("_gold"), F.min("rank").alias("_best"), *[F.count_if(F.col("rank") < k).alias(f"_in_{k}") for k in ks]
    )
    hit = lambda k: F.avg(F.coalesce(F.col("_best") < k, F.lit(False)).cast("double"))
    recall = lambda k: F.coalesce(F.avg(F.when(F.col("_gold") > 0, F.col(f"_in_{k}") / F.col("_gold"))), F.lit(0.0))
    columns = [c for k in ks for c in (recall(k).alias(f"recall_{k}"), (1 - recall(k)).alias(f"lost_{k}"), hit(k).alias(f"hit_{k}"))]
    cost = F.when(hit(costed) > 0, F.avg("wall") / hit(costed)).otherwise(float("inf"))
    return each.groupBy("arm").agg(F.count("*").alias("n"), F.avg("wall").alias("wall_mean"), *columns, hit(1).alias("hit_1"), F.avg(F.coalesce(1 / (F.col("_best") + 1), F.lit(0.0))).alias("rr"), cost.alias("cost_per_hit"))
