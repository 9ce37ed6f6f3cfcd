"""Arms over one labelled set."""

import math

import pytest
from pyspark.sql import functions as F

from tracemill.operators import harness


def answers(spark, name, rows):
    return lambda: harness.Answer(name, spark.createDataFrame(rows, "q int, k int, rank int"))


def test_arms_are_compared_in_one_plan(spark):
    gold = spark.createDataFrame([(q, 10 * q) for q in range(1, 9)] + [(1, 11)], "q int, k int")
    arms = {"a": answers(spark, "a", [(q, 10 * q, 0) for q in (1, 2)] + [(3, 30, 4), (4, 40, 5)]), "b": answers(spark, "b", [(q, 10 * q, 1) for q in range(2, 9)])}
    rows = {r["arm"]: r for r in harness.compared(harness.run_arms(arms, "q", "k"), gold, "q", "k", "a").collect()}
    a, b = rows["a"], rows["b"]
    assert (a["n_queries"], a["recall_1"], a["recall_5"], a["better"], a["worse"], a["p_value"]) == (8, 1.5 / 8, 2.5 / 8, 0, 0, 1.0)
    assert (b["recall_1"], b["recall_3"], b["rr"], b["better"], b["worse"]) == (0, 7 / 8, 0.5 * 7 / 8, 5, 1)
    assert abs(b["p_value"] - 2 * (1 + 6) / 2**6) < 1e-12


def test_a_mislabelled_arm_is_refused(spark):
    with pytest.raises(harness.MislabelledArm, match="hybrid ran as lexical"):
        harness.run_arms({"hybrid": answers(spark, "lexical", [(1, 1, 0)])}, "q", "k")


def test_unknown_labels_stop_the_job(spark):
    gold = spark.createDataFrame([(1, 5), (2, 6)], "q int, k int")
    texts = spark.createDataFrame([(5,), (6,), (7,)], "k int")
    assert harness.checked(gold, texts, "k").count() == 2
    with pytest.raises(Exception, match="a label names an unknown text: 6"):
        harness.checked(gold, texts.filter("k <> 6"), "k").collect()


def test_sign_test(spark):
    pairs = [(0, 0), (1, 5), (5, 1), (3, 3), (40, 90), (0, 2000)]
    df = spark.createDataFrame(pairs, "b long, w long").withColumn("p", harness.sign_test(F.col("b"), F.col("w")))
    for r in df.collect():
        n, m = r["b"] + r["w"], min(r["b"], r["w"])
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n) if n else 1.0
        assert math.isclose(r["p"], want, rel_tol=1e-9, abs_tol=1e-300)


def test_a_grown_set_keeps_its_split(spark):
    split = lambda n: {r["id"]: r["h"] for r in spark.range(n).withColumn("h", harness.held_out(F.col("id"))).collect()}
    few, many = split(200), split(400)
    assert all(many[k] == v for k, v in few.items()) and 20 < sum(few.values()) < 60
