"""Near words against all pairs, and how few pairs are compared."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracemill.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edits(w):
    return 0 if len(w) < 3 or len(w) > 40 else 1 if len(w) < 6 else 2


def test_did_you_mean_equals_all_pairs(spark):
    rnd = random.Random(11)
    known = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 9))): rnd.randrange(1, 5) for _ in range(250)} | {"x" * 41: 1, "y" * 42: 2}
    asked = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 9))) for _ in range(80)} | {"x" * 40, "x" * 42, "", "y" * 40}
    a = spark.createDataFrame([(w,) for w in asked] + [(None,)], "word string")
    v = spark.createDataFrame([*known.items(), (None, 1)], "word string, n int")
    got = {(r["query"], r["rank"]): (r["word"], r["distance"]) for r in spelling.did_you_mean(a, v).collect()}
    want = {}
    for q in asked - known.keys():
        near = sorted((distance(q, w), -n, w) for w, n in known.items() if distance(q, w) <= edits(q))[:3]
        want |= {(q, i): (w, d) for i, (d, _, w) in enumerate(near, 1)}
    assert got == want and len(got) > 50
    assert spelling.did_you_mean(a, v.limit(0)).count() == 0


def test_few_pairs_are_candidates(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)]
    v = spark.createDataFrame([(w,) for w in words], "word string")
    a = spark.createDataFrame([(w[:2] + w[3:],) for w in words[:300]], "word string")
    assert spelling.candidates(a, v).count() < 0.01 * 3000 * 300


def test_leftovers_are_those_of_deletions(spark):
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abé\U0001f600") for _ in range(rnd.randrange(0, 8))) for _ in range(200)] + ["x" * 42]
    edits = np.array([rnd.randrange(3) for _ in words])
    own = lambda w: int(spelling._hashes(np.frombuffer(w.encode("utf-32-le"), np.uint32).reshape(1, len(w)), 0)[0, 0])
    seen = []
    for at, hashes in spelling._leftovers(words, edits):
        for i, h in zip(at, hashes):
            left = {words[i]}
            for _ in range(edits[i]):
                left |= {w[:j] + w[j + 1 :] for w in left for j in range(len(w))}
            assert set(map(int, h)) == {own(w) for w in left}
            seen.append(i)
    assert sorted(seen) == list(range(len(words)))


def test_vocabulary_is_read_once_and_few_leftovers_leave_a_task(spark, tmp_path):
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(3000)]
    spark.createDataFrame([(w, 1) for w in words], "word string, n int").write.parquet(str(tmp_path / "vocabulary"))
    v = spark.read.parquet(str(tmp_path / "vocabulary"))
    a = spark.createDataFrame([(w[:2] + w[3:],) for w in words[:50]] + [(words[0],)], "word string")
    found = spelling.did_you_mean(a, v)
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
    assert sorted((r["query"], r["word"]) for r in found.filter("rank = 1").collect()) == sorted((w[:2] + w[3:], w) for w in words[:50])
    sought = spelling._indexed(a.select("word"), spelling.allowed(F.col("word")))
    bitmap = spark.sparkContext.broadcast(spelling._bits(sought))
    assert spelling._indexed(v.select("word"), F.lit(2), bitmap).count() < 0.05 * spelling._indexed(v.select("word"), F.lit(2)).count()


def test_notes_and_gaps(spark):
    keywords = spark.createDataFrame([("STATIC",), ("STEP",), ("BUCKLE",)], "k string")
    asked = spark.createDataFrame([("*SATIC now",), ("*STEP BUCKLE",), ("plain text",), ("*NOTHINGLIKEIT",)], "q string")
    assert dict(map(tuple, spelling.keyword_notes(asked, keywords, "q", "k").collect())) == {"*SATIC now": "no keyword *satic; nearest: static", "*NOTHINGLIKEIT": "no keyword *nothinglikeit"}
    declared = spark.createDataFrame([(1, "Linear buckling of plates"), (2, "Buckling: linear"), (3, "Linear statics")], "id int, title string")
    held = spark.createDataFrame([(2,)], "id int")
    queries = spark.createDataFrame([("a", ["linear", "Buckling"]), ("b", ["linear"])], "q string, ts array<string>")
    assert [tuple(r) for r in spelling.gaps(declared, held, queries, "id", "title", "q", "ts").collect()] == [("a", "Linear buckling of plates", 1)]
