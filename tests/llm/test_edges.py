"""Every operator on awkward rows: nulls, empty and long texts, repeated rows, extra columns, empty tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tracemill.llm import katz, licenses, mixing, nearest, packing, passages, quality, simhash, tokens, topk, vectors

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = " ".join(f"{WORDS[i % 10]}{i * 7919 % 4099}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", None),
    (3, " \n\t ", "en", None, 3),
    (None, "some words without an id", "en", "a", 24),
    (5, "word", "en", "a", 4),
    (5, "word", "en", "a", 4),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG, "de", "b", len(LONG)),
    (9, "Released under the MIT License.\nÄ é ñ <|endoftext|> 'll  x", "en", "b", 50),
    (10, "of " * 400, "en", "b", 1200),
]
EXTRA = ["score", "predicted", "cuts", "fp", "domain", "n_tokens", "epoch", "row", "held", "key", "sequence_id"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(ROWS, schema).withColumns({c: F.lit("x") for c in EXTRA}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 1, 0), (10, 0, None), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2  # the end alone
    assert sum(1 for r in rows if r["doc_id"] == 5) == 2
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def test_section_tokens(docs, none):
    rows = tokens.section_tokens(docs).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0), (2, 0)}
    assert sum(1 for r in rows if r["doc_id"] == 5) == 2 and any(r["doc_id"] is None for r in rows)
    assert tokens.section_tokens(none).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert by[8]["component_id"] == 7 and by[5]["component_id"] == 5
    assert simhash.near_duplicates(none).count() == 0


def test_katz(docs, none):
    rows = katz.score(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and by[1]["n_tokens"] == 1 and by[None]["held_out"]
    assert all(r["score"] == r["score"] and r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert katz.score(none).count() == 0


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert set(docs.columns) <= set(quality.scored(docs, model).columns)
    assert quality.scored(none, quality.train(none, labels.limit(0))).count() == 0


def test_repeated_keys_with_other_texts(spark):
    rows = [(1, "good words here " * 9, 1), (1, "@@ ## 12 12 12 " * 9, 0), (2, "good words again " * 9, 1), (3, "@@ ## 12 " * 20, 0), (3, "@@ ## 12 " * 20, 0)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    scores = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(scores) == 5 and len({r["score"] for r in scores if r["doc_id"] == 3}) == 1 and len({r["score"] for r in scores if r["doc_id"] == 1}) == 2
    mixed = docs.select("doc_id", F.lit("d").alias("domain"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), mixing.token_count().alias("n_tokens"))
    got = mixing.mix(mixed, {}, 1e9, epochs=1)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(t.split()) for _, t, _ in rows)
    assert mixing.mix(mixed, {}, 0.0, epochs=1).count() == 0


def test_groups_without_a_doc_id(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, text), (None, text), (None, "alone"), (7, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7), (None, 7), (None, 7), (None, None)]


def test_pieces_of_equal_length(spark):
    docs = spark.createDataFrame([(i, "same text " * 55) for i in range(40)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    lengths = {r["length"] for r in rows}
    assert len(rows) == 40 and len(lengths) == 1
    each = 1024 // lengths.pop()
    assert len({r["sequence_id"] for r in rows}) == -(-40 // each)


def test_licenses_from_a_table(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    notices = [(f"n{i}", " ".join(f"t{i}x{j}" for j in range(6 + i % 40))) for i in range(1500)]
    rows = [(i, f"{filler} {notices[i][1]} {filler}") for i in range(0, 1500, 50)] + [(9999, filler), (9998, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(notices, "template string, notice string")
    want = {(i, f"n{i}", 1.0) for i in range(0, 1500, 50)}
    for most in (10**6, 10):  # keys in the plan, and met by a join
        assert {(r["doc_id"], r["template"], r["containment"]) for r in licenses.scan(docs, table, most_keys=most).collect()} == want


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert [(r["doc_id"], r["template"], r["containment"]) for r in rows] == [(9, "mit", 1.0)]
    assert licenses.scan(none).count() == 0


def test_passages(docs, none):
    found = passages.repeated_passages(docs)
    rows = found.collect()
    assert any(r["doc_id"] == 8 and r["other_id"] == 7 and r["stop"] - r["start"] == 60_000 for r in rows)
    assert {r["doc_id"] for r in rows} == {8}
    kept = {r["doc_id"]: r["text"] for r in passages.without_passages(docs, found).collect()}
    assert kept[8] == "" and kept[7] == LONG and kept[1] is None
    assert passages.repeated_passages(none).count() == 0


def test_mixing(spark, docs, none):
    def rows(d):
        return d.select("doc_id", "lang", "source", mixing.domain_of().alias("domain"), mixing.token_count().alias("n_tokens"))

    got = mixing.mix(rows(docs), mixing.target_weights(spark), 1e9, epochs=2).collect()
    assert len(got) == 2 * (len(ROWS) - 2)  # two epochs of all, but for two leaves without tokens
    assert mixing.mix(rows(none), mixing.target_weights(spark), F.col("total") * 0.5).count() == 0


@pytest.fixture(scope="module")
def embeddings(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float((i * k) % 7 - 3) for k in range(1, 6)]) for i in range(41) if i % 7]
    bad = [(100, None), (200, []), (300, [1.0, None, 0.0, 0.0, 0.0]), (400, [nan, 0.0, 0.0, 0.0, 1.0]), (500, [inf, 0.0, 0.0, 0.0, 0.0]), (600, [1.0]), (None, [1.0] * 5), (0, [0.0] * 5), (20, [float((20 * k) % 7 - 3) for k in range(1, 6)])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return spark.createDataFrame(good + bad, schema).withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))


def test_nearest(embeddings):
    rows = vectors.usable(embeddings, "vec_id", "embedding", zero=False)
    got = nearest.search(rows, vectors.queries_of(rows, 20), 20).collect()
    assert {r["query_id"] for r in got} == {20, 40}
    assert len([r for r in got if r["query_id"] == 40]) == 20
    empty = rows.limit(0)
    assert nearest.search(empty, vectors.queries_of(empty, 20), 20).count() == 0


def test_topk(embeddings):
    rows = vectors.usable(embeddings, "vec_id", "embedding", zero=True)
    got = topk.top_k(rows, vectors.queries_of(rows, 20), 50).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}
    assert len([r for r in got if r["query_id"] == 0]) == 36  # all candidates, fewer than k
    empty = rows.limit(0)
    assert topk.top_k(empty, vectors.queries_of(empty, 20), 10).count() == 0


def test_pipeline_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    from tracemill.functions.scratch import stored

    for given in (docs, none):
        at = stored(given, "edges")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.columns == given.columns
            at = stored(out, name)
        assert (at.count() > 0) == (given is docs)
