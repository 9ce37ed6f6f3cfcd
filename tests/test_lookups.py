"""Modes, consults, provider records, and files of a study."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tracemill.operators import consult, retrieval
from tracemill.sources import files


@pytest.mark.parametrize(
    "mode, dense, resolved, fails",
    [("auto", 0.5, "hybrid", False), (" Auto ", None, "bm25", False), ("hybrid", 1.0, "hybrid", False), ("hybrid", None, None, True), ("bm25", 0.5, "bm25", False), ("substring", None, "substring", False), ("dense", 1.0, None, True), ("", 1.0, None, True)],
)
def test_modes(mode, dense, resolved, fails):
    got = consult.choose(mode, dense)
    assert got.resolved == resolved and bool(got.error) == fails


def test_coverage_counts_texts_once_and_none_is_none(spark):
    texts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    vectors = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, None), (9, [1.0])], "k long, v array<double>")
    assert consult.coverage(texts, vectors, "k", "v") == 0.25
    assert consult.coverage(texts, vectors.filter("k = 9"), "k", "v") is None
    assert consult.coverage(texts.limit(0), vectors, "k", "v") is None


def test_cosine_leaves_out_odd_vectors_and_breaks_ties_by_key(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000, 0, -1)] + [(0, [0.0, 0.0]), (-1, None), (-2, [1.0, None]), (-3, [1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(7)
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [1.0, None])], "query_id string, v array<double>")
    got = retrieval.cosine(df, q, "k", "v", k=5, block=1).collect()
    assert sorted((r["query_id"], r["k"]) for r in got) == [("a", i) for i in range(1, 6)]
    assert retrieval.cosine(df.limit(0), q, "k", "v").count() == 0 and retrieval.cosine(df, q.filter("v is null"), "k", "v").count() == 0


def test_long_titles_cost_as_much_as_their_words(spark):
    """A title of 8 times the words takes no 64 times as long: 4000 words took minutes when each was sought among the kept ones, sorted anew."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.concat(F.lit("w"), i)))
    start = time.monotonic()
    r = spark.range(4).select(consult.preprint_queries(F.concat_ws(" ", text, F.col("id").cast("string"))).alias("q")).collect()
    assert time.monotonic() - start < 20
    assert [len(x["q"]) for x in r] == [3] * 4 and all(x["q"][1].count(" AND ") == 2400 for x in r)
    assert r[0]["q"][1].startswith("all:w1000 AND all:w1001 AND") and r[0]["q"][1].endswith("AND all:w3400")


def test_preprint_queries(spark):
    texts = ["coilable longeron mast", "a mast", "ti:mast", "one AND two", 'say "this"', "", "The design of deployable masts for small satellites in orbit", "mast MAST mast beam", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", consult.preprint_queries(F.col("t")).alias("q")).orderBy("i").collect()
    got = [r["q"] for r in rows]
    assert got[0] == ["all:coilable AND all:longeron AND all:mast", "all:coilable AND all:longeron", "coilable longeron mast"]
    assert got[1:6] == [["a mast"], ["ti:mast"], ["one AND two"], ['say "this"'], [""]]
    assert got[6] == ["all:design AND all:deployable AND all:masts AND all:small AND all:satellites AND all:orbit", "all:design AND all:deployable AND all:masts AND all:satellites", texts[6]]
    assert got[7] == ["all:mast AND all:beam", "mast MAST mast beam"]


def test_records_of_odd_replies(spark):
    replies = ["", "[]", "{", '[{"doi": null}]', '[{"doi": "10.48550/ARXIV.2401.00001", "id": "https://openalex.org/W1", "extra": 1}]', "ERROR: no network", None]
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, t string").select("i", consult.works_records(F.col("t")).alias("r"), consult.reply_error(F.col("t")).alias("e")).orderBy("i").collect()
    assert [len(r["r"]) for r in rows] == [0, 0, 0, 1, 1, 0, 0]
    assert rows[4]["r"][0]["arxiv"] == "2401.00001" and rows[4]["r"][0]["work_id"] == "W1" and rows[3]["r"][0]["doi"] == ""
    assert [r["e"] for r in rows] == [None] * 5 + ["no network", None]


def test_paths_are_followed_as_a_file_system_does(spark, tmp_path):
    root = str(tmp_path / "a" / "study")
    asked = ["x.py", "./x.py", "d/../x.py", "../study/x.py", "../../a/study/d/y.md", "../x.py", "/etc/passwd", root + "/x.py", "..", ".", "", "d//y.md", "../../../../../../../../etc/hosts", "../study2/x.py", None]
    got = [r["p"] for r in spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, a string").select("i", files.resolved_path(F.col("a"), root).alias("p")).orderBy("i").collect()]
    want = []
    for a in asked:
        full = None if a is None else os.path.normpath(os.path.join(root, a))
        want.append(full[len(root) + 1 :] if full and full.startswith(root + "/") else None)
    assert got == want


def test_a_study(spark, tmp_path):
    made = {"runs/20240101T000001_a/debug/x.log": b"1", "runs/20240101T000002/notes.md": b"2", "runs/ws/deep/er/a.TEX": b"caf\xe9", "runs/ws/b.bin": b"\x00", "runs/odd/debug/delegations/D1/r.json": b"{}", "runs/odd/debug/run_status.json": b'{"status": "failed"}', "top.md": b"t", "runs/loose.txt": b"l"}
    for path, value in made.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_bytes(value)
    root = f"file://{tmp_path}"
    assert sorted((r["run_id"], r["n_files"], r["status"]) for r in files.runs(spark, root).collect()) == [("20240101T000001_a", 1, "running"), ("odd", 2, "failed")]
    got = sorted((r["path"], r["scope"], r["run_id"], r["owner"], r["size"], r["readable"]) for r in files.artifacts(spark, root).collect())
    assert got == [("runs/odd/debug/delegations/D1/r.json", "run", "odd", "D1", 2, True), ("runs/ws/b.bin", "shared", None, "ws", 1, False), ("runs/ws/deep/er/a.TEX", "shared", None, "ws", 4, True)]
    asked = spark.createDataFrame([("runs/ws/deep/er/a.TEX",), ("runs/ws/b.bin",), ("gone.md",), ("../" + tmp_path.name + "/top.md",), (None,), ("top.md",), ("top.md",)], "path string")
    texts = sorted((r["path"] or "", r["text"]) for r in files.artifact_texts(spark, root, asked).collect())
    assert texts == sorted([("runs/ws/deep/er/a.TEX", "caf�"), ("runs/ws/b.bin", None), ("gone.md", None), ("../" + tmp_path.name + "/top.md", "t"), ("", None), ("top.md", "t"), ("top.md", "t")], key=lambda x: x[0])


def test_a_consult_takes_each_ask_one_way(spark, tmp_path):
    from tracemill.operators import textindex

    docs = spark.createDataFrame([(1, "mast of steel"), (2, "beam of steel"), (30, "1")], "k long, text string").withColumn("tokens", F.split("text", " "))
    textindex.add_segment(docs.select("k", "tokens"), "k", {"tokens": 1.0}, f"file://{tmp_path}/i")
    corpus = consult.Corpus(docs.select("k", "text"), textindex.read_index(spark, f"file://{tmp_path}/i"), "k")
    asks = spark.createDataFrame([(0, None), (1, " 1 "), (2, "steel mast"), (3, "nothing"), (4, "\t")], "a int, said string").withColumn("terms", F.split(F.coalesce("said", F.lit("")), " "))
    got = sorted((r["a"], r["kind"], r["rank"], r["k"], r["shown"]) for r in corpus.consult(asks, "a", "said", "terms", F.col("text"), most=2).collect())
    assert [x for x in got if x[0] < 4] == [(0, "list", 0, 1, None), (0, "list", 1, 2, None), (1, "entry", 0, 1, "mast of steel"), (2, "search", 0, 1, None), (2, "search", 1, 2, None)]
    assert [x[1] for x in got if x[0] == 4] == ["list", "list"]


def test_stores_of_one_header_are_one_scan(spark, tmp_path):
    made = {"experiment_data": "k,v\n1,a\n", "n one/experiment_data": 'k,v\n2,"b\nc"\n', "n+two%20/experiment_data": "v,k\nd,3\n", "three/experiment_data": 'k,"w\nx"\n4,e\n', "none/experiment_data": "", "deep/er/experiment_data": "k,v\n9,z\n"}
    for folder, text in made.items():
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "output.csv").write_text(text, "utf-8")
    df = files.scan_stores(spark, f"file://{tmp_path}", {"k": "long"})
    assert sorted((r["_namespace"], r["k"], r["v"], r["w\nx"]) for r in df.collect()) == [("default", 1, "a", None), ("n one", 2, "b\nc", None), ("n+two%20", 3, "d", None), ("three", 4, None, "e")]
    assert files.store_heads(spark, f"file://{tmp_path}").select("header").distinct().count() == 3
    named = spark.createDataFrame([("three",), ("four",), ("four",), (None,)], "_namespace string")
    assert sorted(files.namespaces(df, named).filter("in_config").collect()) == [("four", 0, False, True), ("three", 1, True, True)]


def test_no_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_stores(spark, f"file://{tmp_path}", {})
