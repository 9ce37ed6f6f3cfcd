"""Indexes of evidence, post-mortems, costs of hits, and corpora from files."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import harness, reports
from tracemill.sources import files

LAST = "run string, id string, pos long, is_patch boolean, status string, to_node string, task string, deliverable string, commit string"


def test_the_last_row_that_is_no_patch_counts(spark):
    rows = [("r", "a", 1, False, "open", "N", "t", None, None), ("r", "a", 3, True, None, None, None, None, None), ("r", "a", 2, None, "done", None, "t", "d", "c"), ("s", "a", 9, True, None, None, None, None, None)]
    got = reports.latest(spark.createDataFrame(rows, LAST), "run", "id", "pos").collect()
    assert [(r["run"], r["id"], r["status"], r["to_node"], r["deliverable"]) for r in got] == [("r", "a", "done", None, "d")]


def test_intent(spark):
    texts = [None, "", " \n\t\n", "  do this \nthen that", "x" * 140, "y" * 141, "\n\n z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(reports.intent(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["", "", "", "do this", "x" * 140, "y" * 137 + "...", "z"]


@pytest.mark.parametrize("n, width", [(1, 0), (3, 0), (90, 30), (400, 0), (10, 3000)])
def test_a_block_is_the_whole_text_cut_at_a_line(spark, n, width):
    rows = [("r", f"D{i:04d}", i, False, "done", "N1", "w" * min(width, 139), "d" if i % 2 else "", "c1" if i % 3 else None) for i in range(n)]
    made = spark.createDataFrame([("c1", f"f{i:02d}" + "x" * (width // 100)) for i in range(11)] * 2, "commit string, file string")
    touched = reports.touched(made, "commit", "file")
    assert [(len(r["named"]), r["n_files"]) for r in touched.collect()] == [(8, 11)]
    df = spark.createDataFrame(rows, LAST)
    got = reports.evidence_blocks(reports.entries(df, touched, "id", "rep"), "run", "id").first()
    shown = ", ".join("delegations/" + f"f{i:02d}" + "x" * (width // 100) for i in range(8)) + ", ... (+3 more)"
    full = "\n".join(f"{r[1]} | N1 | done | {r[6]}\n  report: {'rep/' + r[1] + '.md' if r[7] else '(none)'}\n  touched: {shown if r[8] else '(no files)'}" for r in rows)
    body = full if len(full) <= 6000 else full[:6000].rsplit("\n", 1)[0] + "\n[... index truncated; full index: evidence_index.md ...]"
    assert got["block"] == f"<evidence_index>\n{body}\n</evidence_index>" and got["n_delegations"] == n


def test_an_index_of_nothing(spark):
    df, none = spark.createDataFrame([], LAST), spark.createDataFrame([], "commit string, file string")
    assert reports.evidence_blocks(reports.entries(df, reports.touched(none, "commit", "file"), "id", "rep"), "run", "id").count() == 0
    assert reports.write_reports(df, "run", "id", "/nowhere") == 0


def test_reports_are_written_once_each(spark, tmp_path):
    rows = [("r1", "a", 1, False, "s", "n", "t", "één", "c"), ("r1", "b", 1, False, "s", "n", "t", "", "c"), ("r2", "a", 1, False, "s", "n", "t", "two", "c"), ("r2", "c", 1, False, "s", "n", "t", None, "c")]
    df = spark.createDataFrame(rows, LAST)
    for _ in range(2):
        assert reports.write_reports(df, "run", "id", f"file://{tmp_path}/out") == 2
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.md")} == {"out/r1/a.md": "één", "out/r2/a.md": "two"}


def test_post_mortems_fill_in_for_runs_that_told_nothing(spark):
    rows = [(r, i, 1, False, s, "N", "t", None, None) for r, i, s in (("a", "1", "done"), ("b", "2", "review"), ("b", "1", None), ("c", "1", "done"), ("d", "1", "done"))]
    told = spark.createDataFrame([("a", "planner", "N1"), ("b", "critic", "N1"), ("c", "planner", "SYNTHESIZED:planner"), ("d", "planner", None)], "run string, role string, source_id string")
    diag = spark.createDataFrame([("b", "E", "x"), ("b", None, "x"), ("b", None, None), ("b", "E", None), ("z", "E", None)], "run string, error_type string, type string")
    got = {r["run"]: r["text"] for r in reports.post_mortems(spark.createDataFrame(rows, LAST), diag, told, "run", "id", "planner", "why", "review").collect()}
    assert sorted(got) == ["b", "c"]
    assert got["b"].split("\n") == ["## SYNTHESIZED, NOT FIRST-PERSON", "why", "Last delegation states: 1=N:None, 2=N:review", "Under review, never approved: 2", "Diagnostics: E=2, other=1, x=1"]
    assert got["c"].endswith("Last delegation states: 1=N:done\nDiagnostics: (none)")


def test_costs_count_queries_without_labels(spark):
    walls = spark.createDataFrame([(a, q, 2.0 if a == "x" else 1.0) for a in "xy" for q in range(4)], "arm string, q int, wall double")
    gold = spark.createDataFrame([(0, 10), (0, 11), (1, 12), (2, 13)], "q int, k int")
    answers = spark.createDataFrame([("x", 0, 10, 0), ("x", 0, 11, 12), ("x", 1, 12, 7), ("x", 3, 10, 0)], "arm string, q int, k int, rank int")
    got = {r["arm"]: r for r in harness.summary(answers, walls, gold, "q", "k").collect()}
    x, y = got["x"], got["y"]
    assert x["n"] == 4 and x["recall_5"] == pytest.approx(0.5 / 3) and x["recall_20"] == pytest.approx(2 / 3) and x["lost_20"] == pytest.approx(1 / 3)
    assert x["hit_10"] == 0.5 and x["hit_1"] == 0.25 and x["rr"] == pytest.approx((1 + 1 / 8) / 4) and x["cost_per_hit"] == 4.0
    assert y["cost_per_hit"] == float("inf") and y["recall_5"] == 0 and y["rr"] == 0


def test_chunks_of_a_corpus(spark, tmp_path):
    (tmp_path / "papers.csv").write_text('paper_id,title,year,citation_count,full_text\na,"one, ""two""\nthree",1999,,TRUE\nb,,x,7,yes\n', "utf-8")
    lines = [json.dumps({"paper_id": p, "chunk_id": i, "page": None, "text": "t"}) for p, i in (("a", 0), ("a", 1), ("b", 0), ("gone", 0))]
    (tmp_path / "chunks.jsonl").write_text("\n\n".join(lines) + "\n", "utf-8")
    got = sorted((r["paper_id"], r["chunk_id"], r["title"], r["year"], r["citations"], r["full_text"]) for r in files.corpus_chunks(spark, f"file://{tmp_path}").collect())
    assert got == [("a", 0, 'one, "two"\nthree', 1999, 0, True), ("a", 1, 'one, "two"\nthree', 1999, 0, True), ("b", 0, None, None, 7, False), ("gone", 0, None, None, 0, False)]
