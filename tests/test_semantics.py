"""Operators on literal rows: exact counts, and cases that pass only under the right semantics."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tracemill.functions.columns import nan_to_null, natural_key
from tracemill.functions.html import meta_content, page_text
from tracemill.functions.predicate import PredicateError, where
from tracemill.jobs import documents as document_jobs
from tracemill.jobs.graphs import verdict
from tracemill.operators import documents, evalstats, eventlog, graph, ledger, records, retrieval, sinks, state, symbols
from tracemill.sources import files


@pytest.fixture(scope="module")
def store(spark):
    """Beams: width, mass, whether one buckles, its safety, and who evaluated it."""
    rows = [(1.5, 12.0, 0, 1.9, "D010"), (2.0, 9.0, 0, 1.2, "D011"), (2.5, 7.5, 1, 2.4, "D010"), (3.0, 8.25, 0, 1.7, "D012"), (3.5, 15.0, 0, 1.75, "D012"), (4.0, 6.0, 1, 0.8, "D011")]
    return spark.createDataFrame(rows, "width double, mass double, buckles int, safety double, _delegation_id string").withColumn("row_id", F.monotonically_increasing_id())


def test_compound_predicate(store):
    kept = where(store, "buckles == 0 and safety >= 1.5")
    assert kept.count() == 3
    assert ledger.best_n(kept, "mass", 1, ["row_id"]).first()["mass"] == 8.25
    assert where(store, "width * 4 >= 10").count() == 4
    assert where(store, "1.9 < width < 3.2 and _delegation_id in ['D010', 'D012']").count() == 2
    assert where(store, "(mass > 10) & ~(buckles == 1) | safety == 0.8").count() == 3
    assert where(store, "mass ** 2 % 5 // 1 == 1").count() == 3


def test_explanations_of_empty_answers(store):
    one = lambda **k: ledger.explained(store, **k).first()
    r = one(predicate="safety >= 9", source="agent")
    assert (r["n_scanned"], r["n_matched"], r["verdict"]) == (6, 0, "true zero") and r["filters"] == "source='agent'; where='safety >= 9'"
    assert one(predicate="mass == 0.3")["verdict"].startswith("not necessarily") and one(predicate="buckles == 7")["verdict"] == "true zero"
    assert one()["verdict"] == "found" and one()["filters"] == "(no filter)"
    with pytest.raises(PredicateError):
        one(predicate="nothing >= 9")
    assert ledger.shown_columns(store.columns, ["width", "_ts"], "mass") == ["width", "mass", "_delegation_id"]


def test_negation_keeps_missing_values(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double"))
    assert where(df, "x != 1").count() == 3
    assert where(df, "not (x > 1)").count() == 3
    assert where(df, "not x > 1 and x == x").count() == 1
    assert where(df, "x not in [1, 2]").count() == 2


@pytest.mark.parametrize("text", ["nothing > 1", "width >", "__import__('os')", "width == [1]", "mass.mean() > 1", "width is None"])
def test_bad_predicates_say_so(store, text):
    with pytest.raises(PredicateError):
        where(store, text)


def test_sentinels_are_never_best(spark):
    df = spark.createDataFrame([("1e9",), ("text",), (None,), ("NaN",), ("3",), ("-2e8",)], "f string").withColumn("k", F.monotonically_increasing_id())
    assert [r["f"] for r in ledger.best_n(df, "f", 5, ["k"]).collect()] == ["3"]
    assert ledger.best_n(df.filter("f = '1e9'"), "f", 5, ["k"]).count() == 0


def test_namespaces_union(spark):
    a = spark.createDataFrame([(1, 2.0)], "x int, y double")
    b = spark.createDataFrame([(3, float("nan"), "n")], "x int, y double, note string")
    rows = {r["x"]: r for r in ledger.union_stores({"default": a, "other": b}).collect()}
    assert rows[1]["note"] is None and rows[3]["y"] is None and rows[3]["_namespace"] == "other"


def test_duplicates_at_scale(spark):
    points = [(i % 38, 0.5, "D003") for i in range(160)] + [(1, 0.5, None), (1, 0.5, "")]
    df = spark.createDataFrame(points, "x1 int, x2 double, _delegation_id string")
    (r,) = ledger.duplicate_stats(df.withColumn("k", F.monotonically_increasing_id()), ["x1", "x2"], ["k"]).collect()
    assert (r["n_total"], r["n_unique"], r["n_duplicate"]) == (160, 38, 122)
    assert (r["worst"], r["worst_design"]) == (5, "x1=0.0000;x2=0.5000")  # eight designs have five; this one came first


def test_rounded_designs_are_equal(spark):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (2, 0.3), (3, 0.31)], "k int, x double")
    assert [r["k"] for r in ledger.keep_first(df, df.limit(0), ["x"], ["k"]).orderBy("k").collect()] == [1, 3]
    assert ledger.keep_first(df, df.filter("k = 2"), ["x"], ["k"]).first()["k"] == 3


def test_guard(spark):
    old = spark.createDataFrame([(1, "FINISHED"), (2, "OPEN")], "k int, status string")
    check = lambda rows: ledger.store_guard(old, spark.createDataFrame(rows, old.schema), ["k"]).first()["allowed"]
    assert check([(1, "FINISHED"), (2, "FINISHED"), (3, "OPEN")])
    assert not check([(1, "FINISHED")]) and not check([(1, "OPEN"), (2, "OPEN")])


def test_content_hash_ignores_order(store):
    digest = lambda df: ledger.content_hash(df, ["mass", "safety"]).first()["content_hash"]
    assert digest(store) == digest(store.orderBy(F.desc("mass")).repartition(3)) != digest(store.filter("width > 1.5"))


def test_lookup(spark):
    from tracemill.operators.pool import nearest_pool_row

    pool = spark.createDataFrame([(0.0, 0.0, -1), (5.0, 5.0, 0), (10.0, 10.0, 1)], "a double, b double, y int")
    ask = spark.createDataFrame([(1, 4.4, 4.6), (2, 9.9, 9.9)], "k int, a double, b double")
    assert {(r["k"], r["y"]) for r in nearest_pool_row(ask, pool, ["a", "b"], "k", "y").collect()} == {(1, 0), (2, 1)}


def test_damaged_lines_are_left_out(spark):
    lines = spark.createDataFrame([('{"id": "D1", "n": 1}',), ("",), ("{broken",), (None,), ('{"id": "D2"}',), ("[1]",)], "value string")
    assert {(r["id"], r["n"]) for r in eventlog.parse_jsonl(lines, "id string, n int").collect()} == {("D1", 1), ("D2", None)}


def test_unknown_cost_is_not_zero(spark):
    calls = spark.createDataFrame([("a", "p", 100, 50, None), ("a", "q", 200, 20, None), ("b", "p", 300, 80, 0.06)], "role string, phase string, input_tokens long, output_tokens long, cost double")
    rows = {(r["grouped_by"], r["value"]): r for r in eventlog.rollup(calls, ["role", "phase"]).collect()}
    assert rows["total", ""]["input_tokens"] == 600 and rows["total", ""]["cost_calls"] == 1
    assert rows["role", "a"]["cost"] is None and rows["phase", "p"]["cost"] == 0.06 and len(rows) == 5


def test_collapse_and_patches(spark):
    log = spark.createDataFrame([("D001", 1, "RUNNING", None), ("D002", 2, "RUNNING", "x"), ("D001", 3, "DONE", "y")], "id string, pos int, status string, note string")
    assert {(r["id"], r["status"]) for r in eventlog.collapse(log).collect()} == {("D001", "DONE"), ("D002", "RUNNING")}
    patches = spark.createDataFrame([("D001", 4, "H2", None), ("D001", 5, "H1", "z"), ("D001", 6, "H2", None), ("D009", 7, "H1", None)], "id string, pos int, hypothesis string, note string")
    rows = {r["id"]: r for r in eventlog.patched(log, patches, "hypothesis", ["note"]).collect()}
    assert rows["D001"]["hypothesiss"] == ["H2", "H1"] and rows["D001"]["note"] == "z" and rows["D002"]["hypothesiss"] == [] and len(rows) == 2


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("H10", "H2", "A3", "H1", "H")], "n string")
    assert [r["n"] for r in df.orderBy(*natural_key("n")).collect()] == ["A3", "H", "H1", "H2", "H10"]
    many = ["v1.10", "v1.9", "v01.9", "v1.9.2", "v10", "v9", "", "7", "v1." + "9" * 30, "v1.1" + "0" * 30, "x"]
    df = spark.createDataFrame([(x,) for x in many], "n string")
    assert [r["n"] for r in df.orderBy(*natural_key("n")).collect()] == ["", "7", "v01.9", "v1.9", "v1.9.2", "v1.10", "v1." + "9" * 30, "v1.1" + "0" * 30, "v9", "v10", "x"]


def test_components_with_a_late_bridge(spark):
    records = spark.createDataFrame([(1, "a", None), (2, None, "t"), (3, "a", "t"), (4, None, None), (5, "b", None)], "k long, doi string, title string")
    assert {(r["k"], r["cluster"]) for r in graph.merge_records(records, "k", ["doi", "title"]).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(edges).select("root").distinct().collect()[0]["root"] == 0


def test_layers_put_the_unreached_last(spark):
    nodes = spark.range(5).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    got = {r["node"]: r["layer"] for r in graph.layers(nodes, edges, nodes.filter("node = 0")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_mcnemar_and_wilson(spark):
    pairs = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 1 + [(True, True)] * 5, "a boolean, b boolean")
    assert evalstats.mcnemar(pairs, "a", "b").first()["p_value"] == pytest.approx(2 * (1 + 9) / 2**9)
    many = spark.range(6000).select((F.col("id") % 2 == 0).alias("a"), (F.col("id") % 2 == 1).alias("b"))
    assert evalstats.mcnemar(many, "a", "b").first()["p_value"] == 1.0
    low, high = evalstats.wilson(F.lit(0.0), F.lit(10.0))
    row = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert row["low"] == 0.0 and row["high"] == pytest.approx(0.2775, abs=1e-3)


def test_short_tails_are_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(205)))), (2, ""), (3, None)], "k int, t string")
    assert [(r["start"], len(r["chunk"].split())) for r in retrieval.chunks(df, "k", "t").orderBy("start").collect()] == [(0, 150), (100, 105), (200, 5)]


def test_verdicts(spark):
    texts = ["## Verdict\n\n**PASS** fine", "verdict: fail", "REVISE this", "I would pass", "the verdict is out"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(verdict(F.col("t"))).collect()] == ["PASS", "FAIL", "REVISE", "UNKNOWN", "UNKNOWN"]


def test_page_text():
    html = "<html><head><title>A &amp; B</title></head><body><nav>menu</nav><div id=x><article><h1>Head</h1><p>First <b>bold</b>.</p><dl><dt>term</dt><dd>meaning</dd></dl><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></article></div><script>x()</script><footer>foot</footer></body></html>"
    title, body = page_text(html)
    assert title == "A & B" and body.split("\n") == ["Head", "First bold.", "term: meaning", "| a | b |", "| --- | --- |", "| 1 | 2 |"]
    assert page_text(None) == ("", "") and page_text("plain <b>text")[1] == "plain text"


def test_page_blocks():
    code = "<pre>if x:\n    y()\n\n  z</pre>"
    html = f"<body><div class='top-nav'>menu</div><main><table><tr><td>Prose before{code}and after<dl><dt>k</dt><dd>v w</dd></dl></td></tr></table><p>Area <math><mi>a</mi><mo>=</mo><mn>2</mn></math> here</p><table><tr><th>n</th><th>what|how</th></tr><tr><td>1</td><td><p>one</p><p>two</p></td></tr><tr><td>3</td></tr></table></main><div id='cookie-banner'>ok?</div></body>"
    body = page_text(html)[1].split("\n")
    assert body == ["Prose before", "```", "if x:", "    y()", "", "  z", "```", "and after", "k: v w", "Area a = 2 here", "| n | what\\|how |", "| --- | --- |", "| 1 | one / two |", "| 3 | |"]
    assert page_text("<table><tr><td>open")[1] == "open"


def test_meta_in_any_order(spark):
    pages = ['<meta name="description" content="a">', "<META content='b' property=x name='description'/>", '<meta name="other" content="c">', None]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(meta_content("html", "description")).collect()] == ["a", "b", "", ""]


def test_pages_are_cut_at_sections(spark):
    text = "intro\n## One\n" + "a" * 30 + "\n## Two\nbb\n##no\n## Three \ncc"
    df = spark.createDataFrame([(text, ), ("short\n## x", )], "t string")
    cut = lambda cap: [tuple(r) for r in df.select(*records.cut_at_section(F.col("t"), cap)).collect()]
    assert cut(55)[0] == (text[: text.index("\n## Two")], ["Two", "Three"]) and cut(55)[1] == ("short\n## x", [])
    assert cut(30)[0] == (text[:30], ["Two", "Three"])  # the only heading is in the first half
    assert cut(500)[0] == (text, [])


def test_compound_claims(spark):
    texts = ["x > 3 and y < 4", "x rises and y falls 2", "a is 1; b is 2", "a is 1, b is 2", "(1) this (2) that", "1. this\n2. that", "much and 5 and 6", "3 and much and 6", "version 1.2 alone"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(records.is_compound(F.col("t"))).collect()] == [True, False, True, False, True, True, False, True, False]


def test_never_paired_leaves_out_what_comes_along(spark):
    cases = [(f"{x}{i}", x) for x in "abcd" for i in range(9)] + [("ab", "a"), ("ab", "b"), ("e", "e")]
    df = spark.createDataFrame(cases, "case string, item string")
    edges = spark.createDataFrame([("b", "c")], "src string, dst string")
    rows = {(r["item"], r["other"]) for r in graph.never_paired(df, "case", "item", 8, edges).collect()}
    # a stands beside b, which brings c; e is rare and never among the others
    assert rows == {("a", "d"), ("b", "d"), ("c", "a"), ("c", "b"), ("c", "d"), ("d", "a"), ("d", "b"), ("d", "c"), ("e", "a"), ("e", "b"), ("e", "c"), ("e", "d")}
    few = {(r["item"], r["other"], r["rank"]) for r in graph.never_paired(df, "case", "item", 8, edges, k=1).collect()}
    assert few == {("a", "d", 1), ("b", "d", 1), ("c", "a", 1), ("d", "a", 1), ("e", "a", 1)}


def test_tiers_and_aliases(spark):
    rows = [("pkg.Data.store", "pkg.Data", "Save the rows.", "", "method", False), ("pkg.store_all", "", "Write.", "", "function", False), ("pkg.restored", "", "Undo.", "", "class", False), ("pkg._x.store", "", "Hidden.", "", "class", True), ("pkg.Sampler", "", "Draws points.", "parameters", "class", False)]
    df = spark.createDataFrame(rows, "key string, owner string, summary string, body string, kind string, private boolean")
    score = lambda q, **a: {r["key"]: round(r["score"], 6) for r in symbols.tiered(df, q, a, "key", "owner", "summary", "body", "kind", "private").collect()}
    assert score("store") == {"pkg.Data.store": 1000, "pkg.store_all": 575, "pkg.restored": 287.5, "pkg._x.store": 172.5}
    assert score("other.Data.store")["pkg.Data.store"] == 200
    # sampling is akin to no name, but stands for sampler: 0.6 of a name, and covers its word
    assert score("sampling rows", sampling=("sampler",)) == {"pkg.Data.store": round(12 * 0.675, 6), "pkg.Sampler": round(60 * 0.6 * 0.675 * 1.15, 6)}
    assert score("parameter") == {"pkg.Sampler": round(2 * 0.35 * 1.15, 6)}
    assert symbols.expanded(["latin", "hyper"], {"latinhyper": ("lhs",), "latin": ("hyper",)}) == {"lhs": "latin"}


def test_names_resolve(spark):
    s = spark.createDataFrame([("p.a.Run",), ("p.b.Run",), ("p.b.Go",)], "key string")
    asked = spark.createDataFrame([("p.a.Run",), ("Go",), ("Run",), ("x.y.b.Run",), ("Stop",)], "name string")
    assert {(r["name"], r["key"]) for r in symbols.resolved(s, asked, "key", "name").collect()} == {("p.a.Run", "p.a.Run"), ("Go", "p.b.Go"), ("x.y.b.Run", "p.b.Run")}


def test_ledger_writes_are_guarded(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = lambda *r: spark.createDataFrame(list(r), "k int, y double")
    stamp = {"_delegation_id": F.lit("D1")}
    assert sinks.append_rows(path, rows((1, 1.0), (2, 2.0)), ["k"], stamp).count() == 2
    assert sinks.append_rows(path, rows((3, 3.0)), ["k"], stamp).count() == 3
    replaced = sinks.append_rows(path, rows((2, 9.0)), ["k"], stamp, replace_stale=True)
    assert {(r["k"], r["y"], r["status"]) for r in replaced.collect()} == {(1, 1.0, "FINISHED"), (2, 9.0, "FINISHED"), (3, 3.0, "FINISHED")}
    sinks.append_rows(path, rows((2, 9.0)), ["k"], stamp)
    with pytest.raises(sinks.GuardError):  # two rows of key 2 would become one
        sinks.append_rows(path, rows((2, 5.0)), ["k"], stamp, replace_stale=True)
    assert sinks.read(spark, path).count() == 4 and sinks.read(spark, f"file://{tmp_path}/none") is None


def test_strict_entries_stop_the_job(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',)], "t string")
    assert files.strict(df, "t", "a int, b string").first()["b"] == "x"
    for bad in ('{"a": 1}', "{torn", None):
        with pytest.raises(Exception, match="not a whole entry"):
            files.strict(spark.createDataFrame([(bad,)], "t string"), "t", "a int, b string").collect()


def test_front_matter(spark):
    texts = ["---\nid: x\ntags: [a, b]\nnote: c: d\n---\nBody\n", "no block", "---\n---\n", "text\n---\nid: y\n---\n"]
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "name string, t string")
    rows = [(r["id"], r["fields"], r["body"]) for r in files.front_matter(df, "t", "name").orderBy("name").collect()]
    assert rows == [("x", {"id": "x", "tags": "[a, b]", "note": "c: d"}, "Body\n"), ("f1", {}, "no block"), ("f2", {}, ""), ("f3", {}, texts[3])]


def test_sections(spark):
    texts = ["a\n### Verdict (final)\nPASS\n\nmore\n## Next\nx", "**Verdict:**\nFAIL\n**Other**\ny", "Verdict: REVISE. I\nfound it\n\nelse", "**Verdict**: short\n\nz", "## VerdictNotes\nx", "verdict:\nlow\n---\nq"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(state.section("t", "Verdict")).collect()] == ["PASS\n\nmore", "FAIL", "REVISE. I\nfound it", "short", "", "low"]


def test_replies(spark):
    df = spark.createDataFrame([("SUBSTANCE: FLAG\nCRITIQUE: weak\nproof",), ("substance: ok\nCRITIQUE: x",), ("I can't say",), ("",), (None,), ("SUBSTANCE: FLAG",)], "t string")
    flagged, critique = state.judged("t")
    assert [tuple(r) for r in df.select(flagged, critique).collect()] == [(True, "weak\nproof"), (False, ""), (False, "I can't say"), (False, ""), (False, ""), (True, "SUBSTANCE: FLAG")]
    review = spark.createDataFrame([(1, 'So: ```json\n{"elements": [{"element": "a", "status": "GAP"}, {"status": "gap", "note": "n"}, {"element": "c", "status": "ok"}]}\n``` bye {x}'), (2, "none"), (3, "{torn")], "k int, t string")
    assert {tuple(r) for r in state.review_gaps(review, "t").collect()} == {(1, "a", ""), (1, "?", "n")}


def test_durations(spark):
    df = spark.createDataFrame([("01:02:03",), ("5:07",), ("42",), ("1:99",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(records.seconds_of("t")).collect()] == [3723.0, 307.0, 42.0, None, None, None]


def test_violations(spark):
    rows = [("g", "R1", "H1", "warn", "a", 1), ("g", "R1", "H1", "error", "b", 2), ("g", "R2", None, "warn", "c", 3), ("g", "R3", "H2", "error", "d", 4), ("g", "R3", "H2", "error", "e", 5)]
    df = spark.createDataFrame(rows, "run string, rule string, subject string, severity string, message string, position int")
    (r,) = state.shown(df, "run").collect()
    assert (r["head"], r["digest"]) == ("R1 b\nR3 d", "+1 more: R2()")
    assert {(r["subject"], r["n_repeats"]) for r in state.escalated(df.withColumn("round", F.col("position")), "round").collect()} == {("H2", 2)}


def test_questions_are_resolved_once(spark):
    df = spark.createDataFrame([("q1", "pending", 1), ("q1", "timeout", 2), ("q1", "answered", 3), ("q2", "pending", 4)], "id string, status string, at int")
    assert {tuple(r) for r in state.first_resolution(df, "id", "status", "at").collect()} == {("q1", "timeout", 1, 2), ("q2", "pending", 4, None)}


def test_paper_keys(spark):
    df = spark.createDataFrame([("10.1/a", "2301.1v3", "A title of more than twenty letters"), ("10.48550/arxiv.1", None, "short"), (None, "", None)], "doi string, arxiv string, title string")
    assert [r[0] for r in df.select(state.paper_keys("doi", "arxiv", "title")).collect()] == [["doi:10.1/a", "arxiv:2301.1", "title:atitleofmorethantwentyletters"], [], []]


def test_short_passages_have_holders_too(spark):
    """Passages of one word, parts of words, empty and null ones, and long ones with words cut at their ends."""
    text = "the quick brown fox jumps over the lazy dog and then it sleeps\nunder a tree for some hours"
    docs = spark.createDataFrame([(1, text), (2, "a tree"), (3, None), (4, ""), (5, "xtreex " + text.upper())], "k int, text string")
    passages = [(1, "tree"), (2, "quick brown"), (3, text[2:80]), (4, ""), (5, None), (6, "absent"), (7, "dog and then it sleeps\nunder a tree for so"), (8, text), (9, "tree")]
    asked = spark.createDataFrame(passages, "q int, p string")
    want = {(q, k) for q, p in passages if p for k, t in ((1, text), (2, "a tree"), (5, "xtreex " + text.upper())) if p in t}
    got = [(r["q"], r["k"]) for r in retrieval.holders(docs, asked, "k", "text", "q", "p").collect()]
    assert {*got} == want and len(got) == len(want) and len(want) == 10
    assert retrieval.holders(docs, asked.limit(0), "k", "text", "q", "p").count() == 0


def test_mcnemar_of_many_discordant_pairs(spark):
    """One pass over the tail: exact integers' value to ten digits, and hundreds of thousands of pairs in seconds."""
    for a, b in ((480, 520), (0, 3), (7, 7), (24_700, 25_300)):
        term = total = 1
        for i in range(1, min(a, b) + 1):
            term = term * (a + b - i + 1) // i
            total += term
        pairs = spark.range(a + b).select((F.col("id") < a).alias("a"), (F.col("id") >= a).alias("b"))
        row = evalstats.mcnemar(pairs, "a", "b").first()
        assert (row["only_a"], row["only_b"]) == (a, b) and row["p_value"] == pytest.approx(float(min(Fraction(1), Fraction(2 * total, 2 ** (a + b)))), rel=1e-10)
    large = spark.range(1_000_000).select((F.col("id") < 499_000).alias("a"), (F.col("id") >= 499_000).alias("b"))
    assert evalstats.mcnemar(large, "a", "b").first()["p_value"] == pytest.approx(0.0456, abs=1e-4)


def test_classify_takes_ascii_words(spark):
    df = spark.createDataFrame([(1, "xé die"), (2, "dieé"), (3, "ädie x"), (4, "died"), (5, "die")], "k int, t string")
    got = {r["k"]: r["f"] for r in df.select("k", eventlog.classify(F.col("t"), [("syntax", r"\bdie\b")], "other").alias("f")).collect()}
    assert got == {1: "syntax", 2: "syntax", 3: "syntax", 4: "other", 5: "syntax"}


def test_status_numbers_are_whole_words(spark):
    df = spark.createDataFrame([("no such key D000429",), ("bad value D050391",), ("HTTP 429 for D000001",), ("status=503",), ("4290",), (None,)], "m string")
    assert [r[0] for r in df.select(documents.is_transient("m")).collect()] == [False, False, True, True, False, False]


def test_seeded_numbers_grow_past_their_width(spark):
    board = spark.createDataFrame([("M998", "a", "DONE")], "id string, key string, status string")
    defaults = spark.createDataFrame([(k, i) for i, k in enumerate("abcd")], "key string, position int")
    assert {(r["id"], r["key"]) for r in state.seeded(board, defaults).collect()} == {("M998", "a"), ("M999", "b"), ("M1000", "c"), ("M1001", "d")}


def test_tiers_work_each_step_out_once(spark):
    df = spark.createDataFrame([("a.b.red_widget", "x", "s", "b", "class", False)], "key string, owner string, summary string, body string, kind string, private boolean")
    out = symbols.tiered(df, "how do I use the red gadgets", {"gadgets": ("widget",)}, "key", "owner", "summary", "body", "kind", "private")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1


def test_a_closure_writes_each_pair_once(spark, monkeypatch):
    written = []
    store_ = graph.stored

    def counted(df, name):
        out = store_(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    edges = spark.range(6).selectExpr("id AS src", "id + 1 AS dst")
    assert graph.closure(edges).count() == 21 == sum(written)


def test_a_study_is_listed_by_folders_not_a_task_for_few_files(spark, tmp_path, monkeypatch):
    want = {}
    for path in ("top.md", "runs/x.txt", "runs/a/b.json", "runs/a/debug/c/d e.png", "other/deep/er/f.tex"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path * 3)
        want[path] = (len(path) * 3, (tmp_path / path).stat().st_mtime_ns // 1000)
    for path in ("_temporary/g.md", "runs/.hidden/h.md", "runs/a/_i.md", "runs/a/debug/.j"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / "runs/empty").mkdir()
    for folders in (256, 1):
        monkeypatch.setattr(files, "FOLDERS", folders, raising=False)
        found = files.study_files(spark, f"file://{tmp_path}")
        assert {r["path"]: (r["size"], r["at"]) for r in found.select("path", "size", F.unix_micros("modified").alias("at")).collect()} == want
        assert "binaryFile" not in found._jdf.queryExecution().toString()


def test_trees_of_contents_are_made_in_their_rows(spark):
    rnd = random.Random(15)
    parts = ['<topic title="t" href="h#f">', '<topic href="p">', "<topic>", "</topic>", "</topic>", '<topic title="a"/>', "<topical/>", "text"]
    docs = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30)))) for i in range(1500)] + [(1500, None), (1501, ""), (1502, "</topic><topic><topic/></topic>")]
    want = []
    for key, xml in docs:
        depth, node, levels = 0, 0, {}
        for t in re.findall(r"<topic\b[^>]*>|</topic>", xml or ""):
            if t == "</topic>":
                depth -= 1
                continue
            href = "h" if "#" in t else "p" if "href" in t else ""
            want.append((key, node, levels.get(depth - 1), depth, (re.findall('title="(.)', t) or [""])[0], href, "f" if "#" in t else None))
            levels[depth] = node
            node += 1
            depth += not t.endswith("/>")
    df = spark.createDataFrame(docs, "k long, x string").coalesce(2)
    found = documents.contents_tree(df, "k", "x")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and len(want) > 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window", "Join"))
    twice = documents.contents_tree(df.filter("k = 1502").union(df.filter("k = 1502")), "k", "x").collect()
    assert sorted((r["node"], r["parent"] is None) for r in twice) == [(0, True), (0, True), (1, False), (1, False)]


def test_contents_are_dealt_into_more_tasks_as_lines_grow(spark, monkeypatch):
    monkeypatch.setattr(document_jobs, "LINES", 500, raising=False)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert document_jobs.contents_tree(spark, DATA).rdd.getNumPartitions() == lines // 500 + 1
