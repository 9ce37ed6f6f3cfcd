"""Queries over milestones, questions, violations, contexts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.columns import token_estimate
from tracemill.functions.scratch import scratch
from tracemill.operators import evalstats, records, sinks, state as op
from tracemill.sources.frames import LOG_SQL, log, table


def _board(spark, d):
    s = table(spark, d, "supplier").filter("s_nationkey < 12")
    return s.select(F.format_string("M%03d", "s_suppkey").alias("id"), F.col("s_name").alias("key"), F.when(F.col("s_acctbal") < 0, "SKIPPED").otherwise("PENDING").alias("status"), F.lit(None).cast("string").alias("note"))


def milestone_seed(spark, d):
    defaults = table(spark, d, "supplier").select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("position"))
    return op.seeded(_board(spark, d), defaults).select("id", "key", "status")


def milestone_close(spark, d):
    v = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.format_string("M%03d", "s_suppkey").alias("id"), F.lit("DONE").alias("status"), F.col("s_name").alias("note"))
    return op.closed(_board(spark, d), v)


def milestone_list(spark, d):
    board = _board(spark, d).withColumn("id", F.regexp_replace("id", "^M0*", "M"))
    return op.listed(board, status="PENDING").select("id", "note", "position")


def question_state(spark, d):
    e = log(spark, d).select("id", "pos", F.when(F.col("status").isin("click", "view", "error"), F.col("status")).otherwise("pending").alias("status"))
    return op.first_resolution(e, "id", "status", "pos")


def annotate_last(spark, d):
    e = log(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "status", F.lit("").alias("note")))).alias("entries"))
    out = op.annotated(e, "entries", F.lit("seen"))
    return out.select("id", F.array_join(F.transform("entries", lambda x: F.concat(x["pos"].cast("string"), x["note"])), ",").alias("entries"))


def _violations(spark, d):
    severity = F.when(F.col("k") % 4 == 0, "error").otherwise("warn")
    return log(spark, d).select("id", F.upper("status").alias("rule"), F.when(F.col("k") % 6 > 0, F.concat(F.lit("H"), (F.col("k") % 6).cast("string"))).alias("subject"), severity.alias("severity"), F.concat(F.lit("at "), "pos").alias("message"), F.col("pos").alias("position"))


def violation_digest(spark, d):
    return op.shown(_violations(spark, d), "id")


def violation_escalate(spark, d):
    v = _violations(spark, d).withColumn("subject", F.concat_ws("/", "id", "subject")).withColumn("round", F.floor(F.col("position") / 20))
    return op.escalated(v, "round", rules=5, repeats=3)


def stall(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("at"))
    return op.stalled(e, "user_id", "at", F.lit(10_000).cast("long"), 1200)


def claim_readers(spark, d):
    """Two readers who take turns at orders as notes, each order delivered to one of them."""
    notes = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    place = scratch(spark, "claims")
    last = notes.agg(F.max("o_orderkey")).first()[0] or 0
    for turn in range(8):
        sinks.claim(notes, place, "ab"[turn % 2], "o_orderkey", last // 8 + 1)
    return sinks.claimed(notes, place, "o_orderkey")


def claim_once(spark, d):
    o = table(spark, d, "orders")
    return op.unclaimed(o.select("o_custkey"), o.filter("o_orderstatus = 'F'").select("o_custkey"), "o_custkey")


def context_plan(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", token_estimate("text").alias("cost"))
    return op.context_plan(c, "conv_id", "turn", "cost", "role", 160, result="assistant")


def section_body(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat(F.lit("line of "), "role", F.lit("\nand "), "turn")
    kind = F.col("turn") % 4
    text = F.when(kind == 0, F.concat(F.lit("intro\n## Findings (all)\n"), body, F.lit("\n## Next\nx"))).when(kind == 1, F.concat(F.lit("**Findings**\n"), body, F.lit("\n---\nx"))).when(kind == 2, F.concat(F.lit("Findings: "), body, F.lit("\n\nother"))).otherwise(F.concat(F.lit("## FindingsNotes\n"), body))
    return c.select("conv_id", "turn", op.section(text, "Findings").alias("body"))


def review_gaps(spark, d):
    """Reviews in JSON, one for each order: its lines are the elements; a third in fences, a third torn."""
    li = table(spark, d, "lineitem")
    element = F.struct(F.concat(F.lit("p"), "l_partkey").alias("element"), F.when(F.col("l_returnflag") == "R", "Gap").otherwise("ok").alias("status"), F.col("l_linestatus").alias("note"))
    r = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("json"))
    k = F.col("l_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Here it is:\n```json\n"), "json", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("Review "), "json", F.lit(" end"))).otherwise(F.left("json", F.char_length("json") - 5))
    return op.review_gaps(r.select("l_orderkey", text.alias("text")), "text")


def judge_reply(spark, d):
    c = table(spark, d, "conversations")
    k = F.col("turn") % 3
    text = F.when(k == 0, F.concat(F.lit("SUBSTANCE: FLAG\nCRITIQUE: "), "text")).when(k == 1, F.concat(F.lit("Substance: **OK**\nCRITIQUE: none "), "role")).otherwise(F.col("role"))
    flagged, critique = op.judged(text)
    return c.select("conv_id", "turn", flagged.alias("flagged"), F.md5(critique).alias("critique"))


def paper_keys(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.48550/arxiv."), "doc_id")).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/x"), "doc_id")).alias("doi"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A"), "doc_id", F.lit("v2"))).alias("arxiv"), F.substring("text", 1, 40).alias("title"))
    return t.select("doc_id", F.array_join(op.paper_keys("doi", "arxiv", "title"), "|").alias("keys"), op.best_id("arxiv", "doi", "doi").alias("best"))


def audience(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.split("p_name", " ")).alias("for_whom"))
    return op.for_audience(p, "for_whom", "red").select("p_partkey")


def dangling(spark, d):
    o = table(spark, d, "orders")
    h = o.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("delegations"))
    return op.dangling(h, "delegations", o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")), "o_custkey")


def verdict_tally(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return op.tally(t.select(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("verdict")), "verdict")


def status_splice(spark, d):
    """A status table between markers, made anew from the orders' states."""
    rows = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    text = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))), lambda r: F.concat(F.lit("| "), r["o_orderstatus"], F.lit(" | $"), r["n"].cast("string"), F.lit(" |"))), "\n").alias("rows"))  # one for each state
    return text.select(op.splice(F.lit("# Head\n<!-- a -->\nold\n<!-- b -->\ntail"), "<!-- a -->", "<!-- b -->", F.col("rows")).alias("document"))


def duration_parse(spark, d):
    s = F.col("o_custkey") * 13
    text = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).when(F.col("o_orderkey") % 3 == 1, s.cast("string")).otherwise(F.concat(s.cast("string"), F.lit(" min")))
    return table(spark, d, "orders").select("o_orderkey", records.seconds_of(text).alias("seconds"))


def last_completed(spark, d):
    return log(spark, d).filter("status = 'purchase'").groupBy("from_node").agg(F.max_by("id", "pos").alias("id"), F.max("pos").alias("pos"))


def peak_value(spark, d):
    return log(spark, d).groupBy("id").agg(F.max("value").alias("peak"), F.max_by("pos", F.struct("value", (-F.col("pos")).alias("p"))).alias("pos"))


def power_note(spark, d):
    g = table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("share"))
    return g.select("toxic", "n", F.round(evalstats.power_note(F.col("n"), F.col("share")), 9).alias("least"))


def lost_evidence(spark, d):
    lab = table(spark, d, "labels")
    out = evalstats.lost_evidence(lab.select("doc_id", F.col("quality").cast("double").alias("rr")), lab.select("doc_id", (1.0 - F.col("toxic")).alias("rr")), "doc_id", "rr")
    return out.withColumn("change", F.round("change", 9))


QUERIES = {f.__name__: f for f in (milestone_seed, milestone_close, milestone_list, question_state, annotate_last, violation_digest, violation_escalate, stall, claim_once, claim_readers, context_plan, section_body, review_gaps, judge_reply, paper_keys, audience, dangling, verdict_tally, status_splice, duration_parse, last_completed, peak_value, power_note, lost_evidence)}

_B = "b AS (SELECT printf('M%03d', s_suppkey) AS id, s_name AS key, CASE WHEN s_acctbal < 0 THEN 'SKIPPED' ELSE 'PENDING' END AS status, CAST(NULL AS VARCHAR) AS note, s_suppkey, s_acctbal FROM supplier WHERE s_nationkey < 12)"
_V = f"{LOG_SQL}, v AS (SELECT id, upper(status) AS rule, CASE WHEN k % 6 > 0 THEN 'H' || (k % 6) END AS subject, CASE WHEN k % 4 = 0 THEN 'error' ELSE 'warn' END AS severity, 'at ' || pos AS message, pos AS position FROM log)"
SQL = {
    "milestone_seed": f"WITH {_B}, t AS (SELECT max(s_suppkey) AS top FROM b) SELECT id, key, status FROM b UNION ALL SELECT printf('M%03d', top + row_number() OVER (ORDER BY s.s_suppkey)), s_name, 'PENDING' FROM supplier s, t WHERE s_name NOT IN (SELECT key FROM b)",
    "milestone_close": f"WITH {_B} SELECT id, key, CASE WHEN s_acctbal > 5000 THEN 'DONE' ELSE status END AS status, CASE WHEN s_acctbal > 5000 THEN key END AS note FROM b",
    "milestone_list": f"WITH {_B} SELECT 'M' || s_suppkey AS id, '' AS note, row_number() OVER (ORDER BY s_suppkey) AS position FROM b WHERE status = 'PENDING'",
    "question_state": f"WITH {LOG_SQL} SELECT id, coalesce(arg_min(status, pos) FILTER (WHERE status IN ('click', 'view', 'error')), 'pending') AS status, min(pos) AS asked, min(pos) FILTER (WHERE status IN ('click', 'view', 'error')) AS resolved FROM log GROUP BY 1",
    "annotate_last": f"WITH {LOG_SQL}, m AS (SELECT id, pos, pos = max(pos) OVER (PARTITION BY id) AS last FROM log) SELECT id, string_agg(pos || CASE WHEN last THEN 'seen' ELSE '' END, ',' ORDER BY pos) AS entries FROM m GROUP BY 1",
    "violation_digest": f"WITH {_V}, f AS (SELECT *, row_number() OVER (PARTITION BY id, rule, subject ORDER BY severity <> 'error', position) AS i FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY severity <> 'error', position) AS n FROM f WHERE i = 1) SELECT id, string_agg(rule || ' ' || message, chr(10) ORDER BY n) FILTER (WHERE n <= 2) AS head, CASE WHEN max(n) > 2 THEN '+' || (max(n) - 2) || ' more: ' || string_agg(rule || '(' || coalesce(subject, '') || ')', ', ' ORDER BY n) FILTER (WHERE n > 2) END AS digest FROM r GROUP BY 1",
    "violation_escalate": f"WITH {_V}, s AS (SELECT id || '/' || subject AS subject, rule, severity, position // 20 AS round FROM v WHERE subject IS NOT NULL UNION ALL SELECT id, rule, severity, position // 20 FROM v WHERE subject IS NULL), b AS (SELECT subject, count(DISTINCT rule) AS n_rules FROM s GROUP BY 1), e AS (SELECT DISTINCT subject, rule, round FROM s WHERE severity = 'error'), g AS (SELECT subject, rule, round - row_number() OVER (PARTITION BY subject, rule ORDER BY round) AS run FROM e), l AS (SELECT subject, max(n) AS n_repeats FROM (SELECT subject, rule, run, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1) SELECT subject, n_rules, coalesce(n_repeats, 0) AS n_repeats FROM b LEFT JOIN l USING (subject) WHERE n_rules >= 5 OR coalesce(n_repeats, 0) >= 3",
    "stall": "SELECT user_id, greatest(10000 - max(event_id), 0) AS idle, 10000 - max(event_id) > 1200 AS stalled FROM events GROUP BY 1",
    "claim_readers": """WITH o AS (SELECT min(o_orderkey) AS low, max(o_orderkey) // 8 + 1 AS step FROM orders) SELECT o_orderkey, o_custkey, CASE (o_orderkey - low) // step % 2 WHEN 0 THEN 'a' ELSE 'b' END AS reader FROM orders, o""",
    "claim_once": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "context_plan": """WITH c AS (SELECT conv_id, turn, role, length(text) // 3 + 4 AS cost FROM conversations), h AS (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS h FROM c), p AS (SELECT *, coalesce(turn = h, false) AS is_head FROM h),
        u AS (SELECT *, coalesce(max(cost) FILTER (WHERE is_head) OVER (PARTITION BY conv_id), 0) AS spent, sum(CASE WHEN is_head THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM p), o AS (SELECT *, bool_or(NOT is_head AND spent + used > 80) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS over FROM u),
        f AS (SELECT *, NOT is_head AND NOT over AS fits FROM o), t AS (SELECT *, min(turn) FILTER (WHERE fits AND role <> 'assistant') OVER (PARTITION BY conv_id) AS opens FROM f) SELECT conv_id, turn, role, cost, CASE WHEN is_head THEN 'head' WHEN fits AND turn >= opens THEN 'tail' ELSE 'span' END AS part FROM t""",
    "section_body": "SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN 'line of ' || role || chr(10) || 'and ' || turn ELSE '' END AS body FROM conversations",
    "review_gaps": "SELECT l_orderkey, 'p' || l_partkey AS element, l_linestatus AS note FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3 < 2",
    "judge_reply": r"SELECT conv_id, turn, turn % 3 = 0 AS flagged, md5(CASE turn % 3 WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN 1 THEN '' ELSE role END) AS critique FROM conversations",
    "paper_keys": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '10.48550/arxiv.' || doc_id WHEN doc_id % 3 = 0 THEN '10.1/x' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN 'A' || doc_id || 'v2' END AS arxiv, regexp_replace(lower(substring(text, 1, 40)), '[^a-z0-9]', '', 'g') AS t FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 > 0 THEN 'doi:' || doi END, CASE WHEN arxiv IS NOT NULL THEN 'arxiv:a' || doc_id END, CASE WHEN length(t) > 20 THEN 'title:' || t END], lambda x: x IS NOT NULL), '|') AS keys, CASE WHEN arxiv IS NOT NULL THEN 'A' || doc_id ELSE coalesce(doi, '') END AS best FROM t",
    "audience": "SELECT p_partkey FROM part WHERE p_size <= 10 OR list_contains(string_split(p_name, ' '), 'red')",
    "dangling": "SELECT o_custkey, o_orderkey AS delegation FROM orders WHERE o_orderstatus = 'O'",
    "verdict_tally": "SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' ELSE 'unchecked' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "status_splice": "WITH r AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) SELECT '# Head' || chr(10) || '<!-- a -->' || chr(10) || string_agg('| ' || s || ' | $' || n || ' |', chr(10) ORDER BY s) || chr(10) || '<!-- b -->' || chr(10) || 'tail' AS document FROM r",
    "duration_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey * 13 AS DOUBLE) END AS seconds FROM orders",
    "last_completed": f"WITH {LOG_SQL} SELECT from_node, arg_max(id, pos) AS id, max(pos) AS pos FROM log WHERE status = 'purchase' GROUP BY 1",
    "peak_value": f"WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, pos) AS n FROM log) SELECT id, value AS peak, pos FROM r WHERE n = 1",
    "power_note": "SELECT toxic, count(*) AS n, round(2.8016 * sqrt(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) / count(*)), 9) AS least FROM labels GROUP BY 1",
    "lost_evidence": "SELECT count(*) AS n, count(*) FILTER (WHERE quality > 0 AND toxic = 1) AS lost, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS gained, round(avg(1.0 - toxic - quality), 9) AS change FROM labels",
}
