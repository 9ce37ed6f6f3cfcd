"""Queries over event logs, telemetry and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.columns import token_estimate as estimate
from tracemill.operators import eventlog as op
from tracemill.sources.frames import CALLS_SQL, LEDGER_SQL, LOG_SQL, calls, ledger, log, table

FAULTS = [("timeout", r"\b(anhend|ands)\b"), ("memory", r"\bther\w*"), ("syntax", r"\bdie\b")]


def jsonl_tolerant(spark, d):
    e = table(spark, d, "events")
    lines = e.select("event_id", F.when(F.col("event_id") % 10 == 0, "{not json").when(F.col("event_id") % 10 == 1, "  ").otherwise(F.col("props")).alias("value"))
    return op.parse_jsonl(lines, "k long")


def lww_collapse(spark, d):
    return op.collapse(log(spark, d)).select("id", "pos", "status", "from_node", "to_node", "value", "k")


def lww_patch(spark, d):
    rows = log(spark, d)
    patches = rows.filter("status = 'signup'").select("id", "pos", F.concat(F.lit("H"), F.col("k") % 9).alias("hypothesis"), F.when(F.col("k") % 3 == 0, F.col("k")).alias("k"))
    out = op.patched(rows.filter("status <> 'signup'"), patches, "hypothesis", ["k"])
    return out.select("id", "pos", "status", "k", F.array_join("hypothesiss", ",").alias("hypotheses"))


def status_current(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("n"))
    entry = F.struct(F.col("turn").alias("ts"), F.col("role").alias("status"), F.when(F.col("n") % 3 == 0, F.col("n") / 1000).alias("posterior"))
    nested = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("status_log")).withColumn("prior", F.lit(0.5))
    return op.current_status(nested, "status_log", "prior")


def log_received(spark, d):
    return op.received(log(spark, d), "N3", 30, "view").select("id", "pos", "status", "from_node")


def telemetry_rollup(spark, d):
    return op.rollup(calls(spark, d), ["role", "phase", "model"]).withColumn("cost", F.round("cost", 4))


def vitals(spark, d):
    return op.vitals(calls(spark, d)).withColumn("cost", F.round("cost", 4))


def cost_compute(spark, d):
    prices = spark.createDataFrame([("m0", 3.0, 15.0), ("m1", 0.25, 1.25)], "price_model string, input_price double, output_price double")
    return op.with_costs(calls(spark, d), prices).select("call_id", "base_model", F.round("computed_cost", 9).alias("computed_cost"))


def diag_histogram(spark, d):
    e = table(spark, d, "events")
    kinds = [F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("user_id") % 4)), F.when(F.col("event_type") == "view", F.lit("")), F.when(F.col("event_type") == "click", F.lit("click"))]
    return op.histogram(e, kinds, "other")


def status_pivot(spark, d):
    return op.status_pivot(log(spark, d), ["from_node"], "status", ["click", "view", "error"])


def kpi_vs_prev(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return op.change_from_previous(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", F.round("delta", 2).alias("delta"))


def progress_delta(spark, d):
    daily = log(spark, d).groupBy("id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    so_far = daily.withColumn("so_far", F.sum("n").over(Window.partitionBy("id").orderBy("day")))
    return op.change_from_previous(so_far, ["id"], ["day"], "so_far").select("id", F.col("day").cast("string").alias("day"), "so_far", "delta")


def event_gap(spark, d):
    return op.gaps(log(spark, d), "id", "ts", "pos").select("pos", "id", "gap_us")


def transcript_proxies(spark, d):
    return op.proxies(log(spark, d), "id", F.col("status") == "error", "props", "ts", "pos")


def call_result_align(spark, d):
    return op.align_calls(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", "text")


def context_trim(spark, d):
    return op.trim_context(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", 400).select("conv_id", "turn", "role", "tokens")


def token_estimate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", estimate("text").alias("tokens"))


def split_notices(spark, d):
    c = table(spark, d, "conversations")
    marked = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<notice>"), F.col("role"), F.lit("</notice> "), F.col("text"), F.lit(" <notice>b</notice>"))).otherwise(F.col("text")).alias("t"))
    return op.split_notices(marked, "t").select("conv_id", "turn", F.array_join("notices", "|").alias("notices"), "rest")


def classify_fault(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", op.classify(F.lower("text"), FAULTS, "other").alias("fault"))


def unledgered(spark, d):
    rows = ledger(spark, d).withColumn("_delegation_id", F.format_string("D%06d", F.col("supp_id") * 2))
    return op.unledgered(log(spark, d), rows, ["N1"], "click").select("id", "pos", "k", "from_node")


def ordered_distinct(spark, d):
    return op.ordered_distinct(log(spark, d), "props", "pos")


def natural_sort(spark, d):
    names = table(spark, d, "customer").select(F.concat(F.substring("c_mktsegment", 1, 1), F.col("c_custkey") % 100, F.lit("-"), F.col("c_custkey")).alias("name"))
    return op.natural_first(names, "name", 60)


def next_ids(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return op.allocate_ids(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey"), c, "nation", "c_custkey", ["s_suppkey"], "M%08d")


def total_or_unknown(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("v"))
    return op.total_or_unknown(nations, rows, "nation", "v").withColumn("total", F.round("total", 2))


def clamp(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", op.reply_cap((F.col("o_custkey") % 5 - 1) * F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(100), F.col("o_totalprice")).cast("long").alias("cap"))


def missing_parts(spark, d):
    return op.missing_parts(table(spark, d, "conversations"), "conv_id", "role", ["system", "user", "assistant", "tool"])


def identity_rank(spark, d):
    n = table(spark, d, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    return n.select("n_nationkey", "n_regionkey", (F.when(F.col("n_nationkey") == 0, -1).otherwise(F.row_number().over(w) - 1)).alias("identity"))


def held_vs_declared(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("declared"), F.countDistinct(F.when(F.col("n_chars") > 1000, F.col("doc_id"))).alias("held"))


QUERIES = {f.__name__: f for f in (jsonl_tolerant, lww_collapse, lww_patch, status_current, log_received, telemetry_rollup, vitals, cost_compute, diag_histogram, status_pivot, kpi_vs_prev, progress_delta, event_gap, transcript_proxies, call_result_align, context_trim, token_estimate, split_notices, classify_fault, unledgered, ordered_distinct, natural_sort, next_ids, total_or_unknown, clamp, missing_parts, identity_rank, held_vs_declared)}

_LOG, _CALLS = f"WITH {LOG_SQL}", f"WITH {CALLS_SQL}"
_SUMS = "count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(sum(cost), 4) AS cost, count(cost) AS cost_calls FROM calls"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS n FROM log {}) WHERE n = 1)"
_EST = "CAST(floor(length(coalesce(text, '')) / 3) AS BIGINT) + 4"
SQL = {
    "jsonl_tolerant": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 > 1",
    "lww_collapse": f"{_LOG} SELECT id, pos, status, from_node, to_node, value, k FROM {_LAST.format('')}",
    "lww_patch": f"""{_LOG}, b AS {_LAST.format("WHERE status <> 'signup'")}, p AS (SELECT id, pos, 'H' || CAST(k % 9 AS VARCHAR) AS h, CASE WHEN k % 3 = 0 THEN k END AS k FROM log WHERE status = 'signup'),
        f AS (SELECT id, h, min(pos) AS pos FROM p GROUP BY 1, 2), l AS (SELECT id, string_agg(h, ',' ORDER BY pos) AS hypotheses FROM f GROUP BY 1), o AS (SELECT id, max_by(k, pos) FILTER (WHERE k IS NOT NULL) AS k FROM p GROUP BY 1)
        SELECT b.id, b.pos, b.status, coalesce(o.k, b.k) AS k, coalesce(hypotheses, '') AS hypotheses FROM b LEFT JOIN l USING (id) LEFT JOIN o USING (id)""",
    "status_current": "SELECT conv_id, max_by(role, turn) AS status, min(turn) AS first_ts, max(turn) AS last_ts, coalesce(max_by(length(text) / 1000.0::DOUBLE, turn) FILTER (WHERE length(text) % 3 = 0), 0.5) AS belief FROM conversations GROUP BY 1",
    "log_received": f"{_LOG} SELECT id, pos, status, from_node FROM log WHERE to_node = 'N3' AND status <> 'view' ORDER BY pos DESC LIMIT 30",
    "telemetry_rollup": f"{_CALLS} SELECT 'total' AS grouped_by, '' AS value, {_SUMS} UNION ALL SELECT 'role', role, {_SUMS} GROUP BY role UNION ALL SELECT 'phase', phase, {_SUMS} GROUP BY phase UNION ALL SELECT 'model', model, {_SUMS} GROUP BY model",
    "vitals": f"{_CALLS} SELECT round(coalesce(sum(cost), 0), 4) AS cost, count(*) AS calls, count(*) FILTER (WHERE cost IS NULL) AS unknown_cost_calls, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS tokens, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS span_s FROM calls",
    "cost_compute": f"""{_CALLS}, p(price_model, a, b) AS (VALUES ('m0', 3.0, 15.0), ('m1', 0.25, 1.25)) SELECT call_id, regexp_replace(model, '-[0-9]{{8}}$', '') AS base_model, round((input_tokens * CAST(a AS DOUBLE) + output_tokens * CAST(b AS DOUBLE)) / 1e6, 9) AS computed_cost FROM calls LEFT JOIN p ON price_model = regexp_replace(model, '-[0-9]{{8}}$', '')""",
    "diag_histogram": "SELECT CASE event_type WHEN 'error' THEN 'E' || CAST(user_id % 4 AS VARCHAR) WHEN 'click' THEN 'click' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "status_pivot": f"{_LOG} SELECT from_node, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("click", "view", "error")) + " FROM log GROUP BY 1",
    "kpi_vs_prev": "SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS delta FROM orders",
    "progress_delta": f"{_LOG}, a AS (SELECT id, CAST(ts AS DATE) AS day, count(*) AS n FROM log GROUP BY 1, 2), s AS (SELECT id, day, CAST(sum(n) OVER (PARTITION BY id ORDER BY day) AS BIGINT) AS so_far FROM a) SELECT id, CAST(day AS VARCHAR) AS day, so_far, so_far - lag(so_far) OVER (PARTITION BY id ORDER BY day) AS delta FROM s",
    "event_gap": f"{_LOG} SELECT pos, id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY id ORDER BY pos) AS gap_us FROM log",
    "transcript_proxies": f"""{_LOG}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY id ORDER BY pos) AS gap FROM log), s AS (SELECT id, count(*) FILTER (WHERE status = 'error') AS n_errors, max(gap) AS max_gap_us FROM g GROUP BY 1),
        f AS (SELECT id, substring(props, 1, 80) AS m, min(pos) AS p FROM log WHERE status = 'error' GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM f), l AS (SELECT id, string_agg(m, ' / ' ORDER BY p) AS messages FROM t WHERE n <= 2 GROUP BY 1)
        SELECT id, n_errors, max_gap_us, messages FROM s LEFT JOIN l USING (id)""",
    "call_result_align": """WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn AS call_at, text AS call FROM conversations WHERE role = 'user'),
        r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn AS result_at, text AS result FROM conversations WHERE role = 'assistant') SELECT conv_id, n, call_at, call, result_at, result FROM c LEFT JOIN r USING (conv_id, n)""",
    "context_trim": f"""WITH c AS (SELECT *, {_EST} AS tokens, coalesce(turn = min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id), false) AS pin FROM conversations),
        s AS (SELECT *, sum(CASE WHEN pin THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent, max(CASE WHEN pin THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS held FROM c) SELECT conv_id, turn, role, tokens FROM s WHERE pin OR spent + held <= 400""",
    "token_estimate": f"SELECT conv_id, turn, {_EST} AS tokens FROM conversations",
    "split_notices": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || '|b' ELSE '' END AS notices, CASE WHEN turn % 2 = 0 THEN trim(' ' || text || ' ', ' ') ELSE trim(text, ' ') END AS rest FROM conversations",
    "classify_fault": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in FAULTS) + " ELSE 'other' END AS fault FROM conversations",
    "unledgered": f"WITH {LEDGER_SQL}, {LOG_SQL} SELECT id, pos, k, from_node FROM {_LAST.format('')} WHERE status = 'click' AND k > 0 AND from_node <> 'N1' AND id NOT IN (SELECT printf('D%06d', supp_id * 2) FROM ledger)",
    "ordered_distinct": f"{_LOG} SELECT props, min(pos) AS first_pos FROM log GROUP BY 1",
    "natural_sort": "SELECT substring(c_mktsegment, 1, 1) || c_custkey % 100 || '-' || c_custkey AS name FROM customer ORDER BY substring(c_mktsegment, 1, 1), c_custkey % 100, c_custkey LIMIT 60",
    "next_ids": "WITH m AS (SELECT c_nationkey AS nation, max(c_custkey) AS m FROM customer GROUP BY 1) SELECT s_nationkey AS nation, s_suppkey, printf('M%08d', coalesce(m, 0) + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS new_id FROM supplier LEFT JOIN m ON nation = s_nationkey",
    "total_or_unknown": "WITH t AS (SELECT s_nationkey AS nation, coalesce(sum(CASE WHEN s_acctbal > 0 THEN s_acctbal END), 0.0) AS total FROM supplier GROUP BY 1) SELECT n_nationkey AS nation, round(total, 2) AS total FROM nation LEFT JOIN t ON nation = n_nationkey",
    "clamp": "WITH o AS (SELECT *, (o_custkey % 5 - 1) * CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 100 END AS e FROM orders) SELECT o_orderkey, CASE WHEN e > 0 THEN e WHEN e < 0 THEN NULL ELSE CAST(least(greatest(floor(o_totalprice * 0.25), 512), 65536) AS BIGINT) END AS cap FROM o",
    "missing_parts": "WITH q(p, i) AS (VALUES ('system', 1), ('user', 2), ('assistant', 3), ('tool', 4)), c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, coalesce(string_agg(p, ',' ORDER BY i) FILTER (WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = p)), '') AS missing FROM c, q GROUP BY 1",
    "identity_rank": "SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey = 0 THEN -1 ELSE row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 END AS identity FROM nation",
    "held_vs_declared": "SELECT source, count(DISTINCT doc_id) AS declared, count(DISTINCT CASE WHEN n_chars > 1000 THEN doc_id END) AS held FROM documents GROUP BY 1",
}
