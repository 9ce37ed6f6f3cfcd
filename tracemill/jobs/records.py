"""Queries over run summaries, text fields and registered evaluators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import records as op
from tracemill.sources.frames import CALLS_SQL, KEYS, LEDGER_SQL, calls, ledger, log, table


def kpi_row(spark, d):
    e = table(spark, d, "events")
    c = calls(spark, d).withColumnRenamed("delegation_id", "id")
    runs = e.select(F.format_string("D%06d", "user_id").alias("id")).distinct()
    sources = {
        "telemetry": (c, {"cost": F.sum("cost"), "calls": F.count("*")}),
        "log": (log(spark, d).filter("status = 'error'"), {"errors": F.count("*"), "cost": F.sum("value")}),
    }
    out = op.kpi_rows(runs, sources, "id", {"cost": ["telemetry_cost", "log_cost"]})
    return out.select("id", "telemetry_calls", "log_errors", F.round("cost", 4).alias("cost"))


def max_sequence_id(spark, d):
    return op.highest_number(ledger(spark, d), "_delegation_id")


def review_digest(spark, d):
    return op.digest(table(spark, d, "conversations"), "conv_id", "turn", "text", 3, 900).select("conv_id", "turn", "used")


def merged_ranks(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 300).alias("record"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("rank"))
    return op.merged_ranks(e, "record", "event_type", "rank")


def page_cut(spark, d):
    """Pages whose lines are headings."""
    page, dropped = op.cut_at_section(F.replace("text", F.lit("\n"), F.lit("\n## ")), 1200)
    return table(spark, d, "documents").select("doc_id", F.md5(page).alias("digest"), F.size(dropped).alias("n_dropped"), F.md5(F.array_join(dropped, "|")).alias("dropped"))


def duration_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", op.duration(F.col("o_custkey") * 13).alias("duration"))


def headline_check(spark, d):
    n = ledger(spark, d).filter("abs(price) < 1e8").groupBy("supp_id").agg(F.min("price").alias("low"), F.count("*").alias("n"))
    claims = n.withColumn("claim", F.col("low") * F.when(F.col("supp_id") % 3 == 0, 1.0005).when(F.col("supp_id") % 3 == 1, 1.01).otherwise(1.0))
    return claims.select("supp_id", op.agrees(F.col("claim"), F.col("low")).alias("agrees"))


def head_tail(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", op.head_and_tail(F.col("text"), 60).alias("short"))


def first_line(spark, d):
    return table(spark, d, "documents").select("doc_id", op.first_line(F.concat(F.lit("\n  \n"), F.col("text")), 80).alias("intent"))


def field_value(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat(F.lit("head\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("score: "), F.char_length("text"), F.lit(" \nend"))).otherwise(F.col("role")))
    return c.select("conv_id", "turn", op.field(text, "score").alias("score"))


def compound_claims(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat(F.lit("x rises "), F.when(F.col("turn") % 2 == 0, "5").otherwise("much"), F.lit(" and y falls "), F.when(F.col("conv_id") % 2 == 0, "by half").otherwise("2"))
    return c.select("conv_id", "turn", op.is_compound(text).alias("compound"))


def statement_dups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(op.statement_key("text")).alias("statement")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def terminal_state(spark, d):
    o = table(spark, d, "orders").withColumn("asked", F.when(F.col("o_orderstatus") == "F", "GATED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("?"))
    return o.select("o_orderkey", op.terminal_state("asked", F.col("o_custkey") % 5 == 0, F.col("o_orderkey") % 3 > 0).alias("state"))


def latest_run(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


def cache_lookup(spark, d):
    e = table(spark, d, "events").select(F.col("props").alias("key"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), "value")
    return op.within_ttl(e, "key", "at", F.lit(700), 600, "status")


def corpus_add(spark, d):
    t = table(spark, d, "documents")
    held = t.filter("doc_id % 3 = 0").select(F.md5("text").alias("paper"))
    return op.add_papers(held, t.select(F.md5("text").alias("paper"), "text"), "paper", "text", 500).select("paper", F.char_length("text").alias("n"))


def evidence_rows(spark, d):
    s = table(spark, d, "supplier").select(F.format_string("D%03d", "s_suppkey").alias("_delegation_id"), "s_name")
    return op.evidence(s, ledger(spark, d), "_delegation_id", "_namespace").withColumn("files", F.array_join("files", ","))


def _bowl(discount, tax):
    return {"bowl": (discount - 0.05) ** 2 + (tax - 0.04) ** 2}


def evaluator_door(spark, d):
    rows = ledger(spark, d).select(*KEYS, "discount", "tax")
    return op.evaluated(rows, _bowl, ["discount", "tax"], ["bowl"], "D900", "agent").select(*KEYS, F.round("bowl", 9).alias("bowl"), "_delegation_id", "_source", "status")


def fuzzy_title(spark, d):
    """Misspelt names of parts, sought among all names."""
    p = table(spark, d, "part")
    asked = p.select("p_partkey", F.concat(F.left("p_name", F.lit(3)), F.substring("p_name", 5, 40)).alias("query"))
    return op.close_titles(asked, p, "p_partkey", "query", "p_name", 3).withColumn("ratio", F.round("ratio", 6))


QUERIES = {f.__name__: f for f in (kpi_row, max_sequence_id, review_digest, merged_ranks, page_cut, duration_text, headline_check, head_tail, first_line, field_value, compound_claims, statement_dups, terminal_state, latest_run, cache_lookup, corpus_add, evidence_rows, evaluator_door, fuzzy_title)}

_L = f"WITH {LEDGER_SQL}"
SQL = {
    "kpi_row": f"WITH {CALLS_SQL}, t AS (SELECT delegation_id AS id, sum(cost) AS cost, count(*) AS calls FROM calls GROUP BY 1), g AS (SELECT id, count(*) AS errors, sum(value) AS cost FROM log WHERE status = 'error' GROUP BY 1), r AS (SELECT DISTINCT id FROM log) SELECT id, calls AS telemetry_calls, errors AS log_errors, round(coalesce(t.cost, g.cost), 4) AS cost FROM r LEFT JOIN t USING (id) LEFT JOIN g USING (id)",
    "max_sequence_id": f"{_L} SELECT max(TRY_CAST(regexp_extract(_delegation_id, '^D([0-9]+)$', 1) AS BIGINT)) AS highest FROM ledger",
    "review_digest": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), s AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used FROM n WHERE n <= 3) SELECT conv_id, turn, used FROM s WHERE used <= 900",
    "merged_ranks": "SELECT event_id % 300 AS record, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS best_rank, count(DISTINCT event_type) AS n_lists FROM events GROUP BY 1",
    "page_cut": r"""WITH h AS (SELECT doc_id, replace(text, chr(10), chr(10) || '## ') AS text FROM documents), l AS (SELECT *, instr(reverse(substring(text, 1, 1200)), ' ##' || chr(10)) AS b, length(substring(text, 1, 1200)) AS n FROM h), c AS (SELECT doc_id, text, CASE WHEN length(text) <= 1200 THEN length(text) WHEN b > 0 AND n - b - 3 >= 600 THEN n - b - 3 ELSE 1200 END AS cut FROM l),
        g AS (SELECT doc_id, left(text, cut) AS page, list_transform(list_filter(string_split(substring(text, cut + 1), chr(10)), lambda x: starts_with(x, '## ')), lambda x: trim(x[4:], ' ')) AS dropped FROM c) SELECT doc_id, md5(page) AS digest, len(dropped) AS n_dropped, md5(array_to_string(dropped, '|')) AS dropped FROM g""",
    "duration_text": "WITH s AS (SELECT o_orderkey, o_custkey * 13 AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 90 THEN s || 's' WHEN s < 5400 THEN (s // 60) || 'min' ELSE printf('%.1fh', (s // 360) / 10.0) END AS duration FROM s",
    "headline_check": f"{_L}, n AS (SELECT supp_id, min(price) AS low FROM ledger WHERE abs(price) < 1e8 GROUP BY 1) SELECT supp_id, supp_id % 3 <> 1 OR abs(low) < 1e-9 AS agrees FROM n",
    "head_tail": "SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 30) || ' [' || (length(text) - 60) || ' left out] ' || right(text, 30) END AS short FROM conversations",
    "first_line": "SELECT doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')[1], ' '), 80) AS intent FROM documents",
    "field_value": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS VARCHAR) ELSE '' END AS score FROM conversations",
    "compound_claims": "SELECT conv_id, turn, turn % 2 = 0 AND conv_id % 2 = 1 AS compound FROM conversations",
    "statement_dups": r"SELECT md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS statement, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "terminal_state": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 5 > 0 AND o_orderkey % 3 > 0 THEN 'GATED' WHEN o_orderstatus = 'O' THEN 'FAILED' ELSE 'UNGATED' END AS state FROM orders",
    "latest_run": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey AS latest FROM r WHERE n = 1",
    "cache_lookup": """WITH r AS (SELECT props AS "key", event_id AS "at", 200 AS status, value, row_number() OVER (PARTITION BY props ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error' AND 700 - event_id <= 600) SELECT "key", "at", status, value FROM r WHERE n = 1""",
    "corpus_add": "SELECT md5(text) AS paper, max(length(text)) AS n FROM documents WHERE length(text) > 500 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1",
    "evidence_rows": f"{_L}, r AS (SELECT _delegation_id, string_agg(DISTINCT _namespace, ',' ORDER BY _namespace) AS files FROM ledger GROUP BY 1) SELECT printf('D%03d', s_suppkey) AS _delegation_id, s_name, files FROM supplier LEFT JOIN r ON r._delegation_id = printf('D%03d', s_suppkey)",
    "evaluator_door": f"{_L} SELECT {', '.join(KEYS)}, round(pow(discount - 0.05, 2.0) + pow(tax - 0.04, 2.0), 9) AS bowl, 'D900' AS _delegation_id, 'agent' AS _source, 'FINISHED' AS status FROM ledger",
}
