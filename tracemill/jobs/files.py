"""Queries over files and sinks: what is read is first written from the supplied tables, in the folder that all executors share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tracemill.functions.scratch import scratch
from tracemill.functions.shipping import ship
from tracemill.operators import ledger as led, sinks
from tracemill.operators.eventlog import parse_jsonl
from tracemill.sources import files as op
from tracemill.sources.frames import CALLS_SQL, KEYS, LEDGER_SQL, LOG_SQL, calls, ledger, log, table
from tracemill.sources.tail import opened, tail_jsonl
from tracemill.streaming import keyed, monitors

_TYPES = {**{k: "long" for k in KEYS}, "quantity": "double", "discount": "double", "tax": "double", "price": "double"}


def _csv(df, path):
    df.write.option("header", True).option("escape", '"').csv(path)


def csv_ledger(spark, d):
    """A CSV store whose notes hold quotes and line feeds."""
    path = scratch(spark, "csv")
    rows = ledger(spark, d).withColumn("note", F.concat(F.lit('of "'), "_namespace", F.lit('",\nline '), "line_no"))
    _csv(rows.select(*KEYS, "quantity", "price", "_delegation_id", "note"), f"{path}/output.csv")
    return op.scan_csv(spark, f"{path}/output.csv", _TYPES)


def store_glob(spark, d):
    """Three stores of different columns, found below a root."""
    root = scratch(spark, "stores")
    rows = ledger(spark, d)
    for name, columns, folder in (("A", ["quantity", "price"], ""), ("N", ["price", "quantity", "discount"], "/N"), ("R", ["tax", "price"], "/R")):
        _csv(rows.filter(F.col("_namespace") == name).select(*KEYS, *columns), f"{root}{folder}/{op.STORE_FILE}")
    return op.scan_stores(spark, root, _TYPES).select(*KEYS, "quantity", "discount", "tax", "price", "_namespace")


def namespace_evals(spark, d):
    """Evaluations of each namespace, over all stores below a root."""
    root = scratch(spark, "stores")
    rows = ledger(spark, d)
    for name, folder in (("A", ""), ("N", "/N"), ("R", "/R")):
        _csv(rows.filter(F.col("_namespace") == name).select(*KEYS, "_delegation_id"), f"{root}{folder}/{op.STORE_FILE}")
    return led.real(op.scan_stores(spark, root, _TYPES)).groupBy("_namespace").agg(F.count("*").alias("n_evals"))


def namespace_listing(spark, d):
    """Namespaces of 25 nations' stores, and those that a configuration names beside them."""
    root = scratch(spark, "stores")
    s = table(spark, d, "supplier").withColumn("order_id", F.col("s_suppkey"))
    for (at,) in table(spark, d, "nation").select(F.concat(F.lit("n "), "n_nationkey")).orderBy("n_nationkey").collect():  # 25 rows
        s.filter(F.concat(F.lit("n "), "s_nationkey") == at).select("order_id", "s_name").coalesce(1).write.option("header", True).csv(f"{root}/{at}/{op.STORE_FILE}")
    named = table(spark, d, "region").select(F.concat(F.lit("n "), F.col("r_regionkey") * 6 + 7).alias("_namespace"))
    return op.namespaces(op.scan_stores(spark, root, {"order_id": "long"}), named)


def jsonl_union(spark, d):
    """Telemetry of four processes, a file of JSON lines for each, with blank and torn lines among them."""
    root = scratch(spark, "telemetry")
    c = calls(spark, d)
    line = F.to_json(F.struct("call_id", "role", "model", "input_tokens", "cost"))
    torn = F.when(F.col("call_id") % 7 == 0, F.left(line, F.lit(20))).when(F.col("call_id") % 11 == 0, F.lit("")).otherwise(line)
    for pid in range(4):
        c.filter(F.col("call_id") % 4 == pid).select(torn.alias("value")).write.text(f"{root}/calls.{pid}.jsonl")
    return op.scan_jsonl(spark, f"{root}/calls.*.jsonl", "call_id long, role string, model string, input_tokens long, cost double", "pid")


def _grow(rows, root, cut):
    """Log files under a root (columns log, at and value) as they are when what is before `cut` has been written and the line behind it by half."""
    def run(batches):
        system, top = opened(root)
        system.create_dir(top)
        now = out = None
        for batch in batches:
            for log, at, value in zip(*(c.to_pylist() for c in batch.columns)):
                if log != now:
                    if out:
                        out.close()
                        system.move(f"{top}/.{now}", f"{top}/{now}.jsonl")
                    now, out = log, system.open_output_stream(f"{top}/.{log}")
                if at < cut:
                    out.write(value.encode() + b"\n")
                elif not out.closed:
                    out.write(value.encode()[:9])
                    out.close()
        if now is not None:
            out.close()
            system.move(f"{top}/.{now}", f"{top}/{now}.jsonl")
        yield pa.RecordBatch.from_pydict({"n": pa.array([0])})

    rows.repartition("log").sortWithinPartitions("log", "at").select("log", "at", "value").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


#: Lines of a log file; a longer log is dealt over files, each written by one task.
LINES = 500_000


def _dealt(rows):
    """Logs (columns log, at and value) over files of about LINES lines, all of which grow."""
    files = rows.count() // LINES + 1
    return rows.withColumn("log", F.concat("log", F.lit("."), F.pmod(F.xxhash64("at"), F.lit(files))))


def _tailed(spark, logs, last, build, name, n=3):
    """Lets logs grow in steps; after each the stream that build() makes of their root goes on from its checkpoint."""
    ship(spark)
    place = scratch(spark, name)
    logs = {sub: _dealt(rows) for sub, rows in logs.items()}
    for i in range(n):
        for sub, rows in logs.items():
            _grow(rows, f"{place}/{sub}", (last + 1) * (i + 1) // n)
        out = monitors.run(build(place), name, place=f"{place}/run")
    return out


def jsonl_tail(spark, d):
    """Events that growing files of JSON lines gain, four or more, their last line torn until it is whole."""
    e = table(spark, d, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    logs = e.select(F.concat(F.lit("events."), (F.col("user_id") % 4).cast("string")).alias("log"), F.col("event_id").alias("at"), line.alias("value"))
    build = lambda place: parse_jsonl(tail_jsonl(spark, f"{place}/in/events.*.jsonl", range_bytes=1 << 18), "event_id long, user_id long, event_type string, value double").drop("file", "at")
    return _tailed(spark, {"in": logs}, _last(e, "event_id"), build, "tail")


def _last(df, column):
    return df.agg(F.max(column)).first()[0] or 0


def live_fan_in(spark, d):
    """One stream of a run's delegations, diagnostics and status, each a growing log: changed delegations, all diagnostics, a status once."""
    r = log(spark, d)
    session = F.expr("k div 40").alias("session_started_at")
    of = lambda name, rows, *columns: rows.select(F.lit(name).alias("log"), F.col("pos").alias("at"), F.to_json(F.struct(*columns)).alias("value"))
    logs = {
        "delegations": of("log", r.filter("pos % 5 > 0"), "id", "pos", "status", session, F.col("to_node").alias("payload")),
        "diagnostics": of("log", r.filter("pos % 5 = 0"), "pos", F.col("id").alias("payload")),
        "statuses": of("log", r.filter("pos % 50 = 0"), F.col("from_node").alias("run"), "pos", "status"),
    }
    schemas = {"delegations": "id string, pos long, status string, session_started_at long, payload string", "diagnostics": "pos long, payload string", "statuses": "run string, pos long, status string"}
    build = lambda place: keyed.fan_in(*[parse_jsonl(tail_jsonl(spark, f"{place}/{k}/*.jsonl"), schemas[k]) for k in logs])
    return _tailed(spark, logs, _last(r, "pos"), build, "fan-in", 2)


def newest_first(spark, d):
    return op.newest(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")


def object_entries(spark, d):
    """A JSON document for each user, an object of its events; one in ten is torn."""
    e = log(spark, d)
    entry = F.struct(F.concat(F.lit("e"), "pos").alias("key"), F.struct("status", "k").alias("value"))
    docs = e.groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))
    torn = docs.withColumn("text", F.when(F.substring("id", -1, 1) == "0", F.left("text", F.lit(15))).otherwise(F.col("text")))
    return op.entries(torn, "text", "status: string, k: long")


def strict_ledger(spark, d):
    lines = log(spark, d).select(F.to_json(F.struct("id", "pos", "status", "value")).alias("line"))
    return op.strict(lines, "line", "id string, pos long, status string, value double")


def front_matter(spark, d):
    """Markdown of documents, every second one with a block in front."""
    t = table(spark, d, "documents")
    head = F.concat(F.lit("---\nid: d"), "doc_id", F.lit("\nlang: "), "lang", F.lit("\ntags: ["), "source", F.lit(", text]\nlang: xx\n---\n"))
    docs = t.select(F.concat(F.lit("file"), "doc_id").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.concat(head, "text")).otherwise(F.col("text")).alias("text"))
    out = op.front_matter(docs, "text", "name")
    return out.select("name", "id", F.col("fields")["lang"].alias("lang"), F.array_join(op.list_of(F.col("fields")["tags"]), "|").alias("tags"), F.md5("body").alias("body"))


def commit_files(spark, d):
    """Logs of commits and their files, one for each customer: an order is a commit of its parts."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    heads = o.select("o_custkey", (F.col("o_orderkey") * 10).alias("pos"), F.concat(F.lit("commit "), F.lower(F.hex("o_orderkey"))).alias("line"))
    names = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", (F.col("l_orderkey") * 10 + 1).alias("pos"), F.concat(F.lit("part/"), "l_partkey").alias("line"))
    out = op.commit_files(heads.unionByName(names), "line", "o_custkey", "pos")
    return out.select("o_custkey", "sha", F.array_join("files", ",").alias("files"))


def ledger_append(spark, d):
    """A ledger written in three guarded steps: rows, more rows, and rows in place of stale ones."""
    path = scratch(spark, "ledger")
    keys = [*KEYS, "_source"]
    rows = ledger(spark, d).select(*keys, "price")
    sinks.append_rows(path, rows.filter("_source = 'F'"), keys, {})
    sinks.append_rows(path, rows.filter("_source <> 'F'"), keys, {})
    fresh = rows.filter("part_id % 10 = 3").withColumn("price", F.col("price") + 1)
    return sinks.append_rows(path, fresh, keys, {"_delegation_id": F.lit("D901")}, replace_stale=True)


def pool_ingest(spark, d):
    path = scratch(spark, "ledger")
    sinks.append_rows(path, ledger(spark, d).select(*KEYS, "price"), KEYS, {"_delegation_id": F.lit("D001"), "_source": F.lit("agent")})
    pool = table(spark, d, "part").select(F.lit(-1).cast("long").alias("order_id"), F.lit(1).alias("line_no"), F.col("p_partkey").alias("part_id"), F.lit(0).cast("long").alias("supp_id"), F.col("p_retailprice").alias("price"))
    return sinks.ingest_pool(path, pool, KEYS).groupBy("_delegation_id", "_source", "status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


def log_append(spark, d):
    """A log of started and finished rows and of patches, each appended, then collapsed as it is read."""
    from tracemill.operators import eventlog

    path = scratch(spark, "log")
    rows = log(spark, d).select("id", "pos", "status")
    sinks.append_log(rows.filter("pos % 2 = 0"), path)
    sinks.append_log(rows.filter("pos % 2 = 1"), path)
    sinks.append_log(log(spark, d).filter("status = 'error'").select("id", "pos", F.lit("PATCH").alias("kind"), F.concat(F.lit("n"), "k").alias("note"), F.concat(F.lit("H"), (F.col("k") % 10).cast("string")).alias("hypothesis_id")), path)
    read = op.scan_jsonl(spark, path, "id string, pos long, status string, kind string, note string, hypothesis_id string")
    writes, patches = read.filter("kind is null").select("id", "pos", "status").withColumn("note", F.lit(None).cast("string")), read.filter("kind = 'PATCH'")
    out = eventlog.patched(writes, patches, "hypothesis_id", ["note"])
    return out.select("id", "pos", "status", "note", F.array_join(F.array_sort("hypothesis_ids"), ",").alias("hypotheses"))


def kpi_append(spark, d):
    """KPI rows of two runs, the second with a column that the first didn't know."""
    path = scratch(spark, "kpi")
    c = calls(spark, d).groupBy("delegation_id").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))
    sinks.append_kpi(path, c.select("delegation_id", F.lit("r1").alias("run"), "calls"))
    return sinks.append_kpi(path, c.select("delegation_id", F.lit("r2").alias("run"), "calls", "cost"))


QUERIES = {f.__name__: f for f in (csv_ledger, store_glob, namespace_evals, namespace_listing, jsonl_union, jsonl_tail, live_fan_in, newest_first, object_entries, strict_ledger, front_matter, commit_files, ledger_append, pool_ingest, log_append, kpi_append)}

_L = f"WITH {LEDGER_SQL}"
_K = ", ".join(KEYS)
SQL = {
    "csv_ledger": f"{_L} SELECT {_K}, quantity, price, nullif(_delegation_id, '') AS _delegation_id, 'of \"' || _namespace || '\",' || chr(10) || 'line ' || line_no AS note FROM ledger",
    "store_glob": f"{_L} SELECT {_K}, CASE WHEN _namespace <> 'R' THEN quantity END AS quantity, CASE WHEN _namespace = 'N' THEN discount END AS discount, CASE WHEN _namespace = 'R' THEN tax END AS tax, price, CASE _namespace WHEN 'A' THEN 'default' ELSE _namespace END AS _namespace FROM ledger",
    "namespace_listing": "WITH s AS (SELECT 'n ' || s_nationkey AS _namespace, count(*) AS n_rows FROM supplier GROUP BY 1), c AS (SELECT DISTINCT 'n ' || (r_regionkey * 6 + 7) AS _namespace, true AS in_config FROM region) SELECT _namespace, coalesce(n_rows, 0) AS n_rows, n_rows IS NOT NULL AS on_disk, coalesce(in_config, false) AS in_config FROM s FULL JOIN c USING (_namespace)",
    "namespace_evals": f"{_L} SELECT CASE _namespace WHEN 'A' THEN 'default' ELSE _namespace END AS _namespace, count(*) AS n_evals FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000' GROUP BY 1",
    "jsonl_tail": "SELECT event_id, user_id, event_type, value FROM events",
    "live_fan_in": f"""WITH {LOG_SQL}, r AS (SELECT *, k // 40 AS session_started_at FROM log), d AS (SELECT *, lag(status) OVER w AS s, lag(session_started_at) OVER w AS q, row_number() OVER w AS n FROM r WHERE pos % 5 > 0 WINDOW w AS (PARTITION BY id ORDER BY pos)),
        o AS (SELECT from_node, min(pos) AS pos FROM r WHERE pos % 50 = 0 GROUP BY 1)
        SELECT 'delegation' AS kind, id, pos, status, session_started_at, to_node AS payload FROM d WHERE n = 1 OR s IS DISTINCT FROM status OR q IS DISTINCT FROM session_started_at
        UNION ALL SELECT 'diagnostic', NULL, pos, NULL, NULL, id FROM r WHERE pos % 5 = 0 UNION ALL SELECT 'run_status', from_node, pos, status, NULL, NULL FROM o JOIN r USING (from_node, pos)""",
    "jsonl_union": f"WITH {CALLS_SQL} SELECT call_id, role, model, input_tokens, cost, CAST(call_id % 4 AS VARCHAR) AS pid FROM calls WHERE call_id % 7 <> 0 AND call_id % 11 <> 0",
    "newest_first": "SELECT event_id, user_id, event_type, (SELECT count(*) FROM events) AS n_total FROM events ORDER BY event_id DESC LIMIT 400",
    "object_entries": f"WITH {LOG_SQL} SELECT id, 'e' || pos AS name, status, k FROM log WHERE substring(id, -1, 1) <> '0'",
    "strict_ledger": f"WITH {LOG_SQL} SELECT id, pos, status, value FROM log",
    "front_matter": "SELECT 'file' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE 'file' || doc_id END AS id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN source || '|text' END AS tags, md5(text) AS body FROM documents",
    "commit_files": "SELECT o_custkey, lower(to_hex(o_orderkey)) AS sha, string_agg(DISTINCT 'part/' || l_partkey, ',' ORDER BY 'part/' || l_partkey) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, o_orderkey",
    "ledger_append": f"{_L} SELECT {_K}, _source, CASE WHEN part_id % 10 = 3 THEN price + 1 ELSE price END AS price, 'FINISHED' AS status, CASE WHEN part_id % 10 = 3 THEN 'D901' END AS _delegation_id FROM ledger",
    "pool_ingest": f"{_L}, u AS (SELECT 'D001' AS _delegation_id, 'agent' AS _source, price FROM ledger UNION ALL SELECT 'D000', 'precomputed_pool', p_retailprice FROM part) SELECT _delegation_id, _source, 'FINISHED' AS status, count(*) AS n, round(sum(price), 2) AS price FROM u GROUP BY 1, 2",
    "log_append": f"WITH {LOG_SQL}, l AS (SELECT id, max(pos) AS pos, arg_max(status, pos) AS status FROM log GROUP BY 1), p AS (SELECT id, arg_max('n' || k, pos) AS note, string_agg(DISTINCT 'H' || (k % 10), ',' ORDER BY 'H' || (k % 10)) AS hypotheses FROM log WHERE status = 'error' GROUP BY 1) SELECT id, pos, status, note, coalesce(hypotheses, '') AS hypotheses FROM l LEFT JOIN p USING (id)",
    "kpi_append": f"WITH {CALLS_SQL}, c AS (SELECT delegation_id, count(*) AS calls, round(sum(cost), 4) AS cost FROM calls GROUP BY 1) SELECT delegation_id, 'r1' AS run, calls, NULL AS cost FROM c UNION ALL SELECT delegation_id, 'r2', calls, cost FROM c",
}
