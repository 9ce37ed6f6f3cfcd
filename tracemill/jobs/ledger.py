"""Queries over the evaluation ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.columns import content_revision, round_half_even
from tracemill.functions.predicate import where
from tracemill.operators import ledger as op, pool
from tracemill.sources.frames import INPUTS, KEYS, LEDGER_SQL, LOG_SQL, ledger, log, table

WHERE = "quantity * 2 >= 40 and (discount != 0.05 or not tax > 0.02) & (price < 60000)"


def ledger_where(spark, d):
    return where(ledger(spark, d), WHERE).select(*KEYS, "quantity", "discount", "tax", "price")


def ledger_filter(spark, d):
    return op.provenance_filter(ledger(spark, d), [f"D{i:03d}" for i in range(1, 30)], "O", "N").select(*KEYS, "_delegation_id", "price")


def ledger_project(spark, d):
    return op.narrow(ledger(spark, d), ["price", "quantity", "order_id", "line_no", "part_id"])


def best_n(spark, d):
    return op.best_n(where(ledger(spark, d), "quantity >= 10"), "price", 25, KEYS).select(*KEYS, "quantity", "price", "_delegation_id", "_namespace")


def list_limit(spark, d):
    return op.capped(ledger(spark, d).filter("_source = 'O'").select(*KEYS, "price"), KEYS)


def store_union(spark, d):
    rows = ledger(spark, d)
    cut = lambda ns, *cols: rows.filter(F.col("_namespace") == ns).select(*KEYS, *cols)
    return op.union_stores({"A": cut("A", "quantity", "price"), "N": cut("N", "quantity", "discount"), "R": cut("R", "tax", "price")}).select(*KEYS, "quantity", "discount", "tax", "price", "_namespace")


def rows_per_group(spark, d):
    return op.rows_per_group(ledger(spark, d), ["_delegation_id", "_source", "_namespace"])


def output_stats(spark, d):
    out = op.output_stats(ledger(spark, d), ["price", "quantity", "discount"])
    return out.withColumn("mean", F.round("mean", 4))


def wall_per_group(spark, d):
    return op.wall_per_group(ledger(spark, d)).select("_delegation_id", "n", *[F.round(c, 4).alias(c) for c in ("median_ms", "max_ms", "sum_ms")])


def total_evals(spark, d):
    return op.total_evaluations(ledger(spark, d))


def unstamped_rows(spark, d):
    return op.unstamped(ledger(spark, d))


def ledger_breakdown(spark, d):
    out = op.breakdown(ledger(spark, d))
    return out.select("_namespace", "n_total", F.array_join(F.transform(F.map_entries("per_delegation"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("per_delegation"))


def duplicate_stats(spark, d):
    return op.duplicate_stats(ledger(spark, d), INPUTS, KEYS)


def subset_match(spark, d):
    keys = table(spark, d, "part").select((F.col("p_partkey") % 50 + 1).cast("double").alias("quantity"), F.when(F.col("p_partkey") % 50 > 5, (F.col("p_size") % 11) / 100).alias("discount"))
    return op.subset_match(ledger(spark, d).select(*KEYS, "quantity", "discount"), keys, ["quantity", "discount"])


def dedup_keep_first(spark, d):
    rows = ledger(spark, d)
    return op.keep_first(rows.filter("_source = 'O'"), rows.filter("_source = 'F'"), INPUTS, KEYS, ["_namespace"]).select(*KEYS, *INPUTS, "_namespace")


def query_explain(spark, d):
    rows, out = ledger(spark, d), None
    for name, how in (("found", {"predicate": "quantity >= 10"}), ("none", {"predicate": "quantity > 1000", "source": "O"}), ("loose", {"predicate": "price == 0.1", "delegation_ids": ["D001"]}), ("all", {})):
        one = op.explained(rows, **how).withColumn("query", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def default_columns(spark, d):
    rows = ledger(spark, d)
    return rows.select(*op.shown_columns(rows.columns, [*INPUTS, "_ts"], "price"), *KEYS)


def numeric_matrix(spark, d):
    return op.without_provenance(ledger(spark, d))


def mean_wall(spark, d):
    return op.real(ledger(spark, d)).agg(F.count("_wall_ms").alias("n"), F.round(F.avg("_wall_ms"), 6).alias("mean_ms"))


def objective_range(spark, d):
    return op.objective_range(ledger(spark, d).select("price", "quantity", "_namespace", "_source"), ["_namespace"])


def row_join(spark, d):
    """Inputs and outputs, stored apart, side by side again by row id."""
    rows = ledger(spark, d).withColumn("row_id", F.xxhash64(*KEYS, "price", *INPUTS, "_ts"))
    one = rows.dropDuplicates(["row_id"])
    return one.select("row_id", *KEYS, *INPUTS).join(one.select("row_id", "price"), "row_id").drop("row_id")


def store_guard(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("OPEN").alias("status"))
    new = o.select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 9 > 0), "FINISHED").otherwise("OPEN").alias("status"))
    return op.store_guard(old, new, ["o_orderkey"])


def store_supersede(spark, d):
    rows = ledger(spark, d).select(*KEYS, "quantity", "price")
    fresh = rows.filter("part_id % 10 = 3").withColumn("price", F.col("price") + 1)
    return op.supersede(rows, fresh, KEYS)


def content_hash(spark, d):
    out = op.content_hash(ledger(spark, d), ["price"], ["_namespace"])
    return out


def column_kind(spark, d):
    rows = ledger(spark, d).withColumn("flag", F.when(F.col("line_no") > 3, "True").otherwise("0"))
    return op.column_kinds(rows, ["price", "flag", "_source", "quantity"])


def orphan_rows(spark, d):
    return op.orphans(ledger(spark, d), log(spark, d).select(F.format_string("D%03d", F.substring("id", 2, 6).cast("long") * 2).alias("id")))


def eval_reconcile(spark, d):
    s = table(spark, d, "supplier")
    claims = s.select(F.format_string("D%03d", "s_suppkey").alias("id"), (F.col("s_suppkey") % 4 * 100).alias("claimed"), (F.col("s_nationkey") % 2 == 0).alias("registered"))
    return op.reconcile(claims, ledger(spark, d))


def _lookups(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    candidates = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 0.4).alias("a"), (F.col("s_acctbal") / 10 + 900).alias("b"))
    return pool.nearest_pool_row(candidates, rows, ["a", "b"], "s_suppkey", "p_partkey").withColumn("distance2", F.round("distance2", 6))


def nn_lookup(spark, d):
    return _lookups(spark, d)


def lookup_repeats(spark, d):
    """Lookups that a pool row answers which has answered one before."""
    return pool.repeated(_lookups(spark, d), "p_partkey", ["s_suppkey"]).filter("repeated").select("s_suppkey", "p_partkey")


def best_so_far(spark, d):
    return op.best_so_far(ledger(spark, d), "price", ["_namespace", "_source", "supp_id"], KEYS).select(*KEYS, "best_so_far")


def budget_snapshot(spark, d):
    return op.budget_snapshot(ledger(spark, d), "_delegation_id", 550)


def append_only(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.filter("o_orderkey % 100 <> 7").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return op.append_only(old, new)


def design_key(spark, d):
    return ledger(spark, d).select(*KEYS, F.concat_ws(";", *[F.concat(F.lit(c + "="), F.format_string("%.10f", round_half_even(c))) for c in sorted(INPUTS)]).alias("design_key"))


def content_rev(spark, d):
    return table(spark, d, "documents").select("doc_id", content_revision("text").alias("revision"))


def objective_eval(spark, d):
    """A bowl about (0.05, 0.04) and the sum of two Gaussian wells, over the ledger's inputs."""
    x, y = F.col("discount"), F.col("tax")
    well = lambda cx, cy, depth: -depth * F.exp(-(F.pow(x - cx, F.lit(2.0)) + F.pow(y - cy, F.lit(2.0))) / 0.002)
    return ledger(spark, d).select(*KEYS, F.round(F.pow(x - 0.05, F.lit(2.0)) + F.pow(y - 0.04, F.lit(2.0)), 9).alias("bowl"), F.round(well(0.02, 0.03, 1.0) + well(0.08, 0.06, 0.5), 9).alias("wells"))


_HASH_ROW = "CASE WHEN price IS NULL THEN 'null' ELSE printf('%.10f', round_even(price, 10)) END"

QUERIES = {f.__name__: f for f in (lookup_repeats, ledger_where, ledger_filter, ledger_project, best_n, list_limit, store_union, rows_per_group, output_stats, wall_per_group, total_evals, unstamped_rows, ledger_breakdown, duplicate_stats, subset_match, dedup_keep_first, store_guard, store_supersede, content_hash, column_kind, orphan_rows, eval_reconcile, nn_lookup, best_so_far, budget_snapshot, append_only, design_key, content_rev, objective_eval, query_explain, default_columns, numeric_matrix, mean_wall, objective_range, row_join)}

_L = f"WITH {LEDGER_SQL}"
_K = ", ".join(KEYS)
SQL = {
    "ledger_where": f"{_L} SELECT {_K}, quantity, discount, tax, price FROM ledger WHERE coalesce(quantity * 2 >= 40, false) AND (NOT coalesce(discount = 0.05, false) OR NOT coalesce(tax > 0.02, false)) AND coalesce(price < 60000, false)",
    "ledger_filter": f"{_L} SELECT {_K}, _delegation_id, price FROM ledger WHERE _delegation_id IN ({', '.join(f"'D{i:03d}'" for i in range(1, 30))}) AND _source = 'O' AND _namespace = 'N'",
    "ledger_project": f"{_L} SELECT order_id, line_no, part_id, quantity, price, _namespace FROM ledger",
    "best_n": f"{_L} SELECT {_K}, quantity, price, _delegation_id, _namespace FROM ledger WHERE quantity >= 10 AND abs(price) < 1e8 ORDER BY price, {_K} LIMIT 25",
    "list_limit": f"{_L}, s AS (SELECT {_K}, price FROM ledger WHERE _source = 'O'), t AS (SELECT count(*) AS n_total FROM s) SELECT s.*, n_total, greatest(n_total - 20, 0) AS n_left_out FROM s, t ORDER BY {_K} LIMIT 20",
    "store_union": f"{_L} SELECT {_K}, CASE WHEN _namespace <> 'R' THEN quantity END AS quantity, CASE WHEN _namespace = 'N' THEN discount END AS discount, CASE WHEN _namespace = 'R' THEN tax END AS tax, CASE WHEN _namespace <> 'N' THEN price END AS price, _namespace FROM ledger WHERE _namespace IN ('A', 'N', 'R')",
    "rows_per_group": f"""{_L} SELECT '_delegation_id' AS "column", _delegation_id AS value, count(*) AS n_rows FROM ledger WHERE _delegation_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT '_source', _source, count(*) FROM ledger WHERE _source IS NOT NULL GROUP BY 2 UNION ALL SELECT '_namespace', _namespace, count(*) FROM ledger WHERE _namespace IS NOT NULL GROUP BY 2""",
    "output_stats": f"{_L}, u AS (SELECT 'price' AS output, price AS value FROM ledger UNION ALL SELECT 'quantity', quantity FROM ledger UNION ALL SELECT 'discount', discount FROM ledger) SELECT output, min(value) AS least, max(value) AS largest, round(avg(value), 4) AS mean FROM u WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1",
    "wall_per_group": f"{_L} SELECT _delegation_id, count(_wall_ms) AS n, round(median(_wall_ms), 4) AS median_ms, round(max(_wall_ms), 4) AS max_ms, round(sum(_wall_ms), 4) AS sum_ms FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000' AND coalesce(_source, '') <> 'precomputed_pool' GROUP BY 1",
    "total_evals": f"{_L} SELECT count(*) AS n_evals FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000'",
    "unstamped_rows": f"{_L} SELECT count(*) AS n_rows, count(*) FILTER (WHERE coalesce(_delegation_id, '') = '') AS n_unstamped FROM ledger",
    "ledger_breakdown": f"{_L}, e AS (SELECT _namespace, _delegation_id, count(*) AS n FROM ledger WHERE _delegation_id IS NOT NULL GROUP BY 1, 2) SELECT _namespace, CAST(sum(n) AS BIGINT) AS n_total, string_agg(_delegation_id || '=' || n, ',' ORDER BY _delegation_id) AS per_delegation FROM e GROUP BY 1",
    "duplicate_stats": f"{_L}, e AS (SELECT _delegation_id, round_even(quantity, 10) AS q, round_even(discount, 10) AS di, round_even(tax, 10) AS t, count(*) AS n, min(row({_K})) AS f FROM ledger WHERE _delegation_id <> '' GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY _delegation_id ORDER BY n DESC, f) AS i FROM e) SELECT _delegation_id, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS n_duplicate, max(n) AS worst, max(CASE WHEN i = 1 THEN printf('discount=%.4f;quantity=%.4f;tax=%.4f', di, q, t) END) AS worst_design FROM r GROUP BY 1",
    "subset_match": f"{_L}, k AS (SELECT DISTINCT CAST(p_partkey % 50 + 1 AS DOUBLE) AS q, CASE WHEN p_partkey % 50 > 5 THEN (p_size % 11) / 100.0::DOUBLE END AS di FROM part) SELECT DISTINCT {_K}, quantity, discount FROM ledger WHERE EXISTS (SELECT 1 FROM k WHERE round_even(q, 10) = round_even(quantity, 10) AND (di IS NULL OR round_even(di, 10) = round_even(discount, 10)))",
    "dedup_keep_first": f"{_L}, b AS (SELECT *, row_number() OVER (PARTITION BY _namespace, round_even(quantity, 10), round_even(discount, 10), round_even(tax, 10) ORDER BY {_K}) AS n FROM ledger a WHERE _source = 'O' AND NOT EXISTS (SELECT 1 FROM ledger h WHERE h._source = 'F' AND h._namespace = a._namespace AND round_even(h.quantity, 10) = round_even(a.quantity, 10) AND round_even(h.discount, 10) = round_even(a.discount, 10) AND round_even(h.tax, 10) = round_even(a.tax, 10))) SELECT {_K}, {', '.join(INPUTS)}, _namespace FROM b WHERE n = 1",
    "query_explain": f"""{_L} SELECT 'found' AS query, count(*) AS n_scanned, count(*) FILTER (WHERE quantity >= 10) AS n_matched, 'where=' || chr(39) || 'quantity >= 10' || chr(39) AS filters, CASE WHEN count(*) FILTER (WHERE quantity >= 10) > 0 THEN 'found' ELSE 'true zero' END AS verdict FROM ledger
        UNION ALL SELECT 'none', count(*), count(*) FILTER (WHERE quantity > 1000 AND _source = 'O'), 'source=' || chr(39) || 'O' || chr(39) || '; where=' || chr(39) || 'quantity > 1000' || chr(39), 'true zero' FROM ledger
        UNION ALL SELECT 'loose', count(*), count(*) FILTER (WHERE price = 0.1 AND _delegation_id = 'D001'), 'delegation_ids=[' || chr(39) || 'D001' || chr(39) || ']; where=' || chr(39) || 'price == 0.1' || chr(39), 'not necessarily a true zero: equality of floating-point numbers' FROM ledger UNION ALL SELECT 'all', count(*), count(*), '(no filter)', 'found' FROM ledger""",
    "default_columns": f"{_L} SELECT {', '.join(INPUTS)}, price, _delegation_id, _namespace, {_K} FROM ledger",
    "numeric_matrix": f"{_L} SELECT {_K}, {', '.join(INPUTS)}, price FROM ledger",
    "mean_wall": f"{_L} SELECT count(_wall_ms) AS n, round(avg(_wall_ms), 6) AS mean_ms FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000'",
    "objective_range": f"{_L} SELECT _namespace, 'price' AS objective, min(price) AS least, max(price) AS largest FROM ledger WHERE abs(price) < 1e8 GROUP BY 1",
    "row_join": f"{_L} SELECT DISTINCT {_K}, {', '.join(INPUTS)}, price FROM (SELECT DISTINCT {_K}, {', '.join(INPUTS)}, price, _ts FROM ledger)",
    "store_guard": "SELECT count(*) AS n_old, count(*) AS n_new, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_custkey % 9 = 0) AS n_unfinished, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_custkey % 9 = 0) = 0 AS allowed FROM orders",
    "store_supersede": f"{_L} SELECT {_K}, quantity, CASE WHEN part_id % 10 = 3 THEN price + 1 ELSE price END AS price FROM ledger",
    "content_hash": f"{_L}, e AS (SELECT _namespace, sha256('a' || {_HASH_ROW}) || sha256('b' || {_HASH_ROW}) AS h FROM ledger) SELECT _namespace, count(*) AS n_rows, sha256(concat_ws(',', count(*), " + ", ".join(f"sum(CAST(('0x' || substring(h, {1 + 8 * i}, 8))::BIGINT AS HUGEINT)) % 18446744073709551616" for i in range(16)) + ")) AS content_hash FROM e GROUP BY 1",
    "column_kind": f"""{_L} SELECT 'price' AS "column", 'numeric' AS kind, count(price) AS n FROM ledger UNION ALL SELECT 'flag', CASE WHEN count(*) FILTER (WHERE (CASE WHEN line_no > 3 THEN 1.0 ELSE 0.0 END) NOT IN (0, 1)) = 0 THEN 'binary' ELSE 'numeric' END, count(*) FROM ledger
        UNION ALL SELECT '_source', CASE WHEN count(TRY_CAST(_source AS DOUBLE)) = count(*) THEN 'numeric' ELSE 'label' END, count(*) FROM ledger UNION ALL SELECT 'quantity', CASE WHEN count(*) FILTER (WHERE quantity NOT IN (0, 1)) = 0 THEN 'binary' ELSE 'numeric' END, count(*) FROM ledger""",
    "orphan_rows": f"WITH {LEDGER_SQL}, {LOG_SQL} SELECT _delegation_id, count(*) AS n_rows FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000' AND _delegation_id NOT IN (SELECT printf('D%03d', CAST(substring(id, 2, 6) AS BIGINT) * 2) AS x FROM log) GROUP BY 1",
    "eval_reconcile": f"{_L}, c AS (SELECT printf('D%03d', s_suppkey) AS id, s_suppkey % 4 * 100 AS claimed, s_nationkey % 2 = 0 AS registered FROM supplier), s AS (SELECT _delegation_id AS id, count(*) AS n FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000' GROUP BY 1) SELECT id, claimed, coalesce(n, 0) AS n_stamped, CASE WHEN coalesce(n, 0) > 0 THEN n WHEN claimed > 0 AND registered THEN 0 ELSE claimed END AS n_evals, claimed > 0 AND coalesce(n, 0) = 0 AND registered AS off_ledger FROM c LEFT JOIN s USING (id)",
    "nn_lookup": """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), w AS (SELECT CASE WHEN max(a) > min(a) THEN max(a) - min(a) ELSE 1 END AS sa, CASE WHEN max(b) > min(b) THEN max(b) - min(b) ELSE 1 END AS sb FROM p),
        x AS (SELECT s_suppkey, p_partkey, round(pow((s_suppkey % 50 + 0.4::DOUBLE - a) / sa, 2.0) + pow((s_acctbal / 10 + 900 - b) / sb, 2.0), 12) AS d FROM supplier, p, w), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, p_partkey) AS n FROM x) SELECT s_suppkey, p_partkey, round(d, 6) AS distance2 FROM r WHERE n = 1""",
    "lookup_repeats": """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), w AS (SELECT CASE WHEN max(a) > min(a) THEN max(a) - min(a) ELSE 1 END AS sa, CASE WHEN max(b) > min(b) THEN max(b) - min(b) ELSE 1 END AS sb FROM p),
        x AS (SELECT s_suppkey, p_partkey, round(pow((s_suppkey % 50 + 0.4::DOUBLE - a) / sa, 2.0) + pow((s_acctbal / 10 + 900 - b) / sb, 2.0), 12) AS d FROM supplier, p, w), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, p_partkey) AS n FROM x), f AS (SELECT * FROM r WHERE n = 1) SELECT s_suppkey, p_partkey FROM f WHERE s_suppkey > (SELECT min(s_suppkey) FROM f g WHERE g.p_partkey = f.p_partkey)""",
    "best_so_far": f"{_L} SELECT {_K}, min(CASE WHEN abs(price) < 1e8 THEN price END) OVER (PARTITION BY _namespace, _source, supp_id ORDER BY {_K} ROWS UNBOUNDED PRECEDING) AS best_so_far FROM ledger",
    "budget_snapshot": f"{_L} SELECT _delegation_id, count(*) AS used, greatest(550 - count(*), 0) AS remaining, count(*) >= 550 AS exhausted FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000' GROUP BY 1",
    "append_only": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 50 = 0 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 100 <> 7",
    "design_key": f"{_L} SELECT {_K}, " + " || ';' || ".join(f"'{c}=' || printf('%.10f', round_even({c}, 10))" for c in sorted(INPUTS)) + " AS design_key FROM ledger",
    "content_rev": "SELECT doc_id, substring(sha256(text), 1, 8) AS revision FROM documents",
    "objective_eval": f"{_L} SELECT {_K}, round(pow(discount - 0.05, 2.0) + pow(tax - 0.04, 2.0), 9) AS bowl, round(-1.0 * exp(-(pow(discount - 0.02, 2.0) + pow(tax - 0.03, 2.0)) / 0.002) - 0.5 * exp(-(pow(discount - 0.08, 2.0) + pow(tax - 0.06, 2.0)) / 0.002), 9) AS wells FROM ledger",
}
