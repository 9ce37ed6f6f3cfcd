"""The library's frames, read from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["order_id", "line_no", "part_id", "supp_id"]
INPUTS = ["quantity", "discount", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation ledger: one row for each line item, with failed objectives and rows without a stamp among them."""
    part = F.col("l_partkey")
    price = F.when(part % 17 == 0, None).when(part % 19 == 0, F.lit(1e9)).otherwise(F.col("l_extendedprice"))
    stamp = F.when(part % 11 == 0, None).when(part % 13 == 0, F.lit("")).when(F.col("l_suppkey") % 10 == 0, F.lit("D000")).otherwise(F.format_string("D%03d", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), part.alias("part_id"), F.col("l_suppkey").alias("supp_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), price.alias("price"),
        stamp.alias("_delegation_id"), F.col("l_linestatus").alias("_source"), F.col("l_returnflag").alias("_namespace"), F.col("l_shipdate").alias("_ts"), (F.col("l_tax") * 1000).alias("_wall_ms"),
    )


LEDGER_SQL = """ledger AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
  l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
  CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 1e9 ELSE l_extendedprice END AS price,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN '' WHEN l_suppkey % 10 = 0 THEN 'D000'
       ELSE printf('D%03d', l_suppkey) END AS _delegation_id,
  l_linestatus AS _source, l_returnflag AS _namespace, l_shipdate AS _ts, l_tax * 1000 AS _wall_ms FROM lineitem)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delegation log: a row for each status write, in order of pos."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(
        F.format_string("D%06d", "user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("status"),
        F.concat(F.lit("N"), (F.col("user_id") % 7).cast("string")).alias("from_node"), F.concat(F.lit("N"), (F.col("event_id") % 5).cast("string")).alias("to_node"),
        F.col("ts"), F.col("value"), k.alias("k"), F.col("props"),
    )


LOG_SQL = """log AS (SELECT printf('D%06d', user_id) AS id, event_id AS pos, event_type AS status,
  'N' || CAST(user_id % 7 AS VARCHAR) AS from_node, 'N' || CAST(event_id % 5 AS VARCHAR) AS to_node,
  ts, value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry calls; those of some pages have no known cost."""
    r = log(spark, sf_dir)
    return r.select(
        F.col("pos").alias("call_id"), F.col("status").alias("role"), F.concat(F.lit("m"), (F.col("k") % 3).cast("string"), F.when(F.col("pos") % 2 == 0, F.lit("-20240101")).otherwise(F.lit(""))).alias("model"),
        F.when(F.col("pos") % 4 == 0, F.lit("plan")).otherwise(F.lit("act")).alias("phase"), F.col("id").alias("delegation_id"), F.col("ts"),
        F.col("k").alias("input_tokens"), (F.col("k") % 10).alias("output_tokens"), F.when(F.col("status") != "signup", F.col("value")).alias("cost"),
    )


CALLS_SQL = (
    LOG_SQL
    + """, calls AS (SELECT pos AS call_id, status AS role, 'm' || CAST(k % 3 AS VARCHAR) || CASE WHEN pos % 2 = 0 THEN '-20240101' ELSE '' END AS model,
  CASE WHEN pos % 4 = 0 THEN 'plan' ELSE 'act' END AS phase, id AS delegation_id, ts, k AS input_tokens, k % 10 AS output_tokens,
  CASE WHEN status <> 'signup' THEN value END AS cost FROM log)"""
)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus papers: documents, those of over 5000 characters with full text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("paper_id"), "text", F.element_at(F.split("text", "\n"), 1).alias("title"), (F.col("n_chars") > 5000).alias("full_text"), (F.col("doc_id") % 97).alias("citations"), "source", "lang")


PAPERS_SQL = "papers AS (SELECT doc_id AS paper_id, text, string_split(text, chr(10))[1] AS title, n_chars > 5000 AS full_text, doc_id % 97 AS citations, source, lang FROM documents)"
