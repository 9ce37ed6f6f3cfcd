"""Queries over structured texts, identifiers and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import documents as op, ledger as led
from tracemill.sources.frames import CALLS_SQL, LEDGER_SQL, LOG_SQL, PAPERS_SQL, calls, ledger, log, papers, table


#: Order lines of a task, as groups are made after their rows are dealt.
LINES = 500_000


def _contents(spark, d):
    """A tree for each customer: orders, and in each the parts of its lines."""
    lines = table(spark, d, "lineitem")
    n = max(spark.sparkContext.defaultParallelism, lines.count() // LINES + 1)
    li = lines.select("l_orderkey", "l_linenumber", "l_partkey").repartition(n, "l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    leaf = F.struct("l_linenumber", "l_partkey")
    leaves = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(leaf)).alias("ls"))
    inner = F.array_join(F.transform("ls", lambda x: F.concat(F.lit('<topic title="part '), x["l_partkey"].cast("string"), F.lit('" href="o'), F.col("o_orderkey").cast("string"), F.lit("#p"), x["l_partkey"].cast("string"), F.lit('"/>'))), "")
    each = o.join(leaves, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.concat(F.lit('<topic title="order" href="o'), F.col("o_orderkey").cast("string"), F.lit('">'), inner, F.lit("</topic>")).alias("xml"))
    whole = each.repartition(n, "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "xml"))).alias("x"))
    return whole.select("o_custkey", F.concat(F.lit('<toc><topic title="all">'), F.array_join(F.transform("x", lambda x: x["xml"]), "\n"), F.lit("</topic></toc>")).alias("xml"))


def contents_tree(spark, d):
    return op.contents_tree(_contents(spark, d), "o_custkey", "xml")


def first_nodes(spark, d):
    return op.first_nodes(op.contents_tree(_contents(spark, d), "o_custkey", "xml").filter("href <> ''"), "href")


def notebook_cells(spark, d):
    """Conversations as notebooks: each turn a cell, with its text as output, and every third with a large image."""
    c = table(spark, d, "conversations")
    text = F.create_map(F.lit("mime"), F.lit("text/plain"), F.lit("content"), F.col("text"))
    image = F.create_map(F.lit("mime"), F.lit("image/png"), F.lit("content"), F.repeat(F.lit("x"), 60))
    outputs = F.when(F.col("turn") % 3 == 0, F.array(image, text)).when(F.col("turn") % 3 == 1, F.array(text)).otherwise(F.array().cast("array<map<string,string>>"))
    cell = F.struct("turn", F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.col("role").alias("source"), outputs.alias("outputs"))
    books = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(cell), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("cells"))).alias("text"))
    out = op.notebook_outputs(books, "conv_id", "text", most=50)
    return out.select("conv_id", "cell", "kind", "source", "output", "mime", F.md5("content").alias("content"))


def transcript_scan(spark, d):
    """Recorded messages of one speaker's side; some records are missing, and some lack the key."""
    c = table(spark, d, "conversations")
    message = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    name = F.when(F.col("conv_id") % 3 == 0, "other").otherwise("main")
    docs = c.groupBy("conv_id").agg(message.alias("m")).select("conv_id", F.when(F.col("conv_id") % 5 > 0, F.to_json(F.create_map(name, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))))).alias("text"))
    return op.transcript(docs, "conv_id", "text", "main").select("conv_id", "recorded", "position", "role", F.md5("content").alias("content"))


def source_headers(spark, d):
    """Source files made of orders: their parts are includes, their state an event."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    inc = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ps"))
    o = table(spark, d, "orders").join(inc, F.col("l_orderkey") == F.col("o_orderkey"))
    text = F.concat(F.lit("/**\n * Order of\n * "), "o_orderpriority", F.lit("\n */\n# Order "), F.col("o_orderkey").cast("string"), F.lit("\n"), F.array_join(F.transform("ps", lambda p: F.concat(F.lit('#include "p'), p.cast("string"), F.lit('.h"\n#include <sys.h>'))), "\n"), F.lit("\nevent state_"), "o_orderstatus", F.lit(" (i++) {}\n"))
    out = op.source_header(o.select("o_orderkey", text.alias("t")), "t")
    return out.select("o_orderkey", F.array_join("includes", ",").alias("includes"), "title", F.array_join("events", ",").alias("events"), F.regexp_replace("doc", r"\s+", " ").alias("doc"))


def header_exclusions(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("/", F.lower("p_type"), "p_name").alias("path"), F.col("p_name").alias("title"))
    return op.without_prefixes(p, "path", ("small", "promo"), "title", r"^red ").select("p_partkey")


def normal_ids(spark, d):
    k = F.col("o_orderkey").cast("string")
    n = F.col("o_orderkey") % 6
    raw = F.when(n == 0, F.concat(F.lit("https://works.example/w"), k)).when(n == 1, F.concat(F.lit("DOI: 10.1234/AB"), k)).when(n == 2, F.concat(F.lit("https://doi.org/10.1234/Ab"), k)).when(n == 3, F.concat(F.lit("arXiv:2301."), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"), F.lit("v2"))).when(n == 4, F.concat(F.lit("w"), k)).otherwise(F.concat(F.lit(" key "), k))
    return table(spark, d, "orders").select("o_orderkey", op.normal_id(raw).alias("id"))


def transient_errors(spark, d):
    message = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("HTTP 429 for", "Read timed out at", "no such key", "Connection RESET by", "bad value")]), (F.col("pos") % 5 + 1).cast("int")), "id")
    return log(spark, d).select("pos", op.is_transient(message).alias("transient"))


def flat_results(spark, d):
    """Results of each conversation: its turns as blocks, of which the assistant's count."""
    blocks = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("kind"), "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(blocks.alias("b")).select("conv_id", F.md5(op.flat_content("b", ("assistant",))).alias("content"))


def resolve_targets(spark, d):
    names = {"alpha-one": "A1", "beta": "B"}
    raw = F.element_at(F.array(*[F.lit(x) for x in ("alpha-one", "Alpha One", "ALPHA_ONE", "second", "Beta", "gamma")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", op.resolve_name(raw, names, {"second": "B"}).alias("target"))


def doc_summary(spark, d):
    text = F.concat(F.lit("\n  "), F.col("p_name"), F.lit("\n  of "), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, "\n\nMore.").otherwise("\n\nParameters\n----------\nx"))
    return table(spark, d, "part").select("p_partkey", op.summary_of(text).alias("summary"))


def corpus_listing(spark, d):
    return op.listing(papers(spark, d).withColumn("title", F.md5("title")), "paper_id", "title", "full_text")


def corpus_coverage(spark, d):
    return op.coverage(papers(spark, d), "full_text").withColumn("share", F.round("share", 9))


def chunk_vectors(spark, d):
    """Chunks with their vectors: paper p's chunk c has vector 10 p + c, if there is one."""
    from tracemill.operators import retrieval

    chunks = retrieval.chunks(papers(spark, d), "paper_id", "text").select("paper_id", "chunk_id")
    v = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("paper_id"), (F.col("vec_id") % 10).cast("int").alias("chunk_id"), "embedding")
    return op.with_vectors(chunks, v, ["paper_id", "chunk_id"], "embedding").select("paper_id", "chunk_id", "has_vector", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def process_groups(spark, d):
    out = op.grouped_processes(log(spark, d).select("id", (F.col("k") % 7).alias("pid"), (F.col("k") % 3).alias("start")), "id", "pid", "start")
    return out.select("id", F.array_join(F.transform("processes", lambda x: F.concat_ws(":", x["start"].cast("string"), x["pid"].cast("string"))), ",").alias("processes"))


def summary_cache(spark, d):
    t = table(spark, d, "documents")
    cache = t.filter("lang = 'en'").select(F.sha2("text", 256).alias("hash"), F.left("text", F.lit(9)).alias("summary"))
    return op.cached_summaries(t, cache, "doc_id", "text", F.lit("?"))


def kpi_footer(spark, d):
    w = led.wall_per_group(ledger(spark, d))
    return w.select("_delegation_id", F.format_string("%s: n=%d median=%.1f max=%.1f total=%.1f", "_delegation_id", "n", "median_ms", "max_ms", "sum_ms").alias("line"))


def graph_spec(spark, d):
    """Model of each node: the recorded one, else the agent's, else the default."""
    c = calls(spark, d).groupBy("role").agg(F.max_by("model", "call_id").alias("recorded"))
    nodes = log(spark, d).select(F.col("status").alias("role"), "from_node").distinct()
    return nodes.join(c, "role", "left").select("role", "from_node", F.coalesce(F.when(F.col("from_node") != "N3", F.col("recorded")), F.when(F.col("from_node") == "N3", "agent"), F.lit("default")).alias("model"))


def evals_of(spark, d):
    """Evaluations of one delegation over all namespaces."""
    return led.real(ledger(spark, d)).filter("_delegation_id = 'D007'").agg(F.count("*").alias("n_evals"), F.countDistinct("_namespace").alias("n_namespaces"))


QUERIES = {f.__name__: f for f in (contents_tree, first_nodes, notebook_cells, transcript_scan, source_headers, header_exclusions, normal_ids, transient_errors, flat_results, resolve_targets, doc_summary, corpus_listing, corpus_coverage, chunk_vectors, process_groups, summary_cache, kpi_footer, graph_spec, evals_of)}

_TREE = """li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), o AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM li)), n AS (SELECT DISTINCT o_custkey, -1 AS a, -1 AS b, -1 AS c, 0 AS depth, 'all' AS title, '' AS href, NULL AS fragment FROM o
  UNION ALL SELECT o_custkey, o_orderkey, -1, -1, 1, 'order', 'o' || o_orderkey, NULL FROM o UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, 2, 'part ' || l_partkey, 'o' || o_orderkey, 'p' || l_partkey FROM o JOIN li ON l_orderkey = o_orderkey),
  m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a, b, c) - 1 AS node FROM n), t AS (SELECT o_custkey, node, CASE depth WHEN 1 THEN 0 WHEN 2 THEN min(node) OVER (PARTITION BY o_custkey, a) END AS parent, depth, title, href, fragment FROM m)"""
SQL = {
    "contents_tree": f"WITH {_TREE} SELECT o_custkey, node, parent, depth, title, href, fragment FROM t",
    "first_nodes": f"WITH {_TREE} SELECT href, node FROM t WHERE depth = 1",
    "notebook_cells": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cell FROM conversations) SELECT conv_id, cell, CASE role WHEN 'user' THEN 'markdown' ELSE 'code' END AS kind, role AS source, CASE WHEN turn % 3 < 2 THEN 0 END AS output, CASE WHEN turn % 3 < 2 THEN 'text/plain' END AS mime, CASE WHEN turn % 3 < 2 THEN md5(text) END AS content FROM c",
    "transcript_scan": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations) SELECT conv_id, true AS recorded, position, role, md5(text) AS content FROM c WHERE conv_id % 5 > 0 AND conv_id % 3 > 0 UNION ALL SELECT DISTINCT conv_id, CASE WHEN conv_id % 5 > 0 THEN false END, NULL, NULL, NULL FROM c WHERE conv_id % 5 = 0 OR conv_id % 3 = 0",
    "source_headers": "WITH li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT o_orderkey, string_agg('p' || l_partkey || '.h', ',' ORDER BY l_partkey) AS includes, 'Order ' || o_orderkey AS title, 'state_' || any_value(o_orderstatus) AS events, 'Order of ' || any_value(o_orderpriority) AS doc FROM orders JOIN li ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "header_exclusions": "SELECT p_partkey FROM part WHERE NOT starts_with(lower(p_type), 'small') AND NOT starts_with(lower(p_type), 'promo') AND NOT starts_with(p_name, 'red ')",
    "normal_ids": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'W' || o_orderkey WHEN 1 THEN '10.1234/ab' || o_orderkey WHEN 2 THEN '10.1234/ab' || o_orderkey WHEN 3 THEN 'ARXIV:2301.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') WHEN 4 THEN 'W' || o_orderkey ELSE 'key ' || o_orderkey END AS id FROM orders",
    "transient_errors": f"WITH {LOG_SQL} SELECT pos, pos % 5 IN (0, 1, 3) AS transient FROM log",
    "flat_results": "SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS content FROM conversations GROUP BY 1",
    "resolve_targets": "SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN 'A1' WHEN p_partkey % 6 < 5 THEN 'B' END AS target FROM part",
    "doc_summary": "SELECT p_partkey, p_name || ' of ' || p_brand AS summary FROM part",
    "corpus_listing": f"WITH {PAPERS_SQL} SELECT paper_id, '| ' || paper_id || ' | ' || md5(title) || CASE WHEN full_text THEN ' | full text |' ELSE ' | |' END AS line FROM papers",
    "corpus_coverage": f"WITH {PAPERS_SQL} SELECT count(*) AS n_papers, count(*) FILTER (WHERE full_text) AS n_full, round(count(*) FILTER (WHERE full_text) / count(*), 9) AS share FROM papers",
    "chunk_vectors": rf"WITH {PAPERS_SQL}, w AS (SELECT paper_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM papers), c AS (SELECT paper_id, i AS chunk_id FROM w, unnest(range(0, (n + 99) // 100)) AS u(i)) SELECT paper_id, chunk_id, embedding IS NOT NULL AS has_vector, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM c LEFT JOIN embeddings ON vec_id // 10 = paper_id AND vec_id % 10 = chunk_id",
    "process_groups": f"WITH {LOG_SQL}, p AS (SELECT DISTINCT id, k % 3 AS s, k % 7 AS pid FROM log) SELECT id, string_agg(s || ':' || pid, ',' ORDER BY s, pid) AS processes FROM p GROUP BY 1",
    "summary_cache": "WITH c AS (SELECT text, left(text, 9) AS s FROM documents WHERE lang = 'en' GROUP BY 1, 2) SELECT doc_id, coalesce(s, '?') AS summary, s IS NOT NULL AS hit FROM documents d LEFT JOIN c ON c.text = d.text",
    "kpi_footer": f"WITH {LEDGER_SQL} SELECT _delegation_id, printf('%s: n=%d median=%.1f max=%.1f total=%.1f', _delegation_id, count(_wall_ms), median(_wall_ms), max(_wall_ms), sum(_wall_ms)) AS line FROM ledger WHERE _delegation_id <> '' AND _delegation_id <> 'D000' AND coalesce(_source, '') <> 'precomputed_pool' GROUP BY 1",
    "graph_spec": f"WITH {CALLS_SQL}, c AS (SELECT role, arg_max(model, call_id) AS recorded FROM calls GROUP BY 1) SELECT DISTINCT status AS role, from_node, CASE WHEN from_node = 'N3' THEN 'agent' ELSE coalesce(recorded, 'default') END AS model FROM log LEFT JOIN c ON c.role = log.status",
    "evals_of": f"WITH {LEDGER_SQL} SELECT count(*) AS n_evals, count(DISTINCT _namespace) AS n_namespaces FROM ledger WHERE _delegation_id = 'D007'",
}
