"""Queries over trees, graphs, records, pages and streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tracemill.functions.html import meta_content, page_text as extract
from tracemill.functions.scratch import scratch
from tracemill.functions.shipping import ship
from tracemill.operators import graph as op
from tracemill.sources.frames import table
from tracemill.streaming import keyed, monitors


#: Pages that a task holds as Python's texts at a time.
PAGES = 64


def _edges(spark, d):
    """Each customer leans on the one of half its number, and every fifth on that of a third."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("src")).filter("src > 0")
    return c.select("src", F.expr("src div 2").alias("dst")).unionByName(c.filter("src % 5 = 0").select("src", F.expr("src div 3").alias("dst")))


def transitive_closure(spark, d):
    return op.closure(_edges(spark, d))


def bfs_layers(spark, d):
    """Steps from customer 1 to all that lean on it; what others alone lead to is behind the last."""
    nodes = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("node"))
    edges = _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")).filter("src % 6 <> 5")
    return op.layers(nodes, edges, nodes.filter("node = 1"))


def tree_path(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("label"))
    return op.tree_paths(r.unionByName(n).unionByName(c))


def _cases(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), (F.col("l_partkey") % 400).alias("item"))


def cooccurrence(spark, d):
    return op.pair_counts(_cases(spark, d), "case", "item")


def top_partners(spark, d):
    return op.partners(op.pair_counts(_cases(spark, d), "case", "item"), 6)


def never_paired(spark, d):
    """Parts no order holds together, but those that come along with what is; a part brings that of twice its number."""
    edges = table(spark, d, "part").select((F.col("p_partkey") % 400).alias("src")).distinct().filter("src > 0 and src < 200").select("src", (F.col("src") * 2).alias("dst"))
    return op.never_paired(_cases(spark, d), "case", "item", 8, edges)


def entity_merge(spark, d):
    t = table(spark, d, "documents")
    title = F.regexp_replace(F.lower(F.element_at(F.split("text", "\n"), 1)), "[^a-z0-9]", "")
    records = t.select("doc_id", F.md5("text").alias("doi"), F.when(F.length(title) > 20, title).alias("title"))
    return op.merge_records(records, "doc_id", ["doi", "title"])


def html_extract(spark, d):
    """Title and body of each page; SQL can't parse them."""
    ship(spark)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, PAGES):
                batch = whole.slice(i, PAGES)
                found = [extract(h) for h in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["page_id", "title", "body"])

    return table(spark, d, "pages").select("page_id", "html").mapInArrow(run, "page_id long, title string, body string")


def html_meta(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract("html", '<meta charset="([^"]*)"', 1).alias("charset"), meta_content("html", "description").alias("description"))


def parse_verdict(spark, d):
    c = table(spark, d, "conversations")
    word = F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "REVISE"))), (F.col("conv_id") % 3 + 1).cast("int"))
    text = F.when(F.col("turn") == 0, F.concat(F.lit("# Review\n## Verdict\n"), word, F.lit("\nmore"))).when(F.col("turn") == 1, F.concat(F.lit("notes\nVerdict: **"), word, F.lit("**"))).when(F.col("turn") == 2, F.concat(word, F.lit(" as it stands"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", verdict(text).alias("verdict"))


def verdict(text):
    """A verdict under a heading, after `verdict:`, or as the first word; else UNKNOWN."""
    words = "(PASS|FAIL|REVISE)"
    found = [F.regexp_extract(text, rf"(?i)#+ *verdict\s*\n\W*{words}\b", 1), F.regexp_extract(text, rf"(?i)\bverdict: *\W*{words}\b", 1), F.regexp_extract(text, rf"^\W*{words}\b", 1)]
    return F.upper(F.coalesce(*[F.when(x != "", x) for x in found], F.lit("UNKNOWN")))


def page_text(spark, d):
    """Texts in pages of 6000 characters, with where the next begins."""
    size = 6000
    t = table(spark, d, "documents").select("doc_id", "text", F.char_length("text").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(size))
    pages = t.select("doc_id", "n", F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.md5(F.substring("text", s + 1, F.lit(size))).alias("digest")))).alias("p"))
    return pages.select("doc_id", F.col("p.at").alias("at"), F.col("p.digest").alias("digest"), F.when(F.col("p.at") + size < F.col("n"), F.col("p.at") + size).alias("next"))


def events_tumbling(spark, d):
    return monitors.run(monitors.tumbling(monitors.event_stream(spark, f"{d}/events*.parquet")), "tumbling", "complete").withColumn("mean", F.round("mean", 6))


def events_session(spark, d):
    return monitors.run(monitors.sessions(monitors.event_stream(spark, f"{d}/events*.parquet")), "sessions")


def events_dedup(spark, d):
    return monitors.run(monitors.first_of_hour(monitors.event_stream(spark, f"{d}/events*.parquet")), "dedup")


def _in_slices(spark, d, name, build, n=3):
    """Runs a stream over events that come in slices: each slice is written, and the stream goes on from its checkpoint."""
    e = table(spark, d, "events")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    place = scratch(spark, name)
    for i in range(n):
        cuts = [low + (high + 1 - low) * k // n for k in (i, i + 1)] if high is not None else [0, 0]
        e.filter((F.col("event_id") >= cuts[0]) & (F.col("event_id") < cuts[1])).write.mode("append").parquet(f"{place}/in")
        out = monitors.run(build(monitors.event_stream(spark, f"{place}/in", 1000)), name, place=place)
    return out


def stream_change(spark, d):
    return _in_slices(spark, d, "changes", keyed.changes)


def stream_dup_monitor(spark, d):
    """Users who repeat an event of the same type and value class: told at the third repeat, and once more after three others and a minute."""
    classed = lambda e: e.withColumn("class", F.floor(F.col("value") / 10))
    told = _in_slices(spark, d, "duplicates", lambda e: keyed.duplicate_monitor(classed(e), "user_id", ["event_type", "class"], "ts", ("event_id",)))
    return told.select("user_id", "n_duplicate", F.round(F.col("at") * 1e6).cast("long").alias("at_us"))


def stream_stall(spark, d):
    """Users silent for more than twenty minutes, by event-time timers."""
    return _in_slices(spark, d, "stalls", lambda e: keyed.stalls(e, "user_id", "ts", 1200.0))


def budget_bands(spark, d):
    return monitors.bands(table(spark, d, "events"), "user_id", "event_id", 50)


QUERIES = {f.__name__: f for f in (transitive_closure, bfs_layers, tree_path, cooccurrence, top_partners, never_paired, entity_merge, html_extract, html_meta, parse_verdict, page_text, events_tumbling, events_session, events_dedup, stream_change, stream_dup_monitor, stream_stall, budget_bands)}

_E = "e AS (SELECT CAST(c_custkey AS BIGINT) AS src, CAST(c_custkey // 2 AS BIGINT) AS dst FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 0 AND c_custkey % 5 = 0)"
_C = "c AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 400 AS item FROM lineitem), pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM c x JOIN c y ON x.k = y.k AND x.item < y.item GROUP BY 1, 2)"
SQL = {
    "transitive_closure": f"WITH RECURSIVE {_E}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, CAST(dst AS BIGINT) AS dst FROM r",
    "bfs_layers": f"WITH RECURSIVE {_E}, r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS layer UNION SELECT e.src, layer + 1 FROM r JOIN e ON e.dst = r.node AND e.dst % 6 <> 5 WHERE layer < 60), m AS (SELECT node, min(layer) AS layer FROM r GROUP BY 1) SELECT CAST(c_custkey AS BIGINT) AS node, coalesce(layer, (SELECT max(layer) + 1 FROM m)) AS layer FROM customer LEFT JOIN m ON node = c_custkey",
    "tree_path": "SELECT 'r' || r_regionkey AS node, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || ' > ' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'c' || c_custkey, 2, r_name || ' > ' || n_name || ' > ' || c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "cooccurrence": f"WITH {_C} SELECT * FROM pairs",
    "top_partners": f"WITH {_C}, t AS (SELECT a AS item, b AS partner, n FROM pairs UNION ALL SELECT b, a, n FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, partner) AS rank FROM t) SELECT * FROM r WHERE rank <= 6",
    "never_paired": f"""WITH RECURSIVE {_C}, g AS (SELECT DISTINCT p_partkey % 400 AS src, p_partkey % 400 * 2 AS dst FROM part WHERE p_partkey % 400 > 0 AND p_partkey % 400 < 200), cl AS (SELECT src, dst FROM g UNION SELECT cl.src, g.dst FROM cl JOIN g ON cl.dst = g.src), k AS (SELECT item, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 8), i AS (SELECT DISTINCT item FROM c),
        u AS (SELECT a AS item, b AS other FROM pairs UNION SELECT b, a FROM pairs UNION SELECT item, item FROM i), f AS (SELECT * FROM u UNION SELECT u.item, cl.dst FROM u JOIN cl ON u.other = cl.src), x AS (SELECT i.item, k.item AS other, k.n FROM i CROSS JOIN k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.item = i.item AND f.other = k.item)), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, other) AS rank FROM x) SELECT * FROM r WHERE rank <= 6""",
    "stream_dup_monitor": """WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type, floor(value / 10) ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM x WHERE k > 1), f AS (SELECT user_id, n, t FROM r WHERE n = 3),
        g AS (SELECT r.user_id, min(r.n) AS n FROM r JOIN f USING (user_id) WHERE r.n >= 6 AND r.t - f.t >= 60000000 GROUP BY 1)
        SELECT user_id, n AS n_duplicate, t AS at_us FROM f UNION ALL SELECT user_id, n, t FROM g JOIN r USING (user_id, n)""",
    "stream_stall": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), n AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS after FROM e)
        SELECT user_id, t AS since_ms FROM n WHERE after - t > 1200000 UNION ALL SELECT user_id, t FROM n WHERE after IS NULL AND t + 1200000 <= (SELECT max(t) - 600000 FROM e)""",
    "entity_merge": """WITH RECURSIVE t AS (SELECT doc_id, md5(text) AS doi, regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]', '', 'g') AS title FROM documents),
        n AS (SELECT doc_id, 'd' || doi AS name FROM t UNION ALL SELECT doc_id, 't' || title FROM t WHERE length(title) > 20), m AS (SELECT name, min(doc_id) AS least FROM n GROUP BY 1),
        l AS (SELECT DISTINCT doc_id AS a, least AS b FROM n JOIN m USING (name)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT doc_id AS id, doc_id AS seen FROM t UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a) SELECT id AS doc_id, min(seen) AS cluster FROM r GROUP BY 1""",
    "html_meta": """SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, regexp_extract(html, '(?i)<meta\\s+name="description"\\s+content="([^"]*)"', 1) AS description FROM pages""",
    "parse_verdict": "SELECT conv_id, turn, CASE WHEN turn < 3 THEN ['PASS', 'FAIL', 'REVISE'][conv_id % 3 + 1] ELSE 'UNKNOWN' END AS verdict FROM conversations",
    "page_text": "SELECT doc_id, a AS \"at\", md5(substring(text, a + 1, 6000)) AS digest, CASE WHEN a + 6000 < length(text) THEN a + 6000 END AS next FROM documents, unnest(range(0, greatest(length(text), 1), 6000)) AS u(a)",
    "events_tumbling": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "events_session": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), a AS (SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM a WHERE end_us // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events)",
    "events_dedup": "SELECT DISTINCT user_id, event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour FROM events",
    "stream_change": "WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, event_type FROM l WHERE before IS DISTINCT FROM event_type",
    "budget_bands": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, n, CASE n WHEN 40 THEN 0.8 WHEN 50 THEN 1.0 ELSE 1.5 END AS band FROM n WHERE n IN (40, 50, 75)",
}
