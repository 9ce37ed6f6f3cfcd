"""Queries about runs and arms: indexes of evidence, post-mortems, costs, and a corpus read from its files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.columns import words
from tracemill.functions.scratch import scratch, stored
from tracemill.jobs.retrieval import _GOLD, _P, _QUESTIONS, _bm25_sql, _docs_sql, _gold, _indexed, _questions, _text_index, _words
from tracemill.operators import harness, reports as op, retrieval, textindex
from tracemill.sources import files
from tracemill.sources.frames import LOG_SQL, log, papers, table

STATES = ("status", "to_node", "task", "deliverable", "commit")


def _delegations(spark, d, width=5):
    """Rows of delegations, patches among them; a run is all ids that begin alike."""
    r, k = log(spark, d), F.coalesce("k", F.lit(0))
    task = F.concat(F.lit("\n  "), F.repeat(F.lit("word "), (k % 40).cast("int")), "id", F.lit(" \nmore"))
    return r.select(
        F.left("id", F.lit(width)).alias("run"), "id", "pos", (k % 9 == 0).alias("is_patch"), "status", "to_node", task.alias("task"), F.when(k % 4 > 0, F.concat(F.lit("# report of "), "id", F.lit(" at "), "pos")).alias("deliverable"), F.concat(F.lit("c"), k % 7).alias("commit"), k.alias("k"),
    )


def _last(spark, d, width=5):
    return op.latest(_delegations(spark, d, width), "run", "id", "pos").select("run", "id", *STATES)


def evidence_index(spark, d):
    """A block on each run's delegations, as far as it is shown at once."""
    p = table(spark, d, "part").filter("p_partkey % 7 < 5 AND (p_partkey % 7 <> 2 OR p_partkey < 30)")
    made = op.touched(p.select(F.concat(F.lit("c"), F.col("p_partkey") % 7).alias("commit"), F.concat(F.lit("src/"), "p_partkey", F.lit(".py")).alias("file")), "commit", "file")
    return op.evidence_blocks(op.entries(_last(spark, d), made, "id", "reports"), "run", "id")


def evidence_reports(spark, d):
    """The report files that an index names, as they stand in the shared folder."""
    folder = scratch(spark, "reports")
    op.write_reports(_last(spark, d), "run", "id", folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract("path", r"([^/]+)[.]md$", 1).alias("id"), F.col("content").cast("string").alias("report"))


def post_mortem(spark, d):
    """Texts for the runs of which no planner has told anything."""
    rows = _delegations(spark, d, 6)
    failed = rows.filter("k % 5 = 0").select("run", F.when(F.col("k") % 2 == 0, F.concat(F.lit("E"), F.col("k") % 3)).alias("error_type"), F.when(F.col("k") % 3 == 0, F.col("status")).alias("type"))
    told = rows.filter("pos % 497 IN (17, 18)").select("run", F.when(F.col("pos") % 497 == 17, "planner").otherwise("critic").alias("role"), F.when(F.col("k") % 2 == 0, F.lit("SYNTHESIZED:planner")).otherwise("N1").alias("source_id"))
    return op.post_mortems(_last(spark, d, 6), failed, told, "run", "id", "planner", "The run ended before it was asked.", "error")


def arm_costs(spark, d):
    """Recall, lost evidence, hits and the cost of a hit of two arms over all items, labelled or not."""
    titles = papers(spark, d).select("paper_id", words("title").alias("title"))
    arms = {
        "text": lambda: harness.Answer("text", textindex.best(_text_index(spark, d), _questions(spark, d), 20, key="paper_id")),
        "title": lambda: harness.Answer("title", textindex.best(_indexed(spark, d, "titles", titles, {"title": 1.0}), _questions(spark, d), 20, key="paper_id")),
    }
    q = F.col("item_id")
    walls = table(spark, d, "benchmark").select(F.explode(F.array(F.lit("text"), F.lit("title"))).alias("arm"), q.alias("query_id"), ((q % 7 + 1) / 100).alias("_w")).select("arm", "query_id", F.when(F.col("arm") == "text", F.col("_w")).otherwise(F.col("_w") / 2).alias("wall"))
    out = harness.summary(harness.run_arms(arms, "query_id", "paper_id"), walls, _gold(spark, d), "query_id", "paper_id")
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("arm", "n")])


def corpus_scan(spark, d):
    """A corpus written as it is kept, a list of papers and lines of chunks, and read again; every ninth paper isn't listed."""
    root = scratch(spark, "corpus")
    p, k = papers(spark, d), F.col("paper_id")
    told = p.filter("paper_id % 9 <> 4").select(k, F.concat(F.lit('"'), "lang", F.lit('", of\n'), "source").alias("title"), F.when(k % 3 > 0, 1990 + k % 30).alias("year"), F.when(k % 4 > 0, F.col("citations")).alias("citation_count"), F.when(k % 5 == 0, "").when(F.col("full_text"), "True").otherwise("false").alias("full_text"))
    told.write.option("header", True).option("escape", '"').csv(f"{root}/papers.csv")
    made = retrieval.chunks(p, "paper_id", "text").select(F.col("paper_id").cast("string").alias("paper_id"), "chunk_id", (F.col("chunk_id") % 3 + 1).alias("page"), F.col("chunk").alias("text"))
    made.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/chunks.jsonl")
    out = stored(files.corpus_chunks(spark, root), "corpus-chunks")
    return out.withColumn("text", F.md5("text"))


QUERIES = {f.__name__: f for f in (evidence_index, evidence_reports, post_mortem, arm_costs, corpus_scan)}


def _last_sql(width: int = 5) -> str:
    return f"""{LOG_SQL}, e AS (SELECT left(id, {width}) AS run, id, pos, status, to_node, coalesce(k, 0) AS k FROM log), la AS (SELECT run, id, arg_max(e, pos) AS r FROM e WHERE k % 9 <> 0 GROUP BY 1, 2),
  l AS (SELECT run, id, r.status AS status, r.to_node AS to_node, r.pos AS pos, r.k AS k FROM la)"""


_METRICS = ", ".join(f"round(coalesce(avg(CASE WHEN gold > 0 THEN in{k} / gold END), 0), 6) AS recall_{k}, round(1 - coalesce(avg(CASE WHEN gold > 0 THEN in{k} / gold END), 0), 6) AS lost_{k}, round(avg(CASE WHEN best < {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{k}" for k in (5, 10, 20))

SQL = {
    "evidence_index": f"""WITH {_last_sql()}, pf AS (SELECT 'c' || (p_partkey % 7) AS c, 'src/' || p_partkey || '.py' AS f FROM part WHERE p_partkey % 7 < 5 AND (p_partkey % 7 <> 2 OR p_partkey < 30)), t AS (SELECT c, count(*) AS n, list_sort(list(f))[1:8] AS fs FROM pf GROUP BY 1),
        i AS (SELECT *, repeat('word ', k % 40) || id AS intent FROM l), en AS (SELECT run, id, id || ' | ' || to_node || ' | ' || status || ' | ' || CASE WHEN length(intent) > 140 THEN left(intent, 137) || '...' ELSE intent END || chr(10) || '  report: ' || CASE WHEN k % 4 > 0 THEN 'reports/' || id || '.md' ELSE '(none)' END || chr(10) || '  touched: '
        || coalesce(array_to_string(list_transform(fs, lambda x: 'delegations/' || x), ', ') || CASE WHEN n > 8 THEN ', ... (+' || (n - 8) || ' more)' ELSE '' END, '(no files)') AS entry FROM i LEFT JOIN t ON t.c = 'c' || (k % 7)), w AS (SELECT run, count(*) AS n_delegations, string_agg(entry, chr(10) ORDER BY id) AS f FROM en GROUP BY 1)
        SELECT run, n_delegations, '<evidence_index>' || chr(10) || CASE WHEN length(f) > 6000 THEN regexp_replace(left(f, 6000), '\\n[^\\n]*\\z', '') || chr(10) || '[... index truncated; full index: evidence_index.md ...]' ELSE f END || chr(10) || '</evidence_index>' AS block FROM w""",
    "evidence_reports": f"WITH {_last_sql()} SELECT run, id, '# report of ' || id || ' at ' || pos AS report FROM l WHERE k % 4 > 0",
    "post_mortem": f"""WITH {_last_sql(6)}, s AS (SELECT run, string_agg(id || '=' || to_node || ':' || status, ', ' ORDER BY id) AS states, string_agg(id, ', ' ORDER BY id) FILTER (WHERE status = 'error') AS o FROM l WHERE run NOT IN (SELECT run FROM e WHERE pos % 497 = 17 AND k % 2 <> 0) GROUP BY 1),
        d AS (SELECT run, CASE WHEN k % 2 = 0 THEN 'E' || (k % 3) WHEN k % 3 = 0 THEN status ELSE 'other' END AS kind, count(*) AS n FROM e WHERE k % 5 = 0 GROUP BY 1, 2), t AS (SELECT run, array_to_string(list_sort(list(kind || '=' || n)), ', ') AS t FROM d GROUP BY 1)
        SELECT run, 'SYNTHESIZED:planner' AS source_id, 'planner' AS role, false AS flagged, '## SYNTHESIZED, NOT FIRST-PERSON' || chr(10) || 'The run ended before it was asked.' || chr(10) || 'Last delegation states: ' || states || chr(10) || coalesce('Under review, never approved: ' || o || chr(10), '') || 'Diagnostics: ' || coalesce(t, '(none)') AS text FROM s LEFT JOIN t USING (run)""",
    "arm_costs": f"""{_P}, {_QUESTIONS}, {_docs_sql('papers')}, dt AS (SELECT paper_id, {_words('title')} AS tokens FROM papers), {_bm25_sql('d', 'paper_id')}, {_bm25_sql('dt', 'paper_id', '_t')}, {_GOLD}, a AS (SELECT 'text' AS arm, * FROM s UNION ALL SELECT 'title', * FROM s_t),
        r AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY round(score, 9) DESC, paper_id) - 1 AS rank FROM a), w AS (SELECT arm, item_id AS query_id, (item_id % 7 + 1) / 100 / f AS wall FROM benchmark, (VALUES ('text', 1), ('title', 2)) v(arm, f)),
        x AS (SELECT arm, query_id, min(wall) AS wall, count(g.paper_id) AS gold, min(rank) AS best, count(*) FILTER (WHERE rank < 5) AS in5, count(*) FILTER (WHERE rank < 10) AS in10, count(*) FILTER (WHERE rank < 20) AS in20 FROM w LEFT JOIN g USING (query_id) LEFT JOIN (SELECT * FROM r WHERE rank < 20) r USING (arm, query_id, paper_id) GROUP BY 1, 2)
        SELECT arm, count(*) AS n, round(avg(wall), 6) AS wall_mean, {_METRICS}, round(avg(CASE WHEN best < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(coalesce(1 / (best + 1), 0)), 6) AS rr, CASE WHEN count(*) FILTER (WHERE best < 10) > 0 THEN round(sum(wall) / count(*) FILTER (WHERE best < 10), 6) ELSE 'inf'::DOUBLE END AS cost_per_hit FROM x GROUP BY 1""",
    "corpus_scan": rf"""{_P}, w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM papers), k AS (SELECT *, paper_id AS k, paper_id % 9 <> 4 AS there FROM w)
        SELECT CAST(paper_id AS VARCHAR) AS paper_id, CAST(i AS INTEGER) AS chunk_id, CAST(i % 3 + 1 AS INTEGER) AS page, md5(array_to_string(w[i * 100 + 1 : i * 100 + 150], ' ')) AS text, CASE WHEN there THEN '"' || lang || '", of' || chr(10) || source END AS title, CASE WHEN there AND k % 3 > 0 THEN CAST(1990 + k % 30 AS INTEGER) END AS year,
        CASE WHEN there AND k % 4 > 0 THEN citations ELSE 0 END AS citations, there AND k % 5 <> 0 AND full_text AS full_text FROM k, unnest(range(0, (len(w) + 99) // 100)) AS u(i)""",
}
