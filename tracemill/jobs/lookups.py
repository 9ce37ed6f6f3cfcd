"""Queries that look things up: retrieval by mode, consults, provider records, runs and their artifacts."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from tracemill.functions.columns import words
from tracemill.functions.scratch import scratch, stored
from tracemill.functions.shipping import ship
from tracemill.jobs.retrieval import _P, _QUESTIONS, _bm25_sql, _docs_sql, _indexed, _text_index, _words
from tracemill.operators import consult as op
from tracemill.sources import files
from tracemill.sources.frames import papers, table
from tracemill.sources.tail import opened


def _corpus(spark, d, vectors=True):
    """Papers with full text; every seventh has no vector."""
    full = papers(spark, d).filter("full_text").select("paper_id", "text")
    index = _indexed(spark, d, "full", full.select("paper_id", words("text").alias("tokens")), {"tokens": 1.0})
    e = table(spark, d, "embeddings").filter("vec_id % 7 <> 3").withColumnRenamed("vec_id", "paper_id")
    return op.Corpus(full, index, "paper_id", e if vectors else None)


def retrieval_modes(spark, d):
    """Each mode over a corpus with vectors, and `auto` and `hybrid` over one without; what it came to stands in each row."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") / 20).alias("query_id"), "embedding")
    q = stored(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words("text").alias("terms"), "text").join(e, "query_id", "left"), "questions")
    out = []
    for vectors, modes in ((True, op.MODES), (False, ("auto", "hybrid", "fuzzy"))):
        corpus = _corpus(spark, d, vectors)
        for mode in modes:
            chosen, rows = corpus.search(q, mode)
            if rows is None:
                rows = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("paper_id", "long"), ("score", "double"), ("rank", "int"))])
            told = {"vectors": vectors, "mode": mode, "resolved": chosen.resolved, "error": chosen.error}
            out.append(rows.select(*[F.lit(v).alias(c) for c, v in told.items()], F.round(F.lit(chosen.coverage).cast("double"), 6).alias("coverage"), "query_id", "paper_id", F.round("score", 9).alias("score"), "rank"))
    return reduce(lambda a, b: a.unionByName(b), out)


def consult_lookup(spark, d):
    """Items ask for the contents, for a paper by its id, or in words."""
    i = F.col("item_id")
    asked = F.when(i % 4 == 0, F.lit("  ")).when(i % 4 == 1, F.concat(F.lit(" "), i * 3)).otherwise(F.col("text"))
    asks = table(spark, d, "benchmark").select(i.alias("ask_id"), asked.alias("asked")).withColumn("terms", words("asked"))
    p = papers(spark, d).select("paper_id", "text", "title", "citations")
    corpus = op.Corpus(p, _text_index(spark, d), "paper_id")
    shown = F.concat_ws(" | ", "title", F.col("citations").cast("string"), F.md5("text"))
    return corpus.consult(asks, "ask_id", "asked", "terms", shown).withColumn("score", F.round("score", 6))


def passage_view(spark, d):
    """The best papers' first chunks, as a reader sees them."""
    from tracemill.operators.retrieval import chunks
    from tracemill.operators.textindex import best

    p = papers(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words("text").alias("terms"))
    hits = best(_text_index(spark, d), q, 5, key="paper_id").withColumn("chunk_id", F.lit(0))
    dated = p.withColumn("year", F.when(F.col("paper_id") % 3 > 0, 1990 + F.col("paper_id") % 30)).withColumn("citations", F.when(F.col("paper_id") % 5 > 0, F.col("citations")))
    return op.passages(hits, chunks(p, "paper_id", "text"), dated, "query_id", "paper_id", "chunk_id", "chunk").withColumn("score", F.round("score", 6))


def _titles(spark, d):
    k = F.col("paper_id")
    asked = F.when(k % 7 == 0, F.concat(F.lit("ti:"), "title")).when(k % 7 == 1, F.concat(F.lit('"'), "title", F.lit('"'))).when(k % 7 == 2, F.concat_ws(" AND ", "lang", "source")).when(k % 7 == 3, F.col("lang")).otherwise(F.col("title"))
    return papers(spark, d).select("paper_id", asked.alias("asked"))


def preprint_queries(spark, d):
    tries = op.preprint_queries(F.col("asked"))
    return _titles(spark, d).select("paper_id", F.posexplode(tries).alias("place", "query"))


def provider_records(spark, d):
    """Replies of two providers, damaged ones and errors among them, as records of one kind."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    number = F.format_string("%04d.%05d", k % 2000, k)
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.48550/ARXIV."), number)).when(k % 3 == 1, F.concat(F.lit("10.1000/X"), k.cast("string")))
    works = F.to_json(F.array(F.struct(F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("authors"), doi.alias("doi"), (k % 50).alias("cited_by_count"), F.col("p_type").alias("abstract"))))
    outside = F.struct(doi.alias("DOI"), F.when(k % 3 == 0, number).alias("ArXiv"))
    found = F.to_json(F.array(F.struct(F.concat(F.lit("S"), k).alias("paperId"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.split("p_name", " ").alias("authors"), outside.alias("externalIds"), (k % 50).alias("citationCount"), F.concat(F.lit("https://x/"), k).alias("pdf_url"))))
    reply = F.when(k % 4 < 2, works).otherwise(found)
    reply = F.when(k % 11 == 0, F.left(reply, F.lit(20))).when(k % 13 == 0, F.concat(F.lit("ERROR: limit "), k)).otherwise(reply)
    r = p.select("p_partkey", reply.alias("reply"))
    records = F.when(k % 4 < 2, op.works_records(F.col("reply"))).otherwise(op.papers_records(F.col("reply")))
    return r.select("p_partkey", op.reply_error(F.col("reply")).alias("error"), F.explode_outer(records).alias("r")).select("p_partkey", "error", "r.*")


#: Files of a study that a task writes.
PUT = 4096


def _study(spark, d):
    """A study's files, a run or a shared folder for each supplier."""
    ship(spark)
    root = scratch(spark, "study")
    k = F.col("s_suppkey")
    run = F.when(k % 5 == 4, F.concat(F.lit("ws_"), k)).otherwise(F.format_string("20240101T%06d", k))
    debug = lambda name, value: F.struct(F.concat(F.lit("debug/"), F.lit(name)).alias("at"), value.alias("value"))
    lists = [debug("delegation_log.jsonl", F.lit("{}")), debug("delegations/D001/result.json", F.concat(F.lit('{"name": "'), "s_name", F.lit('"}'))), debug("delegations/D001/sub/plot.png", F.lit("png")), debug("delegations/D002/Notes.MD", F.concat(F.lit("# "), "s_name"))]
    ended = F.when(k % 3 == 0, F.array(debug("run_status.json", F.lit('{"status": "done"}')))).when(k % 3 == 1, F.array(debug("run_status.json", F.lit('{"sta')))).otherwise(F.array().cast("array<struct<at string, value string>>"))
    plain = lambda name, value: F.struct(F.lit(name).alias("at"), value.alias("value"))
    made = F.when(k % 5 == 4, F.array(plain("proof.tex", F.col("s_name")), plain("sub/table.csv", F.concat(F.lit("a,"), k)))).when(k % 5 == 3, F.array(plain("config.yaml", F.lit("a: 1")))).otherwise(F.concat(F.array(*lists), ended))
    rows = table(spark, d, "supplier").select(F.explode(made).alias("f"), run.alias("run")).select(F.concat(F.lit("runs/"), "run", F.lit("/"), "f.at").alias("path"), "f.value")

    def put(batches):
        system, top = opened(root)
        for batch in batches:
            for path, value in zip(*(c.to_pylist() for c in batch.columns)):
                system.create_dir(f"{top}/{path}".rpartition("/")[0])
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.repartition(rows.count() // PUT + 1).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return root


def run_listing(spark, d):
    return files.runs(spark, _study(spark, d)).orderBy(F.desc("run_id"))


def artifact_listing(spark, d):
    return files.artifacts(spark, _study(spark, d)).drop("modified")


def artifact_text(spark, d):
    """Paths as a reader may send them: plain, with detours, out of the study, of other endings."""
    k = F.col("s_suppkey")
    run = F.format_string("20240101T%06d", k)
    here = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    asked = F.when(k % 6 == 0, here("runs/", run, "/debug/delegations/D001/result.json")).when(k % 6 == 1, here("runs/x/../", run, "/./debug/delegations/D002/Notes.MD")).when(k % 6 == 2, here("../../etc/", run, ".txt"))
    asked = asked.when(k % 6 == 3, here("runs/", run, "/debug/delegations/D001/sub/plot.png")).when(k % 6 == 4, here("/runs/", run, "/debug/run_status.json")).otherwise(here("runs/ws_", k, "/proof.tex"))
    return files.artifact_texts(spark, _study(spark, d), table(spark, d, "supplier").select(asked.alias("path")))


QUERIES = {f.__name__: f for f in (retrieval_modes, consult_lookup, passage_view, preprint_queries, provider_records, run_listing, artifact_listing, artifact_text)}


_MODES = f"""{_P}, f AS (SELECT * FROM papers WHERE full_text), {_QUESTIONS}, {_docs_sql('f')}, {_bm25_sql('d', 'paper_id')},
  fv AS (SELECT vec_id AS paper_id, embedding FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id IN (SELECT paper_id FROM f)), qv AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id * 20), c AS (SELECT query_id, paper_id, list_dot_product(a.e, b.e) / (a.m * b.m) AS score FROM (SELECT query_id, e, sqrt(list_dot_product(e, e)) + 1e-9 AS m FROM (SELECT query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM qv)) a, (SELECT paper_id, e, sqrt(list_dot_product(e, e)) + 1e-9 AS m FROM (SELECT paper_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM fv)) b),
  lr AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) - 1 AS r FROM s), dr AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, paper_id) - 1 AS r FROM c),
  x AS (SELECT query_id, paper_id, (2.0::DOUBLE / 3) / (60 + coalesce(a.r, 40)) + (1.0::DOUBLE / 3) / (60 + coalesce(b.r, 40)) AS score FROM (SELECT * FROM dr WHERE r < 40) a FULL JOIN (SELECT * FROM lr WHERE r < 40) b USING (query_id, paper_id)),
  h AS (SELECT 'hybrid' AS resolved, query_id, paper_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, paper_id) - 1 AS rank FROM x),
  t AS (SELECT 'substring' AS resolved, item_id AS query_id, paper_id, CAST(NULL AS DOUBLE) AS score, row_number() OVER (PARTITION BY item_id ORDER BY paper_id) - 1 AS rank FROM benchmark b JOIN f ON contains(lower(f.text), lower(b.text)) AND b.text <> ''),
  o AS (SELECT * FROM h UNION ALL SELECT 'bm25', query_id, paper_id, 1.0::DOUBLE / (60 + r), r FROM lr UNION ALL SELECT * FROM t), v AS (SELECT (SELECT count(*) FROM fv) / count(*) AS coverage FROM f),
  m AS (SELECT * FROM (VALUES (true, 'auto', 'hybrid', NULL), (true, 'hybrid', 'hybrid', NULL), (true, 'bm25', 'bm25', NULL), (true, 'substring', 'substring', NULL), (false, 'auto', 'bm25', NULL), (false, 'hybrid', NULL, 'hybrid needs vectors, and no text has one'), (false, 'fuzzy', NULL, 'unknown mode fuzzy')) m(vectors, mode, resolved, error))
  SELECT vectors, mode, m.resolved, error, CASE WHEN vectors THEN round(coverage, 6) END AS coverage, query_id, paper_id, round(score, 9) AS score, rank FROM m LEFT JOIN (SELECT * FROM o WHERE rank < 10) o USING (resolved), v WHERE m.error IS NOT NULL OR query_id IS NOT NULL"""

_TRIES = r"""w AS (SELECT paper_id, asked, list_filter(regexp_extract_all(lower(asked), '[A-Za-z0-9][A-Za-z0-9\-]*'), lambda w: NOT list_contains(['a', 'an', 'the', 'of', 'for', 'in', 'on', 'and', 'or', 'with', 'to', 'by', 'from', 'via', 'using', 'is', 'are', 'as', 'at'], w)) AS a FROM q),
  u AS (SELECT *, list_filter(a, lambda x, i: list_position(a, x) = i) AS ws FROM w), k AS (SELECT *, list_transform(list_sort(list_transform(ws, lambda x, i: {'l': -length(x), 'i': i, 'w': x}))[1 : greatest(2, CAST(ceil(len(ws) * 3 / 5) AS INTEGER))], lambda p: p.w) AS best FROM u),
  j AS (SELECT *, list_filter(ws, lambda x: list_contains(best, x)) AS fewer FROM k), a AS (SELECT paper_id, CASE WHEN regexp_matches(asked, '\b(?:all|ti|au|abs|co|jr|cat|rn|id):|\b(?:AND|OR|ANDNOT)\b|"') OR len(ws) < 2 THEN [asked]
  WHEN len(fewer) < len(ws) THEN ['all:' || array_to_string(ws, ' AND all:'), 'all:' || array_to_string(fewer, ' AND all:'), asked] ELSE ['all:' || array_to_string(ws, ' AND all:'), asked] END AS t FROM j)"""

_STUDY = """k AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 5 = 4 THEN 'ws_' || s_suppkey ELSE '20240101T' || printf('%06d', s_suppkey) END AS run FROM supplier),
  e AS (SELECT k, run, unnest(CASE WHEN k % 5 = 4 THEN [{'p': 'proof.tex', 'v': s_name}, {'p': 'sub/table.csv', 'v': 'a,' || k}] WHEN k % 5 = 3 THEN [{'p': 'config.yaml', 'v': 'a: 1'}]
    ELSE list_concat([{'p': 'debug/delegation_log.jsonl', 'v': '{}'}, {'p': 'debug/delegations/D001/result.json', 'v': '{"name": "' || s_name || '"}'}, {'p': 'debug/delegations/D001/sub/plot.png', 'v': 'png'}, {'p': 'debug/delegations/D002/Notes.MD', 'v': '# ' || s_name}],
      CASE k % 3 WHEN 0 THEN [{'p': 'debug/run_status.json', 'v': '{"status": "done"}'}] WHEN 1 THEN [{'p': 'debug/run_status.json', 'v': '{"sta'}] ELSE [] END) END) AS f FROM k),
  files AS (SELECT k, run, 'runs/' || run || '/' || f.p AS path, f.p AS p, f.v AS v FROM e)"""

SQL = {
    "retrieval_modes": _MODES,
    "consult_lookup": f"""{_P}, i AS (SELECT item_id AS ask_id, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(item_id * 3 AS VARCHAR) ELSE trim(text) END AS said FROM benchmark), en AS (SELECT ask_id, paper_id, title || ' | ' || citations || ' | ' || md5(text) AS shown FROM i JOIN papers ON said = CAST(paper_id AS VARCHAR)),
        q AS (SELECT ask_id AS query_id, {_words('said')} AS terms FROM i WHERE said <> '' AND ask_id NOT IN (SELECT ask_id FROM en)), {_docs_sql('papers')}, {_bm25_sql('d', 'paper_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) - 1 AS rank FROM s),
        l AS (SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS rank FROM papers ORDER BY paper_id LIMIT 100)
        SELECT query_id AS ask_id, 'search' AS kind, rank, paper_id, round(score, 6) AS score, CAST(NULL AS VARCHAR) AS shown FROM r WHERE rank < 10 UNION ALL SELECT ask_id, 'entry', 0, paper_id, NULL, shown FROM en UNION ALL SELECT ask_id, 'list', rank, paper_id, NULL, NULL FROM i, l WHERE said = ''""",
    "passage_view": f"""{_P}, {_QUESTIONS}, {_docs_sql('papers')}, {_bm25_sql('d', 'paper_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) - 1 AS rank FROM s), w AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM papers)
        SELECT query_id, paper_id, 0 AS chunk_id, round(score, 6) AS score, rank, '[' || (rank + 1) || '] ' || title || ' (' || CASE WHEN paper_id % 3 > 0 THEN CAST(1990 + paper_id % 30 AS VARCHAR) ELSE 'n.d.' END || '), ' || CASE WHEN paper_id % 5 > 0 THEN citations ELSE 0 END || ' citations' || chr(10) || array_to_string(ws[1:150], ' ') AS passage FROM r JOIN w USING (paper_id) WHERE rank < 5""",
    "preprint_queries": f"""{_P}, q AS (SELECT paper_id, CASE paper_id % 7 WHEN 0 THEN 'ti:' || title WHEN 1 THEN '"' || title || '"' WHEN 2 THEN lang || ' AND ' || source WHEN 3 THEN lang ELSE title END AS asked FROM papers), {_TRIES} SELECT paper_id, i - 1 AS place, t[i] AS query FROM a, unnest(range(1, len(t) + 1)) AS g(i)""",
    "provider_records": """WITH k AS (SELECT *, p_partkey AS k, p_partkey % 4 < 2 AS one, p_partkey % 11 = 0 OR p_partkey % 13 = 0 AS off, printf('%04d.%05d', p_partkey % 2000, p_partkey) AS num FROM part)
        SELECT p_partkey, CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'limit ' || k END AS error, CASE WHEN NOT off THEN p_name END AS title, CASE WHEN NOT off THEN p_size END AS year, CASE WHEN NOT off THEN CASE WHEN one THEN p_brand ELSE array_to_string(string_split(p_name, ' ')[1:3], ', ') END END AS authors,
        CASE WHEN NOT off THEN CASE k % 3 WHEN 0 THEN '10.48550/arxiv.' || num WHEN 1 THEN '10.1000/x' || k ELSE '' END END AS doi, CASE WHEN NOT off THEN CASE WHEN k % 3 = 0 THEN num ELSE '' END END AS arxiv, CASE WHEN NOT off THEN CASE WHEN one THEN 'W' ELSE 'S' END || k END AS work_id,
        CASE WHEN NOT off THEN k % 50 END AS citations, CASE WHEN NOT off THEN CASE WHEN one THEN '' ELSE 'https://x/' || k END END AS pdf_url, CASE WHEN NOT off THEN CASE WHEN one THEN p_type ELSE '' END END AS abstract FROM k""",
    "run_listing": f"WITH {_STUDY} SELECT run AS run_id, 'runs/' || run AS path, count(*) AS n_files, CASE WHEN k % 3 = 0 THEN 'done' ELSE 'running' END AS status FROM files WHERE k % 5 < 3 GROUP BY k, run",
    "artifact_listing": rf"""WITH {_STUDY} SELECT path, string_split(path, '/')[-1] AS name, CASE WHEN k % 5 = 4 THEN 'shared' ELSE 'run' END AS scope, CASE WHEN k % 5 < 4 THEN run END AS run_id, CASE WHEN k % 5 = 4 THEN run ELSE string_split(p, '/')[3] END AS owner, strlen(v) AS size, NOT ends_with(path, '.png') AS readable
        FROM files WHERE k % 5 = 4 OR starts_with(p, 'debug/delegations/')""",
    "artifact_text": f"""WITH {_STUDY}, a AS (SELECT s_suppkey AS k, '20240101T' || printf('%06d', s_suppkey) AS r FROM supplier), q AS (SELECT CASE k % 6 WHEN 0 THEN 'runs/' || r || '/debug/delegations/D001/result.json' WHEN 1 THEN 'runs/x/../' || r || '/./debug/delegations/D002/Notes.MD' WHEN 2 THEN '../../etc/' || r || '.txt'
        WHEN 3 THEN 'runs/' || r || '/debug/delegations/D001/sub/plot.png' WHEN 4 THEN '/runs/' || r || '/debug/run_status.json' ELSE 'runs/ws_' || k || '/proof.tex' END AS path FROM a) SELECT q.path, v AS text FROM q LEFT JOIN files f ON f.path = replace(replace(q.path, 'x/../', ''), '/./', '/') AND NOT ends_with(q.path, '.png')""",
}
