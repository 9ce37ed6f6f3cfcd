"""Queries over documents, embeddings and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.columns import normal_title, slug, words
from tracemill.functions.scratch import exists, fingerprint, scratch, stored
from tracemill.functions.stem import STEP_2, STEP_3, STEP_4
from tracemill.operators import evalstats, harness, retrieval as op, spelling, symbols, textindex
from tracemill.sources.frames import PAPERS_SQL, papers, table

TERMS = ["the", "thation", "wh", "der", "que"]
DENSE = "embedding"


def _questions(spark, d):
    """Benchmark items as queries: all their tokens."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words("text").alias("terms"))


def _indexed(spark, d, name, docs, fields, stems=False, parts=1):
    """The index of documents by paper_id, in segments; one that this application has made of the same files is read again."""
    made = spark.sparkContext.__dict__.setdefault("_tracemill_indexes", {})
    key = (name, fingerprint(spark, f"{d}/documents.parquet"))
    if key not in made or not exists(spark, made[key]):
        path = scratch(spark, "index")
        for i in range(parts):
            textindex.add_segment(docs.filter(F.col("paper_id") % parts == i) if parts > 1 else docs, "paper_id", fields, path, stems)
        made[key] = path
    return textindex.read_index(spark, made[key])


def _text_index(spark, d):
    return _indexed(spark, d, "text", papers(spark, d).select("paper_id", words("text").alias("tokens")), {"tokens": 1.0})


def _bm25(spark, d, k):
    """The k best papers of each benchmark item by all its words."""
    return textindex.best(_text_index(spark, d), _questions(spark, d), k, key="paper_id")


#: Scores of fields: a question's words count once.
FIELDS = textindex.Scoring(1.2, 0.75, False, "classic")


def _fixed(spark, terms):
    return spark.range(1).select(F.lit(0).alias("query_id"), F.array(*map(F.lit, terms)).alias("terms"))


def tokenize(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(words("text"), " ").alias("tokens"))


def chunk_words(spark, d):
    return op.chunks(papers(spark, d), "paper_id", "text").select("paper_id", "chunk_id", "start", F.md5("chunk").alias("digest"))


def semi_fulltext(spark, d):
    p = papers(spark, d)
    return op.chunks(p, "paper_id", "text").join(p.filter("full_text").select("paper_id"), "paper_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("n_chunks"))


def bm25_rank(spark, d):
    return _bm25(spark, d, 10).select("query_id", "paper_id", F.round("score", 6).alias("score"), "rank")


def bm25_boosted(spark, d):
    docs = papers(spark, d).select("paper_id", "citations", words("text").alias("tokens"), words("title").alias("key"))
    q = _fixed(spark, TERMS)
    scored = op.bm25(docs, q, "paper_id", "tokens").join(docs.select("paper_id", "citations", "key"), "paper_id")
    boost = op.key_boost(scored, F.col("key"), F.array(*map(F.lit, TERMS)))
    out = scored.withColumn("score", op.citation_prior(F.col("score") * boost, F.col("citations")))
    return op.ranked(out, "query_id", "paper_id", 50).select("paper_id", F.round("score", 6).alias("score"), "rank")


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    return op.ranked(op.cosine(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), DENSE), "vec_id", DENSE, k=k), "query_id", "vec_id", k, digits=6)


def cosine_topk(spark, d):
    return _dense(spark, d, 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def rrf_fusion(spark, d):
    """Dense and lexical ranks of each query; benchmark item n is the text of the query of vector 20 n."""
    lexical = _bm25(spark, d, 40).select((F.col("query_id") * 20).alias("query_id"), F.col("paper_id").alias("vec_id"), "score", "rank")
    return op.ranked(op.fuse(_dense(spark, d, 40), lexical, "query_id", "vec_id", 1000), "query_id", "vec_id", 20, digits=12).select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


def overlap_rank(spark, d):
    q = F.array(*map(F.lit, TERMS))
    p = papers(spark, d).withColumn("score", op.overlap(q, [(words("title"), 3), (F.array("lang", "source"), 2), (words("text"), 1)]))
    return p.filter("score > 0").select("paper_id", "score")


#: A question in everyday words, and what stands for them in the parts' names.
ASKED, ALIASES = "how do I use the red gadgets of copper", {"gadgets": ("widget", "sprocket"), "redgadgets": ("spring",), "copper": ("brass",)}


def _symbols(spark, d):
    p = table(spark, d, "part")
    key = F.concat(F.lit("lib."), F.regexp_replace(F.lower("p_type"), " ", "_"), F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit("_"), "p_partkey")
    return p.select("p_partkey", key.alias("key"), F.lower("p_brand").alias("owner"), "p_type", F.concat_ws(" ", "p_brand", "p_name").alias("body"), F.when(F.col("p_partkey") % 3 == 0, "method").otherwise("class").alias("kind"), (F.col("p_partkey") % 10 == 0).alias("private"))


def tiered_rank(spark, d):
    out = symbols.tiered(_symbols(spark, d), ASKED, ALIASES, "key", "owner", "p_type", "body", "kind", "private")
    return out.select("p_partkey", F.round("score", 6).alias("score"))


def exact_resolve(spark, d):
    """Names as a reader types them: whole keys, last parts, and last parts behind another path."""
    s = _symbols(spark, d)
    leaf = F.element_at(F.split("key", "[.]"), -1)
    two = F.element_at(F.split("key", "[.]"), -2)
    asked = s.select(F.when(F.col("p_partkey") % 4 == 0, F.col("key")).when(F.col("p_partkey") % 4 == 1, leaf).when(F.col("p_partkey") % 4 == 2, F.concat_ws(".", F.lit("x.y"), two, leaf)).otherwise(F.concat(leaf, F.lit("_no"))).alias("name"))
    return symbols.resolved(s, asked, "key", "name")


def code_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(symbols.code_tokens("text")).alias("n_tokens"), F.md5(F.array_join(symbols.code_tokens("text"), " ")).alias("tokens"))


def field_bm25(spark, d):
    docs = papers(spark, d).select("paper_id", words("title").alias("title"), F.array("lang", "source").alias("tags"), words("text").alias("body"))
    found = textindex.best(_indexed(spark, d, "fields", docs, {"title": 8.0, "tags": 4.0, "body": 1.0}), _questions(spark, d), 10, FIELDS, key="paper_id", digits=6)
    return found.select("query_id", "paper_id", F.round("score", 5).alias("score"), "rank")


def fts_rank(spark, d):
    """Stems in title, second line and text, from an index of two segments."""
    lines = F.split("text", "\n")
    docs = papers(spark, d).select("paper_id", words("title").alias("title"), words(F.coalesce(F.get(lines, 1), F.lit(""))).alias("abstract"), words("text").alias("body"))
    found = textindex.best(_indexed(spark, d, "stems", docs, {"title": 8.0, "abstract": 4.0, "body": 1.0}, True, 2), _questions(spark, d), 10, FIELDS, key="paper_id", stems=True, digits=6)
    return found.select("query_id", "paper_id", F.round("score", 5).alias("score"), "rank")


def title_first(spark, d):
    """Papers whose title is the query stand before those that are ranked."""
    titles = papers(spark, d).select("paper_id", normal_title("title").alias("t"))
    q = papers(spark, d).groupBy(normal_title("title").alias("t")).agg(F.min("paper_id").alias("query_id")).filter("query_id % 20 = 0")
    scores = textindex.best(_text_index(spark, d), q.select("query_id", words("t").alias("terms")), 5, key="paper_id")
    return symbols.exact_first(scores, q.join(titles, "t"), "query_id", "paper_id", 5)


def did_you_mean(spark, d):
    """Words of the benchmark without their third letter, sought among the words of all documents."""
    vocabulary = papers(spark, d).select(F.explode(words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    asked = _questions(spark, d).select(F.explode("terms").alias("word")).select(F.concat(F.substring("word", 1, 2), F.substring("word", 4, 100)).alias("word"))
    return spelling.did_you_mean(asked, vocabulary)


def keyword_notes(spark, d):
    """Part types as keywords: every third question has one with a letter too many."""
    p = table(spark, d, "part").select("p_partkey", F.regexp_replace("p_type", " ", "-").alias("keyword"))
    asked = p.select("p_partkey", F.concat(F.lit("*"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("keyword"), F.lit("X"))).otherwise(F.col("keyword")), F.lit(" how to")).alias("query"))
    return spelling.keyword_notes(asked, p, "query", "keyword").distinct()


def title_gaps(spark, d):
    """Names of parts that no order has, for the first two words of every part's name."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    held = table(spark, d, "lineitem").filter("l_partkey % 3 > 0").select(F.col("l_partkey").alias("p_partkey"))
    asked = p.select(F.slice(F.split(F.lower("p_name"), " "), 1, 2).alias("terms")).distinct().withColumn("query", F.array_join("terms", " "))
    return spelling.gaps(p, held, asked, "p_partkey", "p_name", "query", "terms")


def match_count_rank(spark, d):
    return op.matches_per_size(papers(spark, d), "text", "th[aeiou]").filter("n_matches > 0").select("paper_id", "n_matches", F.round("per_thousand", 6).alias("per_thousand"))


def substring_context(spark, d):
    return op.line_hits(papers(spark, d), "paper_id", "text", "License")


def like_all_terms(spark, d):
    return papers(spark, d).filter(op.all_terms(F.col("text"), "the wh, tion")).select("paper_id")


def pool_scores(spark, d):
    chunked = op.chunks(papers(spark, d), "paper_id", "text").select(F.concat_ws("#", "paper_id", F.format_string("%04d", "chunk_id")).alias("cid"), "paper_id", words("chunk").alias("tokens"))
    scored = op.ranked(op.bm25(chunked, _fixed(spark, TERMS), "cid", "tokens"), "query_id", "cid", digits=6)
    scored = scored.withColumn("paper_id", F.element_at(F.split("cid", "#"), 1).cast("long"))
    out = op.pooled(scored, "query_id", "paper_id", "sum_norm")
    return out.select("paper_id", F.round("score", 5).alias("score"))


def norm_title(spark, d):
    return table(spark, d, "pages").select("page_id", normal_title(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


def derive_id(spark, d):
    return table(spark, d, "pages").select("page_id", slug("url").alias("id"))


def invert_index(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    index = b.groupBy("item_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("item_id", op.inverted(F.col("index")).alias("text"))


def corpus_drift(spark, d):
    """The profile of the English papers against that of the German ones."""
    of = lambda lang: op.profile(papers(spark, d).filter(F.col("lang") == lang), "text", "License")
    return op.drifted(of("en"), of("de")).withColumns({c: F.round(c, 6) for c in ("before", "now")})


def corpus_profile(spark, d):
    return op.profile(papers(spark, d), "text", "License").withColumn("prose", F.round("prose", 6))


def _gold(spark, d):
    """Documents that hold a benchmark passage."""
    return op.holders(papers(spark, d).select("paper_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), "paper_id", "text", "query_id", "passage")


def retrieval_metrics(spark, d):
    ranked = _bm25(spark, d, 5)
    scored = evalstats.metrics(ranked, _gold(spark, d), "query_id", "paper_id").withColumn("tier", F.concat(F.lit("t"), F.col("query_id") % 2))
    out = evalstats.summary(scored, "tier")
    return out.select("tier", "n_queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "rr")])


def retrieval_arms(spark, d):
    """Texts, titles, and chunks pooled by their best and by their sum, over all benchmark items that some text holds."""
    titles = papers(spark, d).select("paper_id", words("title").alias("title"))
    questions = _questions(spark, d)
    chunked = op.chunks(papers(spark, d), "paper_id", "text").select(F.concat_ws("#", "paper_id", F.format_string("%04d", "chunk_id")).alias("paper_id"), words("chunk").alias("tokens"))
    found = textindex.best(_indexed(spark, d, "chunks", chunked, {"tokens": 1.0}), questions, 50, key="cid", digits=6)
    found = stored(found.withColumn("score", F.round("score", 6)).withColumn("paper_id", F.element_at(F.split("cid", "#"), 1).cast("long")), "chunk-answers")
    pooled = lambda how: op.ranked(op.pooled(found, "query_id", "paper_id", how), "query_id", "paper_id", 5, digits=5)
    arms = {
        "text": lambda: harness.Answer("text", textindex.best(_text_index(spark, d), questions, 5, key="paper_id")),
        "title": lambda: harness.Answer("title", textindex.best(_indexed(spark, d, "titles", titles, {"title": 1.0}), questions, 5, key="paper_id")),
        "chunk_max": lambda: harness.Answer("chunk_max", pooled("max")),
        "chunk_sum": lambda: harness.Answer("chunk_sum", pooled("sum")),
    }
    gold = harness.checked(_gold(spark, d), papers(spark, d), "paper_id")
    out = harness.compared(harness.run_arms(arms, "query_id", "paper_id"), gold, "query_id", "paper_id", "text")
    return out.select("arm", "n_queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "rr")], "better", "worse", F.round("p_value", 9).alias("p_value"))


def gold_unreachable(spark, d):
    return _gold(spark, d).join(papers(spark, d).filter("full_text").select("paper_id"), "paper_id", "left_anti").select("query_id", "paper_id")


def mcnemar(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 37 < 2).alias("a"), (F.col("o_orderkey") % 41 < 3).alias("b")).withColumn("a", F.col("a"))
    return evalstats.mcnemar(o.filter("a or b"), "a", "b").withColumn("p_value", F.round("p_value", 9))


def wilson(spark, d):
    low, high = evalstats.wilson(F.col("hits"), F.col("n"))
    g = table(spark, d, "labels").groupBy("toxic").agg(F.sum("quality").alias("hits"), F.count("*").alias("n"))
    return g.select("toxic", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def pearson(spark, d):
    li = table(spark, d, "lineitem")
    return evalstats.pearson(li, "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("r", F.round("r", 6))


def bootstrap_ci(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("a"), (1.0 - F.col("toxic")).alias("b"))
    return evalstats.bootstrap_difference(lab, "a", "b", "doc_id")


QUERIES = {f.__name__: f for f in (tokenize, chunk_words, semi_fulltext, bm25_rank, bm25_boosted, cosine_topk, rrf_fusion, overlap_rank, tiered_rank, match_count_rank, substring_context, like_all_terms, pool_scores, norm_title, derive_id, invert_index, corpus_profile, corpus_drift, exact_resolve, code_tokens, field_bm25, fts_rank, did_you_mean, keyword_notes, title_gaps, title_first, retrieval_metrics, retrieval_arms, gold_unreachable, mcnemar, wilson, pearson, bootstrap_ci)}


def _words(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({c}, '\s+'), lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{N}}_\-]', '', 'g'))), lambda w: w <> '')"


_P = f"WITH {PAPERS_SQL}"
_CHUNKS = r"""w AS (SELECT paper_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM papers),
  chunks AS (SELECT paper_id, i AS chunk_id, i * 100 AS start, array_to_string(w[i * 100 + 1 : i * 100 + 150], ' ') AS chunk FROM w, unnest(range(0, (len(w) + 99) // 100)) AS u(i))"""
_QUESTIONS = f"q AS (SELECT item_id AS query_id, {_words('text')} AS terms FROM benchmark)"
_FIXED = "q AS (SELECT 0 AS query_id, [" + ", ".join(f"'{t}'" for t in TERMS) + "] AS terms)"


def _bm25_sql(docs: str, key: str, tag: str = "") -> str:
    """CTEs up to s(query_id, key, score) from q(query_id, terms) and `docs`(key, tokens); tag goes behind their names."""
    return f"""qt{tag} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY 1, 2),
  z{tag} AS (SELECT count(*) AS n, avg(len(tokens)) AS av FROM {docs}),
  pt{tag} AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(tokens) AS dl, unnest(tokens) AS term FROM {docs}) WHERE term IN (SELECT term FROM qt{tag}) GROUP BY 1, 2, 3),
  dfs{tag} AS (SELECT term, count(*) AS df FROM pt{tag} GROUP BY 1),
  s{tag} AS (SELECT query_id, {key}, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM pt{tag} JOIN dfs{tag} USING (term) JOIN qt{tag} USING (term), z{tag} GROUP BY 1, 2)"""


def _one_byte(c: str) -> str:
    """Lower-case words with a capital for each letter of two bytes: the engine's distance counts bytes."""
    return f"translate({c}, 'áàâäçéèêëíîïñóôöúùûüßœæãõìò', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _stems_sql(source: str) -> str:
    """CTEs up to stems(word, stem) of source(word): the stemmer's steps as patterns, one after another."""
    c, v = "[^aeiou]", "[aeiouy]"
    cs, vs = c + "[^aeiouy]*", v + "[aeiou]*"
    more0, more1, one, vowel, closed = f"^({cs})?{vs}{cs}", f"^({cs})?{vs}{cs}{vs}{cs}", f"^({cs})?{vs}{cs}({vs})?$", f"^({cs})?{v}", f"^{cs}{v}[^aeiouwxy]$"
    like = lambda w, p: f"regexp_matches({w}, '{p}')"
    cut = lambda n: f"left(w, length(w) - {n})"

    def swap(table: dict[str, str]) -> str:
        suffix = lambda: "regexp_extract(w, '^.+?(" + "|".join(table) + ")$', 1)"
        to = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
        rest = f"left(w, length(w) - length({suffix()}))"
        return f"CASE WHEN {suffix()} <> '' AND {like(rest, more0)} THEN {rest} || CASE {suffix()} {to} END ELSE w END"

    off = "regexp_extract(w, '^.+?(" + "|".join(x for x in STEP_4 if x != "ion") + ")$', 1)"
    kept = f"left(w, length(w) - length({off}))"
    steps = [
        f"CASE WHEN {like('w', '^.+(ss|i)es$')} THEN {cut(2)} WHEN {like('w', '^.+[^s]s$')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN {like('w', '^.+eed$')} THEN CASE WHEN {like(cut(3), more0)} THEN {cut(1)} ELSE w END WHEN {like('w', '^.+ed$')} AND {like(cut(2), vowel)} THEN {cut(2)} || '+' WHEN {like('w', '^.+ing$')} AND {like(cut(3), vowel)} THEN {cut(3)} || '+' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN {like('w', '(at|bl|iz)[+]$')} THEN {cut(1)} || 'e' WHEN length(w) > 2 AND w[-2] = w[-3] AND {like('w[-2]', '[^aeiouylsz]')} THEN {cut(2)} WHEN {like(cut(1), closed)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN {like('w', '^.+y$')} AND {like(cut(1), vowel)} THEN {cut(1)} || 'i' ELSE w END",
        swap(STEP_2), swap(STEP_3),
        f"CASE WHEN {off} <> '' THEN CASE WHEN {like(kept, more1)} THEN {kept} ELSE w END WHEN {like('w', '^.+[st]ion$')} AND {like(cut(3), more1)} THEN {cut(3)} ELSE w END",
        f"CASE WHEN {like('w', '^.+e$')} AND ({like(cut(1), more1)} OR {like(cut(1), one)} AND NOT {like(cut(1), closed)}) THEN {cut(1)} ELSE w END",
        f"CASE WHEN {like('w', 'll$')} AND {like('w', more1)} THEN {cut(1)} ELSE w END",
    ]
    out = [f"st0 AS (SELECT DISTINCT word, CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END AS w FROM {source} WHERE length(word) > 2 AND strlen(word) <= 64)"]
    out += [f"st{i} AS (SELECT word, {e} AS w FROM st{i - 1})" for i, e in enumerate(steps, 1)]
    return ", ".join(out) + f", stems AS (SELECT word, replace(w, 'Y', 'y') AS stem FROM st{len(steps)})"


def _docs_sql(source: str) -> str:
    return f"d AS (SELECT paper_id, {_words('text')} AS tokens FROM {source})"


_DOCS = f"d AS (SELECT paper_id, {_words('text')} AS tokens FROM papers)"
_COS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), vn AS (SELECT *, sqrt(list_dot_product(e, e)) + 1e-9 AS m FROM v),
  c AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / (a.m * b.m) AS score FROM vn a, vn b WHERE a.vec_id % 20 = 0)"""
_GOLD = "g AS (SELECT item_id AS query_id, paper_id FROM benchmark b JOIN papers p ON contains(p.text, b.text) AND b.text <> '')"
_OVER = "(SELECT list_distinct([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS t)"
_SYMBOLS = "sy AS (SELECT p_partkey, 'lib.' || replace(lower(p_type), ' ', '_') || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS key, replace(p_name, ' ', '_') || '_' || p_partkey AS leaf, lower(p_brand) AS owner, lower(p_type) AS s, lower(p_brand || ' ' || p_name) AS b, p_partkey % 3 <> 0 AS other, p_partkey % 10 = 0 AS private FROM part)"


def _tiered_sql() -> str:
    """The score of the question's words, term by term."""
    tokens, stand_in = ["red", "gadgets", "copper"], {"widget": "gadgets", "sprocket": "gadgets", "brass": "copper", "spring": "red"}
    name = lambda t: f"(list_contains(names, '{t}')" + (f" OR len(list_filter(names, lambda n: length(n) >= 4 AND (contains(n, '{t}') OR contains('{t}', n)))) > 0)" if len(t) > 3 else ")")
    text = lambda t, c: f"(contains({c}, '{t}')" + (f" OR contains({c}, '{t.rstrip('s')}'))" if len(t) > 4 else ")")
    hits = lambda test: " + ".join([*[f"CAST({test(t)} AS INTEGER)" for t in tokens], *[f"0.6::DOUBLE * CAST({test(t)} AS INTEGER)" for t in stand_in]])
    covered = " + ".join("CAST(" + " OR ".join(f"{name(w)} OR {text(w, 's')}" for w in [t, *[a for a, o in stand_in.items() if o == t]]) + " AS INTEGER)" for t in tokens)
    score = f"(60 * ({hits(name)}) + 12 * ({hits(lambda t: text(t, 's'))}) + 2 * ({hits(lambda t: text(t, 'b'))})) * (0.35 + 0.65 * ({covered}) / 3.0::DOUBLE)"
    return f"WITH {_SYMBOLS}, n AS (SELECT *, list_filter(list_distinct(list_concat(string_split(replace(leaf, '_', ' '), ' '), string_split(replace(list_last(string_split(owner, '.')), '_', ' '), ' '))), lambda x: x <> '') AS names FROM sy), x AS (SELECT p_partkey, {score} * CASE WHEN private THEN 0.15 ELSE 1 END * CASE WHEN other THEN 1.15 ELSE 1 END AS score FROM n) SELECT p_partkey, round(CAST(score AS DOUBLE), 6) AS score FROM x WHERE score > 0"


SQL = {
    "tokenize": f"SELECT item_id, array_to_string({_words('text')}, ' ') AS tokens FROM benchmark",
    "chunk_words": f"{_P}, {_CHUNKS} SELECT paper_id, chunk_id, start, md5(chunk) AS digest FROM chunks",
    "semi_fulltext": f"{_P}, {_CHUNKS} SELECT paper_id, count(*) AS n_chunks FROM chunks WHERE paper_id IN (SELECT paper_id FROM papers WHERE full_text) GROUP BY 1",
    "bm25_rank": f"{_P}, {_QUESTIONS}, {_DOCS}, {_bm25_sql('d', 'paper_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) - 1 AS rank FROM s) SELECT query_id, paper_id, round(score, 6) AS score, rank FROM r WHERE rank < 10",
    "bm25_boosted": f"{_P}, {_FIXED}, {_DOCS}, {_bm25_sql('d', 'paper_id')}, x AS (SELECT query_id, paper_id, score * (1 + 1.5 * len(list_intersect((SELECT terms FROM q), {_words('title')})) / CAST(greatest(len(list_distinct({_words('title')})), 1) AS DOUBLE)) * (1 + log10(citations + 1)) AS score FROM s JOIN papers USING (paper_id)), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, paper_id) - 1 AS rank FROM x) SELECT paper_id, round(score, 6) AS score, rank FROM r WHERE rank < 50",
    "cosine_topk": f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) - 1 AS rank FROM c) SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank < 10",
    "rrf_fusion": f"{_P}, {_QUESTIONS}, {_DOCS}, {_bm25_sql('d', 'paper_id')}, {_COS}, dr AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) - 1 AS r FROM c), lr AS (SELECT query_id * 20 AS query_id, paper_id AS vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) - 1 AS r FROM s), f AS (SELECT query_id, vec_id, (2.0::DOUBLE / 3) / (60 + coalesce(a.r, 1000)) + (1.0::DOUBLE / 3) / (60 + coalesce(b.r, 1000)) AS score FROM (SELECT * FROM dr WHERE r < 40) a FULL JOIN (SELECT * FROM lr WHERE r < 40) b USING (query_id, vec_id)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) - 1 AS rank FROM f) SELECT query_id, vec_id, round(score, 9) AS score, rank FROM o WHERE rank < 20",
    "overlap_rank": f"{_P}, x AS (SELECT paper_id, 3 * len(list_intersect(t, {_words('title')})) + 2 * len(list_intersect(t, [lang, source])) + len(list_intersect(t, {_words('text')})) AS score FROM papers, {_OVER}) SELECT paper_id, score FROM x WHERE score > 0",
    "tiered_rank": _tiered_sql(),
    "exact_resolve": f"WITH {_SYMBOLS} SELECT CASE p_partkey % 4 WHEN 0 THEN key WHEN 1 THEN leaf ELSE 'x.y.' || string_split(key, '.')[-2] || '.' || leaf END AS name, key FROM sy WHERE p_partkey % 4 < 3",
    "code_tokens": f"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in symbols.STOP)})) AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM t",
    "field_bm25": f"""{_P}, {_QUESTIONS}, f AS (SELECT paper_id, {_words('title')} AS a, [lang, source] AS b, {_words('text')} AS c FROM papers), z AS (SELECT paper_id, len(a) + len(b) + len(c) AS dl FROM f), zz AS (SELECT count(*) AS n, avg(dl) AS av FROM z), qt AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM q),
        e AS (SELECT paper_id, 8.0::DOUBLE AS w, unnest(a) AS term FROM f UNION ALL SELECT paper_id, 4.0, unnest(b) FROM f UNION ALL SELECT paper_id, 1.0, unnest(c) FROM f), tf AS (SELECT paper_id, term, sum(w) AS tf FROM e WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        s AS (SELECT query_id, paper_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN z USING (paper_id), zz GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, paper_id) - 1 AS rank FROM s) SELECT query_id, paper_id, round(score, 5) AS score, rank FROM r WHERE rank < 10""",
    "fts_rank": f"""{_P}, {_QUESTIONS}, f AS (SELECT paper_id, {_words('title')} AS a, {_words("coalesce(string_split(text, chr(10))[2], '')")} AS b, {_words('text')} AS c FROM papers), z AS (SELECT paper_id, len(a) + len(b) + len(c) AS dl FROM f), zz AS (SELECT count(*) AS n, avg(dl) AS av FROM z),
        ew AS (SELECT paper_id, 8.0::DOUBLE AS w, unnest(a) AS word FROM f UNION ALL SELECT paper_id, 4.0, unnest(b) FROM f UNION ALL SELECT paper_id, 1.0, unnest(c) FROM f), qw AS (SELECT query_id, unnest(terms) AS word FROM q), aw AS (SELECT word FROM ew UNION SELECT word FROM qw), {_stems_sql('aw')},
        e AS (SELECT paper_id, w, coalesce(stem, word) AS term FROM ew LEFT JOIN stems USING (word)), qt AS (SELECT DISTINCT query_id, coalesce(stem, word) AS term FROM qw LEFT JOIN stems USING (word)), tf AS (SELECT paper_id, term, sum(w) AS tf FROM e WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        s AS (SELECT query_id, paper_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN z USING (paper_id), zz GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, paper_id) - 1 AS rank FROM s) SELECT query_id, paper_id, round(score, 5) AS score, rank FROM r WHERE rank < 10""",
    "did_you_mean": f"""{_P}, v AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM papers) GROUP BY 1), a AS (SELECT DISTINCT left(w, 2) || substring(w, 4) AS query FROM (SELECT unnest({_words('text')}) AS w FROM benchmark)),
        m AS (SELECT query, CASE WHEN length(query) < 3 OR length(query) > 40 THEN 0 WHEN length(query) < 6 THEN 1 ELSE 2 END AS most FROM a WHERE query NOT IN (SELECT word FROM v)),
        c AS (SELECT query, word, n, levenshtein({_one_byte('query')}, {_one_byte('word')}) AS distance FROM m JOIN v ON abs(length(query) - length(word)) <= most AND levenshtein({_one_byte('query')}, {_one_byte('word')}) <= most), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, n DESC, word) AS rank FROM c) SELECT query, rank, word, distance FROM r WHERE rank <= 3""",
    "keyword_notes": """WITH p AS (SELECT p_partkey, lower(replace(p_type, ' ', '-')) AS k, replace(p_type, ' ', '-') AS raw FROM part), a AS (SELECT DISTINCT '*' || raw || 'X how to' AS query, k || 'x' AS w FROM p WHERE p_partkey % 3 = 0), v AS (SELECT DISTINCT k FROM p),
        c AS (SELECT DISTINCT w, v.k, levenshtein(w, v.k) AS d FROM a JOIN v ON levenshtein(w, v.k) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY d, k) AS n FROM c), l AS (SELECT w, string_agg(k, ', ' ORDER BY n) AS near FROM r WHERE n <= 4 GROUP BY 1) SELECT query, 'no keyword *' || w || coalesce('; nearest: ' || near, '') AS note FROM a LEFT JOIN l USING (w)""",
    "title_gaps": """WITH g AS (SELECT DISTINCT p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 3 > 0)), w AS (SELECT p_name, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS ws FROM g), q AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1:2] AS ts FROM part),
        m AS (SELECT array_to_string(ts, ' ') AS query, p_name FROM q JOIN w ON list_has_all(ws, ts) WHERE len(list_distinct(ts)) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p_name) AS rank FROM m) SELECT query, p_name, rank FROM r WHERE rank <= 5""",
    "title_first": rf"""{_P}, t AS (SELECT paper_id, trim(regexp_replace(lower(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '*', '')), '\s+', ' ', 'g'), ' ') AS t FROM papers), qq AS (SELECT t, min(paper_id) AS query_id FROM t GROUP BY 1), q AS (SELECT query_id, t, {_words('t')} AS terms FROM qq WHERE query_id % 20 = 0), {_DOCS}, {_bm25_sql('d', 'paper_id')},
        x AS (SELECT query_id, paper_id, true AS exact, 0 AS score FROM q JOIN t USING (t) UNION ALL SELECT query_id, paper_id, false, round(score, 9) FROM s), o AS (SELECT query_id, paper_id, bool_or(exact) AS exact, max(score) AS score FROM x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE -score END, paper_id) - 1 AS rank FROM o) SELECT query_id, paper_id, exact, rank FROM r WHERE rank < 5""",
    "corpus_drift": f"""{_P}, l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM papers), m AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE len({_words('line')}) >= 5) / count(*) AS prose, count(*) FILTER (WHERE contains(line, 'License')) AS marked FROM l WHERE lang IN ('en', 'de') GROUP BY 1), c AS (SELECT lang, count(*) AS t FROM papers GROUP BY 1),
        w AS (SELECT lang, unnest(['n_texts', 'n_lines', 'prose', 'n_marked']) AS measure, unnest([CAST(t AS DOUBLE), n, prose, marked]) AS v FROM m JOIN c USING (lang)) SELECT a.measure, round(b.v, 6) AS before, round(a.v, 6) AS now, abs(a.v - b.v) > 0.5 * greatest(abs(b.v), 1e-9) AS drifted FROM w a JOIN w b USING (measure) WHERE a.lang = 'en' AND b.lang = 'de'""",
    "match_count_rank": f"{_P}, x AS (SELECT paper_id, len(regexp_extract_all(text, 'th[aeiou]')) AS n_matches, length(text) AS l FROM papers) SELECT paper_id, n_matches, round(n_matches * 1000.0::DOUBLE / greatest(l, 1), 6) AS per_thousand FROM x WHERE n_matches > 0",
    "substring_context": f"{_P}, l AS (SELECT paper_id, string_split(text, chr(10)) AS l FROM papers), h AS (SELECT paper_id, l, i - 1 AS line, l[i] AS hit FROM l, unnest(range(1, len(l) + 1)) AS u(i)) SELECT paper_id, line, hit, array_to_string(l[greatest(line, 1) : line + 2], chr(10)) AS context FROM h WHERE contains(lower(hit), 'license')",
    "like_all_terms": f"{_P} SELECT paper_id FROM papers WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%wh%' AND lower(text) LIKE '%tion%'",
    "pool_scores": f"{_P}, {_CHUNKS}, {_FIXED}, d AS (SELECT paper_id || '#' || printf('%04d', chunk_id) AS cid, {_words('chunk')} AS tokens FROM chunks), {_bm25_sql('d', 'cid')} SELECT CAST(string_split(cid, '#')[1] AS BIGINT) AS paper_id, round(sum(score) / sqrt(count(*)), 5) AS score FROM s GROUP BY 1",
    "norm_title": r"SELECT page_id, trim(regexp_replace(lower(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '*', '')), '\s+', ' ', 'g'), ' ') AS title FROM pages",
    "derive_id": "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') AS id FROM pages",
    "invert_index": "SELECT item_id, left(text, 400) AS text FROM benchmark",
    "corpus_profile": f"{_P}, l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM papers) SELECT (SELECT count(*) FROM papers) AS n_texts, count(*) AS n_lines, round(count(*) FILTER (WHERE len({_words('line')}) >= 5) / count(*), 6) AS prose, count(*) FILTER (WHERE contains(line, 'License')) AS n_marked FROM l",
    "retrieval_metrics": f"{_P}, {_QUESTIONS}, {_DOCS}, {_bm25_sql('d', 'paper_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) - 1 AS rank FROM s), {_GOLD}, m AS (SELECT query_id, 't' || CAST(query_id % 2 AS VARCHAR) AS tier, count(*) FILTER (WHERE rank < 1) / count(*) AS r1, count(*) FILTER (WHERE rank < 3) / count(*) AS r3, count(*) FILTER (WHERE rank < 5) / count(*) AS r5, coalesce(1 / (min(rank) + 1), 0) AS rr FROM g LEFT JOIN (SELECT * FROM r WHERE rank < 5) USING (query_id, paper_id) GROUP BY 1) SELECT coalesce(tier, 'all') AS tier, count(*) AS n_queries, round(avg(r1), 6) AS recall_1, round(avg(r3), 6) AS recall_3, round(avg(r5), 6) AS recall_5, round(avg(rr), 6) AS rr FROM m GROUP BY GROUPING SETS ((tier), ())",
    "retrieval_arms": f"""{_P}, {_CHUNKS}, {_QUESTIONS}, {_DOCS}, dt AS (SELECT paper_id, {_words('title')} AS tokens FROM papers), dc AS (SELECT paper_id || '#' || printf('%04d', chunk_id) AS cid, {_words('chunk')} AS tokens FROM chunks), {_bm25_sql('d', 'paper_id')}, {_bm25_sql('dt', 'paper_id', '_t')}, {_bm25_sql('dc', 'cid', '_c')}, {_GOLD},
        c50 AS (SELECT query_id, CAST(string_split(cid, '#')[1] AS BIGINT) AS paper_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, cid) AS n FROM s_c) WHERE n <= 50),
        a AS (SELECT 'text' AS arm, query_id, paper_id, round(score, 9) AS v FROM s UNION ALL SELECT 'title', query_id, paper_id, round(score, 9) FROM s_t UNION ALL SELECT 'chunk_max', query_id, paper_id, round(max(score), 5) FROM c50 GROUP BY 2, 3 UNION ALL SELECT 'chunk_sum', query_id, paper_id, round(sum(score), 5) FROM c50 GROUP BY 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY v DESC, paper_id) - 1 AS rank FROM a), wa AS (SELECT DISTINCT arm, g.* FROM g, (VALUES ('text'), ('title'), ('chunk_max'), ('chunk_sum')) n(arm)),
        m AS (SELECT arm, query_id, count(*) FILTER (WHERE rank < 1) / count(*) AS r1, count(*) FILTER (WHERE rank < 3) / count(*) AS r3, count(*) FILTER (WHERE rank < 5) / count(*) AS r5, coalesce(1 / (min(rank) + 1), 0) AS rr FROM wa LEFT JOIN (SELECT * FROM r WHERE rank < 5) USING (arm, query_id, paper_id) GROUP BY 1, 2),
        o AS (SELECT m.arm, count(*) AS n_queries, avg(m.r1) AS r1, avg(m.r3) AS r3, avg(m.r5) AS r5, avg(m.rr) AS rr, count(*) FILTER (WHERE m.r5 > b.r5) AS better, count(*) FILTER (WHERE m.r5 < b.r5) AS worse FROM m JOIN m b ON b.arm = 'text' AND b.query_id = m.query_id GROUP BY 1)
        SELECT arm, n_queries, round(r1, 6) AS recall_1, round(r3, 6) AS recall_3, round(r5, 6) AS recall_5, round(rr, 6) AS rr, better, worse, round(CASE WHEN better + worse = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(better, worse) + 1), lambda i: exp(lgamma(better + worse + 1) - lgamma(i + 1) - lgamma(better + worse - i + 1) - (better + worse) * ln(2.0))))) END, 9) AS p_value FROM o""",
    "gold_unreachable": f"{_P}, {_GOLD} SELECT query_id, paper_id FROM g WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE full_text)",
    "mcnemar": "WITH c AS (SELECT CAST(count(*) FILTER (WHERE o_custkey % 37 < 2 AND NOT o_orderkey % 41 < 3) AS INTEGER) AS only_a, CAST(count(*) FILTER (WHERE NOT o_custkey % 37 < 2 AND o_orderkey % 41 < 3) AS INTEGER) AS only_b FROM orders) SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))))) END, 9) AS p_value FROM c",
    "wilson": "WITH g AS (SELECT toxic, CAST(sum(quality) AS BIGINT) AS hits, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, hits, n, round(greatest(0, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS low, round(least(1, (hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS high FROM g",
    "pearson": "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1",
}
