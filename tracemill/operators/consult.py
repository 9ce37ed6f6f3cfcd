"""Retrieval by mode with what it fell back to, lookups by id, list or search, and records of literature providers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.scratch import stored
from tracemill.operators import retrieval, textindex

#: The modes of retrieval.
MODES = ("auto", "hybrid", "bm25", "substring")


@dataclass(frozen=True)
class Choice:
    """What a mode comes to: the ranking used (None with an error), and the share of texts that have a vector (None if none has)."""

    mode: str
    resolved: str | None
    coverage: float | None
    error: str | None = None


def coverage(texts: DataFrame, vectors: DataFrame, key: str, vector: str) -> float | None:
    """Share of texts that have a vector; None where none has."""
    have = vectors.filter(F.col(vector).isNotNull()).select(key).distinct().withColumn("_has", F.lit(True))
    n, m = texts.select(key).join(have, key, "left").agg(F.count("*"), F.count("_has")).first()
    return m / n if m else None


def choose(mode: str, dense: float | None) -> Choice:
    """`auto` takes what there is; an explicit mode that lacks something is an error, never a silent fallback."""
    name = mode.strip().lower()
    if name not in MODES:
        return Choice(mode, None, dense, f"unknown mode {name}")
    if name == "hybrid" and dense is None:
        return Choice(mode, None, None, "hybrid needs vectors, and no text has one")
    if name == "auto":
        name = "bm25" if dense is None else "hybrid"
    return Choice(mode, name, dense)


@dataclass
class Corpus:
    """What can be searched: texts (key, text), their index, and vectors (key, vector; None without an embedder)."""

    texts: DataFrame
    index: DataFrame
    key: str
    vectors: DataFrame | None = None
    vector: str = "embedding"

    def covered(self) -> float | None:
        return None if self.vectors is None else coverage(self.texts, self.vectors, self.key, self.vector)

    def search(self, questions: DataFrame, mode: str = "auto", k: int = 10, depth: int = 40, query: str = "query_id", terms: str = "terms", text: str = "text") -> tuple[Choice, DataFrame | None]:
        """What the mode came to, and query, key, score and rank (from 0) of the k best texts; no rows' frame with an error.

        questions has an id, terms, the text itself and, where vectors are to
        be compared, the column `vector`. Ranks come from the `depth` best of
        each ranking; a text that one of them lacks stands at `depth` there. A
        text without a vector takes part in the lexical ranking alone.
        Substrings have no score; they come in order of their keys.
        """
        chosen = choose(mode, self.covered())
        if chosen.error:
            return chosen, None
        if chosen.resolved == "substring":
            lower = self.texts.select(self.key, F.lower("text").alias("_t"))
            found = retrieval.holders(lower, questions.select(query, F.lower(text).alias("_q")), self.key, "_t", query, "_q")
            order = Window.partitionBy(query).orderBy(self.key)
            ranked = found.withColumn("score", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(order) - 1)
            return chosen, ranked.filter(F.col("rank") < k).select(query, self.key, "score", "rank")
        lexical = textindex.best(self.index, questions.select(query, terms), depth, query=query, terms=terms, key=self.key)
        if chosen.resolved == "bm25":
            out = lexical.select(query, self.key, (1.0 / (retrieval.FUSION + F.col("rank"))).alias("score"), "rank")
            return chosen, out.filter(F.col("rank") < k)
        own = self.vectors.join(self.texts.select(self.key), self.key, "left_semi")
        near = retrieval.cosine(own, questions, self.key, self.vector, query, depth)
        dense = retrieval.ranked(near, query, self.key, depth, digits=6)
        return chosen, retrieval.ranked(retrieval.fuse(dense, lexical, query, self.key, depth), query, self.key, k, digits=12).select(query, self.key, "score", "rank")

    def consult(self, asks: DataFrame, ask: str, asked: str, terms: str, shown: Column, k: int = 10, most: int = 100) -> DataFrame:
        """ask, kind, rank and key, score and shown: blank text lists the contents (the `most` smallest keys), the key of a text opens it, all else searches (by words alone).

        shown is a column of texts, which an entry shows. The three answers
        are parts of one plan, each over its own asks.
        """
        said = F.regexp_replace(F.coalesce(F.col(asked), F.lit("")), r"^\s+|\s+$", "")
        every = stored(asks.select(ask, said.alias("_said"), terms), "asks")
        named = self.texts.select(self.key, F.col(self.key).cast("string").alias("_said"))
        entries = every.filter("_said <> ''").join(named, "_said")
        opened = entries.join(self.texts.withColumn("shown", shown).select(self.key, "shown"), self.key)
        opened = opened.select(ask, F.lit("entry").alias("kind"), F.lit(0).alias("rank"), self.key, F.lit(None).cast("double").alias("score"), "shown")

        first = self.texts.select(self.key).orderBy(self.key).limit(most)
        listing = first.agg(F.sort_array(F.collect_list(self.key)).alias("_keys"))  # one row of at most `most` keys
        listed = every.filter("_said = ''").join(F.broadcast(listing)).select(ask, F.posexplode("_keys").alias("rank", self.key))
        listed = listed.select(ask, F.lit("list").alias("kind"), "rank", self.key, F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("shown"))

        rest = every.filter("_said <> ''").join(entries.select(ask).distinct(), ask, "left_anti")
        found = textindex.best(self.index, rest.select(ask, terms), k, query=ask, terms=terms, key=self.key)
        hits = found.select(ask, F.lit("search").alias("kind"), "rank", self.key, "score", F.lit(None).cast("string").alias("shown"))
        return listed.unionByName(opened).unionByName(hits)


def passages(hits: DataFrame, chunks: DataFrame, papers: DataFrame, query: str, paper: str, chunk: str, text: str) -> DataFrame:
    """hits (query, paper, chunk, score, rank) with `passage`, what a reader is shown: place, title, year, citations and the chunk's text."""
    each = hits.join(chunks.select(paper, chunk, text), [paper, chunk]).join(papers.select(paper, "title", "year", "citations"), paper)
    head = F.concat(F.lit("["), F.col("rank") + 1, F.lit("] "), F.coalesce("title", F.lit("untitled")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("), "), F.coalesce("citations", F.lit(0)), F.lit(" citations"))
    return each.select(query, paper, chunk, "score", "rank", F.concat(head, F.lit("\n"), F.col(text)).alias("passage"))


#: Words that a query for preprints leaves out.
SMALL_WORDS = ("a", "an", "the", "of", "for", "in", "on", "and", "or", "with", "to", "by", "from", "via", "using", "is", "are", "as", "at")
#: What tells that a query is in the provider's own syntax already.
FIELDED = r'\b(?:all|ti|au|abs|co|jr|cat|rn|id):|\b(?:AND|OR|ANDNOT)\b|"'


def preprint_queries(text: Column) -> Column:
    """Queries to try in order: all words, the longest three fifths of them (at least two, in their order), the text as it is.

    Fielded queries and texts of fewer than two words are tried as they are.
    """
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  worked out once, however often it is used
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9][A-Za-z0-9\-]*)"), 1), lambda w: ~w.isin(*SMALL_WORDS)))
    joined = lambda ws: F.array_join(F.transform(ws, lambda w: F.concat(F.lit("all:"), w)), " AND ")

    def tries(words: Column) -> Column:
        keep = F.greatest(F.lit(2), F.ceil(F.size(words) * 3 / 5)).cast("int")
        # longest first; of equal length, the earlier one
        placed = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
        kept = F.array_sort(F.transform(F.slice(placed, F.lit(1), keep), lambda p: F.struct(p["i"], p["w"])))
        fewer = F.transform(kept, lambda p: p["w"])
        several = F.when(keep < F.size(words), F.array(joined(words), joined(fewer), text)).otherwise(F.array(joined(words), text))
        return F.when(text.rlike(FIELDED) | (F.size(words) < 2), F.array(text)).otherwise(several)

    return once(found, tries)


#: Fixed value: DOIs of preprints begin so, and their number follows.
PREPRINT_DOI = "10.48550/arxiv."


def works_records(reply: Column) -> Column:
    """Records of a reply that lists works with a flat DOI; a damaged reply has none."""
    kind = "array<struct<id string, title string, year int, authors string, doi string, cited_by_count long, pdf_url string, abstract string>>"
    doi = lambda w: F.lower(F.coalesce(w["doi"], F.lit("")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(_parsed(reply, kind), lambda w: F.struct(
        w["title"].alias("title"), w["year"].alias("year"), blank(w["authors"]).alias("authors"), doi(w).alias("doi"),
        F.when(F.startswith(doi(w), F.lit(PREPRINT_DOI)), F.substr(doi(w), F.lit(len(PREPRINT_DOI) + 1))).otherwise("").alias("arxiv"),
        F.replace(blank(w["id"]), F.lit("https://openalex.org/"), F.lit("")).alias("work_id"), w["cited_by_count"].alias("citations"), blank(w["pdf_url"]).alias("pdf_url"), blank(w["abstract"]).alias("abstract"),
    ))


def papers_records(reply: Column) -> Column:
    """Records of a reply whose papers have a map of outside ids and a list of authors, of whom three are named; a damaged reply has none."""
    kind = "array<struct<paperId string, title string, year int, authors array<string>, externalIds struct<DOI string, ArXiv string>, citationCount long, pdf_url string, abstract string>>"
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(_parsed(reply, kind), lambda p: F.struct(
        p["title"].alias("title"), p["year"].alias("year"), F.array_join(F.slice(F.coalesce(p["authors"], F.array().cast("array<string>")), 1, 3), ", ").alias("authors"), F.lower(blank(p["externalIds"]["DOI"])).alias("doi"),
        blank(p["externalIds"]["ArXiv"]).alias("arxiv"), blank(p["paperId"]).alias("work_id"), p["citationCount"].alias("citations"), blank(p["pdf_url"]).alias("pdf_url"), blank(p["abstract"]).alias("abstract"),
    ))


def _parsed(reply: Column, kind: str) -> Column:
    return F.coalesce(F.from_json(reply, kind), F.array().cast(kind))


def reply_error(reply: Column) -> Column:
    """The message of a reply that is an error; null for others."""
    return F.when(F.startswith(reply, F.lit("ERROR")), F.trim(F.regexp_replace(reply, r"^ERROR:? ?", "")))
