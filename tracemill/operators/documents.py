"""Structure in texts: trees of contents, notebooks, transcripts, headers, identifiers and listings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.shipping import ship

#: Documents whose tags are placed at a time.
TOGETHER = 256


def _placed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """key, node, parent, depth and tag (t) of the opening tags of documents: rows of key and all tags in order."""
    keys, lists = batch.columns
    t = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    opens = ~pc.starts_with(t, "</").to_numpy(zero_copy_only=False).astype(bool)
    alone = pc.ends_with(t, "/>").to_numpy(zero_copy_only=False).astype(bool)
    step = np.where(alone, 0, np.where(opens, 1, -1))
    before = np.cumsum(step) - step
    at = np.flatnonzero(opens)
    row, depth = row[at], (before - before[np.searchsorted(row, row)])[at]
    node = np.arange(len(at)) - np.searchsorted(row, row)
    parents, was = [], -1
    for r, d, n in zip(row.tolist(), depth.tolist(), node.tolist()):
        if r != was:
            last, was = {}, r  # the last node of each depth so far
        parents.append(last.get(d - 1))
        last[d] = n
    numbers = [pa.array(node, pa.int32()), pa.array(parents, pa.int32()), pa.array(depth, pa.int32())]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *numbers, t.take(pa.array(at))], names=["key", "node", "parent", "depth", "t"])


def contents_tree(df: DataFrame, key: str, xml: str, tag: str = "topic") -> DataFrame:
    """key, node (number in the document), parent (null at the top), depth, title, href and fragment of nested elements of one tag.

    Only the tags' order and nesting count; titles and hrefs are attributes. A
    document is one row, so its tags are placed where it stands: nothing is shuffled or sorted.
    """
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                yield _placed(batch.slice(i, TOGETHER))

    part = F.regexp_extract_all(xml, F.lit(rf"(<{tag}\b[^>]*>|</{tag}>)"), 1)
    tags = df.filter(F.col(xml).isNotNull()).select(F.col(key).alias("key"), part.alias("tags"))
    placed = tags.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, node int, parent int, depth int, t string")
    attribute = lambda name: F.regexp_extract("t", rf'\b{name}="([^"]*)"', 1)
    href = attribute("href")
    out = placed.withColumn("_f", F.substring_index(href, "#", -1))
    fragment = F.when(F.contains(href, F.lit("#")), F.col("_f"))
    return out.select(F.col("key").alias(key), "node", "parent", "depth", attribute("title").alias("title"), F.substring_index(href, "#", 1).alias("href"), fragment.alias("fragment"))


def first_nodes(nodes: DataFrame, page: str, depth: str = "depth", node: str = "node", fragment: str = "fragment") -> DataFrame:
    """The shallowest node of each page that is no part of it, the first of equals."""
    return nodes.filter(F.col(fragment).isNull()).groupBy(page).agg(F.min_by(node, F.struct(depth, node)).alias(node))


def notebook_outputs(df: DataFrame, key: str, text: str, most: int = 4_000_000) -> DataFrame:
    """key, cell, kind, source, output (number), mime and content of notebooks in JSON; a cell without outputs has one row without them.

    Images of more than `most` characters are left out; a damaged notebook has no rows.
    """
    schema = "struct<cells: array<struct<cell_type: string, source: string, outputs: array<map<string, string>>>>>"
    cells = df.select(F.col(key), F.posexplode(F.from_json(text, schema)["cells"]).alias("cell", "c"))
    small = F.filter("c.outputs", lambda o: ~(F.coalesce(o["mime"], F.lit("")).startswith("image/") & (F.char_length(o["content"]) > most)))
    return cells.select(key, "cell", F.col("c.cell_type").alias("kind"), F.col("c.source").alias("source"), F.posexplode_outer(small).alias("output", "o")).select(key, "cell", "kind", "source", "output", F.col("o")["mime"].alias("mime"), F.col("o")["content"].alias("content"))


def flat_content(blocks: str | Column, kinds: tuple[str, ...] = ("text",)) -> Column:
    """Text of a result given as a list of blocks (kind, text): those of the kinds, a line each."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"].isin(*kinds)), lambda b: b["text"]), "\n")


def transcript(df: DataFrame, key: str, text: str, wanted: str) -> DataFrame:
    """Messages (position, role, content) of recorded conversations under one key, and whether anything was recorded.

    recorded is null where there is no record at all and false where the record
    lacks the key, each in one row without messages.
    """
    parsed = df.select(F.col(key), F.from_json(text, "map<string, array<struct<role: string, content: string>>>").alias("m"))
    own = parsed.select(key, F.when(F.col("m").isNotNull(), F.map_contains_key("m", F.lit(wanted))).alias("recorded"), F.try_element_at("m", F.lit(wanted)).alias("a"))
    return own.select(key, "recorded", F.posexplode_outer("a").alias("position", "x")).select(key, "recorded", "position", F.col("x.role").alias("role"), F.col("x.content").alias("content"))


def source_header(df: DataFrame, text: str) -> DataFrame:
    """Adds includes (quoted `.h` files, in order, each once), title (first line after `# `), events (names behind `event `) and doc (the first block comment)."""
    includes = F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*#include[ \t]+"([^"]+\.h)"'), 1))
    doc = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(?s)/\*\*?(.*?)\*/", 1), r"(?m)^[ \t]*\*?[ \t]*", ""), r"\A\s+|\s+\z", "")
    return df.withColumns({"includes": includes, "title": F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1)), "events": F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*event[ \t]+(\w+)"), 1)), "doc": doc})


def without_prefixes(df: DataFrame, path: str, prefixes: tuple[str, ...], title: str, boilerplate: str) -> DataFrame:
    """Rows whose path has none of the prefixes and whose title doesn't match the boilerplate pattern."""
    out = df.filter(~F.coalesce(F.col(title), F.lit("")).rlike(boilerplate))
    for p in prefixes:
        out = out.filter(~F.coalesce(F.col(path), F.lit("")).startswith(p))
    return out


def normal_id(text: str | Column) -> Column:
    """One form for an identifier: W numbers of work addresses, DOIs without `doi:` or address in lower case, arXiv ids under `ARXIV:` without version, else as it is."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    work = F.regexp_extract(c, r"(?i)^(?:https?://[^/]+/)?(W\d+)$", 1)
    doi = F.regexp_extract(c, r"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/\S+)$", 1)
    arxiv = F.regexp_extract(c, r"(?i)^(?:arxiv:\s*|https?://arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$", 1)
    return F.when(work != "", F.upper(work)).when(doi != "", F.lower(doi)).when(arxiv != "", F.concat(F.lit("ARXIV:"), arxiv)).otherwise(c)


#: What tells an error that may pass by itself.
TRANSIENT = ("timeout", "timed out", "rate limit", "429", "503", "overloaded", "connection reset", "temporarily unavailable")


def is_transient(message: str | Column) -> Column:
    """Whether an error's text tells that it may pass by itself; null texts don't. Status numbers count as whole words, not as part of a name."""
    c = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    out = F.lit(False)
    for t in TRANSIENT:
        out = out | (c.rlike(rf"(?<![a-z0-9_]){t}(?![a-z0-9_])") if t.isdigit() else F.contains(c, F.lit(t)))
    return out


def resolve_name(asked: str | Column, names: dict[str, str], synonyms: dict[str, str]) -> Column:
    """The known name meant: exactly, then without case, spaces, dashes and underscores, then by a synonym; null if there is none."""
    c = F.col(asked) if isinstance(asked, str) else asked
    plain = lambda s: "".join(ch for ch in s.lower() if ch not in " -_")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    key = F.regexp_replace(F.lower(c), r"[ \-_]", "")
    return F.coalesce(F.try_element_at(table(names), c), F.try_element_at(table({plain(k): v for k, v in names.items()}), key), F.try_element_at(table({plain(k): v for k, v in synonyms.items()}), key))


def summary_of(doc: str | Column) -> Column:
    """First paragraph of a docstring on one line, up to a blank line or a section's rule."""
    c = F.regexp_replace(F.coalesce(F.col(doc) if isinstance(doc, str) else doc, F.lit("")), r"\A\s+", "")
    return F.trim(F.regexp_replace(F.regexp_extract(c, r"(?s)\A(.*?)(?:\n[ \t]*\n|\n[^\n]*\n[ \t]*-{3,}|\z)", 1), r"\s+", " "))


def listing(papers: DataFrame, key: str, title: str, full: str) -> DataFrame:
    """A row of a Markdown table for each paper, with a tag for those with full text."""
    cell = F.replace(F.coalesce(F.col(title), F.lit("")), F.lit("|"), F.lit("\\|"))
    return papers.select(key, F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), cell, F.when(F.col(full), " | full text |").otherwise(" | |")).alias("line"))


def coverage(papers: DataFrame, full: str) -> DataFrame:
    """How many papers there are, how many have full text, and the share."""
    out = papers.agg(F.count("*").alias("n_papers"), F.count_if(F.col(full)).alias("n_full"))
    return out.withColumn("share", F.col("n_full") / F.greatest("n_papers", F.lit(1)))


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Every chunk with its vector by key, null where there is none, and whether it has one."""
    out = chunks.join(vectors.select(*key, vector), key, "left")
    return out.withColumn("has_vector", F.col(vector).isNotNull())


def grouped_processes(lines: DataFrame, group: str, pid: str, start: str) -> DataFrame:
    """Of each run the processes it registered: (pid, start) pairs in order of start, each once."""
    return lines.groupBy(group).agg(F.array_sort(F.collect_set(F.struct(F.col(start).alias("start"), F.col(pid).alias("pid")))).alias("processes"))


def cached_summaries(spans: DataFrame, cache: DataFrame, key: str, text: str, fallback: Column) -> DataFrame:
    """key, summary and hit: a span's cached summary by the hash of its text, else the fallback."""
    hashed = spans.withColumn("_hash", F.sha2(text, 256))
    known = cache.groupBy(F.col("hash").alias("_hash")).agg(F.min("summary").alias("_summary"))
    return hashed.join(known, "_hash", "left").select(key, F.coalesce("_summary", fallback).alias("summary"), F.col("_summary").isNotNull().alias("hit"))
