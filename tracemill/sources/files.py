"""Scans of files: CSV stores, JSON lines, JSON documents, Markdown with front matter, and how much of them a listing shows."""

from __future__ import annotations

import csv
import io
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.columns import nan_to_null
from tracemill.functions.scratch import stored
from tracemill.functions.shipping import ship
from tracemill.operators.eventlog import parse_jsonl
from tracemill.sources.tail import opened

#: Where a store's rows are below its folder.
STORE_FILE = "experiment_data/output.csv"


def scan_csv(spark: SparkSession, path: str | list[str], types: dict[str, str], source: str | None = None) -> DataFrame:
    """A ledger in CSV: cells may hold line feeds and quotes; the named columns are cast, what can't be is null, others stay text, empty cells are null. `source` names a column for each row's file."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    # the path of the metadata is encoded as in URLs, where a plus stands for itself
    file = [] if source is None else [F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias(source)]
    return nan_to_null(raw.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns], *file))


def store_heads(spark: SparkSession, root: str) -> DataFrame:
    """path and header (names of columns) of each file of the stores at a root and in the folders below it; empty files are left out.

    Executors read the first record of each file, and nothing more of it.
    """
    ship(spark)
    found = [p for p in (f"{root}/{STORE_FILE}", f"{root}/*/{STORE_FILE}") if _exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"no store below {root}")
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(found).select("path")

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                system, inside = opened(quote(path, safe="/:@"))  # a URI
                with system.open_input_file(inside) as file, io.TextIOWrapper(file, "utf-8-sig", newline="") as text:
                    out.append(next(csv.reader(text), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["path", "header"])

    return paths.mapInArrow(run, "path string, header array<string>").filter(F.size("header") > 0)


def scan_stores(spark: SparkSession, root: str, types: dict[str, str], default: str = "default") -> DataFrame:
    """The rows of the store at a root and of every store in a folder below it, under `_namespace` (the folder's name).

    Stores are found by their files' place, so that a new one needs no
    registration; columns are taken by name, and what a store lacks is null.
    There is one scan for each header that occurs, however many stores share it.
    """
    heads = store_heads(spark, root).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()  # what a scan's file index holds
    top = rf"\Q{_folder(spark, root)}\E/(?:([^/]*)/)?{STORE_FILE}"
    found = []
    for head in heads:
        folder = F.regexp_extract("_file", top, 1)
        found.append(scan_csv(spark, head["paths"], types, "_file").withColumn("_namespace", F.when(folder == "", default).otherwise(folder)).drop("_file"))
    if not found:
        raise FileNotFoundError(f"no store below {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def namespaces(stores: DataFrame, named: DataFrame) -> DataFrame:
    """_namespace, n_rows, on_disk and in_config of the namespaces that have rows or are named by a configuration (column _namespace), so that neither hides one."""
    there = stores.groupBy("_namespace").agg(F.count("*").alias("n_rows"))
    said = named.filter(F.col("_namespace").isNotNull()).select("_namespace").distinct().withColumn("in_config", F.lit(True))
    out = there.join(said, "_namespace", "full")
    return out.select("_namespace", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNotNull().alias("on_disk"), F.coalesce("in_config", F.lit(False)).alias("in_config"))


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def scan_jsonl(spark: SparkSession, pattern: str, schema: T.StructType | str, source: str | None = None) -> DataFrame:
    """JSON lines of all files that match; blank and damaged lines are left out. `source` names a column for the part of the path that the pattern's * stands for."""
    lines = spark.read.text(pattern)
    if source:
        left, right = pattern.rpartition("/")[2].split("*")
        lines = lines.withColumn(source, F.regexp_extract("_metadata.file_path", rf"/{left.replace('.', '[.]')}([^/]*){right.replace('.', '[.]')}", 1))
    return parse_jsonl(lines, schema)


def strict(df: DataFrame, text: str, schema: T.StructType | str) -> DataFrame:
    """JSON texts as columns; a text that is damaged or lacks a field stops the job with that text."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = df.withColumn("_j", F.from_json(text, schema))
    whole = reduce(lambda a, b: a & b, [F.col(f"_j.{f.name}").isNotNull() for f in schema.fields])
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("_j")).otherwise(F.raise_error(F.concat(F.lit("not a whole entry: "), F.coalesce(F.col(text), F.lit("null")))))
    return parsed.withColumn("_j", checked).select(*[c for c in df.columns if c != text], *[F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields])


def entries(df: DataFrame, text: str, value: str) -> DataFrame:
    """A row for each member of JSON documents that are objects of objects: name and the fields of `value`; a damaged document has none."""
    parsed = df.withColumn("_m", F.from_json(text, f"map<string, struct<{value}>>"))
    return parsed.select(*[c for c in df.columns if c != text], F.explode("_m").alias("name", "_v")).select(*[c for c in df.columns if c != text], "name", "_v.*")


def newest(df: DataFrame, order: str, most: int = 400) -> DataFrame:
    """The last rows by `order`, newest first, each with the number of all rows."""
    total = df.agg(F.count("*").alias("n_total"))
    return df.orderBy(F.desc(order)).limit(most).join(F.broadcast(total))  # one row


def front_matter(df: DataFrame, text: str, name: str) -> DataFrame:
    """id, fields (a map) and body of Markdown texts: a block of `key: value` lines between two --- lines comes first.

    Without such a block the name is the id. Lists in brackets stay text; list_of() reads them.
    """
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\z)", 1)
    has = F.col(text).rlike(r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\z)")
    lines = F.filter(F.split(block, "\n"), lambda line: F.contains(line, F.lit(":")))
    pair = lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("v"))
    pairs = F.filter(F.transform(lines, pair), lambda p: p["k"] != "")
    # the first of a repeated key counts
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    fields = F.when(has, F.map_from_entries(first)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    out = df.withColumn("fields", fields).withColumn("body", F.regexp_replace(text, r"(?s)\A---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\z)", ""))
    return out.withColumn("id", F.coalesce(F.try_element_at("fields", F.lit("id")), F.col(name)))


def list_of(value: Column) -> Column:
    """Items of `[a, b]`; of other text, the text; null for null."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    return F.when(value.rlike(r"^\[.*\]$"), F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")).when(value.isNotNull(), F.array(value))


def commit_files(lines: DataFrame, line: str, group: str, order: str) -> DataFrame:
    """sha and its files, of logs with a line `commit <sha>` before the names: group, sha, files."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(group).orderBy(order)
    sha = F.last(F.when(F.col(line).rlike(r"^commit [0-9a-f]+$"), F.regexp_extract(line, r"^commit ([0-9a-f]+)$", 1)), True).over(w)
    named = lines.withColumn("sha", sha).filter(F.col("sha").isNotNull() & ~F.col(line).rlike(r"^commit [0-9a-f]+$") & (F.trim(line) != ""))
    return named.groupBy(group, "sha").agg(F.sort_array(F.collect_set(line)).alias("files"))


#: Endings of artifacts whose text may be read, and how a run's name begins.
READABLE = ("md", "tex", "py", "json", "txt", "csv", "yaml", "yml")
RUN_NAME = r"^\d{8}T\d{6}"


#: Folders of one level that a task lists.
FOLDERS = 256


def study_files(spark: SparkSession, study: str) -> DataFrame:
    """path (below the study), size and modified of all files of a study; contents are not read.

    Folders without files are not seen, nor are names that begin with _ or a
    dot, as Spark's own readers leave them out. The folders of each of the two
    top levels are listed in one task, all below them by many tasks.
    """
    ship(spark)

    def below(deep):
        def run(batches):
            system, top = opened(study)
            for batch in batches:
                rows = []
                for path in batch.column(0).to_pylist():
                    for f in system.get_file_info(fs.FileSelector(f"{top}/{path}".rstrip("/"), recursive=deep)):
                        at = f.path[len(top):].strip("/")
                        if not any(name[0] in "_." for name in at.split("/")):
                            rows.append((at, f.type == fs.FileType.Directory, f.size, f.mtime_ns // 1000))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["path", "folder", "size", "micros"])

        return run

    kinds = "path string, folder boolean, size long, micros long"
    first = stored(spark.range(1, numPartitions=1).select(F.lit("").alias("path")).mapInArrow(below(False), kinds), "study-level")
    second = stored(first.filter("folder").select("path").coalesce(1).mapInArrow(below(False), kinds), "study-level")
    folders = second.filter("folder").select("path")
    rest = folders.repartition(max(1, -(-folders.count() // FOLDERS))).mapInArrow(below(True), kinds)
    found = first.unionByName(second).unionByName(rest).filter("NOT folder")
    return stored(found.select("path", "size", F.timestamp_micros("micros").alias("modified")), "study-files")


def _folder(spark: SparkSession, path: str) -> str:
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")


def _below(spark: SparkSession, study: str, files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.regexp_extract("path", rf"\Q{_folder(spark, study)}/\E(.*)$", 1))


def runs(spark: SparkSession, study: str) -> DataFrame:
    """run_id, path, n_files and status of the runs of a study: folders of `runs` with files under `debug`.

    The status is that of debug/run_status.json, which a run writes when it
    ends; without it, or where it is damaged, the run is `running`.
    """
    found = study_files(spark, study).withColumn("run_id", F.regexp_extract("path", r"^runs/([^/]+)/debug/.", 1)).filter("run_id <> ''")
    each = found.groupBy("run_id").agg(F.count("*").alias("n_files"))
    ended = _below(spark, study, spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "run_status.json").load(study))
    told = ended.select(F.regexp_extract("path", r"^runs/([^/]+)/debug/run_status[.]json$", 1).alias("run_id"), F.get_json_object(F.col("content").cast("string"), "$.status").alias("_status"))
    return each.join(told.filter("run_id <> ''"), "run_id", "left").select("run_id", F.concat(F.lit("runs/"), "run_id").alias("path"), "n_files", F.coalesce("_status", F.lit("running")).alias("status"))


def artifacts(spark: SparkSession, study: str) -> DataFrame:
    """path, name, scope, run_id, owner, size, modified and readable of what a study's runs have made.

    Files of a run's debug/delegations/<owner> have the scope `run`. Files of
    other folders of `runs`, which all runs share, have the scope `shared` and
    no run_id. A folder named like a run is one even before it has a debug
    folder; its other files belong to neither.
    """
    files = study_files(spark, study).withColumn("_top", F.regexp_extract("path", r"^runs/([^/]+)/.", 1)).filter("_top <> ''")
    mine = F.regexp_extract("path", r"^runs/[^/]+/debug/delegations/([^/]+)/.", 1)
    is_run = files.filter(F.col("path").rlike(r"^runs/[^/]+/debug/.")).select("_top").distinct().withColumn("_run", F.lit(True))
    all_ = files.join(is_run, "_top", "left").withColumn("_run", F.coalesce("_run", F.col("_top").rlike(RUN_NAME))).withColumn("_mine", mine)
    kept = all_.filter(F.when(F.col("_run"), F.col("_mine") != "").otherwise(True))
    ending = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    return kept.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.when(F.col("_run"), "run").otherwise("shared").alias("scope"), F.when(F.col("_run"), F.col("_top")).alias("run_id"),
        F.when(F.col("_run"), F.col("_mine")).otherwise(F.col("_top")).alias("owner"), "size", "modified", ending.isin(*READABLE).alias("readable"),
    )


def resolved_path(path: Column, folder: str) -> Column:
    """A path below a folder with `.` and `..` followed; null where it leads out of the folder, or is null."""
    own = [p for p in folder.split("/") if p]
    start = F.when(F.startswith(path, F.lit("/")), F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, own)).cast("array<string>"))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # `..` above the top stays at the top
    step = lambda at, p: F.when(p == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, p))
    found = F.aggregate(parts, start, step)
    inside = (F.slice(found, 1, len(own)) == F.array(*map(F.lit, own)).cast("array<string>")) if own else F.lit(True)
    return F.when(inside & (F.size(found) > len(own)), F.array_join(F.slice(found, F.lit(len(own) + 1), F.size(found)), "/"))


def artifact_texts(spark: SparkSession, study: str, asked: DataFrame, path: str = "path") -> DataFrame:
    """asked with `text`, the text of each file below the study; null for paths that lead out of it, files that are missing and endings that are not text.

    Only the contents of files that are asked for and allowed go on; bytes that are no UTF-8 are replaced.
    """
    wanted = asked.withColumn("_at", resolved_path(F.col(path), _folder(spark, study)))
    wanted = wanted.withColumn("_at", F.when(F.lower(F.regexp_extract("_at", r"[^/]\.([^./]+)$", 1)).isin(*READABLE), F.col("_at")))
    files = _below(spark, study, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(study)).select(F.col("path").alias("_at"), "content")
    named = wanted.filter("_at IS NOT NULL").select("_at").distinct()
    texts = files.join(named, "_at", "left_semi").select("_at", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return wanted.join(texts, "_at", "left").drop("_at")


def corpus_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a corpus (chunks*.jsonl: paper_id, chunk_id, page, text) with what papers.csv says of their paper: title, year, citations and full_text.

    Chunks of papers that the list lacks stay, with no title and no full text;
    blank lines of chunks are left out; a blank citation count is 0, and only
    `true`, in any case, is full text.
    """
    kinds = {"paper_id": "string", "year": "int", "citation_count": "long"}
    told = scan_csv(spark, f"{folder}/papers.csv", kinds).select("paper_id", "title", "year", "citation_count", F.col("full_text").cast("string").alias("_full"))
    chunks = scan_jsonl(spark, f"{folder}/chunks*.jsonl", "paper_id string, chunk_id int, page int, text string")
    out = chunks.join(told, "paper_id", "left")
    return out.select("paper_id", "chunk_id", "page", "text", "title", "year", F.coalesce("citation_count", F.lit(0)).alias("citations"), F.coalesce(F.lower("_full") == "true", F.lit(False)).alias("full_text"))
