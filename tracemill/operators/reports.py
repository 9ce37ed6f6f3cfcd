"""Texts about runs: an index of what each delegation left, and post-mortems of runs that told nothing themselves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.shipping import ship
from tracemill.sources.tail import opened

#: Characters of an index that a reader is shown at once, files named for a delegation, and characters of its intent.
INLINE, FILES, INTENT = 6000, 8, 140
#: An entry has more than 40 characters, so that these are enough to fill INLINE.
ENTRIES = INLINE // 40


def intent(task: Column) -> Column:
    """The first line of a task that isn't blank, stripped; the end of a long one is cut."""
    first = F.regexp_replace(F.regexp_extract(F.coalesce(task, F.lit("")), r"([^\s][^\n]*)", 1), r"\s+$", "")
    return F.when(F.char_length(first) > INTENT, F.concat(F.left(first, F.lit(INTENT - 3)), F.lit("..."))).otherwise(first)


def latest(log: DataFrame, run: str, key: str, order: str) -> DataFrame:
    """The last row of each key; rows with `is_patch` carry no state and are passed over."""
    rows = log.filter(~F.coalesce("is_patch", F.lit(False)))
    kept = [c for c in rows.columns if c not in (run, key)]
    return rows.groupBy(run, key).agg(F.max_by(F.struct(*kept), order).alias("_r")).select(run, key, "_r.*")


def touched(files: DataFrame, commit: str, file: str) -> DataFrame:
    """Of each commit the first FILES of its files by name, as `named`, and how many it has; a commit of any size is never held whole."""
    names = files.select(commit, file).distinct()
    first = names.withColumn("_n", F.row_number().over(Window.partitionBy(commit).orderBy(file))).filter(F.col("_n") <= FILES)
    lists = first.groupBy(commit).agg(F.sort_array(F.collect_list(file)).alias("named"))
    return lists.join(names.groupBy(commit).agg(F.count("*").alias("n_files")), commit)


def entries(last: DataFrame, files: DataFrame, key: str, reports: str, commit: str = "commit") -> DataFrame:
    """last (to_node, status, task, deliverable, commit) with `entry`, three lines on each delegation; `files` is what touched() gives."""
    shown = F.array_join(F.transform("named", lambda f: F.concat(F.lit("delegations/"), f)), ", ")
    shown = F.when(F.col("n_files") > FILES, F.concat(shown, F.lit(", ... (+"), F.col("n_files") - FILES, F.lit(" more)"))).otherwise(shown)
    report = F.when(F.coalesce("deliverable", F.lit("")) != "", F.concat(F.lit(f"{reports}/"), key, F.lit(".md"))).otherwise("(none)")
    head = F.concat_ws(" | ", key, F.coalesce("to_node", F.lit("?")), F.coalesce("status", F.lit("?")), intent(F.col("task")))
    return last.join(files, commit, "left").withColumn("entry", F.concat(head, F.lit("\n  report: "), report, F.lit("\n  touched: "), F.coalesce(shown, F.lit("(no files)"))))


def evidence_blocks(listed: DataFrame, run: str, key: str, full: str = "evidence_index.md") -> DataFrame:
    """run, n_delegations and block: a run's entries by key, cut at a line where they have more than INLINE characters, with where the whole stands.

    Of each run only its first ENTRIES entries meet in a cell, however many it has.
    """
    first = listed.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(key))).filter(F.col("_n") <= ENTRIES)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "entry"))), lambda x: x["entry"]), "\n")
    texts = first.groupBy(run).agg(ordered.alias("_text"))
    sizes = listed.groupBy(run).agg(F.count("*").alias("n_delegations"), (F.sum(F.char_length("entry")) + F.count("*") - 1).alias("_size"))
    cut = F.concat(F.regexp_replace(F.left("_text", F.lit(INLINE)), r"\n[^\n]*\z", ""), F.lit(f"\n[... index truncated; full index: {full} ...]"))
    body = F.when(F.col("_size") > INLINE, cut).otherwise(F.col("_text"))
    return texts.join(sizes, run).select(run, "n_delegations", F.concat(F.lit("<evidence_index>\n"), body, F.lit("\n</evidence_index>")).alias("block"))


def write_reports(last: DataFrame, run: str, key: str, folder: str) -> int:
    """Writes each delegation's deliverable to folder/<run>/<key>.md and gives their number; a task that runs again writes the same files again."""
    ship(last.sparkSession)
    rows = last.filter(F.coalesce("deliverable", F.lit("")) != "").select(F.concat(F.lit("/"), run, F.lit("/"), key, F.lit(".md")).alias("path"), "deliverable")

    def put(batches):
        system, top = opened(folder)
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                system.create_dir(f"{top}{path}".rpartition("/")[0])
                with system.open_output_stream(f"{top}{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: A text that stands for one that was never told begins so, and so does its source.
SYNTHESIZED = "SYNTHESIZED:"


def post_mortems(last: DataFrame, diagnostics: DataFrame, told: DataFrame, run: str, key: str, role: str, reason: str, open_status: str) -> DataFrame:
    """run, source_id, role, flagged and text for each run that has no own entry of a role: the last state of its delegations, those still under review, and its diagnostics by type.

    told has run, role and source_id of the entries there are; synthesized ones
    don't count, so that a run gets one text however often this runs as long as
    its result is put in their place. diagnostics has run, error_type and type.
    A run's delegations make up one text.
    """
    own = told.filter((F.col("role") == role) & ~F.startswith(F.coalesce("source_id", F.lit("")), F.lit(SYNTHESIZED))).select(run).distinct()
    state = F.concat(F.coalesce("to_node", F.lit("None")), F.lit(":"), F.coalesce("status", F.lit("None")))
    each = last.join(own, run, "left_anti")
    states = each.groupBy(run).agg(F.sort_array(F.collect_list(F.concat(key, F.lit("="), state))).alias("_states"), F.sort_array(F.collect_list(F.when(F.col("status") == open_status, F.col(key)))).alias("_open"))
    kinds = diagnostics.select(run, F.coalesce("error_type", "type", F.lit("other")).alias("_kind")).groupBy(run, "_kind").agg(F.count("*").alias("_n"))
    tally = kinds.groupBy(run).agg(F.sort_array(F.collect_list(F.concat_ws("=", "_kind", "_n"))).alias("_kinds"))
    waiting = F.when(F.size("_open") > 0, F.concat(F.lit("Under review, never approved: "), F.array_join("_open", ", "), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit(f"## SYNTHESIZED, NOT FIRST-PERSON\n{reason}\nLast delegation states: "), F.array_join("_states", ", "), F.lit("\n"), waiting, F.lit("Diagnostics: "), F.coalesce(F.array_join("_kinds", ", "), F.lit("(none)")))
    return states.join(tally, run, "left").select(run, F.lit(f"{SYNTHESIZED}{role}").alias("source_id"), F.lit(role).alias("role"), F.lit(False).alias("flagged"), text.alias("text"))
