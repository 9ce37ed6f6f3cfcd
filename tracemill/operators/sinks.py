"""Guarded writes: ledgers, logs and KPI tables in the folder that all executors share.

A table is a list of markers that name folders of rows. A write makes its own
folder and then puts the next marker, which one writer alone can: readers see
all of a write or nothing, writers at the same time don't lose each other's
rows, and a job that dies leaves the table as it was. An append writes its own
rows and reads none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.markers import Markers
from tracemill.operators.ledger import POOL_ID, POOL_SOURCE, store_guard

MARK = "markers"


class GuardError(ValueError):
    """A write that would lose rows."""


def _state(markers: list[dict]) -> tuple[list[str], T.StructType]:
    """Folders of a table after its markers, and its columns."""
    folders: dict[str, None] = {}
    schema = T.StructType()
    for m in markers:
        for f in m["drop"]:
            folders.pop(f)
        folders |= dict.fromkeys(m["add"])
        schema = T.StructType.fromJson(m["schema"])
    return list(folders), schema


def _widened(old: T.StructType, new: T.StructType) -> T.StructType:
    """Old columns and, behind them, new ones; all may be null. A column keeps its type."""
    kinds = {f.name: f.dataType for f in old}
    if other := [f.name for f in new if kinds.get(f.name, f.dataType) != f.dataType]:
        raise ValueError(f"columns of another type: {other}")
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*old, *[f for f in new if f.name not in kinds]]])


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows; None if there is no table."""
    markers = Markers(spark, f"{path}/{MARK}").all()
    return _rows(spark, path, *_state(markers)) if markers else None


def _rows(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str) -> str:
    folder = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def append(path: str, rows: DataFrame) -> DataFrame:
    """Adds rows; columns new to the table are null in its old rows, columns that the rows lack are null in them."""
    spark = rows.sparkSession
    folder, list_ = _write(rows, path), Markers(spark, f"{path}/{MARK}")
    while True:
        markers = list_.all()
        _, schema = _state(markers)
        wide = _widened(schema, rows.schema)
        if list_.put(len(markers), {"add": [folder], "drop": [], "schema": json.loads(wide.json())}):
            return read(spark, path)


def append_rows(path: str, fresh: DataFrame, keys: list[str], stamp: dict[str, Column], replace_stale: bool = False, status: str = "status") -> DataFrame:
    """Appends evaluated rows to a ledger, stamped and FINISHED; with replace_stale, in place of rows of equal keys.

    Only folders that hold such rows are written anew. The guard refuses a
    write after which the ledger has fewer rows, or rows that were FINISHED
    and no longer are. A write that another one has overtaken is made again.
    """
    rows = fresh.withColumns({**stamp, status: F.lit("FINISHED")})
    spark = rows.sparkSession
    list_ = Markers(spark, f"{path}/{MARK}")
    if not replace_stale:
        return append(path, rows)
    while True:
        markers = list_.all()
        if not markers:
            return append(path, rows)
        folders, schema = _state(markers)
        wide = _widened(schema, rows.schema)
        named = _rows(spark, path, folders, wide).withColumn("_folder", F.regexp_extract("_metadata.file_path", "/(rows-[0-9a-f]+)/[^/]+$", 1))
        stale = [r[0] for r in named.join(rows.select(*keys).distinct(), keys, "left_semi").select("_folder").distinct().collect()]  # at most as many as writes
        old = _rows(spark, path, stale, wide)
        new = old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True).select(*wide.names)
        verdict = store_guard(old, new, keys, status).first()
        if not verdict["allowed"]:
            raise GuardError(f"{verdict['n_new']} rows after {verdict['n_old']}, {verdict['n_unfinished']} no longer finished")
        if list_.put(len(markers), {"add": [_write(new, path)], "drop": stale, "schema": json.loads(wide.json())}):
            return read(spark, path)


def ingest_pool(path: str, pool: DataFrame, keys: list[str]) -> DataFrame:
    """Appends precomputed rows under the pool's id and source, which no statistics of evaluations count."""
    return append_rows(path, pool, keys, {"_delegation_id": F.lit(POOL_ID), "_source": F.lit(POOL_SOURCE)})


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; nothing that is there is touched."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def append_kpi(path: str, rows: DataFrame) -> DataFrame:
    """Adds rows to a KPI table; columns new to it are added to its old rows, empty, behind the old ones."""
    return append(path, rows)


def claim(notes: DataFrame, place: str, reader: str, number: str, most: int | None = None) -> DataFrame:
    """Notes that nobody has claimed, now the reader's: a range of their numbers, `most` numbers at most.

    Notes are numbered in the order in which they come. A claim is the next
    marker, so that of readers at the same time each note goes to one, who has it for good:
    claimed() finds it again after a restart.
    """
    list_ = Markers(notes.sparkSession, place)
    while True:
        markers = list_.all()
        low = markers[-1]["to"] if markers else None
        first, last = notes.agg(F.min(number), F.max(number)).first()
        if last is None or low is not None and last < low:
            return notes.limit(0)
        low = first if low is None else low
        high = last + 1 if most is None else min(last + 1, low + most)
        if list_.put(len(markers), {"from": low, "to": high, "reader": reader}):
            return notes.filter((F.col(number) >= low) & (F.col(number) < high))


def claimed(notes: DataFrame, place: str, number: str) -> DataFrame:
    """Claimed notes with their reader."""
    spark = notes.sparkSession
    rows = [(m["from"], m["to"], m["reader"]) for m in Markers(spark, place).all()]
    ranges = spark.createDataFrame(rows, "low long, high long, reader string")
    return notes.join(ranges, (F.col(number) >= F.col("low")) & (F.col(number) < F.col("high"))).drop("low", "high")
