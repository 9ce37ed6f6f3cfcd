"""Monitors that keep a state for each key: Spark hands them a key's new rows and what they kept, and nothing else is touched."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from tracemill.functions.shipping import by_value, ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State of these monitors is kept by RocksDB, which alone offers timers by key and keeps state out of the heap."""
    ship(spark)
    by_value(__name__)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _plain(series: pd.Series, whole: bool) -> list:
    """A column's cells as state keeps them: missing ones as None, whole numbers that pandas has made floats as whole ones."""
    if whole and series.dtype.kind == "f":
        return [None if v != v else int(v) for v in series.tolist()]
    return [None if v != v else v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for v in series.tolist()]


def _whole(df: DataFrame, columns: list[str]) -> set[str]:
    return {c for c in columns if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")}


def _rows(frames: Iterator[pd.DataFrame], columns: list[str], whole: set[str]) -> list[tuple]:
    """A key's rows of one micro-batch. The trigger's limits bound them."""
    return [row for f in frames for row in zip(*(_plain(f[c], c in whole) for c in columns))]


def _place(cells: tuple) -> tuple:
    """Sorts rows by some of their cells, missing ones last."""
    return tuple((v is None, 0 if v is None else v) for v in cells)


def _grouped(stream: DataFrame, group: str, run, rows: str, state: str) -> DataFrame:
    """A key's rows and state go to Python and back with those of other keys, many in an Arrow batch: no call is made for one key alone."""
    kind = stream.schema[group].dataType.simpleString()
    return stream.groupBy(group).applyInPandasWithState(run, f"_key {kind}, {rows}", state, "append", GroupStateTimeout.NoTimeout).withColumnRenamed("_key", group)


def changes(stream: DataFrame, group: str = "user_id", order: str = "event_id", watched: tuple[str, ...] = ("event_type",), rest: tuple[str, ...] = ()) -> DataFrame:
    """group, order, watched and rest of the rows at which one of a group's watched fields differs from the row before; the first row of a group counts.

    Rows of a micro-batch are compared in order; the state is a group's last
    watched values, written once for each batch that has rows of it. With no
    watched fields only a group's first row is given.
    """
    keyed_state(stream.sparkSession)
    columns, m = [order, *watched, *rest], 1 + len(watched)
    whole = _whole(stream, columns)

    def run(key, frames, state):
        kept = tuple(state.get) if state.exists else None
        if m == 1 and kept is not None:
            return
        rows = sorted(_rows(frames, columns, whole), key=lambda r: _place(r[:1]))
        before, out = kept and kept[1:], []
        for row in rows[:1] if m == 1 else rows:
            if row[1:m] != before:
                out.append((*key, *row))
            before, at = row[1:m], row[0]
        state.update((at, *before))
        if out:
            yield pd.DataFrame(out, columns=["_key", *columns])

    return _grouped(stream.select(group, *columns), group, run, _kinds(stream, columns), _kinds(stream, [order, *watched]))


def duplicate_monitor(stream: DataFrame, group: str, design: list[str], at: str, order: tuple[str, ...] = (), threshold: int = 3, cap: int = 2, cool: float = 60.0, keep_ms: int | None = None) -> DataFrame:
    """Delegations that evaluate designs again: group, n_duplicate (so far) and at (seconds), a row each time a delegation is told.

    A row whose design the delegation has had before is a repeat. Repeats count
    from one telling to the next; at `threshold` the delegation is told, `cap`
    times at most and not within `cool` seconds of the rows' own clock (`at`, a
    timestamp). It is decided row by row, so how rows fall into micro-batches
    makes no difference as long as they come in order. A delegation's designs are
    read and written once for a batch that has rows of it, and dropped with its
    last telling, behind which nothing is counted. keep_ms forgets a design after
    that time.
    """
    keyed_state(stream.sparkSession)
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in design])
    keyed = stream.select(group, *order, name.alias("design_of_row"), (F.unix_micros(at) / 1e6).alias("seconds_of_row"))
    columns = ["design_of_row", "seconds_of_row", *order]
    whole = _whole(keyed, columns)

    def run(key, frames, state):
        n, counter, told, last, designs, since = tuple(state.get) if state.exists else (0, 0, 0, None, [], [])
        if told >= cap:
            return
        now = state.getCurrentProcessingTimeMs()
        seen = {d: s for d, s in zip(designs, since or [now] * len(designs)) if keep_ms is None or s + keep_ms > now}
        out = []
        for name_, seconds, *_ in sorted(_rows(frames, columns, whole), key=lambda r: _place(r[1:])):
            if name_ not in seen:
                seen[name_] = now
                continue
            n, counter = n + 1, counter + 1
            if counter >= threshold and (last is None or (seconds is not None and seconds - last >= cool)):
                out.append((*key, n, seconds))
                counter, told, last = 0, told + 1, float("nan") if seconds is None else seconds
                if told >= cap:
                    seen = {}
                    break
        state.update((n, counter, told, last, list(seen), list(seen.values()) if keep_ms else []))
        if out:
            yield pd.DataFrame(out, columns=["_key", "n_duplicate", "at"])

    state = "n long, counter long, told long, last double, designs array<string>, since array<long>"
    return _grouped(keyed, group, run, "n_duplicate long, at double", state)


class Stalls(StatefulProcessor):
    """Tells of keys that are silent for too long."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.last.get()
        at, told = kept if kept is not None else (None, False)
        if at is not None and not told:
            self.handle.deleteTimer(at + self.limit)
        for ms in sorted(row["millis_of_row"] for row in rows):
            if at is not None and ms - at > self.limit and not told:
                yield Row(_key=key[0], since_ms=at)
            if at is None or ms > at:
                at, told = ms, False
        self.last.update((int(at), bool(told)))
        if not told:
            self.handle.registerTimer(at + self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, told = self.last.get()
        if not told and expiredTimerInfo.getExpiryTimeInMs() == at + self.limit:
            self.last.update((int(at), True))
            yield Row(_key=key[0], since_ms=at)

    def close(self) -> None:
        pass


def stalls(stream: DataFrame, group: str, at: str, limit: float = 1200.0, late: str = "10 minutes") -> DataFrame:
    """group and since_ms, the last write before each silence of more than `limit` seconds; it is told once, when it has lasted that long.

    A timer for each group fires when the watermark has passed the limit; a group that
    writes again first is told of by that write. Writes that come later than `late` are lost.
    """
    keyed_state(stream.sparkSession)
    kind = stream.schema[group].dataType.simpleString()
    keyed = stream.withWatermark(at, late).select(group, F.unix_millis(at).alias("millis_of_row"), at)
    out = keyed.groupBy(group).transformWithState(Stalls(int(limit * 1000)), f"_key {kind}, since_ms long", "Append", "EventTime")
    return out.withColumnRenamed("_key", group)


def fan_in(delegations: DataFrame, diagnostics: DataFrame, statuses: DataFrame) -> DataFrame:
    """kind, id, pos, status, session_started_at and payload of three logs of one run (columns run, pos and their own) as one stream.

    A delegation (id) comes again only when its status or session_started_at
    has changed, diagnostics come all, and a run's status comes once.
    """
    columns = ["kind", "id", "pos", "status", "session_started_at", "payload"]
    none = lambda kind: F.lit(None).cast(kind)
    watched = delegations.select(F.lit("delegation").alias("kind"), "id", "pos", "status", "session_started_at", "payload", F.col("status").alias("_status"), F.col("session_started_at").alias("_session"))
    # nothing of a status is watched, so only a run's first one counts; one monitor keeps both kinds, as a query can hold one
    once = statuses.select(F.lit("run_status").alias("kind"), F.col("run").alias("id"), "pos", "status", none("long").alias("session_started_at"), none("string").alias("payload"), none("string").alias("_status"), none("long").alias("_session"))
    both = watched.unionByName(once).withColumn("_of", F.when(F.col("id").isNull(), F.col("kind")).otherwise(F.concat("kind", F.lit(":"), "id")))
    told = changes(both, "_of", "pos", ("_status", "_session"), ("kind", "id", "status", "session_started_at", "payload"))
    rest = diagnostics.select(F.lit("diagnostic").alias("kind"), none("string").alias("id"), "pos", none("string").alias("status"), none("long").alias("session_started_at"), "payload")
    return told.select(*columns).unionByName(rest.select(*columns))
