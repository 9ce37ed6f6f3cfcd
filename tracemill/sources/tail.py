"""Growing files of JSON lines as a stream: what is appended is read by byte offsets."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracemill.functions.shipping import by_value, ship

#: Bytes of a range that one task reads, and bytes read at a time.
RANGE, BLOCK = 64 << 20, 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(pattern: str) -> dict[str, int]:
    """Sizes of the files of one folder whose names match; none where the folder is missing."""
    system, inside = opened(pattern)
    folder, _, name = inside.rpartition("/")
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, name)}


def after_last_line(file: pa.NativeFile, low: int, high: int) -> int:
    """The place behind the last line feed in [low, high), or low."""
    while high > low:
        begin = max(low, high - BLOCK)
        file.seek(begin)
        at = file.read(high - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        high = begin
    return low


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, stop); whole files' new bytes begin at a line."""

    path: str
    start: int
    stop: int
    end: int
    first: bool


class TailReader(DataSourceStreamReader):
    """Offsets are the bytes of each file up to which its lines are done.

    A last line without its line feed waits for it. A file that vanishes is
    dropped, one of the same name that comes later is read from its start; a
    file that gets shorter is left as it is until it is longer again.
    """

    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"]
        self.from_end = options.get("from", "start") == "end"
        self.range = int(options.get("range", RANGE))
        self.known: dict[str, int] = {}

    def _whole(self, known: dict[str, int]) -> dict[str, int]:
        system, _ = opened(self.pattern)
        out = {}
        for path, size in files_of(self.pattern).items():
            low = known.get(path, 0)
            out[path] = low
            if size > low:
                try:
                    with system.open_input_file(path) as file:
                        out[path] = after_last_line(file, low, size)
                except FileNotFoundError:
                    out.pop(path)
        return out

    def initialOffset(self) -> dict:
        return self._whole({}) if self.from_end else {}

    def latestOffset(self) -> dict:
        self.known = self._whole(self.known)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {**end}  # after a restart too
        out = []
        for path, stop in sorted(end.items()):
            low = start.get(path, 0)
            for at in range(low, stop, self.range):
                out.append(Range(path, at, min(at + self.range, stop), stop, at == low))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.pattern)
        try:
            file = system.open_input_file(partition.path)
        except FileNotFoundError:
            return
        with file:
            at = partition.start
            rest, skip = b"", not partition.first
            if skip:  # a line that begins before the range is another's, unless it ends right there
                at -= 1
            place = at
            file.seek(at)
            while place < partition.stop or rest:
                block = file.read(min(BLOCK, partition.end - at))
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                places, values = [], []
                for line in lines:
                    if skip:
                        skip = False
                    elif place < partition.stop:
                        places.append(place)
                        values.append(line)
                    place += len(line) + 1
                if values:
                    text = pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(values)), pa.array(places, pa.int64()), text], names=["file", "at", "value"])
                if not block or place >= partition.stop:
                    return


class JsonlTail(DataSource):
    """Streaming source `jsonl_tail`: file, at (byte offset of the line) and value of each line that a file gains.

    Options: path (a folder and a pattern of names), from (start, or end: only
    what comes behind the last line that is whole now), range (bytes that a task reads).
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_jsonl(spark: SparkSession, pattern: str, start: str = "start", range_bytes: int = RANGE) -> DataFrame:
    """A stream of the lines that the files of a pattern hold and gain; parse_jsonl() makes columns of them."""
    ship(spark)
    by_value(__name__)
    spark.dataSource.register(JsonlTail)
    return spark.readStream.format("jsonl_tail").option("from", start).option("range", range_bytes).load(pattern)
