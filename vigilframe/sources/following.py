"""Streaming sources that follow appended data by position: lines by byte, records by row.

`log_tail` reads the lines appended to the files of a folder. An offset holds, for each file, the
byte after its last whole line and a checksum of its first one: a half-written line waits for its
end, a newer file is followed as it appears, and a file that starts anew is read from its start.

`event_log` reads the records of appended Parquet files in order of arrival. An offset holds the
rows read of each file; a micro-batch admits a number of rows, not of files. Its start is the
oldest record, the newest one ("latest": only what comes later), or an offset.

Both plan byte or row ranges on the driver, from listings, footers and the ends of files, and
read them in parallel as Arrow batches. Files have to be reachable by the Python workers.
"""

from __future__ import annotations

import fnmatch
import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

TAIL_SCHEMA = "line string, file string, start long"
BLOCK = 1 << 16  # bytes read at once when looking back for the end of a line
HEAD = 256  # bytes of the first line that tell a file from its successor of the same name
BATCH_LINES = 8192
LATE_NS = 600 * 10**9  # so much older than the newest file a new file may be


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.replace("file:", "", 1))


def listing(fs: pafs.FileSystem, folder: str, glob: str) -> dict[str, pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {f.base_name: f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, glob) and f.base_name[0] not in "._"}


# ---------------------------------------------------------------- lines

@dataclass
class Bytes(InputPartition):
    name: str
    start: int
    end: int
    first: bool  # the range starts where a line does


def after_last_line(file, size: int, known: int) -> int:
    """The byte after the last line end before `size`; at least `known`, which follows one."""
    end = size
    while end > known:
        at = max(known, end - BLOCK)
        file.seek(at)
        found = file.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return known


def head_of(file, end: int) -> int:
    """Checksum of the first line, or of its first bytes."""
    file.seek(0)
    return zlib.crc32(file.read(min(HEAD, end)).split(b"\n")[0])


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.from_now = options.get("start", "earliest") == "latest"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.known: dict[str, dict] = {}

    def ends(self) -> dict[str, dict]:
        fs, folder = opened(self.path)
        out = {}
        for name, info in sorted(listing(fs, folder, self.glob).items()):
            before = self.known.get(name, {"at": 0, "head": 0})
            if not info.size:
                out[name] = {"at": 0, "head": 0}
                continue
            with fs.open_input_file(info.path) as file:
                # What was known holds only while the file goes on; else the end is looked for anew.
                goes_on = before["at"] and info.size >= before["at"] and head_of(file, before["at"]) == before["head"]
                at = after_last_line(file, info.size, before["at"] if goes_on else 0)
                out[name] = {"at": at, "head": head_of(file, at) if at else 0}
        self.known = out
        return out

    def initialOffset(self) -> dict:
        return {"files": self.ends() if self.from_now else {}}

    def latestOffset(self) -> dict:
        return {"files": self.ends()}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        out = []
        for name, last in end["files"].items():
            first = start["files"].get(name, {"at": 0, "head": 0})
            goes_on = first["at"] and first["head"] == last["head"] and last["at"] >= first["at"]
            begin = first["at"] if goes_on else 0
            for at in range(begin, last["at"], self.split):
                out.append(Bytes(name, at, min(at + self.split, last["at"]), at == begin))
        return out

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        """The lines that start in the range; the last one may end after it."""
        fs, folder = opened(self.path)
        with fs.open_input_file(f"{folder}/{partition.name}") as handle:
            file, at = io.BufferedReader(handle, BLOCK), partition.start
            if not partition.first:
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            held, places = [], []
            while at < partition.end:
                line = file.readline()
                if not line.endswith(b"\n"):
                    break
                held.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                places.append(at)
                at += len(line)
                if len(held) == BATCH_LINES:
                    yield self.batch(partition.name, held, places)
                    held, places = [], []
            if held:
                yield self.batch(partition.name, held, places)

    def batch(self, name: str, lines: list[str], places: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(lines, pa.string()), pa.array([name] * len(lines), pa.string()), pa.array(places, pa.int64())], names=["line", "file", "start"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return TAIL_SCHEMA

    def streamReader(self, schema: T.StructType) -> TailReader:
        return TailReader(self.options)


# ---------------------------------------------------------------- records

@dataclass
class Rows(InputPartition):
    name: str
    start: int
    end: int


class EventReader(DataSourceStreamReader):
    """Admission needs the place reached so far, which Spark does not hand to a source: it is known
    from the last plan or commit, and after a restart from the file that commits leave in `progress`.
    From a place a plan always comes to the same end or a later one, so an old note does no harm.

    A row group is decoded from its start up to the rows wanted, so files that are followed in small
    micro-batches are best written with row groups of about the size of one.
    """

    def __init__(self, options, schema: T.StructType):
        self.path, self.glob = options["path"], options.get("glob", "*.parquet")
        self.start, self.rows = options.get("start", "earliest"), int(options.get("rows_per_batch", 10))
        self.progress = options.get("progress")
        self.split = int(options.get("split_rows", 1 << 17))
        self.schema = to_arrow_schema(schema)
        self.place: dict | None = None
        self.counts: dict[str, int] = {}

    def files(self) -> list[tuple[int, str, int]]:
        """(time, name, rows) of the files, oldest first."""
        fs, folder = opened(self.path)
        found = sorted((f.mtime_ns, n, f.path) for n, f in listing(fs, folder, self.glob).items())
        for _, name, path in found:
            if name not in self.counts:
                with fs.open_input_file(path) as file:
                    self.counts[name] = pq.read_metadata(file).num_rows
        return [(t, n, self.counts[n]) for t, n, _ in found]

    def initialOffset(self) -> dict:
        if self.start == "earliest":
            first = {"before": 0, "files": {}}
        elif self.start == "latest":
            first = {"before": 0, "files": {n: rows for _, n, rows in self.files()}}
        else:
            first = json.loads(self.start)
        self.place = self.place or first
        return first

    def latestOffset(self) -> dict:
        if self.place is None:
            self.place = self.noted() or self.initialOffset()
        self.place = admitted(self.place, self.files(), self.rows)
        return self.place

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self.place = end
        out = []
        for name, last in end["files"].items():
            for at in range(start["files"].get(name, 0), last, self.split):
                out.append(Rows(name, at, min(at + self.split, last)))
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(self.path)
        with fs.open_input_file(f"{folder}/{partition.name}") as handle:
            file, at = pq.ParquetFile(handle), 0
            for group in range(file.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                if at < partition.end and at + n > partition.start:
                    place = at
                    for batch in file.iter_batches(row_groups=[group], columns=self.schema.names):
                        if place >= partition.end:  # the rest of the group belongs to later batches
                            break
                        low, high = max(0, partition.start - place), min(batch.num_rows, partition.end - place)
                        place += batch.num_rows
                        if low < high:
                            yield batch.slice(low, high - low).select(self.schema.names).cast(self.schema)
                at += n

    def commit(self, end: dict) -> None:
        if self.progress:
            fs, folder = opened(self.progress)
            fs.create_dir(folder)
            with fs.open_output_stream(f"{folder}/.place.json") as file:
                file.write(json.dumps(end).encode())
            fs.move(f"{folder}/.place.json", f"{folder}/place.json")

    def noted(self) -> dict | None:
        if not self.progress:
            return None
        fs, folder = opened(self.progress)
        if fs.get_file_info(f"{folder}/place.json").type != pafs.FileType.File:
            return None
        with fs.open_input_file(f"{folder}/place.json") as file:
            return json.loads(file.read())


def admitted(place: dict, files: list[tuple[int, str, int]], rows: int) -> dict:
    """The offset `rows` records after `place`, or after all there are.

    Files that were read before and are much older than the newest one leave the offset, so that
    it doesn't grow with the history; `before` tells that they are done.
    """
    done, left, out = place["files"], rows, {}
    there = [f for f in files if f[0] >= place["before"] or f[1] in done]
    for _, name, n in there:
        read = done.get(name, 0)
        take = min(n - read, left)
        left -= take
        if read + take:
            out[name] = read + take
    horizon = min([max((t for t, _, _ in there), default=0) - LATE_NS, *(t for t, name, n in there if done.get(name, 0) < n)])
    before = max(place["before"], horizon)
    for t, name, _ in there:
        if t < before:
            out.pop(name, None)
    return {"before": before, "files": out}


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def streamReader(self, schema: T.StructType) -> EventReader:
        return EventReader(self.options, schema)


# ---------------------------------------------------------------- frames

def follow_lines(spark: SparkSession, folder: str, glob: str, start: str = "earliest", split_bytes: int = 64 << 20) -> DataFrame:
    """Lines (with file and byte) as they are appended to the files of a folder."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", folder).option("glob", glob).option("start", start).option(
        "split_bytes", split_bytes).load()


def follow_events(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", start: str = "earliest",
                  rows_per_batch: int = 10, progress: str | None = None) -> DataFrame:
    """Records of appended Parquet files from `start` on, at most `rows_per_batch` in a micro-batch.

    `progress` is a folder of this query alone, kept with its checkpoint; without one a restart
    finds its place batch by batch. A file that comes more than ten minutes after newer ones isn't read.
    """
    spark.dataSource.register(EventLog)
    reader = spark.readStream.format("event_log").schema(schema).option("path", folder).option("glob", glob).option(
        "start", start).option("rows_per_batch", rows_per_batch)
    return (reader.option("progress", progress) if progress else reader).load()
