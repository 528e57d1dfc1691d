"""Data sources of the engine's own: a store of graphs by recording, and the logs of media tools.

A graph store is a folder of Parquet files and of commits. Tasks write files under names of their own; the
driver's commit names the files that count and the recordings they replace, as a whole. A file that no
commit names, of a task that died or of a job that was aborted, is never read. So a write is there wholly
or not at all, writing a recording again leaves it there once, and a deletion is a commit without files.

Tool logs are a folder with one text file a recording, one partition each, parsed line by line under a
declared schema. Both leave files out before anything is read where the option ``recordings`` names what is
wanted (a JSON list). That is an option and no filter that Spark hands on: this version of Spark keeps what one
query of a frame has handed to a Python source for the frame's other queries, which then lack rows.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

STORE, TOOL_LOG = "palaver_graph", "palaver_tool_log"
#: The column by which both are divided.
KEY = "video_id"


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(GraphStore)
    spark.dataSource.register(ToolLog)


def read(spark: SparkSession, kind: str, path: str, recordings: list[str] | None = None) -> DataFrame:
    """A store or a folder of logs, or of some recordings only, whose files alone are opened."""
    reader = spark.read.format(kind).option("path", path)
    return (reader if recordings is None else reader.option("recordings", json.dumps(recordings))).load()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_in(at: fs.FileSystem, folder: str, deep: bool = False) -> list[str]:
    return sorted(x.path for x in at.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=deep)) if x.type == fs.FileType.File)


def written(at: fs.FileSystem, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    with at.open_output_stream(f"{path}.part") as out:
        out.write(text.encode())
    at.move(f"{path}.part", path)


def wanted_of(options: dict) -> set | None:
    return set(json.loads(options["recordings"])) if "recordings" in options else None


@dataclass
class Part(InputPartition):
    path: str
    recordings: tuple


@dataclass
class Written(WriterCommitMessage):
    path: str
    recordings: tuple


class GraphStore(DataSource):
    """Options: path, recordings. The schema of a read is that of the first file, unless one is given."""

    @classmethod
    def name(cls) -> str:
        return STORE

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        at, root = opened(self.options["path"])
        current = current_files(at, root)
        if not current:
            raise FileNotFoundError(f"nothing is committed at {root}")
        return from_arrow_schema(pq.read_schema(next(iter(current)), filesystem=at))

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options["path"], wanted_of(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return StoreWriter(self.options["path"])


def current_files(at: fs.FileSystem, root: str) -> dict[str, set]:
    """Each file that counts with the recordings that it is the last word on."""
    last: dict[str, tuple[str, ...]] = {}
    for commit in files_in(at, f"{root}/commits"):
        if commit.endswith(".json"):
            with at.open_input_stream(commit) as data:
                last |= {k: tuple(v) for k, v in json.loads(data.read()).items()}
    found: dict[str, set] = {}
    for recording, paths in last.items():
        for path in paths:
            found.setdefault(f"{root}/files/{path}", set()).add(recording)
    return found


def committed(at: fs.FileSystem, root: str, files: dict[str, list[str]]) -> None:
    """Adds a commit: the files of each recording from now on."""
    at.create_dir(f"{root}/commits")
    numbers = [int(re.match(r"\d+", x.rpartition("/")[2])[0]) for x in files_in(at, f"{root}/commits")]
    written(at, f"{root}/commits/{max(numbers, default=0) + 1:012d}-{uuid.uuid4().hex}.json", json.dumps(files))


def delete(path: str, recordings: list[str]) -> None:
    """Takes recordings out of a store."""
    committed(*opened(path), {r: [] for r in recordings})


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        at, root = opened(self.path)
        at.create_dir(f"{root}/files")
        name, seen, out = f"{uuid.uuid4().hex}.parquet", set(), None
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(f"{root}/files/{name}", batch.schema, filesystem=at)
                out.write_batch(batch)
                seen |= set(batch.column(KEY).unique().to_pylist())
        if out:
            out.close()
        return Written(name if out else "", tuple(sorted(seen)))

    def commit(self, messages: list[Written]) -> None:
        files: dict[str, list[str]] = {}
        for m in messages:
            for recording in m.recordings if m else ():
                files.setdefault(recording, []).append(m.path)
        committed(*opened(self.path), files)

    def abort(self, messages: list[Written]) -> None:
        at, root = opened(self.path)
        for m in messages:
            if m and m.path:
                at.delete_file(f"{root}/files/{m.path}")


class StoreReader(DataSourceReader):
    def __init__(self, path: str, wanted: set | None):
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[Part]:
        at, root = opened(self.path)
        parts = []
        for path, recordings in sorted(current_files(at, root).items()):
            kept = recordings if self.wanted is None else recordings & self.wanted
            if kept:
                parts.append(Part(path, tuple(sorted(kept))))
        return parts or [Part("", ())]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.path:
            at, _ = opened(self.path)
            import pyarrow.dataset as ds

            yield from ds.dataset(part.path, filesystem=at, format="parquet").to_batches(filter=ds.field(KEY).isin(list(part.recordings)))


#: Lines of the tools' output that are events.
EVENTS = {
    "silence_start": re.compile(r"silence_start:\s*(-?[\d.]+)"),
    "silence_end": re.compile(r"silence_end:\s*(-?[\d.]+)"),
    "cut": re.compile(r"pts_time:\s*([\d.]+)"),
    "duration": re.compile(r"^duration=([\d.]+)"),
}


def recording_of(path: str) -> str:
    """The recording of a log: that of its folder (video_id=...), or the file's own name."""
    *_, folder, name = path.split("/")
    return folder.partition("=")[2] if folder.startswith(f"{KEY}=") else name.rpartition(".")[0]


class ToolLog(DataSource):
    """Options: path, a folder of <video_id>.log or of what Spark's text writer makes by recording, recordings. Rows are events: seq is the line's number, t in milliseconds."""

    @classmethod
    def name(cls) -> str:
        return TOOL_LOG

    def schema(self) -> str:
        return "video_id string, seq long, kind string, t long"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"], wanted_of(self.options))


class LogReader(DataSourceReader):
    def __init__(self, path: str, wanted: set | None):
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[Part]:
        at, root = opened(self.path)
        named = [(x, recording_of(x)) for x in files_in(at, root, deep=True) if x.endswith((".log", ".txt"))]
        return [Part(path, (name,)) for path, name in named if self.wanted is None or name in self.wanted] or [Part("", ())]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.path:
            at, _ = opened(self.path)
            with at.open_input_stream(part.path) as data:
                for seq, line in enumerate(io.BufferedReader(data)):
                    text = line.decode(errors="replace")
                    for kind, rule in EVENTS.items():
                        for m in rule.finditer(text):
                            yield part.recordings[0], seq, kind, round(float(m[1]) * 1000)
