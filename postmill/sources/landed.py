"""Landed payloads as a Spark data source, ``landed``, for batches and streams, and as a sink.

``register(spark)``, then ``spark.read.format("landed").load(path)``, ``spark.readStream...`` or ``df.write.format("landed").mode("append").save(path)``.
A response is a file, ``<path>/board=<token>/<moment>-<digest>.json``: one JSON line that ``streaming.ingest.landed`` reads too. Paths are absolute or URIs that pyarrow knows.

Boards are listed, and each one's files are cut into ranges of names of about ``bytes`` each, so a large board is many tasks and small ones share a task; the driver
keeps ranges, not files. A schema (``.schema("board string, landed_at timestamp")``) names the columns to read; without a column of the contents no file is opened.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

CONTENTS = ["name", "employer_type", "country", "payload"]
SCHEMA = "board string, landed_at timestamp, file string, " + ", ".join(f"{c} string" for c in CONTENTS)
#: Bytes of files to a task, unless the option ``bytes`` says otherwise, and of texts to an Arrow batch.
TASK, BATCH = 64 << 20, 4 << 20
#: Boards that are listed at a time.
AT_ONCE = 16


@dataclass
class Range:
    """A board's files whose names are above ``after`` and up to ``to``."""

    board: str
    after: str
    to: str


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


class Folder:
    """The files below a path."""

    def __init__(self, options: dict):
        self.fs, self.top = fs.FileSystem.from_uri(options["path"])
        self.only = options.get("boards")
        self.bytes = int(options.get("bytes", TASK))

    def _at(self, board: str) -> str:
        return f"{self.top}/board={quote(board, safe='')}"

    def boards(self) -> list[str]:
        """All boards, or those of the option ``boards`` (a JSON list)."""
        if self.only is not None:
            return sorted(set(json.loads(self.only)))
        found = self.fs.get_file_info(fs.FileSelector(self.top, allow_not_found=True))
        return sorted(unquote(x.base_name[6:]) for x in found if x.type == fs.FileType.Directory and x.base_name.startswith("board="))

    def files(self, board: str, after: str, to: str | None) -> list[fs.FileInfo]:
        found = self.fs.get_file_info(fs.FileSelector(self._at(board), allow_not_found=True))
        return sorted((x for x in found if x.base_name.endswith(".json") and x.base_name > after and (to is None or x.base_name <= to)), key=lambda x: x.base_name)

    def each(self, ask, boards: list[str]) -> Iterator:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            yield from pool.map(ask, boards)

    def cut(self, start: dict[str, str], end: dict[str, str] | None) -> list[Ranges]:
        """Tasks of about ``bytes`` each: files after ``start`` and up to ``end``, by board."""

        def ranges(board: str) -> list[tuple[Range, int]]:
            out, size, after = [], 0, start.get(board, "")
            files = self.files(board, after, None if end is None else end[board])
            for x, then in zip(files, [*files[1:], None]):
                size += x.size
                if then is None or size + then.size > self.bytes:
                    out.append((Range(board, after, x.base_name), size))
                    size, after = 0, x.base_name
            return out

        tasks, room = [], 0
        for own in self.each(ranges, self.boards() if end is None else [b for b in end if end[b] > start.get(b, "")]):
            for one, size in own:
                if size > room:
                    tasks.append(Ranges([]))
                    room = self.bytes
                tasks[-1].ranges.append(one)
                room -= size
        return tasks

    def last(self) -> dict[str, str]:
        """The last file of each board that has one."""
        boards = self.boards()
        return {b: own[-1].base_name for b, own in zip(boards, self.each(lambda b: self.files(b, "", None), boards)) if own}

    def rows(self, task: Ranges, columns: list[str]) -> Iterator[pa.RecordBatch]:
        opened = [c for c in columns if c in CONTENTS]
        kinds = pa.schema([(c, pa.timestamp("us", tz="UTC") if c == "landed_at" else pa.string()) for c in columns])
        held, size = [], 0
        for one in task.ranges:
            for x in self.files(one.board, one.after, one.to):
                row = {"board": one.board, "landed_at": int(x.base_name.split("-")[0]), "file": x.path}
                if opened:
                    with self.fs.open_input_stream(x.path) as f:
                        row |= json.loads(f.read())
                    row["board"] = one.board
                held.append([row.get(c) for c in columns])
                size += x.size if opened else 256
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*held), kinds)], schema=kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(zip(*held), kinds)], schema=kinds)

    def put(self, row: dict, moment: int) -> None:
        """Writes a response under a name that follows from it, so that a repeated task writes the same file."""
        said = json.dumps({"board": row["board"], **{c: row.get(c) for c in CONTENTS}}, ensure_ascii=False).encode() + b"\n"
        at = self._at(row["board"])
        self.fs.create_dir(at, recursive=True)
        digest = hashlib.sha256(said).hexdigest()
        parts = f"{at}/.{digest}.{id(row)}.part"
        with self.fs.open_output_stream(parts) as f:
            f.write(said)
        self.fs.move(parts, f"{at}/{moment:020d}-{digest[:16]}.json")


def _known(schema) -> list[str]:
    names = [f.name for f in schema.fields]
    if unknown := set(names) - {"board", "landed_at", "file", *CONTENTS}:
        raise ValueError(f"landed payloads have no column {', '.join(sorted(unknown))}")
    return names


class Batch(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[Ranges]:
        return Folder(self.options).cut({}, None) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).rows(partition, self.columns)


class Stream(DataSourceStreamReader):
    """An offset is the name of each board's last file. Names of a board must ascend, as they do where one crawl of it lands at a time; a file that lands below the last one read is not read."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return Folder(self.options).last()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return Folder(self.options).cut(start, end) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).rows(partition, self.columns)


class Sink(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator) -> WriterCommitMessage:
        folder = Folder(self.options)
        for row in iterator:
            own = row.asDict()
            if own.get("board") is None or own.get("payload") is None or own.get("landed_at") is None:
                raise ValueError("a landed payload needs board, landed_at and payload")
            folder.put(own, round(own["landed_at"].timestamp() * 1_000_000))
        return WriterCommitMessage()


class LandedPayloads(DataSource):
    """Options: ``path``; ``boards``, a JSON list of the only boards to read; ``bytes`` to a task. Rows of the sink need ``board, landed_at, payload``; an equal row lands once."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(dict(self.options), _known(schema))

    def streamReader(self, schema) -> Stream:
        return Stream(dict(self.options), _known(schema))

    def writer(self, schema, overwrite: bool) -> Sink:
        if overwrite:
            raise ValueError("landed payloads are only added to")
        return Sink(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LandedPayloads)
    return spark
