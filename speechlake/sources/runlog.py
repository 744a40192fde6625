"""The run log as a Spark data source: JSON lines that are appended while a run goes on.

``spark.dataSource.register(Runlog)``, then ``spark.read.format("runlog")``, ``spark.readStream.format("runlog")`` and
``df.write.format("runlog")`` with the option ``path``, a folder in any file system that pyarrow opens by its address.

Reading gives file, at (the byte where a line starts), t (the kind of event, null without one) and line. A line that is
no JSON object is left out: blank ones, and those that a run which was killed left torn. Files are read in ranges of
``rangeBytes``; a line belongs to the range in which it starts. A stream goes by bytes of each file and reads no further
than the last line end, so a line that is still being written waits until it is whole.

Writing gives each task a hidden file that gets its name on commit. A stream names files by its batch, so a batch that
is run again takes the place of what it left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ENDING, RANGE_BYTES, READ_BYTES = ".jsonl", 64 << 20, 1 << 20
SCHEMA = "file string, at long, t string, line string"


@dataclass
class Range(InputPartition):
    """Bytes of a file."""

    file: str
    low: int
    high: int


@dataclass
class Staged(WriterCommitMessage):
    """A hidden file that a task wrote."""

    name: str
    lines: int


class Folder:
    """A folder of run logs."""

    def __init__(self, path: str):
        if not path:
            raise ValueError("runlog needs the option path")
        self.path = path

    def _open(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path)

    def files(self) -> list[tuple[str, int]]:
        """Logs and their sizes, by name. Hidden files are none; a folder that is not there is empty."""
        from pyarrow.fs import FileSelector

        fs, base = self._open()
        found = fs.get_file_info(FileSelector(base, allow_not_found=True, recursive=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(ENDING) and f.base_name[0] not in "._")

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """Start and bytes of every line that starts in a range."""
        fs, _ = self._open()
        skip, start, held = part.low > 0, max(0, part.low - 1), []
        with fs.open_input_file(part.file) as f:
            f.seek(start)
            while chunk := f.read(READ_BYTES):
                held.append(chunk)
                if b"\n" not in chunk:
                    continue
                *whole, rest = b"".join(held).split(b"\n")
                held = [rest]
                for line in whole:
                    if not skip and start < part.high:
                        yield start, line
                    skip = False
                    start += len(line) + 1
                if start >= part.high:
                    return
        rest = b"".join(held)
        if rest and not skip and start < part.high:
            yield start, rest

    def last_end(self, file: str, size: int) -> int:
        """The byte after the last line end."""
        fs, _ = self._open()
        with fs.open_input_file(file) as f:
            while size > 0:
                low = max(0, size - READ_BYTES)
                f.seek(low)
                at = f.read(size - low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                size = low
        return 0

    def stage(self, name: str, rows: Iterator[Row]) -> Staged:
        fs, base = self._open()
        fs.create_dir(base, recursive=True)
        n = 0
        with fs.open_output_stream(f"{base}/{name}") as f:
            for row in rows:
                f.write(json.dumps({k: v for k, v in row.asDict(True).items() if v is not None}, ensure_ascii=False, default=str).encode("utf-8", "surrogatepass") + b"\n")
                n += 1
        return Staged(name, n)

    def publish(self, staged: list[Staged], names: list[str], replaced: str | None) -> None:
        """Give hidden files their names. Logs that begin with ``replaced`` go first; None keeps all."""
        fs, base = self._open()
        if replaced is not None:
            for path, _ in self.files():
                if path.rsplit("/", 1)[-1].startswith(replaced):
                    fs.delete_file(path)
        for one, name in zip(staged, names):
            if one.lines:
                fs.move(f"{base}/{one.name}", f"{base}/{name}")
            else:
                fs.delete_file(f"{base}/{one.name}")

    def drop(self, begin: str) -> None:
        """Delete hidden files that begin so."""
        from pyarrow.fs import FileSelector

        fs, base = self._open()
        for f in fs.get_file_info(FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(begin):
                fs.delete_file(f.path)


def parsed(line: bytes) -> tuple[str | None, str] | None:
    """(t, text) of a line that is a JSON object, else None."""
    try:
        text = line.decode("utf-8").strip()
        value = json.loads(text)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    return value["t"] if isinstance(value.get("t"), str) else None, text


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.folder, self.step = Folder(options.get("path", "")), int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        if self.step < 1:
            raise ValueError("rangeBytes must be at least 1")

    def cut(self, file: str, low: int, high: int) -> list[Range]:
        return [Range(file, at, min(at + self.step, high)) for at in range(low, high, self.step)]

    def rows(self, part: Range) -> Iterator[tuple]:
        for at, line in self.folder.lines(part):
            if (found := parsed(line)) is not None:
                yield (part.file, at, *found)


class RunlogReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in self.folder.files() for r in self.cut(file, 0, size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is not None:  # an empty folder has no ranges
            yield from self.rows(partition)


class RunlogStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, size in self.folder.files():
            if self.known.get(file, (-1, 0))[0] != size:
                self.known[file] = size, self.folder.last_end(file, size)
        return {file: end for file, (_, end) in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, high in sorted(end.items()) for r in self.cut(file, start.get(file, 0), high)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from self.rows(partition)


class RunlogWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite, self.id = Folder(options.get("path", "")), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.folder.stage(f".{self.id}-{uuid.uuid4().hex}", iterator)

    def commit(self, messages: list[Staged]) -> None:
        done = [m for m in messages if m is not None]
        self.folder.publish(done, [f"part-{self.id}-{i:05d}{ENDING}" for i in range(len(done))], "" if self.overwrite else None)
        self.folder.drop(f".{self.id}-")

    def abort(self, messages: list[Staged]) -> None:
        self.folder.drop(f".{self.id}-")


class RunlogStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.id = Folder(options.get("path", "")), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.folder.stage(f".{self.id}-{uuid.uuid4().hex}", iterator)

    def commit(self, messages: list[Staged], batchId: int) -> None:
        done = [m for m in messages if m is not None]
        self.folder.publish(done, [f"batch-{batchId}-{i:05d}{ENDING}" for i in range(len(done))], f"batch-{batchId}-")
        self.folder.drop(f".{self.id}-")

    def abort(self, messages: list[Staged], batchId: int) -> None:
        self.folder.drop(f".{self.id}-")


class Runlog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RunlogReader:
        return RunlogReader(dict(self.options))

    def streamReader(self, schema: StructType) -> RunlogStreamReader:
        return RunlogStreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RunlogWriter:
        return RunlogWriter(dict(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> RunlogStreamWriter:
        return RunlogStreamWriter(dict(self.options))
