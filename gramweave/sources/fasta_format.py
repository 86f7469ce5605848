"""Sequence files as a data source: `spark.read.format("fasta")` and `df.write.format("fasta")`.

A file is read in ranges of bytes; a task gets one, or a run of neighbours where there are more than TASKS of less than RANGE. A record belongs to the range in which its header begins, and is read to its end
wherever that lies, so a file may be larger than a task and no line is read for its number. Writers stage a file an attempt; only those of
attempts that are committed get their names, and an abort removes the others, so a task that is repeated leaves nothing twice.

Paths are those of `pyarrow.fs` (local folders that all executors share, hdfs, s3, gs). Stores that only Spark's readers open are read by
`fasta.read_split`. Rules of records are those of `fasta`, but for lines in front of a file's first header, which belong to no range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a range, and of a block that is read at once.
RANGE, BLOCK = 64 << 20, 1 << 20
#: Bytes of a block at least, where the range is small.
LEAST = 1 << 16
#: Tasks beyond which small ranges are joined.
TASKS = 1024
SCHEMA = "file string, begin long, name string, seq string"


def _open(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class Staged(WriterCommitMessage):
    staged: str | None
    name: str | None


def records(file, begin: int, end: int) -> Iterator[tuple[int, str, str]]:
    """(begin, name, sequence) of the records whose header begins in a range of bytes."""
    at = max(0, begin - 1)  # a header is at the start of a line, so the byte in front tells
    file.seek(at)
    size = min(BLOCK, max(LEAST, end - at))
    held, start, own = b"", at, None
    head, lines = "", []
    fresh = begin == 0

    def finished(is_last: bool) -> Iterator[tuple[int, str, str]]:
        sequence = "".join(lines)
        if own is not None and (sequence or is_last):
            yield own, head, sequence

    while True:
        block = file.read(size)
        size = min(BLOCK, 2 * size)
        held += block
        parts = held.split(b"\n")
        if block:
            held = parts.pop()  # the last line may go on
        for line in parts:
            where, start = start, start + len(line) + 1
            if not fresh:
                fresh = True  # what stands in front of the first whole line is the range before's
                continue
            if line.startswith(b">"):
                yield from finished(False)
                if where >= end:
                    return
                own, head, lines = where, line[1:].decode(), []
            elif own is not None and not line.startswith(b";"):
                lines.append(line.decode().replace(" ", ""))
        if not block:
            yield from finished(True)
            return


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.range = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        # whole ranges, so many a task that there are few tasks, each of RANGE at most (or of one range)
        run = max(1, min(RANGE // self.range, -(-sum(f.size for f in files) // (self.range * TASKS))))
        step = self.range * run
        return [Range(f.path, at, min(f.size, at + step)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, step)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str, str]]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as file:
            for begin, name, sequence in records(file, partition.begin, partition.end):
                yield partition.path, begin, name, sequence


class FastaWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool) -> None:
        self.path, self.width, self.names, self.overwrite = options["path"], int(options.get("width", 70)), names, overwrite
        missing = {"name", "seq"} - set(names)
        if missing:
            raise ValueError(f"columns that records need: {sorted(missing)}")

    def write(self, iterator) -> Staged:
        from pyspark import TaskContext

        system, path = _open(self.path)
        # named by task and attempt: a repeated task writes a file of its own
        context = TaskContext.get()
        staged = f"{path}/_staged/{uuid.uuid4().hex}"
        at_name, at_sequence = self.names.index("name"), self.names.index("seq")
        out = None
        for row in iterator:
            if out is None:
                system.create_dir(f"{path}/_staged", recursive=True)
                out = system.open_output_stream(staged)
            sequence = row[at_sequence] or ""
            lines = [sequence[k : k + self.width] for k in range(0, len(sequence), self.width)]
            out.write("\n".join([f">{row[at_name] or ''}", *lines, ""]).encode())
        if out is None:
            return Staged(None, None)
        out.close()
        return Staged(staged, f"{path}/part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.fasta")

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File and f.base_name.startswith("part-"):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.staged:
                system.move(m.staged, m.name)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """What attempts have left that were not committed."""
        from pyarrow import fs

        system, path = _open(self.path)
        if system.get_file_info(f"{path}/_staged").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/_staged")


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options, schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format `fasta` known to a session."""
    spark.dataSource.register(Fasta)
