"""Log files that grow and are rotated, as a data source (A2): ``spark.readStream.format("log_lines").load(folder)``.

An offset says how many bytes of complete lines each file has, and how the file begins.  A file that was renamed is known by its
beginning and goes on where it was; one that begins differently is new, whatever its name.  A line is given once, when it
is complete.  Files are read in byte ranges, in parallel, from any file system that pyarrow opens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset bigint, line string"
#: Bytes by which a file is known, and bytes that a task reads.
HEAD_BYTES = 4096
SPLIT_BYTES = 32 << 20
_STEP = 1 << 20
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string())])


class Place(NamedTuple):
    """What is known of a file: complete bytes, and length and digest of its beginning."""

    done: int
    head: int
    digest: str


class Range(InputPartition):
    """Lines of a file that begin in [low, high); ``place`` tells whether it is still the same file."""

    def __init__(self, file: str, low: int, high: int, begin: int, place: Place):
        super().__init__((file, low, high))
        self.file, self.low, self.high, self.begin, self.place = file, low, high, begin, place


class Folder:
    """The log files below a folder, or a single file."""

    def __init__(self, path: str):
        local = path.removeprefix("file://").removeprefix("file:")
        self.system, self.root = fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)

    def sizes(self) -> dict[str, int]:
        root = self.system.get_file_info(self.root)
        if root.type == fs.FileType.NotFound:
            return {}
        if root.type == fs.FileType.File:
            return {self.root: root.size}
        found = self.system.get_file_info(fs.FileSelector(self.root, recursive=True))
        hidden = ("_", ".")
        return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(hidden)}

    def sizes_of(self, file: str) -> dict[str, int]:
        info = self.system.get_file_info(file)
        return {file: info.size} if info.type == fs.FileType.File else {}

    def digest(self, file: str, size: int) -> str:
        with self.system.open_input_file(file) as data:
            return hashlib.sha256(data.read_at(size, 0)).hexdigest()

    def place(self, file: str, size: int) -> Place | None:
        """Where the last complete line of a file ends; None if it has none."""
        with self.system.open_input_file(file) as data:
            end = size
            while end > 0:
                low = max(0, end - _STEP)
                at = data.read_at(end - low, low).rfind(b"\n")
                if at >= 0:
                    done = low + at + 1
                    head = min(HEAD_BYTES, done)
                    return Place(done, head, hashlib.sha256(data.read_at(head, 0)).hexdigest())
                end = low
        return None

    def is_same(self, file: str, size: int, place: Place) -> bool:
        """Whether a file of this size goes on from a place."""
        return size >= place.done and self.digest(file, place.head) == place.digest

    def ranges(self, start: dict[str, Place], end: dict[str, Place]) -> list[Range]:
        """What lies between two offsets.

        A file that is not where ``end`` has it any more is looked for among all files.  If it is nowhere, reading it fails:
        Spark also asks for the ranges of batches that are done, whose files may be gone.
        """
        sizes, gone = self.sizes(), set()
        for file, place in start.items():
            if file not in end or place.done > end[file].done or not self._continues(end[file], place, file, sizes):
                gone.add(file)
        out = []
        for name, place in end.items():
            file = name
            if file not in sizes or not self.is_same(file, sizes[file], place):
                file = next((f for f, size in sorted(sizes.items()) if self.is_same(f, size, place)), None)
            begin = 0
            if name in start and name not in gone:
                begin = start[name].done
            elif file is not None:
                moved = [s for f, s in start.items() if f in gone and s.done <= place.done and self.is_same(file, sizes[file], s)]
                begin = max((s.done for s in moved), default=0)
            for low in range(begin, place.done, SPLIT_BYTES):
                out.append(Range(file or name, low, min(place.done, low + SPLIT_BYTES), begin, place))
        return out

    def _continues(self, now: Place, before: Place, file: str, sizes: dict[str, int]) -> bool:
        """Whether what ``file`` was at one offset is what it is at a later one."""
        if now.head == before.head:
            return now.digest == before.digest
        if file in sizes and self.is_same(file, sizes[file], now):
            return self.is_same(file, sizes[file], before)
        return any(self.is_same(f, size, now) and self.is_same(f, size, before) for f, size in sizes.items())

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Lines that begin in a range, in batches."""
        if part.file not in self.sizes_of(part.file) or self.digest(part.file, part.place.head) != part.place.digest:
            raise FileNotFoundError(f"{part.file} is gone or was replaced, with {part.high - part.low} bytes that are to be read")
        with self.system.open_input_file(part.file) as data:
            at, rest = part.low, b""
            if at > part.begin:  # the line that goes on over the range's edge belongs to the range before
                at -= 1
                while True:
                    piece = data.read_at(min(_STEP, part.place.done - at), at)
                    found = piece.find(b"\n")
                    at += found + 1 if found >= 0 else len(piece)
                    if found >= 0 or not piece:
                        break
            begin = read = at
            while begin < part.high:
                piece = data.read_at(min(_STEP, part.place.done - read), read)
                if not piece:
                    break
                read += len(piece)
                *whole, rest = (rest + piece).split(b"\n")
                offsets, lines = [], []
                for line in whole:
                    if begin >= part.high:
                        break
                    offsets.append(begin)
                    lines.append(line.decode("utf-8", "replace"))
                    begin += len(line) + 1
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines)], schema=_ARROW)


def _places(offset: dict) -> dict[str, Place]:
    return {file: Place(*place) for file, place in offset.items()}


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.folder = Folder(path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for file, size in sorted(self.folder.sizes().items()):
            place = self.folder.place(file, size)
            if place is not None:
                found[file] = list(place)
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.folder.ranges(_places(start), _places(end))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.folder = Folder(path)

    def partitions(self) -> list[InputPartition]:
        end = {file: place for file, size in sorted(self.folder.sizes().items()) if (place := self.folder.place(file, size)) is not None}
        return self.folder.ranges({}, end) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition) if isinstance(partition, Range) else iter(())


class LogSource(DataSource):
    """A2: complete lines (file, offset, line) of the files below ``path``; ``offset`` is the byte at which a line begins.

    Register it with ``spark.dataSource.register(LogSource)``.  On a stream each batch has the lines that were completed since
    the last one, and the offsets are in the query's checkpoint: after a restart no line is lost or repeated.  Files may
    be appended to, renamed and removed; a file that was copied is a new one.  Batches read all complete lines once.
    An offset has an entry of some 100 bytes for each file, so files that are done with should be moved away.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])
