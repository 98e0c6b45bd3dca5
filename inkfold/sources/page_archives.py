"""Archives of pages (zip and cbz) as a Spark data source, for reading and writing.

Reading: `spark.read.format("page_archive").load(folder)` gives a row for each page image. Archives up to
`run_bytes` are packed into partitions by their file sizes alone; of larger ones the central directory is
read when planning, and each partition is a run of entries. A task reads an entry's bytes by range, one entry
at a time, so an archive of any size needs the memory of its largest page. A schema without `data` reads
directories only; one with `head binary` has the first bytes of each entry. With the option `push_filters` (and
spark.sql.python.filterPushdown.enabled) filters on path and archive are applied before anything is unpacked.

Writing: rows (archive, path, data, optionally place) become stored archives below the folder. A task writes a
part for each run of rows of one archive; the commit puts parts of an archive together in the order of their
first place, and only then do archives get their names. A failed job leaves nothing.

Options: `run_bytes`; `entries`, `pages` (page images, no hidden or system files) or `all`; `mode`, PERMISSIVE (an archive or
entry that can't be opened, and an archive without pages, give a row with the reason in `why`), DROPMALFORMED or FAILFAST.
"""

from __future__ import annotations

import datetime
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from inkfold.functions.text import IMAGE_TYPES
from inkfold.sources.headers import HEAD

SCHEMA = "archive string, path string, size long, modified timestamp, data binary, why string"
RUN_BYTES = 64 << 20
NO_PAGES = "no pages"
_ARCHIVE = re.compile(r"\.(zip|cbz)$", re.I)
_HIDDEN = re.compile(r"(^|/)__MACOSX/|(^|/)\.[^/]*$|/$")
_BROKEN = (zipfile.BadZipFile, zlib.error, struct.error, pa.ArrowInvalid, OSError, EOFError, NotImplementedError, RuntimeError)


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def type_of(name: str) -> str | None:
    """The image type that the last extension stands for."""
    ending = re.search(r"\.[^./]+$", name)
    return IMAGE_TYPES.get(ending[0].lower()) if ending else None


def is_page(path: str) -> bool:
    return not _HIDDEN.search(path) and type_of(path) is not None


def _kept(path: str, only: str) -> bool:
    return is_page(path) if only == "pages" else not path.endswith("/")


@dataclass
class Runs(InputPartition):
    """Archives, or runs of entries (from, to) of an archive."""

    runs: list[tuple[str, int, int | None]] = field(default_factory=list)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.columns = options["path"], schema.fieldNames()
        self.run_bytes = int(options.get("run_bytes", RUN_BYTES))
        self.only, self.mode = options.get("entries", "pages"), options.get("mode", "PERMISSIVE").upper()
        self.tests: list[tuple[str, str, object]] = []

    def _passes(self, column: str, value: str) -> bool:
        of = {"is": value.__eq__, "in": lambda v: value in v, "starts": value.startswith, "ends": value.endswith, "has": value.__contains__, "there": lambda v: True}
        return all(of[kind](wanted) for name, kind, wanted in self.tests if name == column)

    def _files(self) -> tuple[pyarrow.fs.FileSystem, str, list[pyarrow.fs.FileInfo]]:
        fs, root = located(self.uri)
        at = fs.get_file_info(root)
        if at.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        if at.type == pyarrow.fs.FileType.File:
            return fs, root.rpartition("/")[0], [at]
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return fs, root.rstrip("/"), sorted((f for f in found if f.type == pyarrow.fs.FileType.File and _ARCHIVE.search(f.path) and "/_" not in f.path[len(root) :]), key=lambda f: f.path)

    def partitions(self) -> Sequence[InputPartition]:
        fs, root, files = self._files()
        out, small, held = [], Runs(), 0
        for f in files:
            if not self._passes("archive", f.path[len(root) + 1 :]):
                continue
            if f.size > self.run_bytes:
                out += [Runs([(f.path, a, b)]) for a, b in self._cut(fs, f)]
                continue
            if small.runs and held + f.size > self.run_bytes:
                out.append(small)
                small, held = Runs(), 0
            small.runs.append((f.path, 0, None))
            held += f.size
        return [*out, small] if small.runs or not out else out

    def _cut(self, fs: pyarrow.fs.FileSystem, f: pyarrow.fs.FileInfo) -> Iterator[tuple[int, int | None]]:
        """Runs of entries whose wanted ones have about run_bytes; the whole archive if its directory can't be read."""
        try:
            with fs.open_input_file(f.path) as file, zipfile.ZipFile(file) as z:
                entries = [e.compress_size if self._wanted(e.filename) else 0 for e in z.infolist()]
        except _BROKEN:
            yield 0, None
            return
        first, held = 0, 0
        for i, size in enumerate(entries):
            if held and held + size > self.run_bytes:
                yield first, i
                first, held = i, 0
            held += size
        if held or not first:
            yield first, len(entries)

    def _wanted(self, path: str) -> bool:
        return _kept(path, self.only) and self._passes("path", path)

    def read(self, partition: Runs) -> Iterator[tuple]:
        fs, root = located(self.uri)
        if fs.get_file_info(root).type == pyarrow.fs.FileType.File:
            root = root.rpartition("/")[0]
        for path, first, last in partition.runs:
            about = {"archive": path[len(root.rstrip("/")) + 1 :], "modified": fs.get_file_info(path).mtime}
            about["modified"] = about["modified"].astimezone(datetime.timezone.utc) if about["modified"] else None
            for row in self._rows(fs, path, first, last):
                if row.get("why") and self.mode != "PERMISSIVE":
                    if self.mode == "FAILFAST" and row["why"] != NO_PAGES:
                        raise ValueError(f"{about['archive']}, {row.get('path')}: {row['why']}")
                    continue
                yield tuple((about | row).get(c) for c in self.columns)

    def _rows(self, fs: pyarrow.fs.FileSystem, path: str, first: int, last: int | None) -> Iterator[dict]:
        tested = any(name == "path" for name, _, _ in self.tests)
        try:
            with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                entries = z.infolist()
                latest = {e.filename: i for i, e in enumerate(entries)}  # of equal paths the last counts
                if first == 0 and not tested and not any(_kept(e.filename, self.only) for e in entries):
                    yield {"why": NO_PAGES}
                for i, e in enumerate(entries[first:last], first):
                    if not self._wanted(e.filename) or latest[e.filename] != i:
                        continue
                    row = {"path": e.filename, "size": e.file_size}
                    try:
                        if "data" in self.columns:
                            row["data"] = z.read(e)
                        if "head" in self.columns:
                            with z.open(e) as entry:
                                row["head"] = entry.read(HEAD)
                    except _BROKEN as why:
                        row["why"] = str(why)[:200]
                    yield row
        except _BROKEN as why:
            if not tested:
                yield {"why": str(why)[:200]}


class FilteringReader(ArchiveReader):
    """A reader that is asked to filter; Spark refuses one where the pushdown isn't enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes tests of path and archive; Spark applies the others."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", IsNotNull: "there"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("path",), ("archive",)):
                self.tests.append((f.attribute[0], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f


# Fixed values of the zip format: signatures and record layouts, little-endian
_LOCAL = struct.Struct("<4s5H3I2H")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_END = struct.Struct("<4s4H2IH")
_END64 = struct.Struct("<4sQ2H2I4Q")
_LOCATOR = struct.Struct("<4sIQI")
_UTF8, _DAY, _VERSION, _VERSION64, _FULL16, _FULL32 = 0x800, 0x21, 20, 45, 0xFFFF, 0xFFFFFFFF


def entry_header(name: bytes, crc: int, size: int) -> bytes:
    """What stands before a stored entry's bytes."""
    return _LOCAL.pack(b"PK\x03\x04", _VERSION, _UTF8, 0, 0, _DAY, crc, size, size, len(name), 0) + name


def directory(entries: Iterable[tuple[bytes, int, int, int]], start: int) -> Iterator[bytes]:
    """The central directory of stored entries (name, crc, size, offset), which begins at `start`, and what ends the file."""
    n = length = 0
    for name, crc, size, at in entries:
        far = struct.pack("<2HQ", 1, 8, at) if at >= _FULL32 else b""
        record = _CENTRAL.pack(b"PK\x01\x02", _VERSION64, _VERSION64 if far else _VERSION, _UTF8, 0, 0, _DAY, crc, size, size, len(name), len(far), 0, 0, 0, 0, _FULL32 if far else at) + name + far
        n, length = n + 1, length + len(record)
        yield record
    if n >= _FULL16 or start >= _FULL32 or length >= _FULL32:
        yield _END64.pack(b"PK\x06\x06", _END64.size - 12, _VERSION64, _VERSION64, 0, 0, n, n, length, start)
        yield _LOCATOR.pack(b"PK\x06\x07", 0, start + length, 1)
    yield _END.pack(b"PK\x05\x06", 0, 0, min(n, _FULL16), min(n, _FULL16), min(length, _FULL32), min(start, _FULL32), 0)


@dataclass
class Part:
    """One task's run of an archive's entries: a file that is an archive by itself; its entries end at `body`."""

    archive: str
    order: tuple
    path: str
    body: int


@dataclass
class Parts(WriterCommitMessage):
    parts: list[Part]


class _OpenPart:
    """A part that is being written."""

    def __init__(self, fs: pyarrow.fs.FileSystem, part: Part):
        self.part, self.out = part, fs.open_output_stream(part.path)
        self.entries: dict[bytes, tuple[int, int, int]] = {}

    def add(self, path: str, data: bytes) -> None:
        name = path.encode()
        if name in self.entries:
            raise ValueError(f"{self.part.archive} has two entries {path}")
        header, crc = entry_header(name, zlib.crc32(data), len(data)), zlib.crc32(data)
        self.entries[name] = (crc, len(data), self.part.body)
        self.out.write(header)
        self.out.write(data)
        self.part.body += len(header) + len(data)

    def close(self) -> Part:
        for record in directory(((n, *e) for n, e in self.entries.items()), self.part.body):
            self.out.write(record)
        self.out.close()
        return self.part


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        missing = {"archive", "path", "data"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"archives need the columns {', '.join(sorted(missing))}")
        self.uri, self.overwrite = options["path"], overwrite
        self.work = f"_parts-{uuid.uuid4().hex}"

    def _place(self) -> tuple[pyarrow.fs.FileSystem, str]:
        fs, root = located(self.uri)
        return fs, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        fs, root = self._place()
        task, done, current = TaskContext.get(), [], None
        fs.create_dir(f"{root}/{self.work}", recursive=True)
        for batch in iterator:
            places = batch.column("place").to_pylist() if "place" in batch.schema.names else [0] * batch.num_rows
            for archive, path, data, place in zip(batch.column("archive"), batch.column("path"), batch.column("data"), places):
                archive, path, data = archive.as_py(), path.as_py(), data.as_py()
                if archive is None or path is None or ".." in archive.split("/"):
                    raise ValueError(f"no name for an archive or entry: {archive}, {path}")
                if current is None or current.part.archive != archive:
                    if current:
                        done.append(current.close())
                    name = f"{root}/{self.work}/{task.partitionId():08d}-{task.taskAttemptId()}-{len(done)}"
                    current = _OpenPart(fs, Part(archive, (place is None, place, task.partitionId(), len(done)), name, 0))
                current.add(path, data or b"")
        if current:
            done.append(current.close())
        return Parts(done)

    def _joined(self, fs: pyarrow.fs.FileSystem, parts: list[Part], target: str) -> None:
        """One archive of several parts: their bytes in order, copied in pieces, and a directory of all."""
        shift, seen = 0, set()
        entries = []
        with fs.open_output_stream(target) as out:
            for p in parts:
                with fs.open_input_file(p.path) as file:
                    with zipfile.ZipFile(file) as z:
                        own = [(e.filename.encode(), e.CRC, e.file_size, e.header_offset + shift) for e in z.infolist()]
                    file.seek(0)
                    left = p.body
                    while left and (piece := file.read(min(left, 1 << 20))):
                        out.write(piece)
                        left -= len(piece)
                for e in own:
                    if e[0] in seen:
                        raise ValueError(f"{p.archive} has two entries {e[0].decode()}")
                    seen.add(e[0])
                entries += own
                shift += p.body
            for record in directory(entries, shift):
                out.write(record)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, root = self._place()
        fs.create_dir(root, recursive=True)
        by_archive: dict[str, list[Part]] = {}
        for p in sorted((p for m in messages if m for p in m.parts), key=lambda p: p.order):
            by_archive.setdefault(p.archive, []).append(p)
        held = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.type == pyarrow.fs.FileType.File and _ARCHIVE.search(f.path)]
        if not self.overwrite and (there := {f"{root}/{a}" for a in by_archive}.intersection(held)):
            raise FileExistsError(min(there))
        ready = {}
        for n, (archive, parts) in enumerate(by_archive.items()):
            ready[archive] = parts[0].path
            if len(parts) > 1:
                ready[archive] = f"{root}/{self.work}/joined-{n}"
                self._joined(fs, parts, ready[archive])
        for archive, path in ready.items():
            fs.create_dir(f"{root}/{archive}".rpartition("/")[0], recursive=True)
            fs.move(path, f"{root}/{archive}")
        if self.overwrite:
            for path in set(held) - {f"{root}/{a}" for a in by_archive}:
                fs.delete_file(path)
        self._clear(fs, root)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear(*self._place())

    def _clear(self, fs: pyarrow.fs.FileSystem, root: str) -> None:
        work = f"{root}/{self.work}"
        if fs.get_file_info(work).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(work)


class PageArchives(DataSource):
    """Registered as `page_archive`; see the module."""

    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return (FilteringReader if self.options.get("push_filters", "").lower() == "true" else ArchiveReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(PageArchives)
