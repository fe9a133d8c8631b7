"""ZIP archives of documents as a data source, for batches and streams: spark.read.format("book_archives").

A large archive is dealt to several tasks by byte ranges: an entry belongs to the range in which its header lies, so no
task but the readers themselves has to open an archive, and planning needs file sizes alone. Small archives share a
task. Conditions on archive and entry are pushed down: they choose files before these are opened and entries before
these are unpacked. What cannot be read gives a row with an error, never a failed job.

Options: path (a folder, searched below too, or one file), suffix (of entries; .fb2), splitBytes, maxBytes (of an
entry), content (false: names and sizes alone), and for streams logPath (a shared folder) and maxArchives (a batch).

A stream notes the archives of each batch in logPath before it hands them out, so a query that goes on after a failure
reads the same archives in the same batch, and none twice. Archives are told apart by their paths; they must appear
whole, as by a rename.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from bookloom.functions.storage import file_system, small_batches
from bookloom.sources.archives import ENTRIES, MAX_BYTES

#: Bytes of archives that a task reads, about, and bytes of content in an Arrow batch.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: How many tasks may share a lookup of entries of one archive.
LOOKUP_SPREAD = 8
_SCHEMA = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_BROKEN = (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError, EOFError)


@dataclass
class Names:
    """What pushed conditions allow a name to be."""

    among: set[str] | None = None
    tests: list[tuple[str, str]] = field(default_factory=list)

    def narrow(self, names) -> None:
        self.among = set(names) if self.among is None else self.among & set(names)

    def allow(self, name: str) -> bool:
        by = {"starts": name.startswith, "ends": name.endswith, "contains": name.__contains__}
        return (self.among is None or name in self.among) and all(by[kind](value) for kind, value in self.tests)


class Split(InputPartition):
    """Byte ranges of archives: (archive, from, to), the first range of each from 0."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)


def find_archives(path: str) -> list[tuple[str, int]]:
    """(uri, size) of all *.zip files at or below path, in any case, in order of name."""
    fs, inside = file_system(path)
    scheme = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    info = fs.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        return []
    files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inside, recursive=True))
    return sorted((scheme + f.path, f.size) for f in files if f.is_file and (info.is_file or f.path.lower().endswith(".zip")))


def plan(archives: list[tuple[str, int]], split_bytes: int) -> list[Split]:
    """Ranges of at most split_bytes; ranges of several archives share a split as long as they fit."""
    out, held, size = [], [], 0
    for name, whole in archives:
        for lo in range(0, max(whole, 1), split_bytes):
            hi = min(lo + split_bytes, whole) if lo + split_bytes < whole else 1 << 62
            if held and size + min(hi, whole) - lo > split_bytes:
                out.append(Split(held))
                held, size = [], 0
            held.append((name, lo, hi))
            size += min(hi, whole) - lo
    return [*out, Split(held)] if held else out


def unpack(z: zipfile.ZipFile, info: zipfile.ZipInfo, max_bytes: int) -> tuple[bytes | None, str | None]:
    """Content or error of an entry; no more than max_bytes are unpacked, whatever it declares."""
    if info.file_size > max_bytes:
        return None, "too large"
    try:
        with z.open(info) as f:
            data = f.read(max_bytes + 1)
    except _BROKEN as e:
        return None, f"unreadable: {e}"
    return (None, "too large") if len(data) > max_bytes else (data, None)


def batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["content"] or b"") + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def entries_of(split: Split | None, suffix: str, names: Names, max_bytes: int, with_content: bool) -> Iterator[dict]:
    for archive, lo, hi in split.value if split is not None else []:  # no split: there is nothing to read
        row = {"archive": archive, "entry": None, "size": None, "content": None, "error": None}
        try:
            fs, path = file_system(archive)
            with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                mine = [i for i in z.infolist() if lo <= i.header_offset < hi and not i.is_dir() and i.filename.lower().endswith(suffix) and names.allow(i.filename)]
                for info in sorted(mine, key=lambda i: i.header_offset):
                    content, error = unpack(z, info, max_bytes) if with_content else (None, None)
                    yield row | {"entry": info.filename, "size": info.file_size, "content": content, "error": error}
        except _BROKEN as e:
            if lo == 0:
                yield row | {"error": f"unreadable archive: {e}"}


class _Options:
    def __init__(self, options):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".fb2").lower()
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.max_bytes = int(options.get("maxbytes", options.get("maxBytes", MAX_BYTES)))
        self.content = str(options.get("content", "true")).lower() != "false"
        self.log = options.get("logpath", options.get("logPath"))
        self.most = int(options.get("maxarchives", options.get("maxArchives", 1 << 31)))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options, self.archive, self.entry = options, Names(), Names()

    def pushFilters(self, filters):
        by = {"archive": self.archive, "entry": self.entry}
        kinds = {StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            names = by.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if names is not None and isinstance(f, EqualTo):
                names.narrow([f.value])
            elif names is self.archive and isinstance(f, IsNotNull):
                continue  # every row has one
            elif names is not None and isinstance(f, In):
                names.narrow(f.value)
            elif names is not None and type(f) in kinds:
                names.tests.append((kinds[type(f)], f.value))
            else:
                yield f
                continue
            if names is self.entry:
                yield f  # archives that cannot be opened give rows without an entry, which Spark takes out

    def partitions(self):
        found = [a for a in find_archives(self.options.path) if self.archive.allow(a[0])]
        return plan(found, self.options.split_bytes)

    def read(self, partition: Split):
        o = self.options
        return batches(entries_of(partition, o.suffix, self.entry, o.max_bytes, o.content))


class ArchiveStreamReader(DataSourceStreamReader):
    """Offsets are numbers of batches; the log has a file with the archives of each."""

    def __init__(self, options: _Options):
        if not options.log:
            raise ValueError("a stream of archives needs the option logPath")
        self.options, self.seen, self.last = options, set(), 0

    def _file(self, n: int) -> tuple[pafs.FileSystem, str]:
        fs, path = file_system(self.options.log)
        return fs, f"{path}/{n:09d}.json"

    def _batch(self, n: int) -> list[tuple[str, int]]:
        fs, path = self._file(n)
        with fs.open_input_stream(path) as f:
            return [tuple(x) for x in json.loads(f.read())]

    def _catch_up(self) -> None:
        while True:
            fs, path = self._file(self.last + 1)
            if not fs.get_file_info(path).is_file:
                return
            self.last += 1
            self.seen.update(name for name, _ in self._batch(self.last))

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        self._catch_up()
        new = [a for a in find_archives(self.options.path) if a[0] not in self.seen][: self.options.most]
        if new:
            fs, path = self._file(self.last + 1)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(json.dumps(new).encode())
            fs.move(part, path)
            self.last += 1
            self.seen.update(name for name, _ in new)
        return {"batch": self.last}

    def partitions(self, start: dict, end: dict):
        found = [a for n in range(start["batch"] + 1, end["batch"] + 1) for a in self._batch(n)]
        return plan(found, self.options.split_bytes)

    def read(self, partition: Split):
        o = self.options
        return batches(entries_of(partition, o.suffix, Names(), o.max_bytes, o.content))


class BookArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_archives"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(_Options(self.options))

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let conditions reach sources that are written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BookArchives)


def _split_bytes(spark: SparkSession) -> int:
    """spark.sql.files.maxPartitionBytes, SPLIT_BYTES at most: archives grow as they are unpacked."""
    size = re.fullmatch(r"(\d+)\s*([kmg]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower())
    return min(SPLIT_BYTES, int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]]) if size else SPLIT_BYTES


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """archive, entry, size, content, error of all archives at or below path; tasks read as many bytes as the session has them read of other files."""
    register(spark)
    return spark.read.format("book_archives").options(path=path, **{"splitBytes": _split_bytes(spark), **options}).load()


def stream_archives(spark: SparkSession, path: str, log_path: str, **options) -> DataFrame:
    """The same as a stream of archives as they appear."""
    register(spark)
    return spark.readStream.format("book_archives").options(path=path, logPath=log_path, **{"splitBytes": _split_bytes(spark), **options}).load()


def fetch_entries(wanted: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """archive, entry, size, content, error for each distinct row of wanted (archive, entry).

    Only the archives that are named are opened, each by a few tasks at most. A path that is no ZIP archive is taken as
    the document itself, whatever the entry; a name that the archive lacks gives an error. The first of several entries
    of one name counts.
    """

    def one(archive: str, entry: str, z: zipfile.ZipFile | None, names: dict[str, zipfile.ZipInfo], fs, path: str) -> dict:
        row = {"archive": archive, "entry": entry, "size": None, "content": None, "error": None}
        if z is not None:
            if entry not in names:
                return row | {"error": "file not found in archive"}
            content, error = unpack(z, names[entry], max_bytes)
            return row | {"size": names[entry].file_size, "content": content, "error": error}
        try:
            with fs.open_input_file(path) as raw:
                size = raw.size()
                return row | ({"size": size, "error": "too large"} if size > max_bytes else {"size": size, "content": raw.read()})
        except OSError as e:
            return row | {"error": f"unreadable: {e}"}

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, raw, z, names, fs, path = None, None, None, {}, None, ""
        try:
            for batch in found:
                for archive, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if archive != now:
                        for x in (z, raw):
                            if x is not None:
                                x.close()
                        now, raw, z, names = archive, None, None, {}
                        fs, path = file_system(archive)
                        try:
                            raw = fs.open_input_file(path)
                            z = zipfile.ZipFile(raw)
                            for info in z.infolist():
                                names.setdefault(info.filename, info)
                        except _BROKEN:
                            z = None
                    yield one(archive, entry, z, names, fs, path)
        finally:
            for x in (z, raw):
                if x is not None:
                    x.close()

    keys = wanted.where("archive IS NOT NULL AND entry IS NOT NULL").select("archive", "entry").distinct()
    dealt = keys.repartition("archive", F.pmod(F.xxhash64("entry"), F.lit(LOOKUP_SPREAD))).sortWithinPartitions("archive", "entry")
    return dealt.mapInArrow(lambda found: batches(rows(found)), ENTRIES)


def write_archives(books: DataFrame, path: str) -> DataFrame:
    """Write books (archive, entry, content) as ZIP files path/<archive>; gives archive (uri), entries, once run.

    An archive is one task's: its entries come in order of name and are packed one by one. It is written under a
    temporary name and then renamed, so tries that failed leave no archive behind.
    """
    small_batches(books.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        now, z, raw, part, n = None, None, None, "", 0

        def done() -> dict:
            z.close()
            raw.close()
            fs.move(part, f"{folder}/{now}")
            return {"archive": f"{path}/{now}", "entries": n}

        schema = pa.schema([("archive", pa.string()), ("entries", pa.int64())])
        for batch in found:
            for name, entry, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([done()], schema)
                    now, n, part = name, 0, f"{folder}/{name}.{uuid.uuid4().hex}.part"
                    fs.create_dir(part.rpartition("/")[0], recursive=True)
                    raw = fs.open_output_stream(part)
                    z = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(entry), content, zipfile.ZIP_DEFLATED)
                n += 1
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    dealt = books.select("archive", "entry", F.col("content").cast("binary").alias("content")).repartition("archive").sortWithinPartitions("archive", "entry")
    return dealt.mapInArrow(run, "archive string, entries long")
