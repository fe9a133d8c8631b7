"""ZIP archives of documents as rows, one archive per task at a time, entries read as a stream."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the largest document that is read, in bytes.
MAX_BYTES = 512 << 20
ENTRIES = "archive string, entry string, size long, content binary, error string"


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, size, modified of all *.zip files below path, in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def safe_relative(c: Column) -> Column:
    """Whether a path stays below its base: relative, and no step leads up."""
    return (c != "") & ~c.rlike(r"^([/\\]|[A-Za-z]:)") & ~c.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def read_entries(archives: DataFrame, suffix: str = ".fb2", entries: list[str] | None = None, max_bytes: int = MAX_BYTES, with_content: bool = True) -> DataFrame:
    """archive, entry, size, content, error of the entries that end in suffix (or are named in entries).

    An entry that declares or yields more than max_bytes, or cannot be read, gives an error and no content; an
    archive that cannot be opened gives one row without an entry. Names are matched before anything is unpacked.
    """
    schema = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
    wanted = set(entries) if entries is not None else None

    def bounded(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        if info.file_size > max_bytes:
            return None, "too large"
        try:
            with z.open(info) as f:
                data = f.read(max_bytes + 1)
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError, EOFError) as e:
            return None, f"unreadable: {e}"
        return (None, "too large") if len(data) > max_bytes else (data, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                row = {"archive": name, "entry": None, "size": None, "content": None}
                try:
                    fs, path = pafs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                    with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                        for info in z.infolist():
                            if info.is_dir() or not (info.filename in wanted if wanted is not None else info.filename.lower().endswith(suffix)):
                                continue
                            data, error = bounded(z, info) if with_content else (None, None)
                            yield pa.RecordBatch.from_pylist([row | {"entry": info.filename, "size": info.file_size, "content": data, "error": error}], schema)
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    yield pa.RecordBatch.from_pylist([row | {"error": f"unreadable archive: {e}"}], schema)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n).mapInArrow(run, ENTRIES)
