"""The folder that driver and executors share, tables written there, files by any file system, names free of clashes."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


#: Bytes that an Arrow batch of texts takes at most.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ARROW_BYTES at most, so that Python workers need the same memory however long the texts are.

    A session that has a smaller size keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="bookloom-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session (one machine) gets a temporary folder and others an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back: what is read repeatedly is worked out once, and a lost executor loses nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; paths without a scheme are local, file:/x counts as file:///x."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it until it differs from all names in taken (case apart, as Spark has it)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
