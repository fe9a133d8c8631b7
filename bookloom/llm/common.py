"""What the operators of this subpackage share: the shared folder, written tables, byte classes."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one vectorised step handles at once inside a task.
STEP_BYTES = 1 << 20
#: Bytes that an Arrow batch of texts takes at most.
ARROW_BYTES = 8 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The character class of white space that all contracts here use.
SPACE_CLASS = r"[\x20\x09-\x0D]"


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="bookloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (one machine, as in tests) gets a temporary folder of its own and others an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts hold ARROW_BYTES at most, so that workers need the same memory whatever the texts.

    A session that has a smaller size keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, spent: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    The path is added to spent, for remove() once nothing reads the table any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if spent is not None:
        spent.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, spent: list[str]) -> None:
    """Delete written tables."""
    for p in spent:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spent.clear()


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores after it until it differs from all names in taken (case apart, as Spark has it)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def free_prefix(prefix: str, taken: list[str]) -> str:
    """prefix, with underscores after it until no name in taken begins with it."""
    while any(t.lower().startswith(prefix.lower()) for t in taken):
        prefix += "_"
    return prefix


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def text_steps(column: pa.Array, most: int = STEP_BYTES):
    """Cut a column of texts into runs of about so many bytes, at least one text each: yields (start, end)."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(column):
        yield start, len(column)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
