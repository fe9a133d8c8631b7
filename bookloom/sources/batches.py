"""Batches of tables that are published whole or not at all, in two phases and once for each number.

First every table is written to a folder of the attempt, by Spark's own writer, whose task commits leave no halves; what
each table has to show is taken from the folder: parts, bytes and a digest of both. Then a manifest with all of that
appears under the number of the batch by one rename that fails where it is there. A number that is there is never
written again, so a stream that repeats a batch after a failure adds nothing; an attempt that dies leaves folders that no
manifest names. Readers take the batches whose tables all have what the manifest says, part by part.

Layout: <path>/data/<table>/batch=<n>/attempt=<id>/..., <path>/manifest/<n>.json. Readers join the data with the list of
whole batches, so neither parts nor batches pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "batch long, attempt string, table string, parts long, bytes long, digest long, schema string"
_PART = r"/data/([^/]+)/batch=(\d+)/attempt=([^/]+)/"


class BatchStore:
    #: Tables that are written at the same time.
    at_once = 4

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _file(self, batch: int) -> str:
        return f"{self.path}/manifest/{batch:012d}.json"

    def _has(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def committed(self, batch: int) -> bool:
        return self._has(self._file(batch))

    def parts(self, below: str = "data") -> DataFrame:
        """table, batch, attempt, parts, bytes, digest of what lies in the store, from names and sizes of files alone."""
        schema = "table string, batch long, attempt string, parts long, bytes long, digest long"
        if "*" not in below and not self._has(f"{self.path}/{below}"):
            return self.spark.createDataFrame([], schema)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/{below}").select("path", "length")
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        keyed = files.select(*[F.regexp_extract("path", _PART, k).alias(c) for k, c in enumerate(("table", "batch", "attempt"), 1)], "length", F.xxhash64(name, "length").alias("h"))
        found = keyed.groupBy("table", F.col("batch").cast("long").alias("batch"), "attempt").agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"), F.bit_xor("h").alias("digest"))
        return found.select("table", "batch", "attempt", "parts", "bytes", "digest")

    def _publish(self, batch: int, rows: list[dict]) -> None:
        """Make the manifest appear at once; an error if there is one."""
        jvm = self.spark._jvm
        final, part = self._file(batch), f"{self.path}/manifest/.{batch:012d}.{uuid.uuid4().hex}"
        fs, where = self._fs(part)
        out = fs.create(where, False)
        out.write(bytearray("\n".join(json.dumps(r) for r in rows).encode()))
        out.close()
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        target = jvm.org.apache.hadoop.fs.Path(final)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(where), fs.makeQualified(target), self.spark.sparkContext._gateway.new_array(option, 0))

    def _abort(self, folders: list[str]) -> None:
        for folder in folders:
            fs, where = self._fs(folder)
            fs.delete(where, True)

    def commit(self, batch: int, tables: dict[str, DataFrame] | Callable[[], dict[str, DataFrame]], by: dict[str, list[str]] | None = None) -> bool:
        """Write the tables as that batch; False, and nothing is written or worked out, where the batch is there already.

        tables may be a function, so that what prepares them runs only if it is needed; by names the columns by which a
        table's files lie in folders of their own. A failure takes the attempt's
        folders away and is raised; so does a manifest that another writer has put there in the meantime.
        """
        if self.committed(batch):
            return False
        attempt = "a" + uuid.uuid4().hex
        folder = lambda name: f"{self.path}/data/{name}/batch={batch}/attempt={attempt}"
        made = tables() if callable(tables) else tables
        try:
            with ThreadPoolExecutor(self.at_once) as pool:
                write = lambda n, df: (df.write.partitionBy(*by[n]) if n in (by or {}) else df.write).parquet(folder(n))
                for done in [pool.submit(write, *x) for x in made.items()]:
                    done.result()
            seen = {r["table"]: r.asDict() for r in self.parts(f"data/*/batch={batch}/attempt={attempt}").collect()}  # a row for each table
            empty = {"parts": 0, "bytes": 0, "digest": 0}
            rows = [{"batch": batch, "attempt": attempt, "table": n, "schema": df.schema.json()} | {c: seen.get(n, empty)[c] for c in empty} for n, df in made.items()]
            self._publish(batch, rows)
        except BaseException:
            self._abort([folder(name) for name in made])
            raise
        return True

    def manifest(self) -> DataFrame:
        if not self._has(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).option("pathGlobFilter", "[0-9]*.json").json(f"{self.path}/manifest")

    def whole(self) -> DataFrame:
        """batch, attempt of the batches whose tables all have every part that the manifest counts."""
        there = self.parts().select(F.col("table"), "batch", "attempt", *[F.col(c).alias(f"got_{c}") for c in ("parts", "bytes", "digest")])
        checked = self.manifest().join(there, ["table", "batch", "attempt"], "left")
        same = F.lit(True)
        for c in ("parts", "bytes", "digest"):
            same = same & (F.coalesce(f"got_{c}", F.lit(0)) == F.col(c))
        return checked.groupBy("batch", "attempt").agg(F.bool_and(same).alias("whole")).where("whole").select("batch", "attempt")

    def read(self, table: str, schema: T.StructType | str | None = None, before: int | None = None, taken: DataFrame | None = None) -> DataFrame:
        """The table over all whole batches (with numbers below before, or those of taken, out of whole()), with its batch as a column.

        The columns are those of the newest batch; older ones give nulls for what they lack. schema serves where no
        batch has the table yet.
        """
        newest = self.manifest().where(F.col("table") == table).orderBy(F.desc("batch")).select("schema").limit(1).collect()
        if newest:
            schema = T.StructType.fromJson(json.loads(newest[0]["schema"]))
        elif schema is None:
            raise ValueError(f"no batch has a table {table}")
        else:
            schema = self.spark.createDataFrame([], schema).schema
        if not newest or not self._has(f"{self.path}/data/{table}"):
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
        keyed = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])
        data = self.spark.read.schema(keyed).parquet(f"{self.path}/data/{table}")
        taken = self.whole() if taken is None else taken
        taken = taken if before is None else taken.where(F.col("batch") < before)
        return data.join(taken, ["batch", "attempt"], "left_semi").select(*[F.col(f"`{f.name}`") for f in schema.fields], "batch")

    def clean(self) -> int:
        """Take away the folders of attempts that no manifest names; gives how many. Not while a batch is being written."""
        lost = self.parts().join(self.manifest(), ["table", "batch", "attempt"], "left_anti").select("table", "batch", "attempt")
        n = 0
        for r in lost.toLocalIterator():
            fs, where = self._fs(f"{self.path}/data/{r['table']}/batch={r['batch']}/attempt={r['attempt']}")
            n += fs.delete(where, True)
        return n


def publish_stream(stream: DataFrame, store: BatchStore, tables: Callable[[DataFrame, int], dict[str, DataFrame]], checkpoint: str, finish: bool = False):
    """A query that commits tables(rows, n) for each batch; a batch that comes again after a failure is there or is written whole."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: store.commit(n, lambda: tables(df, n)) and None)
    return (writer.trigger(availableNow=True) if finish else writer).start()
