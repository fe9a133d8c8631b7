"""Line dedup across documents, down to one keep bitmap per document.

Lines become (hash, document, position) rows. They are dealt by ranges of (hash, document), so a line that a third of
all documents hold spreads over many tasks, and sorted by hash, document from the largest, and position. Each task
streams its rows: the first document of a hash keeps its lines, later ones lose theirs once a third document shows.
A hash can go on from one task into the next, so rows of a task's first hash wait, and each task sums up its last
hash; both are settled by a join with the totals of those few hashes (two a task at most). What comes out is, for each
document that loses lines, a zlib-compressed bitmap over its lines (1: stays); texts are not part of the exchange.

Defined cases: a null or empty text is one empty line; rows that share a doc_id are one document (each keeps its own
bitmap, by a hash of its text); a null doc_id counts as the smallest one; an empty table gives no rows; other columns
pass through apply_bitmaps untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import SPACE_CLASS, ascii_lower, free_name, free_prefix, remove, small_batches, written

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Words that a document which loses lines must have left in the pipeline.
LEAST_WORDS = 50
_STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
_STREAMED = "kind int, key binary, doc long, th long, pos int, n long"
_DROP, _WAITS, _SUM = 0, 1, 2


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def _doc(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(-(1 << 63)))


def line_rows(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """key (16-byte hash), doc, th (hash of the text), pos for every line that is long enough."""
    whole = docs.select(_doc(id_col).alias("doc"), F.xxhash64(_text(text_col)).alias("th"), _text(text_col).alias("text"))
    rows = whole.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))  # the hash is below: else it is taken again for each line
    keyed = rows.select("doc", "th", "pos", ascii_lower(F.btrim("line", F.lit(_STRIP))).alias("line")).where(F.char_length("line") >= least_chars)
    return keyed.select(F.unhex(F.md5("line")).alias("key"), "doc", "th", "pos")


def stream_first(batches: Iterator[pa.RecordBatch], least_docs: int = LEAST_DOCS) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: rows to drop, rows that wait for other partitions, and the sum of the last hash."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])

    def out(kind: int, key, doc, th, pos, n) -> pa.RecordBatch:
        keys = pa.nulls(len(doc), pa.binary()) if key is None else pa.array([key] * len(doc), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), keys, pa.array(doc), pa.array(th), pa.array(pos), pa.array(n)], schema=schema)

    key_now, doc_now, seen, run, top, held = None, None, 0, -1, None, []  # top: the last hash's largest document here
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch.column(0).to_pylist(), dtype="S16")
        doc, th, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        new_key = np.empty(len(doc), bool)
        new_key[0], new_key[1:] = keys[0] != key_now or run < 0, keys[1:] != keys[:-1]
        new_doc = new_key.copy()
        new_doc[0] |= doc[0] != doc_now
        new_doc[1:] |= doc[1:] != doc[:-1]
        total = np.cumsum(new_doc)
        runs = np.cumsum(new_key)
        starts = np.flatnonzero(new_key)
        base = np.concatenate([[-seen], total[starts] - 1])
        rank = total - base[runs]
        last = np.concatenate([starts - 1, [len(doc) - 1]])  # of run 0 (goes on from before) and of each new one
        most = np.where(last >= 0, rank[last], seen)
        if run >= 0 and held and (starts[0] if len(starts) else len(doc)) > 0 and most[0] >= least_docs and run > 0:
            for h in held:
                yield out(_DROP, None, *h, np.zeros(len(h[0]), np.int64))
            held = []
        first = runs + run == 0
        if first.any():
            yield out(_WAITS, bytes(keys[0]).ljust(16, b"\0"), doc[first], th[first], pos[first], new_doc[first].astype(np.int64))
        gone = ~first & (rank > 1) & (most[runs] >= least_docs)
        if gone.any():
            yield out(_DROP, None, doc[gone], th[gone], pos[gone], np.zeros(gone.sum(), np.int64))
        if len(starts):
            held = []
            top = doc[starts[-1]]
        wait = ~first & (runs == runs[-1]) & (rank > 1) & (most[runs] < least_docs)
        if wait.any():
            held.append((doc[wait], th[wait], pos[wait]))
        key_now, doc_now, seen, run = keys[-1], doc[-1], int(rank[-1]), run + len(starts)
    if run > 0:
        key = bytes(key_now).ljust(16, b"\0")
        yield out(_SUM, key, np.array([top]), np.zeros(1, np.int64), np.zeros(1, np.int32), np.array([seen]))
        for h in held:
            yield out(_WAITS, key, *h, np.zeros(len(h[0]), np.int64))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, th, n_dropped, keep (compressed bitmap) of every document that loses lines; others keep all."""
    spent: list[str] = []
    rows = written(line_rows(docs, id_col, text_col, least_chars), "keys", spent)  # dealing by ranges reads its rows twice
    dealt = rows.repartitionByRange(F.col("key"), F.col("doc").desc()).sortWithinPartitions("key", F.col("doc").desc(), "th", "pos")
    streamed = written(dealt.mapInArrow(lambda b: stream_first(b, least_docs), _STREAMED), "lines")
    remove(docs.sparkSession, spent)
    return bitmaps(settle(streamed, least_docs))


def settle(streamed: DataFrame, least_docs: int) -> DataFrame:
    """doc, th, pos of all lines to drop. streamed is read twice and should be written."""
    edges = streamed.where(F.col("kind") != _DROP)
    totals = edges.groupBy("key").agg(F.sum("n").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= least_docs)
    settled = edges.where(F.col("kind") == _WAITS).join(F.broadcast(totals), "key")  # two keys a task at most
    settled = settled.where(F.col("doc") != F.col("top"))
    return streamed.where(F.col("kind") == _DROP).select("doc", "th", "pos").unionByName(settled.select("doc", "th", "pos"))


def bitmaps(drops: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def pack(positions: pd.Series) -> pd.Series:
        def one(at):
            bits = np.ones(int(max(at)) // 8 * 8 + 8, np.uint8)
            bits[np.asarray(at, np.int64)] = 0
            return zlib.compress(np.packbits(bits).tobytes())

        return positions.map(one)

    grouped = drops.groupBy("doc", "th").agg(F.collect_set("pos").alias("at"))
    return grouped.select("doc", "th", F.size("at").cast("long").alias("n_dropped"), pack("at").alias("keep"))


def kept_lines(text: str, keep: bytes) -> str:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i >= len(bits) or bits[i])


def apply_bitmaps(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut down to the kept lines, plus n_dropped (underscores after the name where docs has it); a null text stays null."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else kept_lines(t, k) for t, k in zip(text, keep)], dtype=object)

    small_batches(docs.sparkSession)
    p = free_prefix("_l_", docs.columns)
    named = {c: p + c for c in ("doc", "th", "n_dropped", "keep")}
    found = found.select(*[F.col(c).alias(n) for c, n in named.items()])
    doc, th, n, keep = (F.col(x) for x in named.values())
    joined = docs.join(found, (_doc(id_col) == doc) & (F.xxhash64(_text(text_col)) == th), "left")
    text = F.col(f"`{text_col}`")
    joined = joined.withColumn(f"{p}cut", cut(F.when(keep.isNotNull(), text), keep))
    text = F.when(keep.isNotNull(), F.col(f"{p}cut")).otherwise(text).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.coalesce(n, F.lit(0)).cast("long").alias(free_name("n_dropped", docs.columns)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = docs.withColumn("n_lines", F.regexp_count(_text("text"), F.lit("\n")).cast("long") + 1)
    cut = apply_bitmaps(counted, keep_bitmaps(docs))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(_text("text"), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; n_chars follows where it is there.

    A document that loses lines and has fewer than LEAST_WORDS words left goes: what it said stands in the document
    that keeps the lines, and the floor of the quality rules holds for what training sees.
    """
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    n_dropped = F.col(free_name("n_dropped", docs.columns))
    words = F.regexp_count(_text("text"), F.lit(SPACE_CLASS.replace("[", "[^") + "+"))
    cut = cut.where((n_dropped == 0) | (words >= LEAST_WORDS)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS stripped
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, length(stripped) >= 20 AS long FROM l
), g AS (
  SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE long GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.long AND g.top <> k.doc_id, false) AS gone FROM k LEFT JOIN g USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
