"""Exact duplicates of whole texts by a tree-merge of sorted digest runs.

Each document becomes a digest row: SHA-256 of its normal form, a second hash and the length of that form, its id, its
row and the slice of the input it came from. The texts are read once and not part of any exchange.

Every task over the digests gives a run: its digests in order, each with the identifier that stays and a count, packed
into blocks of a few thousand entries. The runs are merged in binomial rounds. There are fanout ** rounds places;
in round r a place keeps what belongs to its own r-th digit of the digest space and sends the rest to the places that
differ from it in this digit alone, so no place ever receives all, and every round lets equal digests of fanout runs
become one entry. A place reads its blocks in order of their first digest, so a multiway merge holds only blocks that
overlap. Digests count as equal only where the second hash and the length agree (verified at every level).

On the way back a merged entry of more than one row meets the slices that had its digest, one row a slice, and then the
rows of each slice: a text that a third of all documents share is never one group in one task.

Defined cases: a null text is empty, and empty texts are equal to each other; of rows that share text and id the last
row in reading order stays; a null id counts as the smallest one (largest=False: as the largest); an empty table gives
no rows; other columns, whatever their names, do not matter to digests and pass through drop_copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import ascii_lower, free_prefix, written

#: Entries of a block, and how many runs a place merges at most in a round.
BLOCK, FANOUT = 4096, 8

#: One entry of a run; id and row are those of the document that stays. Big-endian digests sort as bytes do.
ENTRY = np.dtype([("digest", "S32"), ("second", "<i8"), ("chars", "<i8"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
_KEY = ("digest", "second", "chars")
_BLOCKS = "place int, first binary, entries binary"
_SCHEMA = pa.schema([("place", pa.int32()), ("first", pa.binary()), ("entries", pa.binary())])
_LEAST = -(1 << 63)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form=ascii_lower, largest: bool = True) -> DataFrame:
    """doc_id, id (null: the id that loses), row, slice, digest, second, chars of every row; form gives the normal form of a text."""
    text = form(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    taken = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    lost = _LEAST if largest else -_LEAST - 1
    return taken.select(
        "doc_id", F.coalesce("doc_id", F.lit(lost)).alias("id"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("slice"),
        F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("second"), F.char_length("text").cast("long").alias("chars"),
    )


def merged(entries: np.ndarray, largest: bool = True) -> np.ndarray:
    """Entries in order of their key, equal keys as one: the id that stays, its last row, and the sum of n."""
    if not len(entries):
        return entries
    ids = entries["id"] if largest else ~entries["id"]
    order = np.lexsort((entries["row"], ids, entries["chars"], entries["second"], entries["digest"]))
    entries = entries[order]
    new = np.ones(len(entries), bool)
    new[1:] = np.logical_or.reduce([entries[k][1:] != entries[k][:-1] for k in _KEY])
    starts = np.flatnonzero(new)
    out = entries[np.append(starts[1:], len(entries)) - 1].copy()  # the last of each key has the id that stays
    out["n"] = np.add.reduceat(entries["n"], starts)
    return out


def blocks(entries: np.ndarray, place: int) -> Iterator[dict]:
    for at in range(0, len(entries), BLOCK):
        part = entries[at : at + BLOCK]
        yield {"place": place, "first": bytes(part["digest"][0]).ljust(32, b"\0"), "entries": part.tobytes()}


def _digit(digest: np.ndarray, places: int) -> np.ndarray:
    """The place that a digest belongs to in the end: its leading 32 bits dealt to the places in order."""
    head = np.frombuffer(digest.astype("S32").tobytes(), ">u4").reshape(len(digest), 8)[:, 0].astype(np.uint64)
    return (head * np.uint64(places) >> np.uint64(32)).astype(np.int64)


def sent(entries: np.ndarray, place: int, r: int, fanout: int, rounds: int) -> Iterator[dict]:
    """The blocks of a run for round r: each to the place that has the entry's r-th digit and else the digits of this one."""
    if not len(entries):
        return
    weight = fanout ** (rounds - 1 - r)
    digit = _digit(entries["digest"], fanout**rounds) // weight % fanout
    for d in np.unique(digit):
        yield from blocks(entries[digit == d], place + (int(d) - place // weight % fanout) * weight)


def leaf_runs(rows: DataFrame, fanout: int, rounds: int, largest: bool = True) -> DataFrame:
    """A sorted run of each task of digest rows, as blocks on their way into the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() % fanout**rounds
        for batch in batches:
            entries = np.empty(batch.num_rows, ENTRY)
            entries["digest"] = np.array(batch.column("digest").to_pylist(), "S32")
            for k in ("second", "chars", "id", "row"):
                entries[k] = batch.column(k).to_numpy(zero_copy_only=False)
            entries["n"] = 1
            yield from _batches(sent(merged(entries, largest), place, 0, fanout, rounds))

    return rows.select("digest", "second", "chars", "id", "row").sortWithinPartitions("digest").mapInArrow(run, _BLOCKS)


def _batches(rows: Iterator[dict], most: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def multiway(found: Iterator[pa.RecordBatch], largest: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Merge blocks that come in order of place and first digest: yields place and merged entries, in order.

    Entries before the next block's first digest cannot get company any more, so only the rest is held.
    """
    place, held, size = None, [], 0
    for batch in found:
        for k, first, packed in zip(*(batch.column(c).to_pylist() for c in ("place", "first", "entries"))):
            if place is not None and (k != place or size >= 4 * BLOCK):
                entries = merged(np.concatenate(held), largest)
                done = len(entries) if k != place else int(np.searchsorted(entries["digest"], np.bytes_(first), "left"))
                if done:
                    yield place, entries[:done]
                held = [entries[done:]]
                size = len(held[0])
            place = k
            held.append(np.frombuffer(packed, ENTRY))
            size += len(held[-1])
    if size:
        yield place, merged(np.concatenate(held), largest)


def tree_merge(runs: DataFrame, fanout: int, rounds: int, largest: bool = True) -> DataFrame:
    """digest, second, chars, keep, keep_row, n of all distinct texts, each place's in order, out of leaf_runs."""

    def pass_on(r: int):
        def step(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(b for place, entries in multiway(found, largest) for b in sent(entries, place, r, fanout, rounds))

        return step

    def unpacked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, e in multiway(found, largest):
            digest = pa.array([bytes(d).ljust(32, b"\0") for d in e["digest"]], pa.binary())
            yield pa.RecordBatch.from_arrays([digest, *[pa.array(np.ascontiguousarray(e[k])) for k in ENTRY.names[1:]]], names=["digest", "second", "chars", "keep", "keep_row", "n"])

    for r in range(1, rounds + 1):
        dealt = runs.repartitionById(fanout**rounds, F.col("place")).sortWithinPartitions("place", "first")
        runs = dealt.mapInArrow(pass_on(r), _BLOCKS) if r < rounds else dealt.mapInArrow(unpacked, "digest binary, second long, chars long, keep long, keep_row long, n long")
    return runs


def shape(parts: int, fanout: int = FANOUT) -> tuple[int, int]:
    """(fanout, rounds) with at least parts places, and a fanout no larger than the given one."""
    rounds = max(1, math.ceil(math.log(max(parts, 2)) / math.log(fanout) - 1e-9))
    return max(2, math.ceil(parts ** (1 / rounds) - 1e-9)), rounds


def copies(rows: DataFrame, largest: bool = True, parts: int | None = None) -> DataFrame:
    """rows (of digests(), written: they are read twice) with keep_id, group_size and kept."""
    spark = rows.sparkSession
    fanout, rounds = shape(parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = tree_merge(leaf_runs(rows, fanout, rounds, largest), fanout, rounds, largest).where("n > 1")
    key = ["digest", "second", "chars"]
    slices = rows.groupBy("slice", *key).agg(F.count("*").alias("here")).drop("here")
    answers = slices.join(groups, key)  # a row for each slice that has the digest
    found = rows.join(answers, ["slice", *key], "left")
    lost = F.lit(_LEAST if largest else -_LEAST - 1)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.nullif("keep", lost))
    kept = F.col("n").isNull() | (F.col("keep_row") == F.col("row"))
    return found.select(*[F.col(c) for c in rows.columns], keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form=ascii_lower, largest: bool = True, parts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, dropped ones too."""
    rows = written(digests(docs, id_col, text_col, form, largest), "digests")
    return copies(rows, largest, parts).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form=ascii_lower, largest: bool = True) -> DataFrame:
    """The documents that stay, all columns as they were; of rows that share id and normal form any one stays."""
    decided = exact_copies(docs, id_col, text_col, form, largest)
    p = free_prefix("_x_", docs.columns)
    theirs = decided.groupBy(F.col("doc_id").alias(f"{p}id"), F.col("text_sha256").alias(f"{p}text")).agg(F.max("kept").alias(f"{p}kept"), (F.count("*") > 1).alias(f"{p}more"))
    own = F.sha2(form(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 256)
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"{p}id")) & (own == F.col(f"{p}text"))
    left = docs.join(theirs.where(f"{p}kept"), same)
    every = left.where(~F.col(f"{p}more")).unionByName(left.where(f"{p}more").dropDuplicates([f"{p}id", f"{p}text"]))
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

