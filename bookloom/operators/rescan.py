"""Parsing books again: the scan that mends a catalog, and single previews that somebody approves or rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bookloom.operators.changes import apply_selected, diff_fields, one_each

#: How many errors a report keeps, and what a scan sets anew.
ERRORS = 500
SCANNED = ["title", "annotation", "lang", "docdate"]


def archive_groups(books: DataFrame) -> DataFrame:
    """path, books, first_id: one row per archive; ordered by path they come in the order in which a scan meets them."""
    return books.groupBy("path").agg(F.count("*").alias("books"), F.min("id").alias("first_id"))


def fix_scan(books: DataFrame, parsed: DataFrame) -> DataFrame:
    """books (path, filename, cover and the fields of SCANNED) after parsing again, with scan_error.

    parsed has path, filename, the same fields, cover and error. A book without a parsed file, or whose file failed,
    keeps all it has. A cover that is there once stays; the date of registration is never touched. Where a name was
    parsed more than once, a file that did not fail counts before one that did, then the largest fields in order.
    """
    fine_first = parsed.select("path", "filename", F.col("error").isNull().alias("fine"), *SCANNED, "cover", "error")
    new = one_each(fine_first, ["path", "filename"]).select(F.struct("path", "filename", "cover", "error", *SCANNED).alias("_n"))
    joined = books.join(new, (F.col("path") == F.col("_n.path")) & (F.col("filename") == F.col("_n.filename")), "left")
    error = F.when(F.col("_n").isNull(), "file not found in archive").otherwise(F.col("_n.error"))
    fine = error.isNull()
    fields = {c: F.col("_n")[c] for c in SCANNED} | {"cover": F.coalesce("cover", F.lit(False)) | F.coalesce("_n.cover", F.lit(False))}
    kept = [F.when(fine, fields[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in books.columns]
    return joined.select(*kept, error.alias("scan_error"))


def first_errors(scanned: DataFrame, n: int = ERRORS) -> DataFrame:
    """path, id, scan_error of the first n failed books in order of path and id."""
    return scanned.where(F.col("scan_error").isNotNull()).select("path", "id", "scan_error").orderBy("path", "id").limit(n)


def scan_report(scanned: DataFrame) -> DataFrame:
    """One row: archives, total, updated, failed."""
    failed = F.col("scan_error").isNotNull()
    return scanned.agg(F.countDistinct("path").alias("archives"), F.count("*").alias("total"), F.count_if(~failed).alias("updated"), F.count_if(failed).alias("failed"))


def write_scan(scanned: DataFrame, path: str) -> tuple[dict[str, int], DataFrame]:
    """Write fix_scan()'s books to path; the report (total, updated, failed) is gathered by the write itself, in one pass.

    Also gives the first errors, read from what was written: their columns alone, and only rows that failed.
    """
    seen, failed = Observation(), F.col("scan_error").isNotNull()
    watched = scanned.observe(seen, F.count("*").alias("total"), F.count_if(~failed).alias("updated"), F.count_if(failed).alias("failed"))
    watched.write.parquet(path)
    return dict(seen.get), first_errors(scanned.sparkSession.read.schema(scanned.schema).parquet(path))


def preview(rows: DataFrame) -> DataFrame:
    """rows (id, old, new) as pending changes: id, old, new, diff (names of the fields that differ); equal ones are none."""
    return rows.withColumn("diff", diff_fields()).where(F.size("diff") > 0)


def decide(pending: DataFrame, decisions: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays pending, and the fields of approved books (id, fields) for patch().

    decisions: id, approved, flags (by field; null: all). Both answers end a pending change; without one it stays. Of
    several answers for a book the one that rejects counts.
    """
    answers = decisions.groupBy("id").agg(F.min_by(F.struct("approved", "flags"), "approved").alias("_d"))
    stays = pending.join(answers.select("id"), "id", "left_anti")
    yes = pending.join(answers, "id").where("_d.approved").select("id", "old", "new", F.col("_d.flags").alias("flags"))
    return stays, apply_selected(yes, fields)
