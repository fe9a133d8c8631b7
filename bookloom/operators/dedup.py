"""Duplicates by content hash: groups, totals, and hiding all but the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 3


def hashed(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with md5 of their content; no content gives the empty hash, which never groups."""
    return rows.withColumn("md5", F.coalesce(F.md5(F.col(content).cast("binary")), F.lit("")))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """md5, count, book_ids in order, up to three titles in order, of every hash that two rows or more share."""
    known = rows.where(F.col("md5") != "")
    again = known.groupBy("md5").agg(F.count("*").alias("count")).where("count > 1")
    member = known.join(again.select("md5"), "md5", "left_semi")
    return member.groupBy("md5").agg(
        F.count("*").alias("count"), F.sort_array(F.collect_list("id")).alias("book_ids"), F.slice(F.sort_array(F.collect_set("title")), 1, EXAMPLES).alias("example_titles")
    )


def duplicate_members(rows: DataFrame) -> DataFrame:
    """md5 and id of every row of duplicate_groups: a row each in place of an array, whatever the size of a group."""
    known = rows.where(F.col("md5") != "")
    again = known.groupBy("md5").agg(F.count("*").alias("n")).where("n > 1")
    return known.join(again, "md5", "left_semi").select("md5", "id")


def duplicates_total(rows: DataFrame) -> DataFrame:
    """One row: groups, and the rows beyond the first of each."""
    n = rows.where(F.col("md5") != "").groupBy("md5").agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def hide_duplicates(rows: DataFrame) -> DataFrame:
    """rows with duplicate_hidden and duplicate_of_id worked out afresh: the highest id of a hash stays in view.

    A grouped maximum joined back, not a window, so that the copies of one text never sort in one task.
    """
    newest = rows.where(F.col("md5") != "").groupBy("md5").agg(F.max("id").alias("_keeper"))
    joined = rows.drop("duplicate_hidden", "duplicate_of_id").join(newest, "md5", "left")
    hidden = F.coalesce(F.col("_keeper") != F.col("id"), F.lit(False))
    return joined.withColumn("duplicate_hidden", hidden).withColumn("duplicate_of_id", F.when(hidden, F.col("_keeper"))).drop("_keeper")


def keep_first_seen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """On ingestion: rows whose hash the catalog does not have yet, the lowest id of each hash."""
    new = rows.join(known.where(F.col("md5") != "").select("md5"), "md5", "left_anti")
    first = new.where(F.col("md5") != "").groupBy("md5").agg(F.min("id").alias("id"))
    return new.join(first, ["md5", "id"], "left_semi").unionByName(new.where(F.col("md5") == ""))


def audit_keepers(rows: DataFrame) -> DataFrame:
    """Hidden rows whose keeper is missing or hidden itself: id, duplicate_of_id."""
    keeper = rows.select(F.col("id").alias("duplicate_of_id"), F.col("duplicate_hidden").alias("_h"))
    hidden = rows.where("duplicate_hidden").select("id", "duplicate_of_id")
    return hidden.join(keeper, "duplicate_of_id", "left").where(F.coalesce("_h", F.lit(True))).select("id", "duplicate_of_id")
