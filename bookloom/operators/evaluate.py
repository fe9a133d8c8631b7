"""Relevance evaluation: recall at k, reciprocal rank, zero-result rate, percentiles and the regression verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.operators.ranges import running_sum

EPS = 1e-9


def score_queries(results: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """name, top_k, total, relevant, recall_at_k, reciprocal_rank, zero_result.

    results: name, id, pos (from 1), total; relevant: name, id; queries: name, top_k. Queries without relevant ids
    get zeros and are not scored in aggregates.
    """
    want = relevant.select("name", "id").distinct()
    n = want.groupBy("name").agg(F.count("*").alias("relevant"))
    top = queries.select("name", "top_k")
    hits = results.where(F.col("id").isNotNull()).join(want, ["name", "id"], "left_semi").join(top, "name")
    found = hits.groupBy("name").agg(F.count_if(F.col("pos") <= F.col("top_k")).alias("hits"), F.min("pos").alias("first"))
    totals = results.groupBy("name").agg(F.max("total").alias("total"))
    rows = top.join(n, "name", "left").join(found, "name", "left").join(totals, "name", "left").fillna(0, ["relevant", "hits", "total"])
    return rows.select(
        "name",
        "top_k",
        "total",
        "relevant",
        F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0).alias("recall_at_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("total") == 0).alias("zero_result"),
    )


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """One row over all queries; recall and reciprocal rank over those with relevant ids, the zero rate over all."""
    scored = F.col("relevant") > 0
    return scores.agg(
        F.count("*").alias("total_queries"),
        F.count_if(scored).alias("scored_queries"),
        F.coalesce(F.avg(F.when(scored, F.col("recall_at_k"))), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(scored, F.col("reciprocal_rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.col("zero_result").cast("double")), F.lit(0.0)).alias("zero_rate"),
    )


def compare_runs(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: shared_queries, deltas over shared queries, name lists, verdict (pass or regression).

    A query that the baseline has and this run lacks, or one whose accepted item or results are gone, is a regression,
    and so is a fall of an aggregate. A mere drop of one query's recall is listed only.
    """
    take = lambda df, p: df.select("name", *[F.col(c).alias(f"{p}_{c}") for c in ("relevant", "recall_at_k", "reciprocal_rank", "zero_result")], F.lit(True).alias(f"{p}_in"))
    both = take(current, "c").join(take(baseline, "b"), "name", "full_outer")
    here, there = F.coalesce("c_in", F.lit(False)), F.coalesce("b_in", F.lit(False))
    shared = here & there
    names = lambda when: F.sort_array(F.collect_set(F.when(when, F.col("name"))))
    lost = ((F.col("b_reciprocal_rank") > EPS) & (F.col("c_reciprocal_rank") <= EPS)) | (~F.col("b_zero_result") & F.col("c_zero_result"))
    mean = lambda p, c: F.coalesce(F.avg(F.when(shared & (F.col(f"{p}_relevant") > 0), F.col(f"{p}_{c}"))), F.lit(0.0))
    zero = lambda p: F.coalesce(F.avg(F.when(shared, F.col(f"{p}_zero_result").cast("double"))), F.lit(0.0))
    row = both.agg(
        F.count_if(shared).alias("shared_queries"),
        names(here & ~there).alias("added"),
        names(there & ~here).alias("missing"),
        names(shared & (F.col("c_recall_at_k") < F.col("b_recall_at_k") - EPS)).alias("regressed"),
        names(shared & lost).alias("lost"),
        (mean("c", "recall_at_k") - mean("b", "recall_at_k")).alias("recall_delta"),
        (mean("c", "reciprocal_rank") - mean("b", "reciprocal_rank")).alias("mrr_delta"),
        (zero("c") - zero("b")).alias("zero_rate_delta"),
    )
    bad = (F.size("missing") > 0) | (F.size("lost") > 0) | (F.col("recall_delta") < -EPS) | (F.col("mrr_delta") < -EPS) | (F.col("zero_rate_delta") > EPS)
    return row.withColumn("verdict", F.when(bad, "regression").otherwise("pass"))


def _value_counts(rows: DataFrame, group: list[str], c: str) -> DataFrame:
    """group, value, upto (rows with this value or a lower one), n (rows of the group); nulls do not count."""
    counts = rows.where(F.col(c).isNotNull()).groupBy(*group, F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
    return running_sum(counts, group, ["_v"], F.col("_n"), "_upto", "_total")


def percentiles(rows: DataFrame, group: list[str], c: str, ps: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles, the value at rank ceil(p * n), from counts of values and their running sums."""
    at = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_total")), F.lit(1))
    return _value_counts(rows, group, c).groupBy(*group).agg(*[F.min(F.when(F.col("_upto") >= at(p), F.col("_v"))).alias(n) for n, p in ps.items()])


def floor_rank(rows: DataFrame, group: list[str], c: str, ps: dict[str, float]) -> DataFrame:
    """The other definition: the value at index floor(q * n) of the sorted values, the last one at most."""
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("_total")), F.col("_total") - 1)
    return _value_counts(rows, group, c).groupBy(*group).agg(*[F.min(F.when(F.col("_upto") > at(q), F.col("_v"))).alias(n) for n, q in ps.items()])


def throughput(rows: DataFrame, group: str, seconds: float) -> DataFrame:
    """Requests a second and the share of buffer hits, of rows with hits and reads."""
    total = F.sum("hits") + F.sum("reads")
    return rows.groupBy(group).agg((F.count("*") / F.lit(seconds)).alias("per_second"), F.coalesce(F.sum("hits") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("hit_ratio"))


def fingerprint(books: DataFrame, authors: DataFrame) -> DataFrame:
    one = books.agg(F.count("*").alias("books"), F.max("id").alias("max_book_id"))
    return one.join(authors.agg(F.count("*").alias("authors")), F.lit(True))
