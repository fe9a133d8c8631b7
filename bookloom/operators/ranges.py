"""Ranks and running sums of long groups, by ranges of the order: no group is sorted in one task.

Bounds come from a sample that the values' own hashes choose, so the same rows give the same ranges. Rows are counted by
range, the few ranges of a group are summed in order, and only rows of one range are ordered against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.storage import free_name

#: Ranges, and how many values the sample has at most.
PARTS, SAMPLE = 64, 4096


def _key(rows: DataFrame, c: str) -> Column:
    return F.unix_micros(c) if rows.schema[c].dataType.typeName() == "timestamp" else F.col(c)


def bounds_of(rows: DataFrame, c: str, parts: int = PARTS) -> list:
    """At most parts - 1 values that cut the distinct values of c into ranges of about equal size: one aggregate over rows.

    Values are dealt to buckets by their hashes, and each bucket gives the value of its least hash.
    """
    values = rows.select(_key(rows, c).alias("v")).where("v IS NOT NULL").withColumn("h", F.xxhash64("v"))
    least = values.groupBy(F.pmod("h", F.lit(SAMPLE))).agg(F.min(F.struct("h", "v")).alias("m"))
    found = sorted(r["v"] for r in least.select("m.v").collect())
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


def range_of(key: Column, bounds: list) -> Column:
    """How many bounds are at or below key, by a balanced tree of comparisons; null is below all."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), -1).otherwise(tree(0, len(bounds))).cast("int")


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, out: str, total: str | None = None, sample: DataFrame | None = None) -> DataFrame:
    """rows with the running sum of value over each group in order (this row included), and on demand the group's total.

    Equal values of the first order column share a range, the others break ties. Bounds come from sample where it is
    given: rows with about the same values of that column that cost less to work out. One exchange by group and range
    serves both the sums of the ranges and the order within them.
    """
    taken = [*rows.columns, out, *([total] if total else [])]
    names = ["_range", "_value", "_inside", "_before", "_all", "_any", "_r", *(f"_g{i}" for i in range(len(group)))]
    n = dict(zip(names, (free_name(x, taken) for x in names)))
    bounds = bounds_of(rows if sample is None else sample, order[0])
    ranged = rows.withColumn(n["_range"], range_of(_key(rows, order[0]), bounds)).withColumn(n["_value"], value).repartition(*[F.col(g) for g in group], n["_range"])
    whole_row = F.any_value(F.struct(*[F.col(c) for c in ranged.columns]))  # both readers of the exchange need all columns, so it is one
    per = ranged.groupBy(*group, n["_range"]).agg(F.sum(n["_value"]).alias("in"), whole_row.alias(n["_any"]))
    keys = [n[f"_g{i}"] for i in range(len(group))]
    per = per.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(n["_range"]).alias(n["_r"]), "in", n["_any"])
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("in").over(whole.orderBy(n["_r"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn(n["_before"], before).withColumn(n["_all"], F.sum("in").over(whole)).where(F.col(n["_any"]).isNotNull()).drop("in", n["_any"])
    inside = F.sum(n["_value"]).over(Window.partitionBy(*group, n["_range"]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = F.col(n["_range"]) == F.col(n["_r"])
    for g, k in zip(group, keys):
        on = on & F.col(g).eqNullSafe(F.col(k))
    joined = ranged.withColumn(n["_inside"], inside).join(per, on)
    extra = [F.col(n["_all"]).alias(total)] if total else []
    return joined.select(*rows.columns, (F.col(n["_before"]) + F.col(n["_inside"])).alias(out), *extra)
