"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Column expressions only. Tokens are words here: a tokenizer would need Python, and shares of sources are what counts.
A source with share p of all tokens gets a weight in proportion to p ** exponent. The
exponent is bracketed in [0, 1] by repeated sectioning of the table of sources: the largest one whose weights reach
the target entropy, but never below the smallest one that keeps the repetition of any source, against the least
repeated, within the limit. With the default budget the least repeated source is read exactly once, so no document is
lost; a smaller budget cuts the last, partial permutation of each source.

Every pass over a source is a permutation by hash. A document's place in the mixture is (pass + tokens before it in
the pass / tokens of the source) / passes, so each block, a range of places, holds all sources by weight. Running sums
go over hash ranges of a few thousand documents and over the sums of those ranges, so no source meets in one task.

Defined cases: a null source counts as the source named by the empty string; a text without words has one token;
rows equal in doc_id, text and source are one document that is read as often as they are repeated; equal hashes are
ordered by doc_id and text, so the mixture of the same rows is the same; a null doc_id is an id like others; an empty table gives no rows; other columns are ignored (mixing_stage passes them on).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.llm.common import SPACE_CLASS, free_prefix, written

REPEATS, ENTROPY = 2.0, 0.95
BLOCK_TOKENS = 1 << 20
SECTIONS, ROUNDS = 16, 6
#: Documents in a range of hashes, about.
RANGE_DOCS = 4096
SEED = 17


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), source, tokens: one row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.greatest(F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^") + "+")), F.lit(1)).cast("long")
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words.alias("tokens"))
    return rows.groupBy("doc_id", "th", "source").agg(F.sum("tokens").alias("tokens"))


def measures(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent the entropy of the weights, in parts of the greatest possible, and the greatest repetition."""
    each = sources.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.pow("share", F.col("a"))
    rows = each.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(F.pow("share", F.col("a") - 1)).alias("top"), F.min(F.pow("share", F.col("a") - 1)).alias("low"), F.count("*").alias("n")
    )
    out = {}
    for r in rows.collect():  # one row for each exponent
        entropy = math.log(r["z"]) - r["a"] * r["l"] / r["z"]
        out[r["a"]] = (entropy / math.log(r["n"]) if r["n"] > 1 else 1.0, r["top"] / r["low"])
    return out


def find_exponent(sources: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS) -> float:
    """Section [0, 1] again and again; entropy falls and repetition falls as the exponent rises."""

    def bracket(fits_low: bool, ok) -> float:
        """The end of the range in which ok holds: its largest point if it holds below, else its smallest."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
            found = measures(sources, grid)
            if not found:
                return high
            good = [ok(*found[a]) for a in grid]
            if fits_low:
                at = max((i for i, g in enumerate(good) if g), default=None)
                if at is None or at == SECTIONS:
                    return low if at is None else high
                low, high = grid[at], grid[at + 1]
            else:
                at = min((i for i, g in enumerate(good) if g), default=None)
                if at is None or at == 0:
                    return high if at is None else low
                low, high = grid[at - 1], grid[at]
        return low if fits_low else high

    slack = 1 + 1e-12
    a = bracket(True, lambda h, _: h * slack >= entropy) if entropy is not None else 1.0 if repeats is None else 0.0
    return max(a, bracket(False, lambda _, r: r <= repeats * slack)) if repeats is not None else a


def source_plan(rows: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """source, total (tokens), share, weight, passes: a table of one row per source, written."""
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("total"))
    whole = totals.agg(F.sum("total")).first()[0] or 1
    sources = written(totals.withColumn("share", F.col("total") / F.lit(float(whole))), "sources")
    a = find_exponent(sources, entropy, repeats)
    found = sources.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.min(F.pow("share", F.lit(a - 1))).alias("low")).first()
    z, low = found["z"] or 1.0, found["low"] or 1.0
    once = whole * z / low  # the budget at which the least repeated source is read once
    factor = 1.0 if budget is None else budget * low / (whole * z)
    plan = sources.select("source", "total", "share", (F.pow("share", F.lit(a)) / z).alias("weight"), (F.pow("share", F.lit(a - 1)) / low * factor).alias("passes"))
    return written(plan.withColumn("budget", F.lit(float(once if budget is None else budget))), "plan")


def sums_before(sums: DataFrame, bits: int) -> DataFrame:
    """source, pass, range, base: the tokens in lower ranges. Ranges have so many bits and are summed in two steps, so that a task orders about a root of their number."""
    rows = sums.withColumn("upper", F.shiftright("range", (bits + 1) // 2))
    each = rows.groupBy("source", "pass", "upper").agg(F.sum("in_range").alias("in_upper"))
    below = lambda value, by, order: F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("source", "pass", "upper", below("in_upper", ["source", "pass"], "upper").alias("before"))
    rows = rows.withColumn("inner", below("in_range", ["source", "pass", "upper"], "range")).join(each, ["source", "pass", "upper"])
    return rows.select("source", "pass", "range", (F.col("before") + F.col("inner")).alias("base"))


def mixture(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, th, source, tokens, pass, place (in [0, 1)), block, key: read blocks in turn, and each in order of key."""
    rows = written(token_rows(docs), "tokens")
    plan = source_plan(rows, entropy, repeats, budget)
    bits = max(1, math.ceil(math.log2(max(rows.count() / RANGE_DOCS, 1))) + 1)
    blocks = max(1, math.ceil((plan.agg(F.max("budget")).first()[0] or 0) / block_tokens))
    each = rows.join(plan, "source").where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), (F.ceil("passes") - 1).cast("int"))))
    each = each.withColumn("key", F.xxhash64("doc_id", "th", "pass", F.lit(SEED))).withColumn("range", F.shiftrightunsigned("key", 64 - bits))
    sums = sums_before(each.groupBy("source", "pass", "range").agg(F.sum("tokens").alias("in_range")), bits)
    inside = Window.partitionBy("source", "pass", "range").orderBy("key", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["source", "pass", "range"])
    placed = placed.withColumn("place", (F.col("pass") + (F.col("base") + F.col("inner")) / F.col("total")) / F.col("passes")).where("place < 1")
    block = F.floor(F.col("place") * blocks).cast("long")
    return placed.select("doc_id", "th", "source", "tokens", "pass", "place", block.alias("block"), "key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).drop("th")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture reads it, all columns kept.

    How often says it all here: the columns of documents have no place for pass and block, so the packing stage deals its
    sequences to reading blocks, in each of which sources stand by these weights.
    """
    p = free_prefix("_m_", docs.columns)
    key = ["doc_id", "th", "source"]
    often = mixture(docs).groupBy(*[F.col(c).alias(p + c) for c in key]).agg(F.count("*").cast("int").alias(f"{p}n"))
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    on = docs["doc_id"].eqNullSafe(often[f"{p}doc_id"]) & (F.xxhash64(text) == often[f"{p}th"]) & (source == often[f"{p}source"])
    again = docs.join(often, on).withColumn(f"{p}again", F.explode(F.sequence(F.lit(1), F.col(f"{p}n"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
