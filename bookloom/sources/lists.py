"""Outside lists of author and title: CSV, pasted lines, JSON batches and query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators in order of precedence, and the most items and bytes of a JSON batch.
SEPARATORS = [";", "\t", ","]
MAX_ITEMS, MAX_REQUEST = 20_000, 5 << 20
ITEMS = "title: string, author: string, year: int, extra: map<string, string>"


def _year(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def _complete(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("title", F.btrim("title")).withColumn("author", F.btrim("author"))
    return rows.where((F.col("title") != "") & (F.col("author") != ""))


def read_csv_items(spark: SparkSession, path: str) -> DataFrame:
    """title, author, year. The header names the columns in any order and case; incomplete rows are left out."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    at = {c.strip().lstrip("\ufeff").lower(): c for c in rows.columns}
    if not {"title", "author"} <= set(at):
        raise ValueError('csv header must contain "title" and "author" columns')
    year = _year(F.col(f"`{at['year']}`")) if "year" in at else F.lit(None).cast("int")
    return _complete(rows.select(F.col(f"`{at['title']}`").alias("title"), F.col(f"`{at['author']}`").alias("author"), year.alias("year")))


def parse_lines(lines: DataFrame, c: str = "value") -> tuple[DataFrame, DataFrame]:
    """Items (author, title, year) and errors (value) of pasted lines `author<sep>title[<sep>year]`.

    The separator that most lines contain counts for all; of equally common ones the first.
    """
    text = F.btrim(F.regexp_replace(F.col(c), "^\ufeff|\r$", ""), F.lit(" \t"))
    rows = lines.select(F.regexp_replace(F.col(c), "^\ufeff|\r$", "").alias("value")).where(text != "")
    counts = rows.agg(*[F.count_if(F.contains("value", F.lit(s))).alias(f"c{i}") for i, s in enumerate(SEPARATORS)]).first()
    best = max(range(len(SEPARATORS)), key=lambda i: (counts[i] or 0, -i))
    sep = SEPARATORS[best]
    has = F.contains("value", F.lit(sep))
    parts = F.transform(F.split("value", sep), lambda p: F.btrim(p))
    items = rows.where(has).select(F.get(parts, F.lit(0)).alias("author"), F.get(parts, F.lit(1)).alias("title"), _year(F.get(parts, F.lit(2))).alias("year"))
    return _complete(items), rows.where(~has)


def read_json_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON batch of MAX_REQUEST bytes at most; 1 to MAX_ITEMS of them, and each has a title and an author."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    if size > MAX_REQUEST:
        raise ValueError(f"a batch has {MAX_REQUEST} bytes at most")
    rows = spark.read.schema(f"name string, source_url string, items array<struct<{ITEMS}>>").json(path, multiLine=True)
    items = rows.select(F.explode("items").alias("i")).select("i.*")
    n = items.limit(MAX_ITEMS + 1).count()
    if not 1 <= n <= MAX_ITEMS:
        raise ValueError(f"a batch has 1 to {MAX_ITEMS} items")
    return _complete(items)


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries; names must be unique and kinds known."""
    schema = "name string, kind string, query string, author_query string, language string, top_k int, expected_normalized_title string, expected_normalized_author string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    bad = rows.groupBy("name").agg(F.count("*").alias("n"), F.min(F.col("kind").isin("books", "authors") & (F.col("query") != "")).alias("ok")).where("n > 1 OR NOT coalesce(ok, false) OR name IS NULL")
    if not bad.isEmpty():
        raise ValueError("query names must be unique, with a known kind and a query")
    return rows.withColumn("top_k", F.coalesce("top_k", F.lit(10)))
