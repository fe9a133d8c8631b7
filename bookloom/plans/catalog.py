"""Logical catalog tables, and how the star-schema test tables stand in for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text as T

#: Column types of the logical tables.
BOOK = "id long, title string, lang string, approved boolean, duplicate_hidden boolean, md5 string, registerdate timestamp"
AUTHOR = "id long, full_name string"
BOOK_AUTHOR = "book_id long, author_id long"
FAVORITE = "id long, user_id long, book_id long"
SERIES_LINK = "book_id long, ser_id long, ser_no int"
GENRE_LINK = "book_id long, genre_id long"
COLLECTION = "id long, name string, is_public boolean, is_curated boolean, created_at timestamp"
COLLECTION_BOOK = "book_collection_id long, book_id long, position int"
COLLECTION_ITEM = "id long, collection_id long, book_id long, external_title string, external_author string, match_status string, match_score float, position int"


@dataclass(frozen=True)
class Catalog:
    """DataFrames by role; those that a query does not use may be missing."""

    book: DataFrame
    author: DataFrame | None = None
    book_author: DataFrame | None = None
    favorite: DataFrame | None = None
    book_series: DataFrame | None = None
    book_genre: DataFrame | None = None
    collection: DataFrame | None = None
    collection_book: DataFrame | None = None
    collection_item: DataFrame | None = None

    def titled(self) -> DataFrame:
        """book with norm_title; stored catalogs keep that column, so that no query works it out again."""
        return self.book if "norm_title" in self.book.columns else self.book.withColumn("norm_title", T.normalize(F.col("title")))

    def named(self) -> DataFrame:
        return self.author if "norm_name" in self.author.columns else self.author.withColumn("norm_name", T.normalize(F.col("full_name")))


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """part as books, supplier as authors, lineitem as their links, orders as favorites, brands as series."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, item = read("part"), read("lineitem")
    book = part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 4 == 0, "de").otherwise("en").alias("lang"),
        (F.col("p_size") % 10 != 0).alias("approved"),
        (F.col("p_partkey") % 17 == 0).alias("duplicate_hidden"),
        F.col("p_brand").alias("series"),
        F.col("p_type").alias("genre"),
        T.normalize(F.col("p_name"), composed=True).alias("norm_title"),
    )
    author = read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), T.normalize(F.col("s_name"), composed=True).alias("norm_name"))
    favorite = item.join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    favorite = favorite.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("book_id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    collection_book = item.where("l_quantity > 45").groupBy((F.col("l_suppkey") % 20).alias("book_collection_id"), F.col("l_partkey").alias("book_id"))
    return Catalog(
        book=book,
        author=author,
        book_author=item.select(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("author_id")),
        favorite=favorite,
        book_series=part.select(F.col("p_partkey").alias("book_id"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("ser_id"), F.col("p_size").alias("ser_no")),
        collection_book=collection_book.agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position")),
    )
