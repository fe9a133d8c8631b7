"""Catalog lists: scoped, filtered, ordered and paged; details are joined to the page only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.operators.search import BookSearch, page_of, scoped, visible
from bookloom.plans.catalog import Catalog

LIST_LIMIT = 100


def list_books(catalog: Catalog, r: BookSearch) -> DataFrame:
    """id and pos of a plain list, newest first; a list by title is refused."""
    if r.query:
        raise ValueError("lists take no title; use search_books")
    rows = scoped(visible(catalog.book, r.unapproved, r.include_hidden, r.lang), catalog, r)
    return page_of(rows.select("id"), [F.desc("id")], r.limit if 0 < r.limit <= LIST_LIMIT else LIST_LIMIT, r.offset)


def favorite_list(catalog: Catalog, user_id: int, limit: int = LIST_LIMIT, offset: int = 0) -> DataFrame:
    """The user's favorites, the latest first."""
    own = catalog.favorite.where(F.col("user_id") == user_id).select(F.col("book_id"), F.col("id").alias("fav_id"))
    rows = visible(catalog.book).join(own, F.col("id") == F.col("book_id")).select("id", "fav_id")
    return page_of(rows, [F.desc("fav_id"), F.desc("id")], limit, offset)


def popular_books(catalog: Catalog, limit: int = LIST_LIMIT, offset: int = 0) -> DataFrame:
    """Books with at least one favorite, by number of favorites, then id."""
    likes = catalog.favorite.groupBy("book_id").agg(F.count("*").alias("favorite_count"))
    rows = visible(catalog.book).join(likes, F.col("id") == F.col("book_id")).select("id", "favorite_count")
    return page_of(rows, [F.desc("favorite_count"), F.desc("id")], limit, offset)


def collection_list(catalog: Catalog, collection_id: int, limit: int = LIST_LIMIT, offset: int = 0) -> DataFrame:
    own = catalog.collection_book.where(F.col("book_collection_id") == collection_id).select("book_id", "position")
    rows = visible(catalog.book).join(own, F.col("id") == F.col("book_id")).select("id", "position")
    return page_of(rows, [F.asc("position"), F.asc("id")], limit, offset)


def in_given_order(rows: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows whose key is in ids, with its place there."""
    given = F.array(*map(F.lit, ids)) if ids else F.array().cast("array<bigint>")
    return rows.where(F.col(key).isin(ids)).withColumn("pos", F.array_position(given, F.col(key)))


def languages(catalog: Catalog) -> DataFrame:
    """Languages with their number of books. Hidden books do not count, unapproved ones do."""
    return catalog.book.where(~F.col("duplicate_hidden")).groupBy("lang").agg(F.count("*").alias("books"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with rn; Spark limits each group before the exchange."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def with_related(page: DataFrame, links: DataFrame, names: DataFrame, link_key: str, name_col: str, out: str) -> DataFrame:
    """page (id, ...) with an array of (id, name) of its related rows, in order of id; the page is the small side."""
    related = links.join(page.select(F.col("id").alias("book_id")).distinct(), "book_id", "left_semi")
    named = related.join(names.select(F.col("id").alias(link_key), F.col(name_col).alias("_name")), link_key)
    per = named.groupBy(F.col("book_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct(F.col(link_key).alias("id"), F.col("_name").alias("name")))).alias(out))
    empty = F.array().cast(per.schema[out].dataType)
    return page.join(per, "id", "left").withColumn(out, F.coalesce(out, empty))


def mark_favorites(page: DataFrame, catalog: Catalog, user_id: int) -> DataFrame:
    own = catalog.favorite.where(F.col("user_id") == user_id).select(F.col("book_id").alias("id")).distinct().withColumn("_own", F.lit(True))
    return page.join(own, "id", "left").withColumn("fav", F.coalesce("_own", F.lit(False))).drop("_own")


def series_numbers(page: DataFrame, catalog: Catalog) -> DataFrame:
    return page.join(catalog.book_series.select(F.col("book_id").alias("id"), "ser_id", "ser_no"), "id", "left")


def all_words_like(c: Column, query: str) -> Column:
    """Every word of the query somewhere in c, case apart; % and _ keep their LIKE meaning."""
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.lower(c).like(f"%{w}%")
    return out


def page_count(total: int, limit: int) -> int:
    return -(-total // limit) if limit > 0 else 0


def has_next(offset: int, items: int, total: int) -> bool:
    return offset + items < total


#: The columns that a user list may be ordered by.
USER_ORDER = ["id", "username", "email", "date_joined"]


def dynamic_order(column: str, descending: bool, allowed: list[str] | None = None) -> list[Column]:
    """A column from the list of allowed ones (else the first), and the first as tie-break."""
    allowed = allowed or USER_ORDER
    column = column if column in allowed else allowed[0]
    first = F.desc(column) if descending else F.asc(column)
    return [first] if column == allowed[0] else [first, F.asc(allowed[0])]
