"""Small filters over users, genres, collections and single records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_BOOKS = 5


def find_users(users: DataFrame, text: str) -> DataFrame:
    """Users with the text somewhere in name or address, case apart; % and _ keep their LIKE meaning."""
    return users.where(F.col("username").ilike(f"%{text}%") | F.col("email").ilike(f"%{text}%"))


def same_user(users: DataFrame, text: str) -> DataFrame:
    """Users of this name or address, case apart."""
    low = F.lower(F.lit(text))
    return users.where((F.lower("username") == low) | (F.lower("email") == low))


def valid_invites(invites: DataFrame, code: str, now) -> DataFrame:
    """Invites of this code that end after now."""
    return invites.where((F.col("invite") == code) & (F.col("before_date") > F.lit(now)))


def with_token(users: DataFrame, column: str = "bot_token") -> DataFrame:
    return users.where(F.coalesce(F.col(column), F.lit("")) != "")


def genres_to_name(genres: DataFrame) -> DataFrame:
    """Genres whose title still is their code."""
    return genres.where(F.col("title") == F.col("genre"))


def genres_like(genres: DataFrame, text: str) -> DataFrame:
    low = F.lit(text.lower())
    return genres.where(F.contains(F.lower("genre"), low) | F.contains(F.lower("title"), low))


def by_key(rows: DataFrame, value, key: str = "id") -> DataFrame:
    """The row with this key, or none."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def sample_books(links: DataFrame, genre_id: int, n: int = SAMPLE_BOOKS) -> DataFrame:
    """book_id of n books of a genre, the lowest ids."""
    return links.where(F.col("genre_id") == genre_id).select("book_id").distinct().orderBy("book_id").limit(n)


def in_rank_order(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (id, ...) with the pos of ranked (id, pos), in that order; ranked ids whose row is gone drop out."""
    return rows.join(ranked.select("id", "pos"), "id").orderBy("pos")


def split_query(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with title and author: a query is cut at its first ` by `, and the title loses quotes at its ends."""
    parts = F.split(F.col(column), " by ", 2)
    both = F.size(parts) == 2
    title = F.when(both, F.btrim(parts[0], F.lit('"'))).otherwise(F.col(column))
    return queries.withColumn("title", title).withColumn("author", F.when(both & (title != ""), F.nullif(F.get(parts, F.lit(1)), F.lit(""))))


def shown_items(items: DataFrame, collections: DataFrame) -> DataFrame:
    """collection_id, book_id, position of matched items in public curated collections."""
    public = collections.where(F.col("is_curated") & F.col("is_public")).select(F.col("id").alias("collection_id"))
    found = items.where(F.col("book_id").isNotNull() & F.col("match_status").isin("auto_matched", "manual"))
    return found.join(public, "collection_id", "left_semi").select("collection_id", "book_id", "position")
