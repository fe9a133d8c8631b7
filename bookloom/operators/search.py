"""Ranked title search, author search and suggestions over a catalog.

One scan of the visible books works out all signals; scopes are semi joins, so duplicate links never multiply rows;
pages are sort-and-limit plans with the exact total beside them; ids are ranked first and details joined to the page.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.plans.catalog import Catalog

#: Floors of the fuzzy lanes (strict for candidates, inclusive for admission) and the shortest fuzzy needle.
WORD_FLOOR, TITLE_FLOOR, ADMIT_FLOOR, AUTHOR_FLOOR, SUGGEST_FLOOR, LEAST_RUNES = 0.6, 0.5, 0.3, 0.3, 0.5, 3
PAGE_LIMIT, SUGGEST_LIMIT = 100, 15


@dataclass(frozen=True)
class BookSearch:
    query: str = ""
    author_query: str = ""
    lang: str = ""
    unapproved: bool = False
    include_hidden: bool = False
    book_id: int = 0
    favorites_of: int | None = None
    author_id: int = 0
    series_id: int = 0
    genre_id: int = 0
    collection_id: int = 0
    curated_collection_id: int = 0
    limit: int = PAGE_LIMIT
    offset: int = 0
    moderator: bool = True


def clamp(limit: int, default: int, most: int) -> int:
    """A page size: the default if it is not positive or above the most."""
    return default if limit <= 0 or limit > most else limit


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def needle_trigrams(needle: str) -> list[str]:
    """Distinct trigrams of a needle in normal form."""
    out = [f"  {w} "[i : i + 3] for w in needle.split(" ") if w for i in range(len(w) + 1)]
    return list(dict.fromkeys(out))


def visible(books: DataFrame, unapproved: bool = False, include_hidden: bool = False, lang: str = "") -> DataFrame:
    rows = books.where(F.col("approved") == F.lit(not unapproved))
    if not include_hidden:
        rows = rows.where(~F.col("duplicate_hidden"))
    return rows if lang in ("", "all") else rows.where(F.col("lang") == lang)


def scoped(books: DataFrame, catalog: Catalog, r: BookSearch) -> DataFrame:
    """Only the scopes that are asked for become semi joins; a scope that names nothing leaves nothing."""

    def within(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(links.select(F.col("book_id").alias("_in")), F.col("id") == F.col("_in"), "left_semi")

    if r.favorites_of is not None:
        books = within(books, catalog.favorite.where(F.col("user_id") == r.favorites_of))
    if r.author_id:
        books = within(books, catalog.book_author.where(F.col("author_id") == r.author_id))
    if r.series_id:
        books = within(books, catalog.book_series.where(F.col("ser_id") == r.series_id))
    if r.genre_id:
        books = within(books, catalog.book_genre.where(F.col("genre_id") == r.genre_id))
    if r.collection_id:
        books = within(books, catalog.collection_book.where(F.col("book_collection_id") == r.collection_id))
    if r.curated_collection_id:
        public = catalog.collection.where(F.col("is_curated") & F.col("is_public") & (F.col("id") == r.curated_collection_id)).select(F.col("id").alias("_c"))
        members = catalog.collection_item.where(F.col("match_status").isin("auto_matched", "manual"))
        books = within(books, members.join(public, F.col("collection_id") == F.col("_c"), "left_semi"))
    needle = T.normalize_text(r.author_query) if r.author_query else ""
    if needle:  # a query without letters or digits is no filter
        authors = catalog.named().where(author_match(F.col("norm_name"), needle)).select(F.col("id").alias("_a"))
        books = within(books, catalog.book_author.join(authors, F.col("author_id") == F.col("_a"), "left_semi"))
    return books


def author_match(name: Column, needle: str) -> Column:
    """Equal, prefix, or from three characters on word-similar."""
    hit = F.startswith(name, F.lit(needle))
    if len(needle) >= LEAST_RUNES:
        own = strings(needle_trigrams(needle))
        hit = hit | (T.may_reach(own, T.trigrams(name), WORD_FLOOR) & (T.extent_similarity(own, T.ordered_trigrams(name)) >= WORD_FLOOR))
    return hit


def signals(books: DataFrame, needle: str) -> DataFrame:
    """id and the signals of every book, from norm_title; word_score only where a lane or the bound lets it matter."""
    title, wanted = F.col("norm_title"), needle.split(" ")
    own, fuzzy = strings(needle_trigrams(needle)), len(needle) >= LEAST_RUNES
    spread = fuzzy and len(wanted) > 1 and max(map(len, wanted)) >= LEAST_RUNES
    have, want = F.split(title, " "), strings(wanted)
    rows = books.select(
        "id",
        "norm_title",
        (title == needle).alias("exact"),
        F.startswith(title, F.lit(needle)).alias("prefix"),
        F.contains(title, F.lit(needle)).alias("substring"),
        (T.covers(have, want) if spread else F.lit(False)).alias("all_words"),
        F.nullif(F.instr(title, needle), F.lit(0)).alias("position"),
        F.abs(F.char_length(title) - len(needle)).alias("length_delta"),
        (T.trigrams(title) if fuzzy else strings([])).alias("_set"),
    )
    sets = F.col("all_words") & F.forall(F.split("norm_title", " "), lambda t: F.exists(want, lambda w: F.startswith(t, w)))
    rows = rows.withColumn("word_set", sets if spread else F.lit(False))
    rows = rows.withColumn("trigram_score", (T.overlap(own, F.col("_set")) if fuzzy else F.lit(0.0)).cast("float"))
    lane = F.col("prefix") | F.col("substring") | F.col("all_words") | (F.col("trigram_score") >= TITLE_FLOOR)
    score = F.when(lane | T.may_reach(own, F.col("_set"), WORD_FLOOR), T.extent_similarity(own, T.ordered_trigrams(F.col("norm_title")))).otherwise(0.0)
    rows = rows.withColumn("word_score", (score if fuzzy else F.lit(0.0)).cast("float"))
    return rows.withColumn("candidate", lane | (F.col("word_score") >= WORD_FLOOR)).drop("_set")


def admitted_books(catalog: Catalog, r: BookSearch) -> DataFrame:
    """All books that the request admits, with their signals and favorite_count."""
    moderator = r.moderator
    books = visible(catalog.titled(), r.unapproved and moderator, r.include_hidden and moderator, r.lang)
    books = scoped(books, catalog, r)
    needle = T.normalize_text(r.query) or ""
    found = signals(books, needle)
    if r.book_id:
        found = found.where(F.col("id") == r.book_id)
    elif not needle:
        found = found.where(F.lit(False))
    else:
        strong = F.col("exact") | F.col("prefix") | F.col("word_set") | F.col("substring") | F.col("all_words")
        found = found.where(F.col("candidate") & (strong | (F.col("word_score") >= WORD_FLOOR) | (F.col("trigram_score") >= ADMIT_FLOOR)))
    if catalog.favorite is None:
        return found.withColumn("favorite_count", F.lit(0).cast("long"))
    likes = catalog.favorite.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("favorite_count"))
    return found.join(likes, "id", "left").withColumn("favorite_count", F.coalesce("favorite_count", F.lit(0).cast("long")))


def book_order() -> list[Column]:
    down = ["exact", "prefix", "word_set", "substring", "all_words", "word_score", "trigram_score"]
    return [*map(F.desc, down), F.asc_nulls_last("position"), F.asc("length_delta"), F.desc("favorite_count"), F.asc("id")]


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """The page of rows in order, with pos (from 1): a top-k plan, then numbers for the few rows that are left."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    top = rows.orderBy(*order).offset(offset).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)) + offset)


def shared(found: DataFrame) -> DataFrame:
    """found behind an exchange on all its columns, so that a page and a total read one and the same and neither works it out again."""
    return found.repartition(*found.columns)


def search_books(catalog: Catalog, r: BookSearch) -> DataFrame:
    """id, pos, total, query_hash; an empty page is one row with a null id, so that the total is always there."""
    found = shared(admitted_books(catalog, r).drop("norm_title", "candidate"))
    page = page_of(found, book_order(), clamp(r.limit, PAGE_LIMIT, PAGE_LIMIT), r.offset).select("id", "pos")
    digest = hashlib.md5((T.normalize_text(r.query) or "").encode()).hexdigest()
    total = found.agg(F.count("*").alias("total"))
    return total.join(page, F.lit(True), "left").select("id", F.col("pos").cast("long").alias("pos"), "total", F.lit(digest).alias("query_hash"))


def books_per_author(catalog: Catalog, lang: str = "") -> DataFrame:
    """author_id and the number of links to visible books; authors without one are not there."""
    seen = visible(catalog.book, lang=lang).select(F.col("id").alias("book_id"))
    return catalog.book_author.join(seen, "book_id", "left_semi").groupBy("author_id").agg(F.count("*").alias("books"))


def search_authors(catalog: Catalog, query: str, lang: str = "", limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """id, full_name, books, pos, total: by word distance, then number of visible books, then id."""
    needle = T.normalize_text(query) or ""
    own, name = strings(needle_trigrams(needle)), F.col("norm_name")
    near = T.extent_similarity(own, T.ordered_trigrams(name))
    hit = (T.overlap(own, T.trigrams(name)) >= AUTHOR_FLOOR) | (T.may_reach(own, T.trigrams(name), WORD_FLOOR) & (near >= WORD_FLOOR))
    found = catalog.named().where(hit & F.lit(needle != "")).withColumn("distance", (1 - near).cast("float"))
    found = found.join(books_per_author(catalog, lang), F.col("id") == F.col("author_id"))
    found = shared(found.select("id", "full_name", "books", "distance"))
    page = page_of(found, [F.asc("distance"), F.desc("books"), F.asc("id")], clamp(limit, PAGE_LIMIT, PAGE_LIMIT), offset)
    total = found.agg(F.count("*").alias("total"))
    return total.join(page.select("id", "full_name", "books", F.col("pos").cast("long").alias("pos")), F.lit(True), "left").select("id", "full_name", "books", "pos", "total")


def suggestion_split(limit: int, kind: str = "all") -> tuple[int, int]:
    """How many titles and how many authors: titles get the larger half."""
    if kind == "title":
        return limit, 0
    if kind == "author":
        return 0, limit
    return (limit + 1) // 2, limit - (limit + 1) // 2


def suggest(catalog: Catalog, query: str, lang: str = "", limit: int = SUGGEST_LIMIT, kind: str = "all") -> DataFrame:
    """kind, id, value, count, pos. Equal titles of a language are one suggestion, deduped before the limit."""
    titles, authors = suggestion_split(limit, kind)
    needle = T.normalize_text(query) or ""
    asked = F.lit(len(needle) >= LEAST_RUNES)
    books = visible(catalog.titled(), lang=lang)
    found = signals(books, needle).where(asked)
    strong = F.col("exact") | F.col("prefix") | F.col("substring")
    found = found.where(strong | (F.col("word_score") >= WORD_FLOOR) | (F.col("trigram_score") >= SUGGEST_FLOOR))
    found = found.join(books.select("id", "title", "lang"), "id")
    order = [F.desc("exact"), F.desc("prefix"), F.asc_nulls_last("position"), F.desc("word_score"), F.desc("trigram_score"), F.asc("id")]
    # books of one title have the same signals, so the first of them is that with the least id
    least = F.min(F.struct("id", "title", "exact", "prefix", "position", "word_score", "trigram_score"))
    first = found.groupBy("norm_title", "lang").agg(F.count("*").alias("count"), least.alias("first")).select("count", "first.*")
    shelf = page_of(first, order, titles, 0).select(F.lit("title").alias("kind"), "id", F.col("title").alias("value"), "count", F.col("pos").cast("long").alias("pos"))
    name, own = F.col("norm_name"), strings(needle_trigrams(needle))
    people = catalog.named().where(asked & (F.contains(name, F.lit(needle)) | author_match(name, needle)))
    people = people.join(books_per_author(catalog, lang), F.col("id") == F.col("author_id"))
    people = people.select("id", "full_name", "books", (name == needle).alias("exact"), F.startswith(name, F.lit(needle)).alias("prefix"), (1 - T.extent_similarity(own, T.ordered_trigrams(name))).cast("float").alias("distance"))
    order = [F.desc("exact"), F.desc("prefix"), F.asc("distance"), F.desc("books"), F.asc("id")]
    second = page_of(people, order, authors, 0).select(F.lit("author").alias("kind"), "id", F.col("full_name").alias("value"), F.col("books").alias("count"), F.col("pos").cast("long").alias("pos"))
    return shelf.unionByName(second)
