"""Ranked title search over a maintained index of trigrams: a page reads the postings of a few rare trigrams, not all titles.

A posting is a trigram with a book and all that the search needs of it, so candidates are not looked up elsewhere. Files
lie by bucket of the trigram. Which postings hold every book that a request can admit follows from the lanes:

* by similarity, a book shares at least half of the needle's trigrams, so any so many of them that less than half are
  left over meet it: the rarest ones;
* a book that contains the needle has all its trigrams but those that reach over its ends; one whose words begin with
  the needle's words has all but those over the words' ends: the rarest one of each is enough.

The exact signals, order and totals of the search are then worked out over these books alone. Totals are exact, so no
match is cut off early. A needle too short for such trigrams is searched over the index's titles.

Upserts are batches (BatchStore): a batch has the postings of its books and the ids that it replaces, and postings of
earlier batches with such an id are stale. A batch without books removes its ids. An index object keeps the list of
batches that it last saw (a row a batch) until refresh() or its own upsert; an index of very many batches is built anew
in another folder.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators.search import BookSearch, needle_trigrams, search_books
from bookloom.plans.catalog import Catalog
from bookloom.sources.batches import BatchStore

BUCKETS = 64
TITLE = "id long, norm_title string, lang string, approved boolean, duplicate_hidden boolean"
_FIELDS = ["id", "norm_title", "lang", "approved", "duplicate_hidden"]
#: The lowest share of the needle's trigrams that a similar title has (of the floors of search, the trigram lane's).
LEAST_SHARE = 0.5


def bucket_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _bucket(c: Column) -> Column:
    return (F.crc32(c.cast("binary")) % BUCKETS).cast("int")


def sure_grams(needle: str) -> tuple[list[str], list[str]]:
    """Trigrams of every title that contains the needle, and of every title with words that begin with the needle's words."""
    words = [w for w in needle.split(" ") if w]
    last = len(words) - 1
    inside = [g for k, w in enumerate(words) for g in _padded(w, before=k > 0, after=k < last)]
    begins = [g for w in words for g in _padded(w, before=True, after=False)]
    return list(dict.fromkeys(inside)), list(dict.fromkeys(begins))


def _padded(word: str, before: bool, after: bool) -> list[str]:
    """Trigrams of a word with its pads: those over an end that is not known are left out."""
    p = ("  " if before else "") + word + (" " if after else "")
    return [p[i : i + 3] for i in range(len(p) - 2)]


class TitleIndex:
    def __init__(self, store: BatchStore):
        self.store, self.spark = store, store.spark
        self.batches: list | None = None

    def refresh(self) -> None:
        """Take in what others have put into the index."""
        self.batches = None

    def _read(self, table: str, schema: str) -> DataFrame:
        """The table over the batches that are known, with its batch; only their folders are looked at."""
        if self.batches is None:
            self.batches = self.store.whole().collect()
        keyed = f"{schema}, batch long, attempt string"
        if not self.batches:
            return self.spark.createDataFrame([], keyed)
        base = f"{self.store.path}/data/{table}"
        return self.spark.read.schema(keyed).option("basePath", base).parquet(*[f"{base}/batch={b['batch']}/attempt={b['attempt']}" for b in self.batches])

    def upsert(self, batch: int, books: DataFrame, gone: DataFrame | None = None) -> bool:
        """Put books (TITLE's columns, or title in place of norm_title) in as that batch, and take the ids of gone out."""

        def tables() -> dict[str, DataFrame]:
            rows = books if "norm_title" in books.columns else books.withColumn("norm_title", T.normalize(F.col("title")))
            rows = rows.select(*_FIELDS)
            posted = rows.select(F.explode(T.trigrams(F.col("norm_title"))).alias("gram"), *_FIELDS).withColumn("bucket", _bucket(F.col("gram")))
            ids = rows.select("id") if gone is None else rows.select("id").unionByName(gone.select("id"))
            return {
                "title": rows,
                "posting": posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "gram"),
                "gram": posted.groupBy("gram").agg(F.count("*").alias("n")),
                "replaced": (ids if batch else ids.where(F.lit(False))).distinct(),
            }

        done = self.store.commit(batch, tables, by={"posting": ["bucket"]})
        self.refresh()
        return done

    def _live(self, table: str, schema: str) -> DataFrame:
        """Rows that no later batch replaces."""
        rows = self._read(table, schema)
        if len(self.batches) < 2:
            return rows
        later = self._read("replaced", "id long").groupBy(F.col("id").alias("_id")).agg(F.max("batch").alias("_batch"))
        return rows.join(later, (F.col("id") == F.col("_id")) & (F.col("batch") < F.col("_batch")), "left_anti")

    def titles(self) -> DataFrame:
        return self._live("title", TITLE).select(*_FIELDS)

    def chosen_grams(self, needle: str) -> list[str] | None:
        """Trigrams whose postings hold every book that the needle can admit; None if there are no such trigrams."""
        grams = needle_trigrams(needle)
        lanes = sure_grams(needle)
        if not grams or not all(lanes):
            return None
        every = list(dict.fromkeys([*grams, *lanes[0], *lanes[1]]))
        found = self._read("gram", "gram string, n long").where(F.col("gram").isin(every)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
        n = {g: 0 for g in every} | {r["gram"]: r["n"] for r in found}
        rarest = lambda gs: sorted(gs, key=lambda g: (n[g], g))
        spare = len(grams) - math.ceil(LEAST_SHARE * len(grams))
        return list(dict.fromkeys([*rarest(grams)[: spare + 1], rarest(lanes[0])[0], rarest(lanes[1])[0]]))

    def candidates(self, needle: str) -> DataFrame:
        """The books (TITLE) among which all are that a needle in normal form can admit, each once."""
        grams = self.chosen_grams(needle)
        if grams is None:
            return self.titles()
        posted = self._live("posting", f"gram string, {TITLE}, bucket int")
        return posted.where(F.col("bucket").isin(sorted({bucket_of(g) for g in grams})) & F.col("gram").isin(grams)).select(*_FIELDS).dropDuplicates(["id"])

    def search(self, catalog: Catalog, r: BookSearch) -> DataFrame:
        """search_books() of the catalog whose books the index holds."""
        needle = T.normalize_text(r.query) or ""
        books = self.titles() if r.book_id or not needle else self.candidates(needle)
        return search_books(replace(catalog, book=books), r)
