import random

import pytest
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators import resolve as R

PEOPLE = ["Anna Karlson", "Anna Karlsen", "A. Karlson", "Karl Annason", "Bo Ek", "Boris Ek", "", "Ek Bo", None]
TITLES = ["red widget", "red widgets", "Red Widget two", "hot", "hot bolts", "blue bolts", "bolts", "???", None]


def catalog(spark, seed, books=150):
    r = random.Random(seed)
    book = spark.createDataFrame([(i, r.choice(TITLES)) for i in range(books)], "id long, title string")
    author = spark.createDataFrame([(i, p) for i, p in enumerate(PEOPLE)], "id long, full_name string")
    links = [(i, r.randrange(len(PEOPLE))) for i in range(books) for _ in range(r.randrange(4))]
    asked = [(i, r.choice(PEOPLE + ["Nobody At All"]), r.choice(["Red widget: a novel", "hot", "bolts", "unknown", ""])) for i in range(40)]
    items = R.normalized_items(spark.createDataFrame(asked, "item_id long, author string, title string"))
    return items, book, author, spark.createDataFrame(links + links[:20], "book_id long, author_id long")


def plain(items, book, author, links):
    """All items with all books, and the twenty best of each in Python."""
    wrote = links.join(author.withColumnRenamed("id", "author_id"), "author_id").groupBy("book_id").agg(F.collect_set(F.lower("full_name")).alias("names"))
    low = F.lower("title")
    rows = items.select("item_id", F.coalesce("author_norm", F.lit("")).alias("a"), F.col("title_norm").alias("t")).where("t <> ''").crossJoin(book.join(wrote, F.col("id") == F.col("book_id"), "left").select("id", low.alias("low"), "names"))
    sim, starts = T.similarity(F.col("t"), F.col("low")), F.startswith("low", "t")
    title = F.greatest(sim, F.when(starts, R.PREFIX_SCORE).otherwise(0.0))
    near = F.array_max(F.transform("names", lambda x: T.similarity(x, F.col("a"))))
    score = (title * R.TITLE_WEIGHT + F.coalesce(near, F.lit(0.0)) * R.AUTHOR_WEIGHT).cast("float")
    out = {}
    for r in rows.where((sim > R.TITLE_FLOOR) | starts).select("item_id", "id", score.alias("score")).collect():
        out.setdefault(r.item_id, []).append((-r.score, r.id))
    return {(i, b, -s, k) for i, found in out.items() for k, (s, b) in enumerate(sorted(found)[: R.CANDIDATES], 1)}


@pytest.mark.parametrize("sure", [0.0, 0.4, 0.9, 1.0])
def test_candidates_for_any_bound(spark, monkeypatch, sure):
    monkeypatch.setattr(R, "SURE_AUTHOR", sure)
    tables = catalog(spark, round(sure * 10))
    want = plain(*tables)
    assert {tuple(r) for r in R.find_candidates(*tables).select("item_id", "book_id", "score", "rank").collect()} == want
    assert max(k for *_, k in want) == R.CANDIDATES


def test_few_hits_have_their_authors_looked_up(spark):
    """Of 3000 books of one title, 60 by the author asked for: only these can be among the best."""
    names = spark.createDataFrame([(0, "bo ek"), (1, "anna karlson"), (2, "karl annason")], "author_id long, name string")
    hits = spark.range(3000).select(F.lit("bo ek").alias("author_norm"), F.lit("hot").alias("title_norm"), F.col("id").alias("book_id"), F.lit(0.7).alias("title_score"))
    links = spark.range(3000).select(F.col("id").alias("book_id"), F.when(F.col("id") % 50 == 0, 0).otherwise(1 + F.col("id") % 2).alias("author_id"))
    left = R.contenders(hits, hits.select("author_norm").distinct(), names, links).collect()
    assert {r.book_id for r in left} == set(range(0, 3000, 50)) and all(r.author_score == 1.0 for r in left)


def test_neither_titles_nor_books_are_broadcast(spark, tmp_path):
    """A title has many times its own size of trigrams."""
    for name, table in zip(("items", "book", "author", "links"), catalog(spark, 1)):
        table.write.parquet(str(tmp_path / name))
    titles = spark.read.parquet(str(tmp_path / "book")).select(F.lower("title").alias("low")).distinct()
    found = R.matching_titles(spark.read.parquet(str(tmp_path / "items")).select("title_norm").distinct(), titles)
    plan = found._jdf.queryExecution().sparkPlan().toString()  # before exchanges are put in
    assert "BroadcastHashJoin" not in plan.split("Generate explode")[0] and "SortMergeJoin" in plan
