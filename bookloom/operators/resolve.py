"""Matching an outside list of (author, title) to catalog books, all items at once.

Earlier decisions answer first. The rest meet the catalog over an index of title trigrams: the rarest trigrams of a
needle are enough to find every title above the floor, so the join keys on those alone, and each candidate is then
scored, once for all items that ask for the same. Authors that are as good as those asked for are found the same way;
what their books reach rules out most others before their authors are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.functions.storage import new_path, written

#: Floors and weights of the score, buckets, and list sizes.
TITLE_FLOOR, PREFIX_SCORE, TITLE_WEIGHT, AUTHOR_WEIGHT = 0.20, 0.7, 0.6, 0.4
MID, HIGH, TOLERANCE = 0.30, 0.85, 0.001
CANDIDATES, KEPT_CANDIDATES, RECENT = 20, 10, 5
#: Authors more similar than this are found first, by their trigrams; what they give bounds all others. Any value gives the same results.
SURE_AUTHOR = 0.9


def normalized_items(items: DataFrame) -> DataFrame:
    """items with author_norm and title_norm."""
    return items.withColumn("author_norm", T.match_form(F.col("author"))).withColumn("title_norm", T.match_form(T.trim_subtitle(F.col("title"))))


def sharing(needles: DataFrame, texts: DataFrame, floor: float) -> DataFrame:
    """needle, text: all pairs of the two tables (of one column each) whose similarity is above the floor, and others.

    Sharing c trigrams gives at most c over those of the needle, so a text above the floor has one of all but that
    share of them: the rarest among the texts are the join keys. Only the two strings travel; scores come afterwards.
    """
    needles, texts = needles.toDF("needle"), texts.toDF("text")
    posted = texts.select("text", F.explode(T.trigrams(F.col("text"))).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("n"))
    wanted = needles.select("needle", F.explode(T.trigrams(F.col("needle"))).alias("key")).join(often, "key", "left")
    ordered = wanted.groupBy("needle").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("keys"))
    enough = F.size("keys") - F.floor(F.size("keys") * floor).cast("int")
    keyed = ordered.select("needle", F.explode(F.slice("keys", F.lit(1), enough)).alias("k")).select("needle", "k.key")
    # never broadcast: the size of the texts says little about that of their trigrams
    return keyed.join(posted.hint("merge"), "key").select("needle", "text").distinct()


def matching_titles(needles: DataFrame, titles: DataFrame) -> DataFrame:
    """title_norm, low, title_score of all titles (low) above the floor for each needle (title_norm)."""
    pairs = sharing(needles, titles, TITLE_FLOOR).toDF("title_norm", "low")
    scored = pairs.withColumn("sim", T.similarity(F.col("title_norm"), F.col("low"))).withColumn("starts", F.startswith("low", "title_norm"))
    scored = scored.where((F.col("sim") > TITLE_FLOOR) | F.col("starts"))
    return scored.select("title_norm", "low", F.greatest("sim", F.when(F.col("starts"), PREFIX_SCORE).otherwise(0.0)).alias("title_score"))


def _score(author_score: Column) -> Column:
    return (F.col("title_score") * TITLE_WEIGHT + author_score * AUTHOR_WEIGHT).cast("float")


def contenders(hits: DataFrame, wanted: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """The hits that may be among the CANDIDATES best of their pair, with author_score where it is above SURE_AUTHOR, else null.

    wanted has each author_norm of the hits once, names author_id and name, links author_id and book_id (repeats do no harm).
    Books of an author above SURE_AUTHOR have their score; all others have at least what the title gives and at most
    what SURE_AUTHOR would add to it. So hits whose most is below the least of CANDIDATES others of their pair go,
    before the authors of any of them are looked up. Scores are compared as they are ranked, and equal ones stay.
    """
    pair = ["author_norm", "title_norm"]
    alike = sharing(wanted, names.select("name").distinct(), SURE_AUTHOR).toDF("author_norm", "name")
    alike = alike.withColumn("s", T.similarity(F.col("name"), F.col("author_norm"))).where(F.col("s") > SURE_AUTHOR)
    sure = alike.join(names, "name").join(links, "author_id").groupBy("author_norm", "book_id").agg(F.max("s").alias("author_score"))
    bounded = hits.join(sure, ["author_norm", "book_id"], "left")
    bounded = bounded.withColumn("least", _score(F.coalesce("author_score", F.lit(0.0)))).withColumn("most", _score(F.coalesce("author_score", F.lit(SURE_AUTHOR))))
    nth = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("least")))
    cut = bounded.withColumn("nth", nth).where(F.col("nth") <= CANDIDATES).where(F.col("nth") == CANDIDATES).select(*pair, F.col("least").alias("cut"))
    return bounded.join(cut, pair, "left").where("cut IS NULL OR most >= cut").select(*pair, "book_id", "title_score", "author_score")


def find_candidates(items: DataFrame, books: DataFrame, authors: DataFrame, links: DataFrame) -> DataFrame:
    """item_id, book_id, score, rank: the best CANDIDATES per item, ties by book_id.

    Items that ask for the same author and title are one pair until the end, and distinct titles are matched, not
    books. A pair's books are cut to contenders before their authors are compared, and to CANDIDATES before the items
    come back.
    """
    asked = items.where(F.col("title_norm") != "").select("item_id", F.coalesce("author_norm", F.lit("")).alias("author_norm"), "title_norm")
    pairs = asked.select("author_norm", "title_norm").distinct()
    found = matching_titles(asked.select("title_norm").distinct(), books.select(F.lower("title").alias("low")).distinct())
    hits = pairs.join(found, "title_norm").join(books.select(F.col("id").alias("book_id"), F.lower("title").alias("low")).hint("merge"), "low").select("author_norm", "title_norm", "book_id", "title_score")
    names, wrote = authors.select(F.col("id").alias("author_id"), F.lower("full_name").alias("name")), links.select("book_id", "author_id")
    left = written(contenders(hits, pairs.select("author_norm").distinct(), names, wrote), new_path(items.sparkSession, "contenders"))
    met = left.where("author_score IS NULL").select("author_norm", "book_id").distinct().hint("merge").join(wrote, "book_id").join(names, "author_id").select("author_norm", "book_id", "name")
    near = met.select("author_norm", "name").distinct().withColumn("s", T.similarity(F.col("name"), F.col("author_norm")))
    best = met.join(near, ["author_norm", "name"]).groupBy("author_norm", "book_id").agg(F.max("s").alias("other_score"))
    score = _score(F.coalesce("author_score", "other_score", F.lit(0.0)))
    rows = left.join(best, ["author_norm", "book_id"], "left").select("author_norm", "title_norm", "book_id", score.alias("score"))
    order = Window.partitionBy("author_norm", "title_norm").orderBy(F.desc("score"), F.asc("book_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES)
    return asked.join(ranked, ["author_norm", "title_norm"]).select("item_id", "book_id", "score", "rank")


def match_buckets(items: DataFrame, decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """item_id, status, book_id, score, candidates (of ambiguous items, best first).

    A decision for (author_norm, title_norm) is manual with score 1; else candidates from MID on count: none is
    not_found, a single one from HIGH on auto_matched, everything else ambiguous with the best score.
    """
    decided = decisions.select("author_norm", "title_norm", F.col("book_id").alias("_decided")).dropDuplicates(["author_norm", "title_norm"])
    good = candidates.where(F.col("score") >= MID).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "book_id", "score"))).alias("_good"))
    rows = items.select("item_id", "author_norm", "title_norm").join(decided, ["author_norm", "title_norm"], "left").join(good, "item_id", "left")
    n, first = F.coalesce(F.size("_good"), F.lit(0)), F.get("_good", F.lit(0))
    manual, auto = F.col("_decided").isNotNull(), (n == 1) & (first["score"] >= HIGH)
    status = F.when(manual, "manual").when(n < 1, "not_found").when(auto, "auto_matched").otherwise("ambiguous")
    listed = F.transform("_good", lambda c: F.struct(c["book_id"].alias("book_id"), c["score"].alias("score")))
    return rows.select(
        "item_id",
        status.alias("status"),
        F.when(manual, F.col("_decided")).when(auto, first["book_id"]).alias("book_id"),
        F.when(manual, 1.0).when(n < 1, 0.0).otherwise(first["score"]).cast("float").alias("score"),
        F.when(status == "ambiguous", listed).alias("candidates"),
    )


def auto_resolve(matched: DataFrame, books: DataFrame) -> DataFrame:
    """item_id, book_id for ambiguous items: within TOLERANCE of the best score, the most recently registered book."""
    each = matched.where("status = 'ambiguous'").select("item_id", F.explode("candidates").alias("c"), F.array_max(F.transform("candidates", lambda c: c["score"])).alias("top"))
    tied = each.where(F.col("c.score") >= F.col("top") - F.lit(TOLERANCE).cast("float")).select("item_id", F.col("c.book_id").alias("id"))
    return tied.join(books.select("id", "registerdate"), "id").groupBy("item_id").agg(F.max_by("id", F.struct("registerdate", "id")).alias("book_id"))


def import_stats(matched: DataFrame) -> DataFrame:
    """One row: matched, ambiguous, not_found, processed, total."""
    return matched.agg(
        F.count_if(F.col("status").isin("auto_matched", "manual")).alias("matched"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("status") == "not_found").alias("not_found"),
        F.count("*").alias("processed"),
        F.count("*").alias("total"),
    )


def extra_payload(matched: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, extra: JSON of the item's own extra map, its year (not 0) and the first KEPT_CANDIDATES candidates; null when there is none of them.

    Keys of the map come first; `year` and `candidates` take the place of keys of the same name.
    """
    rows = items.select("item_id", F.nullif("year", F.lit(0)).alias("year"), F.col("extra") if "extra" in items.columns else F.lit(None).cast("map<string,string>").alias("extra"))
    rows = rows.join(matched.select("item_id", "candidates"), "item_id", "left")
    some = F.coalesce(F.size("candidates"), F.lit(0)) > 0
    taken = lambda k: (F.col("year").isNotNull() & (k == "year")) | (some & (k == "candidates"))
    own = F.to_json(F.map_filter("extra", lambda k, _: ~taken(k)))
    made = F.to_json(F.struct("year", F.when(some, F.slice("candidates", 1, KEPT_CANDIDATES)).alias("candidates")))
    body = F.array_join(F.filter(F.array(*[F.substring(j, F.lit(2), F.char_length(j) - 2) for j in (F.coalesce(own, F.lit("{}")), made)]), lambda x: x != ""), ",")
    none = F.col("year").isNull() & ~some & (F.coalesce(F.size("extra"), F.lit(0)) <= 0)
    return rows.select("item_id", F.when(~none, F.concat(F.lit("{"), body, F.lit("}"))).alias("extra"))


def recent(ring: Column, n: int = RECENT) -> Column:
    """The last n entries of an array column."""
    return F.reverse(F.slice(F.reverse(ring), 1, n))


def with_status(items: DataFrame, status: str | None) -> DataFrame:
    """Items of a status; `matched` stands for matched automatically or by hand."""
    if not status:
        return items
    return items.where(F.col("match_status").isin("auto_matched", "manual") if status == "matched" else F.col("match_status") == status)
