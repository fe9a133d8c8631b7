"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.functions import records as R
from bookloom.functions import text as T
from bookloom.functions.storage import new_path
from bookloom.operators import changes, dedup, documents, evaluate, lists, resolve, search, state
from bookloom.operators.title_index import TitleIndex
from bookloom.plans import oracle as O
from bookloom.plans.catalog import star_catalog
from bookloom.plans.oracle import CATALOG
from bookloom.sources.batches import BatchStore

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_SEEN = "approved AND NOT duplicate_hidden"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search ---------------------------------------------------------------------------------------------------------


_AUTHOR = "supplier 00000001"
_NEAR = f"SELECT id FROM (SELECT id, {O.ordered('norm_name')} AS t FROM author), (SELECT {O.tri(O.quoted(_AUTHOR))} AS a) WHERE {O.extent('a', 't')} >= 0.6"


def _search(name: str, needle: str, where: str = _SEEN, limit: int = 100, offset: int = 0, **k) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search_books(star_catalog(spark, sf_dir), search.BookSearch(query=needle, limit=limit, offset=offset, **k))

    run.__name__ = name
    query(O.search_sql(needle, where, limit, offset))(run)


_search("search_books_ranked_page", "red widget")
_search("search_books_exact_prefix_substring", "widget")


@query(O.search_sql("red widget", _SEEN, 100, 0))
def search_books_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked page over an index of trigrams, in which one of five books first had another title."""
    catalog, index = star_catalog(spark, sf_dir), TitleIndex(BatchStore(spark, new_path(spark, "titles")))
    again = F.col("id") % 5 == 0
    index.upsert(0, catalog.book.withColumn("norm_title", F.when(again, F.concat(F.lit("red "), "norm_title")).otherwise(F.col("norm_title"))))
    index.upsert(1, catalog.book.where(again))
    return index.search(catalog, search.BookSearch(query="red widget", limit=100))


_search("search_books_word_coverage", "widget re")
_search("search_books_typo", "smal wigdet", limit=50)
_search("search_books_short_needle", "re", limit=20, offset=40)
_search("search_books_nothing", "zzzz")
_search("search_books_language", "hot ring", f"{_SEEN} AND lang = 'de'", lang="de")
_search("search_books_unapproved", "hot ring", "NOT approved AND NOT duplicate_hidden", unapproved=True)
_search("search_books_with_hidden", "hot ring", "approved", include_hidden=True)
_search("scope_author_semi", "red widget", f"{_SEEN} AND id IN (SELECT book_id FROM book_author WHERE author_id = 3)", author_id=3)
_search("scope_favorites_semi", "old rod", f"{_SEEN} AND id IN (SELECT book_id FROM favorite WHERE user_id = 7)", favorites_of=7)
_search("scope_series_semi", "blue", f"{_SEEN} AND series = 'Brand#4'", series_id=4)
_search("scope_collection_semi", "plate", f"{_SEEN} AND id IN (SELECT book_id FROM collection_book WHERE book_collection_id = 5)", collection_id=5)
_search("scope_unknown_is_empty", "red widget", "false", author_id=10**9)
_search("scope_author_text", "red", f"{_SEEN} AND id IN (SELECT ba.book_id FROM book_author ba JOIN author a ON a.id = ba.author_id WHERE starts_with(a.norm_name, 'supplier 00000001') OR a.id IN ({_NEAR}))", author_query="Supplier#00000001")


@query(f"WITH {CATALOG}, visible AS (SELECT id, norm_title FROM book WHERE {_SEEN} AND id = 11) SELECT v.id, 1::BIGINT AS pos, 1::BIGINT AS total, md5('nothing like it') AS query_hash FROM visible v")
def search_books_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_books(star_catalog(spark, sf_dir), search.BookSearch(query="nothing like it", book_id=11))


@query(
    f"""WITH {CATALOG}, n AS (SELECT {O.tri("'supplier 000000012'")} AS a),
m AS (SELECT id, full_name, ({O.extent("a", "t")})::FLOAT AS ws, {O.overlap("a", "list_distinct(t)")} AS sim FROM (SELECT *, {O.ordered("norm_name")} AS t FROM author), n),
c AS (SELECT m.*, b.books, (1 - m.ws)::FLOAT AS distance FROM m JOIN ({O.books_per_author_sql()}) b ON b.author_id = m.id WHERE m.ws >= 0.6 OR m.sim >= 0.3),
p AS (SELECT *, row_number() OVER (ORDER BY distance, books DESC, id) AS pos, count(*) OVER () AS total FROM c)
SELECT id, full_name, books::BIGINT AS books, pos::BIGINT AS pos, total::BIGINT AS total FROM p WHERE pos <= 20"""
)
def search_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_authors(star_catalog(spark, sf_dir), "Supplier#000000012", limit=20)


@query(
    f"""WITH {CATALOG}, visible AS (SELECT id, title, lang, norm_title FROM book WHERE {_SEEN}), {O.signals_sql("red widg")},
f AS (SELECT s.*, v.title, v.lang FROM signals s JOIN visible v USING (id) WHERE exact OR prefix OR substring OR word_score >= 0.6 OR trigram_score >= 0.5),
d AS (SELECT *, count(*) OVER (PARTITION BY norm_title, lang) AS n, row_number() OVER (PARTITION BY norm_title, lang ORDER BY exact DESC, prefix DESC, position NULLS LAST, word_score DESC, trigram_score DESC, id) AS nth FROM f),
p AS (SELECT *, row_number() OVER (ORDER BY exact DESC, prefix DESC, position NULLS LAST, word_score DESC, trigram_score DESC, id) AS pos FROM d WHERE nth = 1)
SELECT 'title' AS kind, id, title AS value, n::BIGINT AS count, pos::BIGINT AS pos FROM p WHERE pos <= 15"""
)
def suggestions_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggest(star_catalog(spark, sf_dir), "red widg", kind="title")


@query(
    f"""WITH {CATALOG}, n AS (SELECT {O.tri("'000000007'")} AS a),
m AS (SELECT id, full_name, norm_name, ({O.extent("a", "t")})::FLOAT AS ws FROM (SELECT *, {O.ordered("norm_name")} AS t FROM author), n),
c AS (SELECT m.*, b.books FROM m JOIN ({O.books_per_author_sql()}) b ON b.author_id = m.id WHERE contains(norm_name, '000000007') OR ws >= 0.6),
p AS (SELECT *, row_number() OVER (ORDER BY norm_name = '000000007' DESC, starts_with(norm_name, '000000007') DESC, (1 - ws)::FLOAT, books DESC, id) AS pos FROM c)
SELECT 'author' AS kind, id, full_name AS value, books::BIGINT AS count, pos::BIGINT AS pos FROM p WHERE pos <= 10"""
)
def suggestions_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggest(star_catalog(spark, sf_dir), "000000007", kind="author", limit=10)


@query(
    f"""WITH {CATALOG}, n AS (SELECT {O.tri("'red widget'")} AS a), t AS (SELECT DISTINCT norm_title FROM book)
SELECT norm_title, round({O.overlap("a", "s")}, 6) AS similarity, round({O.extent("a", "t")}, 6) AS word_similarity
FROM (SELECT norm_title, {O.ordered("norm_title")} AS t, {O.tri("norm_title")} AS s FROM t), n"""
)
def trigram_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = star_catalog(spark, sf_dir).book.select("norm_title").distinct()
    one = F.lit("red widget")
    return titles.select("norm_title", F.round(T.similarity(one, F.col("norm_title")), 6).alias("similarity"), F.round(T.word_similarity(one, F.col("norm_title")), 6).alias("word_similarity"))


# --- lists ----------------------------------------------------------------------------------------------------------


@query(f"WITH {CATALOG}, p AS (SELECT id, row_number() OVER (ORDER BY id DESC)::BIGINT AS pos FROM book WHERE {_SEEN} AND lang = 'en') SELECT * FROM p WHERE pos > 20 AND pos <= 70")
def list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.list_books(star_catalog(spark, sf_dir), search.BookSearch(lang="en", limit=50, offset=20)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CATALOG}, p AS (SELECT b.id, f.id AS fav_id, row_number() OVER (ORDER BY f.id DESC, b.id DESC)::BIGINT AS pos FROM book b JOIN favorite f ON f.book_id = b.id WHERE {_SEEN.replace('approved', 'b.approved')} AND f.user_id = 5) SELECT * FROM p WHERE pos <= 100")
def favorites_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.favorite_list(star_catalog(spark, sf_dir), 5).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CATALOG}, f AS (SELECT book_id, count(*) AS favorite_count FROM favorite GROUP BY 1), p AS (SELECT id, favorite_count, row_number() OVER (ORDER BY favorite_count DESC, id DESC)::BIGINT AS pos FROM book JOIN f ON book_id = id WHERE {_SEEN}) SELECT * FROM p WHERE pos <= 100")
def popular_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.popular_books(star_catalog(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CATALOG}, p AS (SELECT id, position, row_number() OVER (ORDER BY position, id)::BIGINT AS pos FROM book JOIN collection_book ON book_id = id WHERE {_SEEN} AND book_collection_id = 3) SELECT * FROM p WHERE pos <= 100")
def collection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.collection_list(star_catalog(spark, sf_dir), 3).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CATALOG} SELECT lang, count(*)::BIGINT AS books FROM book WHERE NOT duplicate_hidden GROUP BY 1")
def languages_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.languages(star_catalog(spark, sf_dir))


@query(f"WITH {CATALOG} SELECT author_id, books::BIGINT AS books FROM ({O.books_per_author_sql()})")
def books_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.books_per_author(star_catalog(spark, sf_dir))


@query(f"WITH {CATALOG}, r AS (SELECT book_collection_id, book_id, position, row_number() OVER (PARTITION BY book_collection_id ORDER BY b.approved DESC, position, book_id) AS rn FROM collection_book JOIN book b ON b.id = book_id) SELECT book_collection_id, book_id, position, rn::INTEGER AS rn FROM r WHERE rn <= 4")
def top4_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    rows = c.collection_book.join(c.book.select(F.col("id").alias("book_id"), "approved"), "book_id")
    return lists.top_per_group(rows, "book_collection_id", [F.desc("approved"), F.asc("position"), F.asc("book_id")], 4).select("book_collection_id", "book_id", "position", "rn")


@query("SELECT p_partkey AS id, list_position([44, 7, 19, 100, 3], p_partkey)::BIGINT AS pos FROM part WHERE p_partkey IN (44, 7, 19, 100, 3)")
def array_position_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.in_given_order(star_catalog(spark, sf_dir).book.select("id"), [44, 7, 19, 100, 3])


@query(
    f"""WITH {CATALOG}, p AS (SELECT id FROM book WHERE {_SEEN} ORDER BY id DESC LIMIT 20)
SELECT p.id, coalesce(string_agg(DISTINCT a.full_name, ', ' ORDER BY a.full_name), '') AS authors, bool_or(f.book_id IS NOT NULL) AS fav
FROM p LEFT JOIN book_author ba ON ba.book_id = p.id LEFT JOIN author a ON a.id = ba.author_id LEFT JOIN (SELECT DISTINCT book_id FROM favorite WHERE user_id = 5) f ON f.book_id = p.id GROUP BY 1"""
)
def hydrated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    page = lists.list_books(c, search.BookSearch(limit=20))
    rows = lists.with_related(page, c.book_author, c.author, "author_id", "full_name", "authors")
    rows = lists.mark_favorites(rows, c, 5)
    return rows.select("id", F.array_join(F.transform("authors", lambda a: a["name"]), ", ").alias("authors"), "fav")


@query("SELECT p_partkey AS id, p_size AS ser_no FROM part WHERE lower(p_name) LIKE '%re%' AND lower(p_name) LIKE '%wid%'")
def picker_words_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return lists.series_numbers(c.book.where(lists.all_words_like(F.col("title"), "re wid")).select("id"), c).select("id", "ser_no")


# --- duplicates -----------------------------------------------------------------------------------------------------

_DOCS = "h AS (SELECT doc_id AS id, md5(text) AS md5, lang || ':' || left(md5(text), 4) AS title FROM documents)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.hashed(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text"), "text").drop("text")
    return rows.withColumn("title", F.concat_ws(":", "lang", F.substring("md5", 1, 4))).drop("lang")


@query(f"WITH {_DOCS} SELECT md5, count(*)::BIGINT AS count, string_agg(id::VARCHAR, ',' ORDER BY id) AS book_ids, array_to_string(list_sort(list_distinct(list(title)))[1:3], '|') AS example_titles FROM h GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(_hashed(spark, sf_dir)).select("md5", "count", F.array_join(F.col("book_ids").cast("array<string>"), ",").alias("book_ids"), F.array_join("example_titles", "|").alias("example_titles"))


@query(f"WITH {_DOCS} SELECT md5, id FROM h WHERE md5 IN (SELECT md5 FROM h GROUP BY 1 HAVING count(*) > 1)")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_members(_hashed(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT count(*)::BIGINT AS groups, coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM h GROUP BY md5 HAVING count(*) > 1)")
def duplicates_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicates_total(_hashed(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT id, id <> m AS duplicate_hidden, CASE WHEN id <> m THEN m END AS duplicate_of_id FROM (SELECT id, max(id) OVER (PARTITION BY md5) AS m FROM h)")
def hide_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.hide_duplicates(_hashed(spark, sf_dir)).select("id", "duplicate_hidden", "duplicate_of_id")


@query(f"WITH {_DOCS}, k AS (SELECT md5 FROM h WHERE id % 3 = 0) SELECT min(id) AS id, md5 FROM h WHERE id % 3 <> 0 AND md5 NOT IN (SELECT md5 FROM k) GROUP BY md5")
def ingest_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir)
    return dedup.keep_first_seen(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")).select("id", "md5")


# --- resolution -----------------------------------------------------------------------------------------------------

_ITEMS = """items AS (
  SELECT c_custkey AS item_id, 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') AS author,
    CASE c_custkey % 5 WHEN 0 THEN 'Red Widget: a novel' WHEN 1 THEN 'blue bolts' WHEN 2 THEN 'hot' WHEN 3 THEN 'unknown thing' ELSE 'Small  Ring — 2' END AS title FROM customer),
norm AS (SELECT item_id, trim(regexp_replace(lower(author), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS author_norm,
    trim(regexp_replace(lower(string_split(string_split(title, ':')[1], ' — ')[1]), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title_norm FROM items)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    title = F.when(k == 0, "Red Widget: a novel").when(k == 1, "blue bolts").when(k == 2, "hot").when(k == 3, "unknown thing").otherwise("Small  Ring — 2")
    author = F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0"))
    return resolve.normalized_items(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), author.alias("author"), title.alias("title")))


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, items = star_catalog(spark, sf_dir), _items(spark, sf_dir)
    decisions = spark.createDataFrame([("supplier 000000003", "unknown thing", 3)], "author_norm string, title_norm string, book_id long")
    found = resolve.find_candidates(items, c.book, c.author, c.book_author)
    return resolve.match_buckets(items, decisions, found), c.book


_CANDIDATES = f"""WITH {CATALOG}, {_ITEMS},
lows AS (SELECT DISTINCT lower(title) AS low FROM book), wants AS (SELECT DISTINCT title_norm FROM norm WHERE title_norm <> ''),
ts AS (SELECT title_norm, low, {O.overlap("a", "b")} AS sim, starts_with(low, title_norm) AS st FROM (SELECT title_norm, {O.tri("title_norm")} AS a FROM wants), (SELECT low, {O.tri("low")} AS b FROM lows)),
tt AS (SELECT title_norm, low, greatest(sim, CASE WHEN st THEN 0.7 ELSE 0 END) AS s FROM ts WHERE sim > 0.2 OR st),
au AS (SELECT author_norm, id AS author_id, {O.overlap("a", "b")} AS s FROM (SELECT author_norm, {O.tri("author_norm")} AS a FROM (SELECT DISTINCT author_norm FROM norm)), (SELECT id, {O.tri("norm_name")} AS b FROM author)),
best AS (SELECT au.author_norm, ba.book_id, max(au.s) AS s FROM au JOIN (SELECT DISTINCT book_id, author_id FROM book_author) ba USING (author_id) GROUP BY 1, 2),
sc AS (SELECT n.item_id, b.id AS book_id, (tt.s * 0.6 + coalesce(best.s, 0.0) * 0.4)::FLOAT AS score
  FROM norm n JOIN tt USING (title_norm) JOIN book b ON lower(b.title) = tt.low LEFT JOIN best ON best.author_norm = n.author_norm AND best.book_id = b.id),
cand AS (SELECT item_id, book_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, book_id) AS rank FROM sc)"""


@query(_CANDIDATES + " SELECT item_id, book_id, round(score::DOUBLE, 5) AS score, rank::INTEGER AS rank FROM cand WHERE rank <= 20")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return resolve.find_candidates(_items(spark, sf_dir), c.book, c.author, c.book_author).withColumn("score", F.round(F.col("score").cast("double"), 5))


_BUCKETS = (
    _CANDIDATES
    + """, good AS (SELECT item_id, count(*) AS n, max(score) AS top, arg_min(book_id, rank) AS first FROM cand WHERE rank <= 20 AND score >= 0.3 GROUP BY 1),
m AS (SELECT n.item_id, author_norm = 'supplier 000000003' AND title_norm = 'unknown thing' AS manual, coalesce(g.n, 0) AS n, g.top, g.first FROM norm n LEFT JOIN good g USING (item_id)),
b AS (SELECT item_id, CASE WHEN manual THEN 'manual' WHEN n = 0 THEN 'not_found' WHEN n = 1 AND top >= 0.85 THEN 'auto_matched' ELSE 'ambiguous' END AS status,
  CASE WHEN manual THEN 3 WHEN n = 1 AND top >= 0.85 THEN first END AS book_id, round(CASE WHEN manual THEN 1.0 WHEN n = 0 THEN 0.0 ELSE top END::DOUBLE, 5) AS score FROM m)"""
)


@query(_BUCKETS + " SELECT item_id, status, book_id, score FROM b")
def match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[0].select("item_id", "status", "book_id", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(_BUCKETS + " SELECT count(*) FILTER (WHERE status IN ('manual', 'auto_matched'))::BIGINT AS matched, count(*) FILTER (WHERE status = 'ambiguous')::BIGINT AS ambiguous, count(*) FILTER (WHERE status = 'not_found')::BIGINT AS not_found, count(*)::BIGINT AS processed, count(*)::BIGINT AS total FROM b")
def import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.import_stats(_matched(spark, sf_dir)[0])


@query(_BUCKETS + " SELECT c.item_id, max(c.book_id) AS book_id FROM cand c JOIN b USING (item_id) JOIN good g USING (item_id) WHERE b.status = 'ambiguous' AND c.rank <= 20 AND c.score >= 0.3 AND c.score >= g.top - 0.001::FLOAT GROUP BY 1")
def auto_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, books = _matched(spark, sf_dir)
    return resolve.auto_resolve(matched, books.withColumn("registerdate", F.col("id")))


@query(_ITEMS.replace("items AS", "WITH items AS", 1) + " SELECT item_id, author_norm, title_norm FROM norm")
def normalize_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("item_id", "author_norm", "title_norm")


# --- evaluation -----------------------------------------------------------------------------------------------------

_RUN = """q AS (SELECT 'q' || n_nationkey AS name, 5 AS top_k FROM nation),
r AS (SELECT 'q' || c_nationkey AS name, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY {order}, c_custkey) AS pos, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer WHERE c_nationkey % 7 <> {skip}),
w AS (SELECT DISTINCT 'q' || c_nationkey AS name, c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000),
s AS (SELECT q.name, q.top_k, coalesce(max(r.total), 0) AS total, (SELECT count(*) FROM w WHERE w.name = q.name) AS relevant,
  count(w.id) FILTER (WHERE r.pos <= q.top_k) AS hits, min(r.pos) FILTER (WHERE w.id IS NOT NULL) AS first
  FROM q LEFT JOIN r USING (name) LEFT JOIN w ON w.name = r.name AND w.id = r.id GROUP BY 1, 2),
z AS (SELECT name, top_k, total::BIGINT AS total, relevant::BIGINT AS relevant, CASE WHEN relevant > 0 THEN hits / relevant ELSE 0.0 END AS recall_at_k, coalesce(1.0 / first, 0.0) AS reciprocal_rank, total = 0 AS zero_result FROM s)"""


def _scores(spark: SparkSession, sf_dir: str, order: str, skip: int) -> DataFrame:
    c = _read(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("q"), F.col("c_nationkey").cast("string")))
    by = Window.partitionBy("c_nationkey")
    shown = c.where(F.col("c_nationkey") % 7 != skip)
    results = shown.select("name", F.col("c_custkey").alias("id"), F.row_number().over(by.orderBy(F.expr(order), "c_custkey")).alias("pos"), F.count("*").over(by).alias("total"))
    relevant = c.where("c_mktsegment = 'MACHINERY' AND c_acctbal > 5000").select("name", F.col("c_custkey").alias("id"))
    queries = _read(spark, sf_dir, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(5).alias("top_k"))
    return evaluate.score_queries(results, relevant, queries)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("WITH " + _RUN.format(order="c_acctbal", skip=3) + " SELECT name, top_k, total, relevant, round(recall_at_k, 6) AS recall_at_k, round(reciprocal_rank::DOUBLE, 6) AS reciprocal_rank, zero_result FROM z")
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir, "c_acctbal", 3), ["recall_at_k", "reciprocal_rank"])


@query("WITH " + _RUN.format(order="c_acctbal", skip=3) + " SELECT count(*)::BIGINT AS total_queries, (count(*) FILTER (WHERE relevant > 0))::BIGINT AS scored_queries, round(avg(recall_at_k) FILTER (WHERE relevant > 0), 6) AS recall_at_k, round((avg(reciprocal_rank) FILTER (WHERE relevant > 0))::DOUBLE, 6) AS mrr, round(avg(zero_result::INT), 6) AS zero_rate FROM z")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.aggregate_scores(_scores(spark, sf_dir, "c_acctbal", 3)), ["recall_at_k", "mrr", "zero_rate"])


def _two_runs() -> str:
    one = _RUN.format(order="c_acctbal", skip=3)
    two = _RUN.format(order="-c_acctbal", skip=4)
    for n in "qrwsz":
        two = two.replace(f"{n} AS (SELECT", f"{n}2 AS (SELECT", 1)
    two = two.replace("FROM w WHERE w.name", "FROM w2 w WHERE w.name").replace("FROM q LEFT JOIN r USING (name) LEFT JOIN w ON", "FROM q2 q LEFT JOIN r2 r USING (name) LEFT JOIN w2 w ON").replace("AS zero_result FROM s)", "AS zero_result FROM s2)")
    return f"WITH {one}, {two}"


@query(
    _two_runs()
    + """, j AS (SELECT c.name, c.relevant, c.recall_at_k AS cr, b.recall_at_k AS br, c.reciprocal_rank AS cm, b.reciprocal_rank AS bm, c.zero_result AS cz, b.zero_result AS bz FROM z2 c JOIN z b USING (name)),
k AS (SELECT count(*) AS shared_queries, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE cr < br - 1e-9), '') AS regressed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE (bm > 1e-9 AND cm <= 1e-9) OR (NOT bz AND cz)), '') AS lost,
  coalesce(avg(cr) FILTER (WHERE relevant > 0), 0) - coalesce(avg(br) FILTER (WHERE relevant > 0), 0) AS recall_delta, coalesce(avg(cm) FILTER (WHERE relevant > 0), 0) - coalesce(avg(bm) FILTER (WHERE relevant > 0), 0) AS mrr_delta, avg(cz::INT) - avg(bz::INT) AS zero_rate_delta FROM j)
SELECT shared_queries::BIGINT AS shared_queries, '' AS added, '' AS missing, regressed, lost, round(recall_delta::DOUBLE, 6) AS recall_delta, round(mrr_delta::DOUBLE, 6) AS mrr_delta, round(zero_rate_delta::DOUBLE, 6) AS zero_rate_delta,
  CASE WHEN lost <> '' OR recall_delta < -1e-9 OR mrr_delta < -1e-9 OR zero_rate_delta > 1e-9 THEN 'regression' ELSE 'pass' END AS verdict FROM k"""
)
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluate.compare_runs(_scores(spark, sf_dir, "-c_acctbal", 4), _scores(spark, sf_dir, "c_acctbal", 3))
    row = _rounded(row, ["recall_delta", "mrr_delta", "zero_rate_delta"])
    return row.select(*[F.array_join(c, ",").alias(c) if c in ("added", "missing", "regressed", "lost") else F.col(c) for c in row.columns])


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS least FROM events GROUP BY 1")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return evaluate.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).join(e.groupBy("event_type").agg(F.min("value").alias("least")), "event_type")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE i = least(floor(0.5 * n), n - 1)) AS p50, max(value) FILTER (WHERE i = least(floor(0.99 * n), n - 1)) AS p99 FROM r GROUP BY 1")
def percentile_floor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.floor_rank(_read(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS books, (SELECT max(p_partkey) FROM part) AS max_book_id, (SELECT count(*) FROM supplier)::BIGINT AS authors")
def catalog_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return evaluate.fingerprint(c.book, c.author)


@query("SELECT event_type, count(*) / 60.0 AS per_second, coalesce(sum(event_id % 7) / nullif(sum(event_id % 7) + sum(event_id % 3), 0), 0.0) AS hit_ratio FROM events GROUP BY 1")
def load_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 7).alias("hits"), (F.col("event_id") % 3).alias("reads"))
    return evaluate.throughput(e, "event_type", 60.0)


# --- changes and the archive ledger ---------------------------------------------------------------------------------

_LEDGER = "ledger AS (SELECT 'arc' || s_suppkey || '.zip' AS cat_name, s_suppkey % 3 <> 0 AS is_scanned, s_nationkey::BIGINT AS books_count, CASE WHEN s_suppkey % 2 = 0 THEN 1 END::BIGINT AS errors_count FROM supplier)"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("arc"), k.cast("string"), F.lit(".zip")).alias("cat_name"),
        (k % 3 != 0).alias("is_scanned"),
        F.lit("2020-01-01").cast("timestamp").alias("scanned_at"),
        F.col("s_nationkey").cast("long").alias("books_count"),
        F.when(k % 2 == 0, 1).cast("long").alias("errors_count"),
    )


@query(f"WITH {_LEDGER} SELECT count(*)::BIGINT AS total_catalogs, (count(*) FILTER (WHERE is_scanned))::BIGINT AS scanned_catalogs, (count(*) FILTER (WHERE NOT is_scanned))::BIGINT AS unscanned_catalogs, coalesce(sum(books_count), 0)::BIGINT AS total_books, coalesce(sum(errors_count), 0)::BIGINT AS total_errors FROM ledger")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.catalog_stats(_ledger(spark, sf_dir))


@query(f"WITH {_LEDGER} SELECT DISTINCT 'arc' || c_custkey % 300 || '.zip' AS cat_name FROM customer WHERE 'arc' || c_custkey % 300 || '.zip' NOT IN (SELECT cat_name FROM ledger WHERE is_scanned)")
def unscanned_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = _read(spark, sf_dir, "customer").select(F.concat(F.lit("arc"), (F.col("c_custkey") % 300).cast("string"), F.lit(".zip")).alias("cat_name"))
    return changes.unscanned(disk, _ledger(spark, sf_dir))


@query(f"WITH {_LEDGER}, n AS (SELECT 'arc' || n_nationkey * 5 || '.zip' AS cat_name, n_nationkey::BIGINT AS books_count FROM nation) SELECT cat_name, true AS is_scanned, books_count, 0::BIGINT AS errors_count FROM n UNION ALL SELECT * FROM ledger WHERE cat_name NOT IN (SELECT cat_name FROM n)")
def ledger_mark_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    reports = _read(spark, sf_dir, "nation").select(F.concat(F.lit("arc"), (k * 5).cast("string"), F.lit(".zip")).alias("cat_name"), k.cast("long").alias("books_count"), F.lit(0).cast("long").alias("errors_count"), F.lit("2021-01-01").cast("timestamp").alias("scanned_at"))
    return changes.mark_scanned(_ledger(spark, sf_dir), reports).drop("scanned_at")


@query("WITH d AS (SELECT row_number() OVER (ORDER BY n) AS id, n AS name FROM (SELECT DISTINCT p_brand AS n FROM part WHERE p_partkey % 2 = 0)), x AS (SELECT DISTINCT p_brand || '-' || p_type AS name FROM part UNION SELECT p_brand FROM part WHERE p_partkey % 2 = 0) SELECT id, name FROM d UNION ALL SELECT (SELECT max(id) FROM d) + row_number() OVER (ORDER BY name), name FROM x WHERE name NOT IN (SELECT name FROM d)")
def get_or_create_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    old = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("name"))
    dim = changes.get_or_create(spark.createDataFrame([], "id long, name string"), old)
    return changes.get_or_create(dim, part.select(F.concat_ws("-", "p_brand", "p_type").alias("name")).union(old))


@query("WITH n AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS c_acctbal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, c_acctbal FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    new = orders.withColumn("_n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("_n = 1")
    return changes.upsert(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), new.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal")), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    tables = {"lineitem": _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")}
    return changes.delete_cascade(tables, gone, {"lineitem": "l_orderkey"})["lineitem"]


@query("SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'title' END, CASE WHEN p_size % 4 = 0 THEN 'lang' END, CASE WHEN p_size % 5 = 0 THEN 'authors' END, CASE WHEN p_size % 7 = 0 THEN 'series' END, CASE WHEN p_size % 2 = 0 THEN 'cover' END) AS diff FROM part")
def rescan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size")

    def side(new: bool):
        changed = lambda n: (k % n == 0) & F.lit(new)
        authors = F.array(F.struct(F.when(changed(5), "b").otherwise("a").alias("name"), F.lit(new).alias("sort")))
        series = F.struct(F.lit("s").alias("title"), F.when(changed(7), "2").otherwise("1").alias("index"))
        return F.struct(
            F.when(changed(3), "new").otherwise(F.col("p_name")).alias("title"), F.lit("a").alias("annotation"), F.when(changed(4), "de").otherwise("en").alias("lang"),
            F.lit("2000").alias("docdate"), authors.alias("authors"), series.alias("series"), changed(2).alias("cover"),
        )

    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), side(False).alias("old"), side(True).alias("new"))
    return rows.select("id", F.array_join(changes.diff_fields(), ",").alias("diff"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'patched' ELSE p_name END AS title, p_brand AS series FROM part")
def sparse_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = star_catalog(spark, sf_dir).book.select("id", "title", "series")
    patches = _read(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit("patched").alias("title"), F.lit(None).cast("string").alias("series"))
    return changes.patch(books, patches, ["title", "series"])


# --- documents ------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 2000) AS sample FROM pages")
def strip_tags_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", documents.text_sample(F.lit(None).cast("string"), T.strip_tags(F.col("html"))).alias("sample"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.assign_anchors(documents.html_blocks(_read(spark, sf_dir, "pages")))


@query()
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.table_of_contents(documents.assign_anchors(documents.html_blocks(_read(spark, sf_dir, "pages"))))


@query(
    """WITH RECURSIVE b AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents),
c AS (SELECT id, seq, strlen(line)::BIGINT AS cost FROM b),
p AS (SELECT id, seq, cost, cost AS size, 0 AS portion FROM c WHERE seq = 1
UNION ALL SELECT c.id, c.seq, c.cost, CASE WHEN p.size > 0 AND p.size + c.cost > 2048 THEN c.cost ELSE p.size + c.cost END, CASE WHEN p.size > 0 AND p.size + c.cost > 2048 THEN p.portion + 1 ELSE p.portion END FROM p JOIN c ON c.id = p.id AND c.seq = p.seq + 1)
SELECT id, count(DISTINCT portion)::BIGINT AS portions, sum(cost)::BIGINT AS bytes, false AS too_large FROM p GROUP BY 1"""
)
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    note = F.array().cast("array<struct<id:string,cost:bigint>>")
    blocks = lines.select("id", "seq", F.octet_length("line").alias("cost"), note.alias("notes"))
    return documents.portion_sizes(documents.pack_portions(blocks, portion_bytes=2048))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' ELSE 'unknown' END AS code, CASE WHEN length(text) < 20 THEN 'tag_fallback' ELSE 'tag_match' END AS method FROM documents")
def standardize_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    long = F.create_map(*[F.lit(x) for x in ("en", "English", "fr", "fra", "de", "ger", "es", " ES ")])
    tag = F.element_at(long, F.col("lang"))
    decided = documents.language_decision(tag, F.col("text"), documents.standard_language(F.col("lang")))
    return d.select("doc_id", decided["lang"].alias("code"), decided["method"].alias("method"))


@query("WITH i AS (SELECT page_id AS id, page_id % 9 AS grp, strlen(html)::BIGINT AS size FROM pages) SELECT id, grp, sum(size) OVER (PARTITION BY grp ORDER BY lpad(id::VARCHAR, 9, '0') ROWS UNBOUNDED PRECEDING) <= 60000 AS fits FROM i")
def image_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select((F.col("page_id") % 9).alias("id"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("name"), F.octet_length("html").alias("size"), "page_id")
    return documents.within_budget(p, 60000).select(F.col("page_id").alias("id"), F.col("id").alias("grp"), "fits")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS name, replace(p_brand, '.', '-') || '/' || replace(p_partkey || '.fb2', '.', '-') || '.jpg' AS cover, left(sha256(p_name || chr(0) || '3'), 16) AS revision FROM part")
def shown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    name = R.display_name(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""), F.col("p_brand"))
    cover = R.cover_path(F.col("p_brand"), F.concat(F.col("p_partkey").cast("string"), F.lit(".fb2")))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), cover.alias("cover"), R.revision_key(F.col("p_name"), F.lit(3)).alias("revision"))


# --- keyed state ----------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT *, strlen(text) + strlen(role) + 50 AS cost FROM conversations), s AS (SELECT conv_id, turn, sum(cost) OVER w AS total, row_number() OVER w AS nth FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn FROM s WHERE total <= 4096 OR nth = 1")
def conversation_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.trim_conversations(_read(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("SELECT conv_id, count(*)::BIGINT AS messages, (count(*) FILTER (WHERE role = 'user'))::BIGINT AS user_messages, (count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS bot_messages, sum(strlen(text) + strlen(role) + 50)::BIGINT AS length FROM conversations GROUP BY 1")
def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.conversation_stats(_read(spark, sf_dir, "conversations"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
w AS (SELECT user_id, ts, i, ts AS start, 1 AS n FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.ts, e.i, CASE WHEN e.ts >= w.start + INTERVAL 43200 SECOND THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 43200 SECOND THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id AS key, count(DISTINCT start)::BIGINT AS windows, max(n)::BIGINT AS most, (count(*) FILTER (WHERE n > 2))::BIGINT AS refused FROM w GROUP BY 1"""
)
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.fixed_windows(_read(spark, sf_dir, "events"), "user_id", seconds=43200, limit=2)
    return out.groupBy("key").agg(F.countDistinct("window_start").alias("windows"), F.max("count").alias("most"), F.count_if(~F.col("allowed")).alias("refused"))


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY event_type) AS total FROM events) SELECT event_id, event_type, done::BIGINT AS done, total::BIGINT AS total FROM r WHERE done % 50 = 0 OR done = total")
def progress_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.progress_snapshots(_read(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", 50).select("event_id", "event_type", "done", "total")


def queries() -> dict[str, Query]:
    from bookloom.plans import intake, maintenance  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from bookloom.plans import intake, maintenance  # noqa: F401

    return dict(_SQL)
