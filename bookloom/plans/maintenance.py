"""Registered queries of upkeep: filters, rescans, item transitions, encodings and repairs, notes in portions, states."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators import changes, documents, filters, ingest, lists, rescan, resolve, search, state
from bookloom.plans.catalog import star_catalog
from bookloom.plans.oracle import CATALOG
from bookloom.plans.queries import _read, query

# --- filters --------------------------------------------------------------------------------------------------------

_USERS = "users AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(c_name) END AS username, c_mktsegment || c_custkey || '@x.org' AS email, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'bot' || c_custkey END AS bot_token FROM customer)"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    token = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("bot"), k.cast("string")))
    return _read(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, name).otherwise(F.lower(name)).alias("username"), F.concat("c_mktsegment", k.cast("string"), F.lit("@x.org")).alias("email"), token.alias("bot_token"))


@query(f"WITH {_USERS} SELECT id, username, email FROM users WHERE username ILIKE '%mer#00000001%' OR email ILIKE '%building5%'")
def users_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.find_users(_users(spark, sf_dir), "building5").unionByName(filters.find_users(_users(spark, sf_dir), "mer#00000001")).distinct().select("id", "username", "email")


@query(f"WITH {_USERS} SELECT id FROM users WHERE lower(username) = 'customer#000000007' OR lower(email) = 'customer#000000007'")
def user_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.same_user(_users(spark, sf_dir), "CUSTOMER#000000007").select("id")


@query(f"WITH {_USERS} SELECT id, bot_token FROM users WHERE bot_token <> ''")
def users_with_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_token(_users(spark, sf_dir)).select("id", "bot_token")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderdate > TIMESTAMP '1996-01-01'")
def invites_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("invite"), F.col("o_orderdate").cast("timestamp").alias("before_date"))
    return filters.valid_invites(rows, "2-HIGH", datetime.datetime(1996, 1, 1)).select("id")


_GENRES = "genres AS (SELECT row_number() OVER (ORDER BY p_type) AS id, p_type AS genre, CASE WHEN length(p_type) % 2 = 0 THEN p_type ELSE 'Named ' || lower(p_type) END AS title FROM (SELECT DISTINCT p_type FROM part))"


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = changes.get_or_create(spark.createDataFrame([], "id long, name string"), _read(spark, sf_dir, "part").select(F.col("p_type").alias("name")))
    title = F.when(F.char_length("name") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("Named "), F.lower("name")))
    return kinds.select("id", F.col("name").alias("genre"), title.alias("title"))


@query(f"WITH {_GENRES} SELECT id, genre FROM genres WHERE title = genre")
def genres_to_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.genres_to_name(_genres(spark, sf_dir)).select("id", "genre")


@query(f"WITH {_GENRES} SELECT id, title FROM genres WHERE contains(lower(genre), 'ed') OR contains(lower(title), 'ed')")
def genres_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.genres_like(_genres(spark, sf_dir), "ED").select("id", "title")


@query(f"WITH {_GENRES} SELECT DISTINCT p_partkey AS book_id FROM part JOIN genres ON p_type = genre WHERE id = 2 ORDER BY 1 LIMIT 5")
def genre_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _read(spark, sf_dir, "part").join(_genres(spark, sf_dir), F.col("p_type") == F.col("genre")).select(F.col("p_partkey").alias("book_id"), F.col("id").alias("genre_id"))
    return filters.sample_books(links, 2)


@query(f"WITH {_GENRES}, g AS (SELECT p_partkey AS id FROM part JOIN genres ON p_type = genre WHERE genres.id = 2), {CATALOG}, p AS (SELECT id, row_number() OVER (ORDER BY id DESC)::BIGINT AS pos FROM book WHERE approved AND NOT duplicate_hidden AND id IN (SELECT id FROM g)) SELECT * FROM p WHERE pos <= 100")
def scope_genre_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    links = _read(spark, sf_dir, "part").join(_genres(spark, sf_dir), F.col("p_type") == F.col("genre")).select(F.col("p_partkey").alias("book_id"), F.col("id").alias("genre_id"))
    return lists.list_books(replace(star_catalog(spark, sf_dir), book_genre=links), search.BookSearch(genre_id=2)).withColumn("pos", F.col("pos").cast("long"))


_CURATED = """col AS (SELECT n_nationkey AS id, n_nationkey % 2 = 0 AS is_curated, n_nationkey % 3 <> 0 AS is_public FROM nation),
item AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 25 AS collection_id, CASE WHEN l_linenumber < 6 THEN l_partkey END AS book_id,
  CASE l_linenumber WHEN 1 THEN 'manual' WHEN 2 THEN 'auto_matched' WHEN 6 THEN 'manual' ELSE 'ambiguous' END AS match_status, l_linenumber AS position FROM lineitem)"""


def _curated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, k = F.col("n_nationkey"), F.col("l_linenumber")
    col = _read(spark, sf_dir, "nation").select(n.cast("long").alias("id"), (n % 2 == 0).alias("is_curated"), (n % 3 != 0).alias("is_public"))
    status = F.when(k.isin(1, 6), "manual").when(k == 2, "auto_matched").otherwise("ambiguous")
    item = _read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + k).alias("id"), (F.col("l_suppkey") % 25).alias("collection_id"), F.when(k < 6, F.col("l_partkey")).alias("book_id"), status.alias("match_status"), k.alias("position"),
        F.lit(0).cast("float").alias("match_score"), F.lit("{}").alias("external_extra"),
    )
    return col, item


@query(f"WITH {_CURATED} SELECT collection_id, book_id, position FROM item JOIN col ON col.id = collection_id WHERE is_curated AND is_public AND book_id IS NOT NULL AND match_status IN ('manual', 'auto_matched')")
def curated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, item = _curated(spark, sf_dir)
    return filters.shown_items(item, col)


@query(f"WITH {_CURATED}, {CATALOG}, m AS (SELECT DISTINCT book_id FROM item JOIN col ON col.id = collection_id WHERE is_curated AND is_public AND match_status IN ('manual', 'auto_matched') AND collection_id = 4), p AS (SELECT id, row_number() OVER (ORDER BY id DESC)::BIGINT AS pos FROM book WHERE approved AND NOT duplicate_hidden AND id IN (SELECT book_id FROM m)) SELECT * FROM p WHERE pos <= 100")
def scope_curated_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    col, item = _curated(spark, sf_dir)
    return lists.list_books(replace(star_catalog(spark, sf_dir), collection=col, collection_item=item), search.BookSearch(curated_collection_id=4)).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT p_partkey AS id, p_name AS title, p_partkey // 3::BIGINT AS pos FROM part WHERE p_partkey % 3 = 0 AND p_partkey BETWEEN 1 AND 99")
def hydrate_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = spark.range(1, 34).select((F.col("id") * 3).alias("id"), F.col("id").alias("pos")).unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("id"), F.lit(99).cast("long").alias("pos")))
    return filters.in_rank_order(ranked, star_catalog(spark, sf_dir).book.select("id", "title")).select("id", "title", "pos")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey = 7")
def book_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_key(star_catalog(spark, sf_dir).book.select("id", "title"), 7)


@query("""WITH q AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN '"' || s_name || '" by ' || s_nationkey WHEN 1 THEN s_name ELSE ' by ' || s_name END AS query FROM supplier),
c AS (SELECT id, query, strpos(query, ' by ') AS place FROM q)
SELECT id, CASE WHEN place > 0 THEN trim(left(query, place - 1), '"') ELSE query END AS title, CASE WHEN place > 1 THEN nullif(substring(query, place + 4), '') END AS author FROM c""")
def combined_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    text = F.when(k % 3 == 0, F.concat(F.lit('"'), name, F.lit('" by '), F.col("s_nationkey").cast("string"))).when(k % 3 == 1, name).otherwise(F.concat(F.lit(" by "), name))
    return filters.split_query(_read(spark, sf_dir, "supplier").select(k.alias("id"), text.alias("query"))).select("id", "title", "author")


# --- item transitions and users -------------------------------------------------------------------------------------


@query(f"""WITH {_CURATED} SELECT id, CASE WHEN id % 11 = 0 THEN 'ignored' WHEN id % 7 = 0 THEN 'auto_matched' ELSE match_status END AS match_status,
CASE WHEN id % 7 = 0 AND id % 2 = 0 THEN 5 ELSE book_id END AS book_id, CASE WHEN id % 7 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS match_score, CASE WHEN id % 7 = 0 THEN 'x' ELSE '{{}}' END AS external_extra FROM item""")
def item_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, item = _curated(spark, sf_dir)
    again = item.where("id % 7 = 0").select(F.col("id").alias("item_id"), F.lit("auto_matched").alias("status"), F.when(F.col("id") % 2 == 0, F.lit(5)).cast("long").alias("book_id"), F.lit(0.5).alias("score"), F.lit("x").alias("extra"))
    out = changes.ignore_items(changes.rewrite_items(item, again), item.where("id % 11 = 0").select("id"))
    return out.select("id", "match_status", "book_id", F.col("match_score").cast("double").alias("match_score"), "external_extra")


@query("""SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 3 THEN 'done' ELSE 'running' END AS import_status,
CASE WHEN n_nationkey = 3 THEN (SELECT '{"matched":' || count(*) FILTER (WHERE c_mktsegment = 'BUILDING') || ',"total":' || count(*) || '}' FROM customer) END AS import_stats FROM nation""")
def import_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("running").alias("import_status"), none.alias("import_error"), none.alias("import_stats"), F.lit(None).cast("timestamp").alias("imported_at"))
    stats = _read(spark, sf_dir, "customer").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("matched"), F.count("*").alias("total"))
    return changes.finish_import(rows, 3, stats, "done").select("id", "import_status", "import_stats")


@query("""WITH u AS (SELECT c_custkey AS id FROM customer WHERE c_custkey <> 7), c AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey <> 7 OR o_orderkey % 5 = 0),
b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM c)), v AS (SELECT id FROM b WHERE l_suppkey <> 7), f AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey <> 7)
SELECT 'user' AS name, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM u UNION ALL SELECT 'collection', count(*), sum(id)::BIGINT FROM c UNION ALL SELECT 'collection_book', count(*), sum(id)::BIGINT FROM b
UNION ALL SELECT 'vote', count(*), sum(id)::BIGINT FROM v UNION ALL SELECT 'favorite', count(*), sum(id)::BIGINT FROM f""")
def user_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, item = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    collection = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("user_id"))
    item_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tables = {
        "collection": collection,
        "collection_book": item.select(item_id.alias("id"), F.col("l_orderkey").alias("book_collection_id")),
        "vote": item.select(item_id.alias("id"), F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("collection_id")),
        "favorite": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")),
        "user": _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")),
    }
    left = changes.delete_user(tables, 7)
    count = lambda n: left[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    return count("user").unionByName(count("collection")).unionByName(count("collection_book")).unionByName(count("vote")).unionByName(count("favorite"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE o_custkey END AS user_id FROM orders")
def orphans_reattached(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return changes.reattach(rows, rows.where("user_id % 3 <> 0").select(F.col("user_id").alias("id")), "user_id", 1)


@query("""WITH c AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '"note":"n' || c_custkey || '"' END AS own, CASE WHEN c_custkey % 3 = 0 THEN '"year":1999' END AS year,
    CASE WHEN c_custkey % 5 < 3 AND c_custkey % 13 > 0 THEN '"candidates":[' || array_to_string([
      '{"book_id":' || (c_custkey + i) || ',"score":' || ['0.0', '0.25', '0.5', '0.75'][i % 4 + 1] || '}' for i in range(1, least(c_custkey % 13, 10) + 1)], ',') || ']' END AS found FROM customer
) SELECT k AS item_id, CASE WHEN own IS NOT NULL OR year IS NOT NULL OR found IS NOT NULL THEN '{' || concat_ws(',', own, year, found) || '}' END AS extra FROM c""")
def extra_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    # a year or candidates of the item's own give way to those of the match
    extra = F.create_map(F.lit("note"), F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))), F.lit("year"), F.when((k % 2 == 0) & (k % 3 == 0), "old"), F.lit("candidates"), F.when((k % 5 < 3) & (k % 13 > 0), "none"))
    customer = _read(spark, sf_dir, "customer")
    items = customer.select(k.alias("item_id"), F.when(k % 3 == 0, 1999).otherwise(0).alias("year"), F.map_filter(extra, lambda _, v: v.isNotNull()).alias("extra"))
    one = lambda i: F.struct((k + i).alias("book_id"), ((i % 4) / 4).cast("float").alias("score"))
    found = F.when(k % 13 > 0, F.transform(F.sequence(F.lit(1).cast("long"), k % 13), one))
    return resolve.extra_payload(customer.where("c_custkey % 5 < 3").select(k.alias("item_id"), found.alias("candidates")), items)


# --- scanning again -------------------------------------------------------------------------------------------------

_SCANNED = """b AS (SELECT p_partkey AS id, p_brand AS path, p_name AS title, p_size % 2 = 0 AS cover, CASE WHEN p_partkey % 7 = 0 THEN 'file not found in archive' WHEN p_partkey % 5 = 0 THEN 'broken' END AS scan_error FROM part)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    part = _read(spark, sf_dir, "part")
    name = F.concat(k.cast("string"), F.lit(".fb2")).alias("filename")
    books = part.select(k.alias("id"), F.col("p_brand").alias("path"), name, F.col("p_name").alias("title"), none.alias("annotation"), F.lit("en").alias("lang"), none.alias("docdate"), (F.col("p_size") % 2 == 0).alias("cover"))
    parsed = part.where(k % 7 != 0).select(
        F.col("p_brand").alias("path"), name, F.upper("p_name").alias("title"), F.lit("a").alias("annotation"), F.lit("de").alias("lang"), F.lit("2000").alias("docdate"),
        (F.col("p_size") % 3 == 0).alias("cover"), F.when(k % 5 == 0, "broken").alias("error"),
    )
    return rescan.fix_scan(books, parsed)


@query(f"WITH {_SCANNED} SELECT id, CASE WHEN scan_error IS NULL THEN upper(title) ELSE title END AS title, CASE WHEN scan_error IS NULL THEN 'de' ELSE 'en' END AS lang, cover OR (scan_error IS NULL AND (SELECT p_size % 3 = 0 FROM part WHERE p_partkey = id)) AS cover, scan_error FROM b")
def fix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("id", "title", "lang", "cover", "scan_error")


@query(f"WITH {_SCANNED} SELECT path, id, scan_error FROM b WHERE scan_error IS NOT NULL ORDER BY path, id LIMIT 500")
def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescan.first_errors(_scanned(spark, sf_dir))


@query(f"WITH {_SCANNED} SELECT count(DISTINCT path)::BIGINT AS archives, count(*)::BIGINT AS total, (count(*) FILTER (WHERE scan_error IS NULL))::BIGINT AS updated, (count(*) FILTER (WHERE scan_error IS NOT NULL))::BIGINT AS failed FROM b")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescan.scan_report(_scanned(spark, sf_dir))


@query("SELECT p_brand AS path, count(*)::BIGINT AS books, min(p_partkey) AS first_id FROM part GROUP BY 1")
def archive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescan.archive_groups(_read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("id")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'new' ELSE p_name END AS title, CASE WHEN p_size % 4 = 0 AND p_partkey % 5 <> 0 THEN 'de' ELSE 'en' END AS lang FROM part WHERE (p_size % 3 = 0 OR p_size % 4 = 0) AND p_partkey % 4 < 3")
def rescan_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")

    def side(new: bool):
        changed = lambda n: (size % n == 0) & F.lit(new)
        none = F.lit(None)
        return F.struct(
            F.when(changed(3), "new").otherwise(F.col("p_name")).alias("title"), none.cast("string").alias("annotation"), F.when(changed(4), "de").otherwise("en").alias("lang"),
            none.cast("string").alias("docdate"), none.cast("array<struct<name:string>>").alias("authors"), none.cast("struct<title:string>").alias("series"), none.cast("boolean").alias("cover"),
        )

    rows = _read(spark, sf_dir, "part").select(k.alias("id"), side(False).alias("old"), side(True).alias("new"))
    flags = F.struct((k % 2 == 0).alias("title"), F.when(k % 5 == 0, F.lit(False)).alias("lang"))
    decisions = _read(spark, sf_dir, "part").where("p_partkey % 5 <> 9").select(k.alias("id"), (k % 4 < 3).alias("approved"), flags.alias("flags"))
    return rescan.decide(rescan.preview(rows), decisions, ["title", "lang"])[1]


# --- documents ------------------------------------------------------------------------------------------------------


@query()
def chunk_pack_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL: a recursion that carries sets of notes is too slow on whole tables; held against brute force in the tests."""
    lines = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("seq", F.col("at") + 1)
    note = F.array(F.struct((F.col("seq") % 4).cast("string").alias("id"), F.lit(300).cast("long").alias("cost")))
    blocks = lines.select("id", "seq", F.octet_length("line").alias("cost"), F.when(F.col("seq") % 3 == 0, note).otherwise(F.slice(note, 1, 0)).alias("notes"))
    packed = documents.pack_portions(blocks, portion_bytes=1024, lone_bytes=500)
    return documents.portion_sizes(packed, 20000).join(packed.groupBy("id").agg(F.count_if(F.col("error").isNotNull()).alias("errors")), "id")


@query(
    r"""WITH t AS (SELECT doc_id, doc_id % 3 AS k, translate(coalesce(text, ''), '<>&', '') AS t FROM documents),
d AS (SELECT doc_id, k, CASE WHEN doc_id % 2 = 0 THEN '<a xmlns:xlink="x"><b xlink:href="#n"/>' ELSE '<a xmlns:l="x" xmlns:xlink="x"><b l:href="#n"/>' END || chr((1 + doc_id % 8)::INTEGER) || replace(t, ' ', CASE k WHEN 0 THEN ' &amp; ' WHEN 1 THEN ' &lt; ' ELSE ' &lt;? &quot; ' END) || '</a>' AS t FROM t)
SELECT doc_id, md5(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')) AS fixed_md5 FROM d"""
)
def repaired_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with a stray mark at every blank, control characters and links by both prefixes."""
    k = F.col("doc_id")
    head = F.when(k % 2 == 0, '<a xmlns:xlink="x"><b l:href="#n"/>').otherwise('<a xmlns:l="x" xmlns:xlink="x"><b l:href="#n"/>')
    plain = F.translate(F.coalesce("text", F.lit("")), "<>&", "")
    body = F.when(k % 3 == 0, F.replace(plain, F.lit(" "), F.lit(" & "))).when(k % 3 == 1, F.replace(plain, F.lit(" "), F.lit(" < "))).otherwise(F.replace(plain, F.lit(" "), F.lit(" <? &quot; ")))
    raw = F.concat(head, F.char(1 + k % 8), body, F.lit("</a>"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(ingest.repair_markup(raw)).alias("fixed_md5"))


_TABLE = "MAP {" + ", ".join(f"'{tag}': '{code}'" for tag, code in documents.LANGUAGES.items()) + "}"


@query(rf"""WITH w AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS word, lang FROM documents),
t AS (SELECT doc_id, lower(trim(CASE doc_id % 4 WHEN 0 THEN ' ' || upper(lang) || ' ' WHEN 1 THEN substring(word, 1, (n % 5)::INT) WHEN 2 THEN word ELSE lang || substring(word, 1, 1) END)) AS tag FROM w)
SELECT doc_id, CASE WHEN tag = '' THEN '' ELSE coalesce(element_at({_TABLE}, tag)[1], CASE WHEN length(tag) BETWEEN 2 AND 3 THEN substring(tag, 1, 2) ELSE 'unknown' END) END AS code FROM t""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out of languages and words of the texts, of any case and length."""
    k, n, word = F.col("doc_id"), F.char_length("text"), F.regexp_extract("text", "[A-Za-z]+", 0)
    tag = F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).when(k % 4 == 1, F.substring(word, F.lit(1), n % 5)).when(k % 4 == 2, word).otherwise(F.concat("lang", F.substring(word, 1, 1)))
    docs = _read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", documents.standard_language(tag).alias("code"))


@query("SELECT doc_id, text AS decoded, CAST(NULL AS VARCHAR) AS error, md5(text) AS md5 FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, NULL, 'undeclared charset', md5('\\xE9abc'::BLOB) FROM documents WHERE doc_id % 3 = 0")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("E9")), F.encode(F.lit("abc"), "UTF-8"))).otherwise(F.concat(mark, F.encode("text", "UTF-8")))
    out = ingest.decoded(_read(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.md5(F.encode("text", "UTF-8")).alias("plain")))
    return out.select("doc_id", F.col("text").alias("decoded"), "error", F.when(F.col("doc_id") % 3 == 1, F.col("plain")).otherwise(F.col("md5")).alias("md5"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Tom & ' || c_name ELSE c_name END AS title FROM customer")
def cleaned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(' "Tom  &\n'), F.col("c_name"), F.lit('#".'))).otherwise(F.concat(F.lit("- "), F.col("c_name"), F.lit(" `")))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.clean_title(raw).alias("title"))


@query("""WITH c AS (
  SELECT p_partkey AS book_id, 0 AS pos, p_partkey % 150 + 1 AS given, p_brand AS name FROM part UNION ALL SELECT p_partkey, 1, NULL, p_type FROM part UNION ALL SELECT p_partkey, 2, NULL, upper(p_type) FROM part
  UNION ALL SELECT p_partkey, 3, NULL, p_brand FROM part UNION ALL SELECT p_partkey, 4, p_partkey % 100 + 1, NULL FROM part
), k AS (
  SELECT c.*, s_suppkey IS NOT NULL AS there, row_number() OVER (PARTITION BY book_id, given, lower(name) ORDER BY pos) AS nth FROM c LEFT JOIN supplier ON s_suppkey = given WHERE book_id % 3 = 0
), n AS (
  SELECT * FROM k WHERE NOT there AND name IS NOT NULL AND (nth = 1 OR given IS NOT NULL)
), m AS (
  SELECT name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT s_name FROM supplier))
)
SELECT l_partkey AS book_id, l_suppkey AS author_id FROM lineitem WHERE l_partkey % 3 <> 0
UNION ALL SELECT DISTINCT book_id, id FROM (SELECT book_id, given AS id FROM k WHERE there UNION ALL SELECT book_id, id FROM n JOIN m USING (name))""")
def links_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of one of three books are set anew: by id where it is known, else by name, new names created."""
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), "p_brand", "p_type").where("book_id % 3 = 0")
    entry = lambda i, name: F.struct((F.lit(None) if i is None else i).cast("long").alias("id"), name.cast("string").alias("name"))
    k, none = F.col("book_id"), F.lit(None)
    entries = F.array(entry(k % 150 + 1, F.col("p_brand")), entry(None, F.col("p_type")), entry(None, F.upper("p_type")), entry(None, F.concat(F.lit(" "), "p_brand")), entry(k % 100 + 1, none))
    links = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("author_id"))
    authors = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return changes.set_links(links, part.select("book_id", entries.alias("entries")), authors, "author_id")[0]


# --- keyed state ----------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT max(ts) AS now FROM events), e AS (SELECT user_id AS key, ts, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS state FROM events),
l AS (SELECT key, max(struct_pack(ts := ts, state := state)) AS last FROM e GROUP BY 1)
SELECT key, last.state AS state FROM l, t WHERE last.state <> '' AND last.ts > t.now - INTERVAL 86400 SECOND""")
def user_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    rows = e.select(F.col("user_id").alias("key"), "ts", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("state"))
    return state.user_states(rows, now, 86400)
