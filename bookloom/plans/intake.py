"""Registered queries of intake: archives to a catalog, single entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions.images import judged_images
from bookloom.functions.storage import new_path
from bookloom.operators import book_ingest as I
from bookloom.operators import language
from bookloom.operators import markup_tree as M
from bookloom.plans.queries import _read, query
from bookloom.sources.archive_source import fetch_entries, read_archives, write_archives
from bookloom.sources.batches import BatchStore

#: Documents in an archive of the shelf that stands in for a library on disk.
ARCHIVE_DOCS = 250


def _xml(c: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, entry, content, doc_id: every document as a book; title, people, genre and series come from its columns."""
    d = _read(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    word = F.regexp_extract("text", "[A-Za-z]{2,}", 0)
    n = F.char_length("text")
    lit, lang, source = F.lit, F.col("lang"), F.col("source")
    person = lambda first, last: F.concat(lit("<author><first-name>"), first, lit("</first-name><last-name>"), last, lit("</last-name></author>"))
    series = F.concat(lit('<sequence name="S'), (n % 11).cast("string"), lit('" number="'), (n % 5).cast("string"), lit('"/>'))
    content = F.concat(
        lit('<?xml version="1.0" encoding="utf-8"?><FictionBook><description><title-info><genre>'), lang, lit("</genre>"), person(source, lang), F.when(n % 3 == 0, person(lit("editor"), lang)).otherwise(""),
        F.when(word != "", F.concat(lit("<book-title>Book "), word, lit("</book-title>"))).otherwise(""), lit("<lang>"), lang, lit("</lang>"), F.when(n % 2 == 0, series).otherwise(""),
        lit("</title-info></description><body><section><p>"), _xml(F.col("text")), lit("</p></section></body></FictionBook>"),
    )
    archive = F.concat(lit("shelf"), F.lpad(F.floor(F.col("doc_id") / ARCHIVE_DOCS).cast("string"), 9, "0"), lit(".zip"))
    return d.select(archive.alias("archive"), F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), lit(".fb2")).alias("entry"), F.encode(content, "UTF-8").alias("content"), "doc_id")


def shelved(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> str:
    """Write the shelf (or the archives that keep names) as ZIP files; gives their folder."""
    path = new_path(spark, "shelf")
    books = shelf(spark, sf_dir)
    write_archives(books if keep is None else books.where(keep), path).agg(F.sum("entries")).collect()
    return path


_SHELF = f"""d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, length(coalesce(text, '')) AS n FROM documents
), s AS (
  SELECT *, regexp_extract(text, '[A-Za-z]{{2,}}') AS word, 'shelf' || lpad((doc_id // {ARCHIVE_DOCS})::VARCHAR, 9, '0') || '.zip' AS archive, lpad(doc_id::VARCHAR, 12, '0') || '.fb2' AS entry,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body FROM d
), f AS (
  SELECT *, '<?xml version="1.0" encoding="utf-8"?><FictionBook><description><title-info><genre>' || lang || '</genre><author><first-name>' || source || '</first-name><last-name>' || lang || '</last-name></author>'
    || CASE WHEN n % 3 = 0 THEN '<author><first-name>editor</first-name><last-name>' || lang || '</last-name></author>' ELSE '' END || CASE WHEN word <> '' THEN '<book-title>Book ' || word || '</book-title>' ELSE '' END
    || '<lang>' || lang || '</lang>' || CASE WHEN n % 2 = 0 THEN '<sequence name="S' || (n % 11) || '" number="' || (n % 5) || '"/>' ELSE '' END
    || '</title-info></description><body><section><p>' || body || '</p></section></body></FictionBook>' AS content FROM s
)"""


@query(f"""WITH {_SHELF}, m AS (
  SELECT *, md5(content) AS md5, (doc_id // {ARCHIVE_DOCS}) % 2 AS batch FROM f WHERE word <> ''
), k AS (
  SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY batch, archive, entry) AS nth FROM m
), b AS (
  SELECT *, row_number() OVER (ORDER BY batch, archive, entry) AS id FROM k WHERE nth = 1
), a AS (
  SELECT id, batch, lang || ' ' || source AS name FROM b UNION SELECT id, batch, lang || ' editor' FROM b WHERE n % 3 = 0
), ai AS (SELECT name, row_number() OVER (ORDER BY min(batch), name) AS author_id FROM a GROUP BY name),
gi AS (SELECT lang, row_number() OVER (ORDER BY min(batch), lang) AS genre_id FROM b GROUP BY lang),
si AS (SELECT n % 11 AS s, row_number() OVER (ORDER BY min(batch), 'S' || (n % 11)) AS ser_id FROM b WHERE n % 2 = 0 GROUP BY n % 11),
al AS (SELECT id, string_agg(author_id::VARCHAR, ',' ORDER BY author_id) AS author_ids FROM a JOIN ai USING (name) GROUP BY id)
SELECT b.id, b.archive, b.entry, 'Book ' || word AS title, b.lang, md5, author_ids, genre_id, ser_id, CASE WHEN ser_id IS NOT NULL THEN n % 5 END AS ser_no, batch
FROM b JOIN al USING (id) JOIN gi USING (lang) LEFT JOIN si ON si.s = b.n % 11 AND b.n % 2 = 0""")
def ingested_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into an empty catalog: every other archive, then all of them, of which the ledger leaves the new ones."""
    path, store = shelved(spark, sf_dir), BatchStore(spark, new_path(spark, "catalog"))
    found = read_archives(spark, path)
    odd = F.regexp_extract("archive", r"shelf(\d+)\.zip$", 1).cast("long") % 2 == 1
    I.ingest(store, 0, found.where(~odd))
    I.ingest(store, 1, found)
    whole = store.whole()
    read = lambda name: store.read(name, taken=whole)
    authors = read("book_author").groupBy("book_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("author_id")), lambda i: i.cast("string"))).alias("author_ids"))
    links = authors.join(read("book_genre").drop("batch"), "book_id", "left").join(read("book_series").drop("batch"), "book_id", "left")
    books = read("book").select("id", F.regexp_extract("path", r"([^/]+)$", 1).alias("archive"), F.col("filename").alias("entry"), "title", "lang", "md5", "batch")
    return books.join(links, F.col("id") == F.col("book_id")).select("id", "archive", "entry", "title", "lang", "md5", "author_ids", "genre_id", "ser_id", F.col("ser_no").cast("long").alias("ser_no"), "batch")


@query(f"WITH {_SHELF} SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE md5(content) END AS md5, CASE WHEN doc_id % 50 = 7 THEN 'file not found in archive' END AS error FROM f WHERE doc_id % 5 = 2")
def fetched_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of five books by archive and name; some names are not there."""
    path = shelved(spark, sf_dir)
    wanted = shelf(spark, sf_dir).select("doc_id", F.concat(F.lit(path + "/"), "archive").alias("archive"), F.when(F.col("doc_id") % 50 == 7, F.concat("entry", F.lit(".gone"))).otherwise(F.col("entry")).alias("entry")).where("doc_id % 5 = 2")
    found = fetch_entries(wanted).select("archive", "entry", F.md5("content").alias("md5"), "error")
    return wanted.join(found, ["archive", "entry"]).select("doc_id", "md5", "error")


_TREE = rf"""c AS (
  SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{M._SKIPPED}', ' ', 'g'), '<[^<]*') AS p FROM pages
), r AS (
  SELECT page_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS seq FROM c
), t AS (
  SELECT page_id, seq, regexp_extract(raw, '{M._TAG}', ['shut', 'name', 'void']) AS g, regexp_replace(raw, '^</?[A-Za-z][^>]*>', ' ') AS text FROM r
), k AS (
  SELECT page_id, seq, lower(g.name) AS name, text, CASE WHEN lower(g.name) NOT IN ({", ".join(f"'{n}'" for n in M.HTML)}) OR g.void = '/' THEN 0 WHEN g.shut = '/' THEN -1 ELSE 1 END AS step FROM t
), w AS (
  SELECT *, (sum(step) OVER (PARTITION BY page_id ORDER BY seq))::BIGINT AS depth FROM k
), x AS (
  SELECT w.*, (SELECT max_by(o.name, o.seq) FROM w o WHERE o.page_id = w.page_id AND o.step = 1 AND o.seq < w.seq AND o.depth = w.depth + 1) AS shuts,
    (SELECT max(o.seq) FROM w o WHERE o.page_id = w.page_id AND o.step = 1 AND o.seq < w.seq AND o.depth = w.depth - 1) AS parent,
    (SELECT max(o.seq) FROM w o WHERE o.page_id = w.page_id AND o.step = 1 AND o.seq <= w.seq AND o.depth = w.depth) AS inner_node FROM w
), v AS (
  SELECT page_id, min(seq) FILTER (WHERE step = -1 AND (depth < 0 OR coalesce(shuts, '') <> name) OR step = 1 AND depth > {M.MAX_DEPTH}) AS bad,
    min_by(CASE WHEN step = -1 THEN 'unbalanced' ELSE 'too deep' END, seq) FILTER (WHERE step = -1 AND (depth < 0 OR coalesce(shuts, '') <> name) OR step = 1 AND depth > {M.MAX_DEPTH}) AS why, max_by(depth, seq) AS rest FROM x GROUP BY 1
), n AS (
  SELECT x.* FROM x JOIN v USING (page_id) WHERE bad IS NULL OR seq < bad
), o AS (
  SELECT page_id, inner_node AS node, trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '[\t\n\r ]+', ' ', 'g')) AS text FROM n WHERE depth > 0 GROUP BY 1, 2
)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.placed_tokens(M.tag_tokens(_read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), M.HTML))


@query(rf"WITH {_TREE} SELECT n.page_id, n.seq AS node, parent, n.depth, n.name, coalesce(o.text, '') AS text FROM n LEFT JOIN o ON o.page_id = n.page_id AND o.node = n.seq WHERE step = 1")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = M.tree_nodes(_placed(spark, sf_dir))
    return nodes.select(F.col("id").alias("page_id"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "depth", "name", "text")


@query(rf"WITH {_TREE} SELECT v.page_id, CASE WHEN bad IS NOT NULL THEN why WHEN rest > 0 THEN 'open' ELSE 'whole' END AS verdict, bad AS at, (SELECT count(*) FROM n WHERE n.page_id = v.page_id AND step = 1) AS elements FROM v")
def page_tree_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.tree_verdicts(_placed(spark, sf_dir))
    return found.select(F.col("id").alias("page_id"), "verdict", F.col("at").cast("long").alias("at"), "elements")


def _bytes(n: Column, size: int, little: bool = False) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]) if little else digits)


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), s AS (
  SELECT doc_id, doc_id % 11 = 5 AS cut, ['png', 'gif', 'jpeg', 'webp'][(doc_id % 4 + 1)::INT] AS kind, n * 7 % 6000 AS w, n * 13 % 5000 AS h FROM d
)
SELECT doc_id, kind, CASE WHEN NOT cut THEN w END AS width, CASE WHEN NOT cut THEN h END AS height,
  CASE WHEN cut OR w = 0 OR h = 0 THEN 'undecodable' WHEN w > 4096 OR h > 4096 OR w * h > 4194304 THEN 'too large' ELSE 'fine' END AS verdict FROM s""")
def image_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of images that the documents' lengths give their sizes; a JPEG has segments before its frame, some end early."""
    n, hexed = F.char_length("text"), F.unhex
    w, h = n * 7 % 6000, n * 13 % 5000
    note = F.encode(F.concat(F.sha2("text", 256), F.repeat(F.lit("\\u00ff\\u00c0"), (n % 500).cast("int"))), "UTF-8")
    segment = F.concat(hexed(F.lit("FFE1")), _bytes(F.octet_length(note) + 2, 2), note)
    segments = F.unhex(F.repeat(F.hex(segment), (F.col("doc_id") % 5).cast("int")))
    made = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(hexed(F.lit("89504E470D0A1A0A0000000D49484452")), _bytes(w, 4), _bytes(h, 4)))
        .when(F.col("doc_id") % 4 == 1, F.concat(hexed(F.lit("474946383961")), _bytes(w, 2, True), _bytes(h, 2, True)))
        .when(F.col("doc_id") % 4 == 2, F.concat(hexed(F.lit("FFD8")), segments, hexed(F.lit("FFC2000B08")), _bytes(h, 2), _bytes(w, 2)))
        .otherwise(F.concat(hexed(F.lit("52494646000000005745425056503820000000000000009D012A")), _bytes(w, 2, True), _bytes(h, 2, True)))
    )
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("made", made)
    data = F.when(F.col("doc_id") % 11 == 5, F.substring("made", F.lit(1), F.octet_length("made") - 1)).otherwise(F.col("made"))
    judged = judged_images(docs.select("doc_id", data.alias("data")))
    return judged.select("doc_id", "kind", F.col("size.width").alias("width"), F.col("size.height").alias("height"), "verdict")


@query()
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of four of five of them (by crc32 of doc_id), and what becomes of their tags."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = language.decided(docs, language.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "detected", "margin", F.col("decision.lang").alias("lang"), F.col("decision.method").alias("method"))
