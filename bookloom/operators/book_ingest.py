"""From archive entries to a catalog, in one call: books, authors, genres, series, links, covers, errors and the ledger as one batch.

Entries are decoded, repaired and parsed once and staged; every table of the batch comes from what is staged, and the
batch is published whole or not at all (BatchStore). Tables hold what a batch adds: names that the catalog has keep
their ids, new ones get the next in order of name, books the next in order of archive and entry. So the same entries
give the same batch, and a batch that is tried again after a failure gives what the first try would have given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.joins import spread_join
from bookloom.functions.records import cover_path
from bookloom.functions.storage import file_system, small_batches, written
from bookloom.operators.changes import new_members
from bookloom.operators.ingest import decoded, parse_metadata, repair_markup
from bookloom.operators.ranges import running_sum
from bookloom.sources.batches import BatchStore

BOOK = "id long, path string, filename string, format string, registerdate timestamp, docdate string, lang string, title string, annotation string, cover boolean, approved boolean, duplicate_hidden boolean, md5 string"
NAMED = "id long, name string"
LEDGER = "cat_name string, is_scanned boolean, scanned_at timestamp, books_count long, errors_count long"
#: What the catalog calls a book whose bytes it has.
DUPLICATE = "duplicate"


def with_cover(texts: DataFrame) -> DataFrame:
    """texts (fixed: repaired) with cover_type and cover_data (binary) of the image that the cover page names; null where there is none or it is no base64."""
    name = F.regexp_extract("fixed", r'(?s)<coverpage\b.{0,2000}?<image\b[^>]*?href\s*=\s*["\']#([^"\']+)["\']', 1)
    rows = texts.withColumn("image", F.replace(name, F.lit("\\E"), F.lit("")))
    found = F.expr(r"""regexp_extract(fixed, concat('(?s)(<binary\\b[^>]*\\bid\\s*=\\s*["\']\\Q', image, '\\E["\'][^>]*>.*?)</binary'), 1)""")
    rows = rows.withColumn("binary", F.when(F.col("image") != "", found))
    kind = F.regexp_extract("binary", r'^<binary\b[^>]*?content-type\s*=\s*["\']([^"\']+)', 1)
    data = F.try_to_binary(F.nullif(F.regexp_replace("binary", r"^<[^>]*>|\s+", ""), F.lit("")), F.lit("base64"))
    return rows.withColumn("cover_type", F.nullif(kind, F.lit(""))).withColumn("cover_data", data).drop("image", "binary")


def numbered(parsed: DataFrame, books: DataFrame, skip_duplicates: bool) -> DataFrame:
    """parsed with book_id for the entries that become books (else null) and error: why not, if not."""
    bad = F.when(F.size("issues") > 0, F.get("issues", F.lit(0)))
    fine = parsed.where(bad.isNull())
    if skip_duplicates:
        first = fine.groupBy("md5").agg(F.min(F.struct("archive", "entry", "nth_name")).alias("w")).select("md5", "w.*")
        first = first.join(books.select("md5"), "md5", "left_anti")
        fine = fine.join(first, ["md5", "archive", "entry", "nth_name"], "left_semi")
    top = books.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    keys = fine.select("archive", "entry", "nth_name")
    ids = running_sum(keys, [], ["archive", "entry", "nth_name"], F.lit(1).cast("long"), "nth").join(top, F.lit(True))
    ids = ids.select("archive", "entry", "nth_name", (F.col("top") + F.col("nth")).alias("book_id"))
    joined = parsed.join(ids, ["archive", "entry", "nth_name"], "left")
    return joined.withColumn("error", F.coalesce(bad, F.when(F.col("book_id").isNull(), DUPLICATE)))


def batch_tables(store: BatchStore, batch: int, entries: DataFrame, staging: str, now: Column, skip_duplicates: bool, language: Callable[[Column, Column], Column] | None) -> dict[str, DataFrame]:
    """The tables that the entries add to what the batches before this one hold."""
    stage = lambda df, name: written(df, f"{staging}/{name}")
    earlier = stage(store.whole().where(F.col("batch") < batch), "earlier")
    had = lambda name, schema: store.read(name, schema, taken=earlier).drop("batch")
    scanned = had("ledger", LEDGER).where("is_scanned").select(F.col("cat_name").alias("archive")).distinct()
    fresh = entries.select("archive", "entry", "content", "error").join(scanned, "archive", "left_anti")
    # archives may hold a name twice: copies of a name are told apart by their bytes
    texts = decoded(fresh).withColumn("fixed", repair_markup(F.coalesce("text", F.lit(""))))
    texts = with_cover(texts).withColumn("nth_name", F.coalesce("md5", F.lit("")))
    read = stage(parse_metadata(texts).dropDuplicates(["archive", "entry", "nth_name"]), "read")
    opened = read.where("entry IS NOT NULL")
    books = had("book", BOOK)
    found = stage(numbered(opened, books, skip_duplicates), "found")
    new = found.where("book_id IS NOT NULL")
    lang = F.coalesce("lang", F.lit(""))
    tables = {
        "book": new.select(
            F.col("book_id").alias("id"), F.col("archive").alias("path"), F.col("entry").alias("filename"), F.lit("fb2").alias("format"), now.alias("registerdate"), "docdate",
            (language(lang, F.col("body_sample")) if language else lang).alias("lang"), "title", "annotation", F.col("cover_data").isNotNull().alias("cover"), F.lit(True).alias("approved"), F.lit(False).alias("duplicate_hidden"), "md5",
        ),
        "cover": new.where("cover_data IS NOT NULL").select("book_id", cover_path(F.col("archive"), F.col("entry")).alias("path"), F.col("cover_type").alias("content_type"), F.col("cover_data").alias("data")),
        "scan_error": read.join(found.select("archive", "entry", "nth_name", F.col("error").alias("why")), ["archive", "entry", "nth_name"], "left")
        .select("archive", "entry", F.when(F.col("entry").isNull(), F.coalesce("error", F.lit("unreadable archive"))).otherwise(F.col("why")).alias("error")).where("error IS NOT NULL"),
        "ledger": found.groupBy(F.col("archive").alias("cat_name")).agg(
            F.lit(True).alias("is_scanned"), F.first(now).alias("scanned_at"), F.count("book_id").alias("books_count"), F.count_if(F.col("error").isNotNull() & (F.col("error") != DUPLICATE)).alias("errors_count")
        ),
    }
    named = {
        "author": new.select("book_id", F.explode(F.array_distinct("authors")).alias("name")),
        "genre": new.select("book_id", F.explode(F.array_distinct("genres")).alias("name")).where("name <> ''"),
        "series": new.where("series <> ''").select("book_id", F.col("series").alias("name"), "ser_no"),
    }
    for name, links in named.items():
        dim = had(name, NAMED)
        tables[name] = stage(new_members(dim, links), name)
        every = dim.unionByName(tables[name])
        link_id = "ser_id" if name == "series" else f"{name}_id"
        tables[f"book_{name}"] = spread_join(links, every, ["name"], ["book_id"]).select("book_id", F.col("id").alias(link_id), *(["ser_no"] if name == "series" else []))
    return tables


def ingest(store: BatchStore, batch: int, entries: DataFrame, now: Column | None = None, skip_duplicates: bool = True, language: Callable[[Column, Column], Column] | None = None) -> bool:
    """Publish entries (archive, entry, content, error) as that batch of the catalog; False where the batch is there.

    Archives that the ledger has as scanned are left out. Entries that cannot be read or lack a title, and with
    skip_duplicates those whose bytes the catalog or an earlier entry has, become no books; all but the duplicates are
    counted as errors. An archive that cannot be opened is listed as an error and stays unscanned. language gives a
    book's language from its tag and a sample of its text.
    """
    staging = f"{store.path}/staging/{batch}-{uuid.uuid4().hex}"
    try:
        return store.commit(batch, lambda: batch_tables(store, batch, entries, staging, F.current_timestamp() if now is None else now, skip_duplicates, language))
    finally:
        fs, where = store._fs(staging)
        fs.delete(where, True)


def write_covers(covers: DataFrame, base: str) -> DataFrame:
    """Write each data of covers (path, data) to base/path, whole or not at all; gives path, bytes, once run.

    Paths that would leave base are not written: bytes is null. Of several rows with one path the longest data counts.
    """
    small_batches(covers.sparkSession)
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(base)
        for b in batches:
            out = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                inside = path and data is not None and not path.startswith(("/", "\\")) and ".." not in path.replace("\\", "/").split("/")
                if inside:
                    final = f"{folder}/{path}"
                    fs.create_dir(final.rpartition("/")[0], recursive=True)
                    part = f"{final}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, final)
                out.append({"path": path, "bytes": len(data) if inside else None})
            yield pa.RecordBatch.from_pylist(out, schema)

    one = covers.groupBy("path").agg(F.max_by("data", F.struct(F.length("data"), "data")).alias("data"))
    return one.mapInArrow(run, "path string, bytes long")
