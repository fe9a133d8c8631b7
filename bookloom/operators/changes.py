"""Writes as new tables: upserts, replacements, get-or-create, cascades, patches and the archive ledger.

A table is never changed in place. Each function gives the table as it is afterwards; sources/batches.py publishes
tables as a batch that readers see whole or not at all.
"""

from __future__ import annotations

from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions.joins import spread_join
from bookloom.functions.storage import file_system
from bookloom.operators.ranges import running_sum


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], latest: list[Column] | None = None) -> DataFrame:
    """Rows replace those with the same keys; of several new ones the first in the order of latest counts."""
    if latest:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))).where("_n = 1").drop("_n")
    return table.join(rows.select(*keys), _on(table, rows, keys), "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not there yet are added, once each."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), _on(rows, table, keys), "left_anti"))


def one_each(rows: DataFrame, keys: list[str], latest: list[str] | None = None) -> DataFrame:
    """One row for each key: the largest by the columns of latest, then by all others in their order. Nulls are least."""
    first = [c for c in latest or [] if c not in keys]
    rest = [*first, *(c for c in rows.columns if c not in keys and c not in first)]
    if not rest:
        return rows.distinct()
    found = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("one"))
    return found.select(*[F.col(c) if c in keys else F.col("one")[c].alias(c) for c in rows.columns])


def new_members(dim: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """id, name of the names that dim (id, name) lacks, numbered in order of name after the highest id.

    Ids are running counts over ranges of names, so they depend on the names alone, not on how partitions are dealt.
    """
    new = names.select(name_col).where(F.col(name_col).isNotNull()).distinct().join(dim.select(name_col), name_col, "left_anti")
    nth = running_sum(new, [], [name_col], F.lit(1).cast("long"), "nth", sample=names)
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return nth.join(top, F.lit(True)).select((F.col("top") + F.col("nth")).cast("long").alias("id"), name_col)


def get_or_create(dim: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """dim (id, name) with its new_members()."""
    return dim.select("id", name_col).unionByName(new_members(dim, names, name_col))


def exists_any(rows: DataFrame, keys: DataFrame, on: list[str], out: str = "exists") -> DataFrame:
    """keys with whether rows has any row of that key, each key once; null keys equal null keys."""
    there = rows.select(*on).distinct().withColumn(out, F.lit(True))
    asked = keys.select(*on).distinct()
    return asked.join(there, _on(asked, there, on), "left").select(*[asked[c] for c in on], F.coalesce(out, F.lit(False)).alias(out))


def replace_children(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in rows go, and rows take their place."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def set_links(links: DataFrame, changes: DataFrame, dim: DataFrame, link_id: str, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """links (book_id, link_id, extra) with those of the changed books replaced, and the members that dim (id, name) lacks.

    changes: book_id, entries array<struct<id, name, extra>>; null entries leave a book's links alone, empty ones take
    them away. An entry names a member by its id; one without an id (null or 0), or with one that dim lacks, by its
    trimmed name, which is created if dim lacks it. Entries without either are nothing. Within a book, entries without
    an id count once for each name whatever its case, and links once for each member: the first counts. Of several
    changes for a book the one with the largest entries counts.
    """
    extra = extra or []
    one = changes.where("entries IS NOT NULL").groupBy("book_id").agg(F.max("entries").alias("entries"))
    rows = one.select("book_id", F.posexplode("entries").alias("pos", "e"))
    rows = rows.select("book_id", "pos", F.nullif(F.col("e")["id"].cast("long"), F.lit(0)).alias("given"), F.nullif(F.btrim(F.col("e")["name"]), F.lit("")).alias("name"), *[F.col("e")[c].alias(c) for c in extra])
    ids = dim.select(F.col("id").alias("given"), F.lit(True).alias("there"))
    rows = spread_join(rows, ids, ["given"], ["book_id", "pos"], "left")
    by_id = rows.where("there").withColumn("member", F.col("given"))
    nth = F.row_number().over(Window.partitionBy("book_id", "given", F.lower("name")).orderBy("pos"))
    by_name = rows.where("there IS NULL AND name IS NOT NULL").withColumn("nth", nth).where("nth = 1 OR given IS NOT NULL").drop("nth")
    new = new_members(dim.select("id", "name"), by_name)
    names = dim.select("name", F.col("id").alias("member")).unionByName(new.select("name", F.col("id").alias("member"))).groupBy("name").agg(F.min("member").alias("member"))
    named = spread_join(by_name, names, ["name"], ["book_id", "pos"])
    first = by_id.unionByName(named).groupBy("book_id", F.col("member").alias(link_id)).agg(F.min(F.struct("pos", *extra)).alias("first"))
    added = first.select("book_id", link_id, *[F.col("first")[c].alias(c) for c in extra])
    kept = links.join(one.select("book_id"), "book_id", "left_anti").select("book_id", link_id, *extra)
    return kept.unionByName(added), new


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, parents: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows whose parent column (by table name) is among the ids of gone."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    return {n: t.join(ids, t[parents[n]] == ids["_gone"], "left_anti") if n in parents else t for n, t in tables.items()}


def toggle_favorite(favorites: DataFrame, user_id: int, book_id: int, on: bool, new_id: int | None = None) -> DataFrame:
    """The favorite is added (an error if it is there) or taken away."""
    same = (F.col("user_id") == user_id) & (F.col("book_id") == book_id)
    if not on:
        return favorites.where(~same)
    if not favorites.where(same).isEmpty():
        raise ValueError("already a favorite")
    row = favorites.sparkSession.range(1).select(F.lit(new_id).cast("long").alias("id"), F.lit(user_id).cast("long").alias("user_id"), F.lit(book_id).cast("long").alias("book_id"))
    return favorites.unionByName(row)


def patch(table: DataFrame, changes: DataFrame, fields: list[str], key: str = "id", latest: list[str] | None = None) -> DataFrame:
    """Fields that a change names (not null) replace the table's; rows without a change stay as they are.

    Of several changes for a key the largest by latest counts, then by fields: one of them as a whole, not a mixture.
    """
    own = one_each(changes.select(key, *dict.fromkeys([*(latest or []), *fields])), [key], latest).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = table.join(own, table[key] == own["_key"], "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


#: Fields of a rescan in the order in which differences are listed.
DIFF_FIELDS = ["title", "annotation", "lang", "docdate", "authors", "series", "cover"]


def diff_fields(old: str = "old", new: str = "new") -> Column:
    """Names of the fields that differ between two structs; authors by their names in order, series by title and index."""
    a, b = F.col(old), F.col(new)
    name = lambda c: F.transform(c["authors"], lambda x: x["name"])
    same = {c: a[c].eqNullSafe(b[c]) for c in DIFF_FIELDS}
    same["authors"] = name(a).eqNullSafe(name(b))
    return F.array_compact(F.array(*[F.when(~same[c], F.lit(c)) for c in DIFF_FIELDS]))


def apply_selected(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows (id, old, new, flags): new values where the flag is true or null, else the old ones."""
    pick = [F.when(F.coalesce(F.col("flags")[c], F.lit(True)), F.col("new")[c]).otherwise(F.col("old")[c]).alias(c) for c in fields]
    return rows.select("id", *pick)


def unscanned(on_disk: DataFrame, ledger: DataFrame) -> DataFrame:
    """Archives on disk that the ledger does not hold as scanned: cat_name."""
    return on_disk.select("cat_name").distinct().join(ledger.where("is_scanned").select("cat_name"), "cat_name", "left_anti")


def mark_scanned(ledger: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports (cat_name, books_count, errors_count, scanned_at) become ledger rows."""
    rows = reports.select("cat_name", F.lit(True).alias("is_scanned"), "scanned_at", "books_count", "errors_count")
    return upsert(ledger.select("cat_name", "is_scanned", "scanned_at", "books_count", "errors_count"), rows, ["cat_name"], [F.desc("scanned_at")])


def mark_unscanned(ledger: DataFrame, names: list[str]) -> DataFrame:
    again = F.col("cat_name").isin(names)
    return ledger.withColumn("scanned_at", F.when(~again, F.col("scanned_at"))).withColumn("is_scanned", F.col("is_scanned") & ~again)


def catalog_stats(ledger: DataFrame) -> DataFrame:
    scanned = F.count_if(F.coalesce("is_scanned", F.lit(False)))
    none = F.lit(0).cast("long")
    return ledger.agg(
        F.count("*").alias("total_catalogs"),
        scanned.alias("scanned_catalogs"),
        (F.count("*") - scanned).alias("unscanned_catalogs"),
        F.coalesce(F.sum("books_count"), none).alias("total_books"),
        F.coalesce(F.sum("errors_count"), none).alias("total_errors"),
    )


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(0).cast("int")


def latest_jobs(log: DataFrame) -> DataFrame:
    """An append-only job log (job_id, at, ...) down to the latest row of each job."""
    rest = [c for c in log.columns if c != "job_id"]
    latest = log.groupBy("job_id").agg(F.max_by(F.struct(*rest), "at").alias("s"))
    return latest.select("job_id", *[F.col("s")[c].alias(c) for c in rest])


def resolve_items(items: DataFrame, chosen: DataFrame, latest: list[str] | None = None) -> DataFrame:
    """Items with a chosen book become manual with score 1; of several choices the largest by latest counts, then by book_id."""
    pick = one_each(chosen.select("item_id", *(latest or []), "book_id"), ["item_id"], latest).select(F.col("item_id").alias("_id"), F.col("book_id").alias("_book"))
    joined = items.join(pick, items["id"] == pick["_id"], "left")
    hit = F.col("_id").isNotNull()
    new = {"book_id": F.col("_book"), "match_status": F.lit("manual"), "match_score": F.lit(1.0).cast("float")}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])


def ignore_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items whose id is among ids become ignored; their book stays."""
    own = ids.select(F.col("id").alias("_id")).distinct()
    joined = items.join(own, items["id"] == own["_id"], "left")
    return joined.select(*[F.when(F.col("_id").isNotNull(), F.lit("ignored")).otherwise(F.col(c)).alias(c) if c == "match_status" else F.col(c) for c in items.columns])


def rewrite_items(items: DataFrame, again: DataFrame) -> DataFrame:
    """Items that a second try found (again: item_id, status, book_id, score, extra) take its status, score and extra, and its book if it names one.

    Of several tries for an item the one with the highest score counts, then by book_id, status and extra.
    """
    new = one_each(again.select("item_id", "score", "book_id", "status", "extra"), ["item_id"]).select(F.struct("item_id", "status", "book_id", F.col("score").cast("float").alias("score"), "extra").alias("_n"))
    joined = items.join(new, items["id"] == F.col("_n.item_id"), "left")
    hit = F.col("_n").isNotNull()
    each = {"match_status": F.col("_n.status"), "match_score": F.col("_n.score"), "external_extra": F.col("_n.extra"), "book_id": F.coalesce("_n.book_id", "book_id")}
    return joined.select(*[F.when(hit, each[c]).otherwise(F.col(c)).alias(c) if c in each else F.col(c) for c in items.columns])


def finish_import(collections: DataFrame, collection_id: int, stats: DataFrame, status: str, error: str = "", now=None) -> DataFrame:
    """The collection takes the status, the error, the one row of stats as JSON, and the time; others stay."""
    one = stats.select(F.to_json(F.struct("*")).alias("_stats"))
    hit = F.col("id") == collection_id
    new = {"import_status": F.lit(status), "import_error": F.lit(error), "import_stats": F.col("_stats"), "imported_at": F.current_timestamp() if now is None else F.lit(now)}
    return collections.join(one, F.lit(True), "left").select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in collections.columns])


def delete_user(tables: dict[str, DataFrame], user_id: int) -> dict[str, DataFrame]:
    """Tables (collection, collection_book, vote, favorite, user) without a user and what is theirs.

    Their collections go with the books and all votes on them, then their own votes and favorites. Curated collections
    belong to nobody (user_id is null) and stay.
    """
    out, own = dict(tables), tables["collection"].where(F.col("user_id") == user_id).select(F.col("id").alias("_own"))
    others = lambda t: F.coalesce(t["user_id"] != user_id, F.lit(True))
    out["vote"] = tables["vote"].join(own, tables["vote"]["collection_id"] == F.col("_own"), "left_anti").where(others(tables["vote"]))
    out["collection_book"] = tables["collection_book"].join(own, F.col("book_collection_id") == F.col("_own"), "left_anti")
    out["collection"] = tables["collection"].where(others(tables["collection"]))
    out["favorite"] = tables["favorite"].where(others(tables["favorite"]))
    out["user"] = tables["user"].where(F.col("id") != user_id)
    return out


def reattach(rows: DataFrame, users: DataFrame, column: str, to: int | None) -> DataFrame:
    """Rows whose user is not there any more go to another one, or to nobody; rows without a user stay as they are."""
    there = users.select(F.col("id").alias("_user")).distinct()
    joined = rows.join(there, rows[column] == there["_user"], "left")
    lost = F.col(column).isNotNull() & F.col("_user").isNull()
    kind = rows.schema[column].dataType
    return joined.select(*[F.when(lost, F.lit(to).cast(kind)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def export_tables(tables: dict[str, DataFrame], allowed: list[str], path: str) -> list[str]:
    """Write the allowed tables under path, each in a folder of its name; an unknown name is an error, and so is anything else that lies there afterwards."""
    unknown = sorted(set(allowed) - set(tables))
    if unknown:
        raise ValueError(f"no such tables: {', '.join(unknown)}")
    for name in sorted(allowed):
        tables[name].write.mode("errorifexists").parquet(f"{path}/{name}")
    leaked = sorted(set(exported(path)) - set(allowed))
    if leaked:
        raise ValueError(f"tables that are not allowed lie in the export: {', '.join(leaked)}")
    return sorted(allowed)


def exported(path: str) -> list[str]:
    """Names of whatever lies in an export, hidden files left out."""
    fs, folder = file_system(path)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
    return sorted(n for n in names if not n.startswith((".", "_")))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON row per row of a report."""
    report.coalesce(1).write.mode("overwrite").json(path)

