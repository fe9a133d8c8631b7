"""From archive entries to catalog rows: text encoding, markup repair, metadata, child tables.

Decoding is a small Python helper over bytes; repair and parsing are column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.functions.storage import small_batches

#: How many damaged bytes a text may have, code pages by label, and the name for books without an author.
MAX_DAMAGED = 64
CODE_PAGES = {
    "windows-1251": "cp1251", "cp1251": "cp1251", "cp-1251": "cp1251", "koi8-r": "koi8_r", "koi8r": "koi8_r",
    "iso-8859-5": "iso8859_5", "iso8859-5": "iso8859_5", "iso-8859-1": "latin_1", "iso8859-1": "latin_1", "latin1": "latin_1",
}
UNKNOWN_AUTHOR = "Автор неизвестен"
_DECLARED = re.compile(rb"""\s*<\?xml[\s][^>]*?encoding\s*=\s*["']\s*([A-Za-z0-9._-]+)""", re.I)


def decode_text(data: bytes | None) -> tuple[str | None, str | None]:
    """Text and error of a document's bytes: marks first, then valid UTF-8, then what the declaration says."""
    if data is None:
        return None, "no content"
    if data[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff"):
        return None, "unsupported charset: utf-32"
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[2:].decode(name, "replace"), None
    if data.startswith((b"<\0?\0", b"\0<\0?")):
        return None, "unsupported charset: utf-16 without a byte order mark"
    marked = data.startswith(b"\xef\xbb\xbf")
    body = data[3:] if marked else data
    try:
        return body.decode("utf-8"), None
    except UnicodeDecodeError:
        pass
    found = _DECLARED.match(body)
    label = "utf-8" if marked else found[1].decode("ascii").lower() if found else ""
    if label in ("utf-8", "utf8"):
        text = body.decode("utf-8", "surrogateescape")
        damaged = sum("\udc80" <= c <= "\udcff" for c in text)
        return (None, "damaged content") if damaged > MAX_DAMAGED else (re.sub("[\udc80-\udcff]+", "\ufffd", text), None)
    if label in CODE_PAGES:
        return body.decode(CODE_PAGES[label], "replace"), None
    return None, "undeclared charset" if not label else f"unsupported charset: {label}"


def decoded(entries: DataFrame, content: str = "content") -> DataFrame:
    """entries with text and error (that of the source stays if there is one) in place of the content."""
    small_batches(entries.sparkSession)

    @F.pandas_udf("struct<text:string,error:string>")
    def decode(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_text(None if x is None else bytes(x)) for x in c], columns=["text", "error"])

    rows = entries.withColumn("_d", decode(F.col(content)))
    error = F.coalesce("error", F.col("_d.error")) if "error" in entries.columns else F.col("_d.error")
    keep = [c for c in entries.columns if c not in (content, "error")]
    return rows.select(*keep, F.md5(content).alias("md5"), F.col("_d.text").alias("text"), error.alias("error"))


#: The repairs in their order, as pattern and replacement. Control characters; stray < and processing
#: instructions; stray &; the version; self-closing tags, end tags and the language tag that lack their >; links.
REPAIRS = [
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "),
    (r"<(?![A-Za-z/?!_])", "&lt;"),
    (r"(?<!^)<\?|^<\?(?!(?i:xml))", "&lt;?"),
    (r"&(?!(?:amp|lt|gt|quot|apos|#[xX][0-9A-Fa-f]+|#[0-9]+);)", "&amp;"),
    (r"(?s)^(<\?xml[^>]{0,180}?version=[\"'])(?!1\.0)[^\"'>]*", "$1" + "1.0"),
    (r"(<(?:image|empty-line|br|img)\b[^<>]*|<[A-Za-z_][^<>/]*\s[\w:.-]+\s*=[^<>]*)/\s*(?=<)", "$1/>"),
    (r"(</[A-Za-z][\w:.-]*)(?=[^\w:.>-])", "$1>"),
    (r"<lang([^<>]*)(?=</lang>)", "<lang>$1"),
    (r"(<image\b[^>]*\s)href=", "$1xlink:href="),
]


def repair_markup(c: Column) -> Column:
    for pattern, new in REPAIRS:
        c = F.regexp_replace(c, pattern, new)
    # links with the prefix l in a document that declares only xlink
    known = F.contains(c, F.lit("xmlns:xlink")) & ~F.contains(c, F.lit("xmlns:l"))
    return F.when(known, F.replace(c, F.lit(' l:href="'), F.lit(' xlink:href="'))).otherwise(c)


_DESCRIPTION = """`title-info` struct<genre: array<string>, author: array<struct<`first-name`: string, `middle-name`: string, `last-name`: string>>,
`book-title`: string, annotation: string, date: string, lang: string, sequence: array<struct<_name: string, _number: string>>>"""


def parse_metadata(texts: DataFrame) -> DataFrame:
    """texts with title, authors, genres, series, ser_no, lang, docdate, annotation, body_sample and issues.

    The description alone is parsed; what does not parse gives nulls and an issue, never a failed job. Where texts has a
    column fixed, it is the repaired text; it goes. Each step is a column of its own, so none is worked out twice.
    """
    rows = texts if "fixed" in texts.columns else texts.withColumn("fixed", repair_markup(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_part", F.regexp_extract("fixed", r"(?s)(<description\b.*?</description\s*>)", 1))
    plain = F.regexp_replace(F.regexp_replace("_part", r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"\bxlink:href=", "href=")
    slim = F.regexp_replace(plain, r"(?s)<annotation\b.*?</annotation\s*>|<document-info\b.*?</document-info\s*>|<publish-info\b.*?</publish-info\s*>", "")
    rows = rows.withColumn("_annotation", T.strip_tags(F.regexp_extract("_part", r"(?s)<annotation\b[^>]*>(.*?)</annotation\s*>", 1)))
    rows = rows.withColumn("_body", T.strip_tags(F.regexp_extract("fixed", r"(?s)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)))
    rows = rows.withColumn("_xml", F.from_xml(F.when(F.col("_part") != "", slim), _DESCRIPTION, {"rowTag": "description"}))
    info = F.col("_xml")["title-info"]
    name = lambda a: F.btrim(F.regexp_replace(T.repair_case(F.concat_ws(" ", a["last-name"], a["first-name"])), r"\s+", " "))
    authors = F.filter(F.transform(F.coalesce(info["author"], F.array()), name), lambda x: x != "")
    first = F.get(info["sequence"], F.lit(0))
    title = T.clean_title(F.coalesce(info["book-title"], F.lit("")))
    return rows.select(
        *[c for c in texts.columns if c not in ("text", "fixed")],
        F.nullif(title, F.lit("")).alias("title"),
        F.when(F.size(authors) > 0, authors).otherwise(F.array(F.lit(UNKNOWN_AUTHOR))).alias("authors"),
        F.coalesce(info["genre"], F.array().cast("array<string>")).alias("genres"),
        first["_name"].alias("series"),
        T.leading_int(F.coalesce(first["_number"], F.lit(""))).alias("ser_no"),
        F.btrim(info["lang"]).alias("lang"),
        F.btrim(info["date"]).alias("docdate"),
        F.col("_annotation").alias("annotation"),
        F.substring(F.btrim(F.concat_ws(" ", "_annotation", "_body")), 1, 2000).alias("body_sample"),
        F.array_compact(
            F.array(F.when(F.col("error").isNotNull(), F.col("error")), F.when(~F.col("text").rlike("<FictionBook"), "no root"), F.when(info.isNull(), "no description"), F.when(title == "", "no title"))
        ).alias("issues"),
    )


def child_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """book, book_author, book_genre and book_series rows by (archive, entry); names are resolved by get_or_create."""
    key = ["archive", "entry"]
    return {
        "book": parsed.select(*key, "md5", "title", "lang", "docdate", "annotation"),
        "book_author": parsed.select(*key, F.explode(F.array_distinct("authors")).alias("name")),
        "book_genre": parsed.select(*key, F.explode(F.array_distinct("genres")).alias("name")),
        "book_series": parsed.where("series IS NOT NULL").select(*key, F.col("series").alias("name"), "ser_no"),
    }


def archive_reports(parsed: DataFrame) -> DataFrame:
    """cat_name, books_count, errors_count per archive, for the ledger."""
    bad = F.array_size("issues") > 0
    return parsed.groupBy(F.col("archive").alias("cat_name")).agg(F.count_if(~bad).alias("books_count"), F.count_if(bad).alias("errors_count"))
