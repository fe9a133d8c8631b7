"""Markup documents as block rows: samples, headings, anchors, size-bounded portions, images by kind and budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators.ranges import running_sum

#: How long a sample is, how large a portion, a lone block and a document may be.
SAMPLE_CHARS, PORTION_BYTES, LONE_BYTES, TOTAL_BYTES = 2000, 64 << 10, 1 << 20, 96 << 20

#: What follows the < of a block element's start or end tag.
_BLOCK = (
    r"/?(?:h[1-6]|p|li|title|address|article|aside|blockquote|body|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form"
    r"|head|header|hgroup|hr|html|legend|main|menu|nav|ol|optgroup|option|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)(?=[\s/>]|\z)"
)


def text_sample(annotation: Column, body: Column) -> Column:
    return F.substring(F.btrim(F.concat_ws(" ", annotation, body)), 1, SAMPLE_CHARS)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, seq, kind (title, header, p, li, text), anchor, text: all text of a page in order; scripts, styles and comments left out.

    A block ends at the next start or end of any block element, so tags that are left open lose nothing; text that
    follows the end of an element, or stands in one of another kind, is a block of kind text. A tag ends at its first >.
    """
    body = F.coalesce(html_col, F.lit(""))
    body = F.regexp_replace(body, r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style)(?=[\s/>])[^>]*(?:>|\z).*?(?:</\1(?=[\s/>])[^>]*(?:>|\z)|\z)", " ")
    body = F.regexp_replace(body, rf"(?i)<(?!{_BLOCK})(?:/?[a-z]|[!?/])[^>]*(?:>|\z)", " ")
    tag = lambda raw: F.lower(F.regexp_extract(raw, r"(?i)^<(h[1-6]|p|li|title)(?=[\s/>]|\z)", 1))
    block = lambda raw: F.struct(
        F.when(tag(raw) == "", "text").when(tag(raw).rlike("^h[1-6]$"), "header").otherwise(tag(raw)).alias("kind"),
        T.clean_anchor(F.regexp_extract(raw, r'(?is)^<[^/>][^>]*\bid="([^"]*)"', 1)).alias("anchor"),
        F.btrim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^</?[a-z][^>]*(?:>|\z)", " "), r"\s+", " ")).alias("text"),
    )
    found = F.filter(F.transform(F.split(body, rf"(?i)(?=<{_BLOCK})"), block), lambda b: b["text"] != "")
    return pages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("seq", "block")).select("id", "seq", "block.*")


def fb2_blocks(texts: DataFrame) -> DataFrame:
    """id, seq, kind (header, p, v, subtitle, text-author, tr), text, note_refs of the main bodies of repaired documents (id, text).

    Titles are headers, rows of tables are blocks; bodies with a name (notes) are left out, and links to them are listed
    with the block that cites them. A body or block that a truncated document leaves open ends with the text.
    """
    whole = F.regexp_replace(F.coalesce("text", F.lit("")), r"<[^>]*\z", "")
    body = F.array_join(F.regexp_extract_all(whole, F.lit(r"(?s)<body(?![^>]*name=)[^>]*>(.*?)(?:</body\s*>|\z)"), F.lit(1)), " ")
    found = F.regexp_extract_all(body, F.lit(r"(?s)(<title\b[^>]*>.*?(?:</title\s*>|\z)|<tr\b[^>]*>.*?(?:</tr\s*>|\z)|<(?:p|v|subtitle|text-author)\b[^>]*>.*?(?:</(?:p|v|subtitle|text-author)\s*>|\z))"), F.lit(1))
    rows = texts.select("id", F.posexplode(found).alias("seq", "raw"))
    tag = F.regexp_extract("raw", r"^<(title|p|v|subtitle|text-author|tr)\b", 1)
    return rows.select(
        "id",
        "seq",
        F.when(tag == "title", "header").otherwise(tag).alias("kind"),
        T.strip_tags(F.regexp_replace("raw", r"</?(?:b|i|strong|emphasis|a|sup|sub|style)\b[^>]*>", "")).alias("text"),
        F.array_distinct(F.regexp_extract_all("raw", F.lit(r'(?i)<a\b[^>]*href="#([^"]+)"[^>]*type="note"'), F.lit(1))).alias("note_refs"),
    ).where("text <> ''")


def assign_anchors(blocks: DataFrame) -> DataFrame:
    """The first block of a document that names an anchor owns it; all others get one of their own."""
    nth = F.row_number().over(Window.partitionBy("id", "anchor").orderBy("seq"))
    return blocks.withColumn("anchor", F.when((F.col("anchor") != "") & (nth == 1), F.col("anchor")).otherwise(F.concat(F.lit("!auto"), F.col("seq").cast("string"))))


def table_of_contents(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("kind") == "header") & (F.col("text") != "")).select("id", "seq", "anchor", F.col("text").alias("title"))


def pack_portions(blocks: DataFrame, portion_bytes: int = PORTION_BYTES, lone_bytes: int = LONE_BYTES) -> DataFrame:
    """id, seq, cost, charged, portion, error: blocks (id, seq, cost, notes array<struct<id, cost>>) greedily into portions in order.

    A block that does not fit goes to the next portion; one that fits none stands alone there. A note is charged once
    in each portion that cites it: charged is a block's cost with the notes that it is the first to cite. A block that
    is above lone_bytes with all its notes gives error `too large` instead of failing the job. Packing is sequential
    within a document, so a document is one group; documents are dealt over the cluster.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted by id and seq within the partition: a document may go on over batches
        now, portion, size, seen = object(), 0, 0, set()
        for b in batches:
            out, charged, alone = [], [], []
            for doc, notes, cost in zip(b["id"], b["notes"], b["cost"]):
                if doc != now:
                    now, portion, size, seen = doc, 0, 0, set()
                cited = {} if notes is None else {n["id"]: n["cost"] for n in notes}
                whole = cost + sum(cited.values())
                full = cost + sum(c for n, c in cited.items() if n not in seen)
                if size and size + full > portion_bytes:
                    portion, size, seen = portion + 1, 0, set()
                    full = whole
                size += full
                seen |= set(cited)
                out.append(portion)
                charged.append(full)
                alone.append(whole)
            yield pd.DataFrame({"id": b["id"], "seq": b["seq"], "cost": b["cost"], "charged": charged, "portion": out, "alone": alone})

    rows = blocks.select("id", "seq", F.col("cost").cast("long").alias("cost"), "notes").repartition("id").sortWithinPartitions("id", "seq")
    kinds = dict(rows.dtypes)
    packed = rows.mapInPandas(pack, f"id {kinds['id']}, seq {kinds['seq']}, cost long, charged long, portion int, alone long")
    return packed.withColumn("error", F.when(F.col("alone") > lone_bytes, "too large")).drop("alone")


def portion_sizes(packed: DataFrame, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """id, portions, bytes (as charged: with notes), too_large (above the ceiling for a document)."""
    return packed.groupBy("id").agg(F.countDistinct("portion").alias("portions"), F.sum("charged").alias("bytes")).withColumn("too_large", F.col("bytes") > total_bytes)


def image_kind(data: Column) -> Column:
    """jpeg, png, gif or webp by the first bytes of a binary column, else unknown."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png")
        .when(head.rlike("^47494638(37|39)61"), "gif")
        .when(head.rlike("^52494646.{8}57454250"), "webp")
        .otherwise("unknown")
    )


def within_budget(images: DataFrame, total_bytes: int) -> DataFrame:
    """images (id, name, size) in order of name: fits as long as the running total stays within the budget."""
    return running_sum(images, ["id"], ["name"], F.col("size").cast("long"), "_upto").withColumn("fits", F.col("_upto") <= total_bytes).drop("_upto")


def reachable_images(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """id, image: images of blocks and of the notes that blocks cite (blocks: id, note_refs, image_ids; notes: id, note, image_ids)."""
    own = blocks.select("id", F.explode("image_ids").alias("image"))
    cited = blocks.select("id", F.explode("note_refs").alias("note")).distinct()
    return own.unionByName(notes.join(cited, ["id", "note"], "left_semi").select("id", F.explode("image_ids").alias("image"))).distinct()


#: ISO codes by tag, for English names and for three-letter codes whose first two letters are not the
#: two-letter code. All other codes of two or three letters give their first two letters by rule.
LANGUAGES = {
    "afrikaans": "af", "arabic": "ar", "azerbaijani": "az", "belarusian": "be", "bulgarian": "bg", "bengali": "bn", "ben": "bn", "bosnian": "bs",
    "bos": "bs", "catalan": "ca", "czech": "cs", "ces": "cs", "cze": "cs", "welsh": "cy", "wel": "cy", "danish": "da", "german": "de", "ger": "de",
    "greek": "el", "ell": "el", "gre": "el", "english": "en", "esperanto": "eo", "spanish": "es", "spa": "es", "estonian": "et", "est": "et",
    "basque": "eu", "baq": "eu", "persian": "fa", "per": "fa", "finnish": "fi", "french": "fr", "irish": "ga", "gle": "ga", "gujarati": "gu",
    "hebrew": "he", "heb": "he", "hindi": "hi", "croatian": "hr", "hungarian": "hu", "armenian": "hy", "arm": "hy", "indonesian": "id", "ind": "id",
    "icelandic": "is", "ice": "is", "isl": "is", "italian": "it", "japanese": "ja", "georgian": "ka", "geo": "ka", "kat": "ka", "kazakh": "kk",
    "kaz": "kk", "korean": "ko", "latin": "la", "lithuanian": "lt", "latvian": "lv", "lav": "lv", "maori": "mi", "mao": "mi", "mri": "mi",
    "macedonian": "mk", "mac": "mk", "mongolian": "mn", "mon": "mn", "marathi": "mr", "mar": "mr", "malay": "ms", "may": "ms", "norwegian": "nb",
    "nob": "nb", "nor": "nb", "no": "nb", "dutch": "nl", "dut": "nl", "nno": "nn", "punjabi": "pa", "polish": "pl", "pol": "pl", "portuguese": "pt",
    "por": "pt", "romanian": "ro", "rum": "ro", "russian": "ru", "slovak": "sk", "slo": "sk", "slovenian": "sl", "slovene": "sl", "slv": "sl",
    "somali": "so", "albanian": "sq", "alb": "sq", "serbian": "sr", "srp": "sr", "swedish": "sv", "swe": "sv", "swahili": "sw", "tamil": "ta",
    "telugu": "te", "thai": "th", "tagalog": "tl", "tgl": "tl", "turkish": "tr", "tur": "tr", "ukrainian": "uk", "urdu": "ur", "vietnamese": "vi",
    "chinese": "zh", "chi": "zh", "zho": "zh",
}


def standard_language(c: Column, table: dict[str, str] | None = None) -> Column:
    """A tag as a two-letter code: by the table, else the first two bytes of a tag of two or three, else unknown; '' stays."""
    low = F.lower(F.btrim(c))
    known = F.create_map(*[F.lit(x) for pair in (table or LANGUAGES).items() for x in pair])
    short = F.octet_length(low).between(2, 3) & low.rlike("^[\\x00-\\x7F]*$")
    return F.when(low == "", "").otherwise(F.coalesce(F.element_at(known, low), F.when(short, F.substring(low, 1, 2)), F.lit("unknown")))


def language_decision(tag: Column, sample: Column, detected: Column) -> Column:
    """struct<lang, method>: too little text keeps the tag; agreement is a tag match; else what was detected."""
    std = standard_language(tag)
    few = F.char_length(F.coalesce(sample, F.lit(""))) < 20
    made = lambda lang, how: F.struct(lang.alias("lang"), F.lit(how).alias("method"))
    return F.when(few, made(std, "tag_fallback")).when(std == detected, made(std, "tag_match")).otherwise(made(detected, "detected"))

