"""Markup as a tree in rows: brackets are matched by running depths in windows, not by a parser's stack.

A document is cut at its tags. Tags of the elements that hold others (containers) raise or lower the depth; all other
tags are marks within the text of the element that is open there. An element's parent is the last element one level
higher that was opened before it, and so on up its path; with a bounded depth each level is one column of one window.
A window holds one document; documents are dealt over the cluster.

A document is read up to the first tag that cannot be: an end tag that is not that of the innermost open element
(`unbalanced`), an element below the greatest depth (`too deep`), one more element than allowed (`too many`), or one
more binary than allowed (`too many binaries`); whichever comes first decides. Elements that the end of the text leaves
open end there (`open`). Nothing is guessed: what was read before stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How deep elements may be nested and how many elements and binaries a document may have.
MAX_DEPTH, MAX_NODES, MAX_BINARIES = 32, 2_000_000, 10_000

HTML = ["html", "head", "body", "title", "header", "footer", "nav", "main", "article", "section", "aside", "div", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "blockquote", "figure", "h1", "h2", "h3", "h4", "h5", "h6"]
FB2 = ["fictionbook", "description", "body", "section", "title", "epigraph", "annotation", "cite", "poem", "stanza", "p", "v", "subtitle", "text-author", "table", "tr", "td", "th", "binary"]
_SKIPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>"
_TAG = r"^<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*?(/?)>"


def tag_tokens(texts: DataFrame, containers: list[str], text_col: str = "text") -> DataFrame:
    """id, seq, name, step (1: opens, -1: closes, 0: neither), anchor, label, text behind the tag; what precedes the first tag is left out."""
    pieces = F.regexp_extract_all(F.regexp_replace(F.coalesce(text_col, F.lit("")), _SKIPPED, " "), F.lit("<[^<]*"), F.lit(0))
    rows = texts.select("id", F.posexplode(pieces).alias("seq", "raw"))
    part = lambda k: F.regexp_extract("raw", _TAG, k)
    attribute = lambda a: F.nullif(F.regexp_extract("raw", rf'^<[^>]*\s{a}\s*=\s*"([^"]*)"', 1), F.lit(""))
    rows = rows.withColumn("name", F.lower(part(2))).withColumn("holds", F.col("name").isin(containers))
    step = F.when(~F.col("holds") | (part(3) == "/"), 0).when(part(1) == "/", -1).otherwise(1)
    opens = step == 1
    return rows.select(
        "id", "seq", "name", step.alias("step"), F.when(opens, attribute("id")).alias("anchor"), F.when(opens, attribute("name")).alias("label"), F.regexp_replace("raw", r"^</?[A-Za-z][^>]*>", " ").alias("text")
    )


def placed_tokens(tokens: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES, max_binaries: int = MAX_BINARIES) -> DataFrame:
    """tokens with depth (of the innermost open element behind them), open (those elements from the root on: seq, name, label) and fault."""
    order = Window.partitionBy("id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("step") == 1
    rows = tokens.withColumn("depth", F.sum("step").over(upto)).withColumn("nodes", F.sum(opens.cast("long")).over(upto))
    rows = rows.withColumn("binaries", F.sum((opens & (F.col("name") == "binary")).cast("long")).over(upto))
    levels = [F.last(F.when(opens & (F.col("depth") == d), F.struct("seq", "name", "label")), ignorenulls=True).over(upto) for d in range(1, max_depth + 2)]
    rows = rows.withColumn("levels", F.array(*levels))
    closed = F.get("levels", F.col("depth").cast("int"))["name"]  # the element at the depth that the end tag leaves
    fault = (
        F.when((F.col("step") == -1) & ((F.col("depth") < 0) | (F.coalesce(closed, F.lit("")) != F.col("name"))), "unbalanced")
        .when(opens & (F.col("depth") > max_depth), "too deep")
        .when(opens & (F.col("nodes") > max_nodes), "too many")
        .when(opens & (F.col("binaries") > max_binaries), "too many binaries")
    )
    return rows.withColumn("fault", fault).withColumn("open", F.slice("levels", 1, F.greatest(F.least(F.col("depth"), F.lit(max_depth)), F.lit(0)).cast("int"))).drop("levels")


def tree_verdicts(placed: DataFrame) -> DataFrame:
    """id, verdict, at (seq of the tag that decides, null if none does), elements (that were read)."""
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("seq", "fault")))
    per = placed.groupBy("id").agg(first.alias("first"), F.max_by("depth", "seq").alias("left"))
    verdict = F.coalesce("first.fault", F.when(F.col("left") > 0, "open").otherwise("whole"))
    read = placed.join(per.select("id", F.col("first.seq").alias("until")), "id").where("until IS NULL OR seq < until")
    counts = read.groupBy("id").agg(F.count_if(F.col("step") == 1).alias("elements"))
    return per.join(counts, "id", "left").select("id", verdict.alias("verdict"), F.col("first.seq").alias("at"), F.coalesce("elements", F.lit(0)).alias("elements"))


def squeezed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[\\t\\n\\r ]+", " "))


def tree_nodes(placed: DataFrame) -> DataFrame:
    """id, node, parent, depth, name, path, anchor, ancestors (from the root on), text (the element's own, in order) of what was read."""
    until = F.min(F.when(F.col("fault").isNotNull(), F.col("seq"))).over(Window.partitionBy("id"))
    read = placed.withColumn("until", until).where("until IS NULL OR seq < until")
    inner = F.element_at("open", -1)["seq"]
    owned = read.where(F.size("open") > 0).groupBy("id", inner.alias("node")).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("texts"))
    own = squeezed(F.array_join(F.transform("texts", lambda t: t["text"]), " "))
    above = F.slice("open", 1, F.greatest(F.size("open") - 1, F.lit(0)))
    nodes = read.where("step = 1").select(
        "id", F.col("seq").alias("node"), F.get(F.transform(above, lambda o: o["seq"]), F.size(above) - 1).alias("parent"), "depth", "name", F.concat(F.lit("/"), F.array_join(F.transform("open", lambda o: o["name"]), "/")).alias("path"),
        "anchor", F.transform(above, lambda o: o["seq"]).alias("ancestors"), F.get(F.filter("open", lambda o: o["name"] == "body"), F.lit(0))["label"].alias("body"),
    )
    return nodes.join(owned.select("id", "node", own.alias("text")), ["id", "node"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def markup_tree(texts: DataFrame, containers: list[str], text_col: str = "text", **limits) -> DataFrame:
    """tree_nodes() of texts (id, text)."""
    return tree_nodes(placed_tokens(tag_tokens(texts, containers, text_col), **limits))


def note_texts(nodes: DataFrame) -> DataFrame:
    """id, note (its anchor), text: all text below each anchored section of the bodies that have a name, in order of elements."""
    notes = nodes.where("name = 'section' AND anchor IS NOT NULL AND body IS NOT NULL").select("id", F.col("node").alias("section"), F.col("anchor").alias("note"))
    below = nodes.select("id", "node", "text", F.explode(F.concat("ancestors", F.array("node"))).alias("section"))
    found = notes.join(below, ["id", "section"]).groupBy("id", "section", "note").agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("texts"))
    return found.select("id", "note", squeezed(F.array_join(F.transform("texts", lambda t: t["text"]), " ")).alias("text"))
