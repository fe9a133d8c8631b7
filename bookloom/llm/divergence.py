"""How far the sources of a language are apart in their use of terms, by an inverted index with corrected baselines.

Terms that enough documents of a language hold are kept; each source's smoothed shares p of them are compared with those
of every other source, in exact integers. A source gives the share z of a zero count to every kept term that it does not
use, so a pair of sources begins at its baseline: V times |z - z'|, as if neither used any term. Three corrections lead
to the sum of all |p - p'|, and none of them visits terms with two zero counts:

* terms that the first source uses, against the second's z. Their shares depend on their counts alone, so the terms of a
  source are first counted by count, and only those few rows meet the other sources;
* the same the other way round;
* terms that both use: their postings meet by term, and what |p - p'| differs from the two former corrections is emitted
  where it is not zero.

Corrections are summed up by pair before they are exchanged. Terms that a source prefers are ranked in a window of which
only the leading ones of each task are exchanged.

Defined cases: null text, lang and source are empty strings; a text without terms still makes its group occur; repeated
rows count again, and every row is a document; ties are broken by item in UTF-8 order; where a language keeps no term
(V = 0) all pairs have value 0 and there is no term part; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.llm.common import LOWER, remove, small_batches, written

LEAST_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Keys over which the rows of a language are spread where they meet its sources.
SALTS = 32
#: Terms as bytes of UTF-8: runs of ASCII letters and of whatever is not ASCII.
_TERM = re.compile(rb"[A-Za-z\x80-\xFF]+").findall
#: Terms (and documents) that a task counts before it hands them on.
HELD = 1 << 19


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of the texts (lang, source, text) of a task, in parts of HELD terms at most."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def parts() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            both = np.fromiter(counts.values(), np.int64, len(counts))
            terms = pa.array(counts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(both)), pa.repeat(source, len(both)), terms, pa.array(both >> 24), pa.array(both & 0xFFFFFF)], schema=schema)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            counts = held.setdefault((lang, source), {})
            before = len(counts)
            for term, n in Counter(_TERM(text.as_buffer().to_pybytes().translate(LOWER))).items():
                counts[term] = counts.get(term, 0) + (n << 24 | 1)  # documents in the low bits: fewer than 2^24 come before the next part
            size += len(counts) - before + 1
            if size >= HELD:
                yield from parts()
                size = 0
    yield from parts()


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    small_batches(docs.sparkSession)
    rows = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), _text(text_col).alias("text"))
    each = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact also for counts that overflow 64 bits on the way."""
    over = (n.cast("decimal(20,0)") + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    under = (total + SMOOTH * terms).cast("decimal(20,0)")
    return F.call_function("div", over, under) + 1


def _with_others(rows: DataFrame, theirs: DataFrame, *spread: str) -> DataFrame:
    """Each row with all other sources (item) of its language. A language's rows are spread over SALTS keys, since one may hold most."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    every = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(every, ["lang", "salt"]).drop("salt").where(F.col("source") != F.col("item"))


class Index:
    """The kept terms of every language as postings, and the groups. All tables are written: they are read repeatedly."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS):
        spent: list[str] = []
        counts = written(term_counts(docs, text_col, lang_col, source_col), "counts", spent)
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs).drop("docs")
        postings = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "postings")
        remove(docs.sparkSession, spent)
        sources = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source")).distinct()
        langs = postings.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total_lang"))
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = sources.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "total_lang"])
        zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(0)
        self.groups = written(groups.withColumn("zero", zero.cast("long")), "groups")
        self.postings = postings

    def shares(self) -> DataFrame:
        """lang, source, term, n, p (the source's), q (the language's), zero for every kept term that a source uses."""
        p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
        return self.postings.join(self.groups, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "zero")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value (sum of all |p - p'|)."""
        mine = self.groups.select("lang", "source", "zero", "terms")
        theirs = self.groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"))
        both = _with_others(mine, theirs, "source")
        base = F.abs(F.col("zero") - F.col("zero_item"))
        shares = self.shares()
        levels = shares.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("m"))
        against = _with_others(levels, theirs, "source", "p")
        one = against.select("lang", "source", "item", (F.col("m") * (F.abs(F.col("p") - F.col("zero_item")) - base)).alias("value")).where("value <> 0")
        one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        other = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        use = shares.select("lang", "term", "source", "p", "zero")
        met = use.join(use.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_item"), F.col("zero").alias("zero_item")), ["lang", "term"])
        p, r = F.col("p"), F.col("p_item")
        left = F.abs(p - r) - F.abs(p - F.col("zero_item")) - F.abs(r - F.col("zero")) + base
        shared = met.where(F.col("source") != F.col("item")).select("lang", "source", "item", left.alias("value")).where("value <> 0")
        shared = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        start = both.select("lang", "source", "item", (F.col("terms") * base).alias("value"))
        every = start.unionByName(one).unionByName(other).unionByName(shared)
        return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def preferred(self) -> DataFrame:
        """lang, source, item (a term that the source uses more than its language), value (p - q)."""
        return self.shares().where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank of every source against the others and against its language."""
    index = Index(docs, text_col, lang_col, source_col, least_docs)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = index.pairs().withColumn("rank", ranked).withColumn("part", F.lit("pair"))
    terms = index.preferred().withColumn("rank", ranked).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
