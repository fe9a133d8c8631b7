"""Spelling variants of words by anagram hashing: which words of a corpus are one letter apart, and which form each has.

A word's key is the sum of the fifth powers of its letters, so that all orders of the same letters share it. Two words
one letter apart have keys that differ by the value of a letter: by its addition or removal, or by an exchange of one
for another. Instead of trying every letter of an alphabet, each word gives its key as it is and its key less each of
its letters: a word with a letter more meets the other's whole key, and two words with a letter exchanged meet at what
is left of both. An edit leaves one half of what is left as it was: the first k letters or the rest. So rows carry,
next to the value, which half they claim and its hash; only words that agree in value and in a half meet, and the order
of their letters is verified by the edit distance. A pair whose first k letters agree counts by its first half only,
every other by its second, so each pair counts once and pairs are summed up before they are exchanged.

Joins of words are merge joins by hint: a word gives a score of rows of keys, which Spark, going by the size of the
written words, takes for a table small enough to broadcast.

Forms are followed to the last by pointer jumping: n at least doubles with each form, so chains are short.

Defined cases: null texts and null words have no words; words of fewer than LEAST_CHARS code points are no words; a
null doc_id is written as the empty string before the colon; repeated rows count again; equal largest n take the form
that is smallest in code-point order; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import ascii_lower, mix64, remove, written

LEAST_CHARS, LEAST_SEEN = 5, 3
#: A letter counts by this power of its code point.
POWER = 5
#: How many times as frequent as a word its form must be at least.
FORM_TIMES = 2
RUN_PATTERN = "[a-zÀ-ÿ]+"
#: Of so many runs about one loses a letter in the query, by its document and itself.
NOISE = 97

#: Base of the halves' hashes, odd, so that it has an inverse mod 2^64.
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 15
_KEYS = "value long, half long, whole boolean, second boolean, word string, n long"
_SCHEMA = pa.schema([("value", pa.int64()), ("half", pa.int64()), ("whole", pa.bool_()), ("second", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (as text), run for every run of letters that could give a word."""
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    found = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUN_PATTERN), F.lit(0))).alias("run"))
    return found.where(F.char_length("run") >= LEAST_CHARS)


def noisy(doc: Column, run: Column, noise: int = NOISE) -> Column:
    """The run, less the letter that its hash names where noise divides that hash."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % noise == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(words: DataFrame, word: str = "word", least_seen: int = LEAST_SEEN) -> DataFrame:
    """word, n of all words that are long and frequent enough."""
    counted = words.where(F.char_length(word) >= LEAST_CHARS).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_seen)


def _powers(base: int, most: int) -> np.ndarray:
    out = np.full(most + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anagram_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (word, n): its whole key and its key less each of its letters, each with its first half and with its second.

    Of m letters that are left, the first half has m // 2; both are taken from the ends of the word itself.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            words = part.column(0).to_pylist()
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(words)), sizes)
            order = np.lexsort((points, owner))
            new = np.ones(len(order), bool)
            new[1:] = (owner[order][1:] != owner[order][:-1]) | (points[order][1:] != points[order][:-1])
            gone = order[new]  # the distinct letters of each word
            who = np.concatenate([np.arange(len(words)), owner[gone]])
            whole = np.arange(len(who)) < len(words)
            left = sizes[who] - ~whole
            head_end = starts[who] + left // 2
            tail_at = starts[who] + sizes[who] - (left - left // 2)
            with np.errstate(over="ignore"):
                worth = points.copy()
                for _ in range(POWER - 1):
                    worth *= points
                value = np.add.reduceat(worth, starts)[who] - np.concatenate([np.zeros(len(words), np.uint64), worth[gone]])
                placed = mix64(points + np.uint64(1)) * _powers(_BASE, int(sizes.max()))[np.arange(len(points)) - starts[owner]]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)])
                head = sums[head_end] - sums[starts[who]]
                tail = (sums[starts[who] + sizes[who]] - sums[tail_at]) * _powers(pow(_BASE, -1, 1 << 64), int(sizes.max()))[tail_at - starts[who]]
                kind = left.astype(np.uint64) * np.uint64(2)
                half = mix64(mix64(np.concatenate([head, tail])) + np.concatenate([kind, kind + np.uint64(1)]))
            twice = pa.array(np.concatenate([who, who]))
            columns = [np.concatenate([value, value]).view(np.int64), half.view(np.int64), np.concatenate([whole, whole]), np.arange(len(half)) >= len(who)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part.column(0).take(twice), part.column(1).take(twice)], schema=_SCHEMA)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n for both directions of every pair of words one letter apart. words has word, n, each word once and none empty."""
    keys = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(anagram_keys, _KEYS)
    other = keys.select("value", "half", F.col("whole").alias("near_whole"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = keys.join(other.hint("merge"), ["value", "half"]).where(~(F.col("whole") & F.col("near_whole")) & (F.col("word") != F.col("near")))
    k = F.expr("(char_length(word) - if(whole, 0, 1)) div 2").cast("int")
    same_head = F.substring("word", F.lit(1), k) == F.substring("near", F.lit(1), k)
    return met.where((same_head != F.col("second")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")


def forms(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: each word's near words counted, and the most frequent one where that is frequent enough."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(found.hint("merge"), "word", "left")
    holds = -F.col("best.less") >= times * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """formed (written: it is read again and again) with root, the last form of the chain that begins at the word."""
    spark, old = formed.sparkSession, []
    hops = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new: list[str] = []
        moved = written(hops.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", new)
        remove(spark, old)
        old, hops = new, moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(hops.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of distinct words and their counts; words of one root are a group."""
    spent: list[str] = []
    kept = written(words.where("word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words", spent)
    formed = written(forms(kept), "forms")
    remove(words.sparkSession, spent)
    return with_roots(formed)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = runs(docs)
    counts = word_counts(found.select(noisy(F.col("doc"), F.col("run")).alias("word")))
    return spelling_groups(counts).select("word", "form", "root", "n", "n_near", "form_n")
