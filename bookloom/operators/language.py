"""Language of texts by character trigrams: counts of a training fold, a sparse model of bounded size, scores of whole texts.

A trigram's weight in a language is its log share there, with add-half smoothing; a text's score is the sum over its
trigrams, and the language with the highest mean wins. Trigrams run over lower-cased letters with a blank for every
run of anything else. The model keeps the trigrams that tell languages apart best, GRAMS at most, so it fits any task;
counting and scoring are numpy over Arrow batches, and only counts are exchanged.

Defined cases: a text without letters has no language (null); equal scores go to the language that is first in order; a
null language in training is left out; without training rows nothing has a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions.storage import small_batches
from bookloom.operators.documents import language_decision, standard_language

#: Trigrams of a model, and how often one must occur in training, at most and at least.
GRAMS, LEAST = 50_000, 5
#: Code points that are worked on together.
STEP = 1 << 20
#: Above every code point; three of them fill 63 bits.
_SPAN = 1 << 21


def _letters(c: str) -> Column:
    """Lower-case letters with a blank for every run of anything else, and one at both ends."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), r"\P{L}+", " ")), F.lit(" "))


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts as numbers, and the text that each comes from."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = (points[:-2] * _SPAN + points[1:-1]) * _SPAN + points[2:]
    inside = owner[2:] == owner[:-2]
    return codes[inside], owner[:-2][inside]


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP:
            yield start, i
            start = i
            size = 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    grams: np.ndarray  # in order
    weights: np.ndarray  # a row a trigram, a column a language

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean weight in each language, and how many trigrams it has."""
        codes, owner = grams_of(texts)
        at = np.searchsorted(self.grams, codes)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == codes[known]
        total = np.stack([np.bincount(owner[known], self.weights[at[known], k], len(texts)) for k in range(len(self.languages))], 1) if len(self.languages) else np.zeros((len(texts), 0))
        n = np.bincount(owner, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None], n


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n of the documents that have a language."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lo, hi in _steps(texts):
                codes, owner = grams_of(texts[lo:hi])
                for lang in set(langs[lo:hi]):
                    grams, n = np.unique(codes[langs[lo:hi][owner] == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(grams)), pa.array(grams), pa.array(n)], schema=schema)

    rows = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string"), _letters(text_col))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", grams: int = GRAMS, least: int = LEAST) -> Model:
    """A model of at most so many trigrams: those whose counts tell languages apart best (by mutual information)."""
    counts = gram_counts(docs, text_col, lang_col)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    languages = tuple(sorted(totals))
    if not languages:
        return Model((), np.empty(0, np.int64), np.empty((0, 0)))
    whole = sum(totals.values())
    each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(languages)]
    wide = counts.groupBy("gram").agg(F.sum("n").alias("n"), *each).where(F.col("n") >= least)
    tells = F.lit(0.0)
    for k, x in enumerate(languages):
        tells = tells + F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") * F.log(F.col(f"n{k}") * F.lit(whole / max(totals[x], 1)) / F.col("n"))).otherwise(0.0)
    best = wide.orderBy(tells.desc(), "gram").limit(grams).collect()  # grams rows at most
    best.sort(key=lambda r: r["gram"])
    seen = np.array([[r[f"n{k}"] for k in range(len(languages))] for r in best], float).reshape(len(best), len(languages))
    weights = np.log((seen + 0.5) / np.array([totals[x] for x in languages]))
    return Model(languages, np.array([r["gram"] for r in best], np.int64), weights)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with detected (a language of the model or null) and margin (mean log odds against the second best)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<lang: string, margin: double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = {"lang": [], "margin": []}
        every = texts.tolist()
        for lo, hi in _steps(every):
            scores, n = model.scores(every[lo:hi])
            for s, k in zip(scores, n):
                top = np.argsort(-s, kind="stable")
                out["lang"].append(model.languages[top[0]] if k and len(s) else None)
                out["margin"].append(float(s[top[0]] - s[top[1]]) if k and len(s) > 1 else 0.0)
        return pd.DataFrame(out)

    found = docs.withColumn("detected", judge(_letters(text_col)))
    return found.withColumn("margin", F.col("detected.margin")).withColumn("detected", F.col("detected.lang"))


def decided(docs: DataFrame, model: Model, text_col: str = "text", tag_col: str = "lang") -> DataFrame:
    """docs with detected, margin and decision (lang, method): a tag that agrees is confirmed, one that does not is overruled."""
    found = predict(docs, model, text_col)
    return found.withColumn("decision", language_decision(F.coalesce(tag_col, F.lit("")), F.col(text_col), F.coalesce("detected", standard_language(F.coalesce(tag_col, F.lit(""))))))
