"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Column expressions only; the table of vote patterns (at most 3 to the number of rules, some hundreds in practice) is
the one thing that goes to the driver. Every rule votes +1 (good), -1 (bad) or 0 (abstains). A model with two hidden
classes gives each rule, where it votes, a probability of approving in each class; an abstention is no evidence, for or
against. Expectation-maximisation over the counts of vote patterns of all documents fits them from the shares of
approving votes, without labels, with add-one smoothing and one bound: a rule that would approve bad documents more
readily than good ones has no weight, so that no rejection ever speaks for a document. A document is kept if its
posterior probability of being good is at least the threshold and the base rule holds: so approvals can outweigh the
rejection of a weak rule.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows are judged
alike, each for itself; a tie at the threshold is kept; an empty table gives no rows; columns besides those in keep are
ignored, and a column in keep that has the name of a result column gets underscores after its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import SPACE_CLASS, free_name, free_prefix, let, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LEAST_WORDS = 50
THRESHOLD = 0.5
#: Rounds at most, and the change of a posterior at which fitting ends.
ROUNDS, SETTLED = 200, 1e-9


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more."""
    n = F.size(words)
    windows = F.when(
        n >= 3, F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def found(p: Column) -> Column:
            again = F.filter(p, lambda x, k: F.coalesce((x["h"] == F.get(p, k + 1)["h"]) | F.lit(False), F.lit(False)) | F.coalesce(x["h"] == F.get(p, k - 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(starts: Column) -> Column:
            steps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda p: let(found(p), total))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def features(text_col: str, prefix: str = "") -> list[Column]:
    """Columns from which counts() takes the counts of the whole text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("again")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("own")))
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    each = {
        "counted": counted,
        "lines": line_counts,
        "word_chars": left(SPACE_CLASS + "+"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_cries": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_letters": left(r"\P{L}+"),
        "n_digits": F.regexp_count(text, F.lit(r"\p{Nd}")).cast("long"),
        "n_ends": F.regexp_count(text, F.lit(rf"[.!?](?={SPACE_CLASS}|\z)")).cast("long"),
    }
    return [c.alias(prefix + n) for n, c in each.items()]


def counts(prefix: str = "", held: Column | None = None) -> dict[str, Column]:
    """The counts by name, over the columns of features() or the struct of them that is held."""
    col = lambda n: F.col(f"`{prefix}{n}`") if held is None else held[n]
    plain = {n: col(n) for n in ("word_chars", "n_symbols", "n_upper", "n_cries", "n_letters", "n_digits", "n_ends")}
    return plain | {"n_words": col("counted")["n"], "n_repeat_words": col("counted")["again"], "n_lines": col("lines")["n"], "n_dup_lines": col("lines")["n"] - col("lines")["own"]}


def rules(c: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """For each rule when it rejects and when it approves, by counts; between the two it abstains."""
    n, chars, lines = (F.greatest(c[k], F.lit(1)) for k in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols": (c["n_symbols"] > 0.2 * n, c["n_symbols"] <= 0.05 * n),
        "repeated lines": (c["n_dup_lines"] > 0.3 * lines, c["n_dup_lines"] <= 0.1 * lines),
        "repeated words": (c["n_repeat_words"] > 0.3 * n, c["n_repeat_words"] <= 0.1 * n),
        "length of words": ((chars > 10 * n) | (chars < 3 * n), (chars <= 8 * n) & (chars >= 4 * n)),
        "capitals": (c["n_upper"] > 0.2 * chars, c["n_upper"] <= 0.08 * chars),
        "exclamations": (c["n_cries"] > 0.1 * n, c["n_cries"] <= 0.02 * n),
        "letters": (c["n_letters"] < 0.8 * chars, c["n_letters"] >= 0.9 * chars),
        "marks": (c["word_chars"] - c["n_letters"] - c["n_digits"] > 0.5 * n, c["word_chars"] - c["n_letters"] - c["n_digits"] <= 0.3 * n),  # prose has one in five words or so
        "ends of sentences": (c["n_ends"] < 0.03 * n, c["n_ends"] >= 0.05 * n),
        "length of lines": (n < 10 * lines, n >= 20 * lines),
        "digits": (c["n_digits"] > 0.1 * chars, c["n_digits"] <= 0.03 * chars),
    }


def votes(c: dict[str, Column]) -> list[Column]:
    return [F.when(bad, -1).when(good, 1).otherwise(0).cast("int") for bad, good in rules(c).values()]


def fit_votes(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over (votes, count): the prior log-odds of good, and per rule the log-odds of each vote.

    It begins with the share of approvals among a pattern's votes, so the class in which votes approve more is the good
    one. An abstention has log-odds 0, an approval at least and a rejection at most that.
    """
    if not patterns:
        return 0.0, []
    total, width = sum(n for _, n in patterns), len(patterns[0][0])
    good = [(v.count(1) + 0.5) / (v.count(1) + v.count(-1) + 1) for v, _ in patterns]
    prior, weights = 0.0, []
    for _ in range(ROUNDS):
        mass = [g * n for g, (_, n) in zip(good, patterns)]
        prior = math.log((sum(mass) + 1) / (total - sum(mass) + 1))
        weights = []
        for j in range(width):
            seen, fine = dict.fromkeys((-1, 0, 1), 0.0), dict.fromkeys((-1, 0, 1), 0.0)
            for m, (v, n) in zip(mass, patterns):
                seen[v[j]] += n
                fine[v[j]] += m
            of_good, of_bad = (fine[1] + 1) / (fine[1] + fine[-1] + 2), (seen[1] - fine[1] + 1) / (seen[1] + seen[-1] - fine[1] - fine[-1] + 2)
            of_good, of_bad = (of_good, of_bad) if of_good > of_bad else (0.5, 0.5)
            weights.append({-1: math.log((1 - of_good) / (1 - of_bad)), 0: 0.0, 1: math.log(of_good / of_bad)})
        after = [1 / (1 + math.exp(min(-prior - sum(w[x] for w, x in zip(weights, v)), 700.0))) for v, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(after, good))
        good = after
        if moved < SETTLED:
            break
    return prior, weights


def fitted(rows: DataFrame, each: Column) -> tuple[float, list[dict[int, float]]]:
    """fit_votes() over rows, where each is the array of a row's votes."""
    found = rows.groupBy(each.alias("votes")).count().collect()  # a row a pattern
    return fit_votes(sorted((tuple(r["votes"]), r["count"]) for r in found))


def score(model: tuple[float, list[dict[int, float]]], each: list[Column]) -> Column:
    """The posterior of good, by votes."""
    prior, weights = model
    odds = F.lit(prior)
    for v, w in zip(each, weights):
        odds = odds + F.when(v == -1, w[-1]).when(v == 1, w[1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def posterior(rows: DataFrame, each: list[Column]) -> Column:
    """The posterior of good as a column over rows, fitted on their votes."""
    return score(fitted(rows, F.array(*each)), each)


def base_fails(c: dict[str, Column]) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def quality(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """keep, the counts, base_failed, score (posterior of good) and kept, for every row of docs."""
    results = [*COUNTS, "base_failed", "score", "kept"]
    named = [F.col(f"`{k}`").alias(free_name(k, results)) for k in keep]
    at = free_prefix("_q_", [free_name(k, results) for k in keep])
    counted = written(docs.select(*named, *features(text_col, at)), "quality")
    c = counts(at)
    good = posterior(counted, votes(c)).alias("score")
    scored = counted.select(*counted.columns[: len(keep)], *[c[n].alias(n) for n in COUNTS], base_fails(c).alias("base_failed"), good)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs, ["doc_id"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; all columns of the others stay.

    The texts are counted twice, to fit the rules and to judge by them: no text is shuffled or written on the way.
    """
    seen = F.struct(*features("text"))
    model = fitted(docs, let(seen, lambda s: F.array(*votes(counts(held=s)))))

    def fine(s: Column) -> Column:
        c = counts(held=s)
        return ~base_fails(c) & (score(model, votes(c)) >= THRESHOLD)

    return docs.where(let(seen, fine))
