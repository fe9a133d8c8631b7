import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookloom.llm import quality as Q

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(again))


TEXTS = [None, "", " \t\n", "a", "a b", "a b c a b c", "x x x x x", "é ü | b\nq\nq\n \n \nq", "a b c d a b c e a b", "w " * 500, "<b>&\r\n<b>&\r\nz", "one two three\n" * 40 + "😀 end"]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS) for r in Q.quality(df, ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_verdicts(spark):
    name = lambda k: "".join("aeioulnrst"[int(c)] for c in f"{k % 99991:05d}")
    good = [". ".join(" ".join(name(i * 7919 + j * 104729 + k) for k in range(10)) for j in range(0, 120, 10)) + "." for i in range(40)]
    bad = [" ".join(name(i * 7919 + j * 104729) + "***" for j in range(120)) for i in range(6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + ["short"])], "doc_id long, text string")
    rows = {r.doc_id: r for r in Q.quality(df, ["doc_id"]).collect()}
    assert all(rows[i].kept for i in range(40))
    assert not any(rows[i].kept for i in range(40, 47))
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality(df, ["doc_id"]).count() == 0
    twice = spark.createDataFrame([(None, "a " * 60), (None, "a " * 60)], "doc_id long, text string")
    assert Q.quality(twice, ["doc_id"]).count() == 2


def brute_em(patterns, rounds=Q.ROUNDS):
    """The same model row by row: probabilities instead of log-odds."""
    rows = [v for v, n in patterns for _ in range(n)]
    good = [(v.count(1) + 0.5) / (v.count(1) + v.count(-1) + 1) for v in rows]
    for _ in range(rounds):
        a, b = sum(good) + 1, len(rows) - sum(good) + 1
        tables = []
        for j in range(len(rows[0])):
            said = [(g, v[j]) for g, v in zip(good, rows) if v[j]]  # an abstention says nothing
            yes, no = sum(g for g, _ in said), sum(1 - g for g, _ in said)
            p, q = (sum(g for g, x in said if x == 1) + 1) / (yes + 2), (sum(1 - g for g, x in said if x == 1) + 1) / (no + 2)
            tables.append({1: (p, q), -1: (1 - p, 1 - q), 0: (1, 1)} if p > q else dict.fromkeys((-1, 0, 1), (1, 1)))
        new = []
        for v in rows:
            p, q = a, b
            for x, t in zip(v, tables):
                p, q = p * t[x][0], q * t[x][1]
            new.append(p / (p + q))
        good = new
    return {v: g for v, g in zip(rows, good)}


def posterior(v, prior, weights):
    return 1 / (1 + math.exp(-prior - sum(w[x] for w, x in zip(weights, v))))


def test_em_recovers_planted_accuracies():
    draw = random.Random(5)
    right, abstains, share = [0.97, 0.9, 0.85, 0.7, 0.55], [0.1, 0.0, 0.3, 0.2, 0.0], 0.8
    found, truth = Counter(), []
    for _ in range(60000):
        good = draw.random() < share
        v = tuple(0 if draw.random() < a else (1 if (draw.random() < r) == good else -1) for r, a in zip(right, abstains))
        found[v] += 1
        truth.append((v, good))
    prior, weights = Q.fit_votes(sorted(found.items()))
    assert 1 / (1 + math.exp(-prior)) == pytest.approx(share, abs=0.02)
    for w, r, a in zip(weights, right, abstains):  # P(vote | good) / P(vote | bad) is r / (1 - r), and its inverse for a rejection
        assert w[1] == pytest.approx(math.log(r / (1 - r)), abs=0.25) and w[-1] == pytest.approx(-math.log(r / (1 - r)), abs=0.25) and (not a or abs(w[0]) < 0.1)
    judged = sum((posterior(v, prior, weights) >= 0.5) == good for v, good in truth) / len(truth)
    unanimous = sum((-1 not in v) == good for v, good in truth) / len(truth)
    assert judged > 0.97 and judged > unanimous + 0.2


def test_em_equals_brute_force():
    patterns = [((1, 1, 1, 1), 90), ((1, 1, -1, 1), 9), ((-1, 0, 1, -1), 12), ((-1, -1, -1, -1), 3), ((0, 0, 0, 1), 5)]
    prior, weights = Q.fit_votes(patterns)
    for v, g in brute_em(patterns).items():
        assert posterior(v, prior, weights) == pytest.approx(g, abs=1e-6)
    assert Q.fit_votes([]) == (0.0, [])


def test_an_abstention_is_no_evidence_and_a_rejection_never_helps():
    draw = random.Random(9)
    found = Counter(tuple(draw.choice((-1, 0, 1)) for _ in range(5)) for _ in range(3000)) + Counter({(1, 1, 1, 1, -1): 900, (-1, -1, -1, -1, 1): 300})
    prior, weights = Q.fit_votes(sorted(found.items()))
    assert all(w[-1] <= w[0] == 0 <= w[1] for w in weights) and weights[4] == {-1: 0, 0: 0, 1: 0}  # the last rule would be the wrong way round


def test_classes_keep_their_sense():
    prior, weights = Q.fit_votes([((1, 1, 1), 5), ((-1, -1, -1), 95)])  # most rows are bad
    assert prior < 0 and posterior((1, 1, 1), prior, weights) > 0.9 > 0.1 > posterior((-1, -1, -1), prior, weights)


def ratio_votes(text):
    n, chars, symbols, dups, again = brute(text)
    lines = max(sum(1 for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)), 1)
    text = text or ""
    upper, letters, digits = (sum(f(c) for c in text) for f in (lambda c: unicodedata.category(c) == "Lu", lambda c: unicodedata.category(c)[0] == "L", lambda c: unicodedata.category(c) == "Nd"))
    ends = len(re.findall(r"[.!?](?=[\x20\x09-\x0D]|\Z)", text))
    marks = chars - letters - digits
    n, chars = max(n, 1), max(chars, 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        vote(symbols > 0.2 * n, symbols <= 0.05 * n),
        vote(dups > 0.3 * lines, dups <= 0.1 * lines),
        vote(again > 0.3 * n, again <= 0.1 * n),
        vote(chars > 10 * n or chars < 3 * n, 4 * n <= chars <= 8 * n),
        vote(upper > 0.2 * chars, upper <= 0.08 * chars),
        vote(text.count("!") > 0.1 * n, text.count("!") <= 0.02 * n),
        vote(letters < 0.8 * chars, letters >= 0.9 * chars),
        vote(marks > 0.5 * n, marks <= 0.3 * n),
        vote(ends < 0.03 * n, ends >= 0.05 * n),
        vote(n < 10 * lines, n >= 20 * lines),
        vote(digits > 0.1 * chars, digits <= 0.03 * chars),
    )


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    voted = {i: ratio_votes(t) for i, t in texts.items()}
    want = brute_em(sorted(Counter(voted.values()).items()))
    for r in Q.op9_quality(spark, SF).collect():
        n, _, _, _, again = brute(texts[r.doc_id])
        assert r.score == pytest.approx(want[voted[r.doc_id]], abs=1e-6)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and r.kept == (not r.base_failed and r.score >= 0.5)


def test_posterior_is_not_unanimity(spark):
    """Weak rejections are outweighed, and no document goes that no rule rejects."""
    at = SF.replace("0.001", "0.1")
    counted = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", *Q.features("text")).cache()
    each = Q.votes(Q.counts())
    rejected = F.array_contains(F.array(*each), -1)
    model = Q.fitted(counted, F.array(*each))
    assert all(w[-1] <= w[0] == 0 <= w[1] for w in model[1]) and model[0] > 0
    judged = counted.select("doc_id", rejected.alias("rejected"), Q.base_fails(Q.counts()).alias("base_failed"), (Q.score(model, each) >= 0.5).alias("fine"))
    rows = judged.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id", "left").collect()
    assert sum(r.rejected and r.fine for r in rows) > 100 and not any(not r.rejected and not r.fine for r in rows)
    print(model, sum(r.rejected for r in rows), sum(r.rejected and r.fine for r in rows))
    rows = [r for r in rows if not r.base_failed]
    good, bad = ([r.fine for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_clashing_names(spark):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, text, 7, "x", "y", "z")], "doc_id long, text string, n_words int, kept string, _q_counted string, V0 string")
    out = Q.quality(df, ["doc_id", "n_words", "kept", "_q_counted", "V0"])
    assert out.columns == ["doc_id", "n_words_", "kept_", "_q_counted", "V0", *Q.COUNTS, "base_failed", "score", "kept"]
    assert out.first()["n_words_"] == 7 and out.first()["n_words"] == 60
    assert Q.quality_stage(spark, df, "").collect() == df.collect()


def test_long_text(spark):
    long = "one two three four five six. " * 150_000  # 4 MB
    df = spark.createDataFrame([(1, long), (2, long.replace("one", "One", 1))], "doc_id long, text string")
    assert {tuple(r[c] for c in Q.COUNTS) for r in Q.quality(df, ["doc_id"]).collect()} == {(900_000, 3_450_000, 0, 0, 900_000), (900_000, 3_450_000, 0, 0, 899_999)}


@pytest.mark.parametrize("n", [1])
def test_stage_keeps_columns(spark, n):
    df = spark.createDataFrame([(1, "a b " * 9, "en", "s", 3), (2, " ".join(f"w{i}" for i in range(99)), "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = Q.quality_stage(spark, df, "")
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [2]
