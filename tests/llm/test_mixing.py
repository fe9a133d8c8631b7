import math
import random
from collections import Counter, defaultdict

import pytest

from bookloom.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string"


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for s, n in (("hot", 600), ("a", 100), ("b", 60), (None, 20)):
        rows += [(len(rows) + k, " ".join("w" for _ in range(r.randint(0, 60))), "en", s, 1, "x") for k in range(n)]
    return rows + [(None, None, "en", "a", 1, "x"), (5000, "x " * 4000, "en", "b", 1, "x")]


def weights(shares, a):
    z = sum(p**a for p in shares.values())
    return {s: p**a / z for s, p in shares.items()}


def brute_exponent(shares, entropy, repeats):
    def h(a):
        return -sum(w * math.log(w) for w in weights(shares, a).values()) / math.log(len(shares))

    def rep(a):
        q = [p ** (a - 1) for p in shares.values()]
        return max(q) / min(q)

    def bisect(ok):  # ok holds above some point
        lo, hi = 0.0, 1.0
        if ok(lo):
            return lo
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        return hi

    a = bisect(lambda x: h(x) < entropy) if entropy is not None else 0.0
    return max(a, bisect(lambda x: rep(x) <= repeats)) if repeats is not None else a


@pytest.mark.parametrize("seed, entropy, repeats, budget", [(1, 0.95, 2.0, None), (2, 0.8, 50.0, None), (3, None, 3.0, None), (4, 0.95, 4.0, 9000.0)])
def test_mixture(spark, seed, entropy, repeats, budget):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = M.mixture(df, entropy, repeats, budget, block_tokens=2000).collect()
    tokens = {(i, s or ""): max(len((t or "").split()), 1) for i, t, _, s, _, _ in rows}
    total = defaultdict(int)
    for (_, s), n in tokens.items():
        total[s] += n
    whole = sum(total.values())
    shares = {s: n / whole for s, n in total.items()}
    a = brute_exponent(shares, entropy, repeats)
    want = weights(shares, a)
    once = max(total[s] / want[s] for s in total)
    passes = {s: want[s] * (budget or once) / total[s] for s in total}
    read = Counter((r.doc_id, r.source) for r in out)
    got = defaultdict(int)
    for r in out:
        assert r.tokens == tokens[r.doc_id, r.source] and 0 <= r.place < 1 and r["pass"] < math.ceil(passes[r.source] + 1e-5)
        got[r.source] += r.tokens
    for (i, s), n in tokens.items():
        assert math.floor(passes[s] - 1e-5) <= read[i, s] <= math.ceil(passes[s] + 1e-5)
    biggest = max(tokens.values())
    for s in total:
        assert abs(got[s] - want[s] * (budget or once)) <= biggest + 1e-3 * got[s]
    blocks = defaultdict(lambda: defaultdict(int))
    for r in out:
        blocks[r.block][r.source] += r.tokens
    n = max(blocks) + 1
    for b in blocks.values():  # every block holds the sources by weight, but for documents that cross its ends
        assert all(b[s] <= want[s] * (budget or once) / n + 2 * max(v for (_, x), v in tokens.items() if x == s) for s in b)


def test_stage(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    out = M.mixing_stage(spark, df, "")
    assert out.columns == df.columns
    read = Counter(r.doc_id for r in out.collect())
    assert set(read) == {r[0] for r in rows} and all(v in (1, 2, 3) or i == rows[0][0] for i, v in read.items())


def test_empty_and_single(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mixture(df).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 1, "x")], SCHEMA)
    assert [(r["pass"], r.place) for r in M.mixture(one).collect()] == [(0, 0.0)]


def test_clashing_names_and_repeats(spark):
    rows = [(1, "a b", "x", 5, 6, "m")] * 3 + [(1, "other", "x", 5, 6, "m"), (None, None, None, 5, 6, "m"), (2, "a b", "y", 5, 6, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n int, _again int, _m_th string")
    out = M.mixing_stage(spark, df, "")
    assert out.columns == df.columns
    read = Counter((r.doc_id, r.text, r["_n"], r["_again"], r["_m_th"]) for r in out.collect())
    assert set(read) == {(r[0], r[1], 5, 6, "m") for r in rows} and read[1, "a b", 5, 6, "m"] % 3 == 0


def test_sums_in_two_steps(spark):
    rows = [(s, p, k, k * 3 + 1) for s in "ab" for p in (0, 1) for k in range(0, 64, 1 + p)]
    df = spark.createDataFrame(rows, "source string, pass int, range long, in_range long")
    got = {(r.source, r["pass"], r.range): r.base for r in M.sums_before(df, 6).collect()}
    assert got == {(s, p, k): sum(n for a, b, c, n in rows if (a, b) == (s, p) and c < k) for s, p, k, _ in rows}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 2_000_000, "a"), (2, "word", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.tokens for r in M.mixture(df).collect()} == {1: 2_000_000, 2: 1}
