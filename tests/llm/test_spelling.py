import random
import re
import zlib
from collections import Counter

import pytest

from bookloom.llm import spelling as S


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts):
    out = {}
    by = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(by[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(by[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def brute_counts(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def table(seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abeÉéñ÷×ßxyz") for _ in range(r.randint(4, 9))) for _ in range(60)]
    words = []
    for s in stems:
        words += [s] * 3
        for _ in range(3):
            i = r.randrange(len(s))
            words += [s[:i] + s[i + 1 :], s[:i] + r.choice("abé") + s[i + 1 :], s[:i] + r.choice("xyz") + s[i:]]
    rows = [(i, " ".join(r.choice(words).title() if r.random() < 0.2 else r.choice(words) for _ in range(r.randint(0, 60))) + "\n42,") for i in range(200)]
    return rows + [(1000, None), (1001, ""), (None, "aaaaa bbbbb aaaaa"), (1002, "hello " * 60000), rows[3], rows[3], (1003, "12 ### Ωmega жук")]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, tmp_path, seed):
    rows = table(seed)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, n int, word int, run string")
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in S.op11_spelling(spark, str(tmp_path)).collect()}
    want = brute_groups(brute_counts(rows))
    assert len(want) > 200 and got == want
    assert any(len({r, *[w]}) == 2 and want[w][2] != r for w, (_, _, _, _, r) in want.items())  # chains of more than one form
    assert len(got["hello"]) and got["hello"][0] > 59000


@pytest.mark.parametrize("letters, sizes", [("ab", (1, 6)), ("abcdeéß", (4, 7)), ("xyЖ\U0001f600퟿", (1, 5))])
def test_pairs_of_any_words(spark, letters, sizes):
    r = random.Random(3)
    words = {"".join(r.choice(letters) for _ in range(r.randint(*sizes))): r.randint(1, 20) for _ in range(300)}
    pairs = S.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    found = [(p.word, p.near) for p in pairs]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if near(a, b)}
    assert all(p.n == words[p.word] and p.near_n == words[p.near] for p in pairs)


def test_keys_are_never_broadcast(spark, tmp_path):
    words = [("".join(random.Random(i).choices("abcdefgh", k=9)), 3) for i in range(2000)]
    spark.createDataFrame(words, "word string, n long").write.parquet(str(tmp_path / "words"))
    small = spark.read.parquet(str(tmp_path / "words"))  # well below the limit for broadcasts; its keys may not be
    for df in (S.near_pairs(small), S.forms(small)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_ties_and_chains(spark):
    words = {"maker": 4, "baker": 40, "faker": 40, "bakers": 100, "other": 1, "mothers": 3, "mother": 6, "moth": 12}
    got = {r.word: (r.form, r.root, r.n_near) for r in S.spelling_groups(spark.createDataFrame([*words.items(), (None, 5), ("", 5)], "word string, n long")).collect()}
    assert got["maker"] == ("baker", "bakers", 2) and got["faker"] == (None, "faker", 2) and got["baker"] == ("bakers", "bakers", 3)
    assert got["mothers"] == ("mother", "mother", 1) and got["other"] == ("mother", "mother", 1) and got["moth"] == (None, "moth", 0)
    assert len(got) == len(words)


def test_very_long_words(spark):
    a = "ab" * 20000
    words = [(a, 9), (a + "c", 4), (a[:7] + "x" + a[8:], 2), (a[::-1], 1)]
    got = {r.word: (r.form == a, r.n_near) for r in S.spelling_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert [got[w] for w, _ in words] == [(False, 2), (True, 1), (True, 1), (False, 0)]


def test_empty(spark):
    assert S.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert S.word_counts(S.runs(spark.createDataFrame([], "doc_id long, text string")), "run").count() == 0
