import random
import re

import pytest

from bookloom.llm import ngram_join as J


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            x = len(a & sets[k])
            if a and sets[k] and 100 * x >= percent * (len(a) + len(sets[k]) - x):
                parent[root(i)] = root(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstu")
    passage = [word() for _ in range(40)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(r.choice([3, 9, 12, 40, 150, 300]))]
        if base % 2:
            text += passage
        for _ in range(r.randint(1, 25)):
            copy = list(text)
            for _ in range(r.randint(0, max(1, len(text) // 25))):
                at = r.randrange(len(copy))
                copy[at : at + r.randint(0, 1)] = [word() for _ in range(r.randint(0, 2))]
            rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(r.randint(0, 12))]) for _ in range(30)]
    rows += [None, "", " \n", "one", "ONE", "one two three", "One\ttwo\x0bthree", "é É", "a b c d", "a b c d", "a b c d e f g h i j", "a b c d e f g h i"]
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, width, percent", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_against_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    got = J.near_duplicates(df, width=width, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in J.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None)], key=repr)
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [
        (1, text(1), "x"),
        (2, text(1) + " more", "x"),  # a near copy goes
        (2, text(2), "x"),  # another text under its doc_id stays
        (None, text(1) + " end", "x"),  # a near copy without an id goes
        (None, text(3), "x"),
        (None, text(3) + " more", "x"),  # one of these two stays
        (5, text(5), "x"),
        (5, text(5), "x"),  # alike in all columns: one stays
        (6, text(6), "x"),
        (6, text(6), None),  # alike in doc_id and text: one stays
        (7, "", "x"),
        (7, "", "x"),  # empty texts have no links
        (8, None, "x"),
        (9, text(9), "x"),
    ]
    for some in (rows, [r for r in rows if r[0] != 5], rows[:0]):
        df = spark.createDataFrame(some, "doc_id long, text string, source string").repartition(3)
        got = J.ngram_join_stage(spark, df, "")
        assert got.columns == df.columns
        got = [(r.doc_id, r.text) for r in got.collect()]
        assert len([g for g in got if g[0] is None]) == (1 if some else 0)
        want = [(1, text(1)), (2, text(2)), (5, text(5)), (6, text(6)), (7, ""), (7, ""), (8, None), (9, text(9))]
        assert sorted((g for g in got if g[0] is not None), key=repr) == [w for w in want if w[0] in {r[0] for r in some}]


@pytest.mark.parametrize("seed, width, percent", [(4, 4, 85), (5, 5, 80)])
def test_all_links(spark, seed, width, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    member, links = J.similar_classes(df, width=width, percent=percent)
    by_class = {}
    for r in member.where("n_shingles > 0").collect():
        by_class.setdefault(r["class"], set()).add(r.doc_id)
    found = {frozenset((i, k)) for r in links.collect() for i in by_class[r.a] for k in by_class[r.b]}
    found |= {frozenset((i, k)) for c in by_class.values() for i in c for k in c if i != k}
    low = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    sets = {i: {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set() for i, w in low.items()}
    ids = sorted(i for i in sets if sets[i])
    want = {frozenset((i, k)) for i in ids for k in ids if i < k and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k])}
    assert found == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7), (2, "a b c d e f", 5, 6, 7)], "doc_id long, text string, _key int, n int, class int")
    assert J.ngram_join_stage(spark, df, "").collect() == df.where("doc_id = 1").collect()


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(1_200_000))  # 9 MB
    df = spark.createDataFrame([(1, long), (2, long + " one two three four five"), (3, "short text of a few words")], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()} == {1: (1_199_996, 1), 2: (1_200_001, 1), 3: (2, 3)}
