import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from bookloom.llm import divergence as V


def brute(rows, least, top):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(t or ""))
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        docs[lang or ""].update(set(terms(text)))
        groups[lang or "", source or ""].update(terms(text))
    out = []
    for (lang, source), counts in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        peers = {s: c for (a, s), c in groups.items() if a == lang}
        everyone = sum(peers.values(), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = p(counts)
        pairs = [(s, sum(abs(own[t] - q[t]) for t in kept)) for s, q in ((s, p(c)) for s, c in peers.items() if s != source)]
        all_p = p(everyone)
        prefers = [(t, own[t] - all_p[t]) for t in kept if counts[t] > 0 and own[t] > all_p[t]]
        for part, items, most in (("pair", pairs, None), ("term", prefers, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)]
    return sorted(out)


def table(seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("foo", "Bar", "été", "жук", "😀") for b in ("a", "B", "é", "zz")]
    rows = []
    for _ in range(400):
        source = "hot" if r.random() < 0.4 else r.choice(["s1", "s2", "s3", None])
        lang = r.choice(["en", "de", None])
        rows.append((" ".join(r.choice(words[: 5 + 5 * (source == "hot") + 10 * (lang == "en")]) for _ in range(r.randint(0, 12))) + ", 12", lang, source))
    rows += [(None, "en", "silent"), ("", "xx", "a"), ("only one", "xx", "b"), (None, None, None), rows[0], rows[0], ("long " * 100_000, "en", "s1")]
    return rows


@pytest.mark.parametrize("seed, least, top", [(1, 30, 50), (2, 5, 3), (3, 1, 2), (4, 10**6, 50)])
def test_against_brute_force(spark, seed, least, top):
    rows = table(seed)
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "text string, lang string, source string, n int, term string, zero int").repartition(5)
    got = V.divergence(df, least_docs=least, top_terms=top)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_sql(spark, tmp_path):
    spark.createDataFrame(table(7), "text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = V.op13_divergence(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(V.OP13_SQL)
    assert want.columns == got.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(n, t, v) for n, t, v in [(0, 0, 1), (10**13, 3 * 10**13, 7), (1, 3, 1), (92233720368, 92233720368 * 3, 11)]], "n long, t long, v long")
    got = [r.p for r in df.select(V.share(*map(V.F.col, "ntv")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in ((r.n, r.t, r.v) for r in df.collect())]


def test_empty(spark):
    assert V.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "HELD", 7)
    rows = [(lang or "", source or "", text or "") for text, lang, source in table(9)[:80]]
    found = V.count_terms(iter([pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r)) for r in rows[i : i + 9]]) for i in range(0, 80, 9)]))
    n, docs = Counter(), Counter()
    for b in found:
        assert b.num_rows < 60
        for r in b.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want_n, want_docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = [t.replace("B", "b").replace("F", "f") for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        want_n.update((lang, source, t) for t in terms)
        want_docs.update({(lang, source, t) for t in terms})
    assert (n, docs) == (want_n, want_docs)
