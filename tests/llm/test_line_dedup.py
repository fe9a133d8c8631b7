import random

import pyarrow as pa
import pytest

from bookloom.llm import line_dedup as D


def brute(rows):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(strip))
    holders = {}
    low = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20:
                holders.setdefault(key(s), set()).add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(holders.get(key(s), ())) >= 3 and max(holders[key(s)]) != low(i))]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=repr)


def table(seed):
    r = random.Random(seed)
    pool = [f"a line that is long enough number {k}" for k in range(12)] + ["short", "", "  \t", "É" * 20, "THIS LINE SHOUTS VERY LOUD\r"]
    rows = [(i, "\n".join(r.choice(pool[: r.randint(1, len(pool))]) + " " * r.randint(0, 2) for _ in range(r.randint(0, 9)))) for i in range(150)]
    return rows + [(1000, None), (1001, ""), (None, pool[0] + "\nown line"), (3, pool[1] + "\n" + pool[1]), (1002, ("x" * 50000 + "\n") * 3), rows[5], rows[5]]


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7), (3, 40)])
def test_against_brute_force(spark, seed, parts):
    rows = table(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = D.apply_bitmaps(df, D.keep_bitmaps(df))
        assert cut.columns == [*df.columns, "n_dropped"]
        assert sorted(((r.doc_id, r.text or "", r.n_dropped) for r in cut.collect()), key=repr) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_streams_over_batches(size):
    rows = [(b"k" * 16, d, 0, 0) for d in (9, 8)] + [(b"m" * 16, d, 0, p) for d in (9, 7, 5, 4) for p in (0, 1)] + [(b"n" * 16, 3, 0, 0), (b"n" * 16, 2, 0, 0)]
    schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32())])
    whole = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    out = [r for b in D.stream_first(whole.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
    assert sorted((r["doc"], r["pos"]) for r in out if r["kind"] == 0) == sorted((d, p) for d in (7, 5, 4) for p in (0, 1))
    assert sorted((r["key"], r["doc"], r["n"]) for r in out if r["kind"] == 1) == [(b"k" * 16, 8, 1), (b"k" * 16, 9, 1), (b"n" * 16, 2, 0)]
    assert [(r["key"], r["doc"], r["n"]) for r in out if r["kind"] == 2] == [(b"n" * 16, 3, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.apply_bitmaps(df, D.keep_bitmaps(df)).count() == 0


def test_stage_and_clashing_names(spark):
    line, own = "this line stands in many documents", " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{line}\n{own}{i}", 1, "a", "b", 7) for i in range(3)] + [(8, line, 1, "a", "b", 7), (9, line, 1, "a", "b", 7), (4, "few words", 1, "a", "b", 7), (5, None, None, "a", "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _keep string, _L_doc string, n_dropped int")
    out = D.line_dedup_stage(spark, df, "")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == [0, 1, 2, 4, 5, 9]  # 8 has nothing of its own; 9 keeps the line
    assert got[0].text == f"{own}0" and got[0].n_chars == len(got[0].text) and (got[0]["_keep"], got[0]["_L_doc"], got[0].n_dropped) == ("a", "b", 7)
    assert D.apply_bitmaps(df, D.keep_bitmaps(df)).columns == [*df.columns, "n_dropped_"]


def test_very_long_text(spark):
    long = "\n".join(f"line number {i} of a text of many megabytes" for i in range(230_000))  # 10 MB
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "\nan end of its own, of twenty")], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.n) for r in D.apply_bitmaps(df, D.keep_bitmaps(df)).selectExpr("doc_id", "n_dropped", "length(text) AS n").collect()}
    assert got == {1: (230_000, 0), 2: (230_000, 0), 3: (0, len(long) + 29)}
