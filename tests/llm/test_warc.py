import hashlib

from bookloom.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = h in first and first[h] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


ROWS = [(i, f"http://x/{i % 7}", ("<p>é copy</p>" * 20 if i % 3 == 0 else f"<p>{i}</p>" * (i % 60)), "d") for i in range(400)]
ROWS += [(900, None, None, "d"), (901, "a b\nc", "", "d"), (902, "u", "\r\n\r\n" * 50, "d"), (903, "u", "x" * 300_000, "d"), (903, "u", "x" * 300_000, "d"), (None, "n", "y" * 200, "d")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    out = f"file://{tmp_path}/w"
    manifest = W.write_warc(df, out, shards=4, roll_bytes=3000).collect()
    assert len(manifest) > 4 and sum(r.records for r in manifest) == len(ROWS)
    for r in manifest:
        data = (tmp_path / "w" / r.file).read_bytes()
        assert len(data) == r.file_bytes and hashlib.sha256(data).hexdigest() == r.file_sha256
    back = W.read_warc(spark, out).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == brute(ROWS)
    whole = {r.payload_digest: r.payload for r in back if r.record_type == "response"}
    assert all(hashlib.sha256(p).hexdigest() == d for d, p in whole.items())


def test_same_files_again(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a = W.write_warc(df.repartition(3), f"file://{tmp_path}/a", shards=3, roll_bytes=5000).select("file", "file_sha256").collect()
    b = W.write_warc(df.repartition(7), f"file://{tmp_path}/b", shards=3, roll_bytes=5000).select("file", "file_sha256").collect()
    assert sorted(a) == sorted(b)
    assert not list((tmp_path / "a" / "_temporary").iterdir())


def test_empty(spark, tmp_path):
    out = f"file://{tmp_path}/e"
    assert W.write_warc(spark.createDataFrame([], SCHEMA), out).count() == 0
    assert W.read_warc(spark, out).count() == 0


def test_very_long_page(spark, tmp_path):
    rows = [(i, "u", "<p>many words</p>" * 650_000 + "x" * (i // 2), "d") for i in range(4)]  # 10 MB each
    out = f"file://{tmp_path}/l"
    W.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), out)
    back = W.read_warc(spark, out).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == brute(rows)


def test_clashing_names(spark, tmp_path):
    more = ["payload", "record_type", "refers_to", "file", "shard", "key", "size", "data", "first", "_html", "payload_digest"]
    rows = [(i, f"u{i}", f"<p>{i % 3}</p>" * 40, *"x" * len(more)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in more))
    out = f"file://{tmp_path}/c"
    W.write_warc(df, out)
    back = W.read_warc(spark, out).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == brute([(*r[:3], "d") for r in rows])
