import io
import json
import os
import zipfile

import pytest

from bookloom.sources import archive_source as A


def archive(path, entries, stored=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    archive(tmp_path / "in" / "a.zip", [("x.fb2", b"one"), ("Y.FB2", b"two"), ("note.txt", b"no"), ("dir/", b"")])
    archive(tmp_path / "in" / "sub" / "b.ZIP", [(f"{i:03}.fb2", os.urandom(2000)) for i in range(200)], stored=True)
    (tmp_path / "in" / "broken.zip").write_bytes(b"PK\x03\x04 not an archive")
    (tmp_path / "in" / "plain.fb2").write_bytes(b"a bare document")
    return tmp_path / "in"


def test_entries_and_errors(spark, shelf):
    rows = A.read_archives(spark, str(shelf)).collect()
    assert sorted((r.entry, bytes(r.content)) for r in rows if r.archive.endswith("a.zip")) == [("Y.FB2", b"two"), ("x.fb2", b"one")]
    assert sum(r.archive.endswith("b.ZIP") for r in rows) == 200 and len(rows) == 203
    (bad,) = [r for r in rows if r.error]
    assert bad.archive.endswith("broken.zip") and bad.entry is None and bad.error.startswith("unreadable archive")


def test_one_archive_is_read_by_several_tasks(spark, shelf):
    whole = A.read_archives(spark, str(shelf / "sub"), splitBytes=64 << 10)
    assert whole.rdd.getNumPartitions() >= 6
    rows = whole.collect()
    assert len(rows) == 200 == len({r.entry for r in rows}) and all(r.size == len(r.content) == 2000 for r in rows)
    per_task = whole.groupBy(A.F.spark_partition_id()).count().collect()
    assert len(per_task) >= 6 and max(r["count"] for r in per_task) < 60


def test_conditions_choose_archives_and_entries(spark, shelf):
    reader = A.ArchiveReader(A._Options({"path": str(shelf), "splitBytes": "1000"}))
    name = str(shelf / "a.zip")
    left = list(reader.pushFilters([A.EqualTo(("archive",), name), A.In(("entry",), ("x.fb2", "z.fb2")), A.StringStartsWith(("entry",), "x")]))
    assert len(left) == 2 and all(f.attribute == ("entry",) for f in left)
    parts = reader.partitions()
    assert {a for p in parts for a, _, _ in p.value} == {name}  # no other archive is opened
    assert [r["entry"] for p in parts for b in reader.read(p) for r in b.to_pylist()] == ["x.fb2"]
    df = A.read_archives(spark, str(shelf))
    got = df.where((df.archive == name) & (df.entry == "x.fb2")).collect()
    assert [(r.entry, bytes(r.content)) for r in got] == [("x.fb2", b"one")]
    plan = df.where(df.archive == name)._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan book_archives" in plan and "Filter " not in plan  # the source answers the whole condition
    assert df.where(df.entry.endswith("9.fb2")).count() == 20 and df.where(df.entry.isNull()).count() == 1


def test_unpacked_only_up_to_the_limit(spark, tmp_path):
    archive(tmp_path / "a.zip", [("big.fb2", b"x" * 5000), ("small.fb2", b"y")])
    got = {r.entry: (r.error, r.content and bytes(r.content)) for r in A.read_archives(spark, str(tmp_path), maxBytes=100).collect()}
    assert got == {"big.fb2": ("too large", None), "small.fb2": (None, b"y")}
    names = A.read_archives(spark, str(tmp_path), content=False).collect()
    assert sorted((r.entry, r.size, r.content) for r in names) == [("big.fb2", 5000, None), ("small.fb2", 1, None)]
    assert A.read_archives(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("sizes, split", [([10, 10, 10], 25), ([100, 1, 1], 30), ([0, 0], 5), ([], 5), ([64], 64)])
def test_plan_covers_every_byte_once(sizes, split):
    found = A.plan([(str(i), s) for i, s in enumerate(sizes)], split)
    for i, s in enumerate(sizes):
        ranges = sorted((lo, hi) for p in found for a, lo, hi in p.value if a == str(i))
        assert ranges[0][0] == 0 and ranges[-1][1] >= 1 << 62 and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
        assert len(ranges) == max(1, -(-s // split))
    assert all(sum(min(hi, sizes[int(a)]) - lo for a, lo, hi in p.value) <= split for p in found)


def test_lookup_with_bare_files(spark, shelf):
    wanted = [(str(shelf / "a.zip"), "x.fb2"), (str(shelf / "a.zip"), "x.fb2"), (str(shelf / "a.zip"), "none.fb2"), (str(shelf / "plain.fb2"), "whatever"), (str(shelf / "gone.zip"), "x"), (None, "x"), ("file:" + str(shelf / "sub" / "b.ZIP"), "007.fb2")]
    got = {(os.path.basename(r.archive), r.entry): (r.content and bytes(r.content)[:20], r.error) for r in A.fetch_entries(spark.createDataFrame(wanted, "archive string, entry string")).collect()}
    assert len(got) == 5
    assert got["a.zip", "x.fb2"] == (b"one", None) and got["plain.fb2", "whatever"] == (b"a bare document", None)
    assert got["a.zip", "none.fb2"] == (None, "file not found in archive") and got["gone.zip", "x"][1].startswith("unreadable")
    assert len(got["b.ZIP", "007.fb2"][0]) == 20


def test_stream_goes_on_after_a_stop_without_repeats(spark, tmp_path):
    src, log, seen = tmp_path / "in", str(tmp_path / "log"), []
    src.mkdir()

    def run(fail_at=None):
        def take(df, n):
            rows = [(n, os.path.basename(r.archive), r.entry) for r in df.collect()]
            if n == fail_at:
                raise RuntimeError("killed")
            seen.extend(rows)

        q = A.stream_archives(spark, str(src), log, maxArchives=2).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(take).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:
            assert "killed" in str(e)

    for k in range(2):
        archive(src / f"{k}.zip", [("a.fb2", b"1"), ("b.fb2", b"2")])
    run()
    archive(src / "2.zip", [("c.fb2", b"3")])
    (src / "3.zip").write_bytes(b"junk")
    run(fail_at=1)
    assert {n for n, *_ in seen} == {0}
    archive(src / "4.zip", [("d.fb2", b"4")])
    for _ in range(3):
        run()
    assert sorted((a, e or "") for _, a, e in seen) == [("0.zip", "a.fb2"), ("0.zip", "b.fb2"), ("1.zip", "a.fb2"), ("1.zip", "b.fb2"), ("2.zip", "c.fb2"), ("3.zip", ""), ("4.zip", "d.fb2")]
    logged = [json.loads((tmp_path / "log" / n).read_bytes()) for n in sorted(os.listdir(log))]
    assert len({a for batch in logged for a, _ in batch}) == sum(map(len, logged)) == 5


def test_written_archives_read_back(spark, tmp_path):
    rows = [(f"shelf{i % 3}.zip", f"{i}.fb2", f"text {i}".encode()) for i in range(30)]
    made = A.write_archives(spark.createDataFrame(rows, "archive string, entry string, content binary"), str(tmp_path / "out")).collect()
    assert sorted((os.path.basename(r.archive), r.entries) for r in made) == [(f"shelf{k}.zip", 10) for k in range(3)]
    assert sorted(os.listdir(tmp_path / "out")) == ["shelf0.zip", "shelf1.zip", "shelf2.zip"]
    got = sorted((os.path.basename(r.archive), r.entry, bytes(r.content)) for r in A.read_archives(spark, str(tmp_path / "out")).collect())
    assert got == sorted(rows)
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "out" / "shelf0.zip").read_bytes())).testzip() is None
