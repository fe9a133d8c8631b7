import glob
import os

import pytest

from bookloom.sources import batches as B


def table(spark, lo, hi, parts=3):
    return spark.range(lo, hi, 1, parts).selectExpr("id", "cast(id * 2 as string) AS v")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_each_number_once(spark, tmp_path):
    store = B.BatchStore(spark, str(tmp_path))
    assert store.read("t", "id long, v string").count() == 0
    assert store.commit(0, {"t": table(spark, 0, 5), "u": table(spark, 0, 2)})
    assert not store.commit(0, lambda: pytest.fail("worked out again"))
    assert store.commit(1, {"t": table(spark, 5, 9), "u": table(spark, 9, 9)})  # a table without rows
    assert ids(store.read("t")) == list(range(9)) and ids(store.read("u")) == [0, 1]
    assert sorted({r.batch for r in store.read("t").collect()}) == [0, 1] and ids(store.read("t", before=1)) == list(range(5))
    with pytest.raises(ValueError):
        store.read("none")


def test_a_table_that_fails_leaves_nothing(spark, tmp_path):
    store = B.BatchStore(spark, str(tmp_path))
    store.commit(0, {"t": table(spark, 0, 5), "u": table(spark, 0, 5)})
    broken = table(spark, 0, 5).selectExpr("id", "raise_error('no') AS v")
    with pytest.raises(Exception, match="no"):
        store.commit(1, {"t": table(spark, 5, 9), "u": broken})
    assert ids(store.read("t")) == list(range(5)) and not glob.glob(f"{tmp_path}/data/*/batch=1/attempt=*")
    assert store.commit(1, {"t": table(spark, 5, 9), "u": table(spark, 5, 9)}) and ids(store.read("u")) == list(range(9))


class Crash(BaseException):
    pass


class Dying(B.BatchStore):
    """Dies after so many writes, the manifest being the last; like a crash it takes nothing away."""

    at_once = 1

    def __init__(self, spark, path, writes):
        super().__init__(spark, path)
        self.left = writes

    def step(self, write):
        if not self.left:
            raise Crash
        self.left -= 1
        write()

    def table(self, df):
        class Table:
            schema = df.schema

            class write:
                parquet = lambda path: self.step(lambda: df.write.parquet(path))

        return Table

    def _publish(self, batch, rows):
        self.step(lambda: super(Dying, self)._publish(batch, rows))
        raise Crash

    def _abort(self, folders):
        pass


@pytest.mark.parametrize("writes", range(4))
def test_a_crash_between_any_two_writes_and_a_retry(spark, tmp_path, writes):
    B.BatchStore(spark, str(tmp_path)).commit(0, {"t": table(spark, 0, 2), "u": table(spark, 0, 2)})
    dying = Dying(spark, str(tmp_path), writes)
    with pytest.raises(Crash):
        dying.commit(1, {"t": dying.table(table(spark, 2, 5)), "u": dying.table(table(spark, 2, 5))})
    again = B.BatchStore(spark, str(tmp_path))
    assert ids(again.read("t")) == (list(range(5)) if writes == 3 else [0, 1])
    assert again.commit(1, {"t": table(spark, 2, 5), "u": table(spark, 2, 5)}) is (writes != 3)
    assert ids(again.read("t")) == ids(again.read("u")) == list(range(5))
    assert again.clean() == (0 if writes == 3 else writes) and ids(again.read("t")) == list(range(5))


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    one, two = B.BatchStore(spark, str(tmp_path)), B.BatchStore(spark, str(tmp_path))
    monkeypatch.setattr(two, "committed", lambda n: False)  # it looked before the first was done
    assert one.commit(7, {"t": table(spark, 0, 3)})
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        two.commit(7, {"t": table(spark, 50, 60)})
    assert ids(one.read("t")) == [0, 1, 2] and one.clean() == 0


def test_a_batch_that_lacks_a_part_is_not_read(spark, tmp_path):
    store = B.BatchStore(spark, str(tmp_path))
    store.commit(0, {"t": table(spark, 0, 6), "u": table(spark, 0, 6)})
    store.commit(1, {"t": table(spark, 6, 9), "u": table(spark, 6, 9)})
    os.remove(sorted(glob.glob(f"{tmp_path}/data/u/batch=1/attempt=*/part-*.parquet"))[0])
    assert ids(store.read("t")) == list(range(6)) and [r.batch for r in store.whole().collect()] == [0]


def test_columns_of_the_newest_batch(spark, tmp_path):
    store = B.BatchStore(spark, str(tmp_path))
    store.commit(0, {"t": table(spark, 0, 2)})
    store.commit(1, {"t": table(spark, 2, 3).selectExpr("id", "v", "1 AS w")})
    assert sorted(map(tuple, store.read("t").collect())) == [(0, "0", None, 0), (1, "2", None, 0), (2, "4", 1, 1)]


def test_stream_repeats_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = B.BatchStore(spark, str(tmp_path / "store"))
    table(spark, 0, 4, 1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(cp):
        stream = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
        B.publish_stream(stream, store, lambda df, n: {"t": df, "n": df.groupBy().count()}, str(tmp_path / cp), finish=True).awaitTermination()

    run("cp")
    table(spark, 4, 6, 1).write.mode("append").parquet(str(tmp_path / "in"))
    run("cp")
    assert ids(store.read("t")) == list(range(6)) and sorted(r["count"] for r in store.read("n").collect()) == [2, 4]
    for p in (f"{tmp_path}/cp/commits/1", f"{tmp_path}/cp/commits/.1.crc"):  # as if it had died before it noted the batch
        os.remove(p)
    run("cp")
    assert ids(store.read("t")) == list(range(6))
