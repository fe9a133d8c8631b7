import random
import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from bookloom.operators import state as batch
from bookloom.streaming import keyed as K
from bookloom.streaming import state as S


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def feed(spark, tmp_path, stream_of, parts, schema, mode, clock=False):
    """Rows that a stream gives batch by batch for parts, each written after the one before was taken.

    clock: the state's lifetime goes by the clock; such a query never ends by itself and is stopped when it has read the part.
    """
    got, src = [], tmp_path / "in"
    src.mkdir()
    stream = stream_of(spark.readStream.schema(schema).parquet(str(src)))
    for k, part in enumerate(parts):
        write(spark, part, schema, src)
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n, k=k: got.extend((k, r) for r in df.collect()))
        if not clock:
            w.trigger(availableNow=True).start().awaitTermination()
            continue
        q, end = w.start(), time.time() + 40
        while time.time() < end and sum(p.numInputRows for p in q.recentProgress) < len(part):
            time.sleep(0.2)
        q.stop()
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limit_in_any_order_equals_batch(spark, tmp_path, seed):
    r, t0 = random.Random(seed), datetime(2024, 1, 1)
    rows = [(k, t0 + timedelta(seconds=r.choice((3, 7, 7, 50)) * i, microseconds=r.choice((0, 500)))) for k in (1, 2, 3) for i in range(40)]
    rows += rows[:5]  # the same instant more than once
    schema = "key long, ts timestamp"
    want = Counter((x.key, x.ts, x.window_start, x["count"], x.allowed) for x in batch.fixed_windows(spark.createDataFrame(rows, schema)).collect())
    shuffled = sorted(rows, key=lambda x: x[1].timestamp() + r.uniform(0, 500))  # later than others by less than the delay
    end = [[(9, t0 + timedelta(hours=h))] for h in (5, 6)]
    got = feed(spark, tmp_path, lambda s: K.rate_limit(s), [shuffled[:40], shuffled[40:80], shuffled[80:], *end], schema, "append")
    assert Counter((x.key, x.ts, x.window_start, x["count"], x.allowed) for _, x in got if x.key != 9) == want
    assert len({k for k, _ in got}) > 1  # what the watermark has passed does not wait for the end


def test_late_events_count_nowhere(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda s: (1, t0 + timedelta(seconds=s))
    got = feed(spark, tmp_path, lambda s: K.rate_limit(s, delay="10 seconds"), [[at(0), at(30)], [at(5), at(31)], [at(8), at(900)], [at(2000)]], "key long, ts timestamp", "append")
    assert [(int((x.ts - t0).total_seconds()), x["count"]) for _, x in got] == [(0, 1), (30, 2), (31, 3), (900, 1)]


def test_user_states_live_and_end(spark, tmp_path):
    r, t0 = random.Random(3), datetime(2024, 1, 1)
    rows = [(r.randint(1, 9), t0 + timedelta(seconds=r.randint(0, 9000)), r.choice(("search", "author", "", None))) for _ in range(150)]
    schema = "key long, ts timestamp, state string"
    now = t0 + timedelta(seconds=10_000)
    want = {x.key: x.state for x in batch.user_states(spark.createDataFrame(rows, schema), now).collect()}
    shuffled = sorted(rows, key=lambda x: x[1].timestamp() + r.uniform(0, 500))
    parts = [shuffled[:60], shuffled[60:], [(99, now + timedelta(minutes=10), "x")], [(98, t0, "late")]]
    last = {}
    for _, x in feed(spark, tmp_path, lambda s: K.user_states(s), parts, schema, "update"):
        last[x.key] = x.state
    assert {k: s for k, s in last.items() if s and k < 90} == want and want and len(last) > len(want)


def test_conversations_in_any_order_equal_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, i, "user" if i % 2 == 0 else "bot", r.choice("xé") * r.choice((0, 10, 900, 5000))) for c in range(6) for i in range(20)] + [(7, 0, None, None)]
    schema = "conv_id long, turn long, role string, text string"
    want = {(x.conv_id, x.turn, x.text) for x in batch.trim_conversations(spark.createDataFrame(rows, schema)).collect()}
    r.shuffle(rows)
    last = {}
    for k, x in feed(spark, tmp_path, lambda s: K.bounded_conversations(s), [rows[:30], rows[30:75], rows[75:]], schema, "update", clock=True):
        at, kept = last.get(x.conv_id, (k, set()))
        last[x.conv_id] = (k, (kept if at == k else set()) | {(x.conv_id, x.turn, x.text)})
    assert set().union(*(kept for _, kept in last.values())) == want


def test_members_of_live_sets(spark, tmp_path):
    schema = "key string, nth long, action string, member string, value string"
    one = [("ann", 1, "add", "t1", "a"), ("ann", 2, "add", "t2", None), ("bob", 3, "add", "t3", "b"), ("ann", 4, "has", "t1", None), ("ann", 5, "remove", "t1", None), ("ann", 6, "has", "t1", None), ("bob", 7, "has", "t9", None)]
    two = [("ann", 8, "has", "t2", None), ("bob", 9, "clear", None, None), ("bob", 10, "has", "t3", None), ("eve", 11, "has", "t1", None)]
    got = {x.nth: (x.live, x.value) for _, x in feed(spark, tmp_path, K.live_sets, [one, two], schema, "append", clock=True)}
    assert got == {4: (True, "a"), 6: (False, None), 7: (False, None), 8: (True, ""), 10: (False, None), 11: (False, None)}


def test_members_of_live_sets_end(spark, tmp_path):
    schema = "key string, nth long, action string, member string, value string"
    got = {x.nth: x.live for _, x in feed(spark, tmp_path, lambda s: K.live_sets(s, ttl_ms=1), [[("a", 1, "add", "t", "v")], [("a", 2, "has", "t", None)]], schema, "append", clock=True)}
    assert got == {2: False}


def test_archives_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    stream = S.new_archives(spark, str(tmp_path / "in"))
    for name in ("a.zip", "b.ZIP"):
        (tmp_path / "in" / name).write_bytes(b"z")
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(r.archive.rsplit("/", 1)[1] for r in df.collect())).start()
        q.awaitTermination()
    assert sorted(seen) == ["a.zip", "b.ZIP"]


def test_progress(spark, tmp_path):
    schema = "session string, event_type string, ts timestamp"
    (tmp_path / "in").mkdir()
    write(spark, [("s", "scan", datetime(2024, 1, 1, tzinfo=timezone.utc))] * 3, schema, tmp_path / "in")
    got = []
    q = S.progress(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    q.awaitTermination()
    assert [(r.session, r.n) for r in got] == [("s", 3)]
