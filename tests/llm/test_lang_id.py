import zlib

import numpy as np

from bookloom.llm import lang_id as L

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = L.Network.new(["a", "b", "c"], 3, rng)
    for w in net.weights():
        w *= 0.5
    x, y = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.probabilities(x).astype(np.float64)
        return -np.mean(np.log(p[:, y, np.arange(5)]))

    for w, g in zip(net.weights(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.op6_lang_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = L.fit(docs)
    long = "the thing and " * 20000
    texts = [None, "", "123 !?", "the and of with", long, long, "é"]
    df = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    rows = {r.doc_id: r for r in L.predict(df, net, ["doc_id"], with_spans=True).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[3].lang_pred == "en"
    assert rows[4][1:] == rows[5][1:] and rows[4].spans[-1].stop == len(long)
    assert L.predict(df, None, ["doc_id"]).where("lang_pred = 'und'").count() == 7
    assert L.fit(df.select("doc_id", "text", L.F.lit(None).cast("string").alias("lang"))) is None
    assert L.predict(df.limit(0), net, ["doc_id"]).count() == 0


def test_windows_cover_the_text():
    texts = [b"", b"a", b"b" * L.WINDOW, b"c" * (L.WINDOW + 1)]
    windows, many, own = L.cut_windows(texts)
    assert many.tolist() == [0, 1, 1, 2] and own.tolist() == [1, L.WINDOW, L.WINDOW, 1] and len(windows) == 4


def test_equal_probabilities_give_the_first_language(spark):
    import numpy as np

    from bookloom.llm import lang_id as M

    net = M.Network.new(["de", "en", "fr"], 4, np.random.default_rng(1))
    for w in net.weights():
        w[...] = 0
    df = spark.createDataFrame([(1, "some text", "x"), (2, None, "y"), (3, "12 3", "z")], "doc_id long, text string, lang_pred_ string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in M.predict(df, net, ["doc_id"]).collect()}
    assert got[1][0] == "de" and abs(got[1][1] - 1 / 3) < 1e-6 and got[2] == got[3] == ("und", 0.0)
