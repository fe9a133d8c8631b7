import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bookloom.operators import language as L

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    out, low = " ", (text or "").lower()
    for c in low:
        out += c if c.isalpha() else "" if out[-1] == " " else " "
    out = out.rstrip(" ") + " "
    return [out[i : i + 3] for i in range(len(out) - 2)]


def test_scores_equal_brute_force(spark):
    rows = [("der die das und", "de"), ("the and of the", "en"), ("el la los, las!", "es"), (None, "en"), ("x", None), ("ünd 😀 the", "de")]
    model = L.train(spark.createDataFrame(rows, "text string, lang string"), least=1)
    assert model.languages == ("de", "en", "es")
    counts = {x: Counter(g for t, y in rows if y == x for g in brute_grams(t)) for x in model.languages}
    code = lambda g: (ord(g[0]) * L._SPAN + ord(g[1])) * L._SPAN + ord(g[2])
    grams = {g for c in counts.values() for g in c}
    assert sorted(map(code, grams)) == model.grams.tolist()
    for g in grams:
        want = [math.log((counts[x][g] + 0.5) / sum(counts[x].values())) for x in model.languages]
        assert np.allclose(model.weights[np.searchsorted(model.grams, code(g))], want)
    tests = ["the dog", "der Hund und", "las casas", "", None, "123", "🙂"]
    got = {r.i: (r.detected, r.margin) for r in L.predict(spark.createDataFrame(list(enumerate(tests)), "i int, text string"), model).collect()}
    for i, t in enumerate(tests):
        own = [g for g in brute_grams(t)]
        if not own:
            assert got[i] == (None, 0.0)
            continue
        scores = [sum(math.log((counts[x][g] + 0.5) / sum(counts[x].values())) for g in own if g in grams) / len(own) for x in model.languages]
        order = sorted(range(3), key=lambda k: -scores[k])
        assert got[i][0] == model.languages[order[0]] and math.isclose(got[i][1], scores[order[0]] - scores[order[1]], abs_tol=1e-9)


def test_held_out_accuracy_and_bounded_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = L.train(docs.where(~held), grams=2000)
    assert len(model.grams) == 2000
    rows = L.predict(docs.where(held), model).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [r.detected == r.lang for r in rows if r.detected]
    assert len(right) > 150 and sum(right) / len(right) > 0.95


def test_decisions(spark):
    docs = spark.createDataFrame([("the house and the garden of", "eng"), ("the house and the garden of", "de"), ("short", "fre"), (None, None)], "text string, lang string")
    train = spark.createDataFrame([("the house and the garden of a man", "en"), ("das Haus und der Garten eines Mannes", "de")], "text string, lang string")
    got = [tuple(r.decision) for r in L.decided(docs, L.train(train, least=1)).collect()]
    assert got == [("en", "tag_match"), ("en", "detected"), ("fr", "tag_fallback"), ("", "tag_fallback")]


def test_nothing_to_learn_from(spark):
    model = L.train(spark.createDataFrame([], "text string, lang string"))
    assert L.predict(spark.createDataFrame([("some text",)], "text string"), model).first().detected is None


def test_long_text_in_steps(spark, monkeypatch):
    monkeypatch.setattr(L, "STEP", 50)
    texts = ["abc " * 400, "d", "", "abc abc"]
    assert list(L._steps(texts)) == [(0, 1), (1, 4)]
    model = L.Model(("x",), np.array([(97 * L._SPAN + 98) * L._SPAN + 99]), np.array([[2.0]]))
    scores, n = model.scores([" " + t.strip() + " " for t in texts])
    assert n.tolist() == [1600 - 1, 1, 0, 7] and math.isclose(scores[0, 0], 400 * 2 / 1599)


def test_query_on_the_held_out_fold(spark):
    from bookloom.plans import queries

    rows = queries.queries()["detected_languages"](spark, SF).collect()
    tags = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(tags) and sum(r.detected == tags[r.doc_id] for r in held) > 0.95 * len(held)
    assert all((r.method == "tag_match") == (r.detected == tags[r.doc_id]) for r in rows if r.method != "tag_fallback")
