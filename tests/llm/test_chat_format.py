import hashlib

from bookloom.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, example int"


def test_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "%25 %3C| <|end|><|body|>", "<|", "|><<SYS>>", "", None, "a%", "😀<s>\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "only a question", 0), (None, 0, None, None, 0), (3, 1, "assistant", "x", 1), (3, 1, "assistant", "x", 1)]
    got = {r.conv_id: r for r in C.read_back(C.prefix_target_examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert got[1].losses == [t or "" for t in nasty[1::2]]
    assert got[2].losses == [""] and [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert got[3].losses == ["x", "x"]


def test_examples(spark):
    rows = [(1, 0, "system", "s", 0), (1, 1, "user", "u", 0), (1, 2, "assistant", "one", 0), (1, 3, "user", "v", 0), (1, 4, "assistant", "two", 0), (1, 5, "user", "bye", 0)]
    out = C.prefix_target_examples(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert [(r.n_turns, r.text[r.loss_start : r.loss_end]) for r in out] == [(3, "one"), (5, "two"), (6, "")]
    assert out[1].text.startswith(out[0].text) and out[2].text.startswith(out[1].text)
    assert C.prefix_target_examples(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    got = {r.conv_id: r for r in C.op8_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7].loss_chars == len(said) and got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_very_long_texts_and_conversations(spark):
    long = "</s> many words <| of a text " * 100_000  # 3 MB
    rows = [(1, 0, "user", long, 0), (1, 1, "assistant", long + "!", 0)] + [(2, i, "assistant" if i % 2 else "user", f"turn {i} %", 0) for i in range(400)]
    got = {r.conv_id: r for r in C.read_back(C.prefix_target_examples(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [t.text for t in got[1].turns] == [long, long + "!"] and got[1].losses == [long + "!"]
    assert [t.text for t in got[2].turns] == [f"turn {i} %" for i in range(400)] and got[2].losses == [f"turn {i} %" for i in range(1, 400, 2)]


def test_clashing_names(spark):
    more = ["n_turns", "loss_start", "loss_end", "turns", "losses", "said", "at", "_text", "Turn_"]
    rows = [(1, 0, "user", "u", *"x" * len(more)), (1, 1, "assistant", "a", *"x" * len(more))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in more))
    (r,) = C.read_back(C.prefix_target_examples(df)).collect()
    assert [(t.role, t.text) for t in r.turns] == [("user", "u"), ("assistant", "a")] and r.losses == ["a"]
