import random
from collections import Counter
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from bookloom.llm import packing as P

TEXTS = [None, "", "a", "Hello there, it's a test's 'story'.", "\n\n  x", "word " * 5000, "é" * 100, "tab\tand  two", "<|endoftext|>", "x" * 3000, "a", "a"]


def library(as_text):
    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = as_text
    return t


@pytest.fixture(scope="module")
def plain():
    return library(False)


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_equal_the_library(as_text, monkeypatch):
    plain = library(as_text)
    r = random.Random(3)
    parts = ["a", "Zé", "ß", "1²", "½", "_", "'", "'s", "'re", "'ll", "'ve", "'S", " ", "  ", "\n", "\r\n", "\xa0", "\x85", "\x1c", "​", "!", "中文", "😀", "́", "<|endoftext|>", " the", "''s", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [t or "" for t in TEXTS]
    monkeypatch.setattr(P, "MEMORY", 900)  # forgets along the way
    own = P.PieceTokenizer(P.default_tokenizer(), as_text)
    for merger in (own.merger, None):
        own.merger = merger
        own.forget()
        for at in range(0, len(texts), 50):
            ids, counts = own.encode(texts[at : at + 50])
            want = [e.ids for e in plain.encode_batch(texts[at : at + 50], add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_ids_of_all_planes_equal_the_library(plain):
    r = random.Random(11)
    own = P.PieceTokenizer(P.default_tokenizer())
    kinds = [[c for c in P.np.flatnonzero(own.classes == k).tolist() if not 0xD800 <= c < 0xE000] for k in range(4)]
    ends = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'x", "1", "a", " ", "!", ""]
    char = lambda: chr(r.choice(kinds[r.choice((0, 1, 1, 1, 2, 3))]))
    known = ["\U000105c2'm", "\U000105ef't", "\U00010d83's"]
    for _ in range(25):
        texts = known + ["".join(char() + r.choice(ends) for _ in range(r.randint(1, 4))) for _ in range(4000)]
        ids, counts = own.encode(texts)
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    cap = r.choice([10, 50, 2048])
    lengths = [r.randint(1, cap) for _ in range(r.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, placed = {}, {n: set() for n in counts}
    for length, rank, many, each, first, at in P.best_fit_plan(counts, cap):
        for k in range(many * each):
            assert rank + k not in placed[length]
            placed[length].add(rank + k)
            fill.setdefault(first + k // each, []).append((at + k % each * length, length))
    assert all(placed[n] == set(range(c)) for n, c in counts.items())
    for spans in fill.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= cap
    bins = []
    for n in sorted(lengths, reverse=True):  # best fit, longest first, document by document
        fits = [i for i, b in enumerate(bins) if b + n <= cap]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    assert len(fill) == len(bins)


def test_query(spark, tmp_path, plain):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op2_packing(spark, str(tmp_path)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for k in range(len(by_doc[i])):
            r = by_doc[i][k]
            part = np.array(ids[at : at + r.length], "<u4")
            assert r.start == at and r.ids_crc32 == zlib.crc32(part.tobytes()) and (k == 0 or r.length == 2048 or len(ids) <= 2048)
            at += r.length
        assert at == len(ids)
    for spans in by_seq.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048


def test_control_string(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "a")], "doc_id long, text string")
    ids = {(r.doc_id, t): r.ids for t in (False, True) for r in P.token_pieces(df, ["doc_id"], as_text=t).collect()}
    assert 50256 in ids[1, False] and 50256 not in ids[1, True] and ids[2, False] == ids[2, True]


def test_clashing_names_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)] * 3 + [(None, None, 5, 6, 7)], "doc_id long, text string, length int, _s_row int, block int")
    rows = P.packed(df, ["doc_id", "length", "_s_row", "block"]).collect()
    assert sorted((r.doc_id or 0, r.length_, r["_s_row"], r.block, len(r.ids), r.length) for r in rows) == [(0, 5, 6, 7, 1, 1)] + [(1, 5, 6, 7, 3, 3)] * 3
    assert sorted(r.offset for r in rows) == [0, 3, 6, 9]


def test_very_long_text(spark):
    text = "some words, and more 12 of them\n" * 330_000  # 10 MB
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    rows = P.packed(df, ["doc_id"], form="crc32").orderBy("doc_id", "piece").collect()
    one = [r for r in rows if r.doc_id == 1]
    own = library(False).encode("some words, and more 12 of them\n" * 2, add_special_tokens=False).ids
    assert sum(r.length for r in one) == len(own) // 2 * 330_000 + 1 and all(r.length == 2048 for r in one[1:])


def test_empty(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_ids_and_digests_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    key = lambda r: (r.doc_id, r.piece)
    whole = {key(r): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in P.token_pieces(df, ["doc_id"]).collect()}
    assert whole == {key(r): zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in P.token_pieces(df, ["doc_id"], form="packed").collect()}
    assert whole == {key(r): r.ids_crc32 for r in P.token_pieces(df, ["doc_id"], form="crc32").collect()}


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_PIECES", 3)
    df = spark.createDataFrame([(i, "word " * (i % 5)) for i in range(200)], "doc_id long, text string")
    rows = P.packed(df, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) == -(-sum(ends.values()) // 2048)


def test_reading_blocks_hold_sources_by_share(spark):
    from bookloom.llm.mixing import mixing_stage

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(r.randint(5, 200))), "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "small") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = P.written(mixing_stage(spark, docs, ""), "mixed")
    source = dict((i, s) for i, _, s in rows)
    got = P.packed(mixed, ["doc_id"], block_tokens=80_000).collect()
    total, by_block, sequences = Counter(), {}, {}
    for x in got:
        total[source[x.doc_id]] += x.length
        by_block.setdefault(x.block, Counter())[source[x.doc_id]] += x.length
        sequences.setdefault(x.sequence_id, set()).add((x.block, x.key))
    assert sorted(by_block) == list(range(-(-sum(total.values()) // 80_000))) and all(len(s) == 1 for s in sequences.values())
    assert len({k for s in sequences.values() for _, k in s}) == len(sequences)
    for c in by_block.values():
        for s, n in total.items():
            assert abs(c[s] / sum(c.values()) - n / sum(total.values())) < 0.06
