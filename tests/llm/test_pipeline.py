from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from bookloom.llm.packing import default_tokenizer
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_quality import brute as brute_counts

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for _, stage in P.STAGES[:-1]:
        held.append(P.written(stage(spark, held[-1], SF), "test"))
        assert held[-1].columns == docs.columns and held[-1].dtypes == docs.dtypes
    texts = [{r.doc_id: r.text for r in h.collect()} for h in held]
    for i, t in texts[0].items():
        n, _, _, _, again = brute_counts(t)
        assert not (i in texts[1] and (n < 50 or 100 * again > 50 * n))
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert all(i in texts[1] for i in good if i in texts[0] and brute_counts(texts[0][i])[0] >= 50 and 2 * brute_counts(texts[0][i])[4] <= brute_counts(texts[0][i])[0])
    assert sorted(texts[2].items()) == sorted((i, t) for i, t, n in brute_lines(sorted(texts[1].items())) if not n or brute_counts(t)[0] >= 50)
    assert all(brute_counts(t)[0] >= 50 for t in texts[2].values())
    assert sorted(texts[3]) == sorted({c for _, _, c in brute_groups(sorted(texts[2].items()), 5, 80)})
    assert texts[4] == texts[3]
    read = Counter(r.doc_id for r in held[4].select("doc_id").collect())
    assert set(read.values()) <= {1, 2, 3}
    rows = P.STAGES[-1][1](spark, held[4], SF).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == read
    ids = {}
    for r in sorted(rows, key=lambda r: r.piece):
        assert 2 * r.length == len(r.ids)
        ids.setdefault(r.doc_id, {})[r.piece] = np.frombuffer(r.ids, "<u2").tolist()
    own = Tokenizer.from_file(default_tokenizer())
    own.encode_special_tokens = True
    for i, parts in ids.items():
        assert [x for k in sorted(parts) for x in parts[k]] == own.encode(texts[4][i], add_special_tokens=False).ids + [0]
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 2048


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
