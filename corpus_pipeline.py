"""A corpus from raw documents to packed training sequences, in stages that are written and read again.

Each stage takes the documents that its predecessor kept and returns documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookloom.llm.common import written
from bookloom.llm.line_dedup import line_dedup_stage
from bookloom.llm.mixing import mixing_stage
from bookloom.llm.ngram_join import ngram_join_stage
from bookloom.llm.packing import packing_stage
from bookloom.llm.quality import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has no shingle components or token packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
