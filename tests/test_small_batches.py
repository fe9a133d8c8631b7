import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookloom.functions.storage import ARROW_BYTES
from bookloom.operators import book_ingest, ingest, language
from bookloom.sources.archive_source import write_archives

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT, BOOK = "doc_id long, text string, lang string", "archive string, entry string, content binary, path string, data binary"


@pytest.mark.parametrize("name, schema, call", [
    ("decoded", BOOK, ingest.decoded),
    ("gram_counts", TEXT, language.gram_counts),
    ("predict", TEXT, lambda df: language.predict(df, language.Model((), [], []))),
    ("write_archives", BOOK, lambda df: write_archives(df, "/nowhere")),
    ("write_covers", BOOK, lambda df: book_ingest.write_covers(df, "/nowhere")),
])
def test_python_workers_get_small_batches(spark, name, schema, call):
    @F.pandas_udf("long")
    def together(c: pd.Series) -> pd.Series:
        return c.str.len().map(lambda _: int(c.str.len().sum()))

    spark.conf.unset(KEY)
    try:
        call(spark.createDataFrame([], schema))
        texts = spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
        assert texts.select(F.max(together("t"))).first()[0] <= ARROW_BYTES + (1 << 20)
    finally:
        spark.conf.unset(KEY)
