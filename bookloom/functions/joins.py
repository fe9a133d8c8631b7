"""Joins of rows that may pile up on few keys with tables that have each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions.storage import free_name

#: Keys over which the rows of one key are spread.
SALTS = 16


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows.join(table, on), where a key of rows may hold any share of them: by (columns of rows) deals them to copies of table's row."""
    salt = free_name("_salt", [*rows.columns, *table.columns])
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, salt], how).drop(salt)
