"""A set of keys as a bitmap of fixed size: made by Spark's bitmap aggregates, tested by numpy in workers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB; the more keys, the more others are named by chance
MOST = 1 << 29  # 64 MB


def place(key: Column, bits: int = BITS) -> Column:
    """The key's bit, counted from 1, as the aggregates do."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def enough(keys: DataFrame) -> int:
    """Bits for which one other key in some thirty is named by chance: 32 a key, 128 kB to 64 MB."""
    return 1 << max(20, min(MOST.bit_length() - 1, (32 * keys.count()).bit_length()))


def bitmap(keys: DataFrame, column: str, bits: int = BITS, own: bool = False) -> Broadcast:
    """The broadcast bitmap that names every value of the column (own: the values are bits, from 0). At most bits / 32768 rows of 4 kB reach the driver."""
    rows = keys.select((F.col(column) + 1 if own else place(F.col(column), bits)).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    table = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows.collect():
        table[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def named(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    p = places - 1
    return (table[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't among ids (one column of that name; rows without a key stay).

    The bitmap lets most rows pass where they are; only those it names are shuffled for the join.
    """
    shared = bitmap(ids, key)

    @F.pandas_udf("boolean")
    def is_named(p: pd.Series) -> pd.Series:
        return pd.Series(named(shared.value, p.to_numpy()))

    asked = df.withColumn("__named", is_named(place(F.coalesce(F.col(key), F.lit(0).cast(df.schema[key].dataType)))) & F.col(key).isNotNull())
    return asked.where(~F.col("__named")).drop("__named").unionByName(asked.where("__named").drop("__named").join(ids, key, "left_anti").select(*df.columns))
