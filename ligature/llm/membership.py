"""Filters of fixed size for the rows that a small set of keys may concern, so that only these are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def bit_of(key: str):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(1 << BITS))


def bit_of_hash(key: str):
    """The bit of a column that is itself a hash."""
    return F.col(key).bitwiseAND(F.lit((1 << BITS) - 1))


def members(ids: DataFrame, key: str = "id", bit: Column | None = None) -> np.ndarray:
    """A bit for the hash of each value of key, as 32-bit words. What reaches the driver has a fixed bound."""
    bit = bit_of(key) if bit is None else bit
    words = ids.select(F.shiftright(bit, 5).cast("int").alias("w"), F.pmod(bit, F.lit(32)).cast("int").alias("b"))
    found = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return out


def has(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (words[bits >> 5] >> (bits & 31).astype(np.uint32)) & 1 == 1


def has_hash(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return has(words, (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64))


def marked(rows: DataFrame, ids: DataFrame, key: str, name: str = "_in") -> DataFrame:
    """rows with a column that is false only where key surely is not among ids (a column of the same name)."""
    shared = rows.sparkSession.sparkContext.broadcast(members(ids, key))

    @F.pandas_udf("boolean")
    def among(bit: pd.Series) -> pd.Series:
        return pd.Series(has(shared.value, bit.to_numpy()))

    return rows.withColumn(name, among(bit_of(key)))
