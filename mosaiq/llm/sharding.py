"""Shards by jump consistent hashing.

A key's shard comes from the key and the number of shards alone, without a ring
table; when shards are appended, keys move only into the new ones, and only the
fraction that must. Slots number each shard's rows from 0 without gaps, by ranges
of a hash, so a shard of any size is never sorted in one task.

Null keys hash like key 0 and go to one shard like any other; null text has the
size 1 and the checksum of the empty text; repeated rows get a slot each; an empty
table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.plans.ranking import exclusive_prefix, unit

# Fixed value: the multiplier of the 64-bit generator in the jump hash paper (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard in [0, shards) of each 64-bit key; all keys jump together until none is below ``shards``."""
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while going.size:
            state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
            step = 2.0**31 / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump = ((at[going] + 1) * step).astype(np.int64)
            going, jump = going[jump < shards], jump[jump < shards]
            at[going] = jump
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of an integer key column."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, shard, slot, grown_shard)`` for every row.

    ``size`` is the text's UTF-8 bytes plus 1; ``grown_shard`` is the shard with one more shard.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))
    rows = rows.withColumn("__u", unit(F.xxhash64(key, "text_crc32", "size")))
    return exclusive_prefix(rows, "shard", "__u", [key, "text_crc32", "size"], F.lit(1), "slot").drop("__u")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write whole rows under ``shard=N`` folders; several tasks may write files of one shard."""
    df.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)
