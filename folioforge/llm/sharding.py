"""Sharding by jump consistent hashing.

The shard of a row depends on its key and the number of shards alone, no table of a ring is kept,
and with one shard more, a row either stays or moves into the new shard. Slots number the rows of
each shard without gaps: equal rows are first counted together, counted rows are dealt into blocks by
a hash of all their values, and the blocks' counts give each block its first slot. So no task sees a
whole shard, nor all rows of a key, however many texts the key has.

Null keys are one key; a null text has size 1 (no bytes plus 1) and checksum 0, that of no bytes;
repeated rows get slots of their own; an empty table gives an empty result; other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import written

#: Rows of a block on average, and slots that one row of the last step opens at most.
BLOCK_ROWS, RUN = 50_000, 1000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key (Lamping and Veach), for all keys at once."""
    key = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(moving):
            shard[moving] = ahead[moving]
            key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[moving] >> np.uint64(33)).astype(np.float64) + 1)
            ahead[moving] = ((shard[moving] + 1) * step).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return shard.astype(np.int32)


def with_shards(keyed: DataFrame, shards: int) -> DataFrame:
    """``keyed`` with ``shard`` and ``grown_shard`` (one shard more) of its 64-bit column ``key``."""
    at = keyed.columns.index("key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(jump(keys, shards)), pa.array(jump(keys, shards + 1))], names=[*batch.schema.names, "shard", "grown_shard"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return keyed.mapInArrow(work, f"{schema}, shard int, grown_shard int")


def assign(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(id_col).alias("key"),
    ).withColumn("block", F.pmod(F.xxhash64("id", "size", "text_crc32", F.lit("block")), F.lit(blocks)).cast("long"))
    same = ["shard", "grown_shard", "block", "id", "size", "text_crc32"]
    dealt = written(with_shards(keyed, shards).groupBy(*same).agg(F.count("*").alias("n")), "shards")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "block").agg(F.sum("n").alias("rows")).withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long"))).drop("rows")
    inside = Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long"))).join(offsets, ["shard", "block"])
    # rows that come often are opened in runs, so no array grows with their number
    runs = placed.withColumn("start", F.col("start") + F.col("base")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    first = F.col("start") + F.col("run") * RUN
    last = F.least(F.col("start") + F.col("n"), first + RUN) - 1
    return runs.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, last)).alias("slot"), "grown_shard")
