"""A bit field that says of a key whether it may be in a table of keys.

It keeps most rows that have no partner out of a join whose other side is a large text; the
join decides.  It is made by a grouped sum, and has 16 bits or more for each key that is set, between 128 KB
and 16 MB; beyond eight million keys it lets more rows through, up to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the smallest and the largest field.
LEAST_BITS, BITS = 20, 27


def packed_bits(entries: DataFrame, entry: Column, bits: int) -> np.ndarray:
    """Bits of the distinct values of ``entry``, each below ``2**bits``, as 32-bit words."""
    slot = F.col("_slot").cast("int")
    words = (
        entries.select(entry.alias("_slot"))
        .distinct()
        .groupBy(F.shiftright(slot, 5).alias("word"))
        .agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)))).alias("bits"))
        .toArrow()
    )
    field = np.zeros(1 << (bits - 5), dtype=np.uint32)
    field[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return field


def fitting(field: np.ndarray) -> np.ndarray:
    """The field folded to the least size that has 16 bits for each that is set; slots count modulo its bits."""
    wanted = max(1 << LEAST_BITS, 16 * int(np.bitwise_count(field).sum()))
    size = min(len(field), 1 << ((wanted - 1).bit_length() - 5))
    return np.bitwise_or.reduce(field.reshape(-1, size), axis=0)


def tested(field: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Whether the bit of each entry is set."""
    entry = entry & (32 * len(field) - 1)
    return (field[entry >> 5] >> (entry & 31).astype(np.uint32)) & np.uint32(1) == 1


def field_of(keys: DataFrame) -> Broadcast:
    """The field of the last column of ``keys`` (long, not null)."""
    return keys.sparkSession.sparkContext.broadcast(fitting(packed_bits(keys, F.pmod(F.col(keys.columns[-1]), F.lit(1 << BITS)), BITS)))


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Adds ``maybe``: false for rows of ``df`` whose ``key`` (long, not null) is surely not in the last column of ``keys``."""
    field = field_of(keys)
    place = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tested(field.value, batch.column(place).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "maybe"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("maybe", T.BooleanType())]))


def packed_texts(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """(key, blob): a compressed text for each of ``keys``, of the rows of ``docs`` (key, text)."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << BITS))
    field = docs.sparkSession.sparkContext.broadcast(fitting(packed_bits(keys, slot, BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        met: set[int] = set()  # copies of a text leave a task once
        for batch in batches:
            named = batch.column(key).to_pylist()
            rows = [r for r in np.flatnonzero(tested(field.value, batch.column("slot").to_numpy())).tolist() if not (named[r] in met or met.add(named[r]))]
            for at in range(0, len(rows), 512):
                own = pa.array(rows[at : at + 512])
                blobs = [packer.compress((t or "").encode()) for t in batch.column("text").take(own).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(own), pa.array(blobs, pa.binary())], names=[key, "blob"])

    found = docs.select(key, "text", slot.alias("slot")).mapInArrow(run, f"{key} long, blob binary")
    return found.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min("blob").alias("blob"))
