"""Stores of sorted hash arrays, and what a worker keeps of them."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pytest
from pyarrow import fs

from tidewell.llm import hash_arrays


def test_stores_by_path():
    assert isinstance(hash_arrays.store_of("file:///tmp/x")[0], fs.LocalFileSystem)
    store, name = hash_arrays.store_of("dbfs:/some/folder")
    assert isinstance(store, fs.LocalFileSystem) and name == "/dbfs/some/folder"
    with pytest.raises(RuntimeError, match="viewfs://x/y"):
        hash_arrays.store_of("viewfs://x/y")


def test_least_used_are_released(monkeypatch, tmp_path):
    monkeypatch.setattr(hash_arrays, "HELD_BYTES", 3 * 120)
    monkeypatch.setattr(hash_arrays, "HELD_FILES", 5)
    table = lambda: (np.zeros(10, np.int64), np.zeros(10, np.float32))
    opened = OrderedDict((k, table()) for k in "abcde")
    hash_arrays.release(opened)
    assert list(opened) == ["c", "d", "e"]
    for k in range(8):
        np.zeros(10, np.int64).tofile(f"{tmp_path}/{k}")
        opened[str(k)] = np.memmap(f"{tmp_path}/{k}", np.int64, "r", 0, 10), np.zeros(0, np.float32)
        hash_arrays.release(opened)
    assert list(opened) == ["3", "4", "5", "6", "7"]


def test_bit_fields_fit_their_keys(spark):
    """A field of few keys is small, one of many is larger, and none says no of a key that is in the table."""
    from pyspark.sql import functions as F

    from tidewell.llm import bitfield

    for n, size in ((0, 1 << 15), (1000, 1 << 15), (200_000, 1 << 17)):
        keys = spark.range(n).select(F.xxhash64("id").alias("key"))
        field = bitfield.fitting(bitfield.packed_bits(keys, F.pmod("key", F.lit(1 << bitfield.BITS)), bitfield.BITS))
        assert len(field) == size
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("key"))
    found = bitfield.maybe_in(rows, "key", rows.filter("id % 60 = 0").select("key"))
    assert found.filter("id % 60 = 0 and not maybe").isEmpty() and found.filter("maybe").count() < 1000 + 300
