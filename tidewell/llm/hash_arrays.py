"""Sorted hash arrays: a table from 63-bit hashes to numbers, as files in the shared folder.

Tasks sort the entries by hash and write one file for each kind and range of hashes: the
hashes, then the values.  The driver sees the list of files only.  Python workers map files
of a local or mounted folder into memory, so pages that aren't needed take none and a table
may be larger than a worker.  Files of the stores that ``pyarrow.fs`` knows (``hdfs``, ``s3`` and
``s3a``, ``gs``, ``abfs`` and ``abfss``) are read as a whole, and a worker holds the ``HELD_BYTES`` of them that it
used last; ``dbfs:/`` is taken as the folder ``/dbfs``.  Other stores raise an error that says so.

A task that runs again writes a file of another name; the list names those of the attempt
that Spark accepted.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import new_path

#: Entries of one file, about.
FILE_ENTRIES = 1 << 18
#: Bytes of files that can't be mapped, and the number of mapped ones, that a worker keeps.
HELD_BYTES, HELD_FILES = 256 << 20, 4096
_OPENED: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the name there."""
    known = re.sub(r"^s3[an]://", "s3://", re.sub(r"^dbfs:/+", "/dbfs/", path))
    try:
        return fs.FileSystem.from_uri(known)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as wrong:
        raise RuntimeError(f"sorted hash arrays can't be kept at {path}: spark.checkpoint.dir must be a mounted folder or in a store that pyarrow.fs reads") from wrong


def release(opened: OrderedDict[str, tuple[np.ndarray, np.ndarray]]) -> None:
    """Lets go of what was used least lately."""
    read = sum(k.nbytes + v.nbytes for k, v in opened.values() if not isinstance(k, np.memmap))
    while len(opened) > 1 and (read > HELD_BYTES or len(opened) > HELD_FILES):
        keys, values = opened.popitem(last=False)[1]
        read -= 0 if isinstance(keys, np.memmap) else keys.nbytes + values.nbytes


@dataclass(frozen=True)
class HashArrays:
    """Where the files are: path and number of entries for each kind and range of hashes."""

    folder: str
    bits: int
    files: dict[tuple[int, int], tuple[str, int]]

    def find(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, NaN where there is none; ``hashes`` must be sorted."""
        out = np.full(len(hashes), np.nan)
        part = hashes >> np.int64(63 - self.bits)
        edges = _edges(part[1:] != part[:-1], len(part))
        for begin, end in zip(edges, edges[1:], strict=False):
            if (kind, int(part[begin])) in self.files:
                keys, values = self._opened(*self.files[kind, int(part[begin])])
                own = hashes[begin:end]
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                out[begin:end] = np.where(keys[place] == own, values[place], np.nan)
        return out

    def find_any(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """As ``find``, for hashes in any order."""
        order = np.argsort(hashes)
        out = np.empty(len(hashes))
        out[order] = self.find(kind, hashes[order])
        return out

    def _opened(self, path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        if path not in _OPENED:
            store, name = store_of(path)
            if isinstance(store, fs.LocalFileSystem):
                _OPENED[path] = np.memmap(name, np.int64, "r", 0, n), np.memmap(name, np.float32, "r", 8 * n, n)
            else:
                with store.open_input_file(name) as file:
                    data = file.read()
                _OPENED[path] = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float32, n, 8 * n)
            release(_OPENED)
        _OPENED.move_to_end(path)
        return _OPENED[path]


def _edges(change: np.ndarray, n: int) -> list[int]:
    """Where stretches of n values begin, and where the last one ends; none if n is 0."""
    return [0, *(np.flatnonzero(change) + 1).tolist(), n] if n else []


def write_arrays(entries: DataFrame, name: str) -> HashArrays:
    """The table of ``entries`` (kind int, hash long of 63 bits, value float); equal hashes of a kind have equal values."""
    bits = max(0, (entries.count() // FILE_ENTRIES).bit_length())
    folder = new_path(entries.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own: tuple[int, int] | None = None

        def flush() -> pa.RecordBatch:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            fresh = np.append(True, keys[1:] != keys[:-1])
            keys, values = keys[fresh], values[fresh].astype(np.float32)
            path = f"{folder}/{own[0]}-{own[1]}-{uuid.uuid4().hex}"
            store, place = store_of(path)
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(place) as file:
                file.write(keys.tobytes())
                file.write(values.tobytes())
            held.clear()
            return pa.RecordBatch.from_pydict({"kind": pa.array([own[0]], pa.int32()), "part": pa.array([own[1]], pa.int32()), "path": [path], "n": pa.array([len(keys)], pa.int64())})

        for batch in batches:
            kind, part, keys, values = (batch.column(c).to_numpy() for c in ("kind", "part", "hash", "value"))
            edges = _edges((kind[1:] != kind[:-1]) | (part[1:] != part[:-1]), len(kind))
            for begin, end in zip(edges, edges[1:], strict=False):
                if held and own != (int(kind[begin]), int(part[begin])):
                    yield flush()
                own = int(kind[begin]), int(part[begin])
                held.append((keys[begin:end].copy(), values[begin:end].copy()))
        if held:
            yield flush()

    parted = entries.withColumn("part", F.shiftright("hash", 63 - bits).cast("int")).repartition(2 << bits, "kind", "part").sortWithinPartitions("kind", "part", "hash")
    listed = parted.select("kind", "part", "hash", "value").mapInArrow(run, "kind int, part int, path string, n long").collect()  # a row for each file
    return HashArrays(folder, bits, {(r["kind"], r["part"]): (r["path"], r["n"]) for r in listed})
