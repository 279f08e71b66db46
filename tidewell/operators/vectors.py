"""Exact search over vectors: blocks of a matrix product and bounded, mergeable best lists.

Queries and rows are dealt into blocks by a hash, so no label, id or vector gathers in one.  Each
block of queries meets each stripe of rows in one task, which holds the queries, streams the
rows and keeps the best of each query; Spark merges what the tasks kept.  So every row is
compared with every query, but no pair is written anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers in a block of queries, and in a stripe of rows: 2 and 4 MB.
QUERY_NUMBERS, ROW_NUMBERS = 1 << 18, 1 << 19
#: Most scores that a task holds at a time.
TILE = 1 << 21
LEAST = np.iinfo(np.int64).min


class Best:
    """For each of n lists the first ``most`` entries: higher scores first, then smaller ids, then entries without an id."""

    def __init__(self, n: int, most: int, score: type = np.int64):
        self.n, self.most = n, most
        self.score = np.full((n, most), self.lowest(score), dtype=score)
        self.id = np.zeros((n, most), dtype=np.int64)
        self.missing = np.ones((n, most), dtype=bool)
        self.copies = np.zeros((n, most), dtype=np.int64)  # 0: no entry

    @staticmethod
    def lowest(score: type) -> float | int:
        return LEAST if np.issubdtype(score, np.integer) else -np.inf

    def offer(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, copies: np.ndarray) -> None:
        """Entries, each for one of the lists."""
        last = self.score[:, -1][lists], self.missing[:, -1][lists], self.id[:, -1][lists]
        better = (self.copies[:, -1][lists] == 0) | (scores > last[0]) | ((scores == last[0]) & ((missing < last[1]) | ((missing == last[1]) & (ids < last[2]))))
        own = np.flatnonzero(better & (copies > 0))
        if not len(own):
            return
        touched = np.unique(lists[own])
        held = np.repeat(touched, self.most)
        joined = (
            np.append(held, lists[own]),
            *(np.append(mine[touched].ravel(), new[own]) for mine, new in ((self.score, scores), (self.missing, missing), (self.id, ids), (self.copies, copies))),
        )
        order = np.lexsort((joined[3], joined[2], _descending(joined[1]), joined[4] == 0, joined[0]))
        of = joined[0][order]
        first = np.searchsorted(of, touched)
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        order, of, place = (x[place < self.most] for x in (order, of, place))
        for mine, new in ((self.score, joined[1]), (self.missing, joined[2]), (self.id, joined[3]), (self.copies, joined[4])):
            mine[of, place] = new[order]

    def entries(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """List, score, id and copies of all that is held."""
        lists, place = np.nonzero(self.copies)
        return lists, self.score[lists, place], pa.array(self.id[lists, place], mask=self.missing[lists, place]), self.copies[lists, place]


def _descending(scores: np.ndarray) -> np.ndarray:
    return ~scores if np.issubdtype(scores.dtype, np.integer) else -scores


def leading(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the allowed entries that are among the ``most`` highest of their row, with all that tie with the last of them."""
    hidden = np.where(allowed, scores, Best.lowest(scores.dtype.type))
    if hidden.shape[1] > most:
        allowed = allowed & (hidden >= np.partition(hidden, hidden.shape[1] - most, axis=1)[:, -most, None])
    return np.nonzero(allowed)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two tables of 64-bit integers; those beyond 64 bits become the nearest 64-bit number."""
    most = lambda table: max(1, abs(int(table.min(initial=0))), abs(int(table.max(initial=0))))
    bound = left.shape[1] * most(left) * most(right)
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)  # all sums are exact
    if bound < 1 << 63:
        return left @ right.T
    return np.clip(left.astype(object) @ right.astype(object).T, LEAST, np.iinfo(np.int64).max).astype(np.int64)


def tables(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, table) for each length of vectors that occurs."""
    lengths = lists.value_lengths().to_numpy()
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        yield own, lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), length)


def collapsed(rows: DataFrame, *names: str) -> DataFrame:
    """Rows that are equal in all columns as one, with their number as ``copies``."""
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))


def in_blocks(queries: DataFrame, rows: DataFrame, begin: Callable[[pa.RecordBatch], object], schema: str) -> DataFrame:
    """Lets each block of ``queries`` meet all ``rows``; both have a column ``vector``, and no ``block``, ``stripe`` or ``side``.

    ``begin(queries)`` gives an object whose ``add(rows)`` takes record batches of rows, and whose
    ``end()`` gives the record batch of results for the rows it was given.
    """
    n_queries, n_rows, long = (queries.agg(F.count(F.lit(1))).head()[0], *rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).head())
    blocks, stripes = (max(1, -(-n * max(1, long) // numbers)) for n, numbers in ((n_queries, QUERY_NUMBERS), (n_rows, ROW_NUMBERS)))
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", dealt(queries, blocks).alias("block"), F.lit(0).alias("side")).select("*", every(stripes).alias("stripe"))
    right = rows.select("*", dealt(rows, stripes).alias("stripe"), F.lit(1).alias("side")).select("*", every(blocks).alias("block"))
    both = left.unionByName(right, allowMissingColumns=True)
    met = both.repartition(min(2 * blocks * stripes, 20_000), "block", "stripe").sortWithinPartitions("block", "stripe", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe, waiting, work = None, None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "stripe", "side")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                part, (b, s, side) = batch.slice(at, to - at), key[:, at].tolist()
                if b != block:
                    if work is not None:
                        yield work.end()
                    block, stripe, waiting, work = b, s, [], None
                if side == 0 and s == stripe:
                    waiting.append(part)  # the block's queries come again with each stripe, and are read once
                elif side == 1 and waiting:
                    if work is None:
                        work = begin(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    work.add(part)
        if work is not None:
            yield work.end()

    return met.mapInArrow(run, schema)


class _Nearest:
    def __init__(self, queries: pa.RecordBatch, most: int, digits: int):
        self.ids, self.digits = queries.column("id"), digits
        self.parts = [(own, _unit(table)) for own, table in tables(queries.column("vector"))]
        self.best = Best(len(queries), most, np.float64)

    def add(self, rows: pa.RecordBatch) -> None:
        ids, missing = rows.column("id").fill_null(0).to_numpy(), rows.column("id").is_null().to_numpy(zero_copy_only=False)
        copies = rows.column("copies").to_numpy()
        for there, table in tables(rows.column("vector")):
            for here, own in self.parts:
                if own.shape[1] == table.shape[1]:
                    step = max(1, TILE // len(there))
                    for at in range(0, len(here), step):
                        mine = here[at : at + step]
                        scores = np.round(own[at : at + step] @ _unit(table).T, self.digits) + 0.0
                        same = self.ids.take(pa.array(mine)).fill_null(0).to_numpy()[:, None] == ids[there]
                        same &= ~(missing[there] | self.ids.take(pa.array(mine)).is_null().to_numpy(zero_copy_only=False)[:, None])
                        i, j = leading(scores, ~same, self.best.most)
                        self.best.offer(mine[i], scores[i, j], ids[there[j]], missing[there[j]], copies[there[j]])

    def end(self) -> pa.RecordBatch:
        lists, scores, ids, copies = self.best.entries()
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(lists)), ids, pa.array(scores), pa.array(copies)], names=["query_id", "id", "score", "copies"])


def _unit(table: np.ndarray) -> np.ndarray:
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def first_of(found: DataFrame, lists: list[str], most: int, order: list[Column], place: str) -> DataFrame:
    """Merges best lists: the first ``most`` of each list, numbered from 1, an entry as often as its ``copies``."""
    each = found.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.least("copies", F.lit(most)).cast("int"))))
    return each.withColumn(place, F.row_number().over(W.partitionBy(*lists).orderBy(*order))).filter(F.col(place) <= most).drop("copies")


def usable(vector: Column) -> Column:
    """Whether a vector is there, with finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def nearest(queries: DataFrame, rows: DataFrame, most: int, digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score): the rows of the highest cosine similarity to each query.

    Both tables have ``id`` long and ``vector`` array.  Scores are rounded to ``digits``, ties go
    to smaller ids, then to rows without one; rows that repeat count as often.  A row of the
    query's id isn't its neighbour.  Null vectors, those of zeros and those with components that
    are null or not finite take no part; vectors of unequal length aren't compared.  Queries that
    repeat count once; a query without neighbours has no row.
    """
    kept = lambda df: df.select("id", F.col("vector").cast("array<double>").alias("vector")).filter(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    found = in_blocks(kept(queries).distinct(), collapsed(kept(rows), "id", "vector"), lambda block: _Nearest(block, most, digits), "query_id long, id long, score double, copies long")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    return first_of(found, ["query_id"], most, order, "rank").select("query_id", "rank", "id", "score")
