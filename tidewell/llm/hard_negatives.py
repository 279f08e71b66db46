"""Hard-negative mining by slot-decomposed selection.

Components are quantised to ``floor(256 * x)``, and a row's score for an anchor is the integer
inner product.  An anchor's positives are its best other rows of the same label, and each
positive of score p asks for the best rows of other labels whose score is in the window from
half of p to 95 % of p.

**Slots.**  An anchor's windows overlap, but their upper limits cut the scores into disjoint
slots: between the limit of one positive and that of the next.  Tasks keep the best few of
each slot, and Spark merges what they kept.  The first few below a limit are then the first few
of its slot and the slots below, so one pass from the lowest slot upwards, joining each slot to
what was merged below it, answers all windows; the lower limit only shortens an answer.

Both passes, for positives and for slots, compare blocks of anchors with stripes of rows
(``operators.vectors``), so that neither a label nor a common vector gathers in a task.

Defined results: rows with a null label, a null vector, or a component that is null or not
finite take no part; a row without an id is no anchor, stands behind others of its score and is
reported with a null id; rows that repeat count as often as they occur, as anchors, positives
and negatives, and a repeated anchor is a positive of its own copies; vectors of unequal length
aren't compared; components and scores beyond 64 bits become the nearest 64-bit number; an
anchor without positives or a window without rows gives no row; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.vectors import LEAST, TILE, Best, collapsed, first_of, in_blocks, leading, products, tables, usable
from tidewell.sources.shared import written

#: What names an anchor: rows of one id may differ in label or vector.
ANCHOR = ["anchor_id", "label", "mark"]
FOUND = "anchor_id long, label long, mark long, slot int, id long, score long, copies long"


def quantised(rows: DataFrame) -> DataFrame:
    """(id, label, vector, copies): rows that take part, each distinct one once."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    kept = rows.filter(F.col("label").isNotNull() & usable(F.col("embedding")))
    return collapsed(kept.select(F.col("vec_id").alias("id"), moved.alias("label"), vector.alias("vector")), "id", "label", "vector")


class _Anchors:
    """A block of anchors, by length of vector."""

    def __init__(self, anchors: pa.RecordBatch):
        self.key = [anchors.column(c) for c in ("id", "label", "mark")]
        self.id, self.label = (c.to_numpy() for c in self.key[:2])
        self.parts = list(tables(anchors.column("vector")))

    def tiles(self, rows: pa.RecordBatch):
        """(anchors, rows, scores, vectors of both) of each part of the product."""
        for there, table in tables(rows.column("vector")):
            for here, own in self.parts:
                if own.shape[1] == table.shape[1]:
                    step = max(1, TILE // len(there))
                    for at in range(0, len(here), step):
                        yield here[at : at + step], there, products(own[at : at + step], table), own[at : at + step], table

    def found(self, lists: np.ndarray, slots: np.ndarray, score: np.ndarray, ids: pa.Array, copies: np.ndarray) -> pa.RecordBatch:
        key = [c.take(pa.array(lists)) for c in self.key]
        return pa.RecordBatch.from_arrays([*key, pa.array(slots.astype(np.int32)), ids, pa.array(score), pa.array(copies)], names=[*ANCHOR, "slot", "id", "score", "copies"])


def _fields(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = rows.column("id")
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), rows.column("label").to_numpy(), rows.column("copies").to_numpy()


class _Positives(_Anchors):
    """Keeps the best rows of an anchor's label."""

    def __init__(self, anchors: pa.RecordBatch, most: int):
        super().__init__(anchors)
        self.best = Best(len(anchors), most)

    def add(self, rows: pa.RecordBatch) -> None:
        ids, missing, label, copies = _fields(rows)
        for here, there, scores, own, table in self.tiles(rows):
            same = self.label[here, None] == label[there]
            # an anchor's own row counts once less
            a, b = np.nonzero(same & (self.id[here, None] == ids[there]) & ~missing[there])
            alike = (own[a] == table[b]).all(axis=1)
            a, b = a[alike], b[alike]
            same[a, b] = False
            i, j = leading(scores, same, self.best.most)
            counts = np.append(copies[there[j]], copies[there[b]] - 1)
            i, j = np.append(i, a), np.append(j, b)
            self.best.offer(here[i], scores[i, j], ids[there[j]], missing[there[j]], counts)

    def end(self) -> pa.RecordBatch:
        lists, score, ids, copies = self.best.entries()
        return self.found(lists, np.zeros(len(lists)), score, ids, copies)


class _Slots(_Anchors):
    """Keeps the best rows of other labels in each slot of an anchor."""

    def __init__(self, anchors: pa.RecordBatch, most: int, slots: int):
        super().__init__(anchors)
        self.best, self.slots = Best(len(anchors) * slots, most), slots
        #: Upper limits, falling; the last one is below all windows, and stands for those that aren't there.
        self.limits = np.full((len(anchors), slots + 1), LEAST, dtype=np.int64)
        for k, scores in enumerate(anchors.column("scores").to_pylist()):
            self.limits[k, : len(scores)] = [upper_limit(p) for p in scores]
            self.limits[k, len(scores) :] = lower_limit(scores[-1]) - 1

    def add(self, rows: pa.RecordBatch) -> None:
        ids, missing, label, copies = _fields(rows)
        for here, there, scores, _, _ in self.tiles(rows):
            other = self.label[here, None] != label[there]
            for slot in range(self.slots):
                inside = other & (scores <= self.limits[here, slot, None]) & (scores > self.limits[here, slot + 1, None])
                i, j = leading(scores, inside, self.best.most)
                self.best.offer(here[i] * self.slots + slot, scores[i, j], ids[there[j]], missing[there[j]], copies[there[j]])

    def end(self) -> pa.RecordBatch:
        lists, score, ids, copies = self.best.entries()
        return self.found(lists // self.slots, lists % self.slots, score, ids, copies)


def upper_limit(positive: int) -> int:
    """The highest score s with 100 * s <= 95 * positive."""
    return 95 * positive // 100


def lower_limit(positive: int) -> int:
    """The lowest score s with 100 * s >= 50 * positive."""
    return -(-positive // 2)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are rows whose id ``every`` divides."""
    vectors = written(quantised(rows), "quantised")
    anchors = vectors.filter(F.col("id") % every == 0).withColumn("mark", F.xxhash64("vector"))
    order = [F.desc("score"), F.asc_nulls_last("id")]

    begin = anchors.select("id", "label", "mark", "vector")
    found = in_blocks(begin, vectors, lambda block: _Positives(block, positives), FOUND).drop("slot")
    found = written(first_of(found, ANCHOR, positives, order, "place"), "positives")
    per_anchor = found.groupBy(*ANCHOR).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    named = anchors.select(F.col("id").alias("anchor_id"), "label", "mark", "vector", F.col("copies").alias("times")).join(per_anchor, ANCHOR)

    begin = named.select(F.col("anchor_id").alias("id"), "label", "mark", "vector", F.col("positives.score").alias("scores"))
    slots = first_of(in_blocks(begin, vectors, lambda block: _Slots(block, negatives, positives), FOUND), [*ANCHOR, "slot"], negatives, order, "place")
    slots = slots.groupBy(*ANCHOR).agg(F.sort_array(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("kept"))

    merged, answers = F.expr("CAST(array() AS array<struct<slot:int,place:int,id:bigint,score:bigint>>)"), []
    for slot in reversed(range(positives)):  # from the lowest slot upwards
        merged = F.slice(F.concat(F.expr(f"filter(kept, x -> x.slot = {slot})"), merged), 1, negatives)
        answers.insert(0, merged)
    whole = named.drop("vector").join(slots, ANCHOR).withColumn("answers", F.array(*answers))
    each = whole.select("anchor_id", "times", "answers", F.explode("positives").alias("positive"))
    each = each.select("anchor_id", "times", F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"), F.posexplode(F.get("answers", F.col("positive.place") - 1)))
    wide = lambda c, times: F.col(c).cast("decimal(38,0)") * times
    each = each.select("*", F.col("col.score").alias("negative_score")).filter((wide("positive_score", 50) <= wide("negative_score", 100)) & (wide("negative_score", 100) <= wide("positive_score", 95)))
    repeated = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return repeated.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("negative_id"), "positive_score", "negative_score")


def oracle(positives: int = 5, negatives: int = 3, every: int = 50) -> str:
    """DuckDB SQL of ``mine``, for tables of distinct ids and vectors of one length."""
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= {negatives}"""
