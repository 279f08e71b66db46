"""Audit of how the sources of a language differ in the terms they use.

A term is a maximal run of ASCII letters and characters beyond ASCII, with A-Z in lower case.
A language keeps the terms that are in at least ``least_docs`` of its documents (rows of the
table).  Each (language, source) group and each language gives a kept term the probability
``1 + floor(10**9 * (count + 5) / (N + 5 * V))`` in units of 10**-9, where N sums the counts of
the V kept terms.  Reported are, for each group, the summed differences to each other source
of its language, and the terms that it uses most above its language.

**Counting.**  Tasks pack terms by length: up to 8 bytes become one 64-bit word, up to 16
two, in buckets of two lengths each, as such words have few digits to sort by.  Words are
radix-sorted, 16 bits a pass, in the order of the rows, and runs of equal ones give counts and
numbers of documents.  Longer terms are sorted as bytes, a bucket for each length.  What is
counted leaves a task once for each slice of text; Spark adds it up by language, source and
term before and after the shuffle, so no common term or large source gathers in a task.

**Sums over terms.**  A task adds the differences of all pairs of a language's sources over
its terms in one matrix, so what it returns grows with the pairs and not with the terms.

All arithmetic is on integers; ``N + 5 * V`` must stay below 9 * 10**15.

Defined results: null text, language and source count as empty; repeated rows are documents of
their own; texts without terms and empty ones still make their group occur; a language
without kept terms has differences of 0 and no terms; ties go by the bytes of the name; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm import textkit
from tidewell.llm.store import small
from tidewell.sources.shared import written

#: Bytes of text that a task counts at a time.
COUNTED_BYTES = 1 << 22
#: Most numbers of a matrix that a task holds.
MATRIX = 1 << 20
UNIT, EXTRA = 1_000_000_000, 5


# --- counting ---------------------------------------------------------------------------


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each term in lower-cased bytes; terms don't cross rows."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ((data >= 97) & (data <= 122)) | (data >= 128)
    change = inside[1:] != inside[:-1]
    edges = offsets[1:-1]
    edges = np.unique(edges[(edges > 0) & (edges < n)])
    edges = edges[inside[edges] & inside[edges + 1]]  # a term ends and another begins here
    begin, end = np.flatnonzero(change & inside[1:]), np.flatnonzero(change & inside[:-1])
    if len(edges):
        begin, end = np.sort(np.concatenate([begin, edges])), np.sort(np.concatenate([end, edges]))
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


def packed_words(windows: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as one number that sorts as they do, zeros after them."""
    words = np.ascontiguousarray(windows[begin]).view(">u8").ravel().astype(np.uint64)
    shift = (64 - 8 * np.minimum(length, 8)).astype(np.uint64)
    return words >> shift << shift


def radix_order(words: list[np.ndarray], group: np.ndarray, digits: int) -> np.ndarray:
    """Order by words, then group, then as given; ``digits`` of 16 bits of the words are set, from the top of the first."""
    order = np.arange(len(group))
    keys = [(group >> s).astype(np.uint16) for s in (0, 16) if s == 0 or group.max(initial=0) >> 16]
    keys += [(words[d // 4] >> np.uint64(48 - 16 * (d % 4))).astype(np.uint16) for d in reversed(range(digits))]
    for key in keys:
        if len(key) and (key != key[0]).any():
            order = order[np.argsort(key[order], kind="stable")]  # numpy sorts 16-bit integers by radix
    return order


def run_counts(change: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and number of rows of each run; ``change`` says where one begins."""
    first = np.flatnonzero(change)
    new = change.copy()
    new[1:] |= row[1:] != row[:-1]
    return first, np.diff(np.append(first, len(row))), np.add.reduceat(new.astype(np.int64), first)


def strings(data: np.ndarray, length: np.ndarray) -> pa.Array:
    """Strings from a matrix with the bytes of one in each row."""
    flat = data[np.arange(data.shape[1]) < length[:, None]]
    offsets = np.zeros(len(length) + 1, dtype=np.int32)
    np.cumsum(length, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def counted(column: pa.Array, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, count, rows) of a slice of texts, from one bucket of lengths after another; ``group`` is that of each row."""
    data, offsets = textkit.raw(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    begin, end, row = term_bounds(data, offsets)
    length = end - begin
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(16, np.uint8)), 8)
    bucket = np.where(length <= 16, (length + 1) // 2, length).astype(np.uint32)
    for key in np.unique(bucket[length <= 16]).tolist():
        own = np.flatnonzero((bucket == key) & (length <= 16))
        words = [packed_words(windows, begin[own], length[own])]
        if key > 4:
            words.append(packed_words(windows, begin[own] + 8, length[own] - 8))
        order = radix_order(words, group[row[own]], key)
        own, words = own[order], [w[order] for w in words]
        of, at = group[row[own]], row[own]
        change = np.append(True, of[1:] != of[:-1])
        for w in words:
            change[1:] |= w[1:] != w[:-1]
        first, n, docs = run_counts(change, at)
        spelled = np.stack([w[first] for w in words], axis=1).astype(">u8").view(np.uint8)
        yield strings(spelled, length[own[first]]), of[first], n, docs
    for size in np.unique(length[length > 16]).tolist():
        own = np.flatnonzero(length == size)
        spelled = np.stack([data[b : b + size] for b in begin[own].tolist()])
        order = np.lexsort((group[row[own]], spelled.view(f"S{size}").ravel()))
        own, spelled = own[order], spelled[order]
        of, at = group[row[own]], row[own]
        change = np.append(True, (of[1:] != of[:-1]) | (spelled[1:] != spelled[:-1]).any(axis=1))
        first, n, docs = run_counts(change, at)
        yield strings(spelled[first], length[own[first]]), of[first], n, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in textkit.slices(batch.column("text"), COUNTED_BYTES):
                langs, sources = (batch.column(c).slice(at, len(part)).dictionary_encode() for c in ("lang", "source"))
                wide = len(sources.dictionary)
                group = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()
                for terms, of, n, docs in counted(part, group):
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of // wide)), sources.dictionary.take(pa.array(of % wide)), terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    runs = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return runs.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- probabilities ----------------------------------------------------------------------


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10**9 * (count + 5) / (total + 5 * terms))``, by long division in base 1000, so that nothing overflows."""
    below = total + EXTRA * terms
    rest, out = count + EXTRA, F.lit(0).cast("long")
    for place in range(4):
        if place:
            rest = rest % below * 1000
        out = out * 1000 + F.call_function("div", rest, below)
    return out + 1


def pair_sums(dense: DataFrame) -> DataFrame:
    """(lang, i, j, value), i < j: the summed differences of places i and j of the arrays ``p`` (all of a language equally long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows(lang: str, first: int, tile: np.ndarray) -> pa.RecordBatch:
            i, j = np.nonzero(np.arange(first, first + len(tile))[:, None] < np.arange(tile.shape[1]))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array((i + first).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(tile[i, j])], names=["lang", "i", "j", "value"])

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            lists, codes = batch.column("p"), langs.indices.to_numpy()
            for code in np.unique(codes).tolist():
                lang = langs.dictionary[code].as_py()
                own = lists.take(pa.array(np.flatnonzero(codes == code)))
                table = own.flatten().to_numpy().reshape(len(own), -1)
                wide = table.shape[1]
                high, whole = max(1, MATRIX // wide), wide * wide <= MATRIX
                if whole and lang not in held and sum(t.size for t in held.values()) + wide * wide > 4 * MATRIX:
                    yield from (rows(k, 0, t) for k, t in held.items())
                    held.clear()
                for first in range(0, wide, high):
                    tile = held.setdefault(lang, np.zeros((wide, wide), np.int64)) if whole else np.zeros((min(high, wide - first), wide), np.int64)
                    for at in range(0, len(table), high):
                        block = table[at : at + high]
                        for k in range(len(tile)):
                            tile[k] += np.abs(block - block[:, first + k : first + k + 1]).sum(axis=0)
                    if not whole:
                        yield rows(lang, first, tile)
        yield from (rows(k, 0, t) for k, t in held.items())

    sums = dense.select("lang", "p").mapInArrow(run, "lang string, i int, j int, value long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): differences to other sources (``pair``) and terms above the language (``term``)."""
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    counts = term_counts(docs.select(*named, F.coalesce("text", F.lit("")).alias("text")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("uses")).filter(F.col("docs") >= least_docs)
    kept = written(kept.drop("docs"), "kept-terms")

    uses = kept.select("lang", "term", "lang_n", F.inline("uses"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(*named).distinct().join(uses.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")

    own = uses.join(small(groups), ["lang", "source"])
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    above = own.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)

    sides = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sides"), F.first("terms").alias("terms"))
    count = lambda side: F.coalesce(F.element_at(F.map_from_entries("uses"), side["source"]), F.lit(0).cast("long"))
    few = groups.count() <= 100_000  # a language's row holds its groups, so all rows together hold that many
    dense = kept.join(F.broadcast(sides) if few else sides, "lang").select("lang", F.transform("sides", lambda side: share(count(side), side["total"], F.col("terms"))).alias("p"))
    places = sides.select("lang", F.col("sides.source").alias("names"), F.explode(F.sequence(F.lit(0), F.size("sides") - 1)).alias("a"))
    places = places.select("lang", "names", "a", F.explode(F.sequence(F.lit(0), F.size("names") - 1)).alias("b")).filter("a <> b")
    pairs = places.select("lang", F.get("names", F.col("a")).alias("source"), F.get("names", F.col("b")).alias("item"), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    between = pairs.join(pair_sums(dense), ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return between.withColumn("rank", F.row_number().over(order)).unionByName(above)


def oracle(least_docs: int = 30, most_terms: int = 50) -> str:
    """DuckDB SQL of ``audit``."""
    share_of = "1 + (1000000000::HUGEINT * ({0} + 5)) // ({1} + 5 * terms)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
used AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM used GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
of_lang AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
uses AS (SELECT lang, source, term, count(*) AS n FROM used JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM uses GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms, coalesce(lang_total, 0) AS lang_total
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source) LEFT JOIN of_lang USING (lang)),
shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share_of.format("coalesce(n, 0)", "total")} AS p, {share_of.format("lang_n", "lang_total")} AS q
        FROM groups JOIN kept USING (lang) LEFT JOIN uses USING (lang, source, term)),
between_all AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows_of AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN between_all x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
        CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows_of QUALIFY part = 'pair' OR rank <= {most_terms}"""
