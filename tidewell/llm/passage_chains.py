"""Substring deduplication by collinear chaining: passages that repeat across documents.

1. Seeds are k-word windows; of every ``window`` consecutive ones the least by hash is kept
   (minimizers), so an exact stretch of k + window - 1 words always shares a seed.
2. Each seed of two documents or more is anchored to its first place, that in the document of
   least id; where a document has a seed again, that counts both as the seed and as another one
   (so runs of one word find each other).  A document with n seeds gets at most 2 n anchors.
3. The anchors of a document and a first document are chained: a chain's score is the words
   its seeds cover, less a cost for the gaps in both documents.  The best chain that ends at an
   anchor comes from a Fenwick tree of prefix maxima over the places in the first document.
4. Chains of enough words are aligned on the full texts: equal words between seeds are taken
   as they are, other gaps by edit distance, and the ends are extended while it pays off.
   Passages of ``least_words`` words or more at ``least_identity`` or more are reported.
5. Parts of a passage may have their first places in different documents, each with too little
   of it.  So seeds in none of the passages found are anchored once more, to the nearest earlier
   document that has them.  A seed is also known by the ``least_words - window + 1`` words that
   begin there: each exact passage of ``least_words`` holds such a stretch, and stretches in no
   passage found are anchored to the first and to the nearest earlier document that have all
   of their words.  All these go through steps 3 and 4.

Words are compared lower-cased, as 50-bit hashes.  Defined results: null and empty texts have
no passage; a passage that repeats only within one document is not reported; rows of equal id
are versions of one document, told apart by the hash of their text, and none is compared with
another version of it (equal rows are one); rows of null id are left out, as a passage could
not say where it is; of seeds in several earlier places the first counts, then the nearest; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import textkit as tk
from tidewell.llm.bitfield import field_of, maybe_in, packed_texts, tested
from tidewell.llm.store import small
from tidewell.operators.salted import salted_join
from tidewell.sources.shared import discard, remove, tracked, written


def minimizers(words: tk.Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, seed) of the minimizers of each row of a slice; repeated ones by a second name as well."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seed = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        seed = seed * np.uint64(0x9FB21C651E98DF25) + words.hash[i : n + i]
    seed = tk.mix(seed)
    whole = words.row[:n] == words.row[k - 1 :]
    rank = np.where(whole, seed >> np.uint64(1), np.uint64(2**64 - 1))  # windows across rows come last
    least = rank
    step = 1
    while step < window:  # minima over doubling stretches
        jump = min(step, window - step)
        shifted = np.append(least[jump:], np.full(min(jump, len(least)), np.uint64(2**64 - 1)))[: len(least)]
        least, step = np.minimum(least, shifted), step + jump
    # a place is kept if it is the least of a window that begins in its row, so if it is the greatest of these least ones
    step = 1
    while step < window:
        jump = min(step, window - step)
        rest = max(0, n - jump)
        passed = np.where(words.row[jump:n] == words.row[:rest], least[:rest], np.uint64(0))
        least, step = np.append(least[:jump], np.maximum(least[jump:], passed)), step + jump
    at = np.flatnonzero((rank == least) & whole)
    # how often the row had the seed before
    key = tk.mix(seed[at] ^ words.row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])[: len(at)]
    before = np.zeros(len(at), dtype=np.int64)
    before[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    again = np.flatnonzero(before > 0)
    return np.concatenate([at, at[again]]), np.concatenate([seed[at], tk.mix(seed[at][again] + before[again].astype(np.uint64))])


def stretch_hashes(words: tk.Words, place: np.ndarray, length: int) -> pa.Array:
    """A hash of the ``length`` words from each place, null where its row ends before."""
    up, down = tk._powers(len(words.hash) + 1)
    total = np.zeros(len(words.hash) + 1, dtype=np.uint64)
    np.cumsum(words.hash * up[:-1], out=total[1:])
    end = place + length
    whole = end <= words.first[words.row[place] + 1]
    end = np.where(whole, end, place)
    return pa.array(tk.mix((total[end] - total[place]) * down[place]).astype(np.int64), mask=~whole)


def _seed_rows(docs: DataFrame, k: int, window: int, stretch: int, field: Broadcast | None = None, several: Broadcast | None = None) -> DataFrame:
    """(seed, doc_id, text_hash, place, stretch), places counted in words; ``stretch`` names the words from there.

    With a ``field``, seeds that are surely not in it are left out.  ``several`` is a field of the
    ids of more than one text; with it, ``text_hash`` is ``ONLY`` for ids that are surely not among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tk.slices(batch.column("text")):
                words = tk.Words(part, lower=True)
                place, seed = minimizers(words, k, window)
                if field is not None:
                    keep = tested(field.value, seed.astype(np.int64))
                    place, seed = place[keep], seed[keep]
                row = words.row[place]
                doc_id, text_hash = (batch.column(c).slice(at, len(part)).to_numpy() for c in ("doc_id", "text_hash"))
                if several is not None:
                    text_hash = np.where(tested(several.value, doc_id), text_hash, ONLY)
                yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int64)), pa.array(doc_id[row]), pa.array(text_hash[row]), pa.array((place - words.first[row]).astype(np.int32)), stretch_hashes(words, place, stretch)], names=["seed", "doc_id", "text_hash", "place", "stretch"])

    return docs.mapInArrow(run, "seed long, doc_id long, text_hash long, place int, stretch long")


def best_chains(x: np.ndarray, y: np.ndarray, k: int, gap_cost: float, most_gap: int, least: int) -> list[list[int]]:
    """Disjoint chains of anchors (x, y), both rising, best first.

    The score of a chain is the words its anchors cover in x, less ``gap_cost`` for each word
    that x or y advance beyond; with one part of it moved into each anchor, the best chain that
    an anchor can follow is the greatest value of a smaller y.  Chains are cut at gaps of more
    than ``most_gap`` words, and pieces that cover at least ``least`` words are returned.
    """
    order = np.lexsort((-y, x))
    names, rank = np.unique(y, return_inverse=True)
    tree_value, tree_anchor = [-1e300] * (len(names) + 1), [-1] * (len(names) + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    xs, ys, ranks = x.tolist(), y.tolist(), rank.tolist()
    for i in order.tolist():
        at, best, found = ranks[i], -1e300, -1
        while at > 0:
            if tree_value[at] > best:
                best, found = tree_value[at], tree_anchor[at]
            at -= at & -at
        score[i] = float(k)
        if found >= 0:
            covered = min(k, xs[i] - xs[found], ys[i] - ys[found])
            value = score[found] + covered - gap_cost * (max(0, xs[i] - xs[found] - k) + max(0, ys[i] - ys[found] - k))
            if value > k:
                score[i], before[i] = value, found
        value, at = score[i] + gap_cost * (xs[i] + ys[i]), ranks[i] + 1
        while at <= len(names):
            if value > tree_value[at]:
                tree_value[at], tree_anchor[at] = value, i
            at += at & -at
    chains, used = [], [False] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        chain.reverse()
        cuts = [j for j in range(1, len(chain)) if max(xs[chain[j]] - xs[chain[j - 1]], ys[chain[j]] - ys[chain[j - 1]]) > most_gap + k]
        for begin, end in zip([0, *cuts], [*cuts, len(chain)], strict=True):
            piece = chain[begin:end]
            if piece and k + sum(min(k, xs[j] - xs[i]) for i, j in zip(piece, piece[1:], strict=False)) >= least:
                chains.append(piece)
    return chains


#: Blocks of ids within which the places of a seed are sorted.
BLOCKS = 64
#: In place of the hash of a text where its id has no other text: rows of places needn't carry it.
ONLY = 0
PAIR = ["doc_id", "text_hash", "first_id", "first_hash"]


def _chains(anchors: DataFrame, k: int, gap_cost: float, most_gap: int, least: int) -> DataFrame:
    """A row per chain: the pair of texts, and its anchors' places ``xs`` and ``ys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last pair, which may go on
        for batch in batches:
            pair = np.stack([batch.column(c).to_numpy() for c in PAIR], axis=1)
            if not len(pair):
                continue
            edge = np.flatnonzero((pair[1:] != pair[:-1]).any(axis=1)) + 1
            if held and [held[-1].column(c)[-1].as_py() for c in PAIR] != pair[0].tolist():
                yield from found(held)
                held = []
            if len(edge):
                yield from found([*held, batch.slice(0, int(edge[-1]))])
                held = []
                batch = batch.slice(int(edge[-1]))
            held.append(batch)
        if held:
            yield from found(held)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        pair, x, y = np.stack([table[c].to_numpy() for c in PAIR], axis=1), table["place"].to_numpy(), table["first_place"].to_numpy()
        fresh = np.append(True, (pair[1:] != pair[:-1]).any(axis=1) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        pair, x, y = pair[fresh], x[fresh], y[fresh]
        edge = np.flatnonzero((pair[1:] != pair[:-1]).any(axis=1)) + 1
        begin, end = np.append(0, edge), np.append(edge, len(x))
        long = k + x[end - 1] - x[begin] >= least  # places rise within a pair
        pairs, xs, ys = [], [], []
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            for chain in best_chains(x[a:b], y[a:b], k, gap_cost, most_gap, least):
                pairs.append(pair[a])
                xs.append(x[a:b][chain])
                ys.append(y[a:b][chain])
        if pairs:
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in np.ascontiguousarray(np.stack(pairs).T)), pa.array(xs, places), pa.array(ys, places)], names=[*PAIR, "xs", "ys"])

    dealt = anchors.select(*PAIR, "place", "first_place").repartition(*PAIR).sortWithinPartitions(*PAIR, "place", "first_place")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR) + ", xs array<int>, ys array<int>")


def _edit_matches(a: list[int], b: list[int]) -> int:
    """Most equal pairs in an alignment of least edits of two short sequences."""
    row = [(j, 0) for j in range(len(b) + 1)]  # edits, less equal pairs
    for i, u in enumerate(a, 1):
        last, row[0] = row[0], (i, 0)
        for j, v in enumerate(b, 1):
            step = (last[0], last[1] - 1) if u == v else (last[0] + 1, last[1])
            last, row[j] = row[j], min(step, (row[j][0] + 1, row[j][1]), (row[j - 1][0] + 1, row[j - 1][1]))
    return -row[-1][1]


def _extension(a: np.ndarray, b: np.ndarray, drop: int = 8) -> tuple[int, int]:
    """(words, equal words) to go on from the start of both while +1 and -2 pay off."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    equal = a[:n] == b[:n]
    gain = np.cumsum(np.where(equal, 1, -2))
    lost = np.flatnonzero(np.maximum.accumulate(np.maximum(gain, 0)) - gain > drop)
    gain = gain[: lost[0]] if len(lost) else gain
    best = int(np.argmax(gain)) if len(gain) else 0
    return (best + 1, int(equal[: best + 1].sum())) if len(gain) and gain[best] > 0 else (0, 0)


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int) -> tuple[int, int, int, int, int]:
    """(start in a, end, start in b, end, equal words) of a chain of anchors in two word sequences.

    Every word counted as equal was compared: those of an anchor where it goes on from what
    is aligned so far, and those of the gap before it.  Anchors whose words differ are left out.
    """
    start = first = x = y = -1
    equal = 0
    inside = (xs + k <= len(a)) & (ys + k <= len(b))
    xs, ys, step = xs[inside], ys[inside], np.arange(k)
    same_words = (a[xs[:, None] + step] == b[ys[:, None] + step]).all(axis=1)
    for u, v in zip(xs[same_words].tolist(), ys[same_words].tolist(), strict=True):
        if x < 0:
            start, first, x, y = u, v, u, v
        skip = max(0, x - u, y - v)  # words of the anchor that are behind what is aligned
        if skip >= k:
            continue
        u, v = u + skip, v + skip
        if u - x == v - y and (u == x or np.array_equal(a[x:u], b[y:v])):
            equal += u - x
        else:
            equal += _edit_matches(a[x:u].tolist(), b[y:v].tolist())
        equal += k - skip
        x, y = u + k - skip, v + k - skip
    if x < 0:
        return 0, 0, 0, 0, 0
    more, same = _extension(a[x:], b[y:])
    less, same_before = _extension(a[:start][::-1], b[:first][::-1])
    return start - less, x + more, first - less, y + more, equal + same + same_before


PLACES = ["start_word", "end_word", "first_start", "first_end"]
#: Bytes of packed texts that are read at a time.
PACKED_BYTES = 1 << 20


def _aligned(chains: DataFrame, texts: DataFrame, k: int, least_words: int, least_identity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def tokens(part: pa.RecordBatch) -> dict[int, np.ndarray]:
            """The word hashes of each text of some rows, read many texts at a time."""
            blobs = {h: blob for name, own in (("text_hash", "blob"), ("first_hash", "first_blob")) for h, blob in zip(part.column(name).to_pylist(), part.column(own), strict=True)}
            found: list[np.ndarray] = []
            for _, texts in tk.slices(pa.array([unpack(blob.as_py()).decode() for blob in blobs.values()], pa.large_string())):
                words = tk.Words(texts, lower=True)
                found += np.split(words.hash, words.first[1:-1])
            return dict(zip(blobs, found, strict=True))

        for batch in batches:
            out: list[tuple] = []
            size = np.cumsum([len(a.as_buffer()) + len(b.as_buffer()) for a, b in zip(batch.column("blob"), batch.column("first_blob"), strict=True)])
            cuts = (np.flatnonzero(np.diff(size // PACKED_BYTES)) + 1).tolist()
            for begin, end_row in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(begin, end_row - begin)
                text = tokens(part)
                for *pair, xs, ys in zip(*(part.column(c).to_pylist() for c in PAIR), part.column("xs"), part.column("ys"), strict=True):
                    start, end, other, other_end, equal = align(text[pair[1]], text[pair[3]], xs.values.to_numpy(), ys.values.to_numpy(), k)
                    length = max(end - start, other_end - other)
                    if end - start >= least_words and equal >= least_identity * length:
                        out.append((*pair, start, end, other, other_end, equal, equal / length))
            kinds = [pa.int64()] * 9 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)], names=[*PAIR, *PLACES, "n_equal", "identity"])

    joined = chains.join(texts, "text_hash").join(texts.select(F.col("text_hash").alias("first_hash"), F.col("blob").alias("first_blob")), "first_hash")
    schema = ", ".join(f"{c} long" for c in [*PAIR, *PLACES, "n_equal"]) + ", identity double"
    return joined.select(*PAIR, "xs", "ys", "blob", "first_blob").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, *, k: int = 8, window: int = 12, gap_cost: float = 0.25, most_gap: int = 40, least_words: int = 50, least_identity: float = 0.8) -> DataFrame:
    """A row per passage of a document that an earlier one (by id) has as well: doc_id, its words
    [start_word, end_word), first_id and the place there, equal words and their part, and the
    hashes of the two texts."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    names = written(docs.groupBy("doc_id").agg(F.min("text_hash").alias("only"), F.max("text_hash").alias("last")), "names")
    several, stretch = field_of(names.filter("only <> last").select("doc_id")), least_words - window + 1
    seeds = _seed_rows(docs, k, window, stretch, several=several)
    shared = seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first.doc_id <> last").drop("last")
    shared = written(shared, "shared")
    # most seeds are in one document only; the join decides
    again = _seed_rows(docs, k, window, stretch, field_of(shared.select("seed")), several)
    places = written(salted_join(again, shared.drop("n"), "seed", counts=shared), "places")
    anchors = places.filter("doc_id <> first.doc_id").select("doc_id", "text_hash", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "place", F.col("first.place").alias("first_place"))

    def passages(anchors: DataFrame) -> DataFrame:
        # a chain may be half as long as a passage, as its ends are extended
        chains = written(_named(_chains(anchors, k, gap_cost, most_gap, max(k, least_words // 2 - k)), names), "chains")
        hashes = chains.select("text_hash").unionByName(chains.select(F.col("first_hash").alias("text_hash"))).distinct()
        texts = written(packed_texts(docs, "text_hash", hashes), "texts")
        found = _aligned(chains, texts, k, least_words, least_identity)
        # chains that extend into each other give the same passage
        found = written(found.groupBy("doc_id", "first_id", *PLACES, "text_hash", "first_hash").agg(F.max("n_equal").alias("n_equal"), F.round(F.max("identity"), 6).alias("identity")), "passages")
        discard(chains, texts)
        return found

    found = passages(anchors)
    marked = written(_marked(places, found, k), "marked")
    discard(places)
    with tracked() as made:
        anchors = _nearest(marked, "seed", shared).unionByName(_stretched(marked, stretch, k))
    more = passages(anchors)
    discard(marked, shared, names)
    remove(docs.sparkSession, *made)
    return found.unionByName(more)


def _named(chains: DataFrame, names: DataFrame) -> DataFrame:
    """The chains with the hashes of their texts in place of ``ONLY``."""
    for doc_id, text_hash in (("doc_id", "text_hash"), ("first_id", "first_hash")):
        own = names.select(F.col("doc_id").alias("_id"), "only")
        chains = chains.join(own, F.col(doc_id) == F.col("_id")).withColumn(text_hash, F.when(F.col(text_hash) == ONLY, F.col("only")).otherwise(F.col(text_hash))).drop("_id", "only")
    return chains


def _marked(places: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The places of seeds with the document of the first one, and with ``open``: whether they are in no passage found.

    First places are never open, so only the others are compared with passages.
    """
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    covered = F.exists("spans", lambda s: (s["start_word"] <= F.col("place")) & (F.col("place") + k <= s["end_word"]))
    places = places.select("seed", "doc_id", "text_hash", "place", "stretch", F.col("first.doc_id").alias("first_doc"))
    others = places.filter("doc_id <> first_doc").join(spans, (F.col("doc_id") == F.col("_id")) & F.col("text_hash").isin(ONLY, F.col("_hash")), "left")
    return others.withColumn("open", ~F.coalesce(covered, F.lit(False))).drop("_id", "_hash", "spans").unionByName(places.filter("doc_id = first_doc").withColumn("open", F.lit(False)))


def _stretched(marked: DataFrame, stretch: int, k: int) -> DataFrame:
    """Anchors of stretches from open places to the first and the nearest earlier document that have all their words.

    Each gives anchors all along the stretch, as its words are equal.
    """
    here = F.struct(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), F.col("place").alias("first_place"))
    marked = marked.filter("stretch is not null")
    marked = written(_maybe_open(marked, "stretch"), "maybe-open")
    repeated = marked.groupBy("stretch").agg(F.min(here).alias("near"), F.max("doc_id").alias("last"), F.max("open").alias("any_open"), F.count(F.lit(1)).alias("n"))
    repeated = written(repeated.filter("any_open and near.first_id <> last").select("stretch", "near", "n"), "repeated-stretches")
    named = written(salted_join(marked, small(repeated.drop("n")), "stretch", counts=repeated).select("stretch", "doc_id", "text_hash", "place", "first_doc", "open", "near"), "stretches")
    found = named.filter("open and near.first_id <> doc_id").select("doc_id", "text_hash", "place", "near.*").unionByName(_nearest(named.drop("near"), "stretch", repeated))
    along = F.explode(F.sequence(F.lit(0), F.lit(stretch - k), F.lit(k)))
    return found.select("*", along.alias("on")).select("doc_id", "text_hash", (F.col("place") + F.col("on")).alias("place"), "first_id", "first_hash", (F.col("first_place") + F.col("on")).alias("first_place"))


def _maybe_open(marked: DataFrame, key: str) -> DataFrame:
    """The places whose ``key`` is at an open place as well, and a few more."""
    return maybe_in(marked, key, marked.filter("open").select(key)).filter("maybe").drop("maybe")


def _nearest(marked: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Anchors of the open places to the nearest earlier document with the same ``key``.

    A key's places are sorted within blocks of ids, as it may be in very many documents;
    the last place before a block is carried into it, one row for each key and block.
    """
    places = written(salted_join(_maybe_open(marked, key), marked.filter("open").select(key).distinct(), key, counts=counts), "open-places")
    ends = marked.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, width = ends["low"] or 0, max(1, ((ends["high"] or 0) - (ends["low"] or 0)) // BLOCKS + 1)
    block = F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)).cast("int")
    here = F.struct(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), F.col("place").alias("first_place"))
    blocked = places.withColumn("block", block).repartition(key, "block")
    carried = blocked.groupBy(key, "block").agg(F.max(here).alias("last_one"))
    carried = carried.select(key, "block", F.lag("last_one").over(Window.partitionBy(key).orderBy("block")).alias("carried"))
    before = F.lag(here).over(Window.partitionBy(key, "block").orderBy("doc_id", "text_hash", "place"))
    ranked = blocked.withColumn("near", before).filter("open").join(carried, [key, "block"]).withColumn("near", F.coalesce("near", "carried"))
    return ranked.filter("near is not null and near.first_id <> doc_id and near.first_id <> first_doc").select("doc_id", "text_hash", "place", "near.*")
