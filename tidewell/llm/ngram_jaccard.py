"""Exact Jaccard join of documents on word shingles, by a token-group matrix.

1. A document is the set of its distinct k-word shingles, as 50-bit tokens.  Documents with
   equal sets are one class (a 64-bit hash of the set), so copies are never paired.
2. Tokens have one order: frequent ones last (those in at least N / 4096 documents, or in more
   if these are above ``MOST_FREQUENT``; they are counted and broadcast), else by hash.  Which
   tokens count as frequent is for speed only.
   Similar sets share ``need(n)`` tokens of their first ``width(n)``, so only these are kept,
   and of these only tokens of two classes or more.
3. Each class is compared with the centre of every token it has: the class whose tokens are
   the least rare, which a text has that others were edited from.  Classes near a centre form
   its group: similar documents, their distances to the centre known, linked to it or not.
   Tokens that no other class has in its prefix bound what a pair can share, but only those
   of the class whose prefix ends first: the other's suffix may hold those of the longer one.
4. The token-group matrix holds the union of each group's tokens.  A class and a group with
   another component qualify if the class's tokens overlap the union enough, sizes fit, and
   the distance to the centre allows a member within reach (Jaccard distance is a metric).
   Only qualifying groups are opened, and of them only members that these bounds allow.
5. Opened pairs are compared by their full sets; links of both steps give the components.
6. Where links are counted, "another component" in 4 reads "another group", so that every link
   between groups is made.  Within a group, members are dealt into blocks, and a task counts the
   links between two blocks by a matrix product; of a large group, blocks hold members of like
   distance to the centre, and blocks so near it that all their pairs link, or so far apart that
   none does, are not compared.

All comparisons that decide use full sets and integers.  For the components alone, pairs within
a component that is known already are never made, so a group of n near copies costs n
comparisons, not n * n.

Defined results: texts without words (or null) have an empty set and link with nothing; with
fewer than k words the whole sequence is the one shingle; repeated rows and equal ids are one
class if their sets are equal; null ids never name a component that has another (one of null ids only has none); an empty
table gives an empty result; further columns are ignored by ``similar``, kept by ``one_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import textkit as tk
from tidewell.llm.bitfield import maybe_in, packed_texts
from tidewell.llm.components import components
from tidewell.llm.store import Carried, batches_of
from tidewell.sources.shared import alone, discard, written

#: Tokens that a counting task sorts at a time, and how often it must meet one to report it.
COUNTED, MET = 1 << 21, 6
#: Pairs of packed texts in an Arrow batch.
PAIR_ROWS = 256
LAST = 2**63 - 1
#: Frequent tokens that are broadcast at most (16 bytes each).
MOST_FREQUENT = 1 << 20
#: Distance to a centre up to which a class joins its group, whether it links or not.
NEAR = 0.4
#: Members of a block of a group, and tokens of a block pair that are multiplied at a time.
BLOCK, COLUMNS = 128, 4096


def need(n: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Tokens that two similar sets share in their prefixes, the smaller set having n; never more than they share at all."""
    if isinstance(n, np.ndarray):
        return np.minimum(1 + n // 40, (percent * n + 99) // 100)
    return F.least(1 + F.floor(n / 40), F.floor((percent * n + 99) / 100))


def width(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix of a set of n tokens."""
    return np.minimum(n, n - (percent * n + 99) // 100 + need(n, percent))


def shingle_sets(part: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token) of the sets of a slice, in order, and the sets' sizes."""
    row, token = tk.distinct(*tk.window_hashes(tk.Words(part, lower=True), k))
    return row, token, np.bincount(row, minlength=len(part))


def class_of(token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return tk.mix(tk.segment_sums(tk.mix(token), size) + size.astype(np.uint64)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, pa.Array]]:
    for batch in batches:
        for at, part in tk.slices(batch.column("text")):
            yield batch, at, part


def frequent_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many documents and, for order only, about how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token = np.concatenate([*held, np.zeros(0, np.uint64)])
            held.clear()
            token.sort()
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))[: len(token)]
            n = np.diff(np.append(first, len(token)))
            often = n >= MET
            return pa.RecordBatch.from_arrays([pa.array(token[first][often].astype(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for _, _, part in _texts(batches):
            held.append(shingle_sets(part, k)[1])
            if sum(map(len, held)) > COUNTED:
                yield counted()
        yield counted()

    least = max(32, docs.count() // 4096)
    counts = written(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "frequent")
    while counts.filter(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    found = counts.filter(F.col("n") >= least).toArrow()
    discard(counts)
    order = np.argsort(found["token"].to_numpy())
    return found["token"].to_numpy()[order].astype(np.uint64), found["n"].to_numpy()[order]


def _set_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, key, class, n, prefix, end): a row per document; the prefix once a class and task.

    ``end`` is the place of the prefix's last token in the order of tokens, or LAST if the
    prefix is the whole set.
    """
    frequent: Broadcast = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = frequent.value
        standing = np.zeros(len(often), dtype=np.int64)
        standing[np.lexsort((often, times))] = np.arange(len(often)) + (1 << tk.TOKEN_BITS)
        met: set[int] = set()
        for batch, at, part in _texts(batches):
            row, token, size = shingle_sets(part, k)
            own = class_of(token, size)
            rank = token.astype(np.int64)
            if len(often):
                place = np.minimum(np.searchsorted(often, token), len(often) - 1)
                rank = np.where(often[place] == token, standing[place], rank)
                order = np.lexsort((rank, row))
                row, token, rank = row[order], token[order], rank[order]
            fresh = np.zeros(len(part), dtype=bool)
            for i, c in enumerate(own.tolist()):
                if size[i] and c not in met:
                    met.add(c)
                    fresh[i] = True
            keep = np.where(fresh, width(size, percent), 0)
            begin = np.cumsum(size) - size
            inside = (np.arange(len(token)) - np.repeat(begin, size)) < np.repeat(keep, size)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep)).astype(np.int32)), pa.array(token[inside].astype(np.int64)))
            end = np.full(len(part), LAST, dtype=np.int64)
            cut = (keep > 0) & (keep < size)
            end[cut] = rank[(begin + keep - 1)[cut]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(part)), batch.column("key").slice(at, len(part)), pa.array(own), pa.array(size.astype(np.int64)), prefix, pa.array(end)],
                names=["doc_id", "key", "class", "n", "prefix", "end"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id {id_type}, key long, class long, n long, prefix array<long>, end long")


def _compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(u, v, shared, together): sizes of intersection and union of each pair's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def result(pairs_: list[tuple[int, int]], sides: tuple[list[bytes], list[bytes]]) -> pa.RecordBatch:
            rows, tokens, size = zip(*(shingle_sets(pa.array([x.decode() for x in side], pa.large_string()), k) for side in sides), strict=True)
            packed = np.sort(np.concatenate([(r.astype(np.uint64) << np.uint64(tk.TOKEN_BITS)) | t for r, t in zip(rows, tokens, strict=True)]))
            both = packed[1:][packed[1:] == packed[:-1]]
            shared = np.bincount((both >> np.uint64(tk.TOKEN_BITS)).astype(np.int64), minlength=len(pairs_))
            u, v = np.array(pairs_, dtype=np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(shared), pa.array(size[0] + size[1] - shared)], names=["u", "v", "shared", "together"])

        for batch in batches:
            held, sides, length = [], ([], []), 0
            columns = [batch.column(c) for c in ("u", "v", "blob_u", "blob_v")]
            for r in range(batch.num_rows):
                u, v, *blobs = (c[r].as_py() for c in columns)
                held.append((u, v))
                for side, blob in zip(sides, blobs, strict=True):
                    side.append(unpack(blob))
                    length += len(side[-1])
                if length > tk.SLICE_BYTES or len(held) >= tk.SLICE_ROWS:
                    yield result(held, sides)
                    held, sides, length = [], ([], []), 0
            if held:
                yield result(held, sides)

    of = lambda side: texts.select(F.col("class").alias(side), F.col("blob").alias(f"blob_{side}"))
    return pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").mapInArrow(run, "u long, v long, shared long, together long")


def _block_links(members: DataFrame, texts: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Links between members of one group: (class, rep, links) of each block pair a class is in,
    and (class, links) of those that need no comparison.

    ``members`` has class, group, distance, copies.  ``links`` counts the copies of linked classes;
    ``rep`` is a class that links within the block pair reach.
    """

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        plain = pa.array([unpack(b.as_py()).decode() for b in table["blob"]], pa.large_string())
        side, copies, names = (table[c].to_numpy() for c in ("side", "copies", "class"))
        rows, tokens, sizes = zip(*((row + at, token, size) for at, part in tk.slices(plain) for row, token, size in [shingle_sets(part, k)]), strict=True)
        row, size = np.concatenate(rows), np.concatenate(sizes)
        _, column = np.unique(np.concatenate(tokens), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(size), len(size)))
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, (low, low + COLUMNS))
            held = np.zeros((len(size), min(COLUMNS, int(column[-1]) + 1 - low)), dtype=np.float32)
            held[row[a:b], column[a:b] - low] = 1
            shared += held @ held.T
        link = 100 * shared >= percent * (size[:, None] + size - shared)
        link &= side[:, None] != side if side.any() else ~np.eye(len(size), dtype=bool)
        label = np.arange(len(size))
        while (least := np.minimum(label, np.where(link, label, len(size)).min(axis=1))).tolist() != label.tolist():
            label = least
        return pa.table({"class": names, "rep": names[label], "links": link @ copies})

    # all members of a small group are one block; those of a large one are dealt by distance to the centre
    whole = members.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    placed = members.join(whole, "group").withColumn("large", F.col("members") > BLOCK).withColumn("step", F.when(F.col("large"), F.floor(100 * F.col("distance")).cast("int")).otherwise(0))
    steps = placed.groupBy("group", "large", "step").agg(F.count(F.lit(1)).alias("times"), F.sum("copies").alias("mass"))
    steps = written(steps.withColumn("salts", F.ceil(F.col("times") / BLOCK).cast("int")), "steps")
    placed = written(placed.join(steps.select("group", "step", "salts"), ["group", "step"]).withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).select("class", "group", "large", "step", "salt", "copies"), "dealt")
    most = 100 - percent
    # d < (step + 1) / 100, so a pair's distance is at most the sum of both and at least their difference
    surely = F.col("large") & (F.col("step") + F.col("other") + 2 <= most)
    never = F.col("large") & (F.abs(F.col("step") - F.col("other")) - 1 > most)
    both = steps.join(steps.select("group", F.col("step").alias("other"), F.col("salts").alias("other_salts"), F.col("mass").alias("other_mass")), "group")
    masses = both.filter(surely).groupBy("group", "step").agg(F.sum("other_mass").alias("mass"))
    own = F.when(2 * F.col("step") + 2 <= most, F.col("copies")).otherwise(0)
    certain = placed.filter("large").join(masses, ["group", "step"]).select("class", (F.col("mass") - own).alias("links"))
    compared = both.filter(~surely & ~never & (F.col("step") <= F.col("other"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("other_salt", F.explode(F.sequence(F.lit(0), F.col("other_salts") - 1)))
    compared = compared.filter((F.col("step") < F.col("other")) | (F.col("salt") <= F.col("other_salt"))).select("group", "step", "salt", "other", "other_salt")
    place = ["group", "step", "salt", "other", "other_salt"]
    left = placed.join(compared, ["group", "step", "salt"]).select(*place, F.lit(0).alias("side"), "class", "copies")
    right = placed.withColumnsRenamed({"step": "other", "salt": "other_salt"}).join(compared.filter("step <> other or salt <> other_salt"), ["group", "other", "other_salt"])
    dealt = left.unionByName(right.select(*place, F.lit(1).alias("side"), "class", "copies")).join(texts, "class")
    return written(dealt.groupBy(*place).applyInArrow(run, "class long, rep long, links long"), "block-links"), certain


def similar(docs: DataFrame, *, k: int, percent: int, count_links: bool = True) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, and to how many other documents it links.

    Two documents link if 100 * intersection >= percent * union of their sets; component_id is
    the least doc_id that links reach.  ``n_links`` counts every other row that links, copies
    included; without ``count_links`` it is left out, and links that no component needs are not
    made.  ``least_id`` and ``least_key`` say which document, by id and text hash, stands for the
    component.
    """
    rows = written(_set_rows(docs, k, percent), "sets")
    full = rows.filter("n > 0")
    classes = written(full.groupBy("class").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("doc_id"), F.col("key").alias("key"))).alias("m"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")).select("class", "n", "copies", F.col("m.doc_id").alias("first_id"), F.col("m.key").alias("key")), "classes")

    # tokens of two classes or more; a class has one prefix, though several tasks may have met it
    prefixes = full.filter(F.size("prefix") > 0).select("class", "n", "prefix", "end")
    again = prefixes.groupBy("class").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("class")
    tested = maybe_in(prefixes, "class", again).withColumn("width", F.size("prefix"))
    once = tested.filter("not maybe").unionByName(tested.filter("maybe").dropDuplicates(["class"]))
    tokens = once.select(F.explode("prefix").alias("token"), "class", "n", "width", "end")
    shared_tokens = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    matrix = written(tokens.join(shared_tokens, "token"), "matrix")
    # a class of which no token is rare is the likely centre of its copies; own tokens bound what it can share
    standing = matrix.groupBy("class").agg((F.sum("times") / F.first("width")).alias("weight"), (F.first("width") - F.count(F.lit(1))).alias("own"))
    unweighed, matrix = matrix, written(matrix.join(standing, "class").select("token", "class", "n", "weight", "own", "end"), "weighed")
    discard(unweighed)
    centres = matrix.groupBy("token").agg(F.max(F.struct("weight", "class", "n", "own", "end")).alias("centre"))

    def may(n: Column, own: Column, end: Column, m: Column, other: Column, other_end: Column) -> Column:
        """Whether sets of n and m tokens can link: own tokens of the prefix that ends first are not in the other set."""
        most = F.least(n - F.when(end <= other_end, own).otherwise(0), m - F.when(other_end <= end, other).otherwise(0))
        return 100 * most >= percent * (n + m - most)

    n, own, end = F.col("n"), F.col("own"), F.col("end")
    centre = F.col("centre")
    spokes = written(
        matrix.join(centres, "token").filter((F.col("class") != centre["class"]) & may(n, own, end, centre["n"], centre["own"], centre["end"])).select(centre["class"].alias("u"), F.col("class").alias("v")).distinct(), "spokes"
    )
    wanted = matrix.select("class").distinct().join(classes.select("class", "key"), "class")
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    texts = written(packed_texts(keyed, "key", wanted).join(wanted, "key").select("class", "blob"), "texts")
    linked = 100 * F.col("shared") >= percent * F.col("together")
    with batches_of(docs.sparkSession, PAIR_ROWS):
        around = written(_compared(spokes, texts, k).withColumn("link", linked).withColumn("distance", 1 - F.col("shared") / F.col("together")), "around")
    discard(spokes)

    # groups: a class belongs to the nearest centre within NEAR, or is a group of its own
    parts = components(around.filter("link").select("u", "v"))
    nearest = around.filter(F.col("distance") <= NEAR).groupBy(F.col("v").alias("class")).agg(F.min(F.struct("distance", F.col("u").alias("group"))).alias("g"))
    grouped = (
        matrix.select("class", "n", "own", "end")
        .distinct()
        .join(nearest, "class", "left")
        .join(parts.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "n", "own", "end", F.coalesce("g.group", "class").alias("group"), F.coalesce("g.distance", F.lit(0.0)).alias("distance"), F.coalesce("component", "class").alias("component"))
    )
    # what two classes must differ in to be opened: pairs within it are linked already, or counted by blocks
    grouped = written(grouped.withColumn("part", F.col("group" if count_links else "component")), "groups")
    groups = grouped.groupBy("group").agg(F.max("distance").alias("radius"))

    # the token-group matrix, where a token is in more than one part
    placed = matrix.select("token", "class").join(grouped.select("class", "group", "part", "n", "own", "end"), "class")
    open_tokens = placed.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("token")
    placed = written(placed.join(open_tokens, "token", "left_semi"), "placed")
    union_ = placed.groupBy("token", F.col("group").alias("near")).agg(F.min("part").alias("first_part"), F.min("n").alias("least_n"), F.max("n").alias("most"), F.min("end").alias("least_end"))
    reach = (100 - percent) / 100 + 1e-9
    group_most = F.least(n - F.when(end <= F.col("least_end"), own).otherwise(0), F.col("most"))
    qualifying = (
        placed.drop("group")
        .join(union_, "token")
        .filter((F.col("part") > F.col("first_part")) & (100 * group_most >= percent * (n + F.col("least_n") - group_most)))
        .groupBy("class", "n", "own", "end", "part", F.col("near").alias("group"))
        .agg(F.count(F.lit(1)).alias("overlap"), F.min("least_n").alias("least_n"))
        .filter(F.col("overlap") >= F.least(need(n, percent), need(F.col("least_n"), percent)))
        .join(groups, "group")
        .join(around.select(F.col("u").alias("group"), F.col("v").alias("class"), F.col("distance").alias("to_centre")), ["group", "class"], "left")
        .filter(F.col("to_centre").isNull() | (F.col("to_centre") <= F.col("radius") + reach))
    )
    members = grouped.select("group", F.col("class").alias("member"), F.col("n").alias("member_n"), F.col("own").alias("member_own"), F.col("end").alias("member_end"), F.col("part").alias("member_part"), "distance")
    known = F.when(F.col("class") == F.col("group"), F.lit(0.0)).otherwise(F.col("to_centre"))
    opened = (
        qualifying.select("class", "n", "own", "end", "part", "group", known.alias("to_centre"))
        .join(members, "group")
        .filter(
            (F.col("part") > F.col("member_part"))
            & may(n, own, end, F.col("member_n"), F.col("member_own"), F.col("member_end"))
            & (F.col("to_centre").isNull() | (F.abs(F.col("to_centre") - F.col("distance")) <= reach))
        )
        .select(F.col("class").alias("u"), F.col("member").alias("v"))
        .distinct()
    )
    if count_links:  # pairs with a centre are known
        opened = opened.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        opened = opened.join(around.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
    opened = written(opened, "opened")
    discard(placed, matrix)
    with batches_of(docs.sparkSession, PAIR_ROWS):
        late = written(_compared(opened, texts, k).filter(linked).select("u", "v"), "late")
    discard(opened)
    links = around.filter("link").select("u", "v").unionByName(late)
    if count_links:
        copies = classes.select("class", "copies")
        members = grouped.filter(F.col("class") != F.col("group")).select("class", "group", "distance").join(copies, "class")
        inner, certain = _block_links(members, texts, percent, k)
        of = lambda side: members.select(F.col("class").alias(side), F.col("group").alias(f"group_{side}"))
        single = links.join(of("u"), "u", "left").join(of("v"), "v", "left").filter("group_u is null or group_v is null or group_u <> group_v").select("u", "v")
        single = single.unionByName(single.select(F.col("v").alias("u"), F.col("u").alias("v")))
        counted = single.join(copies.withColumnRenamed("class", "v"), "v").select(F.col("u").alias("class"), F.col("copies").alias("links"))
        counted = written(counted.unionByName(inner.select("class", "links")).unionByName(certain).groupBy("class").agg(F.sum("links").alias("links")), "counted")
        links = links.unionByName(inner.filter("class <> rep").select(F.col("class").alias("u"), F.col("rep").alias("v")))
    discard(grouped, texts)
    if count_links or not late.isEmpty():
        parts = components(links)

    # back to the documents: copies by their class
    named = classes.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min(F.struct("first_id", "key")).alias("least"))
    if count_links:
        named = named.join(counted, "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    n_links = ["n_links"] if count_links else []
    named = named.join(least, "component").select("class", F.col("least.first_id").alias("least_id"), F.col("least.key").alias("least_key"), *n_links)
    component = F.when(F.col("n") > 0, F.when(F.col("least_id") < LAST, F.col("least_id"))).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
        .join(named, "class", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in n_links), "key", "least_id", "least_key")
    )


def one_each(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: that of the least doc_id (null last), of equal ids that of
    the least text hash, of equal rows one; all texts without words stay.

    Only rows whose text may be a surplus one's are shuffled.
    """
    found = alone(lambda: similar(docs, k=k, percent=percent, count_links=False).filter("n_shingles > 0").select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("key").alias("_key"), "least_id", "least_key"), "found")
    stays = (F.col("_id") == F.col("least_id")) & (F.col("_key") == F.col("least_key"))
    marks = found.groupBy("_id", "_key").agg(F.first(stays).alias("_stays"), F.count(F.lit(1)).alias("_times")).filter("not _stays or _times > 1").select("_id", "_stays", "_key")
    carried = Carried(docs)
    tested = maybe_in(carried.frame.withColumn("key", F.xxhash64(carried.of("text"))), "key", marks)
    marked = tested.filter("maybe").join(marks, (F.coalesce(carried.of("doc_id"), F.lit(LAST)) == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    repeated = marked.filter("_stays").dropDuplicates(["_id", "_key"])
    return carried.back(tested.filter("not maybe").unionByName(marked.filter("_stays is null").unionByName(repeated), allowMissingColumns=True))


def oracle(k: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of document, set size and component, by all pairs that share a shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) END AS g FROM d),
t AS (SELECT r, unnest(g) AS t FROM s),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS shared FROM t a JOIN t b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN s x ON x.r = u JOIN s y ON y.r = v WHERE 100 * shared >= {percent} * (len(x.g) + len(y.g) - shared)),
links AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT r, r AS root FROM s UNION SELECT links.v, root FROM reach JOIN links ON links.u = reach.r)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN s ON s.r = reach.r JOIN s o ON o.r = reach.root GROUP BY s.r, s.doc_id, s.g"""
