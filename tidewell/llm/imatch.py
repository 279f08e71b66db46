"""I-Match fingerprints of documents.

Terms are lower-cased words, as 63-bit hashes.  Those whose inverse document frequency, as a
part of its largest value ``log(N)``, is in the band make up the lexicon: counted exactly over
all documents, and stored as sorted hash arrays that tasks map into memory, so its size isn't
limited.  A document has its terms in the lexicon and, however frequent, the ``ALWAYS`` of its terms of
least hash, so that texts of common words have some too.  Its distinct terms are sorted and
hashed for several lexicons, as I-Match does:

- the whole one, and ``DENSE`` randomised ones, each of which leaves out a quarter of it;
- ``SUBSETS`` randomised ones that hold 1/8 of it, as many that hold 1/16, and so on to 1/2048
  (of the first two sizes there are no more than 8 and 16).

Documents that share a signature of a dense lexicon differ in few terms.  After an edit of a
quarter of a text such a lexicon always holds a term that changed, so likeness is told by the
lexicons that hold about two terms of the larger document: a signature of m terms is shared if all
m are, so if p of those that either document fills are equal, the two share about ``p ** (1 / m)`` of their
terms.  That is the likeness of two fingerprints; it is 1 if the whole signatures are equal.

A fingerprint is a string of hex digits: 8 for the number of terms, 16 for each dense
signature, 4 for each other one (hyphens if the document has no term there).

Defined results: null text counts as empty; a text without words has a fingerprint without
hashes, of likeness 1 to another such and 0 to others; equal texts have equal fingerprints; a
single document is its own next; null ids come last, equal ids in the order of their packed
texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import textkit as tk
from tidewell.llm.hash_arrays import HashArrays, write_arrays
from tidewell.sources.shared import discard, written

DENSE, LEFT_OUT = 7, 4
SUBSETS = 32
GROUPS = tuple(1 << k for k in range(3, 12))
ALWAYS = 4
LAST = 2**63 - 1
HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
#: Documents of one piece of the ordered table, and the most pieces.
PIECE_ROWS, MOST_PIECES = 1024, 1 << 16
#: Distinct terms that a counting task holds before it passes them on.
HELD = 1 << 20
BAND = (0.2, 0.95)


def terms(words: tk.Words, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) of the chosen words of a slice, ordered by row, then term."""
    row, term = words.row[rows], (words.hash[rows] >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))[: len(row)]
    return row[fresh], term[fresh]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(hash, n): in how many documents a term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            for _, part in tk.slices(batch.column("text")):
                held.append(terms(tk.Words(part, lower=True))[1])
                if sum(map(len, held)) > HELD:
                    yield counted()
        yield counted()

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, band: tuple[float, float]) -> HashArrays:
    """The terms in the band, as keys of sorted hash arrays."""
    total = docs.count()
    idf = F.log(F.lit(float(max(total, 1))) / F.col("n")) / float(np.log(max(total, 2)))
    inside = written(document_frequencies(docs).filter(idf.between(*band)).select(F.lit(0).alias("kind"), "hash", F.lit(1.0).cast("float").alias("value")), "lexicon")
    arrays = write_arrays(inside, "lexicon")
    discard(inside)
    return arrays


def lexicon_terms(column: pa.Array, words_of: HashArrays) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) of a slice: those in the lexicon, and the ``ALWAYS`` of least hash."""
    row, term = terms(tk.Words(column, lower=True))
    known, back = np.unique(term, return_inverse=True)
    inside = ~np.isnan(words_of.find(0, known))[back] if len(known) else np.zeros(0, bool)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = inside | (place < ALWAYS)
    return row[kept], term[kept]


#: Of rows: the numbers of terms, rows x (1 + DENSE) signatures, and rows x sizes x SUBSETS ones; 0 where no term is.
Prints = tuple[np.ndarray, np.ndarray, np.ndarray]


def signatures(column: pa.Array, words_of: HashArrays) -> Prints:
    """The fingerprints of a slice."""
    n = len(column)
    row, term = lexicon_terms(column, words_of)
    count = np.bincount(row, minlength=n)
    term = tk.mix(term.astype(np.uint64))
    dense = np.zeros((n, 1 + DENSE), dtype=np.uint64)
    for k in range(1 + DENSE):
        h = tk.mix(term + np.uint64(0xD1B54A32D192ED03 * (k + 1) & (2**64 - 1)))
        own = h % np.uint64(LEFT_OUT) != 0 if k else np.ones(len(h), bool)
        total = tk.segment_sums(np.where(own, tk.mix(h), np.uint64(0)), count)
        dense[:, k] = np.where(np.bincount(row[own], minlength=n) > 0, tk.mix(total) | np.uint64(1), 0)
    sparse = np.zeros((n, len(GROUPS), SUBSETS), dtype=np.uint64)
    for size, groups in enumerate(GROUPS):
        h = tk.mix(term + np.uint64(0x9E3779B97F4A7C15 * (size + 1) & (2**64 - 1)))
        group = (h & np.uint64(groups - 1)).astype(np.int64)
        own = np.flatnonzero(group < SUBSETS)
        place = row[own] * SUBSETS + group[own]
        order = np.argsort(place, kind="stable")
        place, first = np.unique(place[order], return_index=True)
        total = np.add.reduceat(tk.mix(h[own][order]), first) if len(first) else np.zeros(0, np.uint64)
        sparse[place // SUBSETS, size, place % SUBSETS] = (tk.mix(total) >> np.uint64(48)) | np.uint64(1)
    return count, dense, sparse


def _digits(hashes: np.ndarray, n_digits: int) -> np.ndarray:
    shifts = np.arange(4 * n_digits - 4, -1, -4, dtype=np.uint64)
    digits = HEX[((hashes[:, :, None] >> shifts) & np.uint64(15)).astype(np.uint8)]
    digits[hashes == 0] = ord("-")
    return digits.reshape(len(hashes), hashes.shape[1] * n_digits)


def as_strings(prints: Prints) -> pa.Array:
    """The fingerprints as strings."""
    count, dense, sparse = prints
    n = len(count)
    number = HEX[(count.astype(np.uint64)[:, None] >> np.arange(28, -1, -4, dtype=np.uint64) & np.uint64(15)).astype(np.uint8)]
    text = np.ascontiguousarray(np.concatenate([number, _digits(dense, 16), _digits(sparse.reshape(n, len(GROUPS) * SUBSETS), 4)], axis=1))
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * text.shape[1]), pa.py_buffer(text))


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    most = np.maximum(a[0], b[0])
    size = np.clip(np.round(np.log2(np.maximum(most, 1) / 2)).astype(np.int64) - 3, 0, len(GROUPS) - 1)  # about two terms a subset
    at = np.arange(len(most))
    own, other = a[2][at, size], b[2][at, size]
    either = (own > 0) | (other > 0)
    equal = ((own == other) & either).sum(axis=1) / np.maximum(either.sum(axis=1), 1)
    of = np.maximum(1.0, most / np.array(GROUPS)[size])  # terms of a signature
    return np.where(a[1][:, 0] == b[1][:, 0], 1.0, np.round(equal ** (1 / of), 9))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of another."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprints(docs: DataFrame, *, band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, fingerprint) of every document; ``band`` is of idf as a part of its largest value."""
    words_of = lexicon(docs, band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tk.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), as_strings(signatures(part, words_of))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_pieces(docs: DataFrame) -> DataFrame:
    """Documents by ascending id in pieces: (piece, ahead, doc_id, packed text), a row more
    (``ahead``) for the document that follows a piece's last.

    The bounds of pieces are ids that occur, so the first document of a piece has the bound
    as its id, and goes to the piece before as well.  Texts are compressed for the shuffle.
    """
    total = docs.count()
    pieces = max(1, min(MOST_PIECES, -(-total // PIECE_ROWS)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"))
    cuts = ids.stat.approxQuantile("doc_id", [i / pieces for i in range(pieces)], 1 / (4 * pieces)) if total else [0.0]
    first = ids.agg(F.min("doc_id")).first()[0]
    bounds = np.unique(np.array([first if first is not None else 0, *(int(c) for c in cuts)], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
                blobs = [packer.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                piece = np.searchsorted(bounds, ids, side="right") - 1
                ahead = np.flatnonzero(bounds[piece] == ids)
                row = np.concatenate([np.arange(len(ids)), ahead])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([piece, (piece[ahead] - 1) % len(bounds)]).astype(np.int32)),
                        pa.array(np.arange(len(row)) >= len(ids)),
                        part.column("doc_id").take(pa.array(row)),
                        pa.array([blobs[r] for r in row.tolist()], pa.binary()),
                    ],
                    names=["piece", "ahead", "doc_id", "blob"],
                )

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(run, "piece int, ahead boolean, doc_id long, blob binary")
        .repartition(max(1, min(len(bounds), 20_000)), "piece")
        .sortWithinPartitions("piece", "ahead", F.col("doc_id").asc_nulls_last(), "blob")
    )


def with_edits(docs: DataFrame, *, band: tuple[float, float] = BAND) -> DataFrame:
    """Per document: its fingerprint and its edited text's, how alike they are, it and the next
    one's, and whether they share a signature."""
    words_of = lexicon(docs, band)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, match_edited boolean, match_next boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int | None, str]] = []  # documents of a piece in order
        size, piece, following = 0, -1, None

        def of(texts: list[str]) -> Prints:
            parts = [signatures(p, words_of) for _, p in tk.slices(pa.array(texts, pa.large_string()))]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        def result(after: str) -> pa.RecordBatch:
            """Of all that is held; ``after`` is the text of the document that follows."""
            texts = [t for _, t in held]
            others = [edited(t, n) for t, n in zip(texts, [*texts[1:], after], strict=True)]
            every = of([*texts, after])
            own, later, changed = tuple(x[:-1] for x in every), tuple(x[1:] for x in every), of(others)
            shares = lambda a, b: pa.array(((a[1] == b[1]) & (a[1] > 0)).any(axis=1))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in others], pa.string()),
                    as_strings(own),
                    as_strings(changed),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, later)),
                    shares(own, changed),
                    shares(own, later),
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

        for batch in batches:
            columns = [batch.column(c) for c in ("piece", "ahead", "doc_id", "blob")]
            for k in range(batch.num_rows):
                own, ahead, doc, blob = (c[k].as_py() for c in columns)
                if own != piece:
                    if held:
                        yield result(following)
                    held, size, piece, following = [], 0, own, None
                text = unpack(blob).decode() if not ahead or following is None else ""
                if ahead:
                    following = text if following is None else following
                    continue
                if size > tk.SLICE_BYTES:
                    yield result(text)
                    held, size = [], 0
                held.append((doc, text))
                size += len(text)
        if held:
            yield result(following)

    return in_pieces(docs).mapInArrow(run, schema)
