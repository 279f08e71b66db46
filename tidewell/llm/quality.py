"""Quality rules: counts of repetition and symbols, and n-gram perplexity in language bands.

The perplexity is that of a character 5-gram model per language with modified Kneser-Ney
smoothing.  Tasks count the 5-grams of all distinct texts (copies of a text would teach the
model its own junk), Spark sums the counts, and the smoothed probabilities of orders 1 to 5
are Spark aggregations over the summed table.  What is gathered grows with the input.  Tasks
store the model as sorted hash arrays in the shared folder, which the scoring tasks map into
memory: the driver never holds it, and its size is not limited by a worker's memory.

A character is its code point below 3072, or else one of 1023 classes (so the rarer scripts
are modelled by class), as a 5-gram then is a 60-bit number; class 0 pads the start of a text.

A document passes if its log-perplexity per word is within its language's band.  The band is
around the median of the language's distinct scores, ``reach`` deviations wide.  The score of
a text of n words deviates by ``sqrt(v / n + floor ** 2)``: v comes from the median of
``|score - median| * sqrt(n)`` (so up to half of the distinct scores may be junk), and that of
a language with few distinct scores leans on all languages' (as ``FEW`` of them would).  Only
documents that pass the base rules count for the bands.

Defined results: null or empty text has 0 words and fails the base rules; null language is a
language of its own; repeated rows each get the same verdict; the model of a language with a
handful of distinct texts has learned each of them, so they are kept, as there is nothing to
compare them with; an empty table gives an empty result; further columns are ignored by
``assess`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import textkit as tk
from tidewell.llm.bitfield import BITS as FIELD_BITS
from tidewell.llm.bitfield import fitting, packed_bits, tested
from tidewell.llm.hash_arrays import HashArrays, write_arrays
from tidewell.llm.store import Carried, batches_of, small
from tidewell.sources.shared import alone, discard, remove, tracked, written

ORDER, BITS = 5, 12
CLASSES = 1 << BITS
PLAIN = 3072
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 1 << 20
#: Texts in an Arrow batch of a counting task.
TEXT_ROWS = 1024
#: Distinct scores that all languages together lend to each language's deviation.
FEW = 50
#: Languages up to which their few numbers each are broadcast (counted first).
MOST_LANGS = 100_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WHITE = " \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"  # fixed values


# --- counts of a text -------------------------------------------------------------------


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: tk.Words, k: int) -> np.ndarray:
    """Per row: words that stand in a window of k words found twice or more in the row."""
    rows = len(words.count)
    if len(words.hash) < k:
        return np.zeros(rows, np.int64)
    full = reduce(lambda h, i: h * np.uint64(0x9FB21C651E98DF25) + words.hash[i : len(words.hash) - k + 1 + i], range(k), np.zeros(len(words.hash) - k + 1, np.uint64))
    start = np.flatnonzero(words.row[: len(full)] == words.row[k - 1 :])
    key = tk.mix(full[start] ^ (words.row[start].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(start), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(change, start[again], 1)
    np.add.at(change, start[again] + k, -1)
    return np.bincount(words.row[np.cumsum(change[:-1]) > 0], minlength=rows)


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The metrics of each row of a slice."""
    words = tk.Words(column)
    data, offsets = words.bytes, words.offsets
    inside = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
    symbol = np.zeros(256, dtype=bool)
    symbol[np.frombuffer(SYMBOLS, dtype=np.uint8)] = True
    again = []
    for text in column.to_pylist():
        seen: set[str] = set()
        count = 0
        for line in text.split("\n"):
            if line in seen:
                count += 1
            elif line.strip(WHITE):
                seen.add(line)
        again.append(count)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": _per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(symbol[data], offsets),
        "n_dup_lines": np.array(again, dtype=np.int64),
        "n_repeat_words": repeated_words(words, 5).astype(np.int64),
    }


# --- n-grams ----------------------------------------------------------------------------


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each character of a slice, in order; characters of each row."""
    data, offsets = tk.raw(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    count = _per_row((data & 0xC0) != 0x80, offsets)
    folded = PLAIN + (points * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(CLASSES - 1 - PLAIN)
    kind = np.where(points == 0, CLASSES - 1, np.where(points < PLAIN, points, folded)).astype(np.uint64)
    padded = np.zeros(len(kind) + (ORDER - 1) * len(count), dtype=np.uint64)
    place = np.arange(len(kind)) + np.repeat((ORDER - 1) * np.arange(1, len(count) + 1), count)
    padded[place] = kind
    packed = padded[: len(padded) - ORDER + 1].copy() if len(padded) >= ORDER else np.zeros(0, np.uint64)
    for i in range(1, ORDER):
        packed <<= np.uint64(BITS)
        packed |= padded[i : len(packed) + i]
    return packed[place - (ORDER - 1)] if len(place) else packed[:0], count


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(language, rows, their texts) of a batch, in slices."""
    langs = np.array(batch.column("lang").to_pylist(), dtype=object)
    texts = batch.column("text")
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs == lang)
        for at, part in tk.slices(texts.take(pa.array(rows))):
            yield lang, rows[at : at + len(part)], part


def lang_name(lang: str = "lang") -> Column:
    """A name for each language, which differs for null and the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all distinct texts of each language.

    Texts that no other row has are counted where they are read; of each other text, one copy
    is shuffled and counted.
    """
    keyed = docs.select(lang_name().alias("lang"), "text").withColumn("key", F.xxhash64("lang", "text"))
    again = written(keyed.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("lang", "key"), "again")
    field = docs.sparkSession.sparkContext.broadcast(fitting(packed_bits(again, F.pmod("key", F.lit(1 << FIELD_BITS)), FIELD_BITS)))

    def counted(texts: Iterator[tuple[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        tk.forget()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (key, count) in held.items():
                for at in range(0, len(key), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key[part]), pa.string()), pa.array(key[part].astype(np.int64)), pa.array(count[part])], names=["lang", "gram", "n"])
            held.clear()

        for lang, part in texts:
            key, count = np.unique(grams(part)[0], return_counts=True)
            old = held.get(lang)
            held[lang] = _summed([old[0], key], [old[1], count]) if old else (key, count.astype(np.int64))
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple[str, pa.Array]]:
            for batch in batches:
                alone = ~tested(field.value, batch.column("key").to_numpy())
                for lang, _, part in _by_lang(batch.filter(pa.array(alone))):
                    yield lang, part

        yield from counted(texts())

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def texts() -> Iterator[tuple[str, pa.Array]]:
            for batch in _pieces(batches, 64):
                plain = pa.array([unpack(b.as_py()).decode() for b in batch.column("blob")], pa.large_string())
                for lang, _, part in _by_lang(pa.RecordBatch.from_arrays([batch.column("lang"), plain], names=["lang", "text"])):
                    yield lang, part

        yield from counted(texts())

    schema = "lang string, gram long, n long"
    # the key holds the language; texts that the field sends here by chance are single copies too
    maybe = keyed.select("lang", "key", "text").mapInArrow(_passed(field), "lang string, key long, blob binary").dropDuplicates(["lang", "key"])
    partial = keyed.mapInArrow(single, schema).unionByName(maybe.select("lang", "blob").mapInArrow(unpacked, schema))
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _passed(field: Broadcast):
    """Keeps rows whose key's bit is set, texts packed, each key once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        met: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            rows = [r for r in np.flatnonzero(tested(field.value, batch.column("key").to_numpy())).tolist() if not (keys[r] in met or met.add(keys[r]))]
            for at in range(0, len(rows), 512):
                own = pa.array(rows[at : at + 512])
                blobs = [packer.compress((t or "").encode()) for t in batch.column("text").take(own).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(own), batch.column("key").take(own), pa.array(blobs, pa.binary())], names=["lang", "key", "blob"])

    return run


def _discounts(table: DataFrame) -> DataFrame:
    """The three discounts of each language; where counts of counts are missing, 0.5, 1 and 1.5."""
    have = lambda c: F.sum((F.col("n") == c).cast("double"))
    of = table.groupBy("lang").agg(*(have(c).alias(f"n{c}") for c in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        value = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        return F.coalesce(F.when((value > 0) & (value < k), value), F.lit(k / 2)).alias(f"d{k}")

    return of.select("lang", discount(1), discount(2), discount(3))


def train(counts: DataFrame) -> DataFrame:
    """(lang, size, gram, logp, gap): log-probability of each n-gram of 1 to 5 characters, and
    the log weight of shorter n-grams after its first characters."""
    few = counts.select("lang").distinct().count() <= MOST_LANGS
    tables = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):  # in how many contexts an n-gram was met
        mask = (1 << (BITS * size)) - 1
        tables[size] = written(tables[size + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{size}")
    parts, shorter = [], None
    for size in range(1, ORDER + 1):
        context = Window.partitionBy("lang", F.shiftright("gram", BITS))
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = (
            tables[size]
            .join(F.broadcast(_discounts(tables[size])) if few else _discounts(tables[size]), "lang")  # four numbers a language
            .withColumn("off", off)
            .withColumn("total", F.sum("n").over(context).cast("double"))
            .withColumn("gap", F.sum("off").over(context) / F.col("total"))
        )
        if shorter is None:
            table = table.withColumn("lower", F.lit(1.0 / CLASSES))
        else:
            mask = (1 << (BITS * (size - 1))) - 1
            table = table.withColumn("end", F.col("gram").bitwiseAND(F.lit(mask))).join(shorter.select("lang", F.col("gram").alias("end"), F.col("p").alias("lower")), ["lang", "end"])
        table = written(table.select("lang", "gram", (F.greatest(F.col("n") - F.col("off"), F.lit(0.0)) / F.col("total") + F.col("gap") * F.col("lower")).alias("p"), "gap"), f"model{size}")
        shorter = table
        parts.append(table)
    model = reduce(DataFrame.unionByName, (t.select("lang", F.lit(size).alias("size"), "gram", F.log("p").alias("logp"), F.log("gap").alias("gap")) for size, t in enumerate(parts, 1)))
    model = written(model, "model")
    discard(*parts, *(tables[size] for size in range(1, ORDER)))
    return model


def _keyed(lang: str, size: int, gram: np.ndarray) -> np.ndarray:
    """63-bit hashes of n-grams of a language."""
    salt = tk.word_hashes(data := np.frombuffer(f"{size}:{lang}".encode(), dtype=np.uint8), np.array([0]), np.array([len(data)]))[0]
    return (tk.mix(gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ salt) >> np.uint64(1)).astype(np.int64)


LOGP, GAP = 0, 1


def stored(table: DataFrame) -> HashArrays:
    """The model table as sorted hash arrays: log-probabilities of n-grams, gaps of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, size = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("size").to_numpy()
            gram, logp, gap = (batch.column(c).to_numpy() for c in ("gram", "logp", "gap"))
            for own_lang in sorted(set(lang)):
                for own_size in np.unique(size[lang == own_lang]).tolist():
                    rows = np.flatnonzero((lang == own_lang) & (size == own_size))
                    context, first = np.unique(gram[rows] >> BITS, return_index=True)
                    for kind, key, value in ((LOGP, gram[rows], logp[rows]), (GAP, context, gap[rows][first])):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(_keyed(own_lang, own_size, key)), pa.array(value.astype(np.float32))], names=["kind", "hash", "value"])

    return write_arrays(written(table.select("lang", "size", "gram", "logp", "gap").mapInArrow(run, "kind int, hash long, value float"), "entries"), "model")


def log_probability(model: HashArrays, lang: str, gram: np.ndarray) -> np.ndarray:
    """Log-probability of the last character of each 5-gram; n-grams that were never met back off."""
    gram, back = np.unique(gram, return_inverse=True)
    out = model.find_any(LOGP, _keyed(lang, ORDER, gram))
    rest, gaps = np.flatnonzero(np.isnan(out)), 0.0
    for size in range(ORDER - 1, -1, -1):
        if not len(rest):
            break
        longer = gram[rest] & np.uint64((1 << (BITS * (size + 1))) - 1)
        gaps = gaps + np.nan_to_num(model.find_any(GAP, _keyed(lang, size + 1, longer >> np.uint64(BITS))), nan=0.0)
        found = model.find_any(LOGP, _keyed(lang, size, longer & np.uint64((1 << (BITS * size)) - 1))) if size else np.full(len(rest), -np.log(CLASSES))
        out[rest] = found + gaps
        gaps, rest = gaps[np.isnan(found)], rest[np.isnan(found)]
    return out[back]


def _score_rows(batch: pa.RecordBatch, model: HashArrays) -> list[pa.Array]:
    """The metrics of each row and, by ``model``, its log-perplexity per word."""
    found = {m: np.zeros(batch.num_rows, dtype=np.int64) for m in METRICS}
    mean = np.zeros(batch.num_rows)
    for lang, rows, part in _by_lang(batch):
        for name, values in text_counts(part).items():
            found[name][rows] = values
        gram, count = grams(part)
        total = np.zeros(len(gram) + 1)
        np.cumsum(log_probability(model, lang, gram), out=total[1:])
        end = np.cumsum(count)
        mean[rows] = (total[end] - total[end - count]) / np.maximum(found["n_words"][rows], 1)
    # rounded, as equal texts at other places of a sum differ in the last bits
    return [*(pa.array(found[m]) for m in METRICS), pa.array(np.round(-mean, 9))]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def model_of(docs: DataFrame) -> HashArrays:
    """The stored model of a corpus."""
    with tracked() as made:
        with batches_of(docs.sparkSession, TEXT_ROWS):
            counts = alone(lambda: count_grams(docs), "grams")
        model = stored(train(counts))
    remove(docs.sparkSession, *(path for path in made if path != model.folder))
    return model


def scored(docs: DataFrame, model: HashArrays, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns ``keep`` of each document, ``_lang`` (never null), its metrics and ``score``."""
    fixed, body = [*keep, "_lang"], text if text in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            own = pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column(body)], names=["lang", "text"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fixed), *_score_rows(own, model)], names=[*fixed, *METRICS, "score"])

    rows = docs.select(*keep, lang_name(lang).alias("_lang"), *([] if text in keep else [F.col(text).alias("_text")]))
    schema = T.StructType([*(rows.schema[c] for c in fixed), *(T.StructField(m, T.LongType()) for m in METRICS), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _medians(scores: DataFrame, value: Column, digits: int, by: list[str]) -> DataFrame:
    """The median of ``value``, rounded, in each group; what a task holds are the distinct rounded values."""
    steps = scores.groupBy(*by, F.round(value, digits).alias("step")).agg(F.count(F.lit(1)).alias("times"))
    return steps.groupBy(*by).agg(F.expr("percentile(step, 0.5D, times)").alias("median"), F.sum("times").alias("n"))


def bands(scores: DataFrame) -> DataFrame:
    """(_lang, centre, deviation) of each language; the deviation is that of a text of one word."""

    def made() -> DataFrame:
        distinct = written(scores.filter(f"not ({BASE_FAILED})").select("_lang", "score", "n_words").distinct(), "distinct")
        centres = small(written(_medians(distinct, F.col("score"), 3, ["_lang"]).select("_lang", F.col("median").alias("centre")), "centres"))
        off = written(distinct.join(centres, "_lang").select("_lang", (F.abs(F.col("score") - F.col("centre")) * F.sqrt("n_words")).alias("off")), "off")
        every = _medians(off, F.col("off"), 2, []).select(F.coalesce("median", F.lit(0.0)).alias("all_median"))  # one row
        own = _medians(off, F.col("off"), 2, ["_lang"]).join(F.broadcast(every), F.lit(True)).join(centres, "_lang")
        mean = (F.col("n") * F.col("median") ** 2 + FEW * F.col("all_median") ** 2) / (F.col("n") + FEW)
        return own.select("_lang", "centre", (1.4826 * F.sqrt(mean)).alias("deviation"))

    return small(alone(made, "bands"))


def _banded(found: DataFrame, by: DataFrame, reach: float, floor: float) -> DataFrame:
    """Adds ``lower``, ``upper``, ``base_failed`` and ``kept`` to ``found``, by the bands of languages."""
    wide = reach * F.sqrt(F.col("deviation") ** 2 / F.greatest("n_words", F.lit(1)) + floor**2)
    inside = F.coalesce(F.col("score").between(F.col("lower"), F.col("upper")), F.lit(False))
    placed = found.join(by, "_lang", "left").withColumns({"lower": F.col("centre") - wide, "upper": F.col("centre") + wide, "base_failed": F.expr(BASE_FAILED)})
    return placed.withColumn("kept", ~F.col("base_failed") & inside)


def assess(docs: DataFrame, *, reach: float = 3.5, floor: float = 0.2) -> DataFrame:
    """Per document: the metrics, ``base_failed``, ``kept``, its perplexity and band."""
    found = alone(lambda: scored(docs, model_of(docs), ["doc_id"]), "scores")
    return _banded(found, bands(found), reach, floor).select("doc_id", *METRICS, "base_failed", "kept", F.exp("score").alias("perplexity"), F.exp("lower").alias("band_lower"), F.exp("upper").alias("band_upper"))


def keep_good(docs: DataFrame, *, reach: float = 3.5, floor: float = 0.2) -> DataFrame:
    """The documents that pass.

    They are scored for the bands and once more for the result, which so reads the model and
    the bands but no second copy of the texts.
    """
    carried, model = Carried(docs), model_of(docs)
    found = scored(carried.frame, model, carried.kept, carried.of("text"), carried.of("lang"))
    by = bands(scored(docs.select("text", "lang"), model, []))
    return carried.back(_banded(found, by, reach, floor).filter("kept"))
