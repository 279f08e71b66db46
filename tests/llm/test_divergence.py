"""The divergence audit against plain counting and its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n long, term string, p double"


def corpus(spark, rows):
    """(text, lang, source) rows with columns whose names clash with working ones."""
    return spark.createDataFrame([(i, *r, 7, "t", 0.5) for i, r in enumerate(rows)], COLUMNS).repartition(3)


def expected(rows, least_docs, most_terms):
    """The whole result in plain Python."""
    docs, uses, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        docs[lang or ""].update(set(terms))
        uses[lang or "", source or ""].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        names = sorted((s for k, s in groups if k == lang), key=str.encode)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((uses[lang, s] for s in names), Counter()))
        each = {s: shares(uses[lang, s]) for s in names}
        for s in names:
            found = [(-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode(), o) for o in names if o != s]
            above = [(whole[t] - each[s][t], t.encode(), t) for t in kept if uses[lang, s][t] and each[s][t] > whole[t]]
            for part, items in (("pair", found), ("term", sorted(above)[:most_terms])):
                out |= {(lang, s, part, name, -value, rank) for rank, (value, _, name) in enumerate(sorted(items), 1)}
    return out


def got(frame):
    assert frame.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, n=160):
    rng = random.Random(seed)
    lengths = [*range(1, 20), 31, 32, 33, 200]
    words = ["".join(rng.choice("abcdeXYZéß日😀") for _ in range(rng.choice(lengths))) for _ in range(60)] + ["a", "aa", "aaaaaaaa", "aaaaaaaaa", "a" * 16, "a" * 17, "a" * 40, "b" * 40]
    rows = []
    for _ in range(n):
        text = rng.choice(" .1-\n\x00_") .join(rng.choices(words, k=rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["hot", "hot", "web", "é", None, ""])))
    return [*rows, rows[0], rows[0], (None, "en", "silent"), ("", "xx", "one"), ("12 34", "xx", "two"), ("x y " * 50_000, "de", "long")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counting_and_sql(spark, seed):
    rows = random_rows(seed)
    found = got(divergence.audit(corpus(spark, rows), least_docs=5, most_terms=7))
    assert found == expected(rows, 5, 7)
    documents = pa.table({"text": [r[0] for r in rows], "lang": [r[1] for r in rows], "source": [r[2] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    assert found == {tuple(r) for r in con.execute("SELECT lang, source, part, item, value, rank FROM (" + divergence.oracle(5, 7) + ")").fetchall()}


def test_matrices_in_tiles(spark, monkeypatch):
    """Languages of more sources than a matrix holds."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("abcdefgh", k=9)), "en", f"s{i % 40}") for i in range(200)]
    frame = corpus(spark, rows)
    whole = got(divergence.audit(frame, 3, 4))
    assert whole == expected(rows, 3, 4)
    dense = spark.createDataFrame([("en", [rng.randrange(100) for _ in range(9)]) for _ in range(30)], "lang string, p array<long>").repartition(2).cache()
    tables = np.array([r["p"] for r in dense.collect()])
    plain = {("en", i, j): int(np.abs(tables[:, i] - tables[:, j]).sum()) for i in range(9) for j in range(i + 1, 9)}
    for most in (10, 20, 1 << 20):
        monkeypatch.setattr(divergence, "MATRIX", most)
        assert {(r["lang"], r["i"], r["j"]): r["value"] for r in divergence.pair_sums(dense).collect()} == plain


def test_counts_are_exact_where_products_overflow(spark):
    """Counts of 10**13 occurrences."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    cases = [(rng.randrange(10**13), rng.randrange(10**13, 9 * 10**14), rng.randrange(1, 10**9)) for _ in range(200)] + [(0, 0, 1), (10**15, 10**15, 1)]
    frame = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r["p"] == 1 + 1_000_000_000 * (r["c"] + 5) // (r["n"] + 5 * r["v"]) for r in frame.collect())


def test_slices_of_counted_text(spark, monkeypatch):
    """Documents counted in slices of any size; each term of a document counts once for it."""
    rows = random_rows(9, 60)
    monkeypatch.setattr(divergence, "COUNTED_BYTES", 50)
    column = pa.array([r[0] or "" for r in rows])
    plain = Counter()
    for at, part in divergence.textkit.slices(column, 50):
        for terms, _, n, docs in divergence.counted(part, np.zeros(len(part), np.int64)):
            for term, count, held in zip(terms.to_pylist(), n.tolist(), docs.tolist(), strict=True):
                plain["n", term] += count
                plain["docs", term] += held
    wanted = Counter()
    for text in column.to_pylist():
        found = TERM.findall(text.translate(LOWER))
        wanted.update(("n", t) for t in found)
        wanted.update(("docs", t) for t in set(found))
    assert plain == wanted


def test_empty_and_termless(spark):
    assert divergence.audit(corpus(spark, [("a", "en", "s")]).limit(0)).count() == 0
    rows = [("1 2", "en", "a"), (None, "en", "b"), ("rare", "en", None)]
    assert got(divergence.audit(corpus(spark, rows))) == expected(rows, 30, 50) == {("en", s, "pair", o, 0, k) for s, others in (("a", ["", "b"]), ("b", ["", "a"]), ("", ["a", "b"])) for k, o in enumerate(others, 1)}
