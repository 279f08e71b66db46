"""Quality rules: counts, the language model and its bands, against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import hash_arrays, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score double, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """(doc_id, text, lang) rows with the columns of documents and some that clash."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 0.5, "k") for i, t, lang in rows], DOCS).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


def junk(rng, n):
    return " ".join("".join(rng.choice("qxzjkv#@") for _ in range(9)) for _ in range(n))


def odd_rows():
    return [(i, t, "en") for i, t in ((9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, "one"), (9007, "x y z " * 20_000), (9008, "  　é"))]


def expected_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def folded(text):
    """Characters beyond the plain ones by their class, as the module's docstring has them."""
    kind = lambda c: quality.CLASSES - 1 if c == 0 else c if c < quality.PLAIN else quality.PLAIN + ((c * 2654435761 % 2**32) >> 7) % (quality.CLASSES - 1 - quality.PLAIN)
    return "".join(chr(kind(ord(c))) for c in text)


class PlainModel:
    """Modified Kneser-Ney over the distinct texts of one language, with plain dictionaries."""

    def __init__(self, texts):
        tables = {5: Counter()}
        for text in map(folded, set(texts)):
            padded = "\0" * 4 + text
            tables[5].update(padded[i : i + 5] for i in range(len(text)))
        for size in (4, 3, 2, 1):
            tables[size] = Counter(gram[1:] for gram in tables[size + 1])
        self.p, self.gap = {}, {}
        for size in range(1, 6):
            table = tables[size]
            have = Counter(min(n, 5) for n in table.values())
            cut = {}
            for k in (1, 2, 3):
                y = have[1] / (have[1] + 2 * have[2]) if have[1] else 0
                value = k - (k + 1) * y * have[k + 1] / have[k] if have[k] and have[1] else 0
                cut[k] = value if 0 < value < k else k / 2
            total, off = defaultdict(float), defaultdict(float)
            for gram, n in table.items():
                total[gram[:-1]] += n
                off[gram[:-1]] += cut[min(n, 3)]
            for gram, n in table.items():
                c = gram[:-1]
                self.gap[c] = off[c] / total[c]
                lower = self.p[gram[1:]] if size > 1 else 1 / quality.CLASSES
                self.p[gram] = max(n - cut[min(n, 3)], 0) / total[c] + self.gap[c] * lower

    def score(self, text):
        padded = "\0" * 4 + folded(text)
        return -sum(math.log(self.p[padded[i : i + 5]]) for i in range(len(text))) / max(1, len(WORD.findall(text)))


def plain_verdicts(rows):
    """(counts, score, base failed, lower, upper, kept) of each (id, text, language) row, by hand."""
    texts = defaultdict(list)
    for _, t, lang in rows:
        texts[lang].append(t or "")
    models = {lang: PlainModel(t) for lang, t in texts.items()}
    known: dict = {}
    out = []
    for _, t, lang in rows:
        if (t, lang) not in known:
            counts = expected_counts(t)
            known[t, lang] = counts, round(models[lang].score(t or ""), 9), counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        out.append(known[t, lang])
    # bands around the median of distinct scores, deviations leaning on all languages'
    passed = {(row[2], round(score, 6), counts[0]) for row, (counts, score, failed) in zip(rows, out, strict=True) if not failed}
    centre, spread = {}, {}
    for lang in texts:
        own = [(s, n) for x, s, n in passed if x == lang]
        centre[lang] = np.median([round(s, 3) for s, _ in own]) if own else 0.0
        spread[lang] = [round(abs(s - centre[lang]) * math.sqrt(n), 2) for s, n in own]
    every = np.median(sum(spread.values(), []) or [0.0])
    for k, ((_, _, lang), (counts, score, failed)) in enumerate(zip(rows, out, strict=True)):
        n = len(spread[lang])
        deviation = 1.4826 * math.sqrt((n * (np.median(spread[lang]) if n else 0.0) ** 2 + quality.FEW * every**2) / (n + quality.FEW))
        wide = 3.5 * math.sqrt(deviation**2 / max(1, counts[0]) + 0.2**2)
        low, high = centre[lang] - wide, centre[lang] + wide
        out[k] = counts, score, failed, low, high, not failed and n > 0 and low <= score <= high
    return out


def rows_in_two_languages():
    rng = random.Random(29)
    rows = [(i, prose(rng, 80 + i % 90), "en") for i in range(160)]
    rows += [(200 + i, " ".join(f"é{int(rng.paretovariate(0.7)) % 300}ü" for _ in range(60 + i)), "de") for i in range(90)]
    rows += [(300 + i, prose(rng, 90), None) for i in range(40)] + [(350 + i, prose(rng, 40).upper(), "") for i in range(40)]
    rows += [(500, "w1 w2 w3 w4 w5 w6\nw1 w2 w3 w4 w5 w6\n\n \n" + prose(rng, 60), "en"), (501, "a b a b a b a b a b a b", "en"), (502, "é日本 # $ | <b>  x " * 3, "en")]
    rows += [(510 + i, " ".join("".join(chr(0x4E00 + int(rng.paretovariate(0.7)) % 500) for _ in range(3)) + rng.choice(["", "。", "😀", "\0"]) for _ in range(40)), "zh") for i in range(30)]
    text = junk(rng, 120)
    return rows + [(600 + i, text, "en") for i in range(50)] + [(701, junk(rng, 90), None)] + odd_rows()


def test_counts_perplexity_and_bands(spark):
    rows = rows_in_two_languages()
    found = {r.doc_id: r for r in quality.assess(docs(spark, rows)).collect()}
    for (i, _, _), (counts, score, failed, low, high, kept) in zip(rows, plain_verdicts(rows), strict=True):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, i
        assert r.base_failed == failed and not (failed and r.kept)
        assert math.log(r.perplexity) == pytest.approx(score, rel=1e-5, abs=1e-6) and r.kept == kept
        if not failed:
            assert (math.log(r.band_lower), math.log(r.band_upper)) == pytest.approx((low, high), abs=0.02)
    # junk goes, however often it is copied and in whatever language; all else stays
    assert {i for i, r in found.items() if not r.kept and not r.base_failed} == {*range(600, 650), 701}
    frame = docs(spark, rows)
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.kept)


def test_model_sums_to_one_and_backs_off(spark):
    counts = quality.count_grams(docs(spark, rows_in_two_languages()[:40])).cache()
    model = quality.stored(quality.train(counts))
    for gram in [r.gram for r in counts.select("gram").distinct().limit(5).collect()]:
        every = np.array([(gram >> 12 << 12 & (1 << 60) - 1) | c for c in range(quality.CLASSES)], dtype=np.uint64)
        assert np.exp(quality.log_probability(model, "=en", every)).sum() == pytest.approx(1, abs=1e-3)


def test_few_texts_of_a_language_and_junk_among_them(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 100), "en") for i in range(80)]
    rows += [(100 + i, prose(rng, 100), "sv") for i in range(40)] + [(150, junk(rng, 100), "sv"), (160, "the only text of its language, a clean one of more than ten words", "fi")]
    found = {r.doc_id: r for r in quality.assess(docs(spark, rows)).collect()}
    assert not found[150].kept and all(r.kept != r.base_failed for i, r in found.items() if i != 150)


def test_hash_arrays(spark, monkeypatch):
    monkeypatch.setattr(hash_arrays, "FILE_ENTRIES", 200)  # several files
    rng = random.Random(1)
    entries = {(rng.randint(0, 1), rng.getrandbits(63)): float(i) for i in range(3000)}
    frame = spark.createDataFrame([(*k, v) for k, v in entries.items()] + [(0, 5, 1.5), (0, 5, 1.5)], "kind int, hash long, value float").repartition(7)
    arrays = hash_arrays.write_arrays(frame, "t")
    assert len(arrays.files) > 8
    for kind in (0, 1):
        asked = np.array([h for k, h in entries if k == kind] + [6, 2**63 - 1], dtype=np.int64)
        got = arrays.find_any(kind, asked)
        assert got[:-2].tolist() == [v for (k, _), v in entries.items() if k == kind] and np.isnan(got[-2:]).all()
    assert len(arrays.find_any(0, np.zeros(0, np.int64))) == 0
    assert np.isnan(hash_arrays.write_arrays(frame.limit(0), "t").find_any(0, np.array([1], dtype=np.int64))).all()


def test_empty(spark):
    only = quality.assess(docs(spark, [(1, "", "en"), (2, None, None)])).collect()
    assert [(r.n_words, r.kept) for r in only] == [(0, False)] * 2
    assert quality.assess(docs(spark, [])).collect() == []
    assert quality.keep_good(docs(spark, [])).collect() == []
