"""The Arrow operators and the pipeline against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import imatch, ngram_jaccard, passage_chains, piece_codec, textkit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score double, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def docs(spark, rows):
    """(doc_id, text) rows with the columns of documents and some that clash."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0.5, "k") for i, t in rows], DOCS).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


def odd_rows():
    return [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, "one"), (9006, "Two Words"), (9007, "x y z " * 20_000), (9008, "  　é")]


# --- words ------------------------------------------------------------------------------


def test_words_match_the_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n\t\x0b\x1c 日") for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", "a", " "]
    words = textkit.Words(pa.array(texts, pa.large_string()))
    names = [w for t in texts for w in WORD.findall(t)]
    assert words.count.tolist() == [len(WORD.findall(t)) for t in texts]
    assert len(set(words.hash.tolist())) == len(set(names)) == len(set(zip(names, words.hash.tolist(), strict=True)))


def test_slices_cover_all_rows():
    column = pa.array(["x" * n for n in (0, 10, 5000, 1, 0, 300)] * 50, pa.large_string())
    parts = list(textkit.slices(column, 600))
    assert [at for at, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist()
    assert pa.concat_arrays([p for _, p in parts]) == column


# --- n-gram Jaccard join ------------------------------------------------------------------


def expected_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    rng = random.Random(7)
    rows = []
    for base in range(6):  # chains of edits, groups around a text, texts without it
        text = prose(rng, rng.choice([8, 40, 150, 400])).split()
        for _ in range(22):
            edited = list(text)
            for _ in range(rng.randint(0, 1 + len(edited) // 30)):
                edited[rng.randrange(len(edited))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(edited)))
            if rng.random() < 0.4:
                text = edited
    line = prose(rng, 12)
    rows += [(len(rows) + i, line + " " + prose(rng, 6)) for i in range(60)]
    rows += [(8000 + i, rows[3][1].upper()) for i in range(30)] + odd_rows()
    expected, sizes = expected_components(rows, k, percent)
    found = ngram_jaccard.similar(docs(spark, rows), k=k, percent=percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == {i: (c, sizes[i]) for i, c in expected.items()}
    frame = docs(spark, rows)
    kept = ngram_jaccard.one_each(frame, k=k, percent=percent)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for i, c in expected.items()})


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_lengthened_and_cut(spark, k, percent):
    rng = random.Random(23)
    rows = []
    for base in range(64):  # a text and one version of it with words added or cut off; the first 40 times
        text = [f"b{base}x{rng.randrange(10**6)}" for _ in range(110)]
        rows += [(len(rows) + i, " ".join(text)) for i in range(1 if base else 40)]
        n = 110 * (7 + base % 16) // 100
        rows.append((len(rows), " ".join(text[:-n] if base % 32 < 16 else text + [f"a{rng.randrange(10**6)}" for _ in range(n)])))
    expected, sizes = expected_components(rows, k, percent)
    found = ngram_jaccard.similar(docs(spark, rows), k=k, percent=percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == {i: (c, sizes[i]) for i, c in expected.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_pairs_of_unequal_size(spark, k, percent):
    rng = random.Random(53)
    common = prose(rng, 40).split()  # frequent shingles as well
    rows = []
    for base in range(120):
        n = int(2 ** rng.uniform(0, 11))
        text = [f"v{base}x{rng.randrange(10**6)}" for _ in range(n)]
        if base % 3 == 0:
            text = text[: n // 2] + common[: n // 8] + text[n // 2 :]
        for _ in range(2):
            other, share = list(text), (100 - percent) / 100 * rng.uniform(0.2, 1.3)
            for _ in range(max(1, int(share * n / rng.choice([1, 1, 2])))):
                kind = (base // 3) % 3 if rng.random() < 0.9 else rng.randrange(3)
                at = rng.choice([0, len(other), rng.randint(0, len(other))]) if rng.random() < 0.3 else len(other)
                if kind == 0:
                    other.insert(at, f"n{rng.randrange(10**6)}")
                elif kind == 1 and other:
                    del other[min(at, len(other) - 1)]
                elif other:
                    other[min(at, len(other) - 1)] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
        rows.append((len(rows), " ".join(text)))
    # exactly at the threshold, and one shingle below it
    m = 340
    text = [f"t{i}" for i in range(m + k - 1)]
    for tag, extra in (("at", m * (100 - percent) // percent), ("below", m * (100 - percent) // percent + 1)):
        rows.append((len(rows), " ".join(f"{tag}{w}" for w in text)))
        rows.append((len(rows), " ".join([*(f"{tag}{w}" for w in text), *(f"{tag}x{i}" for i in range(extra))])))
    expected, sizes = expected_components(rows, k, percent)
    assert [expected[i] for i in range(len(rows) - 4, len(rows))] == [len(rows) - 4, len(rows) - 4, len(rows) - 2, len(rows) - 1]
    found = ngram_jaccard.similar(docs(spark, rows), k=k, percent=percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == {i: (c, sizes[i]) for i, c in expected.items()}
    assert 60 < sum(i != c for i, c in expected.items()) < 220


def test_jaccard_many_frequent_tokens_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "MOST_FREQUENT", 8)
    rng = random.Random(59)
    line = prose(rng, 30)
    rows = [(i, line + " " + prose(rng, 30, 10**6)) for i in range(80)]
    rows += [(100 + i, t + " more") for i, t in rows[:20]]
    expected, _ = expected_components(rows, 4, 85)
    extra = [(500, "a b c d e f"), (500, "g h i j k l"), (501, "G h i j k l")]  # one id, two texts
    found = [(r.doc_id, r.component_id) for r in ngram_jaccard.similar(docs(spark, rows + extra), k=4, percent=85).collect()]
    assert sorted(found) == sorted([*expected.items(), (500, 500), (500, 500), (501, 500)])


def expected_links(rows, k, percent):
    """How many other rows each row links to, by all pairs."""
    words = [WORD.findall((t or "").translate(LOWER)) for _, t, *_ in rows]
    sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()} for w in words]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return {r[0]: sum(linked(a, b) for j, b in enumerate(sets) if i != j) for i, (r, a) in enumerate(zip(rows, sets, strict=True))}


@pytest.mark.parametrize(("block", "percent"), [(128, 85), (8, 85), (8, 70)])
def test_jaccard_counts_every_link(spark, monkeypatch, block, percent):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "COLUMNS", 64)
    rng = random.Random(61)
    rows = []
    for base in range(5):  # groups of near copies, some of which link to each other but not to their centre
        text = prose(rng, rng.choice([60, 150, 300])).split()
        for _ in range(36):
            edited = list(text)
            for _ in range(rng.randint(0, len(edited) // rng.choice([15, 30, 200]))):
                edited[rng.randrange(len(edited))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(edited)))
            if rng.random() < 0.2:
                text = edited
    rows += [(1000 + i, rows[40 + i % 3][1].upper()) for i in range(9)] + [(2000, "one two"), (2001, "one  two"), (2002, ""), (2003, None), (2004, "alone")]
    expected, sizes = expected_components(rows, 4, percent)
    links = expected_links(rows, 4, percent)
    found = ngram_jaccard.similar(docs(spark, rows), k=4, percent=percent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.n_links) for r in found} == {i: (c, sizes[i], links[i]) for i, c in expected.items()}
    assert sum(links.values()) > 4 * len(rows)


def test_jaccard_low_threshold(spark):
    texts = [" ".join(f"t{i}x{j}" for j in range(40)) + " same words here now" for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = ngram_jaccard.similar(docs(spark, rows), k=4, percent=1).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in found} == {i: (0, 5) for i in range(6)}


def test_jaccard_empty_and_null_ids(spark):
    assert ngram_jaccard.similar(docs(spark, []), k=4, percent=85).collect() == []
    found = ngram_jaccard.similar(docs(spark, [(None, "a b c d e"), (4, "a b c d e"), (None, "q r s t u")]), k=4, percent=85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 4), (4, 4)]


# --- fingerprints -------------------------------------------------------------------------


M64 = (1 << 64) - 1


def mix(h):
    """textkit.mix, for one number."""
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & M64
    h ^= h >> 29
    h = h * 0xD6E8FEB86659FD93 & M64
    return h ^ h >> 32


def plain_fingerprints(texts):
    """Fingerprint strings by sets and dictionaries; only the hash of a word is the module's."""
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    frequency = Counter(w for own in words for w in set(own))
    n, out = len(texts), []
    inside = {w for w, c in frequency.items() if 0.2 <= np.log(n / c) / np.log(n) <= 0.95}
    number = {w: mix(int(textkit.Words(pa.array([w], pa.large_string())).hash[0]) >> 1) for w in frequency}
    for own in words:
        least = sorted(set(own), key=lambda w: int(textkit.Words(pa.array([w], pa.large_string())).hash[0]) >> 1)[:4]
        kept = {number[w] for w in set(own) & inside | set(least)}
        parts = [f"{len(kept):08x}"]
        for k in range(1 + imatch.DENSE):
            h = [mix((t + 0xD1B54A32D192ED03 * (k + 1)) & M64) for t in kept]
            h = [x for x in h if not k or x % 4]
            parts.append(f"{mix(sum(map(mix, h)) & M64) | 1:016x}" if h else "-" * 16)
        for level, groups in enumerate(imatch.GROUPS):
            h = [mix((t + 0x9E3779B97F4A7C15 * (level + 1)) & M64) for t in kept]
            for g in range(imatch.SUBSETS):
                here = [mix(x) for x in h if x % groups == g]
                parts.append(f"{mix(sum(here) & M64) >> 48 | 1:04x}" if here else "-" * 4)
        out.append(parts)
    return out


def plain_likeness(a, b):
    if a[1] == b[1]:
        return 1.0
    most, at = max(int(a[0], 16), int(b[0], 16)), 2 + imatch.DENSE
    size = min(range(len(imatch.GROUPS)), key=lambda k: abs(np.log2(max(most, 1) / 2 / imatch.GROUPS[k])))
    pairs = [p for p in zip(a[at + 32 * size : at + 32 * size + 32], b[at + 32 * size : at + 32 * size + 32], strict=True) if p != ("-" * 4,) * 2]
    return (sum(x == y for x, y in pairs) / len(pairs)) ** (1 / max(1, most / imatch.GROUPS[size])) if pairs else 0.0


def parts_of(fingerprint):
    return [fingerprint[:8], *(fingerprint[8 + 16 * j : 24 + 16 * j] for j in range(1 + imatch.DENSE)), *(fingerprint[j : j + 4] for j in range(8 + 16 * (1 + imatch.DENSE), len(fingerprint), 4))]


def test_imatch(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(20, 400), 3000)) for i in range(0, 900, 3)] + odd_rows() + [(10_000, prose(rng, 100)), (10_001, "one")]
    rows.append((10_002, rows[-2][1] + " onemoreword"))
    found = {r.doc_id: r for r in imatch.with_edits(docs(spark, rows)).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows)]
    after = [t for _, t in ordered[1:] + ordered[:1]]
    edits = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), n in zip(ordered, after, strict=True)]
    prints = plain_fingerprints([t for _, t in ordered])
    for k, ((i, text), changed) in enumerate(zip(ordered, edits, strict=True)):
        r = found[i]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(text)
        assert r.fingerprint == "".join(prints[k]), i
        assert r.near_next == pytest.approx(plain_likeness(prints[k], prints[(k + 1) % len(prints)]), abs=1e-8)
        own = parts_of(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(plain_likeness(prints[k], own), abs=1e-8)
        assert r.match_edited == any(x == y != "-" * 16 for x, y in zip(prints[k][1:9], own[1:9], strict=True))
    assert found[9004].fingerprint == found[9005].fingerprint == found[10_001].fingerprint
    own = imatch.fingerprints(docs(spark, rows)).collect()
    assert all(found[r.doc_id].fingerprint == r.fingerprint for r in own)
    near = [found[i] for i, _ in rows[:300]]
    assert np.mean([r.near_edited for r in near]) > 0.35 > 0.15 > np.mean([r.near_next for r in near])


def test_imatch_likeness_estimates_shared_terms(spark):
    """Texts of any size that share a known part of their terms."""
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, shared = [], {}
    for i in range(0, 400, 2):
        n, part = rng.choice([12, 40, 150, 600, 3000]), rng.choice([0.0, 0.5, 0.75, 0.95])
        own = fresh(n)
        keep = round(n * part)
        rows += [(i, " ".join(own)), (i + 1, " ".join(own[:keep] + fresh(n - keep)))]
        shared[i] = (n, part)
    rows += [(10_000 + i, t) for i, t in rows]  # terms of one document alone are in no lexicon
    found = {r.doc_id: r.near_next for r in imatch.with_edits(docs(spark, rows)).collect()}
    for part in (0.0, 0.5, 0.75, 0.95):
        for large in (False, True):
            near = [found[i] for i, (n, p) in shared.items() if p == part and (n >= 150) == large]
            assert abs(np.mean(near) - part / (2 - part)) < 0.12 + 0.05 * (not large), (part, large)  # of the terms of both


def test_imatch_one_term_apart_shares_a_signature(spark):
    rng = random.Random(37)
    rows = [(i, prose(rng, 200, 3000)) for i in range(200)]
    rows = [(2 * i, t) for i, t in rows] + [(2 * i + 1, t.replace(t.split()[100], "w1499", 1)) for i, t in rows]
    found = {r.doc_id: r for r in imatch.with_edits(docs(spark, rows)).collect()}
    assert np.mean([found[2 * i].match_next for i in range(200)]) > 0.5 > 0.02 > np.mean([found[2 * i + 1].match_next for i in range(200)])


def test_imatch_null_and_equal_ids(spark):
    assert imatch.with_edits(docs(spark, [])).collect() == []
    single = imatch.with_edits(docs(spark, [(5, "a b c d e f g h")])).collect()
    assert single[0].near_next == 1.0
    rows = [(None, "q r s t u v"), (3, "a b c d e f"), (3, "g h i j k l m"), (3, "a b c d e f"), (None, None), (1, "n o p")]
    found = imatch.with_edits(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in found) == sorted((i or 0, len(t or "")) for i, t in rows)
    again = imatch.with_edits(docs(spark, rows[::-1])).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


# --- passages -----------------------------------------------------------------------------


def test_repeated_passages(spark):
    rng = random.Random(17)
    fresh = iter(range(10**6))
    own = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    passage = own(60)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[41] = "changed", "words"
    short = passage[:30]
    rows = {1: own(80) + passage + own(50), 2: passage + own(90), 3: own(33) + fuzzy + own(20), 4: own(100) + short + own(20), 5: own(200), 6: own(40) + passage + own(10) + passage}
    rows[7] = list(rows[5])
    extra = odd_rows() + [(None, " ".join(passage)), (1, " ".join(rows[1]))]
    frame = docs(spark, [(i, " ".join(w)) for i, w in rows.items()] + extra)
    found = defaultdict(list)
    for r in passage_chains.repeated_passages(frame).collect():
        found[r.doc_id] = sorted([*found[r.doc_id], (r.first_id, r.start_word, r.end_word, r.first_start, r.identity)])
    assert found[2] == [(1, 0, 60, 80, 1.0)]
    (first, start, end, _, same), *more = found[3]
    assert not more and (first, start, end) == (1, 33, 93) and same == pytest.approx(58 / 60)
    assert found[7] == [(5, 0, 200, 0, 1.0)]
    assert found[6] == [(1, 40, 100, 80, 1.0), (1, 110, 170, 80, 1.0)]
    assert not {1, 4, 5, 9001, 9002, 9003, 9004} & set(found)
    assert passage_chains.repeated_passages(docs(spark, [])).collect() == []


def test_passage_whose_parts_have_other_first_places(spark):
    rng = random.Random(67)
    own = lambda tag, n: [f"{tag}{rng.randrange(10**9)}" for _ in range(n)]
    passage, other = own("p", 60), own("q", 70)
    rows = {10: own("a", 30) + passage[:35], 20: passage[25:] + own("b", 30), 30: own("c", 20) + passage, 40: passage + own("d", 20), 50: own("e", 9) + passage[:40]}
    rows |= {60 + i: own("f", 40) + other[14 * i : 14 * i + 14] for i in range(5)}  # lines with first places of their own
    rows |= {70: other + own("g", 9), 80: own("h", 5) + other}
    found = {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in passage_chains.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in rows.items()])).collect()}
    assert found == {(40, 0, 60, 30), (80, 5, 75, 70)}


def uncovered_windows(rows, found, n=50):
    """(document, place) of each window of ``n`` words that an earlier document has and no reported span holds."""
    words = {i: (t or "").translate(LOWER).split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for at in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][at : at + n]), i)
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append((r.start_word, r.end_word))
    repeated = [(i, at) for i in words for at in range(len(words[i]) - n + 1) if first[tuple(words[i][at : at + n])] < i]
    return repeated, [(i, at) for i, at in repeated if not any(a <= at and at + n <= b for a, b in spans[i])]


def test_all_exact_passages_are_found(spark):
    """The whole result against each window of 50 words, with parts of passages in documents before and between."""
    rng = random.Random(71)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows, at = [], 0
    for _ in range(25):
        passage = fresh(rng.choice([50, 51, 60, 80, 150]))
        n = len(passage)
        for first, end in ((0, 35), (n - 35, n), (0, n), (0, 35), (n - 35, n), (0, n), (n // 2 - 17, n // 2 + 17), (0, n)):
            at += rng.randint(1, 3)
            rows.append((at, " ".join(fresh(rng.randint(0, 40)) + passage[first:end] + fresh(rng.randint(0, 40)))))
    rng.shuffle(rows)
    found = passage_chains.repeated_passages(docs(spark, rows)).collect()
    repeated, missed = uncovered_windows(rows, found)
    assert len(repeated) > 300 and missed == []
    words = {i: t.split() for i, t in rows}
    for r in found:  # and nothing else is
        own, other = words[r.doc_id][r.start_word : r.end_word], words[r.first_id][r.first_start : r.first_end]
        assert r.first_id < r.doc_id and len(own) >= 50 and plain_common(own, other) >= 0.8 * max(len(own), len(other))


def test_passage_in_very_many_documents(spark, monkeypatch):
    """A third of all documents share one passage, and its seeds are joined in salts."""
    rng = random.Random(72)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    common, join = fresh(60), passage_chains.salted_join
    monkeypatch.setattr(passage_chains, "salted_join", lambda *a, **b: join(*a, rows=20, **b))
    rows = [(i, " ".join(fresh(15) + (common if i % 3 == 0 else fresh(20)) + fresh(15))) for i in range(450)]
    found = passage_chains.repeated_passages(docs(spark, rows)).collect()
    assert uncovered_windows(rows, found)[1] == []
    assert sorted({r.doc_id for r in found}) == list(range(3, 450, 3)) and {r.first_id for r in found} == {0}


@pytest.mark.parametrize("flip", [False, True])
def test_passages_of_equal_ids(spark, flip):
    rng = random.Random(43)
    own = lambda tag, n: [f"{tag}{rng.randrange(10**9)}" for _ in range(n)]
    passage = own("p", 60)
    rows = [(1, " ".join(own("a", 200))), (1, " ".join([*own("b", 70), *passage])), (2, " ".join([*own("c", 10), *passage])), (2, " ".join([*own("c", 10), *passage, "tail"]))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 0.5, "k") for i, t in (rows[::-1] if flip else rows)], DOCS)
    found = passage_chains.repeated_passages(frame).collect()
    assert sorted((r.doc_id, r.first_id, r.start_word, r.end_word, r.first_start, r.first_end, r.n_equal, r.identity) for r in found) == [(2, 1, 10, 70, 70, 130, 60, 1.0)] * 2
    assert len({r.text_hash for r in found}) == 2 and len({r.first_hash for r in found}) == 1


def test_places_carry_hashes_of_equal_ids_only(spark, monkeypatch):
    """Places of an id with one text go without its hash, and chains get it back; texts are read in parts of any size."""
    from pyspark.sql import functions as F

    from tidewell.llm.bitfield import field_of

    rng = random.Random(71)
    passage = prose(rng, 70, 10**6)
    frame = docs(spark, [(1, passage), (2, prose(rng, 30, 10**6) + " " + passage), (2, passage + " x"), (3, passage), (4, prose(rng, 60, 10**6))])
    hashed = frame.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    true = {(r.doc_id, r.text_hash) for r in hashed.collect()}
    seeds = passage_chains._seed_rows(hashed, 8, 12, 39, several=field_of(spark.createDataFrame([(2,)], "doc_id long")))
    plain = passage_chains._seed_rows(hashed, 8, 12, 39)
    assert {(r.doc_id, r.text_hash) for r in seeds.select("doc_id", "text_hash").distinct().collect()} == {(i, h if i == 2 else passage_chains.ONLY) for i, h in true}
    assert sorted(map(str, seeds.drop("text_hash").collect())) == sorted(map(str, plain.drop("text_hash").collect()))
    whole = passage_chains.repeated_passages(frame).collect()
    assert {(r.doc_id, r.text_hash) for r in whole} == {(i, h) for i, h in true if i in (2, 3)}
    assert {(r.first_id, r.first_hash) for r in whole} == {(i, h) for i, h in true if i == 1}
    monkeypatch.setattr(passage_chains, "PACKED_BYTES", 100)
    assert sorted(map(str, passage_chains.repeated_passages(frame).collect())) == sorted(map(str, whole))


def test_minimizers_by_definition():
    rng = random.Random(73)
    for _ in range(300):
        k, window = rng.choice([(8, 12), (3, 5), (2, 1), (1, 7)])
        n = rng.choice([0, 1, k, k + 1, k + window, 60])
        words = textkit.Words(pa.array([" ".join(rng.choice("abcdefgh") for _ in range(n))], pa.large_string()), lower=True)
        rank = (passage_chains.minimizers(words, k, 1)[1][: max(0, n - k + 1)] >> np.uint64(1)).tolist()  # each place is kept
        least = [i for i, r in enumerate(rank) if any(r == min(rank[j : j + window]) for j in range(max(0, i - window + 1), i + 1))]
        assert passage_chains.minimizers(words, k, window)[0][: len(least)].tolist() == least


def plain_equal(a, b):
    """Most equal words of an alignment of least edits, over all alignments."""
    table = {(0, 0): (0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                ways = [(c[0] + 1, c[1]) for c in (table.get((i - 1, j)), table.get((i, j - 1))) if c]
                if (c := table.get((i - 1, j - 1))) is not None:
                    ways.append((c[0] + (a[i - 1] != b[j - 1]), c[1] - (a[i - 1] == b[j - 1])))
                table[i, j] = min(ways)
    return -table[len(a), len(b)][1]


def test_align_against_all_alignments():
    rng = random.Random(47)
    k, seen = 4, 0
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randint(12, 40))]
        b = [rng.randrange(30) if rng.random() < 0.1 else w for w in a for _ in range(rng.choice([1, 1, 1, 1, 1, 1, 1, 0, 2]))] or [1]
        anchors = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]]
        chain = []
        for i, j in anchors:
            if not chain or i > chain[-1][0] and j > chain[-1][1]:
                chain.append((i, j))
        chain += [(len(a) + 5, len(b) + 5)]  # what isn't there counts for nothing
        if rng.random() < 0.5:
            chain.insert(0, (0, 0))
        xs, ys = (np.array(z) for z in zip(*chain, strict=True))
        start, end, first, first_end, equal = passage_chains.align(np.array(a), np.array(b), xs, ys, k)
        assert 0 <= start <= end <= len(a) and 0 <= first <= first_end <= len(b)
        most = plain_common(a[start:end], b[first:first_end])
        assert equal <= most  # no word is counted that an alignment doesn't have
        if len(chain) > 3:
            seen += 1
            assert equal >= 0.8 * plain_equal(a[start:end], b[first:first_end])
    assert seen > 100


def plain_common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for u in a:
        before, row[0] = row[0], 0
        for j, v in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def test_chains_against_all_chains():
    rng = random.Random(19)
    for _ in range(60):
        n = rng.randint(1, 8)
        x, y = np.array([rng.randint(0, 60) for _ in range(n)]), np.array([rng.randint(0, 60) for _ in range(n)])
        k, cost = 4, 0.25

        def value(chain):
            total = float(k)
            for i, j in zip(chain, chain[1:], strict=False):
                dx, dy = x[j] - x[i], y[j] - y[i]
                total += min(k, dx, dy) - cost * (max(0, dx - k) + max(0, dy - k))
            return total

        best = 0.0
        for mask in range(1, 1 << n):
            chain = sorted((i for i in range(n) if mask >> i & 1), key=lambda i: (x[i], y[i]))
            if all(x[i] < x[j] and y[i] < y[j] for i, j in zip(chain, chain[1:], strict=False)):
                best = max(best, value(chain))
        chains = passage_chains.best_chains(x, y, k, cost, 1000, 1)
        assert sorted(i for c in chains for i in c) == list(range(n))
        # gaps are charged from places, so chains whose anchors overlap may come out a little lower
        assert best - 2 * cost * k * n <= max(map(value, chains)) <= best + 1e-9


# --- pieces -------------------------------------------------------------------------------


def best_cost(codec, text):
    best = [0.0] + [1e300] * len(text)
    for i in range(len(text)):
        if text[i] not in codec.cost:
            best[i + 1] = min(best[i + 1], best[i] + codec.byte_cost * len(text[i].encode()))
        for j in range(i + 1, min(len(text), i + codec.longest) + 1):
            if text[i:j] in codec.cost:
                best[j] = min(best[j], best[i] + codec.cost[text[i:j]][0])
    return best[-1]


def test_codec_is_optimal_and_exact():
    codec = piece_codec.PieceCodec(MODEL)
    prices = {i: c for c, i in codec.cost.values()} | dict.fromkeys(codec.byte_ids, codec.byte_cost)
    rng = random.Random(23)
    parts = ["the", "ing", " ", "  ", "\n", "é", "𝔘", "日本", "x", "tion", " " * 20, "a" * 80, "ab" * 50, "▁", "\x00"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        if text and "▁" not in text:
            marked = ("▁" + text.replace(" ", "▁"))
            for got in (ids, [i for part in codec.stream(marked) for i in part]):
                assert sum(prices[i] for i in got) == pytest.approx(best_cost(codec, marked))


def test_stream_commits_within_the_window():
    codec = piece_codec.PieceCodec(MODEL)
    for text in ("▁" + "abcde" * 400, "ab" * 1500, "intenstionating" * 200):
        parts = list(codec.stream(text))
        assert len(parts) > 15 and max(map(len, parts)) <= 8 * codec.longest
        prices = {i: c for c, i in codec.cost.values()}
        assert sum(prices[i] for p in parts for i in p) == pytest.approx(best_cost(codec, text))


def test_paths_that_never_meet():
    codec = piece_codec.PieceCodec(MODEL)
    text = "▁" * 3001
    prices = {i: c for c, i in codec.cost.values()}
    assert sum(prices[i] for p in codec.stream(text) for i in p) == pytest.approx(best_cost(codec, text))


def test_encoding_goes_through_the_stream(monkeypatch):
    codec = piece_codec.PieceCodec(MODEL)
    commits, stream = [], piece_codec.PieceCodec.stream

    def counted(self, text):
        for part in stream(self, text):
            commits.append((text, part))
            yield part

    monkeypatch.setattr(piece_codec.PieceCodec, "stream", counted)
    text = "Plain words, some unusual: intercontinentalisations 12345 " + "abcde" * 400
    ids = codec.encode(text)
    assert [i for _, part in commits for i in part] == ids  # no word repeats, so every id was committed by the search
    assert len(commits) > 25 and len({t for t, _ in commits}) == len(text.split())
    before = len(commits)
    assert codec.encode("words, words, some") and len(commits) == before  # all of them kept


def test_encode_documents(spark):
    rows = odd_rows() + [(1, "Hello world.\n  Twice  spaced "), (1, "Hello world.\n  Twice  spaced ")]
    encoded = piece_codec.encode(docs(spark, rows), MODEL)
    back = {r.doc_id: r for r in piece_codec.decode(encoded, MODEL).collect()}
    for i, text in rows:
        assert back[i].decoded == text and back[i].round_trip is (None if text is None else True)
    assert back[9002].ids == [] and back[9001].ids is None and back[9001].n_ids == 0
    assert piece_codec.encode(docs(spark, []), MODEL).collect() == []
    again = piece_codec.encode(encoded, MODEL)  # whose columns clash
    assert again.columns == encoded.columns and sorted(map(str, again.collect())) == sorted(map(str, encoded.collect()))


def test_only_seeds_that_repeat_are_joined(spark):
    from pyspark.sql import functions as F

    from tidewell.llm.bitfield import field_of

    rng = random.Random(67)
    rows = [(i, prose(rng, 200, 10**6)) for i in range(24)]
    frame = docs(spark, [*rows, (24, rows[3][1])]).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    seeds = passage_chains._seed_rows(frame, 8, 12, 39)
    shared = seeds.groupBy("seed").count().filter("count > 1").select("seed")
    kept = passage_chains._seed_rows(frame, 8, 12, 39, field_of(shared))
    repeated = lambda df: sorted(map(str, df.join(shared, "seed", "left_semi").collect()))
    assert repeated(kept) == repeated(seeds) and 4 * kept.count() < seeds.count()
    marked = seeds.withColumn("open", F.col("doc_id") == 3)
    assert {r.doc_id for r in passage_chains._maybe_open(marked, "seed").collect()} == {3, 24}
