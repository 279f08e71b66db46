"""Mixing, licence and secret scans against brute force, with odd rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import license_scan, mixing, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copies int"


def docs(spark, rows):
    """(doc_id, text, source) rows with the columns of documents and two that clash."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7) for i, t, s in rows], DOCS)


def expected_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_targets_and_bounds(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 400), rng.choice(["a", "b", "c", "d", None, "a", "a"])) for i in range(600)]
    rows += [(None, "one two", "a"), (5, None, "b"), (6, "", "e"), (7, "same words", "c"), (7, "same words", "c")]
    found = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    targets = expected_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.01 * targets[s] + 4
    again = mixing.mix_sources(docs(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_many_shards_and_copies(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    frame = docs(spark, rows)
    found = mixing.mix_sources(frame, shard_tokens=2000).toPandas()
    by = found.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.02 * by.target + 20).all()
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == found_copies(spark, frame)


def test_mix_many_rows_without_ids_and_long_texts(spark):
    """Null ids of equal sizes, and a text that is larger than many shards; further columns of any name."""
    rows = [(None, "same three words", "a")] * 400 + [(None, "other words", "b")] * 50 + [(1, "w " * 60_000, "a"), (2, "w " * 30_000, None)]
    found = mixing.mix_sources(docs(spark, rows), shard_tokens=2000).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in found)
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 100 for s in target)
    assert sorted(map(str, mixing.mix_sources(docs(spark, rows[::-1]), shard_tokens=2000).collect())) == sorted(map(str, found))


def found_copies(spark, frame):
    return mixing.mix_sources(frame).agg(F.sum("copies")).first()[0]


def test_mix_empty(spark):
    assert mixing.mix_sources(docs(spark, [])).collect() == []
    assert mixing.mixed(docs(spark, [])).collect() == []
    only = mixing.mix_sources(docs(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert {(r.doc_id, r.taken, r.target) for r in only} == {(1, 0, 0.0), (2, 0, 0.0)}


def plain_licences(text):
    """Largest Dice coefficient of each template over all runs of lines, by sets."""
    lines = [w for line in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split("\n") if (w := re.findall("[a-z0-9]+", line))]
    grams = {name: set(license_scan.template_bigrams(t)) for name, t in license_scan.TEMPLATES.items()}
    most = 1 + max(int(len(g) * 1.5 + 1e-9) for g in grams.values())
    found = Counter()
    for i in range(len(lines)):
        words = []
        for line in lines[i:]:
            words += line
            if len(words) > most:
                break
            own = set(map(" ".join, zip(words, words[1:], strict=False)))
            for name, g in grams.items():
                if own and (dice := 2 * len(own & g) / (len(own) + len(g))) >= 0.8:
                    found[name] = max(found[name], round(dice, 6))
    return dict(found)


def test_licences(spark):
    rng = random.Random(71)
    prose = lambda n: " ".join(rng.choice("the of a license house river permission under use and copyright 2.0 terms".split()) for _ in range(n))
    apache, bsd, mit = (license_scan.TEMPLATES[n] for n in ("apache-2.0-header", "bsd-2-clause-conditions", "mit-permission"))
    paragraphs = apache.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless", "\n \n Unless")
    points = bsd.replace("met: ", "met:\n\n * ").replace(" Redistributions in", "\n\n * Redistributions in")
    wrapped = "\n".join(f"// {' '.join(mit.split()[i : i + 7])}" for i in range(0, len(mit.split()), 7))
    rows = [
        (1, "Prose here.\nReleased under the MIT License.\nMore prose.", "a"),
        (2, mit.replace(". ", ".\n"), "a"),
        (3, "LICENSED UNDER CC BY-NC 4.0!", "a"),
        (4, "We licensed a house under some terms.", "a"),
        (5, None, "a"),
        (6, "", "a"),
        (7, "license", "a"),
        (1, "Released under the MIT License.", "a"),
        (8, "x " * 50_000 + "\n\nLicensed under the Apache License, Version 2.0.\n\n" + "y " * 9, "a"),
        (9, f"{prose(300)}\n\n{paragraphs}\n\n{prose(300)}", "a"),
        (10, f"{prose(60)}\n{points}\n{prose(60)}", "a"),
        (11, f"{prose(30)}\n{wrapped}\nint main() {{ return 0; }}\n{prose(30)}", "a"),
    ]
    rows += [(100 + i, "\n".join(prose(rng.randint(0, 30)) if rng.random() < 0.8 else rng.choice([*license_scan.TEMPLATES.values()]).replace(rng.choice(["the ", "and ", "license"]), "") for _ in range(rng.randint(1, 12))), "a") for i in range(60)]
    got = {(r.doc_id, r.license): r.dice for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[(1, "mit-notice")] == 1.0 and got[(2, "mit-permission")] > 0.95 and got[(3, "cc-by-nc-4.0-notice")] == 1.0 and got[(8, "apache-2.0-notice")] == 1.0
    assert got[(9, "apache-2.0-header")] == got[(10, "bsd-2-clause-conditions")] == got[(11, "mit-permission")] == 1.0
    assert not {4, 5, 6, 7} & {i for i, _ in got}
    assert got == {(i, name): dice for i, text, _ in rows for name, dice in plain_licences(text).items()}
    assert license_scan.scan(docs(spark, [])).collect() == []


def test_licences_that_tie(spark):
    """A unit that two templates match equally well gives a row for each; repeated rows give none more."""
    templates = {"one": "permission is granted to use the software freely by anyone", "two": "permission is granted to use the software freely by everyone", "same": "permission is granted to use the software freely by anyone"}
    rows = [(1, "Permission is granted to use the software freely by people", "a")] * 2 + [(None, templates["one"], "a")]
    found = sorted(((r.doc_id or 0), r.license, r.dice) for r in license_scan.scan(docs(spark, rows), templates=templates).collect())
    assert found == [(0, "one", 1.0), (0, "same", 1.0), (0, "two", 0.888889), (1, "one", 0.888889), (1, "same", 0.888889), (1, "two", 0.888889)]


def test_licence_pruning_loses_nothing():
    for text in license_scan.TEMPLATES.values():
        grams = license_scan.template_bigrams(text)
        needed = license_scan.required_words(grams, 0.8)
        kept = [g for g in grams if not set(g.split()) & needed]  # all that a unit without the words can share
        assert 2 * len(kept) / (len(kept) + len(grams)) < 0.8 or len(kept) < len(grams) * 0.8 / 1.2 + 1e-9


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_spans(spark):
    rng = random.Random(1)
    parts = ["secret: ", "token", "=", "password", "'", '"', " ", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "é", "𝔘", "API_key", "apikey: abcdefgh", 'Token = "', "\n", "0123456789abcdef0123456789abcdef", "tokentoken=aaaaaaaa", "ſecret=abcdefghij"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "a") for i in range(800)] + [(9001, None, "a"), (9002, "", "a"), (9003, "tail " * 30_000 + "secret=abcdefgh", "a")]
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, rows)).collect()}
    for i, text, _ in rows:
        spans = base_spans(text)
        digest = hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert (got[i].base_sha256, got[i].n_assign, got[i].n_access, got[i].n_hex) == (digest, *(sum(s[1] == k for s in spans) for k in range(3))), text
    assert secret_scan.scan(docs(spark, [])).collect() == []


def test_markov_spans_and_redaction(spark):
    words = "the house that was built by some people near river with many windows and doors identifier function".split()
    rng = random.Random(2)
    prose = [(i, " ".join(rng.choices(words, k=120)), "a") for i in range(300)]
    key = "Kx9fQ2mZ7pLr4TbW8vYc1NdG5h"
    rows = [*prose, (1000, f"see {key} there", "a"), (1001, "many_house_windows_by_river_2 and password: hunter2hunter2 too", "a"), (1002, None, "a"), (1003, "number 4929381720394857362 there", "a")]
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs(spark, rows)).collect()}
    assert got[1000] == f"markov:4:{4 + len(key)}"
    assert got[1001] == "assign:34:58"
    assert sum(s != "" for s in got.values()) == 2
    frame = docs(spark, rows)
    clean = {r.doc_id: r for r in secret_scan.redact(frame).collect()}
    assert secret_scan.redact(frame).columns == frame.columns
    assert clean[1000].text == "see [SECRET] there" and clean[1000].n_chars == 18
    assert clean[1001].text == "many_house_windows_by_river_2 and [SECRET] too"
    assert clean[1002].text is None and clean[5].text == prose[5][1]


def plain_models(rows, seed=11):
    """The two tables of log ratios, from counts by hand over all documents."""
    ordinary, random_64, random_16 = [], [], []
    for i, text, _ in rows:
        for a, _, b in reversed(base_spans_of_any_length(text)):
            text = text[:a] + " " + text[b:]
        ordinary += re.findall("[A-Za-z0-9+]{4,}", text or "")
        digest = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
        random_64.append(base64.b64encode(bytes.fromhex(digest)).decode().replace("=", "").replace("/", ""))
        random_16.append(hashlib.sha256(digest.encode()).hexdigest())
    logs = []
    for strings in (ordinary, secret_scan.identifiers() * 4, secret_scan.successive() * 4, random_64, random_16):
        pairs = Counter(p for s in strings for p in [s[:1], *(s[j : j + 2] for j in range(len(s) - 1))])
        singles = Counter(c for s in strings for c in s)
        every = sum(singles.values()) + 0.5 * len(secret_scan.ALPHABET)
        table = {}
        for before in ["", *secret_scan.ALPHABET]:
            n, distinct = sum(pairs[before + c] for c in secret_scan.ALPHABET), sum(pairs[before + c] > 0 for c in secret_scan.ALPHABET)
            for c in secret_scan.ALPHABET:
                base = (singles[c] + 0.5) / every
                table[before, c] = math.log((max(pairs[before + c] - 1, 0) + distinct * base) / n if n else base)
        logs.append(table)
    out, common = [], {k: math.log(0.45 * math.exp(logs[0][k]) + 0.45 * math.exp(logs[1][k]) + 0.1 * math.exp(logs[2][k])) for k in logs[0]}
    for model in logs[3:]:
        ratio = {k: model[k] - common[k] for k in model}
        out.append({(b, c): 0.0 if c in "/_-" else ratio["" if b in ("/", "_", "-") else b, c] for b, c in ratio})
    return out


def base_spans_of_any_length(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "")]
    return sorted(found + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text or "")])


def test_markov_models_and_scores_by_hand(spark):
    rng = random.Random(8)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join([*(word() for _ in range(60)), *("-".join(word() for _ in range(4)) for _ in range(3))]), "a") for i in range(200)]
    rows += [(300, "token = abcdefghijkl tail", "a"), (301, None, "a"), (302, "é" * 9, "a")]
    models, tables = secret_scan.train(docs(spark, rows), sample_docs=10**6), plain_models(rows)
    for model, table in zip(models, tables, strict=True):
        assert model == pytest.approx([table[b, c] for b in ["", *secret_scan.ALPHABET] for c in secret_scan.ALPHABET])
    # a run has a span if and only if some stretch of it is unlikely enough, by all stretches
    runs = ["".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(n)) for n in (16, 17, 20, 24, 40) * 6]
    runs += ["/".join(word() for _ in range(5)) for _ in range(30)] + ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (16, 20, 31) * 5]
    scanned = {r.doc_id: r.spans for r in secret_scan.with_spans(docs(spark, [(i, f"( {t} )", "a") for i, t in enumerate(runs)]), models).collect()}
    seen = Counter()
    for i, run in enumerate(runs):
        expected = possible = False
        for table in tables:
            score = [table["" if j == 0 else run[j - 1], c] for j, c in enumerate(run)]
            total = [0.0, *itertools.accumulate(score)]
            expected |= any(total[b] - total[a] >= 15 and total[b] - total[a] >= 0.6 * (b - a) for a in range(len(run)) for b in range(a + 12, len(run) + 1))
            possible |= any(total[b] - total[a] >= 15 and total[b] - total[a] >= 0.6 * (b - a) for a in range(len(run)) for b in range(a + 1, len(run) + 1))
        if expected:
            assert scanned[i], run
        if not possible:
            assert not scanned[i], run
        seen[expected, bool(scanned[i])] += 1
    assert seen[True, True] > 30 and seen[False, False] >= 10


def test_markov_spans_within_paths_and_short(spark):
    plain = "abcdefghijklmnopqrstuvwxyz/_-"
    ratios = [-3.0 if a in plain and b in plain else 1.2 for a in ["a", *secret_scan.ALPHABET] for b in secret_scan.ALPHABET]
    ratios = secret_scan.separated(ratios)
    key, other, path = "Kx9fQ2mZ7pLr4TbW8vYc1NdG", "Zq7RwX3nJ9tHk2VbP5yMcL8s", "/services/hooks/incoming/the/people/near/the/river/"
    at, n = len(path), len(key)
    cases = [
        (f"see {path}{key} there", [(4 + at, 3, 4 + at + n)]),
        (f"see {key[:16]} there", [(4, 3, 20)]),
        (f"{path}{key}{path}{other}/doors", [(at, 3, at + n), (2 * at + n, 3, 2 * at + 2 * n)]),
        (f"{path}2 many_house_windows_2 here", []),
        (f"see {key} there", [(4, 3, 4 + n)]),
    ]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.with_spans(docs(spark, [(i, t, "a") for i, (t, _) in enumerate(cases)]), [ratios, ratios]).collect()}
    assert got == {i: spans for i, (_, spans) in enumerate(cases)}


ORDINARY = """
getElementsByClassName AbstractSingletonProxyFactoryBean Donaudampfschifffahrtsgesellschaft node_modules/webpack-dev-server/client/index /usr/local/lib/python3/site-packages/numpy
2024-11-28T12-14-42 aaaaaaaaaaaaaaaaaaaaaaaa abcdefghijklmnopqrstuvwxyz internationalization counterrevolutionaries NullPointerException IllegalArgumentException addEventListenerOnce
/home/ubuntu/projects/frontend/src/components src/main/java/com/example/service/UserServiceImpl docker-compose-production release-2023-09-15-hotfix 20231115_143022_backup
spark_sql_shuffle_partitions XMLHttpRequestEventTarget ABCDEFGHIJKLMNOPQRSTUVWXYZ Rechtsschutzversicherungsgesellschaften anticonstitutionnellement electroencefalografista
MAX_CONNECTIONS_PER_HOST DEFAULT_BUFFER_SIZE_BYTES kubernetes-dashboard-proxy en_US_UTF8_collation_default github/workflows/continuous-integration HttpServletRequestWrapper
com/google/common/collect/ImmutableList 0123456789abcdefghij version-10-2-17-build-4521 C/Users/Administrator/Documents/Reports thumbnail_1920x1080_final_v2 Weltmeisterschaft
""".split()


def test_ordinary_strings_and_planted_keys(spark):
    """At most 1 in 20 ordinary strings is taken for a secret, and at least 9 in 10 keys of each kind are found, whatever words the corpus has."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    corpus = docs(spark, [(None if i % 2 else i, " ".join(word() for _ in range(60)), "a") for i in range(300)])
    models = secret_scan.train(corpus)
    letters, of = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", lambda a, n: "".join(rng.choice(a) for _ in range(n))
    digits = "0123456789"
    kinds = {
        "mixed 12": lambda: of(letters + digits, 12),
        "mixed 24": lambda: of(letters + digits, 24),
        "letters 16": lambda: of(letters, 16),
        "lower 32": lambda: of(letters[26:], 32),
        "hex 24": lambda: of("0123456789abcdef", 24),
        "uuid": lambda: "-".join(of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "prefixed": lambda: "ghp_" + of(letters + digits, 36),
        "in a path": lambda: f"/services/hooks/{of(letters + digits, 24)}/people",
    }
    rows = [(("ordinary", t), f"see {t} there") for t in ORDINARY] + [((kind, t := make()), f"see {t} there") for kind, make in kinds.items() for _ in range(40)]
    found = {r.doc_id: r.spans for r in secret_scan.with_spans(docs(spark, [(i, t, "a") for i, (_, t) in enumerate(rows)]), models).collect()}
    share = Counter(kind for i, ((kind, _), _) in enumerate(rows) if found[i])
    assert share["ordinary"] <= len(ORDINARY) / 20
    assert all(share[kind] >= 36 for kind in kinds), share


def test_rows_without_ids_are_sampled(spark):
    """The sample of a table without ids follows its texts."""
    rows = [(None, f"w{i} abcd efgh", "a") for i in range(400)]
    assert secret_scan.train(docs(spark, rows), sample_docs=40) != secret_scan.train(docs(spark, rows), sample_docs=10**6)
    assert secret_scan.train(docs(spark, rows[:1]))


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op4_license_scan", "op5_mix_sources"])
def test_query_equals_sql(spark, name):
    import duckdb

    from tidewell.llm import queries

    folder = "/root/testdata/sf0.001"
    found = queries.queries()[name](spark, folder)
    columns = sorted(found.columns)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    plain = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(plain, found.select(*columns).collect())) == sorted(map(plain, expected))
