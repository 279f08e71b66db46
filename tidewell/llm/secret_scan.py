"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

First-order character models are trained from labelled samples: two of random strings (digests
of document ids in base 64, and in hexadecimal), and three of ordinary ones, which are mixed by
fixed weights: words of a bounded, seeded sample of documents (``sample_docs`` in expectation;
rows without an id are told apart by their text); words, identifiers, dates and versions that
``identifiers`` makes from a list and from the licence templates; and runs of one character or
of successive ones.  So what is usual in any of them isn't unlikely, whatever the corpus holds.
The models have a start term and are smoothed by absolute discounts, so a pair that was never
met has the probability of its second character, scaled by how often the first is followed by
something new; what follows a separator (``/``, ``_``, ``-``) begins anew.  A run of
identifier characters is a secret if the log-likelihood ratio of its characters, one random
model over the ordinary one, is high in total and per character.  Stretches of a run of which
that holds are taken first, widened to the next of ``/``, ``_`` and ``-``, so ordinary parts of
a path neither hide a token nor are taken with it.  Tokens of letters only count as well, and
so do long identifiers such as UUIDs; plain numbers do not.  Only DataFrame functions are used; the model is two
tables of 67 x 66 ratios, whatever the input.

Kinds and their fixed patterns are ``assign``, ``access`` and ``hex``; the models add
``markov`` spans, which overlap none of these.  Spans are in code points, end exclusive.

Defined results: null or empty text has no span; each row is scanned by itself, so repeated
rows repeat; an empty table gives an empty result; further columns are ignored by ``scan``
and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.license_scan import TEMPLATES
from tidewell.llm.store import Carried

# fixed values: the patterns of the base kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more characters
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more characters
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
# fixed values: words of programs, paths and compounds, from which ordinary identifiers are made
WORDS = """
abstract address admin alpha android application archive argument attribute background body bottom bridge browser buffer bundle callback category class cloud column commit company
compose config cookie currency cursor daily dashboard default deploy desktop disable display distribution document download dynamic embed empty environment example exception export
extension failure fixture flag frame framework function gateway global google graph health history https include input invoice javascript journal json kernel keyboard language
layout length light linux logger lookup manifest maximum media minimum mobile module network notice object offset organization output package partner performance photo pixel
platform plugin policy preview product program project proxy publish python query reference region remove repository require review rule runner script search service shipping signal
size sleep smart social socket software special status style submit subject success suffix summary switch symbol sync system threshold topic transform type unique universal update
variable verify video virtual webpack website weight welcome workflow world wrapper xml yaml year zone arbeit ausgabe dampf fahrt gesellschaft geschwindigkeit haupt krankheit
mannschaft schluss stadt verwaltung wirtschaft zeichnung zustand beleuchtung travail bonheur quelque aujourdhui cuidado desarrollo trabajo siguiente pequeno
""".split()
RUN = r"[A-Za-z0-9+/_-]"
SEPARATORS = "/_-"
PART_CHARACTER = r"[A-Za-z0-9+]"
PART = PART_CHARACTER + "*"  # what lies between two separators of a run


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of the first characters and of adjacent pairs of ``value``, by ``label``."""
    at = F.explode(F.sequence(F.lit(0), F.length("value") - 1))
    return (
        strings.filter(F.length("value") >= 1)
        .select("label", "value", at.alias("i"))
        .select("label", F.when(F.col("i") == 0, F.expr("substring(value, 1, 1)")).otherwise(F.expr("substring(value, i, 2)")).alias("pair"))
        .groupBy("label", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def conditional(counts: dict[str, int]) -> list[float]:
    """Log-probabilities of first characters, then of each character after each other one.

    ``counts`` has how often a character began a string, and how often a pair stood in one.
    Of ``n`` characters after another, ``t`` of them distinct, a character has probability
    ``(max(count - 1, 0) + t * base) / n``, or ``base`` if n is 0; ``base`` is its part of all
    characters.  So what was met once counts as never met: it may come from a secret.
    """
    total = {c: 0.5 for c in ALPHABET}
    for key, n in counts.items():
        total[key[-1]] += n
    every = sum(total.values())
    base = [total[c] / every for c in ALPHABET]
    out = []
    for before in ["", *ALPHABET]:
        row = [counts.get(before + c, 0) for c in ALPHABET]
        n, distinct = sum(row), sum(x > 0 for x in row)
        out += [log((max(x - 1, 0) + distinct * b) / n if n else b) for x, b in zip(row, base, strict=True)]
    return out


def identifiers() -> list[str]:
    """Ordinary strings: each word in three spellings, joined with the next ones, and dates, versions and numbers."""
    out = [w for text in TEMPLATES.values() for w in re.findall(f"{PART_CHARACTER}{{2,}}", text)]
    for at, word in enumerate(WORDS):
        second, third = (WORDS[(at + step) % len(WORDS)] for step in (37, 101))
        out += [word, word.capitalize(), word.upper(), word + second.capitalize() + third.capitalize(), word.capitalize() + second.capitalize(), word + second, f"{word}{at % 30}", f"{word[0].upper()}{second.capitalize()}"]
    for year in range(1990, 2035):
        month, day, hour = year % 12 + 1, year % 28 + 1, year % 24
        out += [f"{year}", f"{year}{month:02}{day:02}", f"{day:02}T{hour:02}", f"{month:02}{day:02}{hour:02}Z", f"v{month}", f"{month:02}", f"{day:02}", f"{hour:02}{day:02}{month:02}00"]
    return out


def successive() -> list[str]:
    """Runs of one character, and of successive ones."""
    rows = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "9876543210")
    return [*rows, *rows, *(c * 9 for c in ALPHABET)]


def counted(strings: list[str], times: int = 4) -> dict[str, int]:
    """First characters and adjacent pairs, as ``conditional`` takes them; each counts ``times``, as it is no chance find."""
    found = Counter(x[max(0, i - 1) : i + 1] for x in strings for i in range(len(x)))
    return {key: times * n for key, n in found.items()}


#: Parts of the ordinary models: the documents, the identifiers, the runs.
WEIGHTS = (0.45, 0.45, 0.1)


def mixed(models: list[list[float]]) -> list[float]:
    """Log-probabilities of the ordinary models together."""
    return [log(sum(w * exp(x) for w, x in zip(WEIGHTS, row, strict=True))) for row in zip(*models, strict=True)]


def separated(ratios: list[float]) -> list[float]:
    """The same ratios, but separators tell nothing, and what follows one begins a string."""
    size = len(ALPHABET)
    rows = [ratios[i : i + size] for i in range(0, len(ratios), size)]
    rows = [rows[0], *(rows[0] if before in SEPARATORS else row for before, row in zip(ALPHABET, rows[1:], strict=True))]
    return [0.0 if c in SEPARATORS else x for row in rows for c, x in zip(ALPHABET, row, strict=True)]


def train(docs: DataFrame, *, sample_docs: int = 2000, seed: int = 11) -> list[list[float]]:
    """For each random model, log ratios to the ordinary one, as ``conditional`` has them."""
    total = docs.count()
    part = min(1.0, sample_docs / total) if total else 0.0
    chosen = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id"), F.lit(seed)))
    sample = docs.filter(F.pmod(chosen, F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text"])
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    ordinary = sample.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(plain, F.lit(PART_CHARACTER + "{4,}"), F.lit(0))).alias("value"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id"), F.xxhash64("text"))), 256)
    coded = F.array(F.struct(F.lit(1).alias("label"), F.regexp_replace(F.base64(F.unhex(digest)), "[=/]", "").alias("value")), F.struct(F.lit(2).alias("label"), F.sha2(digest, 256).alias("value")))
    random = sample.select(F.explode(coded).alias("s")).select("s.label", "s.value")
    counts: list[dict[str, int]] = [{}, {}, {}]
    for row in _pairs(ordinary.unionByName(random)).collect():  # at most 3 x 67 x 66 rows
        if set(row["pair"]) <= set(ALPHABET):
            counts[row["label"]][row["pair"]] = row["n"]
    documents, *models = map(conditional, counts)
    common = mixed([documents, conditional(counted(identifiers())), conditional(counted(successive()))])
    return [separated([a - b for a, b in zip(model, common, strict=True)]) for model in models]


def _located(text: Column, found: Column) -> Column:
    """(start, end) of matches that were found from left to right without overlap.

    The text of a match can't occur between the end of the match before it and its own start,
    or the pattern would have matched there; so a plain search finds it.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = F.aggregate(
        found,
        F.struct(F.lit(1).alias("next"), none.alias("spans")),
        lambda acc, m: F.get(  # of one element, so that it is located once
            F.transform(
                F.array(F.call_function("locate", m, text, acc["next"])),
                lambda at: F.struct((at + F.length(m)).alias("next"), F.concat(acc["spans"], F.array(F.struct((at - 1).alias("start"), (at - 1 + F.length(m)).alias("end")))).alias("spans")),
            ),
            F.lit(0),
        ),
    )
    return F.when(F.size(found) > 0, state["spans"]).otherwise(none)


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _scores(value: Column, ratios: Column) -> Column:
    """The log ratio of each character after the one before it."""
    place = lambda i: F.call_function("instr", F.lit(ALPHABET), F.call_function("substring", value, i, F.lit(1)))
    row = lambda i: F.when(i > 1, place(i - 1)).otherwise(0)
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.element_at(ratios, (row(i) * F.lit(len(ALPHABET)) + place(i)).cast("int")))


def _stretches(scores: Column, least_ratio: float) -> Column:
    """(start, end, total) in a run: stretches of best total, of ``least_ratio`` or more.

    A stretch ends at its best total, once the total is down to 0 or by ``least_ratio`` from
    the best; as the total is then the least so far, nothing better starts before.
    """
    none = F.array().cast("array<struct<start:int,end:int,total:double>>")
    closing = lambda acc: F.when(acc["best"] >= least_ratio, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["best"].alias("total"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + x
        closed = (total <= 0) | (acc["best"] - total >= least_ratio)
        better = ~closed & (total > acc["best"])
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(closed, acc["at"] + 1).otherwise(acc["start"]).alias("start"),
            F.when(closed, 0.0).otherwise(total).alias("total"),
            F.when(closed, 0.0).when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, acc["at"] + 1).otherwise(acc["end"]).alias("end"),
            F.when(closed, closing(acc)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(scores, F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(0).alias("end"), none.alias("out")), step, closing)


def _merged(spans: Column) -> Column:
    """Spans that overlap become one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    span = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), span(last["start"], F.greatest(last["end"], s["end"])))
        return F.when((F.size(out) > 0) & (s["start"] < last["end"]), joined).otherwise(F.concat(out, span(s["start"], s["end"])))

    return F.aggregate(F.array_sort(spans), none, step)


def with_spans(docs: DataFrame, models: list[list[float]], *, least_run: int = 12, least_ratio: float = 15.0, least_per_char: float = 0.6) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, kind, end), by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    run = RUN + "{%d,}" % least_run
    found = docs.select(
        "*",
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("_assign"),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)).alias("_access"),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("_hex"),
        F.regexp_extract_all(text, F.lit(run), F.lit(0)).alias("_runs"),
    )
    # the patterns match again from the start of each match; too short values go after all are placed
    placed = F.arrays_zip(_located(text, F.col("_assign")).alias("at"), F.transform("_assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))).alias("size"))
    assign = F.transform(F.filter(placed, lambda z: z["size"] >= 8), lambda z: z["at"])
    based = found.withColumn("base", F.array_sort(F.concat(_of_kind(assign, 0), _of_kind(_located(text, F.col("_access")), 1), _of_kind(_located(text, F.col("_hex")), 2))))
    apart = lambda z: ~F.exists(F.col("base"), lambda b: (b["start"] < z["end"]) & (z["start"] < b["end"]))
    placed_runs = F.arrays_zip(_located(text, F.col("_runs")).alias("at"), F.col("_runs").alias("value"))

    def widened(z: Column, t: Column) -> Column:
        piece = F.call_function("substring", z["value"], t["start"] + 1, t["end"] - t["start"])
        start, end = t["start"] + F.length(F.regexp_extract(piece, "^[/_-]*", 0)), t["end"] - F.length(F.regexp_extract(piece, "[/_-]*$", 0))
        before, after = F.call_function("substring", z["value"], F.lit(1), start), F.call_function("substring", z["value"], end + 1, F.length(z["value"]))
        left, right = F.length(F.regexp_extract(before, PART + "$", 0)), F.length(F.regexp_extract(after, "^" + PART, 0))
        return F.struct((start - left).alias("start"), (end + right).alias("end"))

    def of_run(z: Column) -> Column:
        total, size = F.aggregate(z["scores"], F.lit(0.0), lambda t, x: t + x), F.length(z["value"])
        inside = F.filter(_stretches(z["scores"], least_ratio), lambda t: t["total"] >= least_per_char * (t["end"] - t["start"]))
        long_ = F.filter(_merged(F.transform(inside, lambda t: widened(z, t))), lambda t: t["end"] - t["start"] >= least_run)
        whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))
        spans = F.when(F.size(long_) > 0, long_).when((total >= least_ratio) & (total >= least_per_char * size), whole).otherwise(F.lit(None))
        spans = F.filter(F.coalesce(spans, F.slice(whole, 1, 0)), lambda t: F.call_function("substring", z["value"], t["start"] + 1, t["end"] - t["start"]).rlike("[A-Za-z]"))
        return F.transform(spans, lambda t: F.struct((z["start"] + t["start"]).alias("start"), (z["start"] + t["end"]).alias("end")))

    def of_model(ratios: list[float]) -> Column:
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded once
        runs = F.transform(placed_runs, lambda z: F.struct(z["at"]["start"].alias("start"), z["value"].alias("value"), _scores(z["value"], table).alias("scores")))
        return F.flatten(F.transform(runs, of_run))

    more = F.filter(_merged(F.concat(*map(of_model, models))), apart)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return based.withColumn("spans", F.array_sort(F.concat("base", F.when(F.size("_runs") > 0, _of_kind(more, 3)).otherwise(none)))).drop("_assign", "_access", "_hex", "_runs")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, **options: float) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    models = train(docs)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return with_spans(docs.select("doc_id", "text"), models, **options).select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, *, mask: str = "[SECRET]", **options: float) -> DataFrame:
    """The documents, with each secret's span replaced by ``mask``; nothing else changes."""
    carried = Carried(docs)
    state = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.call_function("substring", F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
    )
    rest = lambda s: F.concat(s["out"], F.call_function("substring", F.col("text"), s["at"] + 1, F.length("text")))
    spans = with_spans(carried.frame.withColumnRenamed(carried.of("text"), "text"), train(docs), **options)
    cleaned = spans.withColumn(carried.of("text"), F.when(F.size("spans") > 0, rest(state)).otherwise(F.col("text")))
    return carried.back(cleaned, n_chars=F.length(carried.of("text")).cast("long"))
