"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source has a weight; sources share a token budget by weight, and no source gets more
than ``cap`` times what it holds (the excess is shared again by weight).  The budget is cut
into blocks of equal token counts, which are given to sources, then to the shards of each
source, by highest quotients ``weight / (2k - 1)``.  In a shard, documents stand in a seeded
order; a quota of ``q`` blocks out of ``n`` means ``q // n`` whole passes over the shard and
``q % n`` blocks selected by a seeded permutation.

Only DataFrame functions are used.  Sources, and the shards of a source, are ranked over ranges
(``operators.prefix``), so none of them is one window; documents are windowed by shard, and shards are of bounded
size, so that a source with a third of all rows is many shards.  Shards go by id and size, so
rows of one id (or of none) are spread as well; documents without words are in no window.

Defined results: null text has size 0; null source is a source of its own, last in order;
null ids are ordered as -1; a document of size 0 takes 0; repeated rows each count; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.store import Carried, small
from tidewell.operators.prefix import ranked
from tidewell.sources.shared import alone, written

WORD = r"[^\x20\x09-\x0D]+"
#: Modulus and multipliers of the seeded order of documents.
PRIME, SHARD_FACTOR, SIZE_FACTOR, ORDER_FACTOR = 2147483647, 48271, 16807, 69621
#: Prime factors of the seeded block permutations; each is above any block count of a shard.
BLOCK_PRIMES = (1000000007, 998244353, 1000000009, 754974721)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(key: Column, factor: int, seed: int, more: Column | None = None) -> Column:
    value = F.pmod(F.coalesce(key, F.lit(-1)).cast("long"), F.lit(PRIME)) * F.lit(factor) + F.lit(seed)
    return F.pmod(value if more is None else value + more, F.lit(PRIME))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: ``source_ix`` (by code point, null last), its size, weight and target."""
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), keys=[], order=[F.col("source").asc_nulls_last()], rank="source_ix")
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("source_ix") - 1, F.lit(len(weights))) + 1).cast("int")))
    sources = sources.withColumn("most", F.col("source_size") * F.lit(cap))
    words, weight = sources.agg(F.sum("source_size"), F.sum("weight")).head()
    budget = (words or 0) * share
    # the level: sources in order of most / weight are full, until the rest can share what is left
    filled = ranked(sources, keys=[], order=[F.col("most") / F.col("weight"), F.col("source_ix")], rank="_place", sums={"_most": "most", "_weight": "weight"})
    level = (F.lit(float(budget)) - (F.col("_most") - F.col("most"))) / (F.lit(weight) - (F.col("_weight") - F.col("weight")))
    first = filled.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min(F.struct("_place", "level"))["level"]).head()[0]
    target = F.col("most") if first is None else F.least("most", F.lit(first) * F.col("weight"))
    return sources.withColumn("budget", F.lit(float(budget))).withColumn("target", target).drop("weight", "most")


def _apportion(parties: DataFrame, key: str, weight: str, seats: Column, within: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` divided among the rows of each ``within`` by Sainte-Lague.

    A party's seats are within n * weight / (2 * sum) + 1 of its exact share, so only the
    quotients in that window are ranked; their number is in proportion to the parties.  A
    source may have very many shards, so quotients are ranked over ranges, and what is known of
    a source is a row that is joined.
    """
    totals = small(parties.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).cast("double").alias("_all")))
    sized = (
        parties.join(totals, within)
        .withColumn("_seats", seats)
        .withColumn("_exact", F.when(F.col("_all") > 0, F.col("_seats") * F.col(weight) / F.col("_all")).otherwise(0.0))
        .withColumn("_span", F.when(F.col("_all") > 0, F.ceil(F.col("_n") * F.col(weight) / (2 * F.col("_all")))).otherwise(0) + 3)
        .withColumn("_base", F.greatest(F.lit(0).cast("long"), F.floor("_exact") - F.col("_span")))
    )
    left = small(sized.groupBy(*within).agg((F.first("_seats") - F.sum("_base")).alias("_left")))
    quotients = (
        sized.filter(F.col(weight) > 0)
        .withColumn("_k", F.explode(F.sequence(F.col("_base") + 1, F.floor("_exact").cast("long") + F.col("_span"))))
        .select(*within, key, "_k", (F.col(weight) / (2 * F.col("_k") - 1)).alias("_quotient"))
    )
    order = [F.col("_quotient").desc(), F.col(key), F.col("_k")]
    won = ranked(quotients, keys=within, order=order, rank="_rank").join(left, within).filter(F.col("_rank") <= F.col("_left"))
    won = won.groupBy(*within, key).agg(F.count(F.lit(1)).alias("_won"))
    return (
        sized.join(won, [*within, key], "left")
        .withColumn("quota", F.col("_base") + F.coalesce("_won", F.lit(0)))
        .drop("_seats", "_n", "_all", "_exact", "_span", "_base", "_won")
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    shard_tokens: int = 1 << 20,
    most_block_tokens: int = 2048,
    seed: int = 20240229,
) -> DataFrame:
    """The mix, a row for each document: doc_id, source, size, source_size, target, taken, copies.

    ``taken`` counts the words that the selected blocks take of the document (at most ``cap``
    times its size); ``copies`` is for uses that keep documents whole: passes over the
    document, plus one if the block at its middle is selected.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")

    def quotas() -> DataFrame:
        sources = source_targets(sized, weights, share, cap)
        least = sources.filter("target > 0").agg(F.min("target")).head()[0]
        block = max(1, min(most_block_tokens, math.floor((least or 0) / 1000)))
        sources = sources.withColumn("block", F.lit(block).cast("long"))
        sources = _apportion(sources.withColumn("_one", F.lit(1)), "source_ix", "target", F.round(F.col("budget") / F.col("block")).cast("long"), ["_one"]).drop("_one")
        return sources.withColumnRenamed("quota", "source_quota").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_tokens))))

    sources = alone(quotas, "sources")
    every = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    shard = F.pmod(_seeded(F.col("doc_id"), SHARD_FACTOR, seed, F.col("size") * F.lit(SIZE_FACTOR)), F.col("shards"))
    placed = every.filter("size > 0").withColumn("shard", shard)
    shards = placed.groupBy("source_ix", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    whole = shards
    shards = alone(lambda: _apportion(whole, "shard", "words", F.col("source_quota"), ["source_ix"]), "shards")
    shards = (
        shards.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("words") / F.col("block"))))
        .withColumn("quota", F.least(F.col("quota"), F.floor(F.lit(cap) * F.col("blocks"))))
        .select("source_ix", "shard", F.floor(F.col("quota") / F.col("blocks")).alias("passes"), F.pmod("quota", "blocks").alias("part"), "blocks")
    )
    row = Window.partitionBy("source_ix", "shard").orderBy(_seeded(F.col("doc_id"), ORDER_FACTOR, seed), "doc_id", "size")
    ends = placed.withColumn("end", F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))

    def chosen(k: Column) -> Column:
        factor = F.element_at(F.array(*(F.lit(p) for p in BLOCK_PRIMES)), (F.pmod(F.col("shard") + F.col("source_ix"), F.lit(len(BLOCK_PRIMES))) + 1).cast("int"))
        return F.pmod((k + F.lit(seed) + F.col("shard")) * factor, F.col("blocks")) < F.col("part")

    part_of = F.aggregate(
        F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))),
        F.lit(0).cast("long"),
        lambda sum_, k: sum_ + F.when(chosen(k), F.least("end", (k + 1) * F.col("block")) - F.greatest("begin", k * F.col("block"))).otherwise(F.lit(0).cast("long")),
    )
    middle = F.floor((F.col("begin") + F.floor(F.col("size") / 2)) / F.col("block"))
    own = ["doc_id", "source", "size", "source_size", "target"]
    nothing = F.lit(0).cast("long")
    return (
        ends.join(shards, ["source_ix", "shard"])
        .select(*own, (F.col("passes") * F.col("size") + part_of).cast("long").alias("taken"), (F.col("passes") + chosen(middle).cast("long")).cast("long").alias("copies"))
        .unionByName(every.filter("size = 0").select(*own, nothing.alias("taken"), nothing.alias("copies")))
    )


def mixed(docs: DataFrame, **options: float) -> DataFrame:
    """The mix of whole documents: each row ``copies`` times, with its own columns.

    A document of no words is in no block of tokens, so the mix doesn't hold it.
    """
    carried = Carried(docs)
    own = carried.frame.select("*", F.coalesce(carried.of("doc_id"), F.lit(-1)).alias("id"), F.col(carried.of("source")).alias("of"), word_count(F.col(carried.of("text"))).alias("size"))
    mix = mix_sources(docs, **options).select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("source").alias("of"), "size", "copies")
    # rows that are equal in all of these get their copies in turn
    turn = Window.partitionBy("id", "of", "size")
    own = own.withColumn("turn", F.row_number().over(turn.orderBy(F.xxhash64(carried.of("text"))))).alias("own")
    mix = mix.withColumn("turn", F.row_number().over(turn.orderBy("copies"))).filter("copies > 0").alias("mix")
    same = (F.col("own.id") == F.col("mix.id")) & F.col("own.of").eqNullSafe(F.col("mix.of")) & (F.col("own.size") == F.col("mix.size")) & (F.col("own.turn") == F.col("mix.turn"))
    return carried.back(own.join(mix, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def oracle(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shard_tokens: int = 1 << 20, most_block_tokens: int = 2048, seed: int = 20240229, copies: bool = False) -> str:
    """DuckDB SQL of the same mix, where all quotients are ranked; on demand with ``copies``."""
    also = f"""
     , CASE WHEN size > 0 THEN quota // blocks + (((last - size + size // 2) // block + {seed} + e.shard) * {list(BLOCK_PRIMES)}[(e.shard + e.ix) % {len(BLOCK_PRIMES)} + 1] % blocks < quota % blocks)::INT ELSE 0 END AS copies""" if copies else ""
    primes, order = list(BLOCK_PRIMES), f"((coalesce(doc_id, -1) % {PRIME} + {PRIME}) % {PRIME})"
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ix FROM sized GROUP BY source),
weighed AS (SELECT *, {list(weights)}[(ix - 1) % {len(weights)} + 1]::DOUBLE AS weight, source_size * {cap}::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * {share} AS budget FROM totals),
levels AS (SELECT *, (budget - coalesce(sum(most) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level FROM weighed
           WINDOW b AS (ORDER BY most / weight, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_fit AS (SELECT level AS fit FROM levels WHERE level * weight <= most ORDER BY most / weight, ix LIMIT 1),
targets AS (SELECT source, ix, source_size, budget, least(most, coalesce((SELECT fit FROM first_fit) * weight, most)) AS target FROM levels),
blocked AS (SELECT *, greatest(1, least({most_block_tokens}, coalesce(floor((min(CASE WHEN target > 0 THEN target END) OVER ()) / 1000), 1)))::BIGINT AS block FROM targets),
seats AS (SELECT ix, count(*) AS quota FROM (
    SELECT ix, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, ix, k) AS place, round(budget / block)::BIGINT AS seats
    FROM (SELECT *, unnest(range(1, 2 * ceil(target / block)::BIGINT + 4)) AS k FROM blocked WHERE target > 0)) WHERE place <= seats GROUP BY ix),
placed AS (SELECT s.*, b.ix, b.source_size, b.target, b.block, coalesce(q.quota, 0) AS source_quota,
                  (({order} * {SHARD_FACTOR} + {seed} + size * {SIZE_FACTOR}) % {PRIME}) % greatest(1, ceil(b.source_size / {shard_tokens})::BIGINT) AS shard,
                  ({order} * {ORDER_FACTOR} + {seed}) % {PRIME} AS turn
           FROM sized s JOIN blocked b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN seats q ON q.ix = b.ix),
shards AS (SELECT ix, shard, sum(size)::BIGINT AS words, any_value(source_quota) AS source_quota, any_value(block) AS block FROM placed GROUP BY ix, shard),
won AS (SELECT ix, shard, count(*) AS quota FROM (
    SELECT ix, shard, source_quota, row_number() OVER (PARTITION BY ix ORDER BY words / (2 * k - 1) DESC, shard, k) AS place
    FROM (SELECT *, unnest(range(1, 2 * ceil(2.0 * words / block)::BIGINT + 8)) AS k FROM shards WHERE words > 0)) WHERE place <= source_quota GROUP BY ix, shard),
cut AS (SELECT s.ix, s.shard, blocks, least(coalesce(quota, 0), floor({cap} * blocks)::BIGINT) AS quota
        FROM (SELECT *, greatest(1, ceil(words / block)::BIGINT) AS blocks FROM shards) s LEFT JOIN won ON won.ix = s.ix AND won.shard = s.shard),
ends AS (SELECT *, sum(size) OVER (PARTITION BY ix, shard ORDER BY turn, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS last FROM placed)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN quota // blocks * size + list_sum([
            CASE WHEN ((k + {seed} + e.shard) * {primes}[(e.shard + e.ix) % {len(primes)} + 1]) % blocks < quota % blocks
                 THEN least(last, (k + 1) * block) - greatest(last - size, k * block) ELSE 0 END
            FOR k IN range((last - size) // block, (last - 1) // block + 1)]) ELSE 0 END)::BIGINT AS taken{also}
FROM ends e JOIN cut c ON c.ix = e.ix AND c.shard = e.shard"""
