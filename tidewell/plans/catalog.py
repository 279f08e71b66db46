"""The named queries over the TPC-H-like, event and document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import normalised
from tidewell.operators import sketches, vectors
from tidewell.operators.nested import map_sums, parsed
from tidewell.operators.ranking import top_per_group
from tidewell.operators.time import asof_join, in_blocks, interval_join, numbered, sessions
from tidewell.sources.shared import new_path
from tidewell.sources.sinks import write_partitions
from tidewell.sources.tables import table
from tidewell.streaming.drain import drained, stream_of
from tidewell.streaming.windows import deduplicated, interval_joined, session_counts, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary by return flag and line status."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey = 2 AND c_nationkey = s_nationkey AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY n_name""")
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of suppliers by nation of one region, from customers of the same nation.

    The two small dimension tables are fixed in size; the others are left to the optimizer.
    """
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region").filter("r_regionkey = 2")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .groupBy("n_name")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    )


@query("""
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')""")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered nothing since 2000."""
    late = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name", "c_acctbal")


@query("""
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, sum(l_quantity) AS sum_qty, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def quantity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by return flag and line status, with subtotals."""
    return (
        table(spark, sf_dir, "lineitem")
        .rollup("l_returnflag", "l_linestatus")
        .agg(F.grouping_id().cast("long").alias("level"), F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))
        .select("l_returnflag", "l_linestatus", "level", "sum_qty", "n")
    )


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by type of event."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("""
SELECT p_brand, p_partkey, p_retailprice, rank FROM (
  SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3""")
def dearest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest parts of each brand."""
    return top_per_group(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest orders: a top-k report."""
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT c_nationkey AS nationkey, 'customer' AS only_in FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
UNION ALL
SELECT c_nationkey, 'both' FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)""")
def nation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of rich customers, and those of rich suppliers as well."""
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("nationkey"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("nationkey"))
    return rich.subtract(suppliers).withColumn("only_in", F.lit("customer")).unionByName(rich.intersect(suppliers).withColumn("only_in", F.lit("both")))


@query("""
SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in daily windows."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with an hour's gap."""
    return sessions(table(spark, sf_dir, "events"), key="user_id", time="ts", gap="1 hour")


@query("""
SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS moving_avg,
       value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events""")
def moving_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average of five events and the change from the one before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    blocked, order, own = in_blocks(numbered(events, key="user_id", time="ts", order="event_id"), key="user_id", reach=4)
    found = blocked.select("event_id", "user_id", F.round(F.avg("value").over(order.rowsBetween(-4, 0)), 6).alias("moving_avg"), (F.col("value") - F.lag("value").over(order)).alias("change"), own.alias("own"))
    return found.filter("own").drop("own")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS before_event_id FROM events p JOIN events v ON v.user_id = p.user_id
  AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL '6 hours' WHERE p.event_type = 'purchase' AND v.event_type = 'view'""")
def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user in the six hours before each of the user's purchases."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    pairs = interval_join(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), key="user_id", time="ts", seconds=6 * 3600)
    return pairs.select("event_id", "user_id", "before_event_id")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS asof_event_id, v.value AS asof_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    joined = asof_join(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), key="user_id", time="ts", order="event_id", values=["event_id", "value"])
    return joined.select("event_id", "user_id", "asof_event_id", "asof_value")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their JSON properties."""
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT md5(trim(regexp_replace(lower(text), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each normalised text, and its copies."""
    return table(spark, sf_dir, "documents").groupBy(F.md5(normalised(F.col("text"))).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""
SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, quantile_cont(n_chars, 0.5) AS median_chars FROM documents GROUP BY ALL""")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by language and source."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.percentile("n_chars", F.lit(0.5)).alias("median_chars"))


@query("""
SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, round(avg(toxic), 6) AS toxic_rate, round(avg(quality), 6) AS quality_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates by language."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled_id")
    joined = docs.join(labels, F.col("doc_id") == F.col("labelled_id"), "left")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("labelled_id").alias("labelled"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.round(F.avg("quality"), 6).alias("quality_rate"))


@query("""
SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations put together in order of turns."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(said, lambda s: s["line"]), "\n").alias("transcript"))


@query("""
SELECT user_id, max(CASE WHEN event_type = 'view' THEN n END) AS view, max(CASE WHEN event_type = 'purchase' THEN n END) AS purchase
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and purchases of each user, in columns."""
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "purchase"]).agg(F.count(F.lit(1)))


@query("""
SELECT start, start + INTERVAL '1 day' AS finish, event_type, n, total FROM (
  SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
WHERE start + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the events as a stream; those that the watermark has not passed stay open."""
    counts = windowed_counts(stream_of(spark, sf_dir, "events"), time="ts", size="1 day", by=["event_type"])
    return drained(counts, "counts").select("start", F.col("end").alias("finish"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, each id once within the watermark."""
    once = deduplicated(stream_of(spark, sf_dir, "events"), keys=["event_id"], time="ts")
    return drained(once, "once").select("event_id", "user_id", "event_type", "value")


@query("""
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM scored QUALIFY rank <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50, among all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.nearest(rows.filter(F.col("id") % 50 == 0), rows, 10)


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with an hour's gap as a stream; those that the watermark has not passed stay open."""
    return drained(session_counts(stream_of(spark, sf_dir, "events"), key="user_id", time="ts", gap="1 hour"), "sessions")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS before_event_id FROM events p JOIN events v ON v.user_id = p.user_id
  AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL '6 hours' WHERE p.event_type = 'purchase' AND v.event_type = 'view'""")
def streamed_views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user in the six hours before each of the user's purchases, as a join of two streams."""
    events = lambda kind: stream_of(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("event_id", "ts", "user_id")
    pairs = interval_joined(events("purchase"), events("view"), key="user_id", time="ts", seconds=6 * 3600)
    return drained(pairs.select("event_id", "user_id", "before_event_id"), "pairs")


@query("""
WITH l AS (SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n_users FROM events GROUP BY ROLLUP (event_type, day))
SELECT event_type, day, n_users, TRUE AS close FROM l""")
def sketched_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each type and day, each type, and all: exactly, and whether merged sketches are within 3 % (or 1 user)."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), "user_id")
    exact = events.rollup("event_type", "day").agg(F.countDistinct("user_id").alias("n_users"))
    found = sketches.levels(sketches.distinct_sketches(events, by=["event_type", "day"], of="user_id"), by=["event_type", "day"], name="estimate")
    found = found.select(F.col("event_type").alias("_type"), F.col("day").alias("_day"), "estimate")
    both = exact.join(found, F.col("event_type").eqNullSafe(F.col("_type")) & F.col("day").eqNullSafe(F.col("_day")))
    return both.select("event_type", "day", "n_users", (F.abs(F.col("estimate") - F.col("n_users")) <= F.greatest(F.lit(1.0), 0.03 * F.col("n_users"))).alias("close"))


@query("""
WITH s AS (SELECT user_id, event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY ALL)
SELECT user_id, count(*) AS n_types, string_agg(event_type, ',' ORDER BY event_type) AS types, max(CASE WHEN event_type = 'purchase' THEN k END) AS purchase_k, CAST(sum(k) AS BIGINT) AS all_k FROM s GROUP BY ALL""")
def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed properties of the events, summed in a map by type for each user."""
    events, _ = parsed(table(spark, sf_dir, "events").select("user_id", "event_type", "props"), "props", "k INT")
    maps = map_sums(events.withColumn("k", F.col("props.k")), by=["user_id"], entry="event_type", value="k", name="of")
    total = F.aggregate(F.map_values("of"), F.lit(0).cast("long"), lambda a, x: a + x)
    return maps.select("user_id", F.size("of").cast("long").alias("n_types"), F.array_join(F.map_keys("of"), ",").alias("types"), F.try_element_at("of", F.lit("purchase")).alias("purchase_k"), total.alias("all_k"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, user_id, value FROM events")
def daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written by day, and one type's days written once more, as after a failure."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"), "user_id", "value")
    path = new_path(spark, "daily")
    write_partitions(events, path, ["day"])
    write_partitions(events.filter(F.dayofmonth("day") <= 3), path, ["day"])
    return spark.read.schema(events.schema).parquet(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
