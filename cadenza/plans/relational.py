"""Relational queries over the star schema and events: Spark's own operators and two join patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import aggregates
from cadenza.operators import relational
from cadenza.plans.inputs import table
from cadenza.plans.registry import query


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )


@query("""SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation has 25 rows by the schema, so it is broadcast; the big sides shuffle on their keys."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(big, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nationkey, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN s ON c.k = s.k""")
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "full").na.fill(0, ["customers", "suppliers"])


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS at FROM events)
SELECT a.event_id, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.at - b.at) <= 3600 AND a.event_id <> b.event_id GROUP BY a.event_id""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events of the same user within an hour."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"))
    other = e.select(F.col("event_id").alias("other"), "user_id", F.col("at").alias("other_at"))
    pairs = relational.interval_join(e, other, ["user_id"], F.col("at"), F.col("other_at"), 3600)
    return pairs.where("event_id <> other").groupBy("event_id").agg(F.count("*").alias("n"))


@query("""SELECT a.event_id, p.event_id AS last_purchase_id, round(p.value, 6) AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') a
LEFT JOIN LATERAL (SELECT event_id, value FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) ORDER BY ts DESC, event_id DESC LIMIT 1) p ON true""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last purchase before it."""
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.col("event_id").alias("purchase_id"), "value")
    out = relational.as_of(clicks, bought, "user_id", "ts", "event_id", ["purchase_id", "value"])
    return out.select("event_id", "last_purchase_id", F.round("last_value", 6).alias("last_value"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, round(median(l_quantity), 4) AS median_qty FROM lineitem GROUP BY 1""")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities are whole numbers of 1 to 50 by the schema, so the median's counts are few."""
    of = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    distinct = of.agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))
    return relational.beside("l_returnflag", distinct, of.agg(F.round(F.median("l_quantity"), 4).alias("median_qty")))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, round(percent_rank() OVER w, 6) AS pr, CAST(ntile(4) OVER w AS INTEGER) AS nt,
round(lag(o_totalprice) OVER w, 2) AS prev, round(lead(o_totalprice) OVER w, 2) AS next, round(first_value(o_totalprice) OVER w, 2) AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def window_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    price = lambda c: F.round(c.over(w), 2)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.ntile(4).over(w).alias("nt"),
        price(F.lag("o_totalprice")).alias("prev"), price(F.lead("o_totalprice")).alias("next"), price(F.first("o_totalprice")).alias("top"),
    )


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS hour_n,
round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS near FROM e""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    by = W.partitionBy("user_id")
    return e.select("event_id", F.count("*").over(by.orderBy("us").rangeBetween(-3_600_000_000, 0)).alias("hour_n"), F.round(F.avg("value").over(by.orderBy("us", "event_id").rowsBetween(-3, 1)), 6).alias("near"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(10).limit(50).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("""SELECT * FROM ((SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
UNION ALL (SELECT n_nationkey, 'no supplier' FROM nation EXCEPT SELECT s_nationkey, 'no supplier' FROM supplier))""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("k"))
    supplied = keys("supplier", "s_nationkey")
    both = keys("customer", "c_nationkey").intersect(supplied).withColumn("kind", F.lit("both"))
    return both.unionByName(keys("nation", "n_nationkey").exceptAll(supplied.distinct()).withColumn("kind", F.lit("no supplier")))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides sorted on the key and merged: neither needs to fit in memory."""
    return _lines_of_orders(spark, sf_dir, "merge")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_shuffle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides shuffled on the key, the smaller hashed in each task."""
    return _lines_of_orders(spark, sf_dir, "shuffle_hash")


def _lines_of_orders(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").join(orders.hint(strategy), "l_orderkey")
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_nationkey > r_regionkey AND n_regionkey <> r_regionkey GROUP BY 1")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No equality to shuffle on: a nested loop over the broadcast region, which has five rows by the schema."""
    pairs = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), (F.col("n_nationkey") > F.col("r_regionkey")) & (F.col("n_regionkey") != F.col("r_regionkey")))
    return pairs.groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT a.r_name AS here, b.r_name AS there FROM region a CROSS JOIN region b")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region with every region: 25 rows by the schema."""
    region = table(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("here")).crossJoin(F.broadcast(region.select(F.col("r_name").alias("there"))))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    of = table(spark, sf_dir, "lineitem").groupingSets([[flag], [status], []], flag, status)
    return of.agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("tax"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near_parts, true AS near_median FROM lineitem GROUP BY 1")
def agg_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against the exact answers: distinct parts within 5 %, the median's rank within 1 %.

    The rank of the sketch's median is counted in a pass of its own, so that no task holds all prices. Flags are
    three by the schema, so their sketches are broadcast.
    """
    price, middle = F.col("l_extendedprice"), F.col("middle")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", price)
    sketches = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.approx_count_distinct("l_partkey", 0.01).alias("sketch"), F.percentile_approx(price, 0.5, 10_000).alias("middle"))
    ranks = lines.join(F.broadcast(sketches), F.col("l_returnflag").eqNullSafe(F.col("flag"))).groupBy("l_returnflag", "sketch").agg(
        F.count(price).alias("n"), F.count_if(price < middle).alias("below"), F.count_if(price <= middle).alias("up_to")
    )
    of = relational.beside("l_returnflag", lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts")), ranks)
    near = (F.col("below") <= 0.51 * F.col("n")) & (F.col("up_to") >= 0.49 * F.col("n"))
    return of.select("l_returnflag", "parts", (F.abs(F.col("sketch") - F.col("parts")) <= 0.05 * F.col("parts")).alias("near_parts"), near.alias("near_median"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS middle FROM lineitem GROUP BY 1")
def agg_user_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped aggregate of one's own: the geometric mean."""
    return aggregates.geometric_mean(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity")).withColumn("middle", F.round("middle", 6))


@query("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word FROM (SELECT p_partkey, regexp_extract_all(p_name, '\\S+') AS w FROM part), range(1, 20) t(i) WHERE i <= len(w)")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of one's own, laterally: the words of parts' names."""
    return table(spark, sf_dir, "part").lateralJoin(aggregates.Words(F.col("p_name").outer())).select("p_partkey", "pos", "word")


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, CAST(sum(n) AS BIGINT) AS total, coalesce(max(n) FILTER (WHERE event_type = 'click'), 0) AS clicks, count(*) FILTER (WHERE n >= 10) AS often FROM k GROUP BY user_id""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each user, of kinds of events to their number."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    often = F.size(F.map_filter("m", lambda k, v: v >= 10)).cast("long")
    return m.select("user_id", F.array_join(F.map_keys("m"), ",").alias("kinds"), total.alias("total"), F.coalesce(F.col("m")["click"], F.lit(0)).alias("clicks"), often.alias("often"))


@query("""SELECT o_orderkey, round(nth_value(o_totalprice, 2) OVER w, 2) AS second, round(last_value(o_totalprice) OVER w, 2) AS last, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 6) AS share
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(F.nth_value("o_totalprice", 2).over(whole), 2).alias("second"), F.round(F.last("o_totalprice").over(whole), 2).alias("last"),
        F.round(F.cume_dist().over(W.partitionBy("o_custkey").orderBy("o_totalprice")), 6).alias("share"),
    )


@query("""SELECT * FROM ((SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT ALL SELECT s_nationkey, 'both' FROM supplier)
UNION ALL (SELECT c_nationkey, 'more customers' FROM customer EXCEPT ALL SELECT s_nationkey, 'more customers' FROM supplier))""")
def multiset_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bags: repeats count."""
    keys = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("k"))
    c, s = keys("customer", "c_nationkey"), keys("supplier", "s_nationkey")
    return c.intersectAll(s).withColumn("kind", F.lit("both")).unionByName(c.exceptAll(s).withColumn("kind", F.lit("more customers")))


@query("SELECT o_orderkey FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) IN ('0', '1')")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of an eighth, by a hash of the key: the same rows on every run and machine."""
    return table(spark, sf_dir, "orders").select("o_orderkey").where(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 1).isin("0", "1"))


@query("""WITH g AS (SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", "total")


@query("""WITH b AS (SELECT *, unnest([0, 1]) AS s FROM events)
SELECT date_trunc('hour', ts) - s * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM b GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours, an hour apart."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, upper(event_type) AS kind, date_trunc('day', ts) AS day, CAST(year(ts) AS INTEGER) AS y, regexp_extract(props, '([0-9]+)', 1) AS digits,
length(props) AS n, round(sqrt(abs(value)), 6) AS root FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.upper("event_type").alias("kind"), day.alias("day"), F.year("ts").alias("y"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("digits"), F.length("props").cast("long").alias("n"), F.round(F.sqrt(F.abs("value")), 6).alias("root"),
    )


@query("""SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest order of each customer: one aggregate, no window."""
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    top = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(best.alias("o_orderkey"), F.round(F.max("o_totalprice"), 2).alias("price"))
    return top.join(table(spark, sf_dir, "customer"), "c_custkey", "left_semi")
