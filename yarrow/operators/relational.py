"""The relational forms the operators are made of, on the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import table


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, value: str) -> DataFrame:
    """The last right value at or before each left row: one union and one window with last(ignorenulls), no range join."""
    a = left.withColumns({"_side": F.lit(1), "_t": F.col(at), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, F.col(other_at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side", "_t", "_v")


def r1_pricing(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def r2_revenue_by_nation(spark, d):
    """Five joins; the planner broadcasts by size and orders them."""
    t = lambda n: table(spark, d, n)
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def r3_grouping_sets(spark, d):
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def r4_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def r5_rollup(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


def r6_semi(spark, d):
    late = table(spark, d, "lineitem").where("l_discount > 0.05").select("l_orderkey")
    return table(spark, d, "orders").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def r7_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def r8_full_outer(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def r9_top_per_group(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("o_orderpriority", "o_orderkey", F.col("rn").cast("bigint").alias("rn"))


def r10_sessions(spark, d):
    """Sessions of a user's events, parted by gaps of over 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    gap = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > 1_800_000_000, F.lit(True))
    e = e.withColumn("s", F.sum(gap.cast("int")).over(w))
    return e.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def r11_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.count(F.lit(1))).na.fill(0).select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("3-MEDIUM").alias("medium"))


def r12_set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    label = lambda df, x: df.select("k", F.lit(x).alias("op"))
    return label(c.union(s).distinct(), "union").unionByName(label(c.intersect(s), "intersect")).unionByName(label(c.subtract(s), "except"))


def r13_moving(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("moving"))


def r14_asof(spark, d):
    """Each order with the price of the same customer's order before it."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    earlier = o.groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("price")).withColumn("next_day", F.expr("o_orderdate + INTERVAL 1 MICROSECOND"))
    return asof_join(o.select("o_custkey", "o_orderkey", "o_orderdate"), earlier.select("o_custkey", "next_day", "price"), "o_custkey", "o_orderdate", "next_day", "price").select("o_orderkey", F.round("price", 2).alias("price"))


def r15_event_windows(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (r1_pricing, r2_revenue_by_nation, r3_grouping_sets, r4_cube, r5_rollup, r6_semi, r7_anti, r8_full_outer, r9_top_per_group, r10_sessions, r11_pivot, r12_set_operations, r13_moving, r14_asof, r15_event_windows)}
SQL = {
    "r1_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_disc, count(*) n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "r2_revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "r3_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "r4_cube": "SELECT l_returnflag, l_linestatus, count(*) n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "r5_rollup": "SELECT p_brand, p_size, count(*) n FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "r6_semi": "SELECT o_orderpriority, count(*) n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05) GROUP BY 1",
    "r7_anti": "SELECT c_mktsegment, count(*) n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1",
    "r8_full_outer": "WITH c AS (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1), s AS (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) SELECT coalesce(c.k, s.k) nation, coalesce(c.n, 0) customers, coalesce(s.n, 0) suppliers FROM c FULL OUTER JOIN s ON c.k = s.k",
    "r9_top_per_group": "SELECT o_orderpriority, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn <= 5",
    "r10_sessions": "WITH g AS (SELECT user_id, event_id, ts, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, true) THEN 1 ELSE 0 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM g), n AS (SELECT user_id, s, count(*) n FROM s GROUP BY 1, 2) SELECT user_id, count(*) sessions, max(n) longest FROM n GROUP BY 1",
    "r11_pivot": "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') urgent, count(*) FILTER (o_orderpriority = '2-HIGH') high, count(*) FILTER (o_orderpriority = '3-MEDIUM') medium FROM orders GROUP BY 1",
    "r12_set_operations": "SELECT k, 'union' op FROM (SELECT c_nationkey k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'except' FROM (SELECT c_nationkey k FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "r13_moving": "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) moving FROM orders",
    "r14_asof": "WITH e AS (SELECT o_custkey, o_orderdate, max(o_totalprice) price FROM orders GROUP BY 1, 2) SELECT o.o_orderkey, round(e.price, 2) price FROM orders o ASOF LEFT JOIN e ON o.o_custkey = e.o_custkey AND o.o_orderdate > e.o_orderdate",
    "r15_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2",
}
