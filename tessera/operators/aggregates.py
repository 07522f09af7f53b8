"""Grouped, global, multi-level and approximate aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import Tables, query


def salted_sum(df: DataFrame, key: str, value: Column, name: str, salts: int = 16) -> DataFrame:
    """Sum by key in two phases, the first over (key, salt).

    Built-in sums combine before their shuffle already; this form serves
    aggregates that do not, such as long collected lists.
    """
    first = df.groupBy(key, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt")).agg(F.sum(value).alias("part"))
    return first.groupBy(key).agg(F.sum("part").alias(name))


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """(bucket, low, high, n) over right-open buckets between ``edges``, the last one closed; others are left out."""
    c = F.col(column)
    last = len(edges) - 2
    bucket = F.coalesce(*[
        F.when((c >= a) & ((c < b) | ((c == b) & F.lit(i == last))), F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])
    counted = df.select(bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))
    ends = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bucket int, low double, high double")
    return ends.join(counted, "bucket", "left").fillna(0, ["n"])


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS base, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi,
count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_basic(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("base"), F.round(F.avg("l_discount"), 6).alias("disc"),
        F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.count("*").alias("n"),
    )


@query("SELECT count(*) AS n, round(sum(o_totalprice), 1) AS total, round(avg(o_totalprice), 3) AS mean, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def agg_global(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.agg(F.count("*").alias("n"), F.round(F.sum(p), 1).alias("total"), F.round(F.avg(p), 3).alias("mean"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT lang, count(*) AS n, count(quality) AS known, CAST(sum(quality) AS BIGINT) AS good, round(avg(quality), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_nulls(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n"), F.count("quality").alias("known"), F.sum("quality").alias("good"), F.round(F.avg("quality"), 6).alias("share")
    )


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"))


@query()
def agg_approx_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.05).alias("parts"))


@query("""SELECT c_nationkey, list_sort(list(c_mktsegment)) AS all_segments, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY 1""")
def agg_collect(t: Tables) -> DataFrame:
    some = t.customer.groupBy("c_nationkey")
    return some.agg(F.sort_array(F.collect_list("c_mktsegment")).alias("all_segments"), F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def agg_first_last(t: Tables) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("first_order"), F.max_by("o_orderkey", order).alias("last_order"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS va FROM lineitem GROUP BY 1")
def agg_stddev(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev(q), 6).alias("sd"), F.round(F.stddev_pop(q), 6).alias("sdp"), F.round(F.variance(q), 5).alias("va"))


@query("""SELECT l_returnflag, round((avg(power(x, 3)) - 3 * avg(x) * avg(x * x) + 2 * power(avg(x), 3)) / power(var_pop(x), 1.5), 4) AS skew, round(kurtosis_pop(x), 4) AS kurt
FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY 1""")
def agg_skew(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.skewness("l_quantity"), 4).alias("skew"), F.round(F.kurtosis("l_quantity"), 4).alias("kurt"))


@query("SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 1) AS cs, round(covar_pop(l_quantity, l_extendedprice), 1) AS cp FROM lineitem GROUP BY 1")
def agg_corr(t: Tables) -> DataFrame:
    a, b = "l_quantity", "l_extendedprice"
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.corr(a, b), 6).alias("r"), F.round(F.covar_samp(a, b), 1).alias("cs"), F.round(F.covar_pop(a, b), 1).alias("cp"))


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def agg_percentile(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("med"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query()
def agg_percentile_approx(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", [0.25, 0.5, 0.75]).alias("quartiles"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS open_value,
round(avg(o_totalprice) FILTER (o_totalprice > 100000), 1) AS big FROM orders GROUP BY 1""")
def agg_conditional(t: Tables) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(
        F.count(F.when(s == "F", 1)).alias("done"), F.round(F.sum(F.when(s == "O", p).otherwise(0)), 2).alias("open_value"), F.round(F.avg(F.when(p > 100000, p)), 1).alias("big")
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS TINYINT) AS g, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def agg_grouping_id(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").alias("g"), F.grouping_id().alias("gid"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def agg_grouping_sets(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {l} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", l=t.lineitem)


@query("""SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS "F_qty", count(*) FILTER (l_linestatus = 'F') AS "F_n", sum(l_quantity) FILTER (l_linestatus = 'O') AS "O_qty",
count(*) FILTER (l_linestatus = 'O') AS "O_n" FROM lineitem GROUP BY 1""")
def agg_pivot(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity").alias("qty"), F.count("l_quantity").alias("n"))
    return wide.fillna(0, ["F_n", "O_n"])


@query("""SELECT o_orderstatus AS "o_orderstatus_o_orderpriority", count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH",
count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-MEDIUM", count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY 1""")
def agg_crosstab(t: Tables) -> DataFrame:
    return t.orders.crosstab("o_orderstatus", "o_orderpriority")


@query()
def agg_freq_items(t: Tables) -> DataFrame:
    return t.orders.stat.freqItems(["o_orderstatus", "o_orderpriority"], 0.2)


@query("""SELECT s AS summary, v AS o_totalprice FROM (SELECT count(*) n, avg(o_totalprice) m, stddev_samp(o_totalprice) d, min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
LATERAL (VALUES ('count', n), ('mean', round(m, 4)), ('stddev', round(d, 4)), ('min', lo), ('max', hi)) x(s, v)""")
def agg_describe(t: Tables) -> DataFrame:
    return t.orders.describe("o_totalprice").select("summary", F.when(F.col("summary").isin("mean", "stddev"), F.round(F.col("o_totalprice").cast("double"), 4)).otherwise(F.col("o_totalprice").cast("double")).alias("o_totalprice"))


@query("""SELECT CAST(b AS INTEGER) AS bucket, CAST(b * 10000 AS DOUBLE) AS low, CAST((b + 1) * 10000 AS DOUBLE) AS high, (SELECT count(*) FROM orders WHERE o_totalprice >= b * 10000 AND o_totalprice < (b + 1) * 10000) AS n
FROM range(0, 20) r(b)""")
def agg_histogram(t: Tables) -> DataFrame:
    return histogram(t.orders, "o_totalprice", [10000.0 * k for k in range(21)])


@query("""WITH a AS (SELECT n_name, r_name, sum(s_acctbal) AS b, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT 'nation' AS level, n_name AS name, round(b, 2) AS balance, n FROM a UNION ALL SELECT 'region', r_name, round(sum(b), 2), CAST(sum(n) AS BIGINT) FROM a GROUP BY r_name
UNION ALL SELECT 'total', NULL, round(sum(b), 2), CAST(sum(n) AS BIGINT) FROM a""")
def agg_multilevel(t: Tables) -> DataFrame:
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    levels = named.rollup("r_name", "n_name").agg(F.round(F.sum("s_acctbal"), 2).alias("balance"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "nation").when(F.col("gid") == 1, "region").otherwise("total")
    return levels.select(level.alias("level"), F.when(F.col("gid") == 0, F.col("n_name")).otherwise(F.col("r_name")).alias("name"), "balance", "n")


@query("SELECT user_id, round(sum(value), 3) AS total FROM events GROUP BY 1")
def agg_salted(t: Tables) -> DataFrame:
    return salted_sum(t.events, "user_id", F.col("value"), "total").withColumn("total", F.round("total", 3))
