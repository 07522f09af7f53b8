"""Joins of every kind, with range, salted, as-of and cogrouped forms."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.catalog import Tables, query


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with ``low <= point < high``, by an equi-join on buckets of ``width``; intervals are listed in each bucket they touch.

    Empty intervals and nulls meet nothing. ``width`` near the median interval keeps both sides small.
    """
    listed = right.where(F.col(low) < F.col(high)).withColumn(
        "__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    )
    dealt = left.withColumn("__bucket", F.floor(F.col(point) / width))
    return dealt.join(listed, "__bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bucket")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which every key of ``right`` is listed under each salt and rows of ``left`` are spread over them.

    Rows of ``right`` are listed several times, so joins that keep its unmatched rows are made in two
    parts: the salted one for rows that match, and an anti join for those that do not.
    """
    if how in ("right", "rightouter", "right_outer", "full", "outer", "fullouter", "full_outer"):
        met = salted_join(left, right, key, salts, "inner" if how.startswith("right") else "left")
        lone = right.join(left.select(key).distinct(), key, "left_anti")
        return met.unionByName(lone, allowMissingColumns=True).select(*met.columns)
    spread = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    listed = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(listed, [key, "__salt"], how).drop("__salt")


def as_of(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each row of ``left`` the ``values`` of the latest row of ``right`` at or before it, by union and one window.

    Null keys match nothing, as in an equi-join; rows of ``right`` with one are left out.
    """
    for k in by:
        right = right.where(F.col(k).isNotNull())
    a = left.withColumns({"__side": F.lit(1), **{v: F.lit(None).cast(right.schema[v].dataType) for v in values}})
    b = right.select(*by, on, *values).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = W.partitionBy(*by).orderBy(on, "__side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumns({v: F.last(F.when(F.col("__side") == 0, F.col(v)), True).over(upto) for v in values})
    return filled.where("__side = 1").drop("__side")


def safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", unique: bool = True, account: Observation | None = None) -> DataFrame:
    """Join with a row account in one pass; with ``unique`` a key repeated in ``right`` fails the query.

    ``account`` gives rows_out after an action.
    """
    if unique:
        n = F.count("*").over(W.partitionBy(*on))
        right = right.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate join key"))).otherwise(True)).drop("__n")
    joined = left.join(right, list(on), how)
    return joined.observe(account, F.count("*").alias("rows_out")) if account else joined


def _named(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return _named(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner"), "o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(t: Tables) -> DataFrame:
    return _named(t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left"), "c_custkey", "o_orderkey")


@query("SELECT l.doc_id, d.lang, l.quality FROM documents d RIGHT JOIN labels l ON d.doc_id = l.doc_id")
def join_right(t: Tables) -> DataFrame:
    d, la = t.documents.alias("d"), t.labels.alias("l")
    return _named(d.join(la, F.col("d.doc_id") == F.col("l.doc_id"), "right"), "l.doc_id", "d.lang", "l.quality")


@query("""SELECT k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_nationkey < 20 GROUP BY 1)
FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_nationkey > 4 GROUP BY 1) USING (k)""")
def join_full(t: Tables) -> DataFrame:
    a = t.customer.where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    b = t.supplier.where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def join_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 150000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))  # 5 x 25 rows: the calendar-scaffold form


@query("""SELECT a.l_partkey, a.l_suppkey, a.q, b.n FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a
JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def join_multi(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    b = t.lineitem.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return a.join(b, ["l_partkey", "l_suppkey"])


_BANDS = [(0, 15, "small"), (15, 35, "medium"), (35, 100, "large")]


@query("""SELECT p_partkey, band FROM part JOIN (VALUES (0, 15, 'small'), (15, 35, 'medium'), (35, 100, 'large')) b(lo, hi, band) ON p_size >= lo AND p_size < hi""")
def join_range(t: Tables) -> DataFrame:
    bands = t.spark.createDataFrame(_BANDS, "lo int, hi int, band string")
    return range_join(t.part, bands, "p_size", "lo", "hi", 20).select("p_partkey", "band")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    met = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")))
    return met.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("""SELECT a.k, a.n, b.m FROM (SELECT quality AS k, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) a
JOIN (SELECT toxic AS k, count(*) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_nullsafe(t: Tables) -> DataFrame:
    full = t.documents.join(t.labels, "doc_id", "left")
    a = full.groupBy(F.col("quality").alias("k")).agg(F.count("*").alias("n"))
    b = full.groupBy(F.col("toxic").alias("j")).agg(F.count("*").alias("m"))
    return a.join(b, F.col("k").eqNullSafe(F.col("j"))).select("k", "n", "m")


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(t: Tables) -> DataFrame:
    # nation has 25 rows by definition; supplier is left to the optimizer, which broadcasts below its size threshold only
    met = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "n_name")


def _sides(t: Tables) -> tuple[DataFrame, DataFrame, Column]:
    return t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_merge_hint(t: Tables) -> DataFrame:
    a, b, on = _sides(t)
    return a.join(b.hint("merge"), on).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_shuffle_hash_hint(t: Tables) -> DataFrame:
    a, b, on = _sides(t)
    return a.join(b.hint("shuffle_hash"), on).select("o_orderkey", "c_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey >= r_regionkey")
def join_nested_loop_hint(t: Tables) -> DataFrame:
    return t.nation.join(t.region.hint("shuffle_replicate_nl"), F.col("n_regionkey") >= F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def join_salted(t: Tables) -> DataFrame:
    right = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    return salted_join(t.orders, right, "o_custkey", 8).groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, p.value AS last_purchase FROM events e LEFT JOIN LATERAL (
SELECT value, event_id FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts ORDER BY p.ts DESC, p.value DESC LIMIT 1) p ON true WHERE e.event_type = 'click'""")
def join_asof(t: Tables) -> DataFrame:
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return as_of(clicks, bought, "ts", ["user_id"], ["last_purchase"]).select("event_id", "last_purchase")


@query("""SELECT k AS nation, coalesce(a, 0) AS customers, coalesce(b, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1)
FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) USING (k)""")
def join_cogroup(t: Tables) -> DataFrame:
    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nation": [key[0]], "customers": [int(a["n"].sum())], "suppliers": [int(b["n"].sum())]})

    # counted before the cogroup, so that no group is larger than one row a side
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(both, "nation int, customers long, suppliers long")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def join_safe(t: Tables) -> DataFrame:
    right = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return safe_join(t.lineitem, right, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_name")
