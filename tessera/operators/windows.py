"""Window analytics: ranks, frames, fills, sessions, top-n; and sorting, limits and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.catalog import Tables, query


def qualify(df: DataFrame, condition: Column | str, **windows: Column) -> DataFrame:
    """Rows where ``condition`` holds over the named window results, which are then dropped."""
    return df.withColumns(windows).where(condition).drop(*windows)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the limit is applied before the shuffle too (window group limit)."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return qualify(df, "__nth = 1", __nth=F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def sessions(df: DataFrame, user: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """Adds session: 1, 2, ... per user, a new one after a gap of more than ``gap_seconds``, fractions counted; rows without a time come last, each a session."""
    w = W.partitionBy(user).orderBy(F.asc_nulls_last(ts), F.asc_nulls_last(tie))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    begins = F.when(gap <= gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("__new", begins).withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def _nation(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal")


_W = "OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"


def _w() -> W:
    return W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS rk,
CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS dr FROM part""")
def win_rank(t: Tables) -> DataFrame:
    w = W.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))


@query(f"SELECT c_custkey, CAST(ntile(4) {_W} AS INTEGER) AS q, percent_rank() {_W} AS pr, cume_dist() {_W} AS cd FROM customer")
def win_dist(t: Tables) -> DataFrame:
    return _nation(t).select("c_custkey", F.ntile(4).over(_w()).alias("q"), F.percent_rank().over(_w()).alias("pr"), F.cume_dist().over(_w()).alias("cd"))


@query(f"SELECT c_custkey, lag(c_acctbal) {_W} AS before, lead(c_acctbal, 2, 0) {_W} AS after FROM customer")
def win_lag_lead(t: Tables) -> DataFrame:
    return _nation(t).select("c_custkey", F.lag("c_acctbal").over(_w()).alias("before"), F.lead("c_acctbal", 2, 0.0).over(_w()).alias("after"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), 3) AS moving FROM orders")
def win_moving(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return t.orders.select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 3).alias("moving"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM part")
def win_range(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.count("*").over(W.partitionBy("p_brand").orderBy("p_size").rangeBetween(-1, 1)).alias("near"))


@query(f"""SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS richest,
last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS poorest FROM customer""")
def win_first_last(t: Tables) -> DataFrame:
    w = _w().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return _nation(t).select("c_custkey", F.first("c_custkey").over(w).alias("richest"), F.last("c_custkey").over(w).alias("poorest"))


@query("SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 5) AS share, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 3) AS off FROM customer")
def win_share(t: Tables) -> DataFrame:
    w = W.partitionBy("c_nationkey")
    b = F.col("c_acctbal")
    return _nation(t).select("c_custkey", F.round(b / F.sum(b).over(w), 5).alias("share"), F.round(b - F.avg(b).over(w), 3).alias("off"))


@query("""WITH q AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL)
SELECT p, y, q, v, lag(v, 4) OVER (PARTITION BY p ORDER BY y, q) AS year_before FROM q""")
def win_yoy(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    by = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.year(d).alias("y"), F.quarter(d).alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return by.withColumn("year_before", F.lag("v", 4).over(W.partitionBy("p").orderBy("y", "q")))


@query("SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def dedup_latest(t: Tables) -> DataFrame:
    return latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""SELECT event_id, user_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
SELECT *, CASE WHEN epoch(ts) // 1 - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1 <= 1800 THEN 0 ELSE 1 END AS b FROM events)""")
def win_sessionize(t: Tables) -> DataFrame:
    return sessions(t.events, "user_id", "ts", 1800, "event_id").select("event_id", "user_id", "session")


@query("""SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3""")
def topn_group(t: Tables) -> DataFrame:
    best = top_n(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return best.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "place")


_FILL = "(SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)"


def _gaps(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))


@query(f"""SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f,
first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {_FILL}""")
def win_ffill(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _gaps(t).select("event_id", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("f"), F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("b"))


@query(f"""SELECT event_id, coalesce(v, (lag(v) OVER w + lead(v) OVER w) / 2) AS v FROM {_FILL} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_interp(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _gaps(t).select("event_id", F.coalesce("v", (F.lag("v").over(w) + F.lead("v").over(w)) / 2).alias("v"))


@query("""SELECT conv_id, turn, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS 2 PRECEDING) AS last_roles FROM conversations""")
def win_collect(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.slice(F.collect_list("role").over(w), F.greatest(F.size(F.collect_list("role").over(w)) - 2, F.lit(1)), 3).alias("last_roles"))


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 2")
def sql_qualify(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return qualify(t.orders, "place = 2", place=F.rank().over(w)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY place LIMIT 100")
def sort_multi(t: Tables) -> DataFrame:
    first = t.orders.orderBy(F.asc("o_orderstatus"), F.desc("o_totalprice"), F.asc("o_orderkey")).limit(100)
    w = W.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")  # over the hundred rows of the limit
    return first.select("o_orderkey", F.row_number().over(w).alias("place"))


@query("""SELECT * FROM (SELECT 'asc' AS kind, doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 20) UNION ALL
SELECT * FROM (SELECT 'asc_last', doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 20) UNION ALL
SELECT * FROM (SELECT 'desc', doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 20) UNION ALL
SELECT * FROM (SELECT 'desc_first', doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 20)""")
def sort_nulls(t: Tables) -> DataFrame:
    full = t.documents.join(t.labels, "doc_id", "left")
    orders = {"asc": F.asc("quality"), "asc_last": F.asc_nulls_last("quality"), "desc": F.desc("quality"), "desc_first": F.desc_nulls_first("quality")}
    parts = [full.orderBy(o, "doc_id").limit(20).select(F.lit(k).alias("kind"), "doc_id") for k, o in orders.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, length(o_orderpriority) DESC, o_orderkey LIMIT 50")
def sort_custom(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.orderBy(F.when(s == "P", 1).when(s == "O", 2).otherwise(3), F.desc(F.length("o_orderpriority")), "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def topk(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def sort_offset(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_totalprice", "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_totalprice")
