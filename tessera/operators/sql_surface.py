"""The SQL surface: the same engine reached through Spark SQL text."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from itertools import pairwise

from pyspark.sql import DataFrame

from tessera.operators.catalog import ORACLES, QUERIES, Tables, query

#: SQL texts that Spark and DuckDB both read; ``{name}`` stands for a driver table.
_SHARED = {
    "sql_exists": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "sql_not_exists": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "sql_in_subquery": "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)",
    "sql_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders})",
    "sql_correlated": "SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)",
    "sql_cte": "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey), top AS (SELECT o_custkey FROM spend WHERE s > 1500000) SELECT c.c_custkey, c.c_mktsegment FROM {customer} c JOIN top ON c.c_custkey = top.o_custkey",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 14",
    "sql_window": "SELECT s_suppkey, s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS step FROM {supplier}",
    "sql_case": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind FROM {part}",
    "sql_values": "SELECT v.k, v.name, r_name FROM (VALUES (0, 'zero'), (1, 'one'), (9, 'nine')) AS v(k, name) LEFT JOIN {region} ON v.k = r_regionkey",
    "sql_recursive": "WITH RECURSIVE days(d, n) AS (SELECT DATE '1995-01-01', 1 UNION ALL SELECT CAST(d + INTERVAL 1 DAY AS DATE), n + 1 FROM days WHERE n < 60) SELECT d, (SELECT count(*) FROM {orders} WHERE CAST(o_orderdate AS DATE) = d) AS orders FROM days",
    "sql_lateral": "SELECT n_name, x.s_name FROM {nation} n, LATERAL (SELECT s_name FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) x",
    "sql_set_ops": "SELECT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} UNION SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1",
}


def _register(name: str, text: str) -> None:
    tables = "region nation customer supplier part orders lineitem".split()

    def run(spark, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return spark.sql(text, **{n: getattr(t, n) for n in tables if f"{{{n}}}" in text})

    QUERIES[name] = run
    ORACLES[name] = text.format(**{n: n for n in tables})


for _name, _text in _SHARED.items():
    _register(_name, _text)


@query("SELECT o_orderkey, trim(w) AS word FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders)")
def sql_lateral_view(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderkey, trim(w) AS word FROM {o} LATERAL VIEW explode(split(o_orderpriority, '-')) x AS w", o=t.orders)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY 1")
def sql_pivot(t: Tables) -> DataFrame:
    wide = t.spark.sql("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {o}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F', 'O'))", o=t.orders)
    return wide.fillna(0, ["F", "O"])


@query("SELECT p_partkey, k AS name, v AS value FROM part, LATERAL (VALUES ('p_brand', p_brand), ('p_type', p_type)) x(k, v)")
def sql_unpivot(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT p_partkey, name, value FROM {p} UNPIVOT (value FOR name IN (p_brand, p_type))", p=t.part)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 4000")
def sql_params(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT c_custkey FROM {c} WHERE c_mktsegment = :segment AND c_acctbal > :least", {"segment": "BUILDING", "least": 4000}, c=t.customer)


@query("SELECT 2 AS tables, true AS described, true AS shown, count(*) AS rows, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM customer WHERE c_acctbal > 0")
def sql_ddl(t: Tables) -> DataFrame:
    """CREATE DATABASE, USE, CTAS, INSERT, DESCRIBE, SHOW, TRUNCATE and DROP, in a database of its own."""
    spark, name, before = t.spark, f"tessera_{uuid.uuid4().hex[:12]}", t.spark.catalog.currentDatabase()
    run = lambda text, **frames: spark.sql(text, **frames)
    run(f"CREATE DATABASE {name} COMMENT 'a test'")
    try:
        run(f"USE {name}")
        run("CREATE TABLE rich USING parquet AS SELECT c_custkey, c_nationkey FROM {c} WHERE c_acctbal > 0", c=t.customer)
        run("CREATE TABLE other (k BIGINT COMMENT 'key') USING parquet")
        run("INSERT INTO other SELECT c_custkey FROM rich")
        run("TRUNCATE TABLE other")
        tables = run("SHOW TABLES").count()
        described = {r.col_name for r in run("DESCRIBE TABLE rich").collect()} >= {"c_custkey", "c_nationkey"}
        shown = "parquet" in run("SHOW CREATE TABLE other").first()[0].lower() and run("SELECT * FROM other").isEmpty()
        shown = shown and name in [d.name for d in spark.catalog.listDatabases()] and {x.name for x in spark.catalog.listTables()} >= {"rich", "other"}
        rows, nations = run("SELECT count(*), sum(c_nationkey) FROM rich").first()
    finally:
        run(f"USE {before}")
        run(f"DROP DATABASE IF EXISTS {name} CASCADE")
    return spark.createDataFrame([(tables, described, shown, rows, nations)], "tables int, described boolean, shown boolean, rows long, nations long")


@query("SELECT 'first' AS action, min(o_orderkey) AS value FROM orders UNION ALL SELECT 'head', min(o_orderkey) FROM orders UNION ALL SELECT 'take', 3 UNION ALL SELECT 'tail', max(o_orderkey) FROM orders UNION ALL SELECT 'iterated', count(*) FROM orders UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'top', max(o_orderkey) FROM orders UNION ALL SELECT 'glom', 4 UNION ALL SELECT 'sorted', 1")
def actions(t: Tables) -> DataFrame:
    """The actions that hand rows to the driver, each bounded or streamed, and sorted partitions."""
    keys = t.orders.select("o_orderkey").orderBy("o_orderkey")
    parts = t.orders.select("o_orderkey").repartition(4).sortWithinPartitions("o_orderkey")
    ordered = parts.rdd.mapPartitions(lambda rows: [_ascending(r.o_orderkey for r in rows)]).min()
    found = {
        "first": keys.first()[0], "head": keys.head(1)[0][0], "take": len(keys.take(3)), "tail": keys.tail(1)[0][0], "iterated": sum(1 for _ in keys.toLocalIterator()), "empty": int(keys.isEmpty()),
        "top": t.orders.select("o_orderkey").rdd.map(lambda r: r[0]).top(1)[0], "glom": parts.rdd.getNumPartitions(), "sorted": ordered,
    }
    return t.spark.createDataFrame(list(found.items()), "action string, value long")


def _ascending(values: Iterable[int]) -> int:
    return int(all(a <= b for a, b in pairwise(values)))
