"""Projections, filters, predicates, sampling."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import Tables, query

_TESTS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)), "between": lambda c, v: c.between(*v),
    "like": lambda c, v: c.like(v), "rlike": lambda c, v: c.rlike(v), "null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "contains": lambda c, v: c.contains(v), "<=>": lambda c, v: c.eqNullSafe(v),
}


def where_all(rules: Iterable[tuple[str, str, Any]]) -> Column:
    """Conjunction of (column, operator, value) rules; no rules hold for every row."""
    return reduce(and_, (_TESTS[op](F.col(c), v) for c, op, v in rules), F.lit(True))


def columns_of(df: DataFrame, kinds: Iterable[str] = (), prefix: str = "") -> list[str]:
    """Names of columns of the given simple types (all if none) that begin with ``prefix``."""
    wanted = set(kinds)
    return [f.name for f in df.schema if f.name.startswith(prefix) and (not wanted or f.dataType.simpleString() in wanted)]


@query("SELECT c_custkey, c_name, c_mktsegment AS segment FROM customer")
def proj_select(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.col("c_name"), F.col("c_mktsegment").alias("segment"))


@query("""SELECT o_orderkey, upper(o_orderstatus) AS status, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
o_totalprice * 1.1 AS taxed FROM orders""")
def proj_expr(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey", "upper(o_orderstatus) AS status",
        "CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band",
        "o_totalprice * 1.1 AS taxed",
    )


@query("SELECT p_partkey, p_brand AS brand, p_size AS size, split_part(p_type, ' ', 1) AS kind, p_type AS type FROM part")
def proj_nested(t: Tables) -> DataFrame:
    nested = t.part.select(
        "p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("s"),
        F.split("p_type", " ").alias("a"), F.create_map(F.lit("type"), F.col("p_type")).alias("m"),
    )
    return nested.select("p_partkey", "s.brand", F.col("s").getField("size").alias("size"), F.col("a").getItem(0).alias("kind"), F.col("m").getItem("type").alias("type"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
l_quantity > 25 AS large FROM lineitem""")
def proj_withcolumns(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    more = {"net": net, "gross": net * (1 + F.col("l_tax")), "large": F.col("l_quantity") > 25}
    return t.lineitem.withColumns(more).select("l_orderkey", "l_linenumber", *more)


@query("""SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, CAST(trunc(c_acctbal) AS BIGINT) AS balance, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def proj_cast(t: Tables) -> DataFrame:
    return (
        t.customer.withColumnRenamed("c_name", "name").drop("c_mktsegment")
        .select(F.col("c_custkey").cast("int").alias("id"), "name", F.col("c_acctbal").cast("bigint").alias("balance"), F.col("c_nationkey").cast("string").alias("nation"))
    )


@query("""SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, p_size / 4 AS d, p_size % 7 AS e, round(p_retailprice + p_size * 2.5, 2) AS f FROM part""")
def proj_arith(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", (s + 1).alias("a"), (s - 3).alias("b"), (s * 2).alias("c"), (s / 4).alias("d"), (s % 7).alias("e"), F.round(F.col("p_retailprice") + s * F.lit(2.5).cast("double"), 2).alias("f"))


@query("SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS n, p_size << 2 AS l, p_size >> 1 AS r, bit_count(p_size) AS c, bin(p_size) AS b FROM part")
def scalar_bitwise(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select(
        "p_partkey", s.bitwiseAND(12).alias("a"), s.bitwiseOR(3).alias("o"), s.bitwiseXOR(5).alias("x"), F.bitwise_not(s).alias("n"),
        F.shiftleft(s, 2).alias("l"), F.shiftright(s, 1).alias("r"), F.bit_count(s).cast("tinyint").alias("c"), F.bin(s.cast("long")).alias("b"),
    )


@query("SELECT * FROM customer WHERE c_acctbal > 5000")
def filter_basic(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_acctbal") > 5000)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 OR l_discount > 0.08) AND NOT (l_returnflag = 'R')")
def filter_boolean(t: Tables) -> DataFrame:
    return t.lineitem.where(((F.col("l_quantity") > 40) | (F.col("l_discount") > 0.08)) & ~(F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IS NOT NULL")
def filter_in_between(t: Tables) -> DataFrame:
    return t.orders.where(where_all([("o_orderstatus", "in", ["F", "P"]), ("o_totalprice", "between", (1000, 50000)), ("o_orderpriority", "null", False)])).select("o_orderkey")


@query("""SELECT p_partkey, contains(p_name, 'a') AS has, starts_with(p_brand, 'Brand#1') AS begins, suffix(p_type, 'L') AS ends, p_type LIKE '%A%' AS alike, regexp_matches(p_brand, '#[1-3]') AS matches
FROM part WHERE p_brand LIKE 'Brand%'""")
def filter_like(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_brand").like("Brand%")).select(
        "p_partkey", F.col("p_name").contains("a").alias("has"), F.col("p_brand").startswith("Brand#1").alias("begins"),
        F.col("p_type").endswith("L").alias("ends"), F.col("p_type").like("%A%").alias("alike"), F.col("p_brand").rlike("#[1-3]").alias("matches"),
    )


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) < 90")
def filter_date(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    start = F.to_date(F.lit("1996-01-01"))
    return t.orders.where((day >= start) & (F.datediff(day, start) < 90)).select("o_orderkey")


@query("""SELECT d.doc_id, l.quality, (l.quality IS NOT DISTINCT FROM NULL) AS unlabelled, (l.quality IS NOT DISTINCT FROM 1) AS good FROM documents d LEFT JOIN labels l USING (doc_id)""")
def filter_nullsafe(t: Tables) -> DataFrame:
    q = F.col("quality")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", q.eqNullSafe(F.lit(None)).alias("unlabelled"), q.eqNullSafe(1).alias("good"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedup_distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query()
def sample_bernoulli(t: Tables) -> DataFrame:
    return t.orders.sample(withReplacement=False, fraction=0.1, seed=42)


@query()
def sample_stratified(t: Tables) -> DataFrame:
    return t.orders.sampleBy("o_orderstatus", {"F": 0.2, "O": 0.1, "P": 1.0}, seed=42)


@query()
def sample_split(t: Tables) -> DataFrame:
    train, test = t.orders.randomSplit([0.7, 0.3], seed=42)
    return train.select(F.lit("train").alias("part"), "o_orderkey").unionAll(test.select(F.lit("test").alias("part"), "o_orderkey"))
