"""Set operations, generators, reshaping and nested data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.catalog import Tables, query


def safe_union(parts: dict[str, DataFrame], key: Sequence[str] = ()) -> DataFrame:
    """Union by name with ``_source`` and ``_loaded_at`` columns; with a key, one row of each key stays, that of the first source by name."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("_source", F.lit(k)) for k, df in parts.items())).withColumn("_loaded_at", F.current_timestamp())
    if not key:
        return stacked
    rest = [c for c in stacked.columns if c not in (*key, "_source", "_loaded_at")]
    first = stacked.groupBy(*key).agg(F.min(F.struct("_source", *rest)).alias("s"))
    return first.select(*key, *[F.col("s")[c].alias(c) for c in rest], F.col("s")["_source"].alias("_source"), F.current_timestamp().alias("_loaded_at"))


def flatten(df: DataFrame, depth: int = 5, explode_arrays: bool = False) -> DataFrame:
    """Struct fields as columns named ``parent_child`` down to ``depth``; arrays are exploded (outer) on request.

    A name that would repeat gets a number, so clashing fields are kept apart.
    """
    for _ in range(depth):
        nested = [f for f in df.schema if isinstance(f.dataType, T.StructType)]
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)] if explode_arrays else []
        if not nested and not arrays:
            break
        used: set[str] = set()

        def named(name: str, used: set[str] = used) -> str:
            k, out = 1, name
            while out in used:
                k, out = k + 1, f"{name}_{k + 1}"
            used.add(out)
            return out

        columns: list[Column] = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`").getField(c.name).alias(named(f"{f.name}_{c.name}")) for c in f.dataType]
            else:
                columns.append(F.col(f"`{f.name}`").alias(named(f.name)))
        df = df.select(*columns)
        if not nested and arrays:
            df = df.withColumn(arrays[0], F.explode_outer(arrays[0]))
    return df


def dynamic_pivot(df: DataFrame, by: str, column: str, value: Column, limit: int = 100) -> DataFrame:
    """Pivot over the distinct values of ``column``; fails where there are more than ``limit``."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    return df.groupBy(by).pivot(column, sorted(values)).agg(value)


def snapshot_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of two snapshots with their state, new, gone or same, by one grouping over both."""
    columns = old.columns
    sided = old.select(*columns, F.lit(1).alias("__side")).unionAll(new.select(*columns, F.lit(2).alias("__side")))
    sides = sided.groupBy(*columns).agg(F.bit_or("__side").alias("__sides"))
    state = F.when(F.col("__sides") == 1, "gone").when(F.col("__sides") == 2, "new").otherwise("same")
    return sides.select(state.alias("state"), *columns)


_A = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000"
_B = "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


def _ab(t: Tables) -> tuple[DataFrame, DataFrame]:
    return (
        t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")),
        t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")),
    )


@query(f"{_A} UNION ALL {_B}")
def set_union_all(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return a.union(b)


@query(f"{_A} UNION {_B}")
def set_union(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return a.union(b).distinct()


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def set_union_by_name(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def set_intersect_all(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return a.intersectAll(b)


@query(f"{_A} EXCEPT {_B}")
def set_except(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(t: Tables) -> DataFrame:
    a, b = _ab(t)
    return a.exceptAll(b)


@query("""WITH o AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 0)
SELECT 'new' AS state, * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'gone', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'same', * FROM (SELECT * FROM o INTERSECT SELECT * FROM n)""")
def set_snapshot_diff(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name")
    old = c.where("c_custkey % 7 <> 0")
    new = c.where("c_custkey % 5 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 11 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    return snapshot_states(old, new)


@query("""SELECT id, name, src AS _source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, name) AS n FROM (SELECT c_custkey AS id, c_name AS name, 'a' AS src FROM customer
UNION ALL SELECT s_suppkey, s_name, 'b' FROM supplier)) WHERE n = 1""")
def set_safe_union(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return safe_union({"a": a, "b": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}, ["id"]).drop("_loaded_at")


@query("""SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN string_split(p_type, ' ') END AS w FROM part) LEFT JOIN LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) x ON true""")
def gen_explode(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.split("p_type", " ")).alias("w"))
    return words.select("p_partkey", F.posexplode_outer("w").alias("pos", "word"))


@query("SELECT o_orderkey, CAST(u.unnest.line AS INTEGER) AS line, u.unnest.qty AS qty FROM (SELECT l_orderkey AS o_orderkey, list({'line': l_linenumber, 'qty': l_quantity}) AS items FROM lineitem GROUP BY 1), unnest(items) u")
def gen_inline(t: Tables) -> DataFrame:
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))).alias("items"))
    return nested.select("o_orderkey", F.inline("items"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def gen_json_tuple(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.json_tuple("props", "page", "ref").alias("page", "ref"))


_WIDE = "SELECT c_nationkey, round(sum(c_acctbal), 2) AS total, round(min(c_acctbal), 2) AS lo, round(max(c_acctbal), 2) AS hi FROM customer GROUP BY 1"


def _wide(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.groupBy("c_nationkey").agg(F.round(F.sum(b), 2).alias("total"), F.round(F.min(b), 2).alias("lo"), F.round(F.max(b), 2).alias("hi"))


@query(f"SELECT c_nationkey, measure, value FROM (UNPIVOT ({_WIDE}) ON total, lo, hi INTO NAME measure VALUE value)")
def reshape_stack(t: Tables) -> DataFrame:
    return _wide(t).selectExpr("c_nationkey", "stack(3, 'total', total, 'lo', lo, 'hi', hi) AS (measure, value)")


@query(f"SELECT c_nationkey, measure, value FROM (UNPIVOT ({_WIDE}) ON total, lo, hi INTO NAME measure VALUE value)")
def reshape_unpivot(t: Tables) -> DataFrame:
    return _wide(t).unpivot(["c_nationkey"], ["total", "lo", "hi"], "measure", "value")


@query("""SELECT c_nationkey, """ + ", ".join(f"""CAST(max(CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END) AS INTEGER) AS "{s}\"""" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY 1")
def reshape_onehot(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.max(F.lit(1))).fillna(0)


@query("SELECT o_orderkey AS id, o_custkey AS who_key, o_orderstatus AS who_what_status, o_totalprice AS who_what_price FROM orders")
def reshape_flatten(t: Tables) -> DataFrame:
    what = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    nested = t.orders.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), what.alias("what")).alias("who"))
    return flatten(nested)


@query("""SELECT p_partkey, k AS key, v AS value FROM part, LATERAL (VALUES ('brand', p_brand), ('type', p_type)) x(k, v)""")
def reshape_map(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")))


@query("SELECT l_orderkey, list({'line': l_linenumber, 'qty': l_quantity} ORDER BY l_linenumber, l_quantity) AS items FROM lineitem GROUP BY 1")
def reshape_renest(t: Tables) -> DataFrame:
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))


@query("SELECT c_nationkey, m['BUILDING'] AS building, len(map_keys(m)) AS segments FROM (SELECT c_nationkey, map(list(c_mktsegment), list(n)) AS m FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1)")
def reshape_map_build(t: Tables) -> DataFrame:
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    maps = counts.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    return maps.select("c_nationkey", F.try_element_at("m", F.lit("BUILDING")).alias("building"), F.size("m").cast("long").alias("segments"))
