"""User functions: Arrow-backed scalar, pandas scalar, iterator, aggregate, grouped and mapped forms, and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators.catalog import Tables, query


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'rich' END AS band FROM customer")
def udf_scalar(t: Tables) -> DataFrame:
    def band(balance: float | None) -> str | None:
        return None if balance is None else "debt" if balance < 0 else "mid" if balance < 5000 else "rich"

    return t.customer.select("c_custkey", F.udf(band, StringType(), useArrow=True)("c_acctbal").alias("band"))


@query("SELECT c_custkey, reverse(c_name) AS turned FROM customer")
def udf_sql(t: Tables) -> DataFrame:
    t.spark.udf.register("tessera_turn", F.udf(lambda s: None if s is None else s[::-1], StringType(), useArrow=True))
    return t.spark.sql("SELECT c_custkey, tessera_turn(c_name) AS turned FROM {c}", c=t.customer)


@query("SELECT c_custkey, c_acctbal * 1.8 + 32 AS scaled FROM customer")
def udf_pandas(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def scale(s: pd.Series) -> pd.Series:
        return s * 1.8 + 32

    return t.customer.select("c_custkey", scale("c_acctbal").alias("scaled"))


@query("SELECT p_partkey, length(p_name) + 1 AS n FROM part")
def udf_iter(t: Tables) -> DataFrame:
    @F.pandas_udf("long")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extra = 1  # set up once a task
        for s in batches:
            yield s.str.len() + extra

    return t.part.select("p_partkey", measured("p_name").alias("n"))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 6) AS spread FROM customer GROUP BY 1")
def udaf_pandas(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    return t.customer.groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 6).alias("spread"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def udf_grouped_map(t: Tables) -> DataFrame:
    def standard(g: pd.DataFrame) -> pd.DataFrame:
        b = g["c_acctbal"]
        return pd.DataFrame({"c_custkey": g["c_custkey"], "z": ((b - b.mean()) / b.std()).round(6)})

    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(standard, "c_custkey long, z double")


@query("SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 100000")
def udf_map_partitions(t: Tables) -> DataFrame:
    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = b[b["o_totalprice"] > 100000]
            yield pd.DataFrame({"o_orderkey": some["o_orderkey"], "half": some["o_totalprice"] / 2})

    return t.orders.select("o_orderkey", "o_totalprice").mapInPandas(halves, "o_orderkey long, half double")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def udf_map_arrow(t: Tables) -> DataFrame:
    def even(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.equal(pc.bit_wise_and(b.column(0), 1), 0))

    return t.orders.select("o_orderkey").mapInArrow(even, "o_orderkey long")


@query("SELECT p_partkey, CAST(i AS INTEGER) AS i, p_size * CAST(i AS INTEGER) AS n FROM part, range(1, 4) r(i)")
def udtf_multiples(t: Tables) -> DataFrame:
    @F.udtf(returnType="i int, n int")
    class Multiples:
        def eval(self, size: int):
            for i in range(1, 4):
                yield i, size * i

    t.spark.udtf.register("tessera_multiples", Multiples)
    return t.spark.sql("SELECT p_partkey, i, n FROM {p}, LATERAL tessera_multiples(p_size)", p=t.part)


@query("SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT) % 7 AS value, TRY_CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT) % 7 = 0 AS failed FROM customer")
def udf_captured(t: Tables) -> DataFrame:
    """Errors as a field of the result instead of a failed query."""

    def parsed(name: str) -> tuple[int | None, str | None]:
        try:
            digits = int("".join(c for c in name if c.isdigit()))
            return digits % 7, "zero" if digits % 7 == 0 else None
        except ValueError as e:
            return None, str(e)

    found = F.udf(parsed, "value long, error string", useArrow=True)("c_name")
    return t.customer.select("c_custkey", found.alias("r")).select("c_custkey", "r.value", F.col("r.error").isNotNull().alias("failed"))


@query("SELECT p_partkey, p_brand || '/' || CAST(p_size * 3 AS VARCHAR) AS label FROM part")
def udf_closure(t: Tables) -> DataFrame:
    """Several columns, and a value of the driver's in the closure."""

    def labelled(factor: int):
        return F.udf(lambda brand, size: f"{brand}/{size * factor}", StringType(), useArrow=True)

    return t.part.select("p_partkey", labelled(3)("p_brand", "p_size").alias("label"))


@query("SELECT count(*) AS n, true AS within, true AS varied FROM customer")
def udf_nondeterministic(t: Tables) -> DataFrame:
    """A function that gives other values each time, marked so, which the optimizer then evaluates once a row."""
    import random

    noise = F.udf(lambda: random.random(), "double").asNondeterministic()
    rolled = t.customer.select(noise().alias("x"))
    return rolled.agg(F.count("*").alias("n"), ((F.min("x") >= 0) & (F.max("x") < 1)).alias("within"), (F.min("x") < F.max("x")).alias("varied"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
def udf_broadcast(t: Tables) -> DataFrame:
    """A look-up table broadcast once to each executor."""
    names = t.spark.sparkContext.broadcast({"F": "filled", "O": "open"})
    return t.orders.select("o_orderkey", F.udf(lambda s: names.value.get(s, "other"), StringType(), useArrow=True)("o_orderstatus").alias("status"))


@query("SELECT count(*) AS rows, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS debts FROM customer")
def udf_accumulator(t: Tables) -> DataFrame:
    """Accumulators filled by an action over partitions; tasks that ran twice count once in an action."""
    rows, debts = t.spark.sparkContext.accumulator(0), t.spark.sparkContext.accumulator(0)

    def count(part: Iterator) -> None:
        for r in part:
            rows.add(1)
            debts.add(int(r.c_acctbal is not None and r.c_acctbal < 0))

    t.customer.select("c_acctbal").foreachPartition(count)
    return t.spark.createDataFrame([(rows.value, debts.value)], "rows long, debts long")


@query("SELECT c_nationkey, round(sum(c_acctbal * 1.1), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def df_transform(t: Tables) -> DataFrame:
    """A chain of named steps, each a function of a frame."""

    def scaled(by: float):
        return lambda df: df.withColumn("c_acctbal", F.col("c_acctbal") * by)

    positive = lambda df: df.where("c_acctbal > 0")
    totals = lambda df: df.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return t.customer.transform(positive).transform(scaled(1.1)).transform(totals)


@query("SELECT CAST(count(*) AS BIGINT) AS n, true AS numbered FROM orders")
def udf_partition_index(t: Tables) -> DataFrame:
    """Rows with the number of their partition, the one thing that the RDD API alone gives a function."""
    numbered = t.orders.select("o_orderkey").repartition(3).rdd.mapPartitionsWithIndex(lambda i, rows: ((i, r.o_orderkey) for r in rows))
    df = t.spark.createDataFrame(numbered, "part int, o_orderkey long")
    return df.agg(F.count("*").alias("n"), (F.count_distinct("part") == 3).alias("numbered"))
