"""Registry of the relational queries and of their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import aggregates, analytics, catalog, dimensions, joins, projection, quality, sets, sql_surface, windows  # noqa: F401  the modules register their queries
from tessera.functions import extras, scalars, udfs  # noqa: F401
from tessera.plans.session import table
from tessera.sources import files, versioned  # noqa: F401
from tessera.streaming import queries as _streams  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by customer nation for lines shipped from 1995 on, ranked, first ten."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    by_nation = (
        lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(revenue.alias("revenue"))
    )
    ranked = by_nation.withColumn("place", F.rank().over(W.orderBy(F.desc("revenue"))))
    return ranked.where("place <= 10")


#: Further names under which the blueprint lists a query.
ALIASES = {"scd1": "scd1_overwrite", "scd2": "scd2_history", "scd3": "scd3_previous", "scan_parquet": "scan_parquet_lineitem"}


def queries() -> dict[str, Query]:
    return {"flagship": flagship, **catalog.QUERIES, **{a: catalog.QUERIES[n] for a, n in ALIASES.items()}}


def oracle_sql() -> dict[str, str]:
    return {
        "flagship": """
        SELECT n_name, revenue, CAST(place AS INT) AS place FROM (
          SELECT *, rank() OVER (ORDER BY revenue DESC) AS place FROM (
            SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name)) WHERE place <= 10""",
        **catalog.ORACLES,
        **{a: catalog.ORACLES[n] for a, n in ALIASES.items()},
    }
