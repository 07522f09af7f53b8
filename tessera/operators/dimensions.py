"""Change capture, slowly changing dimensions and the medallion pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.catalog import Tables, query


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of a row in which a null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]), 256)


def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change): INSERT, DELETE, UPDATE or NO_CHANGE of every key of either side."""
    a = old.select(F.col(key), row_hash(fields).alias("a"))
    b = new.select(F.col(key), row_hash(fields).alias("b"))
    kind = F.when(F.col("a").isNull(), "INSERT").when(F.col("b").isNull(), "DELETE").when(F.col("a") == F.col("b"), "NO_CHANGE").otherwise("UPDATE")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def scd1(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``now`` with their key; the rest stays."""
    return now.join(new, key, "left_anti").select(*now.columns).unionByName(new.select(*now.columns))


def scd2(history: DataFrame, new: DataFrame, key: str, fields: Sequence[str], at: Column) -> DataFrame:
    """Closes current rows that ``new`` changes and opens new ones; intervals are half-open, current ones end with null.

    ``history`` has key, fields, valid_from, valid_to, is_current; ``new`` holds each key once.
    """
    fresh = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__new"))
    differs = ~row_hash(fields).eqNullSafe(row_hash([f"__{c}" for c in fields]))
    met = history.join(fresh, key, "left").withColumn("__close", F.col("is_current") & F.coalesce(F.col("__new"), F.lit(False)) & differs)
    closed = met.select(
        key, *fields, "valid_from", F.when(F.col("__close"), at).otherwise(F.col("valid_to")).alias("valid_to"), (F.col("is_current") & ~F.col("__close")).alias("is_current")
    )
    standing = history.where("is_current").select(key, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__old"))
    opened = new.join(standing, key, "left").where(F.col("__old").isNull() | differs).select(
        key, *fields, at.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")
    )
    return closed.unionByName(opened)


def scd3(now: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """Keeps the previous value of ``field`` in ``previous_<field>`` where it changes."""
    fresh = new.select(F.col(key), F.col(field).alias("__v"))
    changed = F.col("__v").isNotNull() & ~F.col("__v").eqNullSafe(F.col(field))
    previous = F.when(changed, F.col(field))
    return now.join(fresh, key, "left").select(key, F.coalesce("__v", field).alias(field), previous.alias(f"previous_{field}"))


_OLD = "(SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 9 <> 0)"
_NEW = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 6 <> 0)"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 6 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return c.where("c_custkey % 9 <> 0"), new


@query(f"""SELECT c_custkey, CASE WHEN a.c_name IS NULL THEN 'INSERT' WHEN b.c_name IS NULL THEN 'DELETE' WHEN a.c_mktsegment = b.c_mktsegment THEN 'NO_CHANGE' ELSE 'UPDATE' END AS change FROM {_OLD} a FULL JOIN {_NEW} b USING (c_custkey)""")
def cdc_hash(t: Tables) -> DataFrame:
    old, new = _sides(t)
    return changes(old, new, "c_custkey", ["c_name", "c_mktsegment"])


@query(f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.c_custkey = o.c_custkey)")
def scd1_overwrite(t: Tables) -> DataFrame:
    old, new = _sides(t)
    return scd1(old, new, "c_custkey")


def _history(t: Tables) -> tuple[DataFrame, DataFrame]:
    old, new = _sides(t)
    opened = old.withColumns({"valid_from": F.lit("2020-01-01").cast("date"), "valid_to": F.lit(None).cast("date"), "is_current": F.lit(True)})
    return opened, new


_SCD2 = f"""SELECT o.c_custkey, o.c_name, o.c_mktsegment, DATE '2020-01-01' AS valid_from, CASE WHEN n.c_mktsegment <> o.c_mktsegment THEN DATE '2024-06-01' END AS valid_to, NOT coalesce(n.c_mktsegment <> o.c_mktsegment, false) AS is_current
FROM {_OLD} o LEFT JOIN {_NEW} n USING (c_custkey) UNION ALL SELECT n.c_custkey, n.c_name, n.c_mktsegment, DATE '2024-06-01', NULL, true FROM {_NEW} n LEFT JOIN {_OLD} o USING (c_custkey) WHERE o.c_custkey IS NULL OR o.c_mktsegment <> n.c_mktsegment"""


@query(_SCD2)
def scd2_history(t: Tables) -> DataFrame:
    opened, new = _history(t)
    return scd2(opened, new, "c_custkey", ["c_name", "c_mktsegment"], F.lit("2024-06-01").cast("date"))


@query(f"SELECT c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, CASE WHEN n.c_mktsegment <> o.c_mktsegment THEN o.c_mktsegment END AS previous_c_mktsegment FROM {_OLD} o LEFT JOIN {_NEW} n USING (c_custkey)")
def scd3_previous(t: Tables) -> DataFrame:
    old, new = _sides(t)
    return scd3(old, new, "c_custkey", "c_mktsegment")


@query(f"SELECT c_custkey, c_mktsegment FROM ({_SCD2}) WHERE valid_from <= DATE '2023-01-01' AND (valid_to IS NULL OR DATE '2023-01-01' < valid_to)")
def scd_asof(t: Tables) -> DataFrame:
    day = F.lit("2023-01-01").cast("date")
    return scd2_history(t).where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))).select("c_custkey", "c_mktsegment")


def bronze(raw: DataFrame, batch: str) -> DataFrame:
    """Raw rows with their batch."""
    return raw.withColumn("_batch", F.lit(batch))


def silver(raw: DataFrame) -> DataFrame:
    """Typed, valid events, each id once."""
    typed = raw.select("event_id", F.to_date("ts").alias("day"), "user_id", F.lower("event_type").alias("event_type"), "value", F.get_json_object("props", "$.page").alias("page"))
    return typed.where("event_id IS NOT NULL AND value IS NOT NULL").dropDuplicates(["event_id"])


def gold(clean: DataFrame) -> DataFrame:
    """Daily figures by event type."""
    return clean.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT CAST(ts AS DATE) AS day, lower(event_type) AS event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 3) AS total FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def medallion_gold(t: Tables) -> DataFrame:
    return gold(silver(bronze(t.events, "b1")))


def scd6(history: DataFrame, new: DataFrame, key: str, field: str, at: Column) -> DataFrame:
    """History as in ``scd2``, with the current value of ``field`` beside every version and the previous one beside each."""
    versions = scd2(history, new, key, [field], at)
    order = W.partitionBy(key).orderBy("valid_from")
    now = F.last(field).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return versions.withColumns({f"current_{field}": now, f"previous_{field}": F.lag(field).over(order)})


@query(f"""SELECT c_custkey, c_mktsegment, valid_from, is_current, last(c_mktsegment) OVER (PARTITION BY c_custkey ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_c_mktsegment,
lag(c_mktsegment) OVER (PARTITION BY c_custkey ORDER BY valid_from) AS previous_c_mktsegment FROM ({_SCD2})""")
def scd6_hybrid(t: Tables) -> DataFrame:
    opened, new = _history(t)
    found = scd6(opened.drop("c_name"), new, "c_custkey", "c_mktsegment", F.lit("2024-06-01").cast("date"))
    return found.select("c_custkey", "c_mktsegment", "valid_from", "is_current", "current_c_mktsegment", "previous_c_mktsegment")


def with_inferred(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``dimension`` with a row for each key that facts have before it does: other columns null, ``inferred`` true until the row comes."""
    known = dimension.withColumn("inferred", F.lit(False))
    missing = facts.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti").withColumn("inferred", F.lit(True))
    return known.unionByName(missing, allowMissingColumns=True)


@query("""SELECT c_custkey, c_name, false AS inferred FROM customer WHERE c_nationkey < 15 UNION ALL SELECT DISTINCT o_custkey, NULL, true FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15)""")
def dim_inferred(t: Tables) -> DataFrame:
    """Orders of customers that have not come yet."""
    known = t.customer.where("c_nationkey < 15").select("c_custkey", "c_name")
    return with_inferred(known, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name", "inferred")


@query("SELECT event_id, CAST(ts AS DATE) AS day, lower(event_type) AS event_type, CASE WHEN user_id % 2 = 0 THEN 'b0' ELSE 'b1' END AS batch FROM events WHERE value IS NOT NULL")
def medallion_increment(t: Tables) -> DataFrame:
    """Two batches, the second of which brings all events again: rows that silver has are left out by an anti join."""
    first = bronze(t.events.where("user_id % 2 = 0"), "b0")
    second = bronze(t.events, "b1")
    held = None
    for raw in (first, second):
        fresh = silver(raw).join(raw.select("event_id", F.col("_batch").alias("batch")).dropDuplicates(["event_id"]), "event_id")
        new = fresh if held is None else fresh.join(held.select("event_id"), "event_id", "left_anti")
        held = new if held is None else held.unionByName(new)
    return held.select("event_id", "day", "event_type", "batch")
