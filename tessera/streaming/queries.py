"""Structured Streaming operators over the events table, each run to its end with ``availableNow``.

The same builder functions take a batch or a streaming frame. In complete or
update mode the result equals the batch twin, which the oracles state.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import quality as rules
from tessera.operators.catalog import Tables, query
from tessera.plans.storage import new_path, written
from tessera.sources.versioned import Clause, VersionedTable


def event_stream(t: Tables, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream, ``ts`` as a UTC timestamp so that it can carry a watermark."""
    source = new_path(t.spark, "events-in")
    events = t.events
    events.repartition(2).write.parquet(source)
    reader = t.spark.readStream.schema(events.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append", state: str | None = None, out: str | None = None, trigger: dict | None = None) -> DataFrame:
    """Run a streaming frame to its end and return what it gave; complete mode keeps the last batch's result.

    In update mode a batch has a folder of its own that a replay overwrites, so no
    row comes twice. ``state`` and ``out`` may name the folders of an earlier run,
    which then goes on; ``trigger`` is availableNow unless it says otherwise.
    """
    spark = stream.sparkSession
    out, state = out or new_path(spark, "stream-out"), state or new_path(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch-{batch:09d}")

    writer.outputMode(mode).foreachBatch(put).start().awaitTermination()
    reader = spark.read.schema(stream.schema)
    return reader.parquet(out) if mode == "complete" else reader.option("recursiveFileLookup", "true").parquet(out)


def progress(stream: DataFrame, sink: str = "memory", mode: str = "append", name: str | None = None, trigger: dict | None = None, until: int | None = None, limit: float = 60.0) -> dict:
    """Run a named query into a memory, noop or console sink; (rows, batches, name, stopped) from its progress.

    With ``until`` a query that does not end by itself is stopped once it has given so many rows, or after ``limit`` seconds.
    """
    name = name or f"q{uuid.uuid4().hex[:8]}"
    q = stream.writeStream.queryName(name).outputMode(mode).format(sink).trigger(**(trigger or {"availableNow": True})).start()
    rows = lambda: sum(p["numInputRows"] for p in q.recentProgress)
    end = time.time() + limit
    try:
        if until is None:
            q.awaitTermination()
        else:
            while rows() < until and time.time() < end and q.isActive:
                q.awaitTermination(0.2)
    finally:
        q.stop()
    return {"rows": rows(), "batches": len(q.recentProgress), "name": q.name, "active": q.isActive, "message": q.status["message"]}


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch to ``apply``; a batch may come again after a failure, so it should be idempotent."""
    state = new_path(stream.sparkSession, "stream-state")
    stream.writeStream.option("checkpointLocation", state).foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and totals by event-time window and type, behind a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE event_type = 'purchase'")
def stream_basic(t: Tables) -> DataFrame:
    return drained(event_stream(t).where("event_type = 'purchase'").select("event_id", "user_id", (F.col("value") * 2).alias("doubled")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_count(t: Tables) -> DataFrame:
    return drained(event_stream(t, 1).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("SELECT event_type, max(n) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def stream_modes(t: Tables) -> DataFrame:
    updates = drained(event_stream(t, 1).groupBy("event_type").agg(F.count("*").alias("n")), "update")
    return updates.groupBy("event_type").agg(F.max("n").alias("n"))  # the last update of a key is the largest


_HOUR = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


@query(_HOUR)
def stream_tumbling(t: Tables) -> DataFrame:
    return drained(windowed(event_stream(t), "1 hour"), "complete")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - CAST(k AS INTEGER) * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events, range(0, 4) r(k) GROUP BY 1, 2")
def stream_sliding(t: Tables) -> DataFrame:
    return drained(windowed(event_stream(t), "1 hour", "15 minutes"), "complete")


@query(f"SELECT * FROM ({_HOUR}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_watermark(t: Tables) -> DataFrame:
    return drained(windowed(event_stream(t), "1 hour"))  # append: windows that the watermark has passed


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def stream_session(t: Tables) -> DataFrame:
    by = event_stream(t).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w"))
    return drained(by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("SELECT event_id, CAST(user_id % 25 AS BIGINT) AS nation, n_name FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey")
def stream_static_join(t: Tables) -> DataFrame:
    named = t.nation.select(F.col("n_nationkey").cast("long").alias("nation"), "n_name")
    return drained(event_stream(t).select("event_id", (F.col("user_id") % 25).alias("nation")).join(named, "nation", "left").select("event_id", "nation", "n_name"))


@query("""SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_stream_join(t: Tables) -> DataFrame:
    def side(kind: str, name: str) -> DataFrame:
        rows = event_stream(t).where(F.col("event_type") == kind)
        return rows.select(F.col("event_id").alias(name), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", "2 hours")

    on = "click_user = purchase_user AND purchase_ts >= click_ts AND purchase_ts <= click_ts + INTERVAL 1 HOUR"
    return drained(side("click", "click").join(side("purchase", "purchase"), F.expr(on)).select("click", "purchase"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    return drained(event_stream(t, 1).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("SELECT event_id FROM events")
def stream_dedup_watermark(t: Tables) -> DataFrame:
    twice = event_stream(t)
    return drained(twice.unionAll(twice).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


@query("SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY 1")
def stream_upsert(t: Tables) -> DataFrame:
    start = t.spark.createDataFrame([], "user_id long, last_event long, n long")
    table = VersionedTable.create(start, new_path(t.spark, "upsert"))

    def apply(df: DataFrame, batch: int) -> None:
        new = written(df.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n")), "batch")
        added = {"last_event": F.greatest(F.col("t.last_event"), F.col("s.last_event")), "n": F.col("t.n") + F.col("s.n")}
        table.merge(new, ["user_id"], [Clause("matched", "update", values=added), Clause("not_matched", "insert")], batch=("users", batch))

    each_batch(event_stream(t, 1).select("user_id", "event_id"), apply)
    return table.read()


def running_totals(events: DataFrame, idle_days: int = 365, late: str = "10 minutes") -> DataFrame:
    """Running count and total by user in state, as an update a batch; a user's state goes once the watermark is ``idle_days`` past its last event."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for f in frames:
            n, total, last = n + len(f), total + float(f["value"].sum()), max(last, int(f["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(last + idle_days * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    kept = events.select("user_id", "value", "ts").withWatermark("ts", late).groupBy("user_id")
    return kept.applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double, last long", "update", "EventTimeTimeout")


@query("SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def stream_state(t: Tables) -> DataFrame:
    updates = drained(running_totals(event_stream(t, 1)), "update")
    return updates.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 3).alias("total"))


class Pipeline:
    """A small declarative pipeline: named tables built from one another, with expectations.

    Each table is built once and written to the shared folder before its readers.
    """

    def __init__(self) -> None:
        self._made: dict[str, DataFrame] = {}
        self._steps: dict[str, tuple] = {}
        self.broken: dict[str, dict[str, int]] = {}

    def table(
        self, *needs: str, expect: dict[str, Column] | None = None, expect_or_drop: dict[str, Column] | None = None, expect_or_fail: dict[str, Column] | None = None, view: bool = False
    ) -> Callable:
        """Registers a table, or with ``view`` a plan that its readers repeat; rows that break ``expect`` are counted in ``broken`` only."""

        def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self._steps[f.__name__] = f, needs, (expect or {}, expect_or_drop or {}, expect_or_fail or {}), view
            return f

        return register

    def view(self, *needs: str) -> Callable:
        return self.table(*needs, view=True)

    def read(self, name: str, path: tuple[str, ...] = ()) -> DataFrame:
        if name in path:
            raise ValueError("the tables need one another: " + " > ".join((*path, name)))
        if name not in self._made:
            build, needs, (counted, dropped, failing), view = self._steps[name]
            df = build(*[self.read(n, (*path, name)) for n in needs])
            kept = rules.expect(df, drop=dropped, fail=failing)
            self._made[name] = kept if view else written(kept, name)
            if (counted or dropped) and not view:
                held = [F.sum((~F.coalesce(v, F.lit(False))).cast("long")).alias(k) for k, v in {**counted, **dropped}.items()]
                self.broken[name] = {k: v or 0 for k, v in df.agg(*held).first().asDict().items()}
        return self._made[name]


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE value > 0 GROUP BY 1")
def pipeline_dag(t: Tables) -> DataFrame:
    p = Pipeline()

    @p.table()
    def raw() -> DataFrame:
        return t.events

    @p.table("raw", expect_or_drop={"positive": F.col("value") > 0})
    def valid(raw: DataFrame) -> DataFrame:
        return raw.select(F.to_date("ts").alias("day"), "value")

    @p.table("valid")
    def daily(valid: DataFrame) -> DataFrame:
        return valid.groupBy("day").agg(F.count("*").alias("n"))

    return p.read("daily")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def stream_medallion(t: Tables) -> DataFrame:
    spark = t.spark
    bronze = drained(event_stream(t).withColumn("_at", F.lit("b1")))
    landed = new_path(spark, "bronze")
    bronze.write.parquet(landed)
    silver = drained(spark.readStream.schema(bronze.schema).parquet(landed).where("value IS NOT NULL").select(F.to_date("ts").alias("day"), "event_type"))
    return silver.groupBy("day", "event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS batched, false AS active FROM events")
def stream_progress(t: Tables) -> DataFrame:
    """A named query's own account: rows by its progress, more than one batch, and stopped at its end."""
    seen = progress(event_stream(t, 1).select("event_id"), "noop")
    return t.spark.createDataFrame([(seen["rows"], seen["batches"] >= 2, seen["active"])], "rows long, batched boolean, active boolean")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_memory(t: Tables) -> DataFrame:
    """Complete mode into a memory table that SQL reads."""
    seen = progress(event_stream(t).groupBy("event_type").agg(F.count("*").alias("n")), "memory", "complete")
    return t.spark.table(seen["name"])


@query("SELECT event_id, user_id FROM events")
def stream_restart(t: Tables) -> DataFrame:
    """Two runs with one checkpoint: the second takes only what has come since, and nothing comes twice."""
    spark, source = t.spark, new_path(t.spark, "events-in")
    state, out = new_path(spark, "stream-state"), new_path(spark, "stream-out")
    even = F.col("user_id") % 2 == 0
    for part in (even, ~even):
        t.events.where(part).write.mode("append").parquet(source)
        got = drained(spark.readStream.schema(t.events.schema).parquet(source).select("event_id", "user_id"), state=state, out=out)
    return got


@query("SELECT true AS enough, true AS consecutive")
def stream_rate(t: Tables) -> DataFrame:
    """The rate source under a processing-time trigger, stopped from outside."""
    name = f"rate{uuid.uuid4().hex[:8]}"
    stream = t.spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    progress(stream, "memory", name=name, trigger={"processingTime": "200 milliseconds"}, until=50)
    seen = t.spark.table(name).agg(F.count("*").alias("n"), F.max("value").alias("m"))
    return seen.select((F.col("n") >= 50).alias("enough"), (F.col("m") + 1 == F.col("n")).alias("consecutive"))
