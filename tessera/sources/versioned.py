"""Versioned tables: Parquet snapshots below a commit log, with DML, time travel, change feed and upkeep.

A table is a folder with one data folder a write and ``_log/<version>.json``, each
of which lists the data files of its version. A commit's log file is written under
another name and then renamed without overwriting, so that a reader never meets
half of it and a second writer of the version fails (optimistic concurrency).
Updates, deletes and merges rewrite the files with rows that they touch; the others
stay. Every access goes through Spark or the Hadoop file system, so any store serves.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.operators.catalog import Tables, query
from tessera.plans.storage import new_path


@dataclass
class Clause:
    """One WHEN clause of a merge: ``when`` is matched, not_matched or not_matched_by_source; ``action`` update, delete or insert.

    ``values`` maps columns to expressions over the aliases t (target) and s
    (source); None takes every column from the source.
    """

    when: str
    action: str
    condition: Column | None = None
    values: dict[str, Column] | None = None


def merge(target: DataFrame, source: DataFrame, on: Sequence[str], clauses: Sequence[Clause]) -> DataFrame:
    """The target after a merge: a full outer join whose action column takes the first clause that holds.

    Null keys never match and a null condition does not hold. A target row that is
    matched by several source rows under an action fails the query.
    """
    columns = target.columns
    many = F.count("*").over(W.partitionBy(*[F.col(c) for c in on]))
    s = source.withColumns({"__s": F.lit(True), "__many": many}).alias("s")
    t = target.withColumn("__t", F.lit(True)).alias("t")
    keys = F.lit(True)
    for c in on:
        keys = keys & (F.col(f"t.{c}") == F.col(f"s.{c}"))
    met = t.join(s, keys, "full")
    has_t, has_s = F.coalesce(F.col("__t"), F.lit(False)), F.coalesce(F.col("__s"), F.lit(False))
    states = {"matched": has_t & has_s, "not_matched": ~has_t & has_s, "not_matched_by_source": has_t & ~has_s}
    action = F.lit(-1)
    for k, c in reversed(list(enumerate(clauses))):
        holds = states[c.when] & F.coalesce(c.condition if c.condition is not None else F.lit(True), F.lit(False))
        action = F.when(holds, F.lit(k)).otherwise(action)
    twice = F.raise_error(F.lit("several source rows match one target row")).cast("int")
    chosen = met.withColumn("__a", F.when((action >= 0) & states["matched"] & (F.col("__many") > 1), twice).otherwise(action))
    a = F.col("__a")
    gone = F.lit(False)
    for k, c in enumerate(clauses):
        if c.action == "delete":
            gone = gone | (a == k)
    kept = chosen.where(~gone & (has_t | (a >= 0)))
    out = []
    for name in columns:
        value = F.col(f"t.{name}")
        for k, c in enumerate(clauses):
            if c.action in ("update", "insert"):
                default = F.col(f"t.{name}") if c.action == "update" else F.lit(None)
                new = F.col(f"s.{name}") if c.values is None else c.values.get(name, default)
                value = F.when(a == k, new).otherwise(value)
        out.append(value.cast(target.schema[name].dataType).alias(name))
    return kept.select(*out)


class VersionedTable:
    """A table at ``path``; create it with ``create``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    @classmethod
    def create(cls, df: DataFrame, path: str, properties: dict[str, str] | None = None) -> VersionedTable:
        table = cls(df.sparkSession, path)
        table._commit(0, "CREATE", table._write(df), df.schema, properties or {})
        return table

    def _write(self, df: DataFrame) -> list[str]:
        """The files that ``df`` was written to, below the table's folder."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return sorted(f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(self._hadoop(f"{self.path}/{name}")) if s.getPath().getName().startswith("part-"))

    def _commit(self, version: int, operation: str, data: list[str], schema: StructType, properties: dict[str, str], **more: Any) -> None:
        entry = {"version": version, "timestamp": time.time(), "operation": operation, "data": data, "schema": schema.json(), "properties": properties, **more}
        made = self._hadoop(f"{self.path}/_log/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, self._hadoop(f"{self.path}/_log/{version:012d}.json"), options)
        except Exception:
            self._fs.delete(made, False)
            raise

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(f"{self.path}/_log"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._hadoop(f"{self.path}/_log/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _entries(self) -> list[dict]:
        return [self._entry(v) for v in self._versions()]

    def _at(self, version: int | None = None, timestamp: float | None = None) -> dict:
        """One entry of the log; only those looked at are read."""
        for v in reversed(self._versions()):
            if version is None or v == version:
                entry = self._entry(v)
                if timestamp is None or entry["timestamp"] <= timestamp:
                    return entry
        raise ValueError("no such version")

    def _place(self, name: str) -> str:
        return name if ":" in name or name.startswith("/") else f"{self.path}/{name}"  # a clone's files lie elsewhere

    def read(self, version: int | None = None, timestamp: float | None = None) -> DataFrame:
        """The table now, at a version, or as of a time in seconds."""
        return self._read(self._at(version, timestamp))

    def _read(self, entry: dict, files: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        some = entry["data"] if files is None else files
        if not some:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*map(self._place, some))

    def _change(self, operation: str, df: DataFrame, keep: Sequence[str] = (), schema: StructType | None = None, **more: Any) -> None:
        last = self._at()
        properties = {**last["properties"], **more.pop("set_properties", {})}
        self._commit(last["version"] + 1, operation, [*keep, *self._write(df)], schema or df.schema, properties, **more)

    def _touched(self, last: dict, rows: DataFrame) -> tuple[list[str], list[str]]:
        """(files of ``last`` with a row of ``rows``, which has _file; the other files): names alone reach the driver."""
        found = {r[0].rsplit("/", 2)[-2] + "/" + r[0].rsplit("/", 1)[-1] for r in rows.select("_file").distinct().collect()}
        hit = [f for f in last["data"] if "/".join(f.rsplit("/", 2)[-2:]) in found]
        return hit, [f for f in last["data"] if f not in set(hit)]

    def _with_file(self, last: dict) -> DataFrame:
        return self._read(last).withColumn("_file", F.col("_metadata.file_path")) if last["data"] else self._read(last).withColumn("_file", F.lit(""))

    def append(self, df: DataFrame, merge_schema: bool = False) -> None:
        """Add rows; other columns or types are refused unless ``merge_schema`` adds them to the table."""
        last = self._at()
        schema = StructType.fromJson(json.loads(last["schema"]))
        known, new = {f.name: f.dataType for f in schema}, {f.name: f.dataType for f in df.schema}
        clash = [c for c in new if c in known and known[c] != new[c]]
        extra = [f for f in df.schema if f.name not in known]
        if clash or (extra and not merge_schema):
            raise ValueError(f"schema mismatch: {clash or [f.name for f in extra]}")
        wide = StructType([*schema.fields, *extra])
        full = df.select(*[F.col(f.name) if f.name in new else F.lit(None).cast(f.dataType).alias(f.name) for f in wide])
        self._change("APPEND", full, last["data"], wide)

    def overwrite(self, df: DataFrame) -> None:
        self._change("OVERWRITE", df)

    def update(self, values: dict[str, Column], condition: Column | None = None) -> None:
        """Set ``values`` where ``condition`` is true, in the files that hold such rows."""
        holds = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        last = self._at()
        hit, rest = self._touched(last, self._with_file(last).where(holds))
        now = self._read(last, hit)
        self._change("UPDATE", now.select(*[F.when(holds, values[c]).otherwise(F.col(c)).cast(now.schema[c].dataType).alias(c) if c in values else F.col(c) for c in now.columns]), rest)

    def delete(self, condition: Column) -> None:
        """Drop the rows for which ``condition`` is true, from the files that hold them; where it is null a row stays."""
        holds = F.coalesce(condition, F.lit(False))
        last = self._at()
        hit, rest = self._touched(last, self._with_file(last).where(holds))
        self._change("DELETE", self._read(last, hit).where(~holds), rest)

    def merge(self, source: DataFrame, on: Sequence[str], clauses: Sequence[Clause], batch: tuple[str, int] | None = None) -> bool:
        """Merge ``source``; files without a matched key stay, unless a clause speaks of rows that the source lacks.

        ``batch`` names a stream and its batch; one that the table has had is passed over, so a
        replay changes nothing. Returns whether the merge was made.
        """
        last = self._at()
        done = {}
        if batch:
            name, number = f"stream.{batch[0]}", batch[1]
            if int(last["properties"].get(name, "-1")) >= number:
                return False
            done = {"set_properties": {name: str(number)}}
        if any(c.when == "not_matched_by_source" for c in clauses):
            hit, rest = last["data"], []
        else:
            hit, rest = self._touched(last, self._with_file(last).join(source.select(*on), list(on), "left_semi"))
        self._change("MERGE", merge(self._read(last, hit), source, on, clauses), rest, **done)
        return True

    def restore(self, version: int) -> None:
        """Make an old version current, as a new version."""
        old, last = self._at(version), self._at()
        self._commit(last["version"] + 1, "RESTORE", old["data"], StructType.fromJson(json.loads(old["schema"])), last["properties"], restored=version)

    def history(self) -> DataFrame:
        """(version, timestamp, operation, parts), newest last; parts counts data folders."""
        rows = [(e["version"], e["timestamp"], e["operation"], len({f.rsplit("/", 1)[0] for f in e["data"]})) for e in self._entries()]
        return self.spark.createDataFrame(rows, "version long, timestamp double, operation string, parts int")

    def changes(self, key: Sequence[str], start: int, end: int | None = None) -> DataFrame:
        """Change feed by ``key`` of versions ``start`` to ``end``: insert, delete, update_preimage, update_postimage.

        Files that two versions share hold no change, so only the others are compared.
        """
        entries = [self._entry(v) for v in self._versions() if v >= start - 1 and (end is None or v <= end)]
        out = None
        for a, b in zip(entries, entries[1:], strict=False):
            same = set(a["data"]) & set(b["data"])
            old, new = (self._read(e, [f for f in e["data"] if f not in same]) for e in (a, b))
            feed = snapshot_changes(old, new, key).withColumn("_commit_version", F.lit(b["version"]).cast("long"))
            out = feed if out is None else out.unionByName(feed, allowMissingColumns=True)
        if out is None:
            raise ValueError("no change lies in that range")
        return out

    def optimize(self, files: int = 1, by: Sequence[str] = (), where: Column | None = None, zorder: bool = False) -> None:
        """Rewrite into ``files`` files, clustered by ranges of ``by`` or along a Z-curve over them; with ``where`` the files with such rows alone."""
        last = self._at()
        hit, rest = (last["data"], []) if where is None else self._touched(last, self._with_file(last).where(where))
        now = self._read(last, hit)
        if by and zorder:
            laid = now.withColumn("__z", z_value(now, by)).repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z")
        elif by:
            laid = now.repartitionByRange(files, *by).sortWithinPartitions(*by)
        else:
            laid = now.repartition(files)
        self._change("OPTIMIZE", laid, rest)

    def vacuum(self, keep_versions: int = 1, dry_run: bool = False, retain_hours: float = 168.0) -> list[str]:
        """Drop data folders that none of the last ``keep_versions`` versions lists and that are older than ``retain_hours``; returns their names.

        A young folder may belong to a writer that has yet to commit, so it stays.
        """
        used = {f.rsplit("/", 1)[0] for v in self._versions()[-keep_versions:] for f in self._entry(v)["data"]}
        limit = (time.time() - 3600 * retain_hours) * 1000
        found = [s for s in self._fs.listStatus(self._hadoop(self.path)) if s.getPath().getName().startswith("data-")]
        gone = sorted(s.getPath().getName() for s in found if s.getPath().getName() not in used and s.getModificationTime() <= limit)
        if not dry_run:
            for d in gone:
                self._fs.delete(self._hadoop(f"{self.path}/{d}"), True)
        return gone

    def set_properties(self, **properties: str) -> None:
        last = self._at()
        self._commit(last["version"] + 1, "SET PROPERTIES", last["data"], StructType.fromJson(json.loads(last["schema"])), {**last["properties"], **properties})

    def comment(self, **comments: str) -> None:
        """Set the comments of columns; no data is written."""
        last = self._at()
        schema = StructType.fromJson(json.loads(last["schema"]))
        fields = [StructField(f.name, f.dataType, f.nullable, {**f.metadata, "comment": comments[f.name]} if f.name in comments else f.metadata) for f in schema]
        self._commit(last["version"] + 1, "COMMENT", last["data"], StructType(fields), last["properties"])

    def alter(self, add: str = "", drop: Sequence[str] = (), rename: dict[str, str] | None = None) -> None:
        """Add columns (DDL), drop or rename some. Added and dropped ones change the schema alone; a rename writes the data anew."""
        last = self._at()
        schema = StructType.fromJson(json.loads(last["schema"]))
        extra = list(StructType.fromDDL(add)) if add else []
        if not rename:
            kept = StructType([*(f for f in schema if f.name not in drop), *extra])
            self._commit(last["version"] + 1, "ALTER", last["data"], kept, last["properties"])
            return
        kept = self.read().drop(*drop)
        for a, b in rename.items():
            kept = kept.withColumnRenamed(a, b)
        for f in extra:
            kept = kept.withColumn(f.name, F.lit(None).cast(f.dataType))
        self._change("ALTER", kept)

    def clone(self, path: str, shallow: bool = False) -> VersionedTable:
        """A copy of the current version: of its data, or ``shallow`` of the list of its files, which must then outlive this table's vacuum."""
        last = self._at()
        if not shallow:
            return VersionedTable.create(self.read(), path, last["properties"])
        made = VersionedTable(self.spark, path)
        made._commit(0, "CLONE", [self._place(f) for f in last["data"]], StructType.fromJson(json.loads(last["schema"])), last["properties"])
        return made

    def detail(self) -> dict:
        last = self._at()
        fields = json.loads(last["schema"])["fields"]
        return {
            "version": last["version"], "parts": len(last["data"]), "properties": last["properties"], "columns": [f["name"] for f in fields],
            "comments": {f["name"]: f["metadata"]["comment"] for f in fields if "comment" in f["metadata"]},
        }


def z_value(df: DataFrame, by: Sequence[str], bits: int = 8) -> Column:
    """Place on a Z-curve: the bits of each column's approximate quantile number, interleaved."""
    def number(c: str) -> Column:
        edges = sorted(set(df.approxQuantile(c, [k / (1 << bits) for k in range(1, 1 << bits)], 0.005)))  # 255 numbers a column
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(c))) if edges else F.lit(0)

    numbers = [number(c) for c in by]
    z = F.lit(0).cast("long")
    for bit in range(bits):
        for k, n in enumerate(numbers):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(n, bit).bitwiseAND(1).cast("long"), bit * len(by) + k))
    return z


def snapshot_changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that differ between two snapshots by ``key``, with ``_change_type``."""
    pack = lambda df, n: df.select(*[F.col(k).alias(f"__{n}{k}") for k in key], F.struct("*").alias(n))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"__a{k}").eqNullSafe(F.col(f"__b{k}"))
    columns = [c for c in new.columns if c in old.columns]
    met = pack(old.select(*columns), "a").join(pack(new.select(*columns), "b"), same, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    entry = lambda side, name: F.struct(F.col(side).alias("row"), F.lit(name).alias("_change_type"))
    rows = F.when(both, F.array(entry("a", "update_preimage"), entry("b", "update_postimage"))).when(
        F.col("a").isNull(), F.array(entry("b", "insert"))
    ).otherwise(F.array(entry("a", "delete")))
    return met.select(F.inline(rows)).select("row.*", "_change_type")


def _customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


def _base(t: Tables) -> VersionedTable:
    return VersionedTable.create(_customers(t), new_path(t.spark, "versioned"))


_C = "(SELECT c_custkey, c_name, c_acctbal FROM customer)"


@query(f"SELECT * FROM {_C}")
def tbl_append(t: Tables) -> DataFrame:
    building = F.col("c_mktsegment") == "BUILDING"
    parts = [t.customer.where(p).select("c_custkey", "c_name", "c_acctbal") for p in (building, ~building)]
    v = VersionedTable.create(parts[0], new_path(t.spark, "versioned"))
    v.append(parts[1])
    return v.read()


@query(f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM {_C}")
def dml_update(t: Tables) -> DataFrame:
    v = _base(t)
    v.update({"c_acctbal": F.lit(0.0), "c_name": F.upper("c_name")}, F.col("c_acctbal") < 0)
    return v.read()


@query(f"SELECT * FROM {_C} WHERE NOT (c_acctbal < 0)")
def dml_delete(t: Tables) -> DataFrame:
    v = _base(t)
    v.delete(F.col("c_acctbal") < 0)
    return v.read()


_T = "(SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 20)"
_S = "(SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey > 12)"


def _merge(t: Tables) -> VersionedTable:
    """Customers of the nations below 20, merged with those of the nations above 12."""
    rows = lambda p: t.customer.where(p).select("c_custkey", "c_name", "c_acctbal")
    v = VersionedTable.create(rows("c_nationkey < 20"), new_path(t.spark, "versioned"))
    v.merge(rows("c_nationkey > 12"), ["c_custkey"], [
        Clause("matched", "delete", F.col("t.c_acctbal") < 0), Clause("matched", "update", values={"c_acctbal": F.col("t.c_acctbal") + 100}), Clause("not_matched", "insert"),
    ])
    return v


@query(f"""SELECT t.c_custkey, t.c_name, CASE WHEN s.c_custkey IS NOT NULL THEN t.c_acctbal + 100 ELSE t.c_acctbal END AS c_acctbal FROM {_T} t LEFT JOIN {_S} s USING (c_custkey)
WHERE NOT (s.c_custkey IS NOT NULL AND t.c_acctbal < 0) UNION ALL SELECT * FROM {_S} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_T})""")
def dml_merge(t: Tables) -> DataFrame:
    return _merge(t).read()


@query(f"SELECT c_custkey, c_name, CASE WHEN c_custkey NOT IN (SELECT c_custkey FROM {_S}) THEN 0 ELSE c_acctbal END AS c_acctbal FROM {_C}")
def dml_merge_by_source(t: Tables) -> DataFrame:
    v = _base(t)
    source = t.customer.where("c_nationkey > 12").select("c_custkey", "c_name", "c_acctbal")
    v.merge(source, ["c_custkey"], [Clause("not_matched_by_source", "update", values={"c_acctbal": F.lit(0.0)})])
    return v.read()


@query(f"SELECT * FROM {_C}")
def tbl_time_travel(t: Tables) -> DataFrame:
    v = _base(t)
    v.delete(F.col("c_acctbal") > 10)
    return v.read(version=0)


@query("SELECT * FROM (VALUES (0, 'CREATE', 1), (1, 'DELETE', 1), (2, 'RESTORE', 1)) x(version, operation, parts)")
def tbl_history(t: Tables) -> DataFrame:
    v = _base(t)
    v.delete(F.col("c_acctbal") > 10)
    v.restore(0)
    return v.history().select(F.col("version").cast("int").alias("version"), "operation", "parts")


@query(f"""WITH b AS (SELECT t.* FROM {_T} t JOIN {_S} s USING (c_custkey)) SELECT *, 'delete' AS _change_type FROM b WHERE c_acctbal < 0 UNION ALL SELECT *, 'update_preimage' FROM b WHERE NOT c_acctbal < 0
UNION ALL SELECT c_custkey, c_name, c_acctbal + 100, 'update_postimage' FROM b WHERE NOT c_acctbal < 0 UNION ALL SELECT *, 'insert' FROM {_S} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_T})""")
def tbl_cdf(t: Tables) -> DataFrame:
    return _merge(t).changes(["c_custkey"], 1).drop("_commit_version")


@query(f"SELECT * FROM {_C}")
def tbl_optimize(t: Tables) -> DataFrame:
    v = _base(t)
    v.optimize(2, ["c_acctbal"])
    v.optimize(1, where=F.col("c_acctbal") < 0)
    v.vacuum(retain_hours=0)
    return v.read()


@query(f"SELECT * FROM {_C}")
def tbl_zorder(t: Tables) -> DataFrame:
    v = _base(t)
    v.optimize(4, ["c_custkey", "c_acctbal"], zorder=True)
    return v.clone(new_path(t.spark, "clone"), shallow=True).read()


@query(f"SELECT c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS note FROM {_C}")
def tbl_alter(t: Tables) -> DataFrame:
    v = _base(t)
    v.alter(add="note string", drop=["c_name"])
    v.comment(note="free text")
    return v.read()
