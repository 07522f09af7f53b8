"""File sources and sinks: CSV, JSON, Parquet, ORC, XML, text, binary; audit columns; incremental ingest."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.operators.catalog import Tables, query
from tessera.plans.storage import new_path, written

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc", ".xml": "xml", ".txt": "text", ".avro": "avro"}
_CORRUPT = "_corrupt_record"


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None, audit: bool = True, **options: str) -> DataFrame:
    """Read by the extension of ``path``; with ``audit`` adds the source file and the load time."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1])
    if kind is None:
        raise ValueError(f"no format is known for {path}")
    reader = spark.read.format(kind).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.withColumns({"_source_file": F.col("_metadata.file_path"), "_load_timestamp": F.current_timestamp()}) if audit else df


def read_csv_checked(spark: SparkSession, path: str | list[str], schema: StructType, **options: str) -> tuple[DataFrame, DataFrame]:
    """(clean, corrupt) rows of CSV files under an explicit schema; corrupt ones keep their raw text.

    The files are parsed once, into the shared folder, as Spark allows no query of the corrupt text alone.
    """
    wide = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    read = spark.read.options(**{"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, **options}).schema(wide).csv(path)
    audited = written(read.withColumns({"_source_file": F.col("_metadata.file_path"), "_load_timestamp": F.current_timestamp()}), "csv")
    return audited.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT), audited.where(F.col(_CORRUPT).isNotNull())


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", by: list[str] | None = None, compression: str | None = None, rows_per_file: int | None = None, dynamic: bool = False) -> None:
    """Write with the common choices: mode, partition columns, codec, file size, dynamic partition overwrite."""
    writer = df.write.format(kind).mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if compression:
        writer = writer.option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int = 16) -> None:
    """A managed table bucketed and sorted by ``key``: equi-joins of two such tables need no exchange."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(name)


class Ingest:
    """Incremental ingest of a folder: new files only, an inferred and kept schema, unread fields in ``_rescued_data``."""

    def __init__(self, spark: SparkSession, source: str, state: str, kind: str = "json", hints: str = "") -> None:
        self.spark, self.source, self.state, self.kind, self.hints = spark, source, state, kind, hints

    def schema(self) -> StructType:
        """The kept schema; inferred from the source and kept on the first call. Read through Spark, so any store serves."""
        place = f"{self.state}/schema"
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(conf).exists(path):
            return StructType.fromJson(json.loads(self.spark.read.text(place, wholetext=True).first()[0]))
        found = self.spark.read.format(self.kind).load(self.source).schema
        if self.hints:
            hinted = {f.name: f for f in StructType.fromDDL(self.hints)}
            found = StructType([hinted.get(f.name, f) for f in found])
        self.spark.range(1).select(F.lit(found.json()).alias("value")).coalesce(1).write.text(place)
        return found

    def run(self, target: str) -> None:
        """Append all files that have come since the last run to the Parquet folder ``target``, exactly once."""
        schema = self.schema()
        raw = self.spark.readStream.text(self.source) if self.kind == "json" else None
        if raw is None:
            stream = self.spark.readStream.format(self.kind).schema(schema).load(self.source)
        else:
            known = F.from_json("value", schema)
            every = F.from_json("value", "map<string,string>")
            rest = F.map_filter(every, lambda k, _: ~k.isin([f.name for f in schema]))
            stream = raw.select(known.alias("r"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("_rescued_data")).select("r.*", "_rescued_data")
        done = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
        done.awaitTermination()


_CUST = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def _cust(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


def _landed(t: Tables, kind: str, **options: str) -> str:
    path = new_path(t.spark, kind) + ("" if kind == "glob" else f".{kind}")
    _cust(t).write.format("csv" if kind == "glob" else kind).options(**options).save(path)
    return path


@query(_CUST)
def scan_csv(t: Tables) -> DataFrame:
    path = _landed(t, "csv", header="true")
    return read_any(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double", audit=False, header="true")


@query("SELECT * FROM (VALUES (1, 'a', NULL), (2, 'b', NULL), (NULL, 'c', 'x,c')) v(id, name, corrupt)")
def scan_csv_modes(t: Tables) -> DataFrame:
    lines = t.spark.createDataFrame([("1,a",), ("2,b",), ("x,c",)], "value string")
    path = new_path(t.spark, "modes")
    lines.coalesce(1).write.text(path)
    read = t.spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").schema("id int, name string, corrupt string").csv(path)
    return read.select("id", "name", "corrupt")


def _lines(t: Tables, *lines: str) -> str:
    path = new_path(t.spark, "lines")
    t.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(id, name)")
def scan_csv_drop(t: Tables) -> DataFrame:
    """Malformed lines are dropped."""
    return t.spark.read.option("mode", "DROPMALFORMED").schema("id int, name string").csv(_lines(t, "1,a", "x,c", "2,b", "3,d,e,f"))


@query("SELECT true AS failed")
def scan_csv_failfast(t: Tables) -> DataFrame:
    """A malformed line fails the read."""
    try:
        t.spark.read.option("mode", "FAILFAST").schema("id int, name string").csv(_lines(t, "1,a", "x,c")).collect()
        failed = False
    except (PySparkException, Py4JJavaError):
        failed = True
    return t.spark.createDataFrame([(failed,)], "failed boolean")


@query("SELECT * FROM (VALUES (1, 'a', NULL), (2, NULL, 5)) v(id, name, extra)")
def scan_json_multiline(t: Tables) -> DataFrame:
    """Documents over several lines, with fields that some lack."""
    path = _lines(t, "[{", '"id": 1, "name": "a"', "}, {", '"id": 2,', '"extra": 5}]')
    return t.spark.read.option("multiLine", True).schema("id int, name string, extra int").json(path)


@query("SELECT c_custkey AS id, c_name AS name, NULL AS balance FROM customer WHERE c_nationkey < 12 UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer WHERE c_nationkey >= 12")
def scan_merge_schema(t: Tables) -> DataFrame:
    """Parquet files of two schemas, read as one."""
    base, low = new_path(t.spark, "merged"), F.col("c_nationkey") < 12
    t.customer.where(low).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.parquet(f"{base}/p=1")
    t.customer.where(~low).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")).write.parquet(f"{base}/p=2")
    return t.spark.read.option("mergeSchema", "true").parquet(base).select("id", "name", "balance")


@query("SELECT c_custkey, c_nationkey FROM customer")
def scan_rdd(t: Tables) -> DataFrame:
    """Rows of an RDD under an explicit schema."""
    return t.spark.createDataFrame(t.customer.select("c_custkey", "c_nationkey").rdd.map(tuple), "c_custkey long, c_nationkey int")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey")
def sink_codecs(t: Tables) -> DataFrame:
    """One third each through snappy, gzip and zstd Parquet files."""
    base = new_path(t.spark, "codecs")
    for k, codec in enumerate(("snappy", "gzip", "zstd")):
        _cust(t).where(F.pmod("c_custkey", F.lit(3)) == k).write.option("compression", codec).parquet(f"{base}/{codec}")
    return t.spark.read.option("recursiveFileLookup", "true").schema(_cust(t).schema).parquet(base)


@query("SELECT count(*) AS n FROM customer")
def sink_tables(t: Tables) -> DataFrame:
    """saveAsTable, then insertInto, by way of the catalog."""
    name = f"tessera_{uuid.uuid4().hex[:12]}"
    rows = t.customer.select("c_custkey", "c_nationkey")
    low = F.col("c_nationkey") < 12
    try:
        rows.where(low).write.saveAsTable(name)
        rows.where(~low).write.insertInto(name)
        n = t.spark.table(name).count()
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS {name}")
    return t.spark.createDataFrame([(n,)], "n long")


@query("SELECT count(*) AS n, CAST(2 AS BIGINT) AS folders FROM (SELECT 1 FROM customer UNION ALL SELECT 1 FROM customer)")
def scan_glob(t: Tables) -> DataFrame:
    base = new_path(t.spark, "glob")
    for part in ("sales_a", "sales_b"):
        _cust(t).write.csv(f"{base}/{part}")
    read = t.spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").csv(f"{base}/sales_*")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "(sales_[a-z])", 1)
    return read.agg(F.count("*").alias("n"), F.count_distinct(folder).alias("folders"))


@query(_CUST)
def scan_json(t: Tables) -> DataFrame:
    return read_any(t.spark, _landed(t, "json"), "c_custkey bigint, c_name string, c_acctbal double", audit=False)


@query(_CUST)
def scan_orc(t: Tables) -> DataFrame:
    return read_any(t.spark, _landed(t, "orc"), audit=False)


@query(_CUST)
def scan_xml(t: Tables) -> DataFrame:
    path = _landed(t, "xml", rowTag="customer")
    return read_any(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double", audit=False, rowTag="customer")


@query("SELECT r_regionkey, r_name FROM region")
def scan_binary(t: Tables) -> DataFrame:
    path = new_path(t.spark, "binary")
    t.region.select(F.concat_ws(",", "r_regionkey", "r_name").alias("value")).write.text(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    rows = files.select(F.explode(F.split(F.trim(F.col("content").cast("string")), "\n")).alias("line")).where("line <> ''")
    return rows.select(F.split("line", ",")[0].cast("int").alias("r_regionkey"), F.split("line", ",")[1].alias("r_name"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def scan_partitioned(t: Tables) -> DataFrame:
    path = new_path(t.spark, "partitioned")
    write(t.orders.select("o_orderkey", "o_orderstatus"), path, by=["o_orderstatus"])
    return t.spark.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


for _name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():

    def _scan(t: Tables, name: str = _name) -> DataFrame:
        return getattr(t, name)

    _scan.__name__ = f"scan_parquet_{_name}"
    query(f"SELECT * FROM {_name}")(_scan)


@query("SELECT * FROM range(0, 1000, 7) r(id)")
def scan_range(t: Tables) -> DataFrame:
    return t.spark.range(0, 1000, 7, 4)


@query("SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, NULL")
def scan_memory(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")


@query(_CUST)
def stream_autoload(t: Tables) -> DataFrame:
    base = new_path(t.spark, "autoload")
    parts = [_cust(t).where(f"c_custkey % 2 = {k}") for k in (0, 1)]
    job = Ingest(t.spark, f"{base}/in", f"{base}/state")
    for part in parts:  # the second run sees the second part's files alone
        part.write.mode("append").json(f"{base}/in")
        job.run(f"{base}/out")
    return t.spark.read.parquet(f"{base}/out").select("c_custkey", "c_name", "c_acctbal")
