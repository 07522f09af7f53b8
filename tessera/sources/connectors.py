"""Connector sources and sinks whose drivers are not part of Spark, and a paged REST source.

JDBC and Kafka need their jars on the class path; the builders here state the
options, and the parsing stage is shared with file streams.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def jdbc_options(
    url: str, table: str = "", query: str = "", driver: str = "", partition_column: str = "", lower: int | None = None, upper: int | None = None, partitions: int = 8, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column it is read in parallel. The bounds part the range and filter nothing."""
    if bool(table) == bool(query):
        raise ValueError("name a table or a query")
    found = {"url": url, "fetchsize": str(fetch_size), "dbtable" if table else "query": table or query}
    if driver:
        found["driver"] = driver
    if partition_column:
        if query or lower is None or upper is None:
            raise ValueError("a partitioned read needs a table and both bounds")
        found |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return found


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, truncate: bool = False) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), truncate=str(truncate).lower()).mode(mode).save()


def kafka_options(servers: str, topic: str, starting: str = "earliest", per_trigger: int | None = None, sasl_jaas: str = "") -> dict[str, str]:
    """Options of a Kafka read, with SASL where a login is given."""
    found = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if per_trigger:
        found["maxOffsetsPerTrigger"] = str(per_trigger)
    if sasl_jaas:
        found |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": sasl_jaas}
    return found


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(**options)).load()


def parsed_messages(messages: DataFrame, schema: StructType | str) -> DataFrame:
    """Fields of JSON message values; a value that does not parse gives nulls and keeps its text in ``_raw``."""
    text = F.col("value").cast("string")
    read = messages.select(F.from_json(text, schema).alias("m"), text.alias("_text"))
    empty = F.forall(F.map_values(F.from_json(F.to_json("m"), "map<string,string>")), lambda v: v.isNull())
    return read.select("m.*", F.when(F.col("m").isNull() | empty, F.col("_text")).alias("_raw"))


class RestSource(DataSource):
    """``format("rest")``: JSON arrays of objects from ``url`` with ``{page}``, pages 0 to ``pages`` - 1, a task each; needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        raise ValueError("a REST read needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RestReader(dict(self.options), [f.name for f in schema])


class _RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.url, self.pages, self.names, self.timeout = options["url"], int(options.get("pages", "1")), names, float(options.get("timeout", "30"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with urllib.request.urlopen(self.url.replace("{page}", str(partition.value)), timeout=self.timeout) as answer:
            for row in json.load(answer):
                yield tuple(row.get(n) for n in self.names)
