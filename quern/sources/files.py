"""Reading and writing tables in the file formats that Spark has built in."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "xml", "text")
_OPTIONS = {"csv": {"header": "true"}, "xml": {"rowTag": "row", "rootTag": "rows"}}
_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A new path below the cluster's shared folder (spark.checkpoint.dir), or in local runs below a temporary one.

    Its folder goes when the JVM ends, with what else is put there.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not top:
        top = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-quern-"))
    folder = f"{top}/files-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return f"{folder}/data"


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] = (), **options: str) -> None:
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    writer = df.write.format(kind).options(**_OPTIONS.get(kind, {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: StructType | None = None, **options: str) -> DataFrame:
    """Reads with a given schema where the format doesn't carry one; nothing is inferred from the data."""
    reader = spark.read.format(kind).options(**_OPTIONS.get(kind, {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def round_trip(df: DataFrame, kind: str, partition_by: list[str] = ()) -> DataFrame:
    """df, written and read again."""
    path = work_dir(df.sparkSession)
    write(df, path, kind, partition_by)
    return read(df.sparkSession, path, kind, None if kind in ("parquet", "orc") else df.schema).select(*df.columns)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modification time of files, without their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
