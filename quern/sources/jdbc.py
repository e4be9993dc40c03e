"""Tables of other databases by JDBC: written side by side, read in ranges of a key, filters and aggregates pushed to the other side."""

from __future__ import annotations

import csv
import glob
import os
import re
import shutil
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession

from quern.sources.files import work_dir

#: The database that comes with Spark's jars, in this JVM.
DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
#: Rows that go in one batch or are fetched at once.
BATCH_ROWS = 10_000
#: Column types of Derby; texts are CLOB unless others are asked for.
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "float": "REAL", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "string": "CLOB"}


def quoted(name: str) -> str:
    """An identifier as Spark writes it to tables it makes: in quotation marks, its case kept."""
    return '"' + name.replace('"', '""') + '"'


def local_database(spark: SparkSession) -> str:
    """The address of a new database in a folder of this machine, for local runs: executors of a cluster can't open it, so there it is an error.

    Its folder goes when the JVM ends.
    """
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("an embedded database is in one JVM only; give the address of a database server")
    path = work_dir(spark).removeprefix("file:").replace("//", "/")
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:{path};create=true"


def _load(folder: str, name: str, columns: list[tuple[str, str]], batches: Iterator[pa.RecordBatch]) -> str:
    """Loads rows into a new database by Derby's own command line, and packs it below ``folder`` as a jar, which any number of JVMs can open; its path."""
    with tempfile.TemporaryDirectory() as own:
        with open(f"{own}/rows.csv", "w", newline="", encoding="utf-8") as out:
            rows = csv.writer(out, quoting=csv.QUOTE_STRINGS, lineterminator="\n")
            for batch in batches:
                columns_of = [[v if v is None or isinstance(v, (int, float, str)) else str(v) for v in c.to_pylist()] for c in batch.columns]
                rows.writerows(zip(*columns_of, strict=True))
        with open(f"{own}/load.sql", "w", encoding="utf-8") as out:
            made = ", ".join(f"{quoted(c)} {t}" for c, t in columns)
            out.write(f"CONNECT 'jdbc:derby:{own}/db;create=true';\nCREATE TABLE {name} ({made});\n")
            out.write(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{own}/rows.csv', ',', '\"', 'UTF-8', 0);\nDISCONNECT;\n")
            out.write(f"CONNECT 'jdbc:derby:{own}/db;shutdown=true';\n")
        jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
        home = os.environ.get("JAVA_HOME")
        java = [f"{home}/bin/java" if home else "java", "-Xmx256m", f"-Dderby.stream.error.file={own}/derby.log", "-cp", ":".join(glob.glob(f"{jars}/derby*.jar")), "org.apache.derby.tools.ij", f"{own}/load.sql"]
        told = subprocess.run(java, capture_output=True, text=True).stdout
        failed = [x for x in re.findall(r"^ERROR (\w+)", told, re.M) if x != "08006"]  # 08006: the database has been shut down, as it should be
        if failed or "ERROR 08006" not in told:
            raise RuntimeError(f"the database was not loaded: {told[-2000:]}")
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_STORED) as jar:  # stored, so that a page is found without reading those before it
            for at, _, names in os.walk(f"{own}/db"):
                for n in names:
                    if not n.endswith(".lck"):
                        jar.write(f"{at}/{n}", os.path.relpath(f"{at}/{n}", own))
        shutil.move(f"{path}.part", path)
        return path


def write_shards(df: DataFrame, table: str, shards: int = 8, types: dict[str, str] | None = None) -> list[str]:
    """The addresses of up to ``shards`` new embedded databases, each with a part of df as ``table``: what a cluster can read without a database server.

    An embedded database is open for writing in one JVM only. So each task loads one of its own, and packs it below the folder that the driver and all executors share, which has to be a
    folder of the machine's file system; from there any number of them read it. No row comes to the driver. Databases without rows hold the columns.
    """
    path = work_dir(df.sparkSession)
    if not re.match(r"(file:)?/", path):
        raise ValueError("embedded databases need a shared folder that is mounted; give the address of a database server")
    folder = re.sub(r"^(file:)?/+", "/", path)
    unknown = [c for c, t in df.dtypes if t not in _TYPES and c not in (types or {})]
    if unknown:
        raise ValueError(f"name the types of {', '.join(unknown)}")
    columns = [(c, (types or {}).get(c) or _TYPES[t]) for c, t in df.dtypes]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"path": [_load(folder, table, columns, batches)]})

    paths = [r["path"] for r in df.repartition(shards).mapInArrow(load, "path string").collect()]
    paths = paths or [_load(folder, table, columns, iter([]))]  # Spark runs no task where it knows that there are no rows
    return [f"jdbc:derby:jar:({p})db" for p in paths]


def read_shards(spark: SparkSession, urls: list[str], table: str, driver: str, key: str | None = None, connections: int = 8) -> DataFrame:
    """The rows of a table that is dealt over databases, each read as by :func:`read`; filters and columns go to all of them."""
    return reduce(DataFrame.unionByName, [read(spark, u, table, driver, key, max(1, connections // len(urls))) for u in urls])


def ask_shards(spark: SparkSession, urls: list[str], sql: str, driver: str) -> DataFrame:
    """The rows of a query that each of several databases runs over its part of a table: partial results, for a further aggregate."""
    return reduce(DataFrame.unionByName, [ask(spark, u, sql, driver) for u in urls])


def write(df: DataFrame, url: str, table: str, driver: str, connections: int = 8, types: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Writes df over at most ``connections`` connections, each a transaction a partition.

    ``types`` are column types of the other database where its default doesn't do (texts that are compared, say).
    """
    writer = df.coalesce(connections).write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).option("driver", driver).option("batchsize", BATCH_ROWS)
    if types:
        writer = writer.option("createTableColumnTypes", ", ".join(f"{c} {t}" for c, t in types.items()))
    writer.save()


def ask(spark: SparkSession, url: str, sql: str, driver: str) -> DataFrame:
    """The rows of a query that the other database runs, over one connection: for aggregates and other small results."""
    return spark.read.format("jdbc").option("url", url).option("driver", driver).option("query", sql).option("preferTimestampNTZ", "true").load()


def read(spark: SparkSession, url: str, table: str, driver: str, key: str | None = None, connections: int = 8) -> DataFrame:
    """A table, read in ranges of a whole-number ``key`` between its least and greatest value, which the other database is asked for.

    Filters on the result, and the columns that are used, go to the other database. Rows with a null key come with the first range. Without a key, or
    without a value in it, there is one connection.
    """
    rows = spark.read.format("jdbc").option("url", url).option("driver", driver).option("dbtable", table).option("fetchsize", BATCH_ROWS).option("preferTimestampNTZ", "true")
    if key is not None:
        low, high = ask(spark, url, f'SELECT min({quoted(key)}) AS "low", max({quoted(key)}) AS "high" FROM {table}', driver).first()
        if low is not None and high > low:
            rows = rows.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1)
            rows = rows.option("numPartitions", max(1, min(connections, int(high) - int(low) + 1)))
    return rows.load()
