"""Tables that cut the lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own: dict[str, str] = {}

#: Rows of a dimension or group table that are broadcast at most.
MOST_BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder. Where neither is set a local
    master, as in tests, gets a temporary folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A new folder below the application's own, which goes when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_folder(spark)}/kgcube-{sc.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write a table to the shared folder and read it again; this cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of what lies in a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """With a hint to broadcast it, if it has few rows; a larger table is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes of text that are broadcast at most, and what a row has besides.
MOST_BROADCAST_BYTES, ROW_BYTES = 64 << 20, 48


def light(df: DataFrame, *texts: str) -> DataFrame:
    """The same for a stored table of short rows, by the bytes of its text columns."""
    size = df.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in texts), F.lit(ROW_BYTES))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= MOST_BROADCAST_BYTES else df


def local(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A few rows that the plan itself holds, so that reading or broadcasting them takes no job."""
    fields = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


def held(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """A small table read once, to be broadcast without a job; a larger one is stored and joined by a shuffle."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(local(df.sparkSession, rows, df.schema)) if len(rows) <= most else stored(df)
