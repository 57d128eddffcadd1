"""Stored raw files of a schema, and their registration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgcube.functions import paths
from kgcube.sources.tables import small

SCHEMA_ID = "^[a-z][a-z0-9_-]*$"


def checked(schema_id: str) -> str:
    if not re.match(SCHEMA_ID, schema_id):
        raise ValueError(f"bad schema id {schema_id!r}")
    return schema_id


#: Folders by hash of the name that raw messages of a schema lie in, and names that go down to the scan as a list.
RAW_BUCKETS, LISTED = 32, 1000
#: Bits of a filter of names: a name has eight, up to 16 MB in all.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27


def _bucket(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(RAW_BUCKETS)).cast("int")


def write_raw(raw: DataFrame, root: str, schema_id: str) -> None:
    """raw(stored_name, content) below the schema's folder: small files in few objects, by hash of the name and sorted by it."""
    rows = raw.select("stored_name", "content", _bucket(F.col("stored_name")).alias("bucket"))
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "stored_name")  # a bucket has as many tasks as its size asks for, so that none sorts more than it can hold
    rows.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/{checked(schema_id)}")


def is_set(bits: Column, bit: Column) -> Column:
    """Is a bit of a bitmap set?"""
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0


def likely(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of all of names(stored_name), and of few others, by a broadcast of bits of the names' hashes: nothing is shuffled."""
    n, places = names.count(), LEAST_BITS
    while places < min(8 * n, MOST_BITS):
        places *= 2

    def marked(rows: DataFrame) -> DataFrame:
        place = F.pmod(F.shiftright(F.xxhash64("stored_name"), 16), F.lit(places))
        return rows.withColumns({"_chunk": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})

    bits = marked(names.select("stored_name")).groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    return marked(df).join(F.broadcast(bits), "_chunk").where(is_set(F.col("_bits"), F.col("_bit"))).drop("_chunk", "_bit", "_bits")


def read_raw(spark: SparkSession, root: str, schema_id: str, names: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """All raw messages of a schema; with names(stored_name), a stored table, only these, from the buckets that they lie in, and
    for a few names also by the statistics of the files. Unless ``exact``, some others may be among them; no text is
    shuffled then, however many the names are."""
    df = spark.read.schema("stored_name string, content string, bucket int").parquet(f"{root}/{checked(schema_id)}")
    if names is not None:
        few = [r["stored_name"] for r in names.select("stored_name").limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, few)).cast("array<string>")).alias("n")).select(_bucket(F.col("n")).alias("b")).distinct()
            df = df.where(F.col("bucket").isin([r["b"] for r in wanted.collect()]) & F.col("stored_name").isin(few))
        else:
            df = likely(df, names)
            df = df.join(names.select("stored_name"), "stored_name", "left_semi") if exact else df
    return df.select("stored_name", "content", F.lit(schema_id).alias("schema_id"), F.octet_length("content").cast("long").alias("size_bytes"))


def read_files(spark: SparkSession, root: str, schema_id: str) -> DataFrame:
    """One row a file of any name below {root}/{schema_id}."""
    df = spark.read.format("binaryFile").load(f"{root}/{checked(schema_id)}")
    return df.select(F.lit(schema_id).alias("schema_id"), F.regexp_extract("path", "[^/]*$", 0).alias("stored_name"), F.col("content").cast("string").alias("content"), F.col("length").alias("size_bytes"))


def engine_by_id(files: DataFrame, engines: DataFrame) -> DataFrame:
    """files(stored_name, engine_id, ...) with the engine's own spelling of its id, whatever the case, and ``status``,
    not null for an unknown one. engines(engine_id, ...) has a row for each media type."""
    known = small(engines.groupBy(F.lower("engine_id").alias("_key")).agg(F.min("engine_id").alias("_id")))
    out = files.join(known, F.lower("engine_id") == F.col("_key"), "left")
    return out.withColumns({"engine_id": F.coalesce("_id", "engine_id"), "status": F.when(F.col("_id").isNull(), "unknown engine")}).drop("_key", "_id")


def with_engine(files: DataFrame, engines: DataFrame) -> DataFrame:
    """engines(engine_id, media_type, priority); media types compare without case, the first match counts."""
    e = engines.groupBy(F.lower("media_type").alias("_m")).agg(F.min_by("engine_id", "priority").alias("engine_id"))
    return files.join(e, F.lower("media_type") == F.col("_m"), "left").drop("_m")


def register_files(raw: DataFrame, engines: DataFrame) -> DataFrame:
    """raw(original_name, media_type, content): stored name from the name's content hash, size and engine; no engine gives a status."""
    name = F.concat(F.substring(F.sha2(F.concat_ws("|", "original_name", "content"), 256), 1, 16), F.lit("_"), paths.safe_name(F.col("original_name")))
    out = with_engine(raw, engines).withColumns({"stored_name": name, "size_bytes": F.octet_length("content").cast("long")})
    return out.withColumn("status", F.when(F.col("engine_id").isNull(), "no engine"))
