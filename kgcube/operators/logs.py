"""Analytics over query and ingestion logs.

A query log has id, schema_id, query_text, resolve_ms, construct_ms, merge_ms, total_ms, cache_hits,
cache_misses, quads, success, completed_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgcube.sources.tables import small, stored


def succeeded(log: DataFrame) -> DataFrame:
    return log.where("success")


#: Blocks that the different values of a column are cut into, at quantiles that a KLL sketch finds among them.
BLOCKS = 256


def percentiles(df: DataFrame, column: str, wanted: dict[str, float], *keys: str) -> DataFrame:
    """Exact percentiles, interpolated, of a column by keys, under the names given.

    Values are counted before they meet, and cut into blocks of about as many different values each. Sums by block say
    which blocks the wanted ranks fall into, and only the values of these are put in order, each block by itself: the
    sketch's error makes blocks less even, never the result less exact."""
    h = stored(df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n")))
    ranks = F.array(*(F.lit(i / BLOCKS) for i in range(1, BLOCKS)))
    found = h.agg(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col("_v").cast("double")), ranks)).first()[0] if not h.isEmpty() else []
    splits = F.array(*map(F.lit, sorted(set(found)))).cast("array<double>")
    h = h.withColumn("_b", F.size(F.filter(splits, lambda x: x < F.col("_v"))))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    b = h.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))  # at most BLOCKS rows for each of the keys
    b = b.withColumns({"_before": F.coalesce(F.sum("_m").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_last": F.sum("_m").over(w) - 1})
    places = {f"{name}_{k}": f(F.col("_last") * p) for name, p in wanted.items() for k, f in (("lo", F.floor), ("hi", F.ceil))}
    held = reduce(lambda x, y: x | y, ((at >= F.col("_before")) & (at < F.col("_before") + F.col("_m")) for at in places.values()))
    b = b.where(held).drop("_m").withColumnsRenamed({k: f"_{k}" for k in keys}).withColumnRenamed("_b", "_c")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_b") == F.col("_c"))
    x = h.join(b, same).drop("_c", *(f"_{k}" for k in keys))
    x = x.withColumn("_cum", F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_b").orderBy("_v")))
    out = x.groupBy(*keys).agg(F.max("_last").alias("_last"), *(F.min(F.when(F.col("_cum") > at, F.col("_v"))).cast("double").alias(n) for n, at in places.items()))
    part = lambda p: F.col("_last") * p - F.floor(F.col("_last") * p)
    return out.select(*keys, *((F.col(f"{n}_lo") + part(p) * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n) for n, p in wanted.items()))


def _beside(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two tables of one row for each of the keys; these may be null."""
    if not keys:
        return left.join(right, F.lit(True), "left")  # tables of one row
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, same, "left").drop(*(f"_{k}" for k in keys))


def latency(log: DataFrame, *keys: str) -> DataFrame:
    """Counts of all, and latencies of those that succeeded, with interpolated percentiles."""
    ok = F.when(F.col("success"), F.col("total_ms"))
    out = log.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("success")).alias("n_ok"), F.count_if(~F.col("success")).alias("n_error"), F.avg(ok).alias("avg_ms"), F.max(ok).alias("max_ms"))
    p = percentiles(succeeded(log), "total_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *keys)
    return _beside(out, p, *keys).select(*keys, "n", "n_ok", "n_error", "p50", "p95", "p99", "avg_ms", "max_ms")


def durations(log: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Mean, most and 95th percentile of duration columns by schema, engine or representation."""
    out = log.groupBy(*keys).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("avg", F.avg), ("max", F.max))))
    for c in columns:
        out = _beside(out, percentiles(log, c, {f"{c}_p95": 0.95}, *keys), *keys)
    return out


def phase_means(log: DataFrame) -> DataFrame:
    return succeeded(log).agg(*(F.avg(f"{c}_ms").alias(c) for c in ("resolve", "construct", "merge")))


def hit_ratio(log: DataFrame, *keys: str) -> DataFrame:
    hits, all_ = F.sum("cache_hits"), F.sum(F.col("cache_hits") + F.col("cache_misses"))
    return log.groupBy(*keys).agg(F.when(all_ > 0, hits / all_).otherwise(0.0).alias("hit_ratio"))


def rollup_cost(log: DataFrame) -> DataFrame:
    return succeeded(log).groupBy(F.col("query_text").rlike(r"(?i)\brollup\b").alias("rolled_up")).agg(F.avg("total_ms").alias("avg_ms"), F.count("*").alias("n"))


def ingested_by(files: DataFrame) -> DataFrame:
    return files.groupBy("schema_id", "engine_id").agg(F.count("*").alias("n_files"))


def distribution(df: DataFrame, column: str, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(column).alias("n"), F.sum(column).alias("total"), F.max(column).alias("most"))
    return _beside(out, percentiles(df, column, {"p50": 0.5, "p90": 0.9}, *keys), *keys)


def backlog(tasks: DataFrame, completed: DataFrame, *keys: str) -> DataFrame:
    return tasks.join(completed.select("stored_name"), "stored_name", "left_anti").groupBy(*keys).agg(F.count("*").alias("n_waiting"))


def trend(log: DataFrame, block: str = "hour") -> DataFrame:
    """Position of each successful query of a schema, the oldest first: its place in its block of time, after all that
    earlier blocks hold, so that no schema is one task."""
    ok = succeeded(log).withColumn("_block", F.date_trunc(block, "completed_at"))
    sizes = ok.groupBy("schema_id", "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy("schema_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = small(sizes.select(F.col("schema_id").alias("_schema"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    placed = ok.withColumn("_place", F.row_number().over(W.partitionBy("schema_id", "_block").orderBy("completed_at", "id")))
    same = F.col("schema_id").eqNullSafe(F.col("_schema")) & F.col("_block").eqNullSafe(F.col("_b"))
    return placed.join(offsets, same).withColumn("position", F.col("_before") + F.col("_place")).drop("_block", "_place", "_schema", "_b", "_before")


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    w = W.partitionBy("schema_id").orderBy(F.desc("completed_at"), F.desc("id"))
    return log.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= n)


def page(log: DataFrame, schema_id: str | None = None, limit: int = 20) -> DataFrame:
    rows = log if schema_id is None else log.where(F.col("schema_id") == schema_id)
    return rows.orderBy(F.desc("completed_at"), "id").limit(limit)


def rolling_hit_ratio(log: DataFrame, size: str = "5 minutes", step: str = "15 seconds") -> DataFrame:
    """Hit ratio of sliding windows, whose size is a multiple of the step; on a stream give ``log`` a watermark on
    completed_at. Events are summed by panes of one step first, and only these few rows go into all their windows."""
    panes = log.groupBy(F.window("completed_at", step).alias("pane")).agg(F.sum("cache_hits").alias("hits"), F.sum(F.col("cache_hits") + F.col("cache_misses")).alias("all"))
    windows = panes.groupBy(F.window(F.window_time("pane"), size, step).alias("w"))
    return windows.agg((F.sum("hits") / F.greatest(F.sum("all"), F.lit(1))).alias("hit_ratio")).select(F.col("w.start").alias("start"), "hit_ratio")


def stream_hit_ratio(log: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes", size: str = "5 minutes", step: str = "15 seconds") -> None:
    """Windows of a streaming log, each written once, when events may be late by no more than ``delay``; processes what is there and stops."""
    out = rolling_hit_ratio(log.withWatermark("completed_at", delay), size, step)
    q = out.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
