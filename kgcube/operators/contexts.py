"""Contexts (cube cells): scope, covering, roll-up and propagation of knowledge, index tables.

A context row has ``context_id`` and one path column per dimension; a link row ties a stored file to one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgcube.functions import paths
from kgcube.plans.cube import Cube
from kgcube.sources.files import checked, is_set
from kgcube.sources.tables import delete, exists, small, stored

Scope = dict[str, list[str]]


def level_columns(cube: Cube, df: DataFrame) -> DataFrame:
    """A scalar column for each level; predicates on these reach a Parquet scan, those on paths don't."""
    return df.withColumns({f"{d.name}_{x}": F.get(F.col(d.name), F.lit(k)) for d in cube.dimensions for k, x in enumerate(d.names)})


def slice_(cube: Cube, ctx: DataFrame, dimension: str, path: list[str]) -> DataFrame:
    names = cube.dimension(dimension).names
    for k, v in enumerate(path):
        col = f"{dimension}_{names[k]}"
        ctx = ctx.where((F.col(col) if col in ctx.columns else F.get(F.col(dimension), F.lit(k))) == v)
    return ctx


def dice(cube: Cube, ctx: DataFrame, scope: Scope) -> DataFrame:
    """Contexts at or below the scope in every dimension that it names; an empty scope selects all."""
    return reduce(lambda df, item: slice_(cube, df, *item), scope.items(), ctx)


def covering(ctx: DataFrame, scope: Scope) -> DataFrame:
    """Contexts comparable with the scope in all its dimensions and coarser in one; none for an empty scope."""
    comparable, coarser = F.lit(True), F.lit(False)
    for d, path in scope.items():
        m = F.least(F.size(d), F.lit(len(path)))
        comparable = comparable & (F.slice(d, F.lit(1), m) == F.slice(paths.lit_path(path), F.lit(1), m))
        coarser = coarser | (F.size(d) < len(path))
    return ctx.where(comparable & coarser)


def rolled(cube: Cube, rho: dict[str, int]) -> dict[str, Column]:
    """Path columns cut to the merge levels; other dimensions as they are."""
    return {d: paths.prefix(F.col(d), rho[d] + 1) if d in rho else F.col(d) for d in cube.names}


def roll_up(cube: Cube, ctx: DataFrame, rho: dict[str, int]) -> DataFrame:
    """Add ``final_id``, the id of the rolled-up cell, and its paths as f_<dimension>."""
    out = ctx.withColumns({f"f_{d}": c for d, c in rolled(cube, rho).items()})
    ids = [paths.hierarchy_id(d.name, d.names, F.col(f"f_{d.name}")) for d in cube.dimensions]
    return out.withColumn("final_id", paths.context_id(ids))


def merge_cells(cube: Cube, specific: DataFrame, rho: dict[str, int]) -> DataFrame:
    """Final cells with the number of contexts merged into each."""
    return roll_up(cube, specific, rho).groupBy("final_id", *(f"f_{d}" for d in cube.names)).agg(F.count("*").alias("n_contexts"))


def ancestor_pairs(cube: Cube, fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(fine_id, coarse_id) where the fine context rolls up to the coarse one, without a theta join.

    The coarse side has few shapes (numbers of members in each dimension, at most the product of the
    level counts). Each fine context is cut to every shape that fits it, and the id of the cut cell
    joins the coarse side by equality.
    """
    shape = [F.size(d).alias(f"_{d}") for d in cube.names]
    shapes = coarse.select(*shape).distinct()
    fits = reduce(lambda a, b: a & b, (F.size(d) >= F.col(f"_{d}") for d in cube.names))
    cut = fine.join(F.broadcast(shapes), fits)  # bounded: one row for each combination of levels
    ids = [paths.hierarchy_id(d.name, d.names, paths.prefix(F.col(d.name), F.col(f"_{d.name}"))) for d in cube.dimensions]
    keyed = cut.select(F.col("context_id").alias("fine_id"), paths.context_id(ids).alias("coarse_id"))
    return keyed.join(coarse.select(F.col("context_id").alias("coarse_id")).distinct(), "coarse_id", "left_semi").select("fine_id", "coarse_id")


def knowledge(cube: Cube, ctx: DataFrame, scope: Scope, rho: dict[str, int]) -> DataFrame:
    """(context_id, final_id): a stored context feeds the final cells of the specific ones at or below it."""
    specific = dice(cube, ctx, scope)
    sources = specific.unionByName(covering(ctx, scope))
    finals = roll_up(cube, specific, rho).select(F.col("context_id").alias("fine_id"), "final_id")
    pairs = ancestor_pairs(cube, specific, sources)
    return pairs.join(finals, "fine_id").select(F.col("coarse_id").alias("context_id"), "final_id").distinct()


def coverage(cube: Cube, ctx: DataFrame, scope: Scope, rho: dict[str, int]) -> DataFrame:
    """(final_id, context_id): the specific contexts that a final cell covers, itself left out."""
    known = knowledge(cube, ctx, scope, rho)
    leaves = dice(cube, ctx, scope).select("context_id")
    return known.join(leaves, "context_id", "left_semi").where("context_id <> final_id").select("final_id", "context_id")


def final_cells(cube: Cube, ctx: DataFrame, scope: Scope, rho: dict[str, int]) -> DataFrame:
    return roll_up(cube, dice(cube, ctx, scope), rho).select("final_id", *(F.col(f"f_{d}").alias(d) for d in cube.names)).distinct()


# --- index tables -------------------------------------------------------------------------------


def contexts_of(cube: Cube, links: DataFrame) -> DataFrame:
    """Distinct contexts of links; missing dimensions are ALL."""
    padded = links.withColumns({d: F.coalesce(F.col(d), paths.all_path()) if d in links.columns else paths.all_path() for d in cube.names})
    return padded.select(*cube.names).distinct().withColumn("context_id", cube.context_id())


def context_dim(cube: Cube, ctx: DataFrame) -> DataFrame:
    """(dimension, hierarchy_id, text, context_id), the normalised form of the index."""
    parts = [F.struct(F.lit(d.name).alias("dimension"), paths.hierarchy_id(d.name, d.names, F.col(d.name)).alias("hierarchy_id"), paths.label(d.name, F.col(d.name)).alias("label")) for d in cube.dimensions]
    return ctx.select("context_id", F.explode(F.array(*parts)).alias("x")).select("x.*", "context_id")


def inverted_index(cube: Cube, ctx: DataFrame) -> DataFrame:
    return context_dim(cube, ctx).groupBy("dimension", "hierarchy_id").agg(F.count("*").alias("n_contexts"), F.min("context_id").alias("first_context"))


#: Contexts that the bits of one posting tell apart.
CHUNK = 1 << 15


def ordinals(ctx: DataFrame) -> DataFrame:
    """(ordinal, chunk, bit, context_id): contexts numbered from 0 without gaps; a stored table."""
    rows = stored(ctx.select("context_id").withColumns({"task": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    tasks = rows.groupBy("task").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    base = tasks.select("task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    ordinal = F.col("row") + F.col("shift")
    return stored(rows.join(F.broadcast(base), "task").select(ordinal.alias("ordinal"), F.floor(ordinal / CHUNK).alias("chunk"), F.pmod(ordinal, F.lit(CHUNK)).alias("bit"), "context_id"))


def postings(cube: Cube, ctx: DataFrame, numbers: DataFrame) -> DataFrame:
    """(dimension, hierarchy_id, chunk, bits): for each hierarchy, ALL included, which contexts are at or below it. A
    posting is cut into chunks of CHUNK contexts, so that no row or task holds all contexts of a value."""
    def above(d) -> Column:
        one = lambda n: F.struct(F.lit(d.name).alias("dimension"), paths.hierarchy_id(d.name, d.names, paths.prefix(F.col(d.name), n)).alias("hierarchy_id"))
        return F.transform(F.sequence(F.lit(0), F.size(d.name)), one)

    rows = ctx.select("context_id", F.explode(F.flatten(F.array(*(above(d) for d in cube.dimensions)))).alias("h")).join(numbers, "context_id")
    return rows.groupBy("h.dimension", "h.hierarchy_id", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))


def select_bits(cube: Cube, posted: DataFrame, scope: Scope) -> DataFrame:
    """(chunk, bits): the contexts of a scope, by intersecting a posting for each dimension that it names, chunk by
    chunk; those of an empty scope are the postings of ALL in the first dimension."""
    named = scope or {cube.names[0]: []}
    wanted = [F.struct(F.lit(d).alias("dimension"), paths.hierarchy_id(d, cube.dimension(d).names, paths.lit_path(path) if path else paths.all_path()).alias("hierarchy_id")) for d, path in named.items()]
    keys = posted.sparkSession.range(1).select(F.explode(F.array(*wanted)).alias("k")).select("k.*")
    found = posted.join(F.broadcast(keys), ["dimension", "hierarchy_id"])  # a row a dimension
    both = found.groupBy("chunk").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.where(F.col("n") == len(named)).select("chunk", "bits")


def of_bits(selected: DataFrame, numbers: DataFrame) -> DataFrame:
    """(context_id) of the bits that are set."""
    return numbers.join(selected, "chunk").where(is_set(F.col("bits"), F.col("bit"))).select("context_id")


def canonical(rows: DataFrame, out: str, *keys: str) -> DataFrame:
    """Hierarchies (dimension, hierarchy_id) of each of the keys numbered in canonical order; this order makes ids."""
    w = W.partitionBy(*keys).orderBy("dimension", "hierarchy_id")
    return rows.withColumn(out, F.row_number().over(w).cast("long"))


def corrupt_tuples(cube: Cube, ctx: DataFrame) -> DataFrame:
    """Coordinates with more than one context id."""
    return ctx.groupBy(*cube.names).agg(F.count_distinct("context_id").alias("n_ids")).where("n_ids > 1")


def specific_by_intersection(cube: Cube, ctx: DataFrame, scope: Scope) -> DataFrame:
    """Like dice, from the normalised index: contexts with a matching row in every named dimension."""
    out = ctx.select("context_id")
    for d, path in scope.items():
        names = cube.dimension(d)
        rows = ctx.select(F.lit(d).alias("dimension"), "context_id", F.col(d).alias("path"))
        out = out.join(rows.where(paths.starts_with(F.col("path"), paths.lit_path(path[: len(names.names)]))).select("context_id"), "context_id", "left_semi")
    return out


def files_of(ctx: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(ctx.select("context_id").distinct(), "context_id", "left_semi")


def orphan_contexts(ctx: DataFrame, links: DataFrame) -> DataFrame:
    return ctx.join(links.select("context_id"), "context_id", "left_anti")


def unindexed_files(files: DataFrame, links: DataFrame) -> DataFrame:
    return files.join(links.select("stored_name"), "stored_name", "left_anti")


def engine_of_context(links: DataFrame) -> DataFrame:
    return links.groupBy("context_id").agg(F.max_by("engine_id", "stored_name").alias("engine_id"))


def schema_stats(cube: Cube, ctx: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    h = context_dim(cube, ctx).agg(F.count_distinct("hierarchy_id").alias("n_hierarchies"))
    c = ctx.agg(F.count("*").alias("n_contexts"))
    f = files.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))
    return h.crossJoin(c).crossJoin(f)  # three tables of one row


TABLES = {"contexts": ["context_id"], "context_files": ["context_id", "stored_name"]}
#: Folders by hash of the key that a table of a schema has, and places of a key in a bucket's membership bits.
BUCKETS, PLACES = 32, 1 << 22
BITS = "bucket int, chunk long, bits binary"


def _keyed(rows: DataFrame, keys: list[str]) -> DataFrame:
    h = F.xxhash64(*keys)
    place = F.pmod(F.shiftright(h, 20), F.lit(PLACES))
    return rows.withColumns({"hash": h, "bucket": F.pmod(h, F.lit(BUCKETS)).cast("int"), "chunk": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})


def write_index(cube: Cube, links: DataFrame, root: str, schema_id: str, unique: bool = False) -> None:
    """Append contexts and links that the index doesn't have yet; running it again adds nothing.

    A table lies in BUCKETS folders by hash of the key, and each has bits of the keys that it may hold. Of a batch only
    keys whose bits are set are compared with the index, and with only those of its keys that share a bit with them, first
    by their hashes. Links are moved once, to drop repeated ones; contexts, and ``unique`` links, a stored table where none
    is repeated, are written from where they are. Bits are written before rows, so that they never miss one when a batch is broken off."""
    spark = links.sparkSession
    rows = {"contexts": contexts_of(cube, links), "context_files": links.select("stored_name", "engine_id", "context_id")}
    for name, keys in TABLES.items():
        path = _schema_folder(root, name, schema_id)
        new = _keyed(rows[name], keys)
        if name == "contexts":
            new = stored(new)  # distinct by their paths
        elif not unique:
            new = stored(new.repartition("bucket", "chunk").distinct())  # equal rows are in one task
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            continue
        if hit := _may_hold(new, path, touched):
            maybe = stored(_maybe(new, path, touched).select(*keys, "hash", "bucket", "chunk", "bit"))
            known = _keyed(spark.read.schema(rows[name].select(*keys).schema.add("bucket", "integer")).parquet(path).where(F.col("bucket").isin(hit)), keys)
            known = _marked(known, _bits_of(maybe)).select(*keys, "hash")
            alike = stored(maybe.join(known.select("hash"), "hash", "left_semi").select(*keys, "hash"))
            old = stored(alike.join(known.join(small(alike.select("hash").distinct()), "hash", "left_semi"), [*keys, "hash"], "left_semi").select(*keys))
            new = new.join(small(old), keys, "left_anti")
        _bits_of(new).coalesce(1).write.mode("append").option("compression", "zstd").parquet(_bits_folder(path))
        new = new.drop("hash", "chunk", "bit")
        (level_columns(cube, new) if name == "contexts" else new).write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(path)


def _bits_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Keyed rows whose bits are set; bits have at most 512 kB a bucket, 16 MB in all."""
    return rows.join(F.broadcast(bits), ["bucket", "chunk"]).where(is_set(F.col("bits"), F.col("bit"))).drop("bits")


def _maybe(new: DataFrame, path: str, touched: list[int]) -> DataFrame:
    """Keyed rows whose key the index may hold."""
    bits = new.sparkSession.read.schema(BITS).parquet(_bits_folder(path)).where(F.col("bucket").isin(touched))
    return _marked(new, bits.groupBy("bucket", "chunk").agg(F.bitmap_or_agg("bits").alias("bits")))


def _may_hold(new: DataFrame, path: str, touched: list[int]) -> list[int]:
    """Buckets that may hold one of the keys."""
    if not exists(new.sparkSession, _bits_folder(path)):
        return []
    return [r["bucket"] for r in _maybe(new, path, touched).select("bucket").distinct().collect()]


def _bits_folder(path: str) -> str:
    head, _, tail = path.rpartition("/")
    return f"{head}_bits/{tail}"


def _schema_folder(root: str, name: str, schema_id: str) -> str:
    return f"{root}/{name}/schema_id={checked(schema_id)}"


def compact_index(cube: Cube, spark, root: str, schema_id: str) -> None:
    """Write the tables of a schema anew, in fewer files than many small batches left."""
    for name in TABLES:
        path = _schema_folder(root, name, schema_id)
        bits = spark.read.schema(BITS).parquet(_bits_folder(path))
        stored(bits.groupBy("bucket", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))).coalesce(1).write.mode("overwrite").parquet(_bits_folder(path))
        stored(spark.read.parquet(path)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark, root: str, name: str, schema_id: str) -> DataFrame:
    """A table of the index, pruned to one schema."""
    return spark.read.parquet(f"{root}/{name}").where(F.col("schema_id") == schema_id).drop("bucket")


def reset(spark, root: str, schema_id: str | None = None) -> None:
    """Drop the rows of one schema, or of all."""
    for name in TABLES:
        if schema_id is None:
            delete(spark, f"{root}/{name}")
            delete(spark, f"{root}/{name}_bits")
        else:
            delete(spark, path := _schema_folder(root, name, schema_id))
            delete(spark, _bits_folder(path))
