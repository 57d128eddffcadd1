"""Property-graph forms of triples: vertices and edges, node-link model, topology."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.functions import paths
from kgcube.operators.triples import RDF_TYPE, module


def edges(triples: DataFrame) -> DataFrame:
    """(src, dst, label): links between resources; a bag."""
    t = triples.where(~F.col("is_literal") & (F.col("p") != RDF_TYPE))
    return t.select(F.col("s").alias("src"), F.col("o").alias("dst"), paths.last_segment(F.col("p")).alias("label"))


def vertex_props(triples: DataFrame) -> DataFrame:
    """(id, props): values of literal predicates by key, as a map of sorted lists."""
    lit = triples.where("is_literal").groupBy("s", paths.last_segment(F.col("p")).alias("key")).agg(F.array_sort(F.collect_list("o")).alias("values"))
    return lit.groupBy(F.col("s").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("props"))


def type_label(value, literal):
    """A literal as it is, of an IRI its last part."""
    return F.when(literal, value).otherwise(paths.last_segment(value))


def vertices(triples: DataFrame) -> DataFrame:
    """(id, label, props): all subjects and linked resources; the label is the first type in document order (``seq``,
    where triples have it, else the order of names), or Resource; props as in ``vertex_props``. The triples are read once."""
    lit, typed = F.col("is_literal"), F.col("p") == RDF_TYPE
    order = ["seq"] if "seq" in triples.columns else []
    first = F.when(typed, F.struct(*order, "o", type_label(F.col("o"), lit).alias("label")))
    none = F.lit(None)
    own = F.struct(F.col("s").alias("id"), F.when(lit, paths.last_segment(F.col("p"))).alias("key"), F.when(lit, F.col("o")).alias("value"), first.alias("first"))
    linked = F.struct(F.col("o").alias("id"), none.cast("string").alias("key"), none.cast("string").alias("value"), F.when(F.lit(False), first).alias("first"))
    rows = triples.select(F.explode(F.when(~lit & ~typed, F.array(own, linked)).otherwise(F.array(own))).alias("x")).select("x.*")
    keys = rows.groupBy("id", "key").agg(F.array_sort(F.collect_list("value")).alias("values"), F.min("first").alias("first"))
    pair = F.when(F.col("key").isNotNull(), F.struct("key", "values"))
    v = keys.groupBy("id").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(pair)).alias("pairs"))
    return v.select("id", F.coalesce("first.label", F.lit("Resource")).alias("label"), F.when(F.size("pairs") > 0, F.map_from_entries("pairs")).alias("props"))


def topology(v: DataFrame, e: DataFrame) -> DataFrame:
    return v.agg(F.count("*").alias("n_vertices")).crossJoin(e.agg(F.count("*").alias("n_edges")))  # tables of one row


def induced_edges(v: DataFrame, e: DataFrame) -> DataFrame:
    ids = v.select("id")
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _rank():
    return F.when(module(F.col("graph")) == "derived", 2).when(module(F.col("graph")) == "asserted", 1).otherwise(0)


def model_nodes(quads: DataFrame) -> DataFrame:
    """(id, is_literal, rank): resources, and a leaf for each literal statement; rank is the highest module."""
    s = quads.select(F.col("s").alias("id"), F.lit(False).alias("is_literal"), _rank().alias("rank"))
    o = quads.select(F.when(F.col("is_literal"), F.concat_ws("|", "s", "p", "o")).otherwise(F.col("o")).alias("id"), "is_literal", _rank().alias("rank"))
    return s.unionByName(o).groupBy("id", "is_literal").agg(F.max("rank").alias("rank"))


def model_edges(quads: DataFrame) -> DataFrame:
    return quads.select(F.col("s").alias("src"), F.when(F.col("is_literal"), F.concat_ws("|", "s", "p", "o")).otherwise(F.col("o")).alias("dst"), paths.display_name(F.col("p")).alias("label"), module(F.col("graph")).alias("module"))


#: Representations by name: triples -> one data frame of triples, or vertices and edges.
REPRESENTATIONS: dict[str, Callable[[DataFrame], tuple[DataFrame, ...]]] = {}


def register_representation(name: str, form: Callable[[DataFrame], tuple[DataFrame, ...]]) -> None:
    REPRESENTATIONS[name] = form


register_representation("RDF", lambda t: (t,))
register_representation("LPG", lambda t: (vertices(t), edges(t)))
register_representation("GRAPH_FRAME", lambda t: (vertices(t), edges(t)))
