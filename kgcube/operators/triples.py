"""Triples and quads: relational mapping, context graphs, module stamping, membership, the answer.

A triple is (s, p, o, is_literal, datatype, lang); a quad adds graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgcube.functions import paths
from kgcube.plans.cube import Cube

# Vocabularies of contextualised knowledge repositories and RDF.
CKR = "http://dkm.fbk.eu/ckr/meta#"
OLAP = "http://dkm.fbk.eu/ckr/olap-model#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

TRIPLE = ["s", "p", "o", "is_literal", "datatype", "lang"]


def map_rows(df: DataFrame, base: str, key: Column, subject: Column, types: list[str], literals: dict[str, Column], edges: dict[str, Column], first: int = 0) -> DataFrame:
    """(stored_name, triple, seq) of each row: its types, literals by predicate and edges to other subjects. Null
    objects give none; seq numbers them from ``first`` on, in this order."""
    none = F.lit(None).cast("string")
    iri = lambda c: F.concat(F.lit(base), c)
    parts = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(base + t).alias("o"), F.lit(False).alias("is_literal")) for t in types]
    parts += [F.struct(F.lit(base + p).alias("p"), c.cast("string").alias("o"), F.lit(True).alias("is_literal")) for p, c in literals.items()]
    parts += [F.struct(F.lit(base + p).alias("p"), iri(c).alias("o"), F.lit(False).alias("is_literal")) for p, c in edges.items()]
    rows = df.select(key.alias("stored_name"), iri(subject).alias("s"), F.posexplode(F.array(*parts)).alias("seq", "t"))
    return rows.select("stored_name", "s", "t.p", "t.o", "t.is_literal", none.alias("datatype"), none.alias("lang"), (F.col("seq") + first).alias("seq")).where("o is not null")


def as_set(triples: DataFrame, *keys: str) -> DataFrame:
    """Each triple once for the keys; with ``seq``, if there, its first place."""
    rows = triples.select(*keys, *TRIPLE, *(["seq"] if "seq" in triples.columns else []))
    return rows.groupBy(*keys, *TRIPLE).agg(F.min("seq").alias("seq")) if "seq" in triples.columns else rows.distinct()


def context_graph(links: DataFrame, triples: DataFrame) -> DataFrame:
    """The set of triples of all files of each context."""
    return as_set(context_bag(links, triples), "context_id")


def context_bag(links: DataFrame, triples: DataFrame) -> DataFrame:
    """The triples of all files of each context, repeated as they stand: graph forms count them so."""
    return links.select("stored_name", "context_id").join(triples, "stored_name")


def stamp(graphs: DataFrame, knowledge: DataFrame, base: str, suffix: str = "-mod") -> DataFrame:
    """Each triple of a context in the module of every final graph that the context feeds."""
    k = knowledge.select("context_id", paths.graph_iri(base, F.col("final_id"), suffix).alias("graph"))
    return graphs.join(k, "context_id").select(*TRIPLE, "graph")


def _quad(s: Column, p: str, o: Column, literal: bool, graph: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("is_literal"), none.alias("datatype"), none.alias("lang"), graph.alias("graph"))


def membership(cube: Cube, finals: DataFrame, base: str) -> DataFrame:
    """For each final cell a quad per member, and one that names its asserted module."""
    g = paths.graph_iri(base, F.col("final_id"))
    parts = [_quad(g, CKR + "hasAssertedModule", F.concat(g, F.lit("-mod")), False, g)]
    for d in cube.dimensions:
        parts += [_quad(g, f"{base}{d.name}_{x}", F.get(F.col(d.name), F.lit(k)), True, g) for k, x in enumerate(d.names)]
    return finals.select(F.explode(F.array(*parts)).alias("q")).select("q.*").where("o is not null")


def membership_vertices(cube: Cube, finals: DataFrame, base: str) -> DataFrame:
    entries = [F.struct(F.lit(f"{d.name}_{x}").alias("k"), F.get(F.col(d.name), F.lit(k)).alias("v")) for d in cube.dimensions for k, x in enumerate(d.names)]
    props = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
    return finals.select(paths.graph_iri(base, F.col("final_id")).alias("id"), F.lit("Context").alias("label"), props.alias("props"))


def derived_metadata(finals: DataFrame, base: str) -> DataFrame:
    g = paths.graph_iri(base, F.col("final_id"))
    inf, mod = F.concat(g, F.lit("-inf")), F.concat(g, F.lit("-mod"))
    parts = [_quad(g, CKR + "hasModule", inf, False, g), _quad(inf, CKR + "closureOf", g, False, g), _quad(inf, CKR + "derivedFrom", mod, False, g)]
    return finals.select(F.explode(F.array(*parts)).alias("q")).select("q.*")


def coverage_quads(coverage: DataFrame, base: str) -> DataFrame:
    g = paths.graph_iri(base, F.col("final_id"))
    return coverage.select(_quad(g, OLAP + "covers", paths.graph_iri(base, F.col("context_id")), False, g).alias("q")).select("q.*")


def union(*quads: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), quads).distinct()


def module(graph: Column) -> Column:
    return F.when(graph.endswith("-inf"), "derived").when(graph.endswith("-mod"), "asserted").otherwise("context")


def in_modules(quads: DataFrame, *names: str) -> DataFrame:
    return quads.where(module(F.col("graph")).isin(*names))


def search(quads: DataFrame, text: str) -> DataFrame:
    return quads.where(F.lower(F.concat_ws(" ", "s", "p", "o", "graph")).contains(text.lower()))


def node(value: Column, literal: Column, datatype: Column, lang: Column) -> Column:
    """A term as N-Quads text."""
    quoted = F.concat(F.lit('"'), paths.escape(value), F.lit('"'))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.when(literal, F.concat(quoted, tail)).otherwise(resource(value))


def resource(name: Column) -> Column:
    """An IRI, or a blank node, as N-Quads text."""
    return F.when(name.startswith("_:"), name).otherwise(F.concat(F.lit("<"), name, F.lit(">")))


def triple_text() -> Column:
    return F.concat_ws(" ", resource(F.col("s")), resource(F.col("p")), node(F.col("o"), F.col("is_literal"), F.col("datatype"), F.col("lang")))


def quad_text() -> Column:
    return F.concat_ws(" ", triple_text(), resource(F.col("graph")), F.lit("."))


def split_token(cube: Cube, token: Column) -> Column:
    """'dim_level' -> struct(dimension, level); level names may hold '_'."""
    out = F.lit(None).cast("struct<dimension:string,level:string>")
    for d in sorted(cube.names, key=len):
        out = F.when(token.startswith(f"{d}_"), F.struct(F.lit(d).alias("dimension"), F.substring(token, len(d) + 2, 1 << 20).alias("level"))).otherwise(out)
    return out


def decode_membership(cube: Cube, quads: DataFrame, base: str) -> DataFrame:
    """(graph, dimension, level, value) from membership quads."""
    token = F.substring(F.col("p"), len(base) + 1, 1 << 20)
    rows = quads.where(F.col("is_literal") & F.col("p").startswith(base) & (module(F.col("graph")) == "context"))
    return rows.select("graph", split_token(cube, token).alias("x"), F.col("o").alias("value")).where("x is not null").select("graph", "x.dimension", "x.level", "value")


def cube_cells(cube: Cube, quads: DataFrame, base: str) -> DataFrame:
    """Per context graph its finest member in each dimension, and how many and which graphs it covers: those are
    the leaves of one cell."""
    m = decode_membership(cube, quads, base)
    depth = F.coalesce(*(F.when((F.col("dimension") == d.name) & (F.col("level") == x), F.lit(k)) for d in cube.dimensions for k, x in enumerate(d.names)))
    cells = m.withColumn("depth", depth).groupBy("graph").agg(*(F.max_by(F.when(F.col("dimension") == d, F.col("value")), F.when(F.col("dimension") == d, F.col("depth"))).alias(d) for d in cube.names))
    covers = quads.where(F.col("p") == OLAP + "covers").groupBy("graph").agg(F.count("*").alias("n_covers"), F.array_sort(F.collect_set("o")).alias("covers"))
    return cells.join(covers, "graph", "left").withColumn("n_covers", F.coalesce("n_covers", F.lit(0)))
