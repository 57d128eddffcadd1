"""Whole queries: a contextualised graph for a scope and roll-up levels."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgcube.functions import paths
from kgcube.operators import contexts as C
from kgcube.operators import graphs as G
from kgcube.operators import rules as R
from kgcube.operators import triples as T
from kgcube.operators.terms import Dictionary, Graph, resources, statements
from kgcube.plans.cube import Cube
from kgcube.sources.tables import stored

QUAD = ["s", "p", "o", "graph"]


@dataclass
class Answer:
    """Quads (RDF), or vertices and edges (LPG, GRAPH_FRAME), and the tables that they come from."""

    quads: DataFrame | None
    vertices: DataFrame | None
    edges: DataFrame | None
    knowledge: DataFrame
    finals: DataFrame

    def summary(self) -> DataFrame:
        """One row: contexts, final contexts, and quads or vertices and edges."""
        k = self.knowledge.agg(F.count_distinct("context_id").alias("context_count"))
        f = self.finals.agg(F.count("*").alias("final_context_count"))
        rows = self.quads if self.quads is not None else self.edges
        return k.crossJoin(f).crossJoin(rows.agg(F.count("*").alias("row_count")))  # tables of one row


Triples = DataFrame | Callable[[DataFrame], DataFrame]


def build(cube: Cube, ctx: DataFrame, links: DataFrame, triples: Triples, scope: C.Scope, roll_up: dict[str, str] | None = None, representation: str = "RDF", tbox: DataFrame | None = None) -> Answer:
    """The union of the graphs of all contexts that the scope selects or that cover it, each in the
    modules of the final cells that it feeds, with the cells' membership. With a TBox, the RDF form
    also has derived modules. Graph forms carry no modules, only the cells as vertices.

    ``triples`` is a table, or maps files(stored_name) to their triples, so that others needn't be mapped.
    ``ctx`` and ``links`` are read several times and should be stored tables; the knowledge set is stored here."""
    if representation not in G.REPRESENTATIONS:
        raise ValueError(f"unknown representation {representation!r}")
    if tbox is not None and representation != "RDF":
        raise ValueError("derived triples need the RDF form")
    rho = cube.levels(roll_up or {})
    known = stored(C.knowledge(cube, ctx, scope, rho))
    finals = C.final_cells(cube, ctx, scope, rho)
    used = C.files_of(known, links).select("context_id", "stored_name")
    mapped = triples(used.select("stored_name").distinct()) if callable(triples) else triples
    cells = T.membership(cube, finals, cube.base)
    if representation == "RDF" and tbox is None:
        rows = stored(mapped.join(used.select("stored_name").distinct(), "stored_name", "left_semi") if not callable(triples) else mapped)
        feeds = used.join(known, "context_id").select("stored_name", paths.graph_iri(cube.base, F.col("final_id"), "-mod").alias("graph")).distinct()
        terms = Dictionary.of(statements(rows), resources(feeds, "graph"))
        asserted = terms.encode(rows, ["s", "p"], True).join(terms.encode(feeds, ["graph"]), "stored_name").select(*QUAD).distinct()
        return Answer(terms.decode(stored(asserted) if not terms.broadcast else asserted, ["s", "p", "graph"], True).select(*T.TRIPLE, "graph").unionByName(cells), None, None, known, finals)
    if representation == "RDF":
        graph = Graph.of_files(used, mapped)
        found = R.derive(graph, tbox)
        feeds = known.select("context_id", *(paths.graph_iri(cube.base, F.col("final_id"), suffix).alias(suffix[1:]) for suffix in ("-mod", "-inf")))
        terms = Dictionary.of(resources(feeds.select("mod", "inf").distinct(), "mod", "inf"), base=found.terms)
        feeds = stored(terms.encode(feeds, ["context_id", "mod", "inf"]))
        stamped = [facts.join(feeds, "context_id").select("s", "p", "o", F.col(module).alias("graph")) for facts, module in ((graph.facts, "mod"), (found.facts, "inf"))]
        stamped = stamped[0].unionByName(stamped[1]).distinct()
        stamped = terms.decode(stamped if terms.broadcast else stored(stamped), ["s", "p", "graph"], True).select(*T.TRIPLE, "graph")
        parts = [stamped, cells, T.derived_metadata(finals, cube.base), T.coverage_quads(C.coverage(cube, ctx, scope, rho), cube.base)]
        return Answer(reduce(lambda x, y: x.unionByName(y), parts), None, None, known, finals)  # no two parts share a quad
    one = T.as_set(T.context_bag(used, mapped))
    v, e = G.REPRESENTATIONS[representation](one)
    vertices = T.membership_vertices(cube, finals, cube.base)
    vertices = vertices.withColumn("props", F.transform_values("props", lambda k, x: F.array(x)))
    return Answer(None, v.unionByName(vertices), e, known, finals)


QUERY_LOG = "id string, schema_id string, query_text string, resolve_ms long, construct_ms long, total_ms long, context_count long, final_context_count long, row_count long, success boolean, error string, completed_at timestamp"


def logged(cube: Cube, schema_id: str, text: str, ctx: DataFrame, path: str, write: Callable[[Answer], None], **query) -> Answer | None:
    """Build an answer, hand it to ``write``, and append a row about it to the query log at ``path``: milliseconds to
    find its contexts and to construct and write it, counts, or the error, in which case there is no answer."""
    spark, began, found, error = ctx.sparkSession, time.time(), None, None
    resolved = began
    try:
        found = build(cube, ctx, **query)
        resolved = time.time()
        write(found)
        counts = found.summary().first()
    except Exception as e:  # what goes wrong is a row of the log
        found, error, counts = None, str(e).split("\n")[0], None
    ms = lambda a, b: int(1000 * (b - a))
    end = time.time()
    row = (uuid.uuid4().hex, schema_id, text, ms(began, resolved), ms(resolved, end), ms(began, end), *(counts or (None, None, None)), error is None, error, datetime.fromtimestamp(end, timezone.utc))
    spark.createDataFrame([row], QUERY_LOG).coalesce(1).write.mode("append").parquet(path)
    return found
