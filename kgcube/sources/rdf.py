"""N-Quads, N-Triples, vertex/edge lines and property-graph lines as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgcube.operators.triples import TRIPLE, quad_text, triple_text

# The terms of N-Quads, and the characters that its literals escape.
NODE = r"(<[^>]*>|_:[A-Za-z0-9_][A-Za-z0-9_.-]*)"
LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?'
QUAD_LINE = rf"^\s*{NODE}\s+(<[^>]*>)\s+({NODE[1:-1]}|{LITERAL})(?:\s+{NODE})?\s*\.\s*(?:#.*)?$"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def write_nquads(quads: DataFrame, path: str, by_context: bool = False) -> None:
    """One quad a line; ``by_context``: in a folder for each context, where the modules of a context lie together."""
    lines = quads.select(quad_text().alias("value"), "graph")
    if not by_context:
        lines.select("value").write.text(path)
        return
    name = F.regexp_replace(F.regexp_extract("graph", "[^/#:]*$", 0), "-(mod|inf)$", "")
    lines.select("value", F.nullif(name, F.lit("")).alias("context_id")).repartition("context_id").write.partitionBy("context_id").text(path)


def write_ntriples(quads: DataFrame, path: str) -> None:
    """The union of all modules without the graph term."""
    quads.select(*TRIPLE).distinct().select(F.concat(triple_text(), F.lit(" .")).alias("value")).write.text(path)


def unescape(text):
    """Escapes of a literal, read once from left to right: each piece is an escape or what stands between two."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def plain(x):
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("int")
        long = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(~x.startswith("\\"), x).when(x.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), long)
        for k, v in ESCAPES.items():
            out = out.when(F.substring(x, 2, 1) == k, F.lit(v))
        return out.otherwise(x)

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def read_nquads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(quads, lines that are none); a line without graph term has a null graph. Blank nodes are named _:x."""
    lines = spark.read.text(path, recursiveFileLookup=True).where((F.length(F.trim("value")) > 0) & ~F.col("value").rlike(r"^\s*#"))
    part = lambda i: F.regexp_extract("value", QUAD_LINE, i)
    name = lambda c: F.regexp_replace(c, "^<|>$", "")
    ok = F.col("value").rlike(QUAD_LINE)
    term = part(3)
    literal = term.startswith('"')
    value = F.when(literal, unescape(F.regexp_extract(term, r'(?s)^"((?:[^"\\]|\\.)*)"', 1))).otherwise(name(term))
    empty = lambda c: F.nullif(c, F.lit(""))
    quads = lines.where(ok).select(
        name(part(1)).alias("s"), name(part(2)).alias("p"), value.alias("o"), literal.alias("is_literal"),
        empty(F.regexp_extract(term, r'"\^\^<([^>]*)>$', 1)).alias("datatype"), empty(F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1)).alias("lang"), empty(name(part(4))).alias("graph"),
    )
    return quads, lines.where(~ok)


VERTEX, EDGE = "id string, label string, props map<string, array<string>>", "src string, dst string, label string"


def write_graph_json(v: DataFrame, e: DataFrame, path: str) -> None:
    line = lambda kind, df, cols: df.select(F.to_json(F.struct(F.lit(kind).alias("_kind"), F.struct(*cols).alias("row"))).alias("value"))
    line("v", v, ["id", "label", "props"]).unionByName(line("e", e, ["src", "dst", "label"])).write.text(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema("_kind string, row struct<id string, label string, props map<string, array<string>>, src string, dst string>").json(path)
    return rows.where("_kind = 'v'").select("row.id", "row.label", "row.props"), rows.where("_kind = 'e'").select("row.src", "row.dst", "row.label")


def write_lpg(v: DataFrame, e: DataFrame, path: str) -> None:
    """One element a line: {"@type": "vertex"|"edge", "@value": {...}}."""
    line = lambda kind, df, cols: df.select(F.to_json(F.struct(F.lit(kind).alias("@type"), F.struct(*cols).alias("@value"))).alias("value"))
    edge = [F.col("src").alias("outV"), F.col("dst").alias("inV"), "label"]
    line("vertex", v, ["id", "label", "props"]).unionByName(line("edge", e, edge)).write.text(path)


def normalise_lpg(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(value) in any of the envelopes -> (vertices(id, label), edges); endpoints become vertices too."""
    j = lambda *names: F.coalesce(*(F.get_json_object("value", f"{at}.{n}") for at in ("$['@value']", "$.row", "$") for n in names))
    x = lines.select(j("id").alias("id"), j("label").alias("label"), j("src", "source", "outV").alias("src"), j("dst", "target", "inV").alias("dst"))
    e = x.where("src is not null and dst is not null").select("src", "dst", "label")
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    v = x.where("src is null and id is not null").groupBy("id").agg(F.min("label").alias("label"))
    return v.unionByName(ends.join(v, "id", "left_anti"), allowMissingColumns=True), e


def classify_lines(lines: DataFrame) -> DataFrame:
    """Data and summary lines of a result: kind is 'quad', 'json', 'summary' or 'error'."""
    v = F.col("value")
    kind = F.when(~v.startswith("{"), "quad").when(F.get_json_object(v, "$.error").isNotNull(), "error").when(F.get_json_object(v, "$.summary").isNotNull(), "summary").otherwise("json")
    return lines.withColumn("kind", kind)


def write_result(quads: DataFrame, summary: DataFrame, path: str) -> None:
    """Data lines and one trailing record, in a file of its own: the summary, or if the data can't be computed,
    the error, which is raised too."""
    try:
        quads.select(quad_text().alias("value")).write.text(f"{path}/data")
        last = summary.select(F.to_json(F.struct(F.struct("*").alias("summary"))).alias("value"))
    except Exception as e:
        error = quads.sparkSession.createDataFrame([(str(e).split("\n")[0],)], "error string")
        error.select(F.to_json(F.struct("error")).alias("value")).write.text(f"{path}/summary")
        raise
    last.write.text(f"{path}/summary")
