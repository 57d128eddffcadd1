"""The sales cube over orders, customers, nations and regions, and the same tables as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgcube.functions import paths
from kgcube.operators import triples as T
from kgcube.plans.cube import Cube

BASE = "urn:kgcube:"

SALES = {
    "id": "sales",
    "dimensions": {
        "place": {"levels": [{"name": "region", "depth": 0}, {"name": "nation", "depth": 1, "rollup_to": "region", "rollup_function": "lookup"}]},
        "segment": {"levels": [{"name": "segment", "depth": 0}]},
        "time": {
            "levels": [
                {"name": "year", "depth": 0},
                {"name": "month", "depth": 1, "rollup_to": "year", "rollup_function": "date_to_year"},
                {"name": "day", "depth": 2, "rollup_to": "month", "rollup_function": "date_to_month"},
            ]
        },
    },
}


def cube() -> Cube:
    return Cube.load(SALES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))


def sources(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows that stand for stored files, with their coordinates; with ``files`` only those of these names."""
    geo = geography(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    both, none = F.array("r_name", "n_name"), paths.all_path()
    segment = F.array("c_mktsegment")
    day = paths.day_path(F.col("o_orderdate").cast("date"))
    found = {
        "orders": orders.withColumns({"stored_name": F.concat(F.lit("order/"), F.col("o_orderkey")), "place": both, "segment": segment, "time": day}),
        "customer": customers.withColumns({"stored_name": F.concat(F.lit("customer/"), F.col("c_custkey")), "place": both, "segment": segment, "time": none}),
        "nation": geo.withColumns({"stored_name": F.concat(F.lit("nation/"), F.col("n_nationkey")), "place": both, "segment": none, "time": none}),
        "region": table(spark, sf_dir, "region").withColumns({"stored_name": F.concat(F.lit("region/"), F.col("r_regionkey")), "place": F.array("r_name"), "segment": none, "time": none}),
    }
    if files is None:
        return found
    return {k: df.join(files.select("stored_name"), "stored_name", "left_semi") for k, df in found.items()}


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stored_name, engine_id, size_bytes, paths, context_id) of all source rows."""
    c, out = cube(), None
    for engine, df in sources(spark, sf_dir).items():
        part = df.select("stored_name", F.lit(engine).alias("engine_id"), (F.length("stored_name") + 40).cast("long").alias("size_bytes"), *c.names)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("context_id", c.context_id())


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube()
    return links(spark, sf_dir).select(*c.names).distinct().withColumn("context_id", c.context_id())


def triples(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """Triples of the source rows; an order's file also has those about its customer that place it."""
    s, col = sources(spark, sf_dir, files), F.col
    key = lambda name, c: F.concat(F.lit(f"{name}/"), col(c))
    note = F.concat(F.lit('C:\\new "'), col("c_mktsegment"), F.lit('"\n\tx\r'))
    nation = {"inNation": key("nation", "c_nationkey")}
    parts = [
        T.map_rows(s["orders"], BASE, col("stored_name"), col("stored_name"), ["Order", "Deed"], {"status": col("o_orderstatus"), "priority": col("o_orderpriority")}, {"placedBy": key("customer", "o_custkey")}),
        T.map_rows(s["orders"], BASE, col("stored_name"), key("customer", "o_custkey"), ["Customer"], {}, nation, 10),
        T.map_rows(s["customer"], BASE, col("stored_name"), col("stored_name"), ["Customer"], {"name": col("c_name"), "note": note}, nation),
        T.map_rows(s["nation"], BASE, col("stored_name"), col("stored_name"), ["Nation"], {"name": col("n_name")}, {"inRegion": key("region", "n_regionkey")}),
        T.map_rows(s["region"], BASE, col("stored_name"), col("stored_name"), ["Region"], {"name": col("r_name")}, {}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SCOPE = {"place": {"region": "ASIA"}, "time": {"year": "1996"}}
ROLL_UP = {"place": "nation", "time": "month"}


def scope_paths() -> dict[str, list[str]]:
    return {"place": ["ASIA"], "time": ["1996"]}


# --- the same as SQL text -----------------------------------------------------------------------

LEVELS = {"place": ["region", "nation"], "segment": ["segment"], "time": ["year", "month", "day"]}


def hid(dim: str, path: str) -> str:
    cases = ", ".join(f"CASE WHEN len({path}) >= {i} THEN '{x}=' || {path}[{i}] END" for i, x in enumerate(LEVELS[dim], 1))
    return f"sha256('{dim}|' || concat_ws('|', {cases}))"


def cid(place: str, segment: str, time: str) -> str:
    return f"sha256({hid('place', place)} || ',' || {hid('segment', segment)} || ',' || {hid('time', time)})"


WITH = f"""
WITH geo AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
rows_ AS (
  SELECT 'order/' || o_orderkey AS stored_name, 'orders' AS engine_id, [r_name, n_name] AS place, [c_mktsegment] AS segment,
         [strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y-%m-%d')] AS time
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT 'customer/' || c_custkey, 'customer', [r_name, n_name], [c_mktsegment], []::VARCHAR[] FROM customer JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nation/' || n_nationkey, 'nation', [r_name, n_name], []::VARCHAR[], []::VARCHAR[] FROM geo
  UNION ALL SELECT 'region/' || r_regionkey, 'region', [r_name], []::VARCHAR[], []::VARCHAR[] FROM region
),
contexts AS (SELECT place, segment, time, {cid('place', 'segment', 'time')} AS context_id FROM (SELECT DISTINCT place, segment, time FROM rows_)),
links AS (SELECT stored_name, engine_id, CAST(length(stored_name) + 40 AS BIGINT) AS size_bytes, r.place, r.segment, r.time, context_id FROM rows_ r JOIN contexts c ON r.place = c.place AND r.segment = c.segment AND r.time = c.time),
spec AS (SELECT * FROM contexts WHERE place[1:1] = ['ASIA'] AND time[1:1] = ['1996']),
cover AS (
  SELECT * FROM contexts WHERE place[1:least(len(place), 1)] = ['ASIA'][1:least(len(place), 1)] AND time[1:least(len(time), 1)] = ['1996'][1:least(len(time), 1)] AND (len(place) < 1 OR len(time) < 1)
),
finals AS (SELECT context_id, place[1:2] AS place, segment, time[1:2] AS time FROM spec),
final_ids AS (SELECT context_id, place, segment, time, {cid('place', 'segment', 'time')} AS final_id FROM finals),
sources_ AS (SELECT * FROM spec UNION ALL SELECT * FROM cover),
knowledge AS (
  SELECT DISTINCT k.context_id, f.final_id FROM sources_ k JOIN spec c ON c.place[1:len(k.place)] = k.place AND c.segment[1:len(k.segment)] = k.segment AND c.time[1:len(k.time)] = k.time
  JOIN final_ids f ON f.context_id = c.context_id
),
cells AS (SELECT DISTINCT final_id, place, segment, time FROM final_ids),
triples AS (
  SELECT 'order/' || o_orderkey AS stored_name, '{BASE}order/' || o_orderkey AS s, unnest([{{'n': 0, 'p': '{T.RDF_TYPE}', 'o': '{BASE}Order', 'l': false}}, {{'n': 1, 'p': '{T.RDF_TYPE}', 'o': '{BASE}Deed', 'l': false}}, {{'n': 2, 'p': '{BASE}status', 'o': o_orderstatus, 'l': true}}, {{'n': 3, 'p': '{BASE}priority', 'o': o_orderpriority, 'l': true}}, {{'n': 4, 'p': '{BASE}placedBy', 'o': '{BASE}customer/' || o_custkey, 'l': false}}]) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT 'order/' || o_orderkey, '{BASE}customer/' || o_custkey, unnest([{{'n': 10, 'p': '{T.RDF_TYPE}', 'o': '{BASE}Customer', 'l': false}}, {{'n': 11, 'p': '{BASE}inNation', 'o': '{BASE}nation/' || c_nationkey, 'l': false}}]) FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT 'customer/' || c_custkey, '{BASE}customer/' || c_custkey, unnest([{{'n': 0, 'p': '{T.RDF_TYPE}', 'o': '{BASE}Customer', 'l': false}}, {{'n': 1, 'p': '{BASE}name', 'o': c_name, 'l': true}}, {{'n': 2, 'p': '{BASE}note', 'o': 'C:\\new "' || c_mktsegment || '"' || chr(10) || chr(9) || 'x' || chr(13), 'l': true}}, {{'n': 3, 'p': '{BASE}inNation', 'o': '{BASE}nation/' || c_nationkey, 'l': false}}]) FROM customer JOIN geo ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nation/' || n_nationkey, '{BASE}nation/' || n_nationkey, unnest([{{'n': 0, 'p': '{T.RDF_TYPE}', 'o': '{BASE}Nation', 'l': false}}, {{'n': 1, 'p': '{BASE}name', 'o': n_name, 'l': true}}, {{'n': 2, 'p': '{BASE}inRegion', 'o': '{BASE}region/' || n_regionkey, 'l': false}}]) FROM geo
  UNION ALL SELECT 'region/' || r_regionkey, '{BASE}region/' || r_regionkey, unnest([{{'n': 0, 'p': '{T.RDF_TYPE}', 'o': '{BASE}Region', 'l': false}}, {{'n': 1, 'p': '{BASE}name', 'o': r_name, 'l': true}}]) FROM region
),
tri AS (SELECT stored_name, s, t.p AS p, t.o AS o, t.l AS is_literal, t.n AS seq FROM triples WHERE t.o IS NOT NULL),
graphs AS (SELECT context_id, s, p, o, is_literal, min(seq) AS seq FROM links JOIN tri USING (stored_name) GROUP BY ALL),
asserted AS (SELECT DISTINCT s, p, o, is_literal, '{BASE}context/' || final_id || '-mod' AS graph FROM graphs JOIN knowledge USING (context_id)),
member AS (
  SELECT '{BASE}context/' || final_id AS s, unnest([{{'p': '{T.CKR}hasAssertedModule', 'o': '{BASE}context/' || final_id || '-mod', 'l': false}},
    {{'p': '{BASE}place_region', 'o': place[1], 'l': true}}, {{'p': '{BASE}place_nation', 'o': place[2], 'l': true}}, {{'p': '{BASE}segment_segment', 'o': segment[1], 'l': true}},
    {{'p': '{BASE}time_year', 'o': time[1], 'l': true}}, {{'p': '{BASE}time_month', 'o': time[2], 'l': true}}, {{'p': '{BASE}time_day', 'o': time[3], 'l': true}}]) AS t FROM cells
),
membership AS (SELECT s, t.p AS p, t.o AS o, t.l AS is_literal, s AS graph FROM member WHERE t.o IS NOT NULL),
answer AS (SELECT * FROM asserted UNION SELECT * FROM membership)
"""
