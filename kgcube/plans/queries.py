"""Queries over the test tables, one for each operator, with the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgcube.functions import paths
from kgcube.operators import contexts as C
from kgcube.operators import graphs as G
from kgcube.operators import rules as R
from kgcube.operators import triples as T
from kgcube.operators.terms import Graph
from kgcube.plans import sales as S
from kgcube.plans.answer import build
from kgcube.plans.cube import dimension_violations, lookup_parent
from kgcube.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_sales: bool = True):
    """Register a function under its name, with SQL after the common tables of the sales cube."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (S.WITH if with_sales else "") + sql
        return f

    return add


def plain(sql: str | None = None):
    return query(sql, with_sales=False)


_left: dict[tuple, str] = {}


def once(run):
    """A run whose folder other queries of the same session read too: it runs once for each folder of tables."""

    def folder(spark, d):
        key = (run.__name__, spark.sparkContext.applicationId, d)
        if key not in _left:
            _left[key] = run(spark, d)
        return _left[key]

    return folder


CUBE = S.cube()
RHO = CUBE.levels(S.ROLL_UP)
SCOPE = S.scope_paths()
joined = lambda c: F.array_join(c, ">")


def flat():
    return [joined(F.col(d)).alias(d) for d in CUBE.names]


SQL_FLAT = "array_to_string(place, '>') AS place, array_to_string(segment, '>') AS segment, array_to_string(time, '>') AS time"


def contexts_table(spark, d):
    """The contexts as a stored table, for plans that read them several times."""
    return tables.stored(C.level_columns(CUBE, S.contexts(spark, d)))


def specific(spark, d):
    return C.dice(CUBE, S.contexts(spark, d), SCOPE)


def index_tables(spark, d):
    """Contexts and links as stored tables."""
    links = tables.stored(S.links(spark, d))
    return tables.stored(C.level_columns(CUBE, C.contexts_of(CUBE, links))), links


def known(spark, d):
    return C.knowledge(CUBE, contexts_table(spark, d), SCOPE, RHO)


def finals(spark, d):
    return C.final_cells(CUBE, S.contexts(spark, d), SCOPE, RHO)


def place_table(spark, d):
    return S.geography(spark, d).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("n_nationkey").alias("position"))


# --- cube, paths, ids ---------------------------------------------------------------------------


@plain("SELECT n_name AS nation, r_name || '>' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def scope_paths(spark, d):
    """Path of every nation by lookup, as a scope builder makes it."""
    t = place_table(spark, d)
    return CUBE.member_path(t, t.select("nation"), "place", "nation", "nation", "path").select("nation", joined(F.col("path")).alias("path"))


@plain("""SELECT n_name AS nation, p.level AS level, CASE WHEN p.level IN ('nation') THEN true ELSE false END AS nation_below, true AS region_below
FROM nation, (VALUES ('region'), ('nation')) AS p(level)""")
def level_order(spark, d):
    """For each nation's levels: does the level roll up to nation, to region?"""
    order = CUBE.level_order(spark).where("dimension = 'place'")
    flags = order.groupBy("level").agg(*(F.bool_or(F.col("rolls_up") & (F.col("other") == x)).alias(f"{x}_below") for x in ("nation", "region")))
    members = place_table(spark, d).select("nation", F.explode(F.array(F.lit("region"), F.lit("nation"))).alias("level"))
    return members.join(flags, "level").select("nation", "level", "nation_below", "region_below")


@query("SELECT context_id FROM spec")
def scope_built(spark, d):
    """The contexts of a scope whose paths come from the dimension table and the roll-up functions."""
    scope = CUBE.scope(spark, S.SCOPE, {"place": place_table(spark, d)})
    return C.dice(CUBE, S.contexts(spark, d), scope).select("context_id")


@query("SELECT a.context_id AS fine_id, b.context_id AS coarse_id, true AS up, a.context_id = b.context_id AS down FROM contexts a JOIN contexts b ON a.place[1] = b.place[1] AND a.place[1:len(b.place)] = b.place AND a.segment[1:len(b.segment)] = b.segment AND a.time[1:len(b.time)] = b.time")
def rolls_up_flags(spark, d):
    """Of each pair of a context and an ancestor: does either roll up to the other?"""
    c = contexts_table(spark, d)
    side = lambda k: c.select(F.col("context_id").alias(f"{k}_id"), *(F.col(n).alias(f"{k}_{n}") for n in CUBE.names))
    x = C.ancestor_pairs(CUBE, c, c).join(side("fine"), "fine_id").join(side("coarse"), "coarse_id")
    of = lambda k: {n: F.col(f"{k}_{n}") for n in CUBE.names}
    return x.select("fine_id", "coarse_id", paths.rolls_up_to(of("fine"), of("coarse")).alias("up"), paths.rolls_up_to(of("coarse"), of("fine")).alias("down"))


@plain("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y') || '>' || strftime(o_orderdate, '%Y-%m') || '>' || strftime(o_orderdate, '%Y-%m-%d') AS path FROM orders")
def member_paths(spark, d):
    days = S.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    return CUBE.member_path(None, days, "time", "day", "day", "path").select("day", joined(F.col("path")).alias("path"))


@query(f"""SELECT context_id, {S.hid('place', 'place')} AS place_id, {S.hid('segment', 'segment')} AS segment_id, {S.hid('time', 'time')} AS time_id FROM contexts""")
def hierarchy_ids(spark, d):
    return S.contexts(spark, d).select("context_id", *(c.alias(f"{n}_id") for n, c in CUBE.ids().items()))


@query(f"SELECT context_id, {SQL_FLAT} FROM contexts")
def contexts_index(spark, d):
    return S.contexts(spark, d).select("context_id", *flat())


@query("""SELECT context_id, concat_ws('_', CASE WHEN len(place) = 0 THEN 'place:ALL' ELSE 'place:' || array_to_string(place, '>') END,
 CASE WHEN len(segment) = 0 THEN 'segment:ALL' ELSE 'segment:' || array_to_string(segment, '>') END, CASE WHEN len(time) = 0 THEN 'time:ALL' ELSE 'time:' || array_to_string(time, '>') END) AS label FROM contexts""")
def path_labels(spark, d):
    return S.contexts(spark, d).select("context_id", F.concat_ws("_", *(paths.label(n, F.col(n)) for n in CUBE.names)).alias("label"))


@query("""SELECT context_id, concat_ws(',', 'region=' || place[1], 'nation=' || place[2]) AS place_map, concat_ws(',', 'year=' || time[1], 'month=' || time[2], 'day=' || time[3]) AS time_map,
 array_to_string(time, '>') AS time_again FROM contexts""")
def level_maps(spark, d):
    def text(dim):
        names = CUBE.dimension(dim).names
        m = paths.level_map(names, F.col(dim))
        return F.concat_ws(",", *(F.concat(F.lit(f"{x}="), F.try_element_at(m, F.lit(x))) for x in names))

    names = CUBE.dimension("time").names
    again = paths.from_level_map(names, paths.level_map(names, F.col("time")))
    return S.contexts(spark, d).select("context_id", text("place").alias("place_map"), text("time").alias("time_map"), joined(again).alias("time_again"))


@query("""SELECT DISTINCT array_to_string(time, '>') AS path, array_to_string(time[1:n], '>') AS ancestor, n FROM (SELECT time, unnest(range(0, len(time) + 1)) AS n FROM contexts)""")
def ancestor_chain(spark, d):
    t = S.contexts(spark, d).select("time").distinct()
    return t.select(joined(F.col("time")).alias("path"), F.explode(paths.ancestors(F.col("time"))).alias("a")).select("path", joined(F.col("a")).alias("ancestor"), F.size("a").cast("long").alias("n")).distinct()


@query("SELECT DISTINCT array_to_string(time, '>') AS path, CASE WHEN len(time) > 0 THEN array_to_string(time[1:len(time) - 1], '>') END AS parent FROM contexts")
def roll_one_level(spark, d):
    return S.contexts(spark, d).select("time").distinct().select(joined(F.col("time")).alias("path"), joined(paths.parent(F.col("time"))).alias("parent"))


@plain("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_rollup(spark, d):
    c = S.table(spark, d, "customer").join(S.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    t = place_table(spark, d)
    later = t.withColumns({"region": F.lit("NOWHERE"), "position": F.col("position") + 1000})  # of two rows the first counts
    return lookup_parent(c, later.unionByName(t), "nation", "nation", "region", "region").select("c_custkey", "nation", "region")


@plain("SELECT event_id, props AS value FROM events WHERE props IS NULL OR length(props) = 0 OR contains(props, '|') UNION ALL SELECT event_id, event_type || '|' FROM events WHERE event_type = 'error'")
def bad_members(spark, d):
    e = S.table(spark, d, "events")
    values = e.select("event_id", F.col("props").alias("value")).unionByName(e.where("event_type = 'error'").select("event_id", F.concat("event_type", F.lit("|")).alias("value")))
    return values.where(~paths.valid_member(F.col("value")))


@plain("""SELECT r_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS nation, CASE WHEN n_nationkey % 2 = 1 THEN 'nation or region missing' ELSE 'unknown level city' END AS violation
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1 OR n_nationkey % 3 = 0""")
def dimension_violations_(spark, d):
    t = place_table(spark, d).withColumns({"nation": F.when(F.col("position") % 2 == 0, F.col("nation")), "city": F.when(F.col("position") % 3 == 0, F.lit("x"))})
    return dimension_violations(CUBE, "place", t).select("region", "nation", "violation")


@query("SELECT context_id, array_to_string(time, '>') AS time, CASE WHEN len(time) = 3 THEN substr(time[3], 1, 7) END AS month, CASE WHEN len(time) >= 2 THEN substr(time[2], 1, 4) END AS year FROM contexts")
def date_roll_ups(spark, d):
    return S.contexts(spark, d).select("context_id", joined(F.col("time")).alias("time"), paths.month_of(F.get("time", F.lit(2))).alias("month"), paths.year_of(F.get("time", F.lit(1))).alias("year"))


# --- index --------------------------------------------------------------------------------------


@query("SELECT context_id, max_by(engine_id, stored_name) AS engine_id FROM links GROUP BY context_id")
def engine_of_context(spark, d):
    return C.engine_of_context(S.links(spark, d))


@query(f"""SELECT dimension, hierarchy_id, count(*) AS n_contexts, min(context_id) AS first_context FROM (
 SELECT context_id, 'place' AS dimension, {S.hid('place', 'place')} AS hierarchy_id FROM contexts UNION ALL SELECT context_id, 'segment', {S.hid('segment', 'segment')} FROM contexts
 UNION ALL SELECT context_id, 'time', {S.hid('time', 'time')} FROM contexts) GROUP BY ALL""")
def inverted_index(spark, d):
    return C.inverted_index(CUBE, S.contexts(spark, d))


@query("SELECT context_id, stored_name, row_number() OVER (PARTITION BY context_id ORDER BY stored_name DESC) AS rank FROM links WHERE context_id IN (SELECT context_id FROM spec)")
def context_files(spark, d):
    from pyspark.sql.window import Window as W

    found = C.files_of(specific(spark, d), S.links(spark, d))
    return found.select("context_id", "stored_name", F.row_number().over(W.partitionBy("context_id").orderBy(F.desc("stored_name"))).cast("long").alias("rank"))


@query("SELECT context_id FROM contexts WHERE context_id NOT IN (SELECT context_id FROM links WHERE engine_id <> 'customer')")
def orphan_contexts(spark, d):
    return C.orphan_contexts(S.contexts(spark, d), S.links(spark, d).where("engine_id <> 'customer'")).select("context_id")


@query("SELECT stored_name FROM links WHERE context_id NOT IN (SELECT context_id FROM spec)")
def unindexed_files(spark, d):
    links = S.links(spark, d)
    inside = links.join(specific(spark, d).select("context_id"), "context_id", "left_semi")
    return C.unindexed_files(links, inside).select("stored_name")


@query(f"""SELECT (SELECT count(DISTINCT h) FROM (SELECT {S.hid('place', 'place')} AS h FROM contexts UNION SELECT {S.hid('segment', 'segment')} FROM contexts UNION SELECT {S.hid('time', 'time')} FROM contexts)) AS n_hierarchies,
 (SELECT count(*) FROM contexts) AS n_contexts, (SELECT count(*) FROM links) AS n_files, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM links) AS total_bytes""")
def schema_stats(spark, d):
    links = S.links(spark, d)
    return C.schema_stats(CUBE, S.contexts(spark, d), links, links)


@query("SELECT array_to_string(place, '>') AS place, array_to_string(segment, '>') AS segment, array_to_string(time, '>') AS time, 2 AS n_ids FROM contexts WHERE len(time) = 0")
def corrupt_tuples(spark, d):
    """Contexts without time get a second id, and are found."""
    c = S.contexts(spark, d)
    broken = c.unionByName(c.where(F.size("time") == 0).withColumn("context_id", F.lit("other")))
    return C.corrupt_tuples(CUBE, broken).select(*flat(), "n_ids")


@query("""SELECT context_id, concat_ws(',', 'place_region=' || place[1], 'place_nation=' || place[2], 'segment_segment=' || segment[1], 'time_year=' || time[1], 'time_month=' || time[2], 'time_day=' || time[3]) AS members FROM contexts""")
def flat_members(spark, d):
    c = C.level_columns(CUBE, S.contexts(spark, d))
    names = [f"{x.name}_{n}" for x in CUBE.dimensions for n in x.names]
    return c.select("context_id", F.concat_ws(",", *(F.concat(F.lit(f"{n}="), F.col(n)) for n in names)).alias("members"))


@query("SELECT DISTINCT 'place' AS dimension, CASE WHEN len(place) = 0 THEN 'place:ALL' ELSE 'place:' || array_to_string(place, '>') END AS label FROM contexts UNION SELECT 'segment', CASE WHEN len(segment) = 0 THEN 'segment:ALL' ELSE 'segment:' || array_to_string(segment, '>') END FROM contexts UNION SELECT 'time', CASE WHEN len(time) = 0 THEN 'time:ALL' ELSE 'time:' || array_to_string(time, '>') END FROM contexts")
def distinct_hierarchies(spark, d):
    return C.context_dim(CUBE, S.contexts(spark, d)).select("dimension", "label").distinct()


@query(f"""SELECT n_name AS nation, x.dimension AS dimension, x.hierarchy_id AS hierarchy_id, row_number() OVER (PARTITION BY n_name ORDER BY x.dimension, x.hierarchy_id) AS place FROM (
 SELECT DISTINCT place[2] AS n_name, unnest([{{'dimension': 'place', 'hierarchy_id': {S.hid('place', 'place')}}}, {{'dimension': 'segment', 'hierarchy_id': {S.hid('segment', 'segment')}}}]) AS x FROM contexts WHERE len(place) = 2)""")
def canonical_order(spark, d):
    """Hierarchies of each nation's contexts, numbered by dimension and id."""
    ctx = S.contexts(spark, d).where(F.size("place") == 2)
    rows = C.context_dim(CUBE, ctx).join(ctx.select("context_id", F.get("place", F.lit(1)).alias("nation")), "context_id").where("dimension <> 'time'").select("nation", "dimension", "hierarchy_id").distinct()
    return C.canonical(rows, "place", "nation")


@query("SELECT context_id, time[1] AS time_year, len(place) AS n FROM contexts WHERE context_id IN (SELECT context_id FROM links)")
def index_roundtrip(spark, d):
    """Write the index twice, read it back: the second write adds nothing."""
    root, links = tables.new_folder(spark), tables.stored(S.links(spark, d))
    C.write_index(CUBE, links, root, "sales")
    C.write_index(CUBE, links, root, "sales")
    return C.read_index(spark, root, "contexts", "sales").select("context_id", "time_year", F.size("place").cast("long").alias("n"))


@query("SELECT context_id FROM contexts")
def reset_schema(spark, d):
    """Of two schemas in an index one is dropped; the other stays."""
    root, links = tables.new_folder(spark), tables.stored(S.links(spark, d))
    C.write_index(CUBE, links, root, "sales")
    C.write_index(CUBE, links, root, "other")
    C.reset(spark, root, "other")
    return spark.read.parquet(f"{root}/contexts").select("context_id")


# --- resolve ------------------------------------------------------------------------------------


@query("SELECT context_id FROM contexts WHERE time[1] = '1996'")
def slice_year(spark, d):
    return C.slice_(CUBE, S.contexts(spark, d), "time", ["1996"]).select("context_id")


@query("SELECT context_id FROM spec")
def dice_region_year(spark, d):
    return specific(spark, d).select("context_id")


@query("SELECT context_id FROM contexts")
def select_all(spark, d):
    return C.dice(CUBE, S.contexts(spark, d), {}).select("context_id")


@query("SELECT context_id FROM cover")
def covering_contexts(spark, d):
    return C.covering(S.contexts(spark, d), SCOPE).select("context_id")


@query("SELECT context_id FROM contexts WHERE place[1] = 'ASIA' INTERSECT SELECT context_id FROM contexts WHERE time[1] = '1996'")
def specific_by_intersection(spark, d):
    return C.specific_by_intersection(CUBE, S.contexts(spark, d), SCOPE)


def posted(spark, d):
    ctx = contexts_table(spark, d)
    numbers = C.ordinals(ctx)
    return C.postings(CUBE, ctx, numbers), numbers


@query("SELECT context_id FROM spec")
def scope_from_postings(spark, d):
    """The scope's contexts from bitmaps of two hierarchies."""
    bits, numbers = posted(spark, d)
    return C.of_bits(C.select_bits(CUBE, bits, SCOPE), numbers)


@query(f"""SELECT dimension, hierarchy_id, count(*) AS n FROM (
 SELECT 'place' AS dimension, {S.hid('place', 'p')} AS hierarchy_id FROM (SELECT unnest([place[1:n] FOR n IN range(0, len(place) + 1)]) AS p FROM contexts)
 UNION ALL SELECT 'segment', {S.hid('segment', 'p')} FROM (SELECT unnest([segment[1:n] FOR n IN range(0, len(segment) + 1)]) AS p FROM contexts)
 UNION ALL SELECT 'time', {S.hid('time', 'p')} FROM (SELECT unnest([time[1:n] FOR n IN range(0, len(time) + 1)]) AS p FROM contexts)) GROUP BY ALL""")
def posting_sizes(spark, d):
    """How many contexts are at or below each hierarchy, from its bitmaps."""
    bits, _ = posted(spark, d)
    return bits.groupBy("dimension", "hierarchy_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))


# --- roll-up ------------------------------------------------------------------------------------


@query("SELECT context_id, final_id FROM final_ids")
def roll_up_month_nation(spark, d):
    return C.roll_up(CUBE, specific(spark, d), RHO).select("context_id", "final_id")


@query("SELECT final_id, count(*) AS n_contexts FROM final_ids GROUP BY final_id")
def merge_cells(spark, d):
    return C.merge_cells(CUBE, specific(spark, d), RHO).select("final_id", "n_contexts")


@query(f"SELECT final_id, {SQL_FLAT} FROM cells")
def final_contexts(spark, d):
    return finals(spark, d).select("final_id", *flat())


@query("SELECT a.context_id AS fine_id, b.context_id AS coarse_id FROM contexts a JOIN contexts b ON a.place[1] = b.place[1] AND a.place[1:len(b.place)] = b.place AND a.segment[1:len(b.segment)] = b.segment AND a.time[1:len(b.time)] = b.time")
def ancestor_pairs(spark, d):
    c = contexts_table(spark, d)
    return C.ancestor_pairs(CUBE, c, c)


@query("SELECT context_id, final_id FROM knowledge WHERE context_id IN (SELECT context_id FROM spec)")
def knowledge_specific(spark, d):
    return known(spark, d).join(specific(spark, d).select("context_id"), "context_id", "left_semi")


@query("SELECT context_id, final_id FROM knowledge WHERE context_id IN (SELECT context_id FROM cover)")
def knowledge_covering(spark, d):
    return known(spark, d).join(C.covering(S.contexts(spark, d), SCOPE).select("context_id"), "context_id", "left_semi")


@query("SELECT final_id, context_id FROM knowledge WHERE context_id IN (SELECT context_id FROM spec) AND context_id <> final_id")
def coverage(spark, d):
    return C.coverage(CUBE, contexts_table(spark, d), SCOPE, RHO)


@query(f"SELECT context_id, {S.cid('place[1:1]', 'segment', 'time[1:1]')} AS final_id FROM spec")
def rollup_all_is_root(spark, d):
    rho = CUBE.levels({"place": "ALL", "time": "ALL"})
    return C.roll_up(CUBE, specific(spark, d), rho).select("context_id", "final_id")


# --- triples and the answer ---------------------------------------------------------------------

QUAD = ["s", "p", "o", "is_literal", "graph"]
SQL_QUAD = "s, p, o, is_literal, graph"


@query("SELECT stored_name, s, p, o, is_literal FROM tri")
def map_rows(spark, d):
    return S.triples(spark, d).select("stored_name", "s", "p", "o", "is_literal")


@plain("SELECT DISTINCT n_name AS nation, t.dimension AS dimension, t.level AS level FROM nation, (SELECT unnest([{'dimension': 'place', 'level': 'nation_code'}, {'dimension': 'time', 'level': 'day'}]) AS t)")
def dim_level_split(spark, d):
    rows = S.table(spark, d, "nation").select(F.col("n_name").alias("nation"), F.explode(F.array(F.lit("place_nation_code"), F.lit("time_day"), F.lit("none"))).alias("token"))
    return rows.select("nation", T.split_token(CUBE, F.col("token")).alias("x")).where("x is not null").select("nation", "x.dimension", "x.level").distinct()


def spec_graphs(spark, d):
    return T.context_graph(C.files_of(known(spark, d), S.links(spark, d)), S.triples(spark, d))


def spec_graph(spark, d, axioms):
    """What the axioms' rules can read or derive of the same, as numbers."""
    return Graph.of_files(C.files_of(known(spark, d), S.links(spark, d)), axioms.relevant(S.triples(spark, d).drop("seq")))


@query("SELECT context_id, s, p, o, is_literal FROM graphs WHERE context_id IN (SELECT context_id FROM knowledge)")
def context_graph(spark, d):
    return spec_graphs(spark, d).select("context_id", "s", "p", "o", "is_literal")


@query("SELECT context_id, count(DISTINCT (s, p, o, is_literal)) AS n, count(*) AS n_bag FROM links JOIN tri USING (stored_name) WHERE context_id IN (SELECT context_id FROM knowledge) GROUP BY context_id")
def triple_counts(spark, d):
    """Triples of each graph as a set, and as they stand in its files."""
    bag = T.context_bag(C.files_of(known(spark, d), S.links(spark, d)), S.triples(spark, d))
    return bag.groupBy("context_id", *T.TRIPLE).agg(F.count("*").alias("k")).groupBy("context_id").agg(F.count("*").alias("n"), F.sum("k").alias("n_bag"))


@query(f"SELECT {SQL_QUAD} FROM asserted")
def asserted_quads(spark, d):
    return T.stamp(spec_graphs(spark, d), known(spark, d), S.BASE).select(*QUAD).distinct()


@query(f"SELECT {SQL_QUAD} FROM membership")
def membership_quads(spark, d):
    return T.membership(CUBE, finals(spark, d), S.BASE).select(*QUAD)


@query(f"""SELECT '{S.BASE}context/' || final_id AS id, 'Context' AS label, concat_ws(',', 'place_nation=' || place[2], 'place_region=' || place[1], 'segment_segment=' || segment[1], 'time_month=' || time[2], 'time_year=' || time[1]) AS props FROM cells""")
def membership_vertices(spark, d):
    v = T.membership_vertices(CUBE, finals(spark, d), S.BASE)
    return v.select("id", "label", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("props"))


def full_answer(spark, d, **more):
    ctx, links = index_tables(spark, d)
    return build(CUBE, ctx, links, lambda files: S.triples(spark, d, files), SCOPE, S.ROLL_UP, **more)


@query(f"SELECT {SQL_QUAD} FROM answer")
def answer(spark, d):
    return full_answer(spark, d).quads.select(*QUAD)


@query("SELECT (SELECT count(DISTINCT context_id) FROM knowledge) AS context_count, (SELECT count(*) FROM cells) AS final_context_count, (SELECT count(*) FROM answer) AS row_count")
def answer_count(spark, d):
    return full_answer(spark, d).summary()


@query(f"SELECT {SQL_QUAD} FROM membership")
def module_filter(spark, d):
    return T.in_modules(full_answer(spark, d).quads, "context").select(*QUAD)


@query(f"SELECT {SQL_QUAD} FROM answer WHERE contains(lower(s || ' ' || p || ' ' || o || ' ' || graph), 'building')")
def quad_search(spark, d):
    return T.search(full_answer(spark, d).quads, "BUILDING").select(*QUAD)


@query(f"SELECT graph, split_part(substr(p, {len(S.BASE) + 1}), '_', 1) AS dimension, split_part(substr(p, {len(S.BASE) + 1}), '_', 2) AS level, o AS value FROM membership WHERE is_literal")
def membership_decode(spark, d):
    return T.decode_membership(CUBE, T.membership(CUBE, finals(spark, d), S.BASE), S.BASE)


@query(f"""SELECT '{S.BASE}context/' || c.final_id AS graph, c.place[len(c.place)] AS place, c.segment[len(c.segment)] AS segment, c.time[len(c.time)] AS time, coalesce(n, 0) AS n_covers, coalesce(covers, '') AS covers FROM cells c
LEFT JOIN (SELECT final_id, count(*) AS n, string_agg('{S.BASE}context/' || context_id, ',' ORDER BY context_id) AS covers FROM knowledge WHERE context_id IN (SELECT context_id FROM spec) AND context_id <> final_id GROUP BY final_id) v USING (final_id)""")
def cube_cells(spark, d):
    ctx = contexts_table(spark, d)
    quads = T.membership(CUBE, finals(spark, d), S.BASE).unionByName(T.coverage_quads(C.coverage(CUBE, ctx, SCOPE, RHO), S.BASE))
    return T.cube_cells(CUBE, quads, S.BASE).withColumn("covers", F.coalesce(F.array_join("covers", ","), F.lit("")))


@query(f"SELECT {SQL_QUAD}, (SELECT count(*) FROM answer) AS total FROM answer ORDER BY s, p, o, graph LIMIT 2000")
def preview(spark, d):
    """The first 2,000 quads of the answer, with the number of all."""
    q = full_answer(spark, d).quads
    n = q.agg(F.count("*").alias("total"))
    return q.select(*QUAD).orderBy("s", "p", "o", "graph").limit(2000).crossJoin(n)  # n is one row


# --- graph forms --------------------------------------------------------------------------------

G_TRI = f"gt AS (SELECT s, p, o, is_literal, min(seq) AS seq FROM graphs WHERE context_id IN (SELECT context_id FROM knowledge) GROUP BY ALL), ids AS (SELECT s AS id FROM gt UNION SELECT o FROM gt WHERE NOT is_literal AND p <> '{T.RDF_TYPE}'), "
G_TRI += f"""lab AS (SELECT s AS id, arg_min(o, seq) AS t FROM gt WHERE p = '{T.RDF_TYPE}' GROUP BY s), lits AS (SELECT s AS id, string_agg(k || '=' || v, ';' ORDER BY k) AS props FROM (SELECT s, split_part(p, ':', 3) AS k, string_agg(o, ',' ORDER BY o) AS v FROM gt WHERE is_literal GROUP BY s, p) GROUP BY s)"""


def with_graph(sql: str) -> str:
    return ", " + G_TRI + sql


def graph_triples(spark, d):
    """Those of the files that the knowledge set needs, as a stored table, as graph forms read it several times."""
    files = tables.stored(C.files_of(known(spark, d), S.links(spark, d)).select("stored_name").distinct())
    return tables.stored(T.as_set(S.triples(spark, d, files)))


def flat_vertices(v):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(F.substring_index(e["key"], ":", -1), F.lit("="), F.array_join(e["value"], ","))), ";")
    return v.select("id", F.substring_index("label", ":", -1).alias("label"), text.alias("props"))


@query(with_graph(" SELECT ids.id AS id, coalesce(split_part(t, ':', 3), 'Resource') AS label, props FROM ids LEFT JOIN lab USING (id) LEFT JOIN lits USING (id)"))
def vertices(spark, d):
    return flat_vertices(G.vertices(graph_triples(spark, d)))


@query(with_graph(f" SELECT s AS src, o AS dst, p AS label FROM gt WHERE NOT is_literal AND p <> '{T.RDF_TYPE}'"))
def edges(spark, d):
    return G.edges(graph_triples(spark, d))


@query(with_graph(""" SELECT i, CASE WHEN i LIKE '%/%' THEN list_extract(string_split(i, '/'), -1) ELSE i END AS label, list_extract(string_split(CASE WHEN i LIKE '%/%' THEN list_extract(string_split(i, '/'), -1) ELSE i END, CASE WHEN i LIKE '%/%' THEN '/' ELSE ':' END), -1) AS display FROM (SELECT DISTINCT p AS i FROM gt WHERE p NOT LIKE '%#%' UNION SELECT id FROM ids)"""))
def iri_labels(spark, d):
    t = graph_triples(spark, d)
    i = t.where(~F.col("p").contains("#")).select(F.col("p").alias("i")).union(G.vertices(t).select("id")).distinct()
    return i.select("i", paths.last_segment(F.col("i")).alias("label"), paths.display_name(F.col("i")).alias("display"))


@query(with_graph(f" SELECT (SELECT count(*) FROM ids) AS n_vertices, (SELECT count(*) FROM gt WHERE NOT is_literal AND p <> '{T.RDF_TYPE}') AS n_edges"))
def topology(spark, d):
    t = graph_triples(spark, d)
    return G.topology(G.vertices(t), G.edges(t))


RANK = "CASE WHEN graph LIKE '%-inf' THEN 2 WHEN graph LIKE '%-mod' THEN 1 ELSE 0 END"


@query(f"SELECT id, is_literal, max(r) AS rank FROM (SELECT s AS id, false AS is_literal, {RANK} AS r FROM answer UNION ALL SELECT CASE WHEN is_literal THEN s || '|' || p || '|' || o ELSE o END, is_literal, {RANK} FROM answer) GROUP BY ALL")
def node_link_nodes(spark, d):
    return G.model_nodes(full_answer(spark, d).quads)


@query("SELECT s AS src, CASE WHEN is_literal THEN s || '|' || p || '|' || o ELSE o END AS dst, CASE WHEN p LIKE '%#%' THEN split_part(p, '#', 2) ELSE list_extract(string_split(p, ':'), -1) END AS label, CASE WHEN graph LIKE '%-mod' THEN 'asserted' ELSE 'context' END AS module FROM answer")
def node_link_edges(spark, d):
    return G.model_edges(full_answer(spark, d).quads)


@query(with_graph(f", top AS (SELECT id FROM ids ORDER BY id LIMIT 1200) SELECT s AS src, o AS dst, p AS label FROM gt WHERE NOT is_literal AND p <> '{T.RDF_TYPE}' AND s IN (SELECT id FROM top) AND o IN (SELECT id FROM top)"))
def induced_edges(spark, d):
    """Edges among the first 1,200 nodes of a preview."""
    t = graph_triples(spark, d)
    top = G.vertices(t).select("id").orderBy("id").limit(1200)
    return G.induced_edges(top, G.edges(t)).select("src", "dst", "label")


# --- rules --------------------------------------------------------------------------------------

B = S.BASE


def tbox(spark, d):
    """Axioms derived from the tables: places as classes, order classes, and one axiom for each kind of rule."""
    place = R.tbox_from_dimension(place_table(spark, d), ["region", "nation"], B)
    rows = [
        (B + "Order", R.SUB_CLASS, B + "Document"), (B + "Document", R.SUB_CLASS, B + "Thing"), (B + "placedBy", R.SUB_PROPERTY, B + "concerns"),
        (B + "orderNation", R.CHAIN, "_:a"), ("_:a", R.FIRST, B + "placedBy"), ("_:a", R.REST, "_:b"), ("_:b", R.FIRST, B + "inNation"), ("_:b", R.REST, R.RDF + "nil"),
        (B + "placedBy", R.DOMAIN, B + "Purchase"), (B + "placedBy", R.RANGE, B + "Buyer"),
        ("_:some", R.SOME, B + "Customer"), ("_:some", R.ON, B + "placedBy"), ("_:some", R.SUB_CLASS, B + "CustomerOrder"),
        (B + "Customer", R.SUB_CLASS, "_:value"), ("_:value", R.VALUE, B + "Sales"), ("_:value", R.ON, B + "handledBy"),
        ("_:both", R.INTERSECTION, "_:c"), ("_:c", R.FIRST, B + "Document"), ("_:c", R.REST, "_:d"), ("_:d", R.FIRST, B + "Purchase"), ("_:d", R.REST, R.RDF + "nil"), ("_:both", R.SUB_CLASS, B + "PaidDocument"),
    ]
    return R.merged_tbox(place, tables.local(spark, rows, "s string, p string, o string"))


SQL_PLACE_TBOX = f"SELECT '{B}' || n_name AS s, '{R.SUB_CLASS}' AS p, '{B}' || r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name"


@plain(SQL_PLACE_TBOX.replace("SELECT", "SELECT DISTINCT", 1))
def tbox_from_dimension(spark, d):
    return R.tbox_from_dimension(place_table(spark, d), ["region", "nation"], B)


@plain(f"SELECT substr(sha256(string_agg(l, chr(10) ORDER BY l)), 1, 16) AS version FROM (SELECT DISTINCT s || ' ' || p || ' ' || o AS l FROM ({SQL_PLACE_TBOX}))")
def tbox_version(spark, d):
    return R.tbox_version(tbox_from_dimension(spark, d))


def facts(spark, d, axioms):
    return Graph.of_files(S.links(spark, d), axioms.relevant(S.triples(spark, d).drop("seq")))  # closures don't ask for the order


def one_rule(spark, d, rule):
    axioms = R.Axioms(tbox(spark, d), [rule])
    return R.once(rule, facts(spark, d, axioms), axioms).select("context_id", "s", "p", "o", "is_literal")


TYPE = T.RDF_TYPE
FACTS = ", f AS (SELECT * FROM graphs) "


@query(FACTS + f"SELECT context_id, s, p, t.c AS o, is_literal FROM f, (SELECT unnest(['{B}Document', '{B}Thing']) AS c) t WHERE p = '{TYPE}' AND o = '{B}Order' UNION ALL SELECT context_id, s, p, '_:value', is_literal FROM f WHERE p = '{TYPE}' AND o = '{B}Customer'")
def types_by_subclass(spark, d):
    return one_rule(spark, d, R.sub_class)


@query(FACTS + f"SELECT context_id, s, '{B}concerns' AS p, o, is_literal FROM f WHERE p = '{B}placedBy'")
def sub_property(spark, d):
    return one_rule(spark, d, R.sub_property)


@query(FACTS + f"SELECT DISTINCT a.context_id AS context_id, a.s AS s, '{B}orderNation' AS p, b.o AS o, b.is_literal AS is_literal FROM f a JOIN f b ON a.context_id = b.context_id AND a.o = b.s WHERE a.p = '{B}placedBy' AND b.p = '{B}inNation'")
def property_chain(spark, d):
    return one_rule(spark, d, R.chain)


@query(FACTS + f"SELECT DISTINCT a.context_id AS context_id, a.s AS s, '{TYPE}' AS p, '{B}CustomerOrder' AS o, false AS is_literal FROM f a JOIN f b ON a.context_id = b.context_id AND a.o = b.s WHERE a.p = '{B}placedBy' AND b.p = '{TYPE}' AND b.o = '{B}Customer'")
def some_values_from(spark, d):
    return one_rule(spark, d, R.some_values)


@query(FACTS + f"SELECT DISTINCT context_id, s, '{B}handledBy' AS p, '{B}Sales' AS o, false AS is_literal FROM f WHERE p = '{TYPE}' AND o = '{B}Customer'")
def has_value(spark, d):
    return one_rule(spark, d, R.has_value)


@query(FACTS + f"SELECT DISTINCT context_id, s, '{TYPE}' AS p, '{B}Purchase' AS o, false AS is_literal FROM f WHERE p = '{B}placedBy'")
def domain_types(spark, d):
    return one_rule(spark, d, R.domain)


@query(FACTS + f"SELECT DISTINCT context_id, o AS s, '{TYPE}' AS p, '{B}Buyer' AS o, false AS is_literal FROM f WHERE p = '{B}placedBy'")
def range_types(spark, d):
    return one_rule(spark, d, R.range_)


CLOSED = f""", f AS (SELECT context_id, s, p, o, is_literal FROM graphs),
pb AS (SELECT * FROM f WHERE p = '{B}placedBy'), cu AS (SELECT * FROM f WHERE p = '{TYPE}' AND o = '{B}Customer'),
six AS (
  SELECT context_id, s, '{TYPE}' AS p, t.c AS o, false AS is_literal FROM f, (SELECT unnest(['{B}Document', '{B}Thing']) AS c) t WHERE p = '{TYPE}' AND o = '{B}Order'
  UNION SELECT context_id, s, '{B}concerns', o, false FROM pb
  UNION SELECT a.context_id, a.s, '{B}orderNation', b.o, false FROM pb a JOIN f b ON a.context_id = b.context_id AND a.o = b.s WHERE b.p = '{B}inNation'
  UNION SELECT a.context_id, a.s, '{TYPE}', '{B}CustomerOrder', false FROM pb a JOIN cu b ON a.context_id = b.context_id AND a.o = b.s
  UNION SELECT context_id, s, '{TYPE}', '_:value', false FROM cu
  UNION SELECT context_id, s, '{B}handledBy', '{B}Sales', false FROM cu
),
eight AS (
  SELECT * FROM six UNION SELECT context_id, s, '{TYPE}', '{B}Purchase', false FROM pb UNION SELECT context_id, o, '{TYPE}', '{B}Buyer', false FROM pb
  UNION SELECT a.context_id, a.s, '{TYPE}', '{B}PaidDocument', false FROM pb a JOIN f b ON a.context_id = b.context_id AND a.s = b.s WHERE b.p = '{TYPE}' AND b.o = '{B}Order'
)
"""


def closed(spark, d, rules, *wanted):
    axioms = R.Axioms(tbox(spark, d), rules, wanted)
    return R.closure(facts(spark, d, axioms), axioms).select("context_id", "s", "p", "o", "is_literal")


@query(CLOSED + "SELECT context_id, s, p, o, is_literal FROM six")
def closure_six_rules(spark, d):
    return closed(spark, d, R.SIX)


@query(CLOSED + "SELECT context_id, s, p, o, is_literal FROM eight")
def closure(spark, d):
    return closed(spark, d, R.EIGHT)


@query(CLOSED + f"SELECT context_id, s, p, o, is_literal FROM eight WHERE o IN ('{B}Document', '{B}Thing', '{B}Purchase', '{B}Buyer', '_:value') OR p = '{B}concerns'")
def rdfs_closure(spark, d):
    """With the RDFS rules alone."""
    return closed(spark, d, R.RDFS_RULES)


@query(CLOSED + f"SELECT context_id, s, p, o, is_literal FROM eight WHERE o = '{B}PaidDocument'")
def intersection_types(spark, d):
    return closed(spark, d, R.EIGHT, B + "PaidDocument")


@query(CLOSED + f""" SELECT DISTINCT s, p, o, is_literal, '{B}context/' || final_id || '-inf' AS graph FROM eight JOIN knowledge USING (context_id)
UNION SELECT '{B}context/' || final_id, '{T.CKR}hasModule', '{B}context/' || final_id || '-inf', false, '{B}context/' || final_id FROM cells
UNION SELECT '{B}context/' || final_id || '-inf', '{T.CKR}closureOf', '{B}context/' || final_id, false, '{B}context/' || final_id FROM cells
UNION SELECT '{B}context/' || final_id || '-inf', '{T.CKR}derivedFrom', '{B}context/' || final_id || '-mod', false, '{B}context/' || final_id FROM cells""")
def derived_quads(spark, d):
    axioms = R.Axioms(tbox(spark, d), R.EIGHT)
    derived = T.stamp(R.closure(spec_graph(spark, d, axioms), axioms), known(spark, d), B, "-inf")
    return T.union(derived, T.derived_metadata(finals(spark, d), B)).select(*QUAD)


@query(CLOSED + f""" SELECT {SQL_QUAD} FROM answer UNION SELECT s, p, o, is_literal, '{B}context/' || final_id || '-inf' AS graph FROM eight JOIN knowledge USING (context_id)
UNION SELECT '{B}context/' || final_id, '{T.CKR}hasModule', '{B}context/' || final_id || '-inf', false, '{B}context/' || final_id FROM cells
UNION SELECT '{B}context/' || final_id || '-inf', '{T.CKR}closureOf', '{B}context/' || final_id, false, '{B}context/' || final_id FROM cells
UNION SELECT '{B}context/' || final_id || '-inf', '{T.CKR}derivedFrom', '{B}context/' || final_id || '-mod', false, '{B}context/' || final_id FROM cells
UNION SELECT '{B}context/' || final_id, '{T.OLAP}covers', '{B}context/' || context_id, false, '{B}context/' || final_id FROM knowledge WHERE context_id IN (SELECT context_id FROM spec) AND context_id <> final_id""")
def answer_with_reasoning(spark, d):
    return full_answer(spark, d, tbox=tbox(spark, d)).quads.select(*QUAD)


@query(CLOSED + f""" SELECT DISTINCT s, p, o, is_literal, '{B}context/' || final_id || '-inf' AS graph FROM eight JOIN knowledge USING (context_id)""")
def derived_module(spark, d):
    """The derived modules alone."""
    return T.in_modules(full_answer(spark, d, tbox=tbox(spark, d)).quads, "derived").select(*QUAD)


@query(with_graph(f""" SELECT ids.id AS id, coalesce(split_part(t, ':', 3), 'Resource') AS label FROM ids LEFT JOIN lab USING (id) UNION ALL SELECT '{S.BASE}context/' || final_id, 'Context' FROM cells"""))
def answer_lpg(spark, d):
    """Vertices of the answer as a property graph: resources, and the cells as contexts."""
    return full_answer(spark, d, representation="LPG").vertices.select("id", F.substring_index("label", ":", -1).alias("label"))


@query(with_graph(f" SELECT s AS src, o AS dst, p AS label FROM gt WHERE NOT is_literal AND p <> '{T.RDF_TYPE}'"))
def answer_graph_frame(spark, d):
    return full_answer(spark, d, representation="GRAPH_FRAME").edges
