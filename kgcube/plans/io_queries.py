"""Queries over sources, sinks, logs and streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from kgcube.operators import contexts as C
from kgcube.operators import graphs as G
from kgcube.operators import logs as L
from kgcube.operators import rules as R
from kgcube.operators import triples as T
from kgcube.operators.terms import Graph
from kgcube.plans import sales as S
from kgcube.plans.answer import logged
from kgcube.plans.cube import Catalog, Cube, register_roll_up
from kgcube.plans.queries import CLOSED, CUBE, QUAD, SQL_QUAD, flat_vertices, full_answer, graph_triples, index_tables, known, once, place_table, plain, query, spec_graphs, tbox, with_graph
from kgcube.sources import files, rdf, tables
from kgcube.streaming import ingest
from kgcube.streaming.materialised import Materialised, derived, touched

# --- text forms ---------------------------------------------------------------------------------


@query(f"SELECT {SQL_QUAD} FROM answer")
def nquads_roundtrip(spark, d):
    path = tables.new_folder(spark)
    rdf.write_nquads(full_answer(spark, d).quads, path, by_context=True)
    return rdf.read_nquads(spark, path)[0].select(*QUAD)


@plain(r"""SELECT '_:c' || c_custkey AS s, 'urn:p' AS p, t.o AS o, t.l AS is_literal, t.g AS graph FROM (SELECT c_custkey, unnest([{'o': c_name || chr(9) || 'é' || chr(128512) || 'C:\new', 'l': true, 'g': '_:g'}, {'o': '_:n' || c_nationkey, 'l': false, 'g': NULL}]) AS t FROM customer)""")
def nquads_terms(spark, d):
    """Lines of another writer: blank nodes, escapes by code point, comments, and no graph term."""
    path, c = tables.new_folder(spark), S.table(spark, d, "customer")
    s = F.concat(F.lit("_:c"), "c_custkey", F.lit(" <urn:p> "))
    text = F.concat(s, F.lit('"'), "c_name", F.lit(r'\t\u00e9\U0001F600C:\\new" _:g . # c'))
    c.select(F.explode(F.array(text, F.concat(s, F.lit("_:n"), "c_nationkey", F.lit(" .")), F.lit("# comment"), F.lit(""))).alias("value")).write.text(path)
    return rdf.read_nquads(spark, path)[0].select(*QUAD)


@query(CLOSED + """ SELECT DISTINCT s, p, o, is_literal FROM answer UNION SELECT s, p, o, is_literal FROM eight JOIN knowledge USING (context_id)""")
def ntriples_with_derived(spark, d):
    """Asserted and derived statements of a written answer, without metadata about modules."""
    path = tables.new_folder(spark)
    q = full_answer(spark, d, tbox=tbox(spark, d)).quads
    about = F.col("p").isin(T.OLAP + "covers", T.CKR + "hasModule", T.CKR + "closureOf", T.CKR + "derivedFrom")
    rdf.write_ntriples(q.where(~about), path)
    return rdf.read_nquads(spark, path)[0].select("s", "p", "o", "is_literal")


@plain(f"""SELECT DISTINCT '{S.BASE}' || p_type || '/' || p_brand AS s, '{R.SUB_CLASS}' AS p, '{S.BASE}' || p_type AS o FROM part UNION SELECT '{S.BASE}' || n_name, '{R.SUB_CLASS}', '{S.BASE}' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT DISTINCT '{S.BASE}made' || p_type, '{R.DOMAIN}', '{S.BASE}' || p_type FROM part""")
def supplementary_tbox(spark, d):
    """Axioms of a dimension, merged with those of a file that was written as N-Triples."""
    path, part = tables.new_folder(spark), S.table(spark, d, "part")
    iri = lambda *c: F.concat(F.lit(S.BASE), *c)
    none = F.lit(None).cast("string")
    row = lambda s, p, o: part.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(False).alias("is_literal"), none.alias("datatype"), none.alias("lang")).distinct()
    axioms = row(iri("p_type", F.lit("/"), "p_brand"), R.SUB_CLASS, iri("p_type")).unionByName(row(iri(F.lit("made"), "p_type"), R.DOMAIN, iri("p_type")))
    rdf.write_ntriples(axioms, path)
    return R.merged_tbox(R.tbox_from_dimension(place_table(spark, d), ["region", "nation"], S.BASE), rdf.read_nquads(spark, path)[0])


@query("SELECT DISTINCT s, p, o, is_literal FROM answer")
def ntriples_union(spark, d):
    path = tables.new_folder(spark)
    rdf.write_ntriples(full_answer(spark, d).quads, path)
    return rdf.read_nquads(spark, path)[0].select("s", "p", "o", "is_literal")


@query(with_graph(f" SELECT ids.id AS id, coalesce(split_part(t, ':', 3), 'Resource') AS label, props, (SELECT count(*) FROM gt WHERE NOT is_literal AND p <> '{T.RDF_TYPE}') AS n_edges FROM ids LEFT JOIN lab USING (id) LEFT JOIN lits USING (id)"))
def graph_json_roundtrip(spark, d):
    path, t = tables.new_folder(spark), graph_triples(spark, d)
    rdf.write_graph_json(G.vertices(t), G.edges(t), path)
    v, e = rdf.read_graph_json(spark, path)
    return flat_vertices(v).crossJoin(e.agg(F.count("*").alias("n_edges")))  # one row


@query(with_graph(f" SELECT s AS src, o AS dst, p AS label FROM gt WHERE NOT is_literal AND p <> '{T.RDF_TYPE}'"))
def lpg_rows(spark, d):
    path, t = tables.new_folder(spark), graph_triples(spark, d)
    rdf.write_lpg(G.vertices(t), G.edges(t), path)
    return rdf.normalise_lpg(spark.read.text(path))[1]


@query(with_graph(" SELECT ids.id AS id, coalesce(split_part(t, ':', 3), 'Resource') AS label FROM ids LEFT JOIN lab USING (id)"))
def lpg_vertices(spark, d):
    """Vertices from lines in three forms: with a type envelope, with a row envelope, and bare."""
    path, t = tables.new_folder(spark), graph_triples(spark, d)
    v, e, n = G.vertices(t), G.edges(t), F.pmod(F.xxhash64("id"), F.lit(3))
    rdf.write_lpg(v.where(n == 0), e, f"{path}/a")
    rdf.write_graph_json(v.where(n == 1), e.where(F.lit(False)), f"{path}/b")
    v.where(n == 2).select(F.to_json(F.struct("id", "label")).alias("value")).write.text(f"{path}/c")
    found = rdf.normalise_lpg(spark.read.text([f"{path}/{x}" for x in "abc"]))[0]
    return found.select("id", F.substring_index("label", ":", -1).alias("label"))


@query("SELECT 'quad' AS kind, (SELECT count(*) FROM answer) AS n UNION ALL SELECT 'summary', 1")
def result_summary(spark, d):
    path, a = tables.new_folder(spark), full_answer(spark, d)
    rdf.write_result(a.quads, a.summary(), path)
    return rdf.classify_lines(spark.read.text([f"{path}/data", f"{path}/summary"])).groupBy("kind").agg(F.count("*").alias("n"))


@plain("""SELECT substr(sha256(c_name || '|' || c_mktsegment), 1, 16) || '_' || replace(c_name, '#', '_') AS stored_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'aixm' WHEN c_mktsegment = 'MACHINERY' THEN 'fixm' END AS engine_id,
 CAST(length(c_mktsegment) AS BIGINT) AS size_bytes, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'no engine' END AS status FROM customer""")
def registered_files(spark, d):
    """Customers as files, their segment as media type; of two engines for one type the first counts."""
    raw = S.table(spark, d, "customer").select(F.col("c_name").alias("original_name"), F.col("c_mktsegment").alias("media_type"), F.col("c_mktsegment").alias("content"))
    engines = spark.createDataFrame([("aixm", "building", 1), ("fixm", "machinery", 2), ("other", "Building", 3)], "engine_id string, media_type string, priority int")
    return files.register_files(raw, engines).select("stored_name", "engine_id", "size_bytes", "status")


@plain("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE c_mktsegment END AS engine_id, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown engine' END AS status FROM customer")
def file_engines(spark, d):
    """Customers as files, their segment as engine id, which compares without case."""
    engines = spark.createDataFrame([("building", "a", 1), ("building", "b", 2), ("machinery", "c", 3)], "engine_id string, media_type string, priority int")
    return files.engine_by_id(S.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("engine_id")), engines).select("c_custkey", "engine_id", "status")


@query("SELECT 'sales' AS schema_id, (SELECT count(DISTINCT context_id) FROM knowledge) AS context_count, (SELECT count(*) FROM cells) AS final_context_count, (SELECT count(*) FROM answer) AS row_count, true AS success, NULL::VARCHAR AS error UNION ALL SELECT 'sales', NULL, NULL, NULL, false, 'unknown representation ' || chr(39) || 'TABLE' || chr(39)")
def query_log_rows(spark, d):
    """The log of a query that is built and written, and of one that fails."""
    root = tables.new_folder(spark)
    ctx, links = index_tables(spark, d)
    args = {"links": links, "triples": lambda names: S.triples(spark, d, names), "scope": S.scope_paths(), "roll_up": S.ROLL_UP}
    for form in ("RDF", "TABLE"):
        logged(CUBE, "sales", form, ctx, f"{root}/log", lambda a: rdf.write_nquads(a.quads, f"{root}/data"), representation=form, **args)
    return spark.read.parquet(f"{root}/log").select("schema_id", "context_count", "final_context_count", "row_count", "success", "error")


# --- logs: the events table stands in for a query log --------------------------------------------


def log(spark, d):
    e, i = S.table(spark, d, "events"), F.col("event_id")
    ms = {"resolve_ms": i % 50, "construct_ms": i % 70, "merge_ms": i % 30}
    total = i % 50 + i % 70 + i % 30 + F.floor(F.abs("value")).cast("long")
    text = F.when(F.col("user_id") % 3 == 0, "SELECT time_year=1996 ROLLUP ON time_month").otherwise("SELECT *")
    return e.select(i.alias("id"), F.col("event_type").alias("schema_id"), text.alias("query_text"), *(c.alias(n) for n, c in ms.items()), total.alias("total_ms"), (i % 5).alias("cache_hits"), (i % 4).alias("cache_misses"), (i % 10 != 0).alias("success"), F.col("ts").cast("timestamp").alias("completed_at"))


LOG = """WITH log AS (SELECT event_id AS id, event_type AS schema_id, CASE WHEN user_id % 3 = 0 THEN 'SELECT time_year=1996 ROLLUP ON time_month' ELSE 'SELECT *' END AS query_text, event_id % 50 AS resolve_ms, event_id % 70 AS construct_ms, event_id % 30 AS merge_ms,
 event_id % 50 + event_id % 70 + event_id % 30 + CAST(floor(abs(value)) AS BIGINT) AS total_ms, event_id % 5 AS cache_hits, event_id % 4 AS cache_misses, event_id % 10 <> 0 AS success, ts AS completed_at FROM events)
"""


@plain(LOG + "SELECT schema_id, count(*) AS n, count(*) FILTER (success) AS n_ok, count(*) FILTER (NOT success) AS n_error, quantile_cont(total_ms, 0.5) FILTER (success) AS p50, quantile_cont(total_ms, 0.95) FILTER (success) AS p95, quantile_cont(total_ms, 0.99) FILTER (success) AS p99, avg(total_ms) FILTER (success) AS avg_ms, max(total_ms) FILTER (success) AS max_ms FROM log GROUP BY schema_id")
def log_latency(spark, d):
    return L.latency(log(spark, d), "schema_id")


@plain(LOG + "SELECT avg(resolve_ms) AS resolve, avg(construct_ms) AS construct, avg(merge_ms) AS merge FROM log WHERE success")
def phase_means(spark, d):
    return L.phase_means(log(spark, d))


@plain(LOG + "SELECT schema_id, CASE WHEN sum(cache_hits + cache_misses) > 0 THEN sum(cache_hits) / sum(cache_hits + cache_misses) ELSE 0.0 END AS hit_ratio FROM log GROUP BY schema_id")
def hit_ratio(spark, d):
    return L.hit_ratio(log(spark, d), "schema_id")


@plain(LOG + "SELECT regexp_matches(query_text, '(?i)\\brollup\\b') AS rolled_up, avg(total_ms) AS avg_ms, count(*) AS n FROM log WHERE success GROUP BY 1")
def rollup_cost(spark, d):
    return L.rollup_cost(log(spark, d))


@query("SELECT 'sales' AS schema_id, engine_id, count(*) AS n_files FROM links GROUP BY engine_id")
def by_engine(spark, d):
    return L.ingested_by(S.links(spark, d).withColumn("schema_id", F.lit("sales")))


@query("SELECT engine_id, count(size_bytes) AS n, CAST(sum(size_bytes) AS BIGINT) AS total, max(size_bytes) AS most, quantile_cont(size_bytes, 0.5) AS p50, quantile_cont(size_bytes, 0.9) AS p90 FROM links GROUP BY engine_id")
def distributions(spark, d):
    return L.distribution(S.links(spark, d), "size_bytes", "engine_id")


@plain(LOG + "SELECT id, schema_id, row_number() OVER (PARTITION BY schema_id ORDER BY completed_at, id) AS position FROM log WHERE success")
def trend(spark, d):
    return L.trend(log(spark, d)).select("id", "schema_id", "position")


@plain(LOG + "SELECT id, schema_id, position FROM (SELECT id, schema_id, row_number() OVER (PARTITION BY schema_id ORDER BY completed_at DESC, id DESC) AS position FROM log) WHERE position <= 20")
def recent_n(spark, d):
    return L.recent(log(spark, d)).select("id", "schema_id", "position")


@plain(LOG + "SELECT id, total_ms FROM log WHERE schema_id = 'click' ORDER BY completed_at DESC, id LIMIT 20")
def log_page(spark, d):
    return L.page(log(spark, d), "click").select("id", "total_ms")


@plain(LOG + """SELECT start, sum(cache_hits) / greatest(sum(cache_hits + cache_misses), 1) AS hit_ratio FROM (
 SELECT cache_hits, cache_misses, unnest(generate_series(time_bucket(INTERVAL 15 SECONDS, completed_at) - INTERVAL 285 SECONDS, time_bucket(INTERVAL 15 SECONDS, completed_at), INTERVAL 15 SECONDS)) AS start FROM log) GROUP BY start""")
def rolling_hit_ratio(spark, d):
    out = L.rolling_hit_ratio(log(spark, d))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "hit_ratio")


@plain(LOG + """SELECT start, sum(cache_hits) / greatest(sum(cache_hits + cache_misses), 1) AS hit_ratio FROM (
 SELECT cache_hits, cache_misses, unnest(generate_series(time_bucket(INTERVAL 15 SECONDS, completed_at) - INTERVAL 285 SECONDS, time_bucket(INTERVAL 15 SECONDS, completed_at), INTERVAL 15 SECONDS)) AS start FROM log)
 WHERE start + INTERVAL 5 MINUTES <= (SELECT max(completed_at) FROM log) - INTERVAL 10 MINUTES GROUP BY start""")
def streaming_hit_ratio(spark, d):
    """The same from a stream: windows that are closed when events may be ten minutes late."""
    root = tables.new_folder(spark)
    log(spark, d).write.parquet(f"{root}/log")
    source = spark.readStream.schema(spark.read.parquet(f"{root}/log").schema).parquet(f"{root}/log")
    L.stream_hit_ratio(source, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "hit_ratio")


@query("SELECT engine_id, count(*) AS n_waiting FROM links WHERE context_id NOT IN (SELECT context_id FROM spec) GROUP BY engine_id")
def backlog(spark, d):
    links = S.links(spark, d)
    done = C.files_of(C.dice(CUBE, S.contexts(spark, d), S.scope_paths()), links)
    return L.backlog(links, done, "engine_id")


# --- streams ------------------------------------------------------------------------------------


@once
def stream(spark, d):
    """Tasks for all files of the sales cube, in JSON files with broken and repeated lines, run as a stream of two batches.
    Customers can't be read; those whose names end in 5 can on a second attempt."""
    root, links = tables.new_folder(spark), tables.stored(S.links(spark, d).select("stored_name", "engine_id", *CUBE.names))
    task = F.to_json(F.struct(F.lit("sales").alias("schemaId"), F.col("stored_name").alias("storedName"), F.col("engine_id").alias("engineId"), F.lit(1).alias("extra")))
    lines = links.select(task.alias("value")).unionByName(links.where("engine_id = 'nation'").select(task.alias("value")))
    broken = links.where("engine_id = 'region'").select(F.to_json(F.struct("stored_name")).alias("value"))
    n_files = ingest.write_tasks(lines.unionByName(broken), f"{root}/tasks", TASKS_IN_FILE)

    def links_of(tasks):
        own = files.likely(links, tasks.select(F.col("storedName").alias("stored_name")))  # a batch moves few links of others
        row = lambda status: ["stored_name", *CUBE.names, status.alias("status")]
        customer = F.col("engine_id") == "customer"
        again = customer & F.col("stored_name").endswith("5")
        known = own.where(~again).select(*row(F.when(customer, F.lit("unreadable"))))
        tried = tasks.where("engineId = 'customer'").select(F.col("storedName").alias("stored_name"), "attempts")
        return known.unionByName(own.where(again).join(tried, "stored_name").select(*row(F.when(F.col("attempts") == 0, F.lit("unreadable")))))

    work = ingest.Ingestion(spark, root, links_of, lambda x: C.write_index(CUBE, tables.stored(x), f"{root}/index", "sales", unique=True), cube=CUBE)
    work.run(ingest.read_tasks(spark, f"{root}/tasks", -(-n_files // 2)))
    work.drain()
    return root


TASKS_IN_FILE = ingest.TASKS_IN_FILE
READ = "(engine_id <> 'customer' OR stored_name LIKE '%5')"


@query(f"SELECT DISTINCT context_id, stored_name FROM links WHERE {READ}")
def stream_ingest_index(spark, d):
    return C.read_index(spark, f"{stream(spark, d)}/index", "context_files", "sales").select("context_id", "stored_name")


@query(f"SELECT DISTINCT stored_name, engine_id, 1 AS contexts_count FROM links WHERE {READ}")
def stream_events(spark, d):
    e = ingest.read_log(spark, stream(spark, d), "completed", "storedName string, engineId string, contexts_count int")
    return e.select(F.col("storedName").alias("stored_name"), F.col("engineId").alias("engine_id"), "contexts_count").distinct()


@query("SELECT stored_name, 'unreadable' AS status, 3 AS attempts, true AS final, 'tasks' AS origin FROM links WHERE engine_id = 'customer' AND stored_name NOT LIKE '%5' UNION ALL SELECT NULL, 'missing schemaId,storedName,engineId', NULL, NULL, NULL FROM links WHERE engine_id = 'region'")
def dead_letters(spark, d):
    """Files that failed three times, and messages that couldn't be decoded."""
    root = stream(spark, d)
    dead = ingest.read_log(spark, root, "dead", ingest.DEAD).select(F.col("storedName").alias("stored_name"), "status", "attempts", "final", "origin")
    return dead.unionByName(ingest.read_log(spark, root, "quarantine", "value string, status string").select("status"), allowMissingColumns=True)


@query(f"SELECT context_id FROM contexts WHERE context_id NOT IN (SELECT context_id FROM links WHERE {READ})")
def invalidated_contexts(spark, d):
    """Materialised graphs that are left when the stream has invalidated those of the contexts it touched."""
    cache = Materialised(spark, tables.new_folder(spark))
    ctx = tables.stored(S.contexts(spark, d).select("context_id"))
    cache.add(ctx, ctx, "RDF", at(11, 0))
    cache.invalidate(ingest.read_log(spark, stream(spark, d), "invalidated", "context_id string"), at(11, 30))
    return cache.fresh("RDF", at(11, 45)).select("context_id")


def at(hour: int, minute: int) -> datetime:
    return datetime(2024, 1, 1, hour, minute, tzinfo=timezone.utc)


@query("SELECT context_id, context_id IN (SELECT context_id FROM spec) AS hit FROM knowledge GROUP BY context_id")
def materialised_hits(spark, d):
    """Graphs of specific contexts are fresh, those of covering ones were built too long ago."""
    ctx, cache = S.contexts(spark, d), Materialised(spark, tables.new_folder(spark))
    for df, built in ((C.dice(CUBE, ctx, S.scope_paths()), at(11, 30)), (C.covering(ctx, S.scope_paths()), at(10, 30))):
        cache.add(df, df.select("context_id"), "RDF", built)
    hits, misses = cache.split(known(spark, d).select("context_id").distinct(), "RDF", at(12, 0))
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))


@query("SELECT context_id, count(*) AS n, CASE WHEN context_id IN (SELECT context_id FROM spec) THEN 'first' ELSE 'again' END AS build FROM graphs WHERE context_id IN (SELECT context_id FROM knowledge) GROUP BY context_id")
def materialised_graphs(spark, d):
    """All graphs are built; those of covering contexts become stale and are built again; the cache then has each once."""
    graphs, cache = tables.stored(spec_graphs(spark, d)), Materialised(spark, tables.new_folder(spark))
    needed = graphs.select("context_id").distinct()
    cache.add(needed, graphs, "RDF", at(11, 0))
    cache.invalidate(C.covering(S.contexts(spark, d), S.scope_paths()), at(11, 10))
    misses = tables.stored(cache.split(needed, "RDF", at(11, 20))[1])
    cache.add(misses, graphs.join(misses, "context_id", "left_semi"), "RDF", at(11, 20))
    first = int(at(11, 0).timestamp() * 1_000_000)
    rows = cache.rows("RDF", at(11, 30)).groupBy("context_id", "built").agg(F.count("*").alias("n"))
    return rows.select("context_id", "n", F.when(F.col("built") == first, "first").otherwise("again").alias("build"))


@query(CLOSED + " SELECT context_id, s, p, o, is_literal, true AS hit FROM eight WHERE context_id IN (SELECT context_id FROM knowledge) UNION ALL SELECT DISTINCT context_id, NULL, NULL, NULL, NULL, false FROM knowledge")
def cached_derived(spark, d):
    """Derived triples are kept by TBox version: with the same axioms all contexts are hits, with others none."""
    cache, box = Materialised(spark, tables.new_folder(spark)), tbox(spark, d)
    graphs = tables.stored(spec_graphs(spark, d))
    needed, name = graphs.select("context_id").distinct(), derived(R.tbox_version(box).first().version)
    cache.add(needed, R.closure(graphs, box), name, at(11, 0))
    hits, _ = cache.split(needed, name, at(11, 30))
    other = derived(R.tbox_version(box.where(F.col("p") != R.DOMAIN)).first().version)
    _, misses = cache.split(needed, other, at(11, 30))
    rows = cache.rows(name, at(11, 30)).join(hits, "context_id", "left_semi").select("context_id", "s", "p", "o", "is_literal", F.lit(True).alias("hit"))
    return rows.unionByName(misses.withColumn("hit", F.lit(False)), allowMissingColumns=True)


NUMBER = "CAST(split_part(stored_name, '/', 2) AS BIGINT)"
LATER = CLOSED.replace("f AS (SELECT context_id, s, p, o, is_literal FROM graphs)", f"f AS (SELECT DISTINCT context_id, s, p, o, is_literal FROM links JOIN tri USING (stored_name) WHERE {NUMBER} % 6 <> 0)")


@query(LATER + f" SELECT context_id, s, p, o, is_literal, context_id IN (SELECT context_id FROM links WHERE {NUMBER} % 6 < 2) AS again FROM eight")
def closure_after_changes(spark, d):
    """A sixth of the files is withdrawn and another comes in: only the contexts that these touch are closed again."""
    cache, box, number = Materialised(spark, tables.new_folder(spark)), tables.stored(tbox(spark, d)), F.substring_index("stored_name", "/", -1).cast("long")
    links = tables.stored(S.links(spark, d).select("stored_name", "context_id"))
    before, after = links.where(number % 6 != 1), links.where(number % 6 != 0)

    def facts_of(links):
        def facts(contexts):
            own = tables.stored(links.join(contexts, "context_id", "left_semi"))
            return Graph.of_files(own, S.triples(spark, d, own.select("stored_name").distinct()))

        return facts

    cache.derived(before.select("context_id"), facts_of(before), box, at(11, 0))
    cache.invalidate(touched(before, after), at(11, 10))
    rows = cache.derived(after.select("context_id"), facts_of(after), box, at(11, 20))
    first = int(at(11, 0).timestamp() * 1_000_000)
    return rows.select("context_id", "s", "p", "o", "is_literal", (F.col("built") != first).alias("again"))


@query("SELECT context_id, count(*) AS n FROM graphs WHERE context_id IN (SELECT context_id FROM knowledge) AND context_id NOT IN (SELECT context_id FROM cover) GROUP BY context_id")
def cleared_graphs(spark, d):
    """What the files of the cache hold after the covering contexts were cleared: nothing of these."""
    graphs, root = tables.stored(spec_graphs(spark, d)), tables.new_folder(spark)
    cache = Materialised(spark, root)
    cache.add(graphs.select("context_id").distinct(), graphs, "RDF", at(11, 0))
    cache.clear(C.covering(S.contexts(spark, d), S.scope_paths()))
    return spark.read.parquet(f"{root}/rows").groupBy("context_id").agg(F.count("*").alias("n"))


# --- schemas, noise, late tasks -----------------------------------------------------------------


def region_cubes(spark, d):
    """A schema for each region, with its number of nations as levels; ids as the regions are called."""
    rows = S.geography(spark, d).groupBy("r_name").agg(F.count("*").alias("n")).orderBy("r_name").collect()  # a row a region
    levels = [{"name": "year", "depth": 0}, {"name": "month", "depth": 1, "rollup_to": "year", "rollup_function": "date_to_year"}]
    return [{"id": r.r_name.lower(), "dimensions": {"time": {"levels": levels[: 1 + r.n % 2]}}} for r in rows]


@plain("SELECT lower(r_name) AS id, CASE WHEN regexp_full_match(lower(r_name), '[a-z][a-z0-9_-]*') THEN CASE WHEN count(*) % 2 = 0 THEN 'year' ELSE 'year>month' END END AS levels FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def cataloged_schemas(spark, d):
    """Schemas that two writers registered, each reading what the other wrote; ids that no schema may have are refused."""
    path, refused = tables.new_folder(spark), []
    for data in region_cubes(spark, d):
        for writer in (Catalog(spark, path), Catalog(spark, path)):
            try:
                writer.register(data)
            except ValueError:
                refused.append((data["id"], None))
    reader = Catalog(spark, path)
    known = [(r.id, reader.describe(r.id).first().levels) for r in reader.list().select("id").collect()]
    return tables.local(spark, known + refused[::2], "id string, levels string")


@plain("SELECT DISTINCT substr(c_name, 1, 1) || '>' || c_name AS path, c_name AS name FROM customer")
def registered_roll_up(spark, d):
    """Paths of names under their first letters, by a roll-up function of the user."""
    register_roll_up("first_letter", lambda c: F.substring(c, 1, 1))
    levels = [{"name": "letter", "depth": 0}, {"name": "name", "depth": 1, "rollup_to": "letter", "rollup_function": "first_letter"}]
    own = Cube.load({"id": "names", "dimensions": {"text": {"levels": levels}}})
    names = S.table(spark, d, "customer").select(F.col("c_name").alias("name")).distinct()
    return own.member_path(None, names, "text", "name", "name", "path").select(F.array_join("path", ">").alias("path"), "name")


@query("SELECT s, p, o FROM tri WHERE is_literal AND (contains(o, '\"') OR contains(o, chr(10)))")
def escaped_literals(spark, d):
    """Literals with quotes, backslashes, tabs and line ends, written as N-Quads and read again."""
    path = tables.new_folder(spark)
    rows = S.triples(spark, d).where(F.col("is_literal") & (F.col("o").contains('"') | F.col("o").contains("\n")))
    rdf.write_nquads(rows.select(*T.TRIPLE, F.lit("urn:kgcube:context/x-mod").alias("graph")), path)
    return rdf.read_nquads(spark, path)[0].select("s", "p", "o")


@query("SELECT DISTINCT context_id, s, p, o FROM graphs WHERE p = 'urn:kgcube:placedBy'")
def noise_left_out(spark, d):
    """Of facts and as many each that are reflexive, about vocabulary, about schema, or types that say nothing, the facts."""
    f = T.context_graph(S.links(spark, d), S.triples(spark, d)).where(F.col("p") == S.BASE + "placedBy").select(*R.FACT)
    row = lambda s=F.col("s"), p=F.col("p"), o=F.col("o"): F.struct(s.alias("s"), p.alias("p"), o.alias("o"), *R.FACT[4:])
    noise = [row(o=F.col("s")), row(s=F.concat(F.lit(R.RDFS), "s")), row(p=F.lit(R.DOMAIN)), row(p=F.lit(T.RDF_TYPE), o=F.lit(R.META[3])), row(p=F.lit("urn:p"), o=F.lit(R.RESOURCE))]
    f = f.select("context_id", F.explode(F.array(row(), *noise)).alias("f")).select("context_id", "f.*")
    return R.drop_noise(f).select("context_id", "s", "p", "o")


@query(f"SELECT stored_name, 'first' AS engine_id FROM links UNION ALL SELECT stored_name, 'later' FROM links WHERE {NUMBER} % 2 = 1")
def late_tasks(spark, d):
    """What was processed when, over two batches, tasks of even files come late and those of odd ones anew."""
    root = tables.new_folder(spark)
    number = F.substring_index("stored_name", "/", -1).cast("long")
    found = tables.stored(S.links(spark, d).select("stored_name", *CUBE.names))

    def tasks(engine, time):
        task = F.struct(F.lit("sales").alias("schemaId"), F.col("stored_name").alias("storedName"), F.lit(engine).alias("engineId"), time.alias("timestamp"))
        return ingest.parse_tasks(found.select(F.to_json(task).alias("value")))

    work = ingest.Ingestion(spark, root, lambda x: found.withColumn("status", F.lit(None).cast("string")), lambda x: None, cube=CUBE)  # links of other files don't count
    work.batch(tasks("first", F.lit("2024-01-02T00:00:00Z")), "000000000000-000")
    work.batch(tasks("later", F.when(number % 2 == 1, "2024-01-03T00:00:00Z").otherwise("2024-01-01T00:00:00Z")), "000000000001-000")
    return ingest.read_log(spark, root, "log", ingest.LOG).select("stored_name", "engine_id")
