"""Ingestion, materialised graphs, sources and rules on small cases."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from kgcube.operators import contexts as C
from kgcube.operators import graphs as G
from kgcube.operators import logs as L
from kgcube.operators import messages as M
from kgcube.operators import rules as R
from kgcube.plans import sales as S
from kgcube.plans.cube import Cube
from kgcube.sources import files, rdf, tables
from kgcube.sources.tables import stored
from kgcube.streaming import ingest
from kgcube.streaming.materialised import Materialised

CUBE = S.cube()
PATHS = "place array<string>, segment array<string>, time array<string>"


def links(spark, *names):
    rows = [(n, "e", ["ASIA", n[0]], [], []) for n in names]
    return spark.createDataFrame(rows, f"stored_name string, engine_id string, {PATHS}").withColumn("context_id", CUBE.context_id())


def lines(spark, *names):
    values = [f'{{"schemaId":"sales","storedName":"{n}","engineId":"e","more":1}}' for n in names] + ["nonsense", '{"schemaId":"sales"}']
    return ingest.parse_tasks(spark.createDataFrame([(v,) for v in values], "value string"))


def test_replayed_batches_and_attempts(spark):
    root, tried = tables.new_folder(spark), []

    def analyse(tasks):
        tried.append({r.storedName: r.attempts for r in tasks.collect()})
        x = tasks.select(F.col("storedName").alias("stored_name"), "attempts").join(links(spark, "a1", "a2", "b1", "c1"), "stored_name", "left")
        bad = F.col("stored_name").startswith("c") | ((F.col("stored_name") == "b1") & (F.col("attempts") == 0))
        return x.withColumn("status", F.when(bad, "no").when(F.col("context_id").isNull() & (F.col("stored_name") != "z"), "lost"))

    def index(x):
        C.write_index(CUBE, x.where("context_id is not null"), f"{root}/index", "sales")

    work = ingest.Ingestion(spark, root, analyse, index)
    first = lines(spark, "a1", "b1", "c1", "a1")
    for _ in range(2):  # delivered twice
        work.batch(first, "000000000000-000")
    assert tried[0] == tried[1] == {"a1": 0, "b1": 0, "c1": 0}
    work.batch(lines(spark, "a2", "z"), "000000000001-000")
    assert tried[2] == {"a2": 0, "z": 0, "b1": 1, "c1": 1}
    work.drain()
    assert tried[3:] == [{"c1": 2}]
    files_in = sorted(r.stored_name for r in C.read_index(spark, f"{root}/index", "context_files", "sales").collect())
    assert files_in == ["a1", "a2", "b1"]
    log = {r.stored_name: r.contexts_count for r in ingest.read_log(spark, root, "log", ingest.LOG).collect()}
    assert log == {"a1": 1, "a2": 1, "b1": 1, "z": 0} and ingest.read_log(spark, root, "log", ingest.LOG).count() == 4
    assert [(r.storedName, r.attempts, r.final, r.status) for r in ingest.read_log(spark, root, "dead", ingest.DEAD).collect()] == [("c1", 3, True, "no")]
    assert ingest.read_log(spark, root, "quarantine", "value string, status string").count() == 4


def test_index_keeps_schemas_apart(spark):
    root = tables.new_folder(spark)
    for schema, names in (("one", ("a1", "b1")), ("two", ("a1",)), ("one", ("a1", "c1"))):
        C.write_index(CUBE, links(spark, *names), root, schema)
    count = lambda schema: C.read_index(spark, root, "context_files", schema).count()
    assert (count("one"), count("two")) == (3, 1)
    C.compact_index(CUBE, spark, root, "one")
    assert (count("one"), count("two")) == (3, 1)
    C.reset(spark, root, "one")
    assert (count("one"), count("two")) == (0, 1)
    C.reset(spark, root)
    assert not tables.names(spark, root)
    with pytest.raises(ValueError):
        C.write_index(CUBE, links(spark, "a1"), root, "Bad Id")


def test_materialised_graphs(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    cache = Materialised(spark, tables.new_folder(spark))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "context_id string")
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "context_id string, n int")
    assert cache.fresh("RDF", at(9)).count() == 0
    cache.add(ids("a", "b"), rows, "RDF", at(9))
    assert {r.context_id for r in cache.fresh("RDF", at(9, 30)).collect()} == {"a", "b"} and cache.fresh("LPG", at(9)).count() == 0
    hits, misses = cache.split(ids("a", "c"), "RDF", at(9, 30))
    assert [r.context_id for r in hits.collect()] == ["a"] and [r.context_id for r in misses.collect()] == ["c"]
    cache.invalidate(ids("a"), at(9, 10))
    assert [r.context_id for r in cache.fresh("RDF", at(9, 30)).collect()] == ["b"]
    cache.add(ids("a"), rows, "RDF", at(9, 40))
    assert cache.rows("RDF", at(9, 50)).count() == 2 and cache.fresh("RDF", at(10, 30)).count() == 1
    cache.expire(at(10, 30))
    assert cache.fresh("RDF", at(10, 30)).count() == 1
    cache.clear()
    assert cache.fresh("RDF", at(9, 50)).count() == 0


def facts(spark, *rows):
    return spark.createDataFrame([("c", *r, False, None, None) for r in rows], "context_id string, s string, p string, o string, is_literal boolean, datatype string, lang string")


def tbox(spark, *rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def derived(df):
    return {(r.s, r.p, r.o) for r in df.collect()}


def test_rules_on_small_facts(spark):
    f = facts(spark, ("v", R.RDF_TYPE, "VOR"), ("f", "usedRunway", "r"), ("r", "airport", "h"), ("x", "sub", "y"))
    t = tbox(spark, ("VOR", R.SUB_CLASS, "Navaid"), ("airport", R.DOMAIN, "Runway"), ("airport", R.RANGE, "Airport"), ("Airport", R.SUB_CLASS, "Place"), ("sub", R.SUB_PROPERTY, "airport"),
             ("atAirport", R.CHAIN, "_:a"), ("_:a", R.FIRST, "usedRunway"), ("_:a", R.REST, "_:b"), ("_:b", R.FIRST, "airport"), ("_:b", R.REST, R.RDF + "nil"))
    want = {("v", R.RDF_TYPE, "Navaid"), ("r", R.RDF_TYPE, "Runway"), ("h", R.RDF_TYPE, "Airport"), ("h", R.RDF_TYPE, "Place"), ("f", "atAirport", "h"), ("x", "airport", "y"), ("x", R.RDF_TYPE, "Runway"), ("y", R.RDF_TYPE, "Airport"), ("y", R.RDF_TYPE, "Place")}
    assert derived(R.closure(f, t)) == want
    assert derived(R.closure(f, t, R.SIX)) == {("v", R.RDF_TYPE, "Navaid"), ("f", "atAirport", "h"), ("x", "airport", "y")}
    assert derived(R.closure(f, t, [R.domain])) == {("r", R.RDF_TYPE, "Runway")}

    def everything_is_known(new, known, box):  # a rule of one's own
        return new.select("context_id", F.col("o").alias("s"), F.lit("known").alias("p"), F.lit("yes").alias("o"), "is_literal", "datatype", "lang").where("s <> 'yes'")

    assert ("h", "known", "yes") in derived(R.closure(f, t, [*R.EIGHT, everything_is_known]))


def test_noise_is_dropped(spark):
    keep = ("a", "p", "b")
    noise = [("a", "p", "a"), (R.RDFS + "x", "p", "b"), ("a", R.RDF_TYPE, R.RESOURCE), ("a", R.SUB_CLASS, "b"), ("a", R.DOMAIN, "b"), ("a", R.REST, "b"), ("a", R.RDF_TYPE, R.OWL + "Class"), (R.OWL + "Thing", R.RDF_TYPE, "b")]
    assert derived(R.drop_noise(facts(spark, keep, *noise))) == {keep}


def test_escapes_and_blank_nodes(spark):
    path = tables.new_folder(spark)
    values = ["C:\\new", 'say "x"', "a\nb\rc", "\\\\n", "tab\t", "\\", "\\u0041"]
    q = spark.createDataFrame([("_:b", "p", v, True, None, None, "urn:context/1-mod") for v in values] + [("s", "p", "_:o", False, None, None, "urn:context/2")], "s string, p string, o string, is_literal boolean, datatype string, lang string, graph string")
    for by_context in (False, True):
        rdf.write_nquads(q, f"{path}/{by_context}", by_context)
        back, bad = rdf.read_nquads(spark, f"{path}/{by_context}")
        assert sorted(map(str, back.collect())) == sorted(map(str, q.collect())) and bad.count() == 0
    assert sorted(tables.names(spark, f"{path}/True")) == ["_SUCCESS", "context_id=1", "context_id=2"]


def test_result_with_an_error(spark):
    path = tables.new_folder(spark)
    q = spark.createDataFrame([("s", "p", "o", False, None, None, "g")], "s string, p string, o string, is_literal boolean, datatype string, lang string, graph string")
    rdf.write_result(q, spark.createDataFrame([(1,)], "row_count int"), f"{path}/a")
    with pytest.raises(Exception):
        rdf.write_result(q.withColumn("s", F.raise_error(F.lit("broken"))), spark.createDataFrame([(1,)], "row_count int"), f"{path}/b")
    kinds = lambda x: [r.kind for r in rdf.classify_lines(spark.read.text(f"{path}/{x}/summary")).collect()]
    assert kinds("a") == ["summary"] and kinds("b") == ["error"]


def test_registries(spark):
    M.register_engine(M.Engine("Own", ("text/own",), M.fixm_features, M.MAPPINGS["fixm"]))
    try:
        found = files.engine_by_id(spark.createDataFrame([("f", "OWN"), ("g", "none")], "stored_name string, engine_id string"), M.engine_table(spark))
        assert {(r.stored_name, r.engine_id, r.status) for r in found.collect()} == {("f", "Own", None), ("g", "none", "unknown engine")}
        named = files.with_engine(spark.createDataFrame([("f", "Text/Own")], "stored_name string, media_type string"), M.engine_table(spark))
        assert named.first().engine_id == "Own"
    finally:
        del M.ENGINES["own"]
    G.register_representation("COUNT", lambda t: (t.groupBy("s").count(),))
    assert G.REPRESENTATIONS.pop("COUNT")(facts(spark, ("a", "p", "b")))[0].first()["count"] == 1


def test_dimension_table_and_labels(spark):
    data = {**S.SALES, "dimensions": {**S.SALES["dimensions"], "place": {**S.SALES["dimensions"]["place"], "hierarchies": [{"region": "ASIA", "nation": "N1"}, {"region": "EUROPE"}]}}}
    assert [tuple(r) for r in Cube.load(data).table(spark, "place").orderBy("position").collect()] == [(0, "ASIA", "N1"), (1, "EUROPE", None)]
    t = spark.createDataFrame([("a", R.RDF_TYPE, "urn/Z", False, 0), ("a", R.RDF_TYPE, "urn/A", False, 1), ("b", R.RDF_TYPE, "x/y", True, 0), ("c", "urn/p", "a", False, 0)], "s string, p string, o string, is_literal boolean, seq int")
    assert {r.id: r.label for r in G.vertices(t).collect()} == {"a": "Z", "b": "x/y", "c": "Resource"}


def test_percentiles_of_nulls_and_ties(spark):
    log = spark.createDataFrame([(None, 5, True), (None, 5, True), (None, 8, True), ("a", 1, False), ("b", None, True)], "schema_id string, total_ms long, success boolean")
    got = {r.schema_id: (r.n, r.p50, r.p95) for r in L.latency(log, "schema_id").collect()}
    assert got[None][:2] == (3, 5.0) and abs(got[None][2] - 7.7) < 1e-9 and got["a"] == (1, None, None) and got["b"] == (1, None, None)
    assert L.latency(log).count() == 1 and L.latency(log.limit(0)).count() == 1


def test_registered_roll_up(spark):
    from kgcube.plans import cube

    cube.register_roll_up("first_letter", lambda c: F.substring(c, 1, 1))
    try:
        levels = [{"name": "letter", "depth": 0}, {"name": "word", "depth": 1, "rollup_to": "letter", "rollup_function": "first_letter"}]
        own = Cube.load({"id": "words", "dimensions": {"text": {"levels": levels}}})
        assert own.scope(spark, {"text": {"word": "abc"}}) == {"text": ["a", "abc"]}
        flags = {(r.level, r.other): r.rolls_up for r in own.level_order(spark).collect()}
        assert flags == {("letter", "letter"): True, ("letter", "word"): False, ("word", "letter"): True, ("word", "word"): True}
    finally:
        del cube.ROLL_UPS["first_letter"]


def test_a_small_batch_reads_a_bounded_part_of_the_index(spark):
    root = tables.new_folder(spark)
    many = spark.range(20_000).select(F.concat(F.lit("f"), F.col("id")).alias("stored_name"), F.lit("e").alias("engine_id"), F.array(F.lit("ASIA"), F.concat(F.lit("N"), F.col("id") % 3000)).alias("place"), F.array().cast("array<string>").alias("segment"), F.array().cast("array<string>").alias("time")).withColumn("context_id", CUBE.context_id())
    C.write_index(CUBE, many, root, "sales")
    size = lambda name: C.read_index(spark, root, name, "sales").count()
    assert (size("contexts"), size("context_files")) == (3000, 20_000)
    new = links(spark, *(f"x{i}" for i in range(10)))
    path = f"{root}/context_files/schema_id=sales"
    keyed = C._keyed(new, C.TABLES["context_files"])
    touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]
    assert len(touched) <= 10 and len(C._may_hold(keyed, path, touched)) <= 2  # bits of 20,000 keys among 32 * 2**20 places
    old = C._keyed(many.where("stored_name in ('f7', 'f8')"), C.TABLES["context_files"])
    assert len(C._may_hold(old, path, [r.bucket for r in old.select("bucket").distinct().collect()])) == old.select("bucket").distinct().count()
    for _ in range(2):
        C.write_index(CUBE, new.unionByName(many.where("stored_name < 'f11'"), allowMissingColumns=True), root, "sales")
        assert (size("contexts"), size("context_files")) == (3001, 20_010)
    C.compact_index(CUBE, spark, root, "sales")
    C.write_index(CUBE, many, root, "sales")
    assert (size("contexts"), size("context_files")) == (3001, 20_010)


def test_a_batch_moves_no_more_than_it_must(spark):
    root = tables.new_folder(spark)
    found = links(spark, "a1", "a2", "b1").withColumn("status", F.when(F.col("stored_name") == "b1", "bad"))
    found = found.unionByName(links(spark, "b1").withColumn("status", F.lit(None).cast("string")))  # good and bad rows: the file fails as a whole
    work = ingest.Ingestion(spark, root, lambda tasks: found.join(tasks.select(F.col("storedName").alias("stored_name")), "stored_name"), lambda x: C.write_index(CUBE, x, f"{root}/index", "sales"))
    work.batch(lines(spark, "a1", "b1"), "000000000000-000")
    path = f"{root}/index/context_files/schema_id=sales"
    new = C._keyed(links(spark, "a1", "a2"), C.TABLES["context_files"])
    assert [r.stored_name for r in C._maybe(new, path, list(range(C.BUCKETS))).collect()] == ["a1"]  # only this key is compared
    work.batch(lines(spark, "a1", "a2"), "000000000001-000")
    assert sorted(r.stored_name for r in C.read_index(spark, f"{root}/index", "context_files", "sales").collect()) == ["a1", "a2"]
    assert {r.storedName: r.status for r in ingest.read_log(spark, root, "waiting/batch=000000000000-000", ingest.WAITING).collect()} == {"b1": "bad"}
    for kind in ("log", "completed", "invalidated", "waiting"):
        parts = [n for n in tables.names(spark, f"{root}/{kind}/batch=000000000000-000") if n.startswith("part-")]
        assert parts and all(n.endswith(".gz") for n in parts)


def test_late_tasks_and_other_schemas(spark):
    root, indexed, engines = tables.new_folder(spark), [], []

    def analyse(tasks):
        engines.append({r.storedName: r.engineId for r in tasks.collect()})
        return tasks.select(F.col("storedName").alias("stored_name"), F.col("engineId").alias("engine_id"), F.lit("c").alias("context_id"), F.lit(None).cast("string").alias("status"))

    work = ingest.Ingestion(spark, root, analyse, lambda x: indexed.append(sorted((r.schema_id, r.stored_name) for r in x.collect())))

    def tasks(*rows):
        return ingest.parse_tasks(spark.createDataFrame([(f'{{"schemaId":"{s}","storedName":"{n}","engineId":"{e}","timestamp":"{t}"}}',) for s, n, e, t in rows], "value string"))

    work.batch(tasks(("a", "f", "new", "2024-01-02"), ("a", "f", "old", "2024-01-01"), ("b", "g", "e", "2024-01-01")), "000000000000-000")
    assert engines[-1] == {"f": "new", "g": "e"} and indexed == [[("a", "f")], [("b", "g")]]
    again = ingest.Ingestion(spark, root, analyse, lambda x: indexed.append(sorted((r.schema_id, r.stored_name) for r in x.collect())))  # after a restart
    again.batch(tasks(("a", "f", "older", "2024-01-01"), ("b", "g", "newer", "2024-01-03")), "000000000001-000")
    assert engines[-1] == {"g": "newer"}
    again.batch(tasks(("b", "g", "last", "2024-01-02"), ("b", "h", "e", "")), "000000000002-000")
    assert engines[-1] == {"h": "e"}


def test_links_by_paths_and_latest_tasks(spark):
    """Ids come from paths behind the shuffle, and a file's tasks and times of earlier batches meet in one shuffle, unsorted before it."""
    root, indexed = tables.new_folder(spark), []
    found = links(spark, "a1", "a2", "b1").unionByName(links(spark, "a1", "a1").withColumn("time", F.array(F.lit("1996"))).withColumn("context_id", CUBE.context_id()))
    bare = found.select("stored_name", *CUBE.names, F.when(F.col("stored_name") == "b1", "bad").alias("status"))
    work = ingest.Ingestion(spark, root, lambda tasks: bare, lambda x: indexed.append({(r.stored_name, r.engine_id, r.context_id, tuple(r.place)) for r in x.collect()}), cube=CUBE)
    tasks = ingest.parse_tasks(spark.createDataFrame([(f'{{"schemaId":"sales","storedName":"{n}","engineId":"{e}","timestamp":"{t}"}}',) for n, e, t in (("a1", "new", "2024-01-02"), ("a1", "old", "2024-01-01"), ("b1", "e", "2024-01-01"), ("z", "e", ""))], "value string"))
    work.batch(tasks, "000000000000-000")
    want = {(r.stored_name, "new", r.context_id, tuple(r.place)) for r in found.where("stored_name = 'a1'").collect()}
    assert len(want) == 2 and indexed == [want]
    assert {(r.stored_name, r.engine_id, r.contexts_count) for r in ingest.read_log(spark, root, "log", ingest.LOG).collect()} == {("a1", "new", 2), ("z", "e", 0)}
    assert {r.context_id for r in ingest.read_log(spark, root, "invalidated", "context_id string").collect()} == {w[2] for w in want}
    assert [r.storedName for r in work.waiting("000000000000-001").collect()] == ["b1"]

    again = tasks.select(*ingest.REQUIRED, F.when(F.col("storedName") == "z", "2024-01-05").otherwise("2024-01-01").alias("timestamp"), F.lit(0).alias("attempts"))
    due = work.due(again, "000000000001-000")
    assert {r.storedName: r.timestamp for r in due.collect()} == {"z": "2024-01-05", "b1": "2024-01-01"}  # a1 was processed at a later time
    plan = due._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan[plan.index("Exchange hashpartitioning") :]


def test_task_files_are_bounded(spark, monkeypatch):
    from kgcube.plans import io_queries

    monkeypatch.setattr(io_queries, "TASKS_IN_FILE", 300)
    root = io_queries.stream(spark, "/root/testdata/sf0.001/")  # another path than that of other tests, so that it runs
    lines = spark.read.text(f"{root}/tasks").groupBy(F.input_file_name()).count().collect()
    assert len(lines) > 4 and max(r["count"] for r in lines) <= 300
    assert sorted(n for n in tables.names(spark, f"{root}/log") if n.endswith("-000")) == ["batch=000000000000-000", "batch=000000000001-000"]
    assert C.read_index(spark, f"{root}/index", "context_files", "sales").count() > 1500


def test_raw_messages_by_name(spark):
    root = tables.new_folder(spark)
    raw = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("stored_name"), F.repeat(F.lit("x"), 50).alias("content"))
    files.write_raw(raw, root, "s")
    few = raw.where("stored_name in ('n5', 'n17', 'nowhere')")
    got = files.read_raw(spark, root, "s", few)
    assert {r.stored_name for r in got.collect()} == {"n5", "n17"} and len(got.inputFiles()) <= 64
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:60]
    assert files.read_raw(spark, root, "s", raw.limit(2000)).count() == 2000 and files.read_raw(spark, root, "s").count() == 5000


def test_a_store_that_forgets(spark):
    root = tables.new_folder(spark)
    cache, at = Materialised(spark, root), lambda h, m=0: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "context_id string")
    rows = spark.createDataFrame([(f"c{i}", k) for i in range(40) for k in range(i % 3)], "context_id string, k int")
    for hour in (9, 10):
        cache.add(rows.select("context_id").distinct(), rows, "RDF", at(hour))
    cache.add(ids("c1"), rows.where("context_id = 'c1'"), "LPG", at(9))
    cache.invalidate(ids("c1", "c2"), at(9, 30))
    for _ in range(2):  # also again, as after a failure
        cache.clear(ids("c1", "c4", "c5", "nothing"))
        held = {(r.representation, r.context_id) for r in spark.read.schema("context_id string, k int, representation string").parquet(f"{root}/rows").collect()}
        assert held == {("RDF", r.context_id) for r in rows.collect()} - {("RDF", c) for c in ("c1", "c4", "c5")}
    assert cache.fresh("LPG", at(9, 10)).count() == 0 and cache.rows("LPG", at(9, 10)).count() == 0
    assert cache.rows("RDF", at(10, 10)).count() == rows.where("context_id not in ('c1', 'c4', 'c5')").count()
    stale = lambda: {r.context_id for r in spark.read.parquet(f"{root}/stale").collect()}
    assert stale() == {"c2"}
    cache.compact(at(10, 40))
    assert stale() == set() and tables.names(spark, f"{root}/rows/representation=RDF") == [f"built={int(at(10).timestamp() * 1_000_000)}"]
    assert cache.rows("RDF", at(10, 40)).where("context_id = 'c2'").count() == 2


def test_only_misses_are_closed(spark):
    cache, asked = Materialised(spark, tables.new_folder(spark)), []
    at = lambda h, m=0: datetime(2024, 1, 1, h, m, tzinfo=timezone.utc)
    f = spark.createDataFrame([(c, f"{c}{i}", R.RDF_TYPE, "A", False, None, None) for c in "abcd" for i in range(2)], "context_id string, s string, p string, o string, is_literal boolean, datatype string, lang string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "context_id string")

    def facts(contexts):
        asked.append("".join(sorted(r.context_id for r in contexts.collect())))
        return f.join(contexts, "context_id", "left_semi")

    box = tbox(spark, ("A", R.SUB_CLASS, "B"))
    assert cache.derived(ids("ab"), facts, box, at(9)).count() == 4
    assert cache.derived(ids("abc"), facts, box, at(9, 10)).count() == 6
    cache.invalidate(ids("a"), at(9, 20))
    assert cache.derived(ids("abce"), facts, box, at(9, 30)).count() == 6
    assert cache.derived(ids("abce"), facts, box, at(9, 40)).count() == 6
    assert cache.derived(ids("ab"), facts, tbox(spark, ("A", R.SUB_CLASS, "B"), ("B", R.SUB_CLASS, "C")), at(9, 50)).count() == 8
    assert asked == ["ab", "c", "ae", "ab"]


def test_percentiles_of_many_values(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = {"a": np.exp(rng.normal(5, 2, 5000)).astype(int).tolist(), "b": list(range(1000)), None: [7]}
    log = spark.createDataFrame([(k, int(v)) for k, vs in data.items() for v in vs], "k string, v long")
    wanted = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in L.percentiles(log, "v", wanted, "k").collect()}
    for k, vs in data.items():
        for name, p in wanted.items():
            assert abs(got[k][name] - np.quantile(vs, p)) < 1e-6, (k, name)
    assert L.percentiles(log, "v", wanted).count() == 1


def test_links_of_other_files_and_repeated_ones(spark):
    """A file has each context once, whatever the analysis gives; files that no task names don't come in."""
    root, seen = tables.new_folder(spark), []

    def analyse(tasks):
        rows = links(spark, "a1", "a1", "b1", "c1", "other").withColumn("status", F.when(F.col("stored_name") == "c1", "bad"))
        return rows.unionByName(rows.where("stored_name = 'c1'").withColumn("status", F.lit(None).cast("string")))

    def index(x):
        seen.append(sorted((r.stored_name, r.schema_id) for r in x.collect()))
        C.write_index(CUBE, x, f"{root}/index", "sales", unique=True)

    work = ingest.Ingestion(spark, root, analyse, index)
    for _ in range(2):  # delivered twice
        work.batch(lines(spark, "a1", "b1", "c1", "d1"), "000000000000-000")
    assert seen == [[("a1", "sales"), ("b1", "sales")]] * 2
    assert C.read_index(spark, f"{root}/index", "context_files", "sales").count() == 2
    log = {r.stored_name: r.contexts_count for r in ingest.read_log(spark, root, "log", ingest.LOG).collect()}
    assert log == {"a1": 1, "b1": 1, "d1": 0}
    assert [(r.storedName, r.status) for r in work.waiting("000000000000-001").collect()] == [("c1", "bad")]


def test_raw_messages_are_found_without_moving_text(spark):
    root = tables.new_folder(spark)
    raw = tables.stored(spark.range(5000).select(F.concat(F.lit("f/"), "id").alias("stored_name"), F.repeat(F.lit("text"), 3).alias("content")))
    files.write_raw(raw, root, "s")
    names = tables.stored(raw.select("stored_name").limit(2000))
    found = files.read_raw(spark, root, "s", names, exact=False)
    assert found.join(names, "stored_name", "left_semi").count() == 2000 and found.count() < 3000
    assert "hashpartitioning(stored_name" not in found._jdf.queryExecution().toString()


def test_graph_forms_and_noise_read_facts_once(spark):
    """No shuffle where a row tells whether it is noise, and one scan of a table of triples for its vertices."""
    f = facts(spark, ("a", "p", "a"), ("a", R.RDF_TYPE, "urn/T"), ("a", "p", "b")).unionByName(facts(spark, ("a", "p", "a")).withColumn("is_literal", F.lit(True)))
    kept = R.drop_noise(f)
    assert sorted((r.o, r.is_literal) for r in kept.collect()) == [("a", True), ("b", False), ("urn/T", False)]
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    v = G.vertices(stored(f))
    assert {(r.id, r.label, str(r.props)) for r in v.collect()} == {("a", "T", "{'p': ['a']}"), ("b", "Resource", "None")}
    assert v._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_messages_are_announced_by_files_of_bounded_length(spark, monkeypatch):
    from kgcube.plans import message_queries

    monkeypatch.setattr(message_queries, "TASKS_IN_FILE", 200, raising=False)
    root = message_queries.ingested(spark, "/root/testdata/sf0.001/./")  # another path than that of other tests, so that it runs
    lines = spark.read.text(f"{root}/tasks").groupBy(F.input_file_name()).count().collect()
    assert len(lines) > 4 and max(r["count"] for r in lines) <= 200
    assert sorted(n for n in tables.names(spark, f"{root}/log") if n.endswith("-000")) == ["batch=000000000000-000", "batch=000000000001-000"]


def test_links_of_another_engine_do_not_count(spark):
    root, seen = tables.new_folder(spark), []
    found = links(spark, "a1", "b1", "c1").withColumns({"engine_id": F.when(F.col("stored_name") == "a1", "E").otherwise("other"), "status": F.when(F.col("stored_name") == "c1", "bad")})
    work = ingest.Ingestion(spark, root, lambda tasks: found, lambda x: seen.append([r.stored_name for r in x.collect()]), own_engine=True)
    work.batch(lines(spark, "a1", "b1", "c1"), "000000000000-000")
    assert seen == [["a1"]] and work.waiting("000000000000-001").isEmpty()
    assert {r.stored_name: r.contexts_count for r in ingest.read_log(spark, root, "log", ingest.LOG).collect()} == {"a1": 1, "b1": 0, "c1": 0}
