"""Cube semantics on small cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from kgcube.functions import paths
from kgcube.operators import contexts as C
from kgcube.operators import messages as M
from kgcube.operators import rules as R
from kgcube.plans import sales as S
from kgcube.plans.answer import build
from kgcube.plans.cube import Catalog, Cube
from kgcube.sources import rdf, tables
from kgcube.sources.xml import MEMBER, map_triples, units

CUBE = S.cube()


def contexts(spark, *cells):
    df = spark.createDataFrame([tuple(list(x) for x in c) for c in cells], "place array<string>, segment array<string>, time array<string>")
    return df.withColumn("context_id", CUBE.context_id())


CELLS = [
    (("ASIA", "N1"), ("A",), ("2018", "2018-02", "2018-02-01")),
    (("ASIA", "N1"), ("A",), ("2018", "2018-02", "2018-02-02")),
    (("ASIA",), ("A",), ("2018",)),
    (("ASIA",), (), ()),
    (("EUROPE",), (), ()),
    (("ASIA", "N2"), (), ("2019",)),
]


def names(spark, df, column):
    ids = {r.context_id: i for i, r in enumerate(contexts(spark, *CELLS).collect())}
    return sorted(ids[r[column]] for r in df.collect())


def test_dice_and_covering_are_disjoint(spark):
    ctx = contexts(spark, *CELLS)
    scope = {"place": ["ASIA", "N1"], "time": ["2018", "2018-02"]}
    assert names(spark, C.dice(CUBE, ctx, scope), "context_id") == [0, 1]
    assert names(spark, C.covering(ctx, scope), "context_id") == [2, 3]
    assert C.covering(ctx, {}).count() == 0


def test_knowledge_flows_down_only(spark):
    ctx = contexts(spark, *CELLS)
    known = C.knowledge(CUBE, ctx, {"place": ["ASIA"]}, {})
    got = {(r.context_id, r.final_id) for r in known.collect()}
    ids = [r.context_id for r in ctx.collect()]
    below = lambda f, c: all(tuple(f[d][: len(c[d])]) == tuple(c[d]) for d in range(3))
    want = {(ids[k], ids[c]) for k, c in itertools.product(range(6), range(6)) if CELLS[c][0][:1] == ("ASIA",) and below(CELLS[c], CELLS[k])}
    assert got == want


def test_roll_up_never_refines_and_is_idempotent(spark):
    ctx = contexts(spark, *CELLS)
    once = C.roll_up(CUBE, ctx, CUBE.levels({"place": "nation", "time": "month"}))
    again = C.roll_up(CUBE, once.select(*(F.col(f"f_{d}").alias(d) for d in CUBE.names), "final_id").withColumn("context_id", F.col("final_id")).drop("final_id"), CUBE.levels({"place": "nation", "time": "month"}))
    assert sorted(r.final_id for r in once.collect()) == sorted(r.final_id for r in again.collect())
    assert CUBE.levels({"time": "ALL"}) == {"time": 0} and CUBE.at_leaves()["time"] == 2 and CUBE.at_roots()["time"] == 0


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(paths.month_of(F.lit("2018-02-03"))) == "2018-02" and get(paths.month_of(F.lit("2018-13-03"))) is None and get(paths.month_of(F.lit("x"))) is None
    assert get(paths.year_of(F.lit("2018-02"))) == "2018" and get(paths.year_of(F.lit("2018"))) is None
    assert get(F.size(paths.days(F.lit("2020-01-03").cast("date"), F.lit("2020-01-01").cast("date")))) == 0
    assert get(F.size(paths.days(F.lit(None).cast("date"), F.lit("2020-01-01").cast("date")))) == 1
    assert str(get(paths.iso_date(F.lit("2025-01-15T23:59:59+02:00")))) == "2025-01-15" and get(paths.iso_date(F.lit("soon"))) is None
    assert get(paths.last_segment(F.lit("http://x/a#B"))) == "B" and get(paths.last_segment(F.lit("http://x/a/"))) == "a" and get(paths.display_name(F.lit("urn:x:y"))) == "y"
    assert get(paths.icao(F.lit("urn.aero.LOWW.x"))) == "LOWW" and get(paths.icao(F.lit("urn"))) is None
    assert get(paths.escape(F.lit('a"b\\\n'))) == 'a\\"b\\\\\\n'
    assert get(paths.parent(paths.all_path())) is None and get(paths.parent(paths.lit_path(["a"]))) == []
    assert get(paths.context_id([])) == "cc1d2f83844" + get(paths.context_id([]))[11:]


@pytest.mark.parametrize("change", [{"id": "Bad Id"}, {"dimensions": {}}, {"dimensions": {"t": {"levels": [{"name": "a", "depth": 1}]}}}, {"dimensions": {"t": {"levels": [{"name": "a", "depth": 0}, {"name": "b", "depth": 1, "rollup_to": "c", "rollup_function": "lookup"}]}}}, {"dimensions": {"t": {"levels": [{"name": "a", "depth": 0}, {"name": "b", "depth": 1, "rollup_to": "a", "rollup_function": "nope"}]}}}])
def test_bad_cubes_are_rejected(change):
    with pytest.raises(ValueError):
        Cube.load({**S.SALES, **change})


def test_scope_and_catalog(spark):
    place = spark.createDataFrame([("ASIA", "N1", 1), ("ASIA", "N1", 2)], "region string, nation string, position int")
    assert CUBE.scope(spark, {"place": {"nation": "N1"}, "time": {"day": "2018-02-01"}}, {"place": place}) == {"place": ["ASIA", "N1"], "time": ["2018", "2018-02", "2018-02-01"]}
    for bad in ({"place": {"nation": "N9"}}, {"nowhere": {"x": "y"}}, {"time": {"week": "1"}}, {"time": {"year": "1", "month": "2"}}):
        with pytest.raises(ValueError):
            CUBE.scope(spark, bad, {"place": place})
    catalog = Catalog(spark, tables.new_folder(spark))
    catalog.register(S.SALES)
    catalog.register(S.SALES)
    assert catalog.list().count() == 1 and catalog.get("sales").names == CUBE.names
    assert {r.dimension: r.levels for r in catalog.describe("sales").collect()}["time"] == "year>month>day"
    with pytest.raises(ValueError):
        catalog.register({**S.SALES, "dimensions": {"segment": S.SALES["dimensions"]["segment"]}})


def test_closure_terminates_on_cycles(spark):
    facts = spark.createDataFrame([("c", "x", R.RDF_TYPE, "A", False, None, None)], "context_id string, s string, p string, o string, is_literal boolean, datatype string, lang string")
    tbox = spark.createDataFrame([("A", R.SUB_CLASS, "B"), ("B", R.SUB_CLASS, "C"), ("C", R.SUB_CLASS, "A")], "s string, p string, o string")
    assert sorted(r.o for r in R.closure(facts, tbox).collect()) == ["B", "C"]
    none = spark.createDataFrame([], "s string, p string, o string")
    assert R.closure(facts, none).count() == 0


def test_nquads_keep_terms(spark):
    q = spark.createDataFrame([("s", "p", 'a "b"\n\\', True, None, "en", "g"), ("s", "p", "1", True, "int", None, "g"), ("s", "p", "o", False, None, None, "g")], "s string, p string, o string, is_literal boolean, datatype string, lang string, graph string")
    path = tables.new_folder(spark)
    rdf.write_nquads(q, path)
    back, bad = rdf.read_nquads(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, q.collect())) and bad.count() == 0
    lines = spark.createDataFrame([("nonsense",)], "value string")
    lines.write.text(path + "x")
    assert rdf.read_nquads(spark, path + "x")[1].count() == 1


def test_graph_forms_and_errors(spark):
    d = "/root/testdata/sf0.001"
    args = (CUBE, S.contexts(spark, d), S.links(spark, d), S.triples(spark, d), S.scope_paths(), S.ROLL_UP)
    a = build(*args, representation="LPG")
    assert a.vertices.where("label = 'Context'").count() == a.finals.count() and a.edges.count() > 0
    with pytest.raises(ValueError):
        build(*args, representation="TABLE")


AIXM = """<message:AIXMBasicMessage xmlns:message="m" xmlns:gml="g" xmlns:aixm="a" xmlns:event="e"><message:hasMember><aixm:Stand gml:id="S1"><aixm:availability>
<aixm:Use gml:id="U1"><aixm:operationalStatus>NORMAL</aixm:operationalStatus><gml:validTime><gml:TimePeriod><gml:beginPosition>2025-01-16T00:00:00Z</gml:beginPosition>
<gml:endPosition>2025-01-17T23:59:59Z</gml:endPosition></gml:TimePeriod></gml:validTime><event:location>LOWS</event:location></aixm:Use></aixm:availability></aixm:Stand></message:hasMember>
<message:hasMember><event:Event gml:id="E1"><event:location>LOVV</event:location></event:Event></message:hasMember></message:AIXMBasicMessage>"""


def test_aixm_message(spark):
    raw = spark.createDataFrame([("f", AIXM), ("bad", "<a><b>"), ("none", None)], "stored_name string, content string")
    places = spark.createDataFrame([("Austria", "LOVV", "LOWS")], "territory string, fir string, location string")
    topics = spark.createDataFrame([("C", "F", "Stand"), ("C", "F", "Notam")], "category string, family string, feature string")
    got = {(r.stored_name, ">".join(r.location or []), ">".join(r.time), ">".join(r.topic), r.status) for r in M.extract_contexts(raw, "aixm", places, topics).collect()}
    assert got == {
        ("f", "Austria>LOVV>LOWS", "2025>2025-01>2025-01-16", "C>F>Stand", None), ("f", "Austria>LOVV>LOWS", "2025>2025-01>2025-01-17", "C>F>Stand", None),
        ("f", "Austria>LOVV", "", "C>F>Notam", None), ("bad", "", "", "", "malformed"), ("none", "", "", "", "malformed"),
    }
    t = [(r.s, r.p.split("#")[-1], r.o) for r in map_triples(raw, "aixm", "b#").where("stored_name = 'f' and is_literal").collect()]
    assert t == [("b#U1", "operationalStatus", "NORMAL"), ("b#U1", "location", "LOWS")]
    assert units(raw, MEMBER).where("error is not null").count() == 2


def test_postings_are_cut_into_chunks(spark, monkeypatch):
    from kgcube.operators import contexts as C

    monkeypatch.setattr(C, "CHUNK", 64)
    ctx = spark.createDataFrame([(f"c{i}", ["R", f"N{i % 7}"] if i % 3 else ["R"], ["s"], [f"{i % 2}"]) for i in range(500)], "context_id string, place array<string>, segment array<string>, time array<string>").repartition(3)
    numbers = C.ordinals(ctx)
    assert sorted(r.ordinal for r in numbers.collect()) == list(range(500))
    posted = C.postings(CUBE, ctx, numbers)
    sizes = posted.groupBy("dimension", "hierarchy_id").agg(F.count("*").alias("chunks"), F.sum(F.bitmap_count("bits")).alias("n"))
    assert sizes.where("n = 500 and chunks = 8").count() == 5  # ALL of three dimensions, R, and s
    for scope in ({}, {"place": ["R", "N2"]}, {"place": ["R"], "time": ["1"]}, {"place": ["R", "N1"], "segment": ["s"], "time": ["0"]}, {"place": ["nowhere"]}):
        got = sorted(r.context_id for r in C.of_bits(C.select_bits(CUBE, posted, scope), numbers).collect())
        assert got == sorted(r.context_id for r in C.dice(CUBE, ctx, scope).collect()), scope
