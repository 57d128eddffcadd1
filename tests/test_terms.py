"""Numbered terms: exact also where hashes clash, and closures that don't depend on them."""

import pytest
from pyspark.sql import functions as F

from kgcube.operators import rules as R
from kgcube.operators.terms import Dictionary, Graph, is_resource, resources, statements

FACT = "context_id string, s string, p string, o string, is_literal boolean, datatype string, lang string"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(f"c{i % 3}", f"s{i % 7}", f"p{i % 2}", f"o{i % 5}", False, None, None) for i in range(40)]
    rows += [("c0", "s0", "p0", "o1", True, None, None), ("c0", "s0", "p0", "o1", True, "int", None), ("c0", "s0", "p0", "o1", True, None, "int"), ("c0", "s0", "p0", "", True, None, None)]
    return spark.createDataFrame(rows, FACT).distinct()


@pytest.mark.parametrize("mask", [-2, 0b11110, 0b111111110])
def test_every_term_has_its_own_number(spark, facts, mask):
    d = Dictionary.of(statements(facts), resources(facts, "context_id"), mask=mask)
    n = facts.select("s").union(facts.select("p")).union(facts.select("context_id")).union(facts.where("not is_literal").select("o")).distinct().count() + 4
    assert d.terms.count() == n == d.terms.select("id").distinct().count()
    assert bool(d.clashes) if mask == 0b11110 else mask != -2 or not d.clashes
    coded = d.encode(facts, ["context_id", "s", "p"], True)
    assert coded.where(~is_resource(F.col("o"))).count() == 4
    back = d.decode(coded, ["context_id", "s", "p"], True).select(*facts.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, facts.collect()))
    more = Dictionary.of(resources(spark.createDataFrame([(f"x{i}",) for i in range(12)] + [("s0",)], "v string"), "v"), base=d)
    assert more.terms.count() == n + 12 == more.terms.select("id").distinct().count()
    assert more.encode(facts, ["s"]).select("s").distinct().count() == 7
    assert sorted(map(str, more.decode(coded, ["context_id", "s", "p"], True).select(*facts.columns).collect())) == sorted(map(str, facts.collect()))
    numbers = spark.range(1).select(*(more.number(x).alias(x) for x in ("s0", "x3", "p1"))).first()
    ids = {r.value: r.id for r in more.terms.where("not is_literal").collect()}
    assert tuple(numbers) == (ids["s0"], ids["x3"], ids["p1"])


def test_large_dictionaries_are_joined_by_shuffle(spark, facts, monkeypatch):
    monkeypatch.setattr("kgcube.operators.terms.MOST_BROADCAST_BYTES", 0)
    graph = Graph.of(facts)
    assert not graph.terms.broadcast
    assert sorted(map(str, graph.rows().select(*facts.columns).collect())) == sorted(map(str, facts.collect()))


def test_contexts_and_axioms_are_broadcast_when_the_dictionary_is_not(spark, facts, monkeypatch):
    monkeypatch.setattr("kgcube.operators.terms.MOST_BROADCAST_BYTES", 400)
    graph = Graph.of(facts)
    assert not graph.terms.broadcast and set(graph.terms.named) == {"context_id"}
    box = spark.createDataFrame([("p0", R.SUB_PROPERTY, "q"), ("q", R.DOMAIN, "A"), ("A", R.SUB_CLASS, "B")], "s string, p string, o string")
    found = R.derive(graph, box)
    assert {r.value for r in found.terms.often.collect()} >= {"A", "B", R.RDF_TYPE}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = found.rows().select(*facts.columns)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        have = sorted(map(str, rows.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # of the six joins with terms or their keys only two are shuffled: that of rare objects, and that of subjects
    assert plan.count("Join LeftOuter") - plan.count("rightHint=(strategy=broadcast)") <= 2
    old = facts.where("p = 'p0'").select("context_id", "s", "o", "is_literal", "datatype", "lang").collect()
    want = {(r.context_id, r.s, "q", r.o, r.is_literal, r.datatype, r.lang) for r in old} | {(r.context_id, r.s, R.RDF_TYPE, c, False, None, None) for r in old for c in "AB"}
    assert have == sorted(str(x) for x in spark.createDataFrame(sorted(want, key=str), FACT).collect())


def test_later_rounds_read_only_facts_like_those_made(spark):
    f = spark.createDataFrame([("c", 1, 5, 7), ("c", 1, 9, 2), ("c", 1, 9, 3)], "context_id string, s long, p long, o long")
    made = spark.createDataFrame([("d", 8, 5, 0), ("d", 8, 9, 3)], "context_id string, s long, p long, o long")
    t = type("Box", (), {"type": F.lit(9).cast("long")})
    assert sorted((r.p, r.o) for r in R._alike(f, made, t).collect()) == [(5, 7), (9, 3)]
    assert R._alike(f, made.limit(0), t).count() == 0


def test_closure_of_clashing_numbers(spark, monkeypatch):
    f = spark.createDataFrame([("c", f"x{i}", R.RDF_TYPE, "A", False, None, None) for i in range(9)] + [("d", "x1", "p", "lit", True, None, None)], FACT)
    box = spark.createDataFrame([("A", R.SUB_CLASS, "B"), ("B", R.SUB_CLASS, "C"), ("p", R.SUB_PROPERTY, "q"), ("q", R.DOMAIN, "A")], "s string, p string, o string")
    want = sorted(map(str, R.closure(f, box).collect()))
    assert len(want) == 9 * 2 + 4
    monkeypatch.setattr("kgcube.operators.terms.MASK", 0b11110)
    monkeypatch.setattr(Dictionary.of.__func__, "__kwdefaults__", {"base": None, "mask": 0b11110})
    assert sorted(map(str, R.closure(f, box).collect())) == want


def test_facts_of_a_subject_stay_together(spark):
    """Each fact once, and all of a subject and context in one file, side by side."""
    n = 40
    links = spark.range(n).select(F.concat(F.lit("f"), "id").alias("stored_name"), F.concat(F.lit("c"), F.col("id") % 5).alias("context_id"))
    row = lambda o: F.struct(F.concat(F.lit("urn:s"), F.floor(F.col("id") / 10)).alias("s"), F.lit("urn:p").alias("p"), o.alias("o"))
    triples = spark.range(n).select(F.concat(F.lit("f"), "id").alias("stored_name"), F.explode(F.array(*(row(F.lit(f"urn:o{k}")) for k in range(4)))).alias("t")).select("stored_name", "t.*")
    none = F.lit(None).cast("string")
    graph = Graph.of_files(links, triples.select("*", F.lit(False).alias("is_literal"), none.alias("datatype"), none.alias("lang")))
    files = graph.facts.select("context_id", "s", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("row"))
    found = files.groupBy("context_id", "s").agg(F.count_distinct("file").alias("files"), (F.max("row") - F.min("row") + 1).alias("span"), F.count("*").alias("n")).collect()
    assert len(found) == 20 and all((r.files, r.span, r.n) == (1, 4, 4) for r in found)


def test_facts_that_no_axiom_reads_are_left_out(spark):
    """The closure is the same without them; of wanted classes only what leads to these is read and returned."""
    none = (False, None, None)
    f = [("c", "x", R.RDF_TYPE, "A", *none), ("c", "x", "p", "y", *none), ("c", "x", "other", "y", *none), ("c", "x", R.RDF_TYPE, "Other", *none), ("c", "y", R.RDF_TYPE, "E", *none), ("c", "x", "q", "y", *none)]
    f = spark.createDataFrame(f, FACT)
    rows = [("A", R.SUB_CLASS, "B"), ("p", R.SUB_PROPERTY, "q"), ("p", R.DOMAIN, "D"), ("q", R.RANGE, "R"), ("E", R.SUB_CLASS, "G"), ("n", R.SUB_CLASS, "Both"), ("n", R.INTERSECTION, "l"), ("l", R.FIRST, "B"), ("l", R.REST, "m"), ("m", R.FIRST, "D"), ("m", R.REST, R.RDF + "nil")]
    box = spark.createDataFrame(rows, "s string, p string, o string")
    read = lambda a: {(r.p, r.o) for r in a.relevant(f).collect()}
    every = R.Axioms(box, R.EIGHT)
    assert read(every) == {(R.RDF_TYPE, "A"), ("p", "y"), ("q", "y"), (R.RDF_TYPE, "E")}
    want = {("x", "B"), ("x", "D"), ("y", "R"), ("y", "G"), ("x", "Both")}
    assert {(r.s, r.o) for r in R.closure(every.relevant(f), every).collect()} == want
    both = R.Axioms(box, R.EIGHT, ("Both",))
    assert read(both) == {(R.RDF_TYPE, "A"), ("p", "y")}
    assert [(r.s, r.o) for r in R.closure(both.relevant(f), both).collect()] == [("x", "Both")]
    assert read(R.Axioms(box, [R.range_])) == {("q", "y")}
    typed = R.Axioms(box.union(spark.createDataFrame([(R.RDF_TYPE, R.SUB_PROPERTY, "kind")], "s string, p string, o string")), R.EIGHT)
    assert read(typed) == read(every) | {(R.RDF_TYPE, "Other")}
    assert R.Axioms(box, [*R.EIGHT, lambda new, facts, t: new]).relevant(f).count() == 6
