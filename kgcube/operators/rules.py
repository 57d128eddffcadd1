"""Derived knowledge: rule closure over the triples of each context against a TBox.

Facts are (context_id, s, p, o, is_literal, datatype, lang), or a graph of numbered terms; the rules see numbers only. The
TBox is (s, p, o), schema axioms only, closed under class and property chains once, so that a round of the closure
takes a fact all the way up. Closure is semi-naive: each round joins what the last one found with the axioms, which are
broadcast if they are few, and the rules over two facts join it with those facts that they can use, if it holds any that they name.
Only facts that the rules can read or derive take part, if ``Axioms.relevant`` leaves the others out before they become numbers.
What is derived is compared only with facts that some axiom can derive, and after the first round only with those of the
same predicates and classes. Rules without axioms don't run. A rule doesn't see again what a closed table of axioms made of facts that it has seen. Each round is written to the
shared folder, so the plan doesn't grow and lost executors cost one round at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgcube.operators.terms import Dictionary, Graph, is_resource, resources, statements
from kgcube.operators.triples import RDF_TYPE, TRIPLE
from kgcube.sources.tables import MOST_BROADCAST_ROWS, held, local, small, stored

# RDF, RDFS and OWL terms.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SUB_CLASS, SUB_PROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
DOMAIN, RANGE, RESOURCE = RDFS + "domain", RDFS + "range", RDFS + "Resource"
CHAIN, FIRST, REST = OWL + "propertyChainAxiom", RDF + "first", RDF + "rest"
INTERSECTION, SOME, VALUE, ON = OWL + "intersectionOf", OWL + "someValuesFrom", OWL + "hasValue", OWL + "onProperty"
META = [RDFS + "Class", RDFS + "Datatype", RDF + "Property", OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "Restriction", RDF + "List"]

FACT = ["context_id", *TRIPLE]
CODED = ["context_id", "s", "p", "o"]


def tbox_from_dimension(table: DataFrame, levels: list[str], base: str) -> DataFrame:
    """Adjacent levels of each row as subClassOf, from the finer member to the coarser."""
    pairs = F.array(*(F.struct(F.col(f).alias("c"), F.col(c).alias("p")) for c, f in zip(levels, levels[1:], strict=False)))
    x = table.select(F.explode(pairs).alias("x")).where("x.c is not null and x.p is not null and x.c <> x.p")
    return x.select(F.concat(F.lit(base), "x.c").alias("s"), F.lit(SUB_CLASS).alias("p"), F.concat(F.lit(base), "x.p").alias("o")).distinct()


def merged_tbox(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("s", "p", "o")
    for p in parts[1:]:
        out = out.unionByName(p.select("s", "p", "o"))
    return out.distinct()


def tbox_version(tbox: DataFrame) -> DataFrame:
    """16 hex digits of the sorted axioms; a TBox is schema, of bounded size."""
    line = F.concat_ws(" ", "s", "p", "o")
    return tbox.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256), 1, 16).alias("version"))


def reachable(tbox: DataFrame, predicate: str) -> DataFrame:
    """(sub, sup) of all chains of one predicate, without sub = sup: on the driver for few axioms, else by doubling."""
    pairs = tbox.where((F.col("p") == predicate) & (F.col("s") != F.col("o"))).select(F.col("s").alias("sub"), F.col("o").alias("sup")).distinct()
    few = pairs.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return local(tbox.sparkSession, _chains(few), "sub string, sup string")
    pairs = stored(pairs)
    size = pairs.count()
    while True:
        longer = pairs.select("sub", F.col("sup").alias("mid")).join(pairs.select(F.col("sub").alias("mid"), "sup"), "mid").select("sub", "sup").where("sub <> sup")
        pairs = stored(pairs.unionByName(longer).distinct())
        now = pairs.count()
        if now == size:
            return pairs
        size = now


#: Axioms of one predicate whose chains the driver follows.
FEW = 1000


def _chains(pairs: list) -> list[tuple[str, str]]:
    above: dict[str, set] = {}
    for sub, sup in pairs:
        above.setdefault(sub, set()).add(sup)
    out = []
    for start in above:
        seen, todo = {start}, [start]
        while todo:
            new = above.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out += [(start, x) for x in seen if x != start]
    return out


#: Joins one table of facts with another.
Rule2 = Callable[[DataFrame, DataFrame], DataFrame]


def _fact(s: str, p: str | Column, o: str) -> list[Column | str]:
    return ["context_id", F.col(s).alias("s"), (F.col(p) if isinstance(p, str) else p).alias("p"), F.col(o).alias("o")]


class Axioms:
    """What rules read of a TBox, as text. ``table`` (kind, x0, x1, x2) is stored, and ``few`` are its rows if a broadcast may
    hold them. With ``wanted`` only axioms count that lead to types of these classes, and ``derive`` returns no others."""

    #: Columns of the tables of axioms.
    TABLES = {"classes": ("sub", "sup"), "properties": ("sub", "sup"), "domain": ("p", "cls"), "range": ("p", "cls"), "chains": ("q", "first", "second"), "intersections": ("first", "second", "sup"), "some": ("prop", "filler", "sup"), "value": ("cls", "prop", "val")}

    def __init__(self, tbox: DataFrame, rules: list[Rule], wanted: tuple[str, ...] = ()):
        self.rules, self.wanted = rules, wanted
        self.box = t = stored(tbox.select("s", "p", "o").distinct())
        found = {"classes": reachable(t, SUB_CLASS), "properties": reachable(t, SUB_PROPERTY)}
        by = lambda p, s, o: t.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
        for name, predicate in (("domain", DOMAIN), ("range", RANGE)):
            pairs = by(predicate, "p", "cls")
            if sub_class in rules and sub_property in rules:  # they hold for sub-properties and super-classes too
                pairs = pairs.unionByName(pairs.join(found["properties"], F.col("p") == F.col("sup")).select(F.col("sub").alias("p"), "cls"))
                pairs = pairs.unionByName(pairs.join(found["classes"], F.col("cls") == F.col("sub")).select("p", F.col("sup").alias("cls"))).distinct()
            found[name] = pairs
        heads = by(FIRST, "l1", "first").join(by(REST, "l1", "l2"), "l1").join(by(FIRST, "l2", "second"), "l2")
        found["chains"] = by(CHAIN, "q", "l1").join(heads, "l1").select("q", "first", "second")
        sub = by(SUB_CLASS, "node", "sup").select("sup", "node")
        found["intersections"] = by(INTERSECTION, "node", "l1").join(heads, "l1").where("first <> second").join(sub, "node").select("first", "second", "sup")
        on = by(ON, "node", "prop")
        found["some"] = by(SOME, "node", "filler").join(on, "node").where(F.col("prop") != RDF_TYPE).join(sub, "node").select("prop", "filler", "sup")
        found["value"] = by(VALUE, "node", "val").join(on, "node").join(by(SUB_CLASS, "cls", "node"), "node").select("cls", "prop", "val")
        none = F.lit(None).cast("string")
        own = any(r not in AXIOMS for r in rules)  # a rule of one's own may read any
        rows = [found[k].select(F.lit(k).alias("kind"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(v)), *(none.alias(f"x{i}") for i in range(len(v), 3))) for k, v in self.TABLES.items() if own or k in {AXIOMS[r] for r in rules}]
        self.table = stored(reduce(lambda a, b: a.unionByName(b), rows).distinct())
        rows = self.table.limit(MOST_BROADCAST_ROWS + 1).collect()
        self.few = rows if len(rows) <= MOST_BROADCAST_ROWS else None
        if wanted and self.few is not None and not own:
            self.few = self._leading()
            self.table = local(t.sparkSession, [tuple(r) for r in self.few], "kind string, x0 string, x1 string, x2 string")

    def _leading(self) -> list:
        """The few axioms that can take part in deriving a wanted type, from its class backwards."""
        names = {"p": set(), "o": set(self.wanted)}  # wanted predicates and classes; all classes if the type is such a predicate
        kept = {}
        while True:
            wants = lambda x, side: x in names[side] or RDF_TYPE in names["p"] if side == "o" else x in names["p"] or x == RDF_TYPE  # noqa: B023, E731
            new = {tuple(r): r for r in self.few if tuple(r) not in kept and any(wants(x, side) for side, x in self._named(r, DERIVABLE))}
            if not new:
                return list(kept.values())
            kept |= new
            for r in new.values():
                for side, x in self._named(r, READ):
                    names[side].add(x)

    @classmethod
    def _named(cls, row, columns: tuple) -> list[tuple[str, str]]:
        """(p or o, name): the predicates and classes in the columns of a row."""
        return [(side, row[f"x{cls.TABLES[kind].index(c)}"]) for side, names in zip("po", columns, strict=True) for kind, c in names if kind == row["kind"]]

    def relevant(self, triples: DataFrame) -> DataFrame:
        """Triples that the rules can read or derive; all others change nothing. Where a rule of one's own is among them, all."""
        if any(r not in AXIOMS for r in self.rules):
            return triples
        pairs = lambda side: [F.struct(F.lit(side).alias("side"), self._column(kind, c).alias("name")) for names in (READ, DERIVABLE) for kind, c in names["po".index(side)]]
        keys = held(self.table.select(F.explode(F.array(*pairs("p"), *pairs("o"))).alias("k")).select("k.*").where("name is not null").distinct())
        types = keys.where((F.col("side") == "p") & (F.col("name") == RDF_TYPE)).isEmpty()  # else the type itself is a predicate that is read
        typed = (F.col("p") == RDF_TYPE) & F.lit(types)
        key = F.col("side") == F.when(typed, "o").otherwise("p"), F.col("name") == F.when(typed, F.col("o")).otherwise(F.col("p"))
        return triples.join(keys, key[0] & key[1], "left_semi")

    @classmethod
    def _column(cls, kind: str, column: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(f"x{cls.TABLES[kind].index(column)}"))


class TBox:
    """Axioms by rule, as numbers; each table is broadcast if it is small."""

    TABLES = Axioms.TABLES

    def __init__(self, axioms: Axioms, terms: Dictionary):
        self.type = terms.number(RDF_TYPE)
        self.table = stored(terms.encode(axioms.table, ["x0", "x1", "x2"]))
        self.few = self.table.collect() if axioms.few is not None else None
        self.sizes = dict(Counter(r["kind"] for r in self.few)) if self.few is not None else {r["kind"]: r["n"] for r in self.table.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        for name in self.TABLES:
            setattr(self, name, self._of(name))

    def _of(self, kind: str) -> DataFrame:
        names = self.TABLES[kind]
        if self.few is not None:
            rows = [tuple(r)[1 : 1 + len(names)] for r in self.few if r["kind"] == kind]
            return F.broadcast(local(self.table.sparkSession, rows, ", ".join(f"{c} long" for c in names)))
        rows = self.table.where(F.col("kind") == kind).select(*(F.col(f"x{i}").alias(c) for i, c in enumerate(names)))
        return F.broadcast(rows) if self.sizes.get(kind, 0) <= MOST_BROADCAST_ROWS else rows

    def numbers(self, *names: tuple[str, str]) -> set[int]:
        """The values of columns (kind, column) of few axioms."""
        return {r[f"x{self.TABLES[kind].index(column)}"] for kind, column in names for r in self.few if r["kind"] == kind}

    def keys(self, *names: tuple[str, str]) -> DataFrame:
        """(key): the distinct values of columns (kind, column)."""
        if self.few is not None:
            return F.broadcast(local(self.table.sparkSession, [(x,) for x in sorted(self.numbers(*names))], "key long"))
        parts = [getattr(self, kind).select(F.col(column).alias("key")) for kind, column in names]
        rows = reduce(lambda a, b: a.union(b), parts).distinct()
        return F.broadcast(rows) if sum(self.sizes.get(kind, 0) for kind, _ in names) <= MOST_BROADCAST_ROWS else rows


Rule = Callable[[DataFrame, DataFrame, TBox], DataFrame]


def kept(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column is a key."""
    return rows.join(keys, F.col(column) == F.col("key"), "left_semi")


def types(f: DataFrame, t: TBox) -> DataFrame:
    return f.where(F.col("p") == t.type).select("context_id", "s", F.col("o").alias("cls"))


def sub_class(new: DataFrame, facts: DataFrame, t: TBox) -> DataFrame:
    return types(new, t).join(t.classes, F.col("cls") == F.col("sub")).select(*_fact("s", t.type, "sup"))


def sub_property(new: DataFrame, facts: DataFrame, t: TBox) -> DataFrame:
    return new.join(t.properties, F.col("p") == F.col("sub")).select(*_fact("s", "sup", "o"))


def _both(new: DataFrame, facts: DataFrame, old: DataFrame | None, one: Rule2) -> DataFrame:
    """Pairs of a new fact with any, on either side; in the first round all facts are new. ``old`` are facts without the
    new ones, so that two of these meet once."""
    return one(new, facts) if new is facts else one(new, facts).unionByName(one(facts if old is None else old, new))


def chain(new: DataFrame, facts: DataFrame, t: TBox, old: DataFrame | None = None) -> DataFrame:
    def one(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.where(is_resource(F.col("o"))).join(t.chains, F.col("p") == F.col("first")).select("context_id", F.col("s").alias("a"), F.col("o").alias("mid"), "q", "second")
        b = kept(right, "p", t.keys(("chains", "second"))).select("context_id", F.col("s").alias("mid"), F.col("p").alias("second"), F.col("o").alias("b"))
        return a.join(b, ["context_id", "mid", "second"]).select(*_fact("a", "q", "b"))

    return _both(new, facts, old, one)


def intersection(new: DataFrame, facts: DataFrame, t: TBox, old: DataFrame | None = None) -> DataFrame:
    def one(left: DataFrame, right: DataFrame) -> DataFrame:
        a = types(left, t).join(t.intersections, F.col("cls") == F.col("first")).select("context_id", "s", "second", "sup")
        b = kept(types(right, t), "cls", t.keys(("intersections", "second"))).withColumnRenamed("cls", "second")
        return a.join(b, ["context_id", "s", "second"]).select(*_fact("s", t.type, "sup"))

    return _both(new, facts, old, one)


def some_values(new: DataFrame, facts: DataFrame, t: TBox, old: DataFrame | None = None) -> DataFrame:
    def one(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.where(is_resource(F.col("o"))).join(t.some, F.col("p") == F.col("prop")).select("context_id", F.col("s").alias("x"), F.col("o").alias("s"), F.col("filler").alias("cls"), "sup")
        return a.join(kept(types(right, t), "cls", t.keys(("some", "filler"))), ["context_id", "s", "cls"]).select(*_fact("x", t.type, "sup"))

    return _both(new, facts, old, one)


def has_value(new: DataFrame, facts: DataFrame, t: TBox) -> DataFrame:
    return types(new, t).join(t.value, "cls").select(*_fact("s", "prop", "val"))


def domain(new: DataFrame, facts: DataFrame, t: TBox) -> DataFrame:
    return new.join(t.domain, "p").select(*_fact("s", t.type, "cls"))


def range_(new: DataFrame, facts: DataFrame, t: TBox) -> DataFrame:
    return new.where(is_resource(F.col("o"))).join(t.range, "p").select(*_fact("o", t.type, "cls"))


SIX: list[Rule] = [sub_class, sub_property, chain, intersection, some_values, has_value]
EIGHT: list[Rule] = [*SIX, domain, range_]
RDFS_RULES: list[Rule] = [sub_class, sub_property, domain, range_]

#: Rules that join two facts; the others look at each new one by itself.
PAIRING = {chain, intersection, some_values}

#: What the facts that these join are named by in axioms.
SIDES = {chain: (("chains", "first"), ("chains", "second")), intersection: (("intersections", "first"), ("intersections", "second")), some_values: (("some", "prop"), ("some", "filler"))}

#: Of these rules a rule needn't see what they have made: its axioms are closed, so it has made the same of what they read.
#: The second table holds as well where domains and ranges are closed.
CLOSED = {sub_class: {sub_class}, sub_property: {sub_property}}
CLOSED_TOO = {sub_class: {sub_class, domain, range_}, sub_property: {sub_property}, domain: {sub_property}, range_: {sub_property}}

#: The axioms that a rule needs; a rule of one's own, that isn't here, always runs, and sees facts as text.
AXIOMS = {sub_class: "classes", sub_property: "properties", chain: "chains", intersection: "intersections", some_values: "some", has_value: "value", domain: "domain", range_: "range"}


def without_noise(graph: Graph) -> DataFrame:
    """Numbered facts but for reflexive ones, statements about vocabulary terms or schema, and types that say nothing."""
    d = graph.terms
    schema = (SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, CHAIN, FIRST, REST)
    own = d.terms.where(~F.col("is_literal") & reduce(lambda x, y: x | y, (F.col("value").startswith(v) for v in (RDF, RDFS, OWL)))).select("id", "value")
    rows = own.limit(MOST_BROADCAST_ROWS + 1).collect()
    ids = {r["value"]: r["id"] for r in rows if r["value"] in (RDF_TYPE, RESOURCE, *schema, *META)} if len(rows) <= MOST_BROADCAST_ROWS else dict(own.where(F.col("value").isin(RDF_TYPE, RESOURCE, *schema, *META)).select("value", "id").collect())
    vocabulary = F.broadcast(local(d.spark, [(r["id"],) for r in rows], "s long")) if len(rows) <= MOST_BROADCAST_ROWS else own.select(F.col("id").alias("s"))
    among = lambda c, *names: F.col(c).isin([ids[n] for n in names if n in ids])
    empty = among("o", RESOURCE) | (among("p", RDF_TYPE) & among("o", *META))
    return graph.facts.where(~((F.col("s") == F.col("o")) | among("p", *schema) | empty)).join(vocabulary, "s", "left_anti")


def drop_noise(derived: DataFrame) -> DataFrame:
    """The same for facts as text, which a look at each row tells."""
    s, p, o, thing = F.col("s"), F.col("p"), F.col("o"), ~F.col("is_literal")
    reflexive = thing & F.col("datatype").isNull() & F.col("lang").isNull() & (s == o)
    about = reduce(lambda x, y: x | y, (s.startswith(v) for v in (RDF, RDFS, OWL)))
    schema = p.isin(SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, CHAIN, FIRST, REST)
    empty = thing & ((o == RESOURCE) | ((p == RDF_TYPE) & o.isin(META)))
    return derived.select(*FACT).where(~(reflexive | about | schema | empty))


def new_facts(found: DataFrame, *known: DataFrame) -> DataFrame:
    """Numbered facts of found, each once, that aren't known; with the bits of all rules that made it in ``by``, if it has these."""
    rows = Graph.together(found)
    rows = rows.groupBy(*CODED).agg(F.bit_or("by").alias("by")) if "by" in found.columns else rows.select(*CODED).distinct()
    return reduce(lambda out, k: out.join(k.select(*CODED), CODED, "left_anti"), known, rows)


def _with_axioms(facts: DataFrame | Graph, axioms: Axioms) -> Graph:
    """The facts as numbers that the axioms' terms have too."""
    graph = facts if isinstance(facts, Graph) else Graph.of(axioms.relevant(facts.select(*FACT)))
    more = resources(axioms.box.select("s", "p", "o", F.lit(RDF_TYPE).alias("type")), "s", "p", "o", "type")
    return Graph(graph.facts.select(*CODED), Dictionary.of(more, base=graph.terms))


#: What axioms read: the predicates of statements, and classes.
READ = (("properties", "sub"), ("chains", "first"), ("chains", "second"), ("some", "prop"), ("domain", "p"), ("range", "p")), (("classes", "sub"), ("intersections", "first"), ("intersections", "second"), ("some", "filler"), ("value", "cls"))

#: What axioms can derive: the predicates of statements, and classes.
DERIVABLE = (("properties", "sup"), ("chains", "q"), ("value", "prop")), (("classes", "sup"), ("domain", "cls"), ("range", "cls"), ("intersections", "sup"), ("some", "sup"))


def _among(facts: DataFrame, t: TBox, predicates: DataFrame, classes: DataFrame) -> DataFrame:
    """Statements with one of the predicates, and types with one of the classes."""
    typed = F.col("p") == t.type
    return kept(facts.where(~typed), "p", predicates).unionByName(kept(facts.where(typed), "o", classes))


def _alike(facts: DataFrame, made: DataFrame, t: TBox) -> DataFrame:
    """Facts with the predicate, and if it is the type also the class, of one that was made."""
    kind = F.struct("p", F.when(F.col("p") == t.type, F.col("o")).otherwise(F.lit(0)).alias("cls"))
    kinds = held(made.select(kind.alias("kind")).distinct().select("kind.p", "kind.cls"))
    return facts.join(kinds.select(F.col("p").alias("_p"), F.col("cls").alias("_cls")), (F.col("p") == F.col("_p")) & (kind["cls"] == F.col("_cls")), "left_semi")


def once(rule: Rule, facts: DataFrame | Graph, tbox: DataFrame | Axioms) -> DataFrame:
    """What one rule derives at once, as text."""
    axioms = tbox if isinstance(tbox, Axioms) else Axioms(tbox, [rule])
    graph = _with_axioms(facts, axioms)
    t = TBox(axioms, graph.terms)
    rivals = _among(graph.facts, t, *(t.keys(*names) for names in DERIVABLE)) if rule in AXIOMS else graph.facts
    found = stored(new_facts(rule(graph.facts, graph.facts, t).select(*CODED), rivals).sortWithinPartitions("context_id", "s"))
    return graph.terms.decode(found, CODED[:3], True).select(*FACT)


def derive(facts: DataFrame | Graph, tbox: DataFrame | Axioms, rules: list[Rule] = EIGHT) -> Graph:
    """Derived facts only, as numbers: the fixpoint without the facts, the TBox and noise. Axioms bring their own rules."""
    axioms = tbox if isinstance(tbox, Axioms) else Axioms(tbox, rules)
    graph = _with_axioms(facts, axioms)
    terms, facts = graph.terms, graph.facts
    t = TBox(axioms, terms)
    rules = [r for r in axioms.rules if t.sizes.get(AXIOMS.get(r, ""), 1 if r not in AXIOMS else 0)]
    own = [r for r in rules if r not in AXIOMS]  # of a rule of one's own anything may come
    alone, pairing = [r for r in rules if r in AXIOMS and r not in PAIRING], [r for r in rules if r in PAIRING]
    pairs = t.keys(("chains", "first"), ("chains", "second"), ("some", "prop")), t.keys(("intersections", "first"), ("intersections", "second"), ("some", "filler"))
    usable = lambda df: _among(df, t, *pairs) if pairing else df.where(F.lit(False))
    bit = {r: 1 << k for k, r in enumerate(alone)}
    past = CLOSED_TOO if sub_class in rules and sub_property in rules else CLOSED

    def unseen(rule: Rule, new: DataFrame) -> DataFrame:
        seen = sum(bit.get(r, 0) for r in past.get(rule, ()))
        return new.where(F.col("by").bitwiseAND(F.lit(seen)) == 0) if seen and "by" in new.columns else new

    def meeting(fit: DataFrame) -> list[Rule]:
        """The rules over two facts that name one of these."""
        if not pairing or t.few is None:
            return pairing
        there = {r["key"] for r in fit.select(F.when(F.col("p") == t.type, F.col("o")).otherwise(F.col("p")).alias("key")).distinct().collect()}  # named by the few axioms
        return [r for r in pairing if there & t.numbers(*SIDES[r])]

    new, fit, found = facts, usable(facts), None
    fits, old, rivals = fit, None, facts if own else _among(facts, t, *(t.keys(*names) for names in DERIVABLE))
    while rules:
        parts = [rule(unseen(rule, new), new, t).select(*CODED, F.lit(bit[rule]).alias("by")) for rule in alone]
        parts += [rule(fit, fits, t, old).select(*CODED, F.lit(0).alias("by")) for rule in meeting(fit)]
        for rule in own:
            text = lambda df: terms.decode(df, CODED[:3], True).select(*FACT)  # noqa: B023, E731
            made = stored(rule(text(new), text(facts if found is None else facts.unionByName(found)), t).select(*FACT))
            terms = Dictionary.of(statements(made), base=terms)
            parts.append(terms.encode(made, CODED[:3], True).select(*CODED, F.lit(0).alias("by")))
        if not parts:
            break
        made = reduce(lambda a, b: a.unionByName(b), parts)
        if found is None:
            new = stored(new_facts(made, rivals).sortWithinPartitions("context_id", "s"))
        else:
            made = stored(new_facts(made).sortWithinPartitions("context_id", "s"))
            new = made if made.isEmpty() else stored(new_facts(made, _alike(rivals.unionByName(found), made, t)))
        if new.isEmpty():
            break
        found = new.select(*CODED) if found is None else found.unionByName(new.select(*CODED))
        fit, old = usable(new.select(*CODED)), fits
        fits = fits.unionByName(fit)
    if found is None:
        return Graph(facts.where(F.lit(False)), terms)
    if axioms.wanted:
        classes = terms.encode(local(terms.spark, [(x,) for x in axioms.wanted], "key string"), ["key"])
        found = kept(found.where(F.col("p") == t.type), "o", F.broadcast(classes))
    stated = terms.encode(axioms.box, ["s", "p", "o"])
    return Graph(without_noise(Graph(found, terms)).join(small(stated), ["s", "p", "o"], "left_anti").select(*CODED), terms)


def closure(facts: DataFrame | Graph, tbox: DataFrame | Axioms, rules: list[Rule] = EIGHT) -> DataFrame:
    """What is derived, as text. ``facts`` should be a stored table."""
    return derive(facts, tbox, rules).rows().select(*FACT)
