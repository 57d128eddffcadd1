"""Terms as numbers: a dictionary, so that joins and distincts of triples move longs instead of strings.

A term is (value, is_literal, datatype, lang). Its number is a hash of these, so encoding is an expression and needs no
join; the lowest bit says whether the term is a literal. One pass over the data gives the table of distinct terms, which
is checked: of terms with the same number all but one get another, and those few are known to every later
encoding. Decoding joins the terms, by broadcast if they are few bytes. Else only what has to be is shuffled: predicates,
contexts and terms that many rows hold, as those of axioms, are still broadcast, and rows carry no text that they don't need yet.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgcube.sources.tables import MOST_BROADCAST_BYTES, MOST_BROADCAST_ROWS, ROW_BYTES, held, local, small, stored

TERM = ["value", "is_literal", "datatype", "lang"]
TERM_SCHEMA = "value string, is_literal boolean, datatype string, lang string"
#: New terms that the driver itself compares with a dictionary's.
FEW = 1000
#: Bits of a hash that a number keeps; the lowest is free for the literals' mark.
MASK = -2


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit("\0"))


def _hash(value: Column, literal: Column, datatype: Column, lang: Column, mask: int) -> Column:
    h = F.xxhash64(value, _text(datatype), _text(lang)).bitwiseAND(F.lit(mask)) + literal.cast("long")
    return F.when(value.isNotNull(), h)


def resources(df: DataFrame, *columns: str) -> DataFrame:
    """The columns' values as terms."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    rows = F.array(*(F.struct(F.col(c).alias("value"), no.alias("is_literal"), none.alias("datatype"), none.alias("lang")) for c in columns))
    return df.select(F.explode(rows).alias("t")).select("t.*")


def statements(triples: DataFrame) -> DataFrame:
    """All terms of triples."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    one = lambda v, *x: F.struct(F.col(v).alias("value"), *(c.alias(n) for c, n in zip(x, TERM[1:], strict=True)))
    rows = F.array(one("s", no, none, none), one("p", no, none, none), one("o", F.col("is_literal"), F.col("datatype"), F.col("lang")))
    return triples.select(F.explode(rows).alias("t")).select("t.*")


def is_resource(number: Column) -> Column:
    return number.bitwiseAND(F.lit(1)) == 0


class Dictionary:
    """``terms`` (id, hash, value, is_literal, datatype, lang) is a stored table; ``clashes`` are its few rows
    whose id isn't their hash. Besides there are parts of it that are broadcast: ``often`` (id and the term) has terms that
    many rows hold, and ``named`` (id, value), by column, all that the column holds."""

    def __init__(self, spark: SparkSession, tables: list[DataFrame], clashes: list[tuple], mask: int, size: int | None = None, base: Dictionary | None = None):
        self.spark, self.tables, self.clashes, self.mask = spark, tables, clashes, mask
        self.terms = reduce(lambda a, b: a.unionByName(b), tables)
        self.other = {tuple(c[1:]): c[0] for c in clashes}
        self.bytes = self.terms.agg(F.coalesce(F.sum(F.octet_length("value") + ROW_BYTES), F.lit(0))).first()[0] if size is None else size
        self.broadcast = self.bytes <= MOST_BROADCAST_BYTES
        self.often: DataFrame | None = base.often if base else None
        self.named: dict[str, DataFrame] = dict(base.named) if base else {}

    def name(self, column: str, values: DataFrame) -> None:
        """Keep what a column holds, of values(column), a stored table of distinct resources, if it is small enough to be broadcast."""
        if not self.broadcast and values.agg(F.coalesce(F.sum(F.octet_length(column) + ROW_BYTES), F.lit(0))).first()[0] <= MOST_BROADCAST_BYTES:
            self.named[column] = self.encode(values.select(F.col(column).alias("value"), F.col(column).alias("id")), ["id"])

    @classmethod
    def of(cls, *parts: DataFrame, base: Dictionary | None = None, mask: int = MASK) -> Dictionary:
        """Of tables of terms; with ``base``, whose numbers stay, one that has these too."""
        mask = base.mask if base else mask
        rows = reduce(lambda a, b: a.unionByName(b), parts).where("value is not null").select(*TERM).distinct()
        rows = rows.withColumn("hash", _hash(*(F.col(c) for c in TERM), mask))
        same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in TERM))
        if base:
            few = rows.limit(FEW + 1).collect()
            if len(few) <= FEW:  # as of axioms: one look at the base
                return cls._with_few(few, base)
            rows = rows.alias("r").join(base.terms.alias("b"), (F.col("r.hash") == F.col("b.hash")) & same("r", "b"), "left_anti")
        rows = stored(rows.select("hash", *TERM))
        again = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        if base:
            again = again.union(base.terms.select(F.col("id").alias("hash")).join(rows.select("hash"), "hash", "left_semi"))
        again = held(again.distinct())  # before the join, which else shuffles all text for the few or none that there are
        several = rows.join(again, "hash", "left_semi").orderBy("hash", *TERM).limit(MOST_BROADCAST_ROWS + 1).collect()
        if len(several) > MOST_BROADCAST_ROWS:
            raise ValueError("more terms share a hash than a broadcast may hold")  # of 64 bits, beyond 10**12 terms
        table, clashes = rows.withColumn("id", F.col("hash")), []
        if several:
            clashes = cls._numbered(rows, several, base, mask)
            found = local(rows.sparkSession, clashes, f"id long, hash long, {TERM_SCHEMA}")
            matched = rows.alias("r").join(F.broadcast(found).alias("b"), (F.col("r.hash") == F.col("b.hash")) & same("r", "b"), "left")  # a row a clash
            table = stored(matched.select(F.coalesce("b.id", "r.hash").alias("id"), "r.hash", *(f"r.{c}" for c in TERM)))
        return cls(rows.sparkSession, [*(base.tables if base else []), table.select("id", "hash", *TERM)], [*(base.clashes if base else []), *clashes], mask, base=base)

    @classmethod
    def _with_few(cls, few: list, base: Dictionary) -> Dictionary:
        hashes = [r["hash"] for r in few]
        there = base.terms.where(F.col("id").isin(hashes) | F.col("hash").isin(hashes)).collect() if few else []
        known = {tuple(r[c] for c in ("hash", *TERM)) for r in there}
        new = sorted((r for r in few if tuple(r[c] for c in ("hash", *TERM)) not in known), key=lambda r: (r["hash"], *(str(r[c]) for c in TERM)))
        ids, count = {r["id"] for r in there}, Counter(r["hash"] for r in new)
        rows = local(base.spark, [tuple(r[c] for c in ("hash", *TERM)) for r in new], f"hash long, {TERM_SCHEMA}")
        clashes = cls._numbered(rows, [r for r in new if count[r["hash"]] > 1 or r["hash"] in ids], base, base.mask)
        other = {c[1:]: c[0] for c in clashes}
        numbered = [(other.get(k := tuple(r[c] for c in ("hash", *TERM)), r["hash"]), *k) for r in new]
        table = local(base.spark, numbered, f"id long, hash long, {TERM_SCHEMA}")
        out = cls(base.spark, [*base.tables, table], [*base.clashes, *clashes], base.mask, base.bytes, base)
        asked = {tuple(r[c] for c in ("hash", *TERM)) for r in few}
        often = {r[0]: (r[0], *r[2:]) for r in numbered} | {r["id"]: (r["id"], *(r[c] for c in TERM)) for r in there if tuple(r[c] for c in ("hash", *TERM)) in asked}
        if base.often is None:
            out.often = local(base.spark, list(often.values()), f"id long, {TERM_SCHEMA}")
        return out

    @staticmethod
    def _numbered(rows: DataFrame, several: list, base: Dictionary | None, mask: int) -> list[tuple]:
        """Free numbers for all but the first term of each hash; those of ``base`` keep theirs."""
        if not several:
            return []
        used = rows.select(F.col("hash").alias("id"))
        if base:
            used = used.union(base.terms.select("id"))
        taken = {r["id"] for r in base.terms.where(F.col("id").isin([r["hash"] for r in several])).select("id").collect()} if base else set()
        step, out, given = mask & -mask, [], set()
        for r in several:
            if r["hash"] not in taken:
                taken.add(r["hash"])
                continue
            at = r["hash"]
            while True:
                tries = [at + step * k for k in range(1, 1025)]
                tries = [(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in tries]
                busy = {x["id"] for x in used.where(F.col("id").isin(tries)).select("id").collect()} | given
                if free := next((x for x in tries if x not in busy), None):
                    break
                at = tries[-1]
            given.add(free)
            out.append((free, r["hash"], *(r[c] for c in TERM)))
        return out

    def number(self, resource: str) -> Column:
        """That of a resource, as a constant."""
        none = F.lit(None).cast("string")
        h = _hash(F.lit(resource), F.lit(False), none, none, self.mask)
        other = next((i for (_, *t), i in self.other.items() if t == [resource, False, None, None]), None)
        return h if other is None else F.lit(other)

    def encode(self, df: DataFrame, columns: list[str], statement: bool = False) -> DataFrame:
        """Numbers in place of the resources in the columns; with ``statement`` in place of the object too, whose
        other columns go."""
        none, no = F.lit(None).cast("string"), F.lit(False)
        parts = {c: (F.col(c), no, none, none) for c in columns}
        if statement:
            parts["o"] = (F.col("o"), F.col("is_literal"), F.col("datatype"), F.col("lang"))
        if not self.clashes:
            out = df.withColumns({c: _hash(*t, self.mask) for c, t in parts.items()})
        else:
            rows = local(self.spark, self.clashes, f"id long, hash long, {TERM_SCHEMA}")
            out = df.withColumns({f"_{c}": F.struct(_hash(*t, self.mask).alias("hash"), *(x.alias(n) for x, n in zip(t, TERM, strict=True))) for c, t in parts.items()})
            for c in parts:
                known = rows.select(F.col("id").alias(f"_id_{c}"), F.struct("hash", *TERM).alias("_term"))
                out = out.join(F.broadcast(known), F.col(f"_{c}").eqNullSafe(F.col("_term")), "left").drop("_term")  # checked when they were found
                out = out.withColumn(c, F.coalesce(f"_id_{c}", f"_{c}.hash")).drop(f"_{c}", f"_id_{c}")
        return out.drop("is_literal", "datatype", "lang") if statement else out

    def decode(self, df: DataFrame, columns: list[str], statement: bool = False) -> DataFrame:
        """The other way. Where the terms aren't broadcast, df should be a stored table, as it may be read several times."""
        names = [*columns, *(["o"] if statement else [])]
        wide = [c for c in names if not (self.broadcast or c == "p" or c in self.named)]
        often, predicates = self.often if statement and "o" in wide else None, df.select(F.col("p").alias("id")) if "p" in names and not self.broadcast else None  # before texts are joined, which a distinct of predicates would repeat
        plain = lambda t, c: t.select(F.col("id").alias("_id"), *(F.col(x).alias(f"_{c}_{x}") for x in (TERM if statement and c == "o" else TERM[:1])))

        def texts(rows: DataFrame, c: str, table: DataFrame) -> DataFrame:
            return rows.join(plain(table, c), F.col(c) == F.col("_id"), "left").drop("_id")

        if often is not None:  # rows whose object is among these take no part in the objects' shuffle
            keys = F.broadcast(often.select(F.col("id").alias("_id")))
            rest = df.join(keys, F.col("o") == F.col("_id"), "left_semi")
            df = texts(df.join(keys, F.col("o") == F.col("_id"), "left_anti"), "o", self.terms).unionByName(rest, allowMissingColumns=True)
        elif "o" in wide:
            df = texts(df, "o", self.terms)
        for c in wide:
            if c != "o":
                df = texts(df, c, self.terms.where(is_resource(F.col("id"))))
        for c in names:
            if self.broadcast:
                df = texts(df, c, F.broadcast(self.terms))
            elif c in self.named:
                df = texts(df, c, F.broadcast(self.named[c]))
            elif c == "p":
                known = held(predicates.distinct())
                df = texts(df, c, small(self.terms.join(known, "id", "left_semi")))
        if often is not None:
            of = plain(often, "o").withColumnsRenamed({f"_o_{x}": f"_often_{x}" for x in TERM})
            df = df.join(F.broadcast(of), F.col("o") == F.col("_id"), "left").drop("_id")
            df = df.withColumns({f"_o_{x}": F.coalesce(f"_o_{x}", f"_often_{x}") for x in TERM}).drop(*(f"_often_{x}" for x in TERM))
        df = df.withColumns({c: F.col(f"_{c}_value") for c in names}).drop(*(f"_{c}_value" for c in names))
        return df.withColumnsRenamed({f"_o_{x}": x for x in TERM[1:]}) if statement else df


@dataclass
class Graph:
    """Triples of contexts as numbers: facts(context_id, s, p, o, and, where known, seq), each once, a stored table."""

    facts: DataFrame
    terms: Dictionary

    @classmethod
    def of(cls, facts: DataFrame) -> Graph:
        """Of a set of facts(context_id, s, p, o, is_literal, datatype, lang)."""
        contexts = stored(facts.select("context_id").distinct())
        d = Dictionary.of(statements(facts), resources(contexts, "context_id"))
        d.name("context_id", contexts)
        return cls(stored(d.encode(facts.select("context_id", "s", "p", "o", *TERM[1:]), ["context_id", "s", "p"], True)), d)

    @staticmethod
    def together(facts: DataFrame) -> DataFrame:
        """Numbered facts by context and subject: rows of a subject stay side by side, so that what repeats in them takes
        little room, and a distinct of them needs no other shuffle."""
        return facts.repartition("context_id", "s")

    @classmethod
    def of_files(cls, links: DataFrame, triples: DataFrame) -> Graph:
        """The set of triples of all files of each context."""
        rows = stored(triples)
        links = links.select("stored_name", "context_id")
        contexts = stored(links.select("context_id").distinct())
        d = Dictionary.of(statements(rows), resources(contexts, "context_id"))
        d.name("context_id", contexts)
        bag = d.encode(links, ["context_id"]).join(d.encode(rows, ["s", "p"], True), "stored_name")
        keys = ["context_id", "s", "p", "o"]
        bag = cls.together(bag.select(*keys, *(["seq"] if "seq" in rows.columns else [])))
        facts = bag.groupBy(*keys).agg(F.min("seq").alias("seq")) if "seq" in rows.columns else bag.distinct()
        return cls(stored(facts.sortWithinPartitions("context_id", "s")), d)

    def rows(self) -> DataFrame:
        """As text."""
        return self.terms.decode(self.facts, ["context_id", "s", "p"], True)
