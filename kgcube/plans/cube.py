"""Cube schemas: named dimensions of levels, as data."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgcube.functions import paths
from kgcube.sources.tables import exists

#: Roll-up functions by name: Column of a member -> Column of its parent. 'lookup' uses the dimension table.
ROLL_UPS: dict[str, Callable[[Column], Column]] = {"date_to_month": paths.month_of, "date_to_year": paths.year_of}


def register_roll_up(name: str, function: Callable[[Column], Column]) -> None:
    ROLL_UPS[name] = function


@dataclass(frozen=True)
class Level:
    name: str
    depth: int
    roll_up_to: str | None = None
    function: str | None = None


@dataclass(frozen=True)
class Dimension:
    name: str
    levels: tuple[Level, ...]
    rows: tuple[dict, ...] = ()

    @property
    def names(self) -> list[str]:
        return [x.name for x in sorted(self.levels, key=lambda x: x.depth)]

    def depth(self, level: str) -> int:
        if level not in self.names:
            raise ValueError(f"unknown level {level!r} of {self.name!r}")
        return self.names.index(level)


@dataclass(frozen=True)
class Cube:
    id: str
    dimensions: tuple[Dimension, ...]
    base: str = field(default="urn:kgcube:")

    @staticmethod
    def load(data: dict) -> Cube:
        """From a dict {id, dimensions: {name: {levels: [...], hierarchies: [...]}}}; raises on violations."""
        dims = []
        for name in sorted(data.get("dimensions") or {}):
            d = data["dimensions"][name]
            levels = tuple(Level(x["name"], x["depth"], x.get("rollup_to"), x.get("rollup_function")) for x in sorted(d["levels"], key=lambda x: x["depth"]))
            dims.append(Dimension(name, levels, tuple(d.get("hierarchies") or ())))
        cube = Cube(data.get("id") or "", tuple(dims))
        wrong = cube.violations()
        if wrong:
            raise ValueError("; ".join(wrong))
        return cube

    def violations(self) -> list[str]:
        out = []
        if not re.fullmatch(r"[a-z][a-z0-9_-]*", self.id):
            out.append(f"bad id {self.id!r}")
        if not self.dimensions:
            out.append("no dimension")
        for d in self.dimensions:
            names = [x.name for x in d.levels]
            if [x.depth for x in d.levels] != list(range(len(names))) or not names:
                out.append(f"{d.name}: depths have gaps")
            if len(set(names)) < len(names):
                out.append(f"{d.name}: a level name is used twice")
            for x in d.levels:
                if (x.roll_up_to is None) != (x.function is None):
                    out.append(f"{d.name}.{x.name}: parent and function go together")
                if x.depth == 0 and x.roll_up_to:
                    out.append(f"{d.name}.{x.name}: the root has no parent")
                if x.depth > 0 and (x.roll_up_to not in names or names.index(x.roll_up_to) != x.depth - 1):
                    out.append(f"{d.name}.{x.name}: its parent isn't the level above")
                if x.function and x.function != "lookup" and x.function not in ROLL_UPS:
                    out.append(f"{d.name}.{x.name}: unknown function {x.function}")
            for row in d.rows:
                if set(row) - set(names):
                    out.append(f"{d.name}: unknown levels in a hierarchy row")
        return out

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dimensions]

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        raise ValueError(f"unknown dimension {name!r}")

    def levels(self, targets: dict[str, str]) -> dict[str, int]:
        """{dimension: level} -> {dimension: depth}; ALL stands for the root level."""
        return {d: 0 if x == "ALL" else self.dimension(d).depth(x) for d, x in targets.items()}

    def at_leaves(self) -> dict[str, int]:
        return {d.name: len(d.levels) - 1 for d in self.dimensions}

    def at_roots(self) -> dict[str, int]:
        return {d.name: 0 for d in self.dimensions}

    def level_rolls_up_to(self, dimension: str, fine: str, coarse: str) -> bool:
        d = self.dimension(dimension)
        return d.depth(fine) >= d.depth(coarse)

    def level_table(self, spark: SparkSession) -> DataFrame:
        """Levels by dimension, depth and name."""
        rows = [(d.name, x.name, x.depth, x.roll_up_to, x.function) for d in self.dimensions for x in d.levels]
        return spark.createDataFrame(rows, "dimension string, level string, depth int, rollup_to string, rollup_function string")

    def level_order(self, spark: SparkSession) -> DataFrame:
        """(dimension, level, other, rolls_up) for all pairs of levels of a dimension."""
        t = self.level_table(spark)
        other = t.select("dimension", F.col("level").alias("other"), F.col("depth").alias("_depth"))
        return t.join(other, "dimension").select("dimension", "level", "other", (F.col("depth") >= F.col("_depth")).alias("rolls_up"))

    def table(self, spark: SparkSession, dimension: str) -> DataFrame:
        """The dimension table of the cube's own hierarchy rows: a column for each level, and their position."""
        d = self.dimension(dimension)
        rows = [(i, *(r.get(n) for n in d.names)) for i, r in enumerate(d.rows)]
        return spark.createDataFrame(rows, "position int, " + ", ".join(f"{n} string" for n in d.names))

    def ids(self) -> dict[str, Column]:
        return {d.name: paths.hierarchy_id(d.name, d.names, F.col(d.name)) for d in self.dimensions}

    def context_id(self) -> Column:
        return paths.context_id([self.ids()[n] for n in self.names])

    def member_path(self, table: DataFrame | None, df: DataFrame, dimension: str, level: str, value: str, out: str) -> DataFrame:
        """Add ``out``, the path of the member in column ``value``, by repeated roll-up; null if some step has no result.

        ``table`` is the dimension table (one column a level), needed where levels roll up by lookup."""
        d = self.dimension(dimension)
        depth = d.depth(level)
        df = df.withColumn(f"_{depth}", F.col(value))
        for k in range(depth, 0, -1):
            x = d.levels[k]
            if x.function == "lookup":
                if table is None:
                    raise ValueError(f"{dimension}.{x.name} rolls up by lookup")
                df = lookup_parent(df, table, f"_{k}", x.name, x.roll_up_to, f"_{k - 1}")
            else:
                df = df.withColumn(f"_{k - 1}", ROLL_UPS[x.function](F.col(f"_{k}")))
        names = [f"_{k}" for k in range(depth + 1)]
        whole = F.lit(True)
        for n in names:
            whole = whole & F.col(n).isNotNull()
        return df.withColumn(out, F.when(whole, F.array(*names))).drop(*names)

    def scope(self, spark: SparkSession, wanted: dict[str, dict[str, str]], tables: dict[str, DataFrame] | None = None) -> dict[str, list[str]]:
        """{dimension: {level: value}} -> {dimension: whole path}; exactly one level a dimension."""
        out = {}
        for name, choice in wanted.items():
            if len(choice) != 1:
                raise ValueError(f"{name}: give one level")
            (level, value), = choice.items()
            one = spark.createDataFrame([(value,)], "value string")
            path = self.member_path((tables or {}).get(name), one, name, level, "value", "path").select("path").first()
            if path is None or path.path is None:
                raise ValueError(f"{name}: no path for {level} = {value!r}")
            out[name] = path.path
        return out


def lookup_parent(df: DataFrame, table: DataFrame, member: str, level: str, parent: str, out: str) -> DataFrame:
    """Parent of each member from the dimension table; of rows with one member the first by position counts."""
    order = ["position"] if "position" in table.columns else table.columns
    first = table.where(F.col(level).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(level).orderBy(*order))).where("_n = 1")
    return df.join(first.select(F.col(level).alias(member), F.col(parent).alias(out)), member, "left")


def dimension_violations(cube: Cube, name: str, table: DataFrame) -> DataFrame:
    """Rows of a dimension table without a member where a lookup level or its parent needs one, with invalid members, or
    with one in a column that is no level."""
    d = cube.dimension(name)
    bad = [F.when(F.col(x.name).isNull() | F.col(x.roll_up_to).isNull(), F.lit(f"{x.name} or {x.roll_up_to} missing")) for x in d.levels if x.function == "lookup"]
    bad += [F.when(F.col(x.name).isNotNull() & ~paths.valid_member(F.col(x.name)), F.lit(f"{x.name} invalid")) for x in d.levels]
    bad += [F.when(F.col(c).isNotNull(), F.lit(f"unknown level {c}")) for c in table.columns if c not in (*d.names, "position")]
    return table.withColumn("violation", F.coalesce(*bad)).where("violation is not null")


CATALOG = "id string, content string, at long"


class Catalog:
    """Cube schemas as a Parquet table; an id can't be registered with another content."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def text(data: dict) -> str:
        return json.dumps(data, sort_keys=True)

    def list(self) -> DataFrame:
        return self._rows().groupBy("id").agg(F.min_by("content", F.struct("at", "content")).alias("content"))

    def register(self, data: dict) -> None:
        """Each registration is a row of its own, so two writers of one id can't hide each other: the earliest text of
        an id is the schema, and who came later with another one is told."""
        cube, text = Cube.load(data), self.text(data)
        known = self._texts(cube.id)
        if not known:
            self.spark.createDataFrame([(cube.id, text, time.time_ns())], CATALOG).coalesce(1).write.mode("append").parquet(self.path)
            known = self._texts(cube.id)
        if known[0] != text:
            raise ValueError(f"{cube.id} is registered with another content")

    def _texts(self, id: str) -> list[str]:
        return [r.content for r in self._rows().where(F.col("id") == id).orderBy("at", "content").collect()]

    def _rows(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], CATALOG)
        return self.spark.read.schema(CATALOG).parquet(self.path)

    def get(self, id: str) -> Cube:
        row = self.list().where(F.col("id") == id).first()
        if row is None:
            raise KeyError(id)
        return Cube.load(json.loads(row.content))

    def describe(self, id: str) -> DataFrame:
        return self.get(id).level_table(self.spark).groupBy("dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "level"))), lambda x: x["level"]), ">").alias("levels"))
