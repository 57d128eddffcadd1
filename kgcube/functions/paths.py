"""Column expressions over member paths.

The coordinate of a cell in one dimension is an array of member values from the coarsest level down;
the empty array is the ALL coordinate. A cell has one path column per dimension, named like it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_path() -> Column:
    return F.array().cast("array<string>")


def lit_path(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)).cast("array<string>") if values else all_path()


def prefix(path: Column, n) -> Column:
    """The n coarsest members, or all if there are fewer."""
    return F.slice(path, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def month_of(day: Column) -> Column:
    """'yyyy-MM-dd' -> 'yyyy-MM'; null for other shapes and for dates that don't exist."""
    ok = day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    return F.when(ok, F.substring(day, 1, 7))


def year_of(month: Column) -> Column:
    """'yyyy-MM' -> 'yyyy'; null for other shapes."""
    return F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.substring(month, 1, 4))


def day_path(day: Column) -> Column:
    """Year, month and day of a date; ALL for null."""
    return F.when(day.isNull(), all_path()).otherwise(F.array(F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy-MM-dd")))


def hierarchy_text(dimension: str, levels: list[str], path: Column) -> Column:
    names = F.array(*map(F.lit, levels))
    parts = F.transform(path, lambda v, i: F.concat(F.get(names, i), F.lit("="), v))
    return F.concat(F.lit(f"{dimension}|"), F.array_join(parts, "|"))


def hierarchy_id(dimension: str, levels: list[str], path: Column) -> Column:
    return F.sha2(hierarchy_text(dimension, levels, path), 256)


def context_id(ids: list[Column]) -> Column:
    """Of hierarchy ids in the order of dimension names."""
    return F.sha2(F.concat_ws(",", *ids) if ids else F.lit("EMPTY"), 256)


def starts_with(path: Column, coarse: Column) -> Column:
    """Does the path roll up to the coarse one?"""
    return F.slice(path, F.lit(1), F.size(coarse)) == coarse


def rolls_up_to(fine: dict[str, Column], coarse: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (starts_with(fine[d], coarse[d]) for d in coarse))


def parent(path: Column) -> Column:
    """One level up; a single member goes to ALL, and ALL has no parent (null)."""
    return F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))))


def ancestors(path: Column) -> Column:
    """The path itself, its parent, and so on to ALL."""
    return F.transform(F.sequence(F.size(path), F.lit(0), F.lit(-1)), lambda n: F.slice(path, F.lit(1), n))


def level_map(levels: list[str], path: Column) -> Column:
    return F.map_from_arrays(F.slice(F.array(*map(F.lit, levels)), F.lit(1), F.size(path)), path)


def from_level_map(levels: list[str], members: Column) -> Column:
    """A path again; it ends at the first level that has no member."""
    values = [F.try_element_at(members, F.lit(x)) for x in levels]
    out = all_path()
    for n in range(len(levels), 0, -1):
        whole = reduce(lambda a, b: a & b, (v.isNotNull() for v in values[:n]))
        nxt = values[n] if n < len(levels) else None
        cond = whole if nxt is None else whole & nxt.isNull()
        out = F.when(cond, F.array(*values[:n])).otherwise(out)
    return out


def label(dimension: str, path: Column) -> Column:
    return F.concat(F.lit(f"{dimension}:"), F.when(F.size(path) == 0, F.lit("ALL")).otherwise(F.array_join(path, ">")))


def valid_member(value: Column) -> Column:
    return F.coalesce((F.length(value) > 0) & ~value.contains("|"), F.lit(False))


def iso_date(value: Column) -> Column:
    """The written date of an ISO date or date-time, null if there is none."""
    return F.try_to_date(F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})(T[0-9:.]+(Z|[+-]\d{2}:?\d{2})?)?$", 1), "yyyy-MM-dd")


def days(begin: Column, end: Column) -> Column:
    """Dates from begin to end; a missing end is the other one; none if both are missing or reversed."""
    b, e = F.coalesce(begin, end), F.coalesce(end, begin)
    return F.when(b <= e, F.sequence(b, e)).otherwise(F.array().cast("array<date>"))


def graph_iri(base: str, cid: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{base}context/"), cid, F.lit(suffix))


def last_segment(iri: Column) -> Column:
    """After '#', else after '/', else all; a separator at the end is ignored."""
    t = F.regexp_replace(iri, "[#/]$", "")
    return F.when(t.contains("#"), F.substring_index(t, "#", -1)).otherwise(F.substring_index(t, "/", -1))


def display_name(iri: Column) -> Column:
    s = last_segment(iri)
    return F.when(iri.contains("#") | iri.contains("/"), s).otherwise(F.substring_index(iri, ":", -1))


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def icao(link: Column) -> Column:
    """The first dot-separated part of three to five capitals."""
    return F.try_element_at(F.filter(F.split(link, r"\."), lambda x: x.rlike("^[A-Z]{3,5}$")), F.lit(1))


def local_tag(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
