"""Embeddings: which are usable, and their components as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgcube.sources.tables import MOST_BROADCAST_ROWS

#: A table beyond the broadcast bound is repeated so often in a join, and the other side's rows dealt over the copies.
SALTS = 64


def doubles(column: str) -> Column:
    """Components as doubles, without negative zeros."""
    return F.transform(F.col(column).cast("array<double>"), lambda x: x + F.lit(0.0))


def finite(vector: Column) -> Column:
    """Is the vector there, with finite components only? True for an empty one."""
    plain = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vector, plain), F.lit(False))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column without nulls, whose lists have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype, copy=False).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], entries: int, how: str = "inner") -> DataFrame:
    """rows joined with the few rows of table(keys, ...). ``entries``: what the table holds in all; beyond the bound of
    a broadcast it is repeated SALTS times, so that a key with a third of all rows is spread over as many tasks."""
    if entries <= MOST_BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
