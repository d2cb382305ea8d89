"""Equality joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def spread_join(rows: DataFrame, facts: DataFrame, key: str | list[str], salts: int = SALTS, kind: str = "inner") -> DataFrame:
    """rows with the columns of facts, which has one row for each value of key; kind is inner or left.

    Rows of one key are dealt over `salts` groups by a hash of their other columns. facts is copied
    only to the groups that exist, so at most `salts` rows meet for a key when it is copied, and a
    group of rows holds about a `salts`-th of its key's rows. Rows that are equal in every column
    fall into one group. Null keys drop out of an inner join.
    """
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    rows = rows.withColumn("_salt", dealt)
    keys = [key] if isinstance(key, str) else list(key)
    copied = rows.select(*keys, "_salt").distinct().join(facts, keys)
    return rows.join(copied, [*keys, "_salt"], kind).drop("_salt")
