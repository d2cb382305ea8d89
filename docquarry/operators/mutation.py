"""States of tables after inserts and deletes, computed as new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import cut


def numbered(rows: DataFrame, order: list, name: str, start: Column | int = 0) -> DataFrame:
    """rows with dense numbers from `start` in that order.

    Rows are sorted by ranges of the order; what meets on the driver is one count for each range.
    Order must tell all rows apart for numbers that are the same on every run.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits are the row's place in its partition
    dealt = cut(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    first = F.lit(start) if isinstance(start, int) else start
    out = dealt.withColumns({"_part": part, name: at}).join(table, "_part")
    return out.withColumn(name, F.col(name) + F.col("_before") + first).drop("_id", "_part", "_before")


def appended(base: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """base with the rows of new behind it, whose keys follow the largest key of base in that order."""
    top = base.agg(F.coalesce(F.max(key), F.lit(-1)).alias("_top"))
    fresh = numbered(new, order, key, 1).crossJoin(F.broadcast(top))  # one row
    fresh = fresh.withColumn(key, (F.col(key) + F.col("_top")).cast(base.schema[key].dataType)).drop("_top")
    return base.unionByName(fresh.select(*base.columns))


def inserted(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with those rows of new whose keys it doesn't have; of new rows of one key the least comes in."""
    firsts = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("_r"))
    firsts = firsts.select(*keys, "_r.*").join(base.select(*keys), keys, "left_anti")
    return base.unionByName(firsts.select(*base.columns))


def counted_delete(rows: DataFrame, gone: Column) -> DataFrame:
    """(deleted, remaining): how many rows a delete takes and leaves; null conditions take none."""
    hit = F.coalesce(gone, F.lit(False))
    return rows.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("remaining"))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """rows that meet all conditions that are given: a value or a list of values for each column; None is no condition."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return rows
