"""Precision, recall, confusion counts and spread of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a, b, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0."""
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), digits)


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, abstained (null prediction), precision, recall, f1, accuracy."""
    e, p = F.expr(expected), F.expr(predicted)
    counts = rows.agg(
        F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"),
        F.count_if(~e & ~p).alias("tn"), F.count_if(p.isNull()).alias("abstained"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def spread(rows: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    """Mean, population and sample deviation, exact median and 99th percentile for each key."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_pop(value), digits).alias("std_pop"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), digits).alias("std_samp"),
        F.round(F.percentile(value, F.lit(0.5)), digits).alias("p50"),
        F.round(F.percentile(value, F.lit(0.99)), digits).alias("p99"),
    )
