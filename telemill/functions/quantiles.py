"""Exact interpolated quantiles from value counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def quantiles_from_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    n: str,
    quantiles: Mapping[str, float],
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Quantiles per group from rows ``(keys, value, n)`` that are unique per ``(keys, value)``.

    A quantile p sits at position p * (total - 1) of the sorted values, linearly interpolated.  The
    caller counts equal values first, with map-side combine, so a hot group reaches this point as its
    distinct values only; they are walked by a spilling window, not held in one aggregation buffer.
    ``sums`` names further columns to add up per group: ``{result: column}``.
    """
    by_value = Window.partitionBy(*keys).orderBy(value)
    upto = by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum(n).over(upto)).withColumn("_total", F.sum(n).over(group))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col(value)))

    aggregates = []
    for name, p in quantiles.items():
        position = F.lit(p) * (F.col("_total") - 1)
        aggregates += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
        ]
    aggregates += [F.sum(source).alias(target) for target, source in (sums or {}).items()]
    grouped = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggregates)

    out = [F.col(k) for k in keys] + [F.col(t) for t in (sums or {})]
    for name, p in quantiles.items():
        position = F.lit(p) * (F.col("_total") - 1)
        fraction = position - F.floor(position)
        out.append(
            (F.col(f"_lo_{name}") * (1 - fraction) + F.col(f"_hi_{name}") * fraction).cast("double").alias(name)
        )
    return grouped.select(*out)
