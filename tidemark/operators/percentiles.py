"""Exact percentiles without gathering a group in one task.

Spark's ``percentile`` holds all distinct values of a group in one task. Here rows are read twice:
once to count them by bins of about a thousandth in width, which says in which bins the wanted
ranks lie, and once to count the values in these bins, which are then put in order. Both counts are
combined before they are shuffled. What one task sorts is the distinct values of one bin of one
group, and sorting spills. Nulls are left out; values interpolate linearly between the two nearest
ranks, as ``percentile`` has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_E = 1024
#: Above every |ln| of a double; infinite values get the last bin.
_MOST_LN = 1000.0


def _bin(value: Column) -> Column:
    """A number that never falls where the value grows."""
    code = F.floor(F.least(F.ln(F.abs(value)), F.lit(_MOST_LN)) * BINS_PER_E) + int(_MOST_LN) * BINS_PER_E
    return F.when(value > 0, code).when(value < 0, -code).otherwise(0)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """``keys`` and, for each name of ``wanted``, that fraction's percentile of the double ``value``; no row for a group without values."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], value.alias("v")).filter("v IS NOT NULL")
    rows = rows.withColumn("bin", _bin(F.col("v")))
    group = Window.partitionBy(*names)
    upto = F.sum("c").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = rows.groupBy(*names, "bin").agg(F.count("*").alias("c"))
    bins = bins.select(*names, "bin", (upto - F.col("c")).alias("before"), "c", F.sum("c").over(group).alias("n"))

    def ranks(p: float) -> tuple[Column, Column, Column]:
        at = (F.col("n") - 1) * F.lit(p)
        return at, F.floor(at), F.ceil(at)

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))

    near = F.lit(False)
    for p in wanted.values():
        _, low, high = ranks(p)
        near = near | holds(low) | holds(high)
    near = bins.filter(near).select(*[F.col(n).alias(f"b_{n}") for n in names], F.col("bin").alias("b_bin"), "before", "n")
    if not keys:  # two bins a fraction at most
        near = F.broadcast(near)
    same = rows["bin"] == near["b_bin"]
    for n in names:
        same = same & rows[n].eqNullSafe(near[f"b_{n}"])
    counts = rows.join(near, same).groupBy(*names, "bin", "v").agg(F.count("*").alias("c"), F.max("before").alias("before"), F.max("n").alias("n"))
    inner = Window.partitionBy(*names, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("before", F.col("before") + F.sum("c").over(inner) - F.col("c"))
    ends = []
    for i, p in enumerate(wanted.values()):
        _, low, high = ranks(p)
        ends += [F.max(F.when(holds(low), F.col("v"))).alias(f"low{i}"), F.max(F.when(holds(high), F.col("v"))).alias(f"high{i}")]
    found = placed.groupBy(*names).agg(F.max("n").alias("n"), *ends).filter("n IS NOT NULL")
    out = []
    for i, (name, p) in enumerate(wanted.items()):
        at, low, high = ranks(p)
        a, b = F.col(f"low{i}"), F.col(f"high{i}")
        out.append(F.when(a == b, a).otherwise((high - at) * a + (at - low) * b).alias(name))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *out)
