"""Percentiles by nearest rank and medians, of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, one column a name of ``ranks``): for each group the values that hold given places among its values in order.

    ``ranks`` gives places from 1, as columns over ``n``, the number of the group's values; nulls are no values. Equal values are counted
    before anything moves. Counts are written in ranges of key and value, so a group may be of any size: the ranges' sums say which of them holds a place, and only those are
    looked into. Groups without values are left out; a null key is a group.
    """
    from ledgerline.operators.written import in_order

    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    rows = in_order(counted, [*keys, "v"], "ranked-values")
    runs = rows.groupBy("part", *keys).agg(F.sum("c").alias("s"))  # a row a range, and one more a group
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("s").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before).withColumn("n", F.sum("s").over(group))
    inside = lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("s"))
    some = F.lit(False)
    for r in ranks.values():
        some = some | inside(r)
    wanted = runs.filter(some).select(*[F.col(k).alias(f"run {k}") for k in keys], F.col("part").alias("run part"), "before", "n")
    on = F.col("part") == F.col("run part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"run {k}"))
    running = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(wanted), on).withColumn("last", F.col("before") + F.sum("c").over(running))  # at most a range for each place and group
    holds = lambda r: (F.col("last") >= r) & (F.col("last") - F.col("c") < r)
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(holds(r), F.col("v"))).alias(name) for name, r in ranks.items()])


def nearest_rank(q: float, n: str = "n") -> Column:
    """The place of the ``q``-th percentile among n values: q/100 * n + 0.5 to the nearest whole number, halves to the even one."""
    place = F.bround(F.lit(q / 100.0) * F.col(n) + 0.5, 0).cast("long")
    return F.greatest(F.lit(1), F.least(F.col(n), place))


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median): the mean of the two middle values of each group."""
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return ranked_values(df, keys, value, {"low": low, "high": high}).select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias("median"))
