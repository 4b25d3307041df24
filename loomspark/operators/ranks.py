"""Ranks and running sums that no single task has to compute.

A window over one key (or none) puts all its rows into one task. Here rows are first dealt to bins that follow the
order; sums per bin are small, their running sums give each bin's start, and windows run within bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import seeded

#: Bins for each factor of e of a number's size.
BINS = 4096


def number_bin(x: Column) -> Column:
    """A bin that never falls as x grows."""
    return F.floor(F.signum(x) * BINS * F.log1p(F.abs(x))).cast("long")


def running(df: DataFrame, groups: list[str], bins: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each output: input of ``sums``, the sum of the input over the rows before in its group.

    ``bins`` are columns whose order agrees with ``order``; rows that are equal in ``order`` must be equal in ``bins``.
    """
    totals = df.groupBy(*groups, *bins).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    over = Window.partitionBy(*groups).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, *bins]
    starts = totals.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0)).alias(f"_s_{k}") for k in sums])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    joined = df.join(starts, same)
    within = Window.partitionBy(*groups, *bins).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*df.columns, *[(F.col(f"_s_{k}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(k) for k, v in sums.items()])


def seeded_rank(df: DataFrame, groups: list[str], key: str, seed: int | str | Column, before: list[str] | None = None, name: str = "rn") -> DataFrame:
    """``df`` with the 0-based rank of each row in its group, by the columns ``before``, then seeded order, then key."""
    before = before or []
    binned = df.withColumn("_h", seeded(key, seed)).withColumn("_bin", F.substring("_h", 1, 3)).withColumn("_one", F.lit(1).cast("long"))
    out = running(binned, groups, [*before, "_bin"], [*[F.col(b) for b in before], F.col("_h"), F.col(key)], {name: "_one"})
    return out.drop("_h", "_bin", "_one")
