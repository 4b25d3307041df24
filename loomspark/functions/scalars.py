"""Scalar rules of partition sampling, as plain numbers and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: float) -> int:
    """Rounded to the nearest whole number, ties to the even one."""
    return round(x)


def quota(positives: int, total: int, *, least: float = 0.01, most: float = 0.5, max_samples: int = 10_000, min_samples: int = 30, min_positives: int = 10, force: bool = False) -> tuple[int, int]:
    """How many positives and how many rows a partition takes of a table with these counts.

    Raises ValueError if there are too few positives or rows. Where more negatives would be asked for than there are,
    the positives are cut down to keep their share at ``most``.
    """
    if positives < min_positives:
        raise ValueError("Not enough positive samples")
    if total < min_samples:
        raise ValueError("Not enough total samples")
    share = positives / total
    if total <= max_samples:
        if share < least:
            return positives, half_even(positives / least)
        if share > most and force:
            p = min(half_even(half_even((total - positives) / (1 - most)) * most), positives)
            return p, half_even(p / most)
        return positives, total
    fill = lambda p: positives if positives / max_samples < most else p
    if share < least:
        p = min(max(half_even(max_samples * least), min_positives), positives)
        return (p, half_even(p / least)) if p / max_samples < least else (fill(p), max_samples)
    if share > most:
        p, n = half_even(max_samples * most), total - positives
        if max_samples - p > n:
            p = half_even(n * most / (1 - most))
            return p, p + n
        return p, max_samples
    p = half_even(max_samples * share)
    if p < min_positives:
        p = max(half_even(max_samples * least), min_positives)
    return fill(p), max_samples


def quota_columns(p: Column, n: Column, least: Column, most: Column, s: Column, min_positives: Column, force: Column) -> tuple[Column, Column]:
    """``quota`` as two columns, for rows that pass its checks."""
    r = lambda x: F.bround(x, 0)
    share = p / n
    fill = lambda x: F.when(p / s < most, p).otherwise(x)
    forced = F.least(r(r((n - p) / (1 - most)) * most), p)
    rare = F.least(F.greatest(r(s * least), min_positives), p)
    over = r(s * most)
    short = s - over > n - p
    middle = F.when(r(s * share) < min_positives, F.greatest(r(s * least), min_positives)).otherwise(r(s * share))
    small = F.when(share < least, p).when((share > most) & force, forced).otherwise(p)
    small_n = F.when(share < least, r(p / least)).when((share > most) & force, r(forced / most)).otherwise(n)
    capped = r((n - p) * most / (1 - most))
    large = F.when(share < least, F.when(rare / s < least, rare).otherwise(fill(rare))).when(share > most, F.when(short, capped).otherwise(over)).otherwise(fill(middle))
    large_n = F.when(share < least, F.when(rare / s < least, r(rare / least)).otherwise(s)).when((share > most) & short, capped + n - p).otherwise(s)
    return F.when(n <= s, small).otherwise(large).cast("long"), F.when(n <= s, small_n).otherwise(large_n).cast("long")


def min_rounds(total: int, size: int, confidence: float = 0.99) -> int:
    """Draws after which a row has been drawn with the given confidence."""
    return 1 if size >= total else math.ceil(math.log(1 - confidence) / math.log(1 - size / total))


def min_partitions(total: int, size: int) -> int:
    """The fewest draws that leave a row unseen with a probability of 1e-6 / total at most."""
    return 1 if size >= total else max(1, math.ceil(math.log(1e-6 / total) / math.log(1 - size / total)))


def min_seen(total: int, size: int) -> int:
    """``min_partitions`` held to 1, 2 or 3."""
    return min(max(1, min_partitions(total, size)), 3)


def step_grid(least: int = 10_000, most: int = 100_000, steps: int = 5) -> list[int]:
    """Sample sizes in equal steps, the largest last."""
    step = (most - least) // (steps - 1)
    grid = list(range(least, most, step)) if step else []
    return [*grid, most] if not grid or grid[-1] != most else grid


def seeded(key: str, seed: int | str | Column) -> Column:
    """A reproducible pseudo-random order of keys that other SQL engines share; the seed may differ by row."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), seed if isinstance(seed, Column) else F.lit(str(seed))))


def partition_name(i: Column) -> Column:
    return F.concat(F.lit("partition_"), F.lpad(i.cast("string"), 3, "0"))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def gigabytes(n: Column) -> Column:
    """Bytes as units of 2**30."""
    return n / F.lit(float(1 << 30))
