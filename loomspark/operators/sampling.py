"""Class-rebalanced row partitions that cover a table.

A draw takes the least-seen rows of each class first, in seeded order among equals. Candidate partitions are scored,
a greedy cover accepts those that see the most under-seen rows, and near-equal ones are dropped. Frames stay on the
executors; only counts, scores and partition numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import quota, seeded
from loomspark.operators.ranks import seeded_rank
from loomspark.sources.stored import stored


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """(positives, rows)."""
    r = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.count("*").alias("n")).first()
    return int(r["p"] or 0), int(r["n"])


def draw(rows: DataFrame, key: str, label: str, size: dict[int, int], round_: int, seed: int | str = 42) -> DataFrame:
    """Of rows (key, label, seen) the ``size[y]`` least-seen ones of each label y."""
    ranked = seeded_rank(rows, [label], key, f"{seed}:{round_}", before=["seen"], name="_rn")
    limit = F.coalesce(*[F.when(F.col(label) == y, F.lit(n)) for y, n in size.items()], F.lit(0))
    return ranked.filter(F.col("_rn") < limit).drop("_rn")


def candidates(df: DataFrame, key: str, label: str, size: dict[int, int], rounds: int, seed: int | str = 42) -> DataFrame:
    """(partition_id, key, label) of ``rounds`` least-seen-first draws.

    Draws are dealt like cards. In a cycle every row of a class has been seen equally often and is ranked once, by the
    seeded order of the cycle; draw r takes ranks r * size to (r + 1) * size - 1 counted over all cycles. A draw that
    straddles two cycles takes the end of one and the start of the next; a row that would come twice in it gives its
    second place to nobody, so such a draw may be smaller by those few rows. Counts within a class differ by 2 at most.
    """
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect() if r[label] in size}
    of = lambda values: F.coalesce(*[F.when(F.col(label) == y, F.lit(v)) for y, v in values.items()])
    cycles = {y: -(-rounds * size[y] // total) for y, total in n.items() if size[y]}
    if not cycles:
        return df.limit(0).select(F.lit(0).alias("partition_id"), key, label)
    dealt = df.filter(F.col(label).isin(list(cycles))).select(key, label).withColumn("_c", F.explode(F.sequence(F.lit(0), of(cycles) - 1)))
    # a class that every draw takes whole needs no order: the cycle is the draw
    whole = [y for y in cycles if size[y] == n[y]]
    ranked = seeded_rank(dealt.filter(~F.col(label).isin(whole)), [label, "_c"], key, F.concat(F.lit(f"{seed}:"), F.col(label), F.lit(":"), F.col("_c")), name="_rn")
    at = F.col("_rn") + F.col("_c") * of(n)
    drawn = ranked.select(F.floor(at / of(size)).cast("int").alias("partition_id"), key, label)
    taken = dealt.filter(F.col(label).isin(whole)).select(F.col("_c").cast("int").alias("partition_id"), key, label)
    return drawn.unionByName(taken).filter(F.col("partition_id") < rounds).distinct()


def seen_counts(parts: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """(key, seen) of every row of the universe."""
    return universe.select(key).join(parts.groupBy(key).agg(F.count("*").alias("seen")), key, "left").select(key, F.coalesce("seen", F.lit(0)).alias("seen"))


def under_seen(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("seen") < least)


def enough(seen: str, least: Column) -> Column:
    """Whether the least seen row has been seen three times as often as asked for."""
    return F.coalesce(F.col(seen) >= 3 * least, F.lit(True))


def coverage(parts: DataFrame, wanting: DataFrame, key: str) -> DataFrame:
    """(partition_id, covered): how many of the wanting rows each partition holds, 0 included."""
    held = parts.join(wanting.select(key), key, "left_semi").groupBy("partition_id").agg(F.count("*").alias("covered"))
    return parts.select("partition_id").distinct().join(held, "partition_id", "left").select("partition_id", F.coalesce("covered", F.lit(0)).alias("covered"))


def pick(parts: DataFrame, wanting: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """The one partition that covers most wanting rows; ties go to the smallest ``rank`` of order (partition_id, rank)."""
    return coverage(parts, wanting, key).join(order, "partition_id").orderBy(F.desc("covered"), "rank").limit(1)


def held_by(parts: DataFrame, key: str) -> DataFrame:
    """(p, n): sorted lists of the partitions that hold a row, and how many rows each list stands for."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_set("partition_id")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))


def greedy_cover(parts: DataFrame, key: str, rank: Callable[[list[int]], dict[int, tuple]], least: int, most: int = 100, look: int = 64) -> list[int]:
    """Numbers of the accepted partitions, until all rows are seen ``least`` times, none helps, or ``most`` are accepted.

    Each pick takes the partition that covers most rows seen less than ``least`` times; ``rank`` is asked for those that tie and
    the least rank wins. Rows are reduced to the lists of partitions that hold them once. What a partition covers only
    falls, so its last known number bounds it from above: a pick counts the ``look`` partitions of the highest bounds at a
    time, and only those that can still win or tie.
    """
    lists = stored(held_by(parts, key), "held-by")
    sizes = lists.select("n", F.explode("p").alias("partition_id")).groupBy("partition_id").agg(F.sum("n").alias("n")).collect()  # 1000 at most
    bound = {r["partition_id"]: r["n"] for r in sizes}
    accepted: list[int] = []
    while len(accepted) < most and bound:
        exact: dict[int, int] = {} if accepted or least < 1 else dict(bound)
        while rest := sorted((p for p in bound if p not in exact and bound[p] > 0 and bound[p] >= max(exact.values(), default=0)), key=lambda p: (-bound[p], p))[:look]:
            ids = F.lit(accepted).cast("array<int>")
            wanting = lists.filter(F.size(F.array_intersect("p", ids)) < least)
            held = wanting.select("n", F.explode(F.array_intersect("p", F.lit(rest).cast("array<int>"))).alias("partition_id"))
            counts = {r["partition_id"]: r["n"] for r in held.groupBy("partition_id").agg(F.sum("n").alias("n")).collect()}  # ``look`` at most
            for p in rest:
                exact[p] = bound[p] = counts.get(p, 0)
        top = max(exact.values(), default=0)
        if not top:
            return accepted
        tied = [p for p, n in exact.items() if n == top]
        ranks = rank(tied) if len(tied) > 1 else {}
        accepted.append(min(tied, key=lambda p: ranks.get(p, ())))
        del bound[accepted[-1]]
    return accepted


def jaccard_pairs(parts: DataFrame, key: str) -> DataFrame:
    """(a, b, jaccard) of partitions a < b that share a row. Partitions number a hundred or so; rows may be many.

    Rows are first reduced to the set of partitions that hold them, so pairs come from distinct sets, not from rows.
    """
    sets = held_by(parts, key)
    pairs = sets.select("n", F.explode("p").alias("a"), "p").select("n", "a", F.explode(F.filter("p", lambda b: b > F.col("a"))).alias("b"))
    both = pairs.groupBy("a", "b").agg(F.sum("n").alias("both"))
    size = parts.groupBy("partition_id").agg(F.count("*").alias("n"))
    a, b = size.select(F.col("partition_id").alias("a"), F.col("n").alias("na")), size.select(F.col("partition_id").alias("b"), F.col("n").alias("nb"))
    return both.join(a, "a").join(b, "b").select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def redundant(pairs: DataFrame, limit: float = 0.99) -> DataFrame:
    """(partition_id): partitions with an earlier one at the limit or above."""
    return pairs.filter(F.col("jaccard") >= limit).select(F.col("b").alias("partition_id")).distinct()


def distinct_partitions(parts: DataFrame, key: str) -> DataFrame:
    """(partition_id): of partitions with equal rows the smallest number.

    Two partitions are taken for equal if their counts and two order-free sums of row hashes agree.
    """
    h = lambda s: F.sum(F.xxhash64(F.lit(s), key).cast("decimal(38,0)"))
    marks = parts.groupBy("partition_id").agg(F.count("*").alias("n"), h(1).alias("h1"), h(2).alias("h2"))
    return marks.groupBy("n", "h1", "h2").agg(F.min("partition_id").alias("partition_id")).select("partition_id")


def partitions(df: DataFrame, key: str, label: str, *, least: float = 0.01, most: float = 0.5, max_samples: int = 10_000, min_samples: int = 30, min_positives: int = 10, max_partitions: int = 100, least_seen: int = 1, force: bool = False, seed: int | str = 42, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(partition_id, key, label): accepted partitions, numbered from 0 in seeded order.

    ``score`` takes the candidates (partition_id, key, label) and returns (partition_id, auroc); better candidates win
    ties of coverage. A quota that takes the whole table gives one partition.
    """
    p, n = class_counts(df, label)
    want_p, want_n = quota(p, n, least=least, most=most, max_samples=max_samples, min_samples=min_samples, min_positives=min_positives, force=force)
    rows = df.filter(F.col(label).isin(0, 1)).select(key, label)
    want = {1: want_p, 0: min(want_n - want_p, n - p)}
    if want[1] == p and want[0] == n - p:
        return rows.select(F.lit(0).alias("partition_id"), key, label)
    rounds = min(1000, max(-(-p * 3 * least_seen // want[1]), -(-(n - p) * 3 * least_seen // max(1, want[0]))))
    made = stored(candidates(rows, key, label, want, rounds, seed), "candidates")
    made = made.join(F.broadcast(distinct_partitions(made, key)), "partition_id", "left_semi")
    known: dict[int, float] = {}

    def rank(tied: list[int]) -> dict[int, tuple]:
        """Better scores first, then higher numbers; only partitions that tie are scored, once each."""
        new = [p for p in tied if p not in known]
        if new and score:
            known.update({r["partition_id"]: r["auroc"] for r in score(made.filter(F.col("partition_id").isin(new))).collect()})  # 1000 at most
        return {p: (-known.get(p, 0.5), -p) for p in tied}

    chosen = greedy_cover(made, key, rank, least_seen, max_partitions)
    kept = made.filter(F.col("partition_id").isin(chosen))
    kept = kept.join(F.broadcast(redundant(jaccard_pairs(kept, key))), "partition_id", "left_anti")
    number = kept.select("partition_id").distinct().withColumn("_new", (F.row_number().over(Window.orderBy(seeded("partition_id", seed))) - 1).cast("int"))
    return kept.join(F.broadcast(number), "partition_id").select(F.col("_new").alias("partition_id"), key, label)


def report(parts: DataFrame, label: str) -> DataFrame:
    """(n_partitions, avg_positives, avg_negatives)."""
    each = parts.groupBy("partition_id").agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    return each.agg(F.count("*").alias("n_partitions"), F.avg("p").alias("avg_positives"), F.avg("n").alias("avg_negatives"))


def gather(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(pos, ...) rows of ``df`` at index (pos, key); repeated keys repeat rows."""
    return index.join(df, key)


def gather_indirect(df: DataFrame, index: DataFrame, through: DataFrame, key: str) -> DataFrame:
    """Rows at index (pos, i) through (i, key)."""
    return index.join(through, "i").join(df, key)
