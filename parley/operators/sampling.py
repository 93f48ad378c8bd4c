"""Samples: weighted and plain round robin over groups, largest-remainder targets, greedy assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import lookup


def weighted_round_robin(rows: DataFrame, group_col: str, order_col: str, weights: dict[str, int], size: int) -> DataFrame:
    """size rows: rounds over the groups by name, each round takes a group's weight of its next rows; id is group-0001 and so on.

    Only a group's first rows can be chosen, so each partition hands on at most `size` rows of a group before they are ranked (the window's group limit)."""
    names = sorted(weights)
    weight = {n: max(1, int(weights[n])) for n in names}
    offset = {n: sum(weight[m] for m in names[:i]) for i, n in enumerate(names)}
    group = F.col(group_col)
    ranked = rows.where(group.isin(*names)).withColumn("rn", F.row_number().over(Window.partitionBy(group_col).orderBy(order_col))).where(F.col("rn") <= size)
    w = lookup(weight, group, 1)
    placed = ranked.withColumn("round", F.floor((F.col("rn") - 1) / w).cast("int")).withColumn("slot", (lookup(offset, group, 0) + (F.col("rn") - 1) % w).cast("int"))
    return placed.withColumn("sample_id", F.format_string("%s-%04d", group, F.col("rn"))).orderBy("round", "slot").limit(size)


def round_robin(rows: DataFrame, group_col: str, order_col: str, size: int) -> DataFrame:
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(group_col).orderBy(order_col))).where(F.col("rn") <= size)
    return ranked.orderBy("rn", group_col).limit(size)


def largest_remainder(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers that add up to total: floors, then one each to the largest remainders (ties: the later name)."""
    exact = {k: total * v for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (exact[k] - out[k], k), reverse=True)[: total - sum(out.values())]:
        out[k] += 1
    return out


def largest_remainder_targets(counts: DataFrame, name_col: str, count_col: str, total: int) -> DataFrame:
    """name, share and target of a small table of groups (languages, strata)."""
    from_all = counts.crossJoin(F.broadcast(counts.agg(F.sum(count_col).alias("_all"))))  # one row
    exact = F.col(count_col) * total / F.col("_all")
    floored = from_all.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact")).withColumn("_frac", F.round(F.col("_exact") - F.col("_floor"), 9))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(1)))
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_frac"), F.desc(name_col)))
    return floored.withColumn("_left", left).withColumn("_place", order).select(name_col, count_col, (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("int")).cast("long").alias("target"))


def assign(preferences: dict[str, list[str]], targets: dict[str, int]) -> dict[str, str]:
    """Each case its first preference with room left; cases with the fewest preferences choose first. For corpus plans of a few thousand cases, on the driver."""
    room, out = dict(targets), {}
    for case, wanted in sorted(preferences.items(), key=lambda x: len(x[1])):
        out[case] = next((r for r in wanted if room.get(r, 0) > 0), wanted[0])
        room[out[case]] = room.get(out[case], 0) - 1
    return out
