"""Prefix sums that no single task has to make.

Threshold metrics depend only on how many right and wrong values each distinct
confidence has, so rows are first reduced to *tie groups* (map-side, by any
keys), which are summed in slices of the confidence scale. Order-sensitive metrics need every row: those are summed inside slices
of the confidence scale, which are cut further by ranges of ``ord`` where many
rows share one confidence, and slices get the totals of the slices above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept

#: Slices of the confidence scale in ordered prefix sums.
SLICES = 1024


def times(rows: DataFrame) -> Column:
    """How many rows a row stands for: 1, or its ``n_rows``."""
    return F.col("n_rows") if "n_rows" in rows.columns else F.lit(1)


def tie_groups(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(by, conf, n, pos, errors) of each distinct confidence."""
    n, right = times(outcomes), F.col("correct")
    return outcomes.groupBy(*by, "conf").agg(F.sum(n).cast("long").alias("n"), F.sum(right * n).cast("long").alias("pos"), F.sum((1 - right) * n).cast("long").alias("errors"))


def running(ties: DataFrame, by: list[str], columns: dict[str, str], down: bool = True) -> DataFrame:
    """``ties`` with running sums over the confidences of each group, falling
    or rising: ``columns`` names each sum by its column, and ``<column>_all`` is
    the total. Sums run inside slices of the confidence scale, which get the
    totals of the slices before them, so no task orders a whole group."""
    direction = F.desc_nulls_last if down else F.asc_nulls_last
    sliced = ties.withColumn("slice_", F.coalesce(F.floor(F.col("conf") * SLICES), F.lit(-1)))
    totals = sliced.groupBy(*by, "slice_").agg(*(F.sum(c).alias(f"sum_{c}") for c in columns))
    before = Window.partitionBy(*by).orderBy(F.desc("slice_") if down else F.asc("slice_")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *(F.col(c).alias(f"key_{i}") for i, c in enumerate(by)), F.col("slice_").alias("at_"),
        *(F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in columns), *(F.sum(f"sum_{c}").over(whole).alias(f"{c}_all") for c in columns),
    )
    inside = Window.partitionBy(*by, "slice_").orderBy(direction("conf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = sliced.withColumns({name: F.sum(c).over(inside) for c, name in columns.items()})
    same = F.col("slice_") == F.col("at_")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"key_{i}"))
    joined = part.join(offsets, same).withColumns({name: F.col(name) + F.col(f"before_{c}") for c, name in columns.items()})
    return joined.drop("slice_", "at_", *(f"key_{i}" for i in range(len(by))), *(f"before_{c}" for c in columns))


def cumulated(ties: DataFrame, by: list[str]) -> DataFrame:
    """Tie groups with k, k_pos and k_errors: counts at or above each
    confidence, and totals n_all and errors_all."""
    return running(ties, by, {"n": "k", "pos": "k_pos", "errors": "k_errors"}).drop("pos_all")


def ranked(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Rows with k and k_errors in stable order: confidence falling, then ord,
    and the totals n_all and errors_all of their group."""
    # a slice of one confidence may be cut by ord; a part's place is (slice, part)
    whole = outcomes.withColumn("slice", F.floor(F.col("conf") * SLICES))
    low, high = F.min("ord").cast("double"), F.max("ord").cast("double")
    single = whole.groupBy(*by, "slice").agg(F.min("conf").alias("c0"), F.max("conf").alias("c1"), low.alias("lo_"), ((high - low) / SLICES + 1e-9).alias("width_")).where("c0 = c1").select(*by, "slice", "lo_", "width_")
    cut = F.coalesce(F.floor((F.col("ord") - F.col("lo_")) / F.col("width_")), F.lit(0))
    sliced = whole.join(single, [*by, "slice"], "left").withColumn("part", cut).drop("lo_", "width_")
    totals = sliced.groupBy(*by, "slice", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("correct")).alias("e"))
    every, above = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("slice"), "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "slice", "part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("e").over(above), F.lit(0)).alias("e0"), F.sum("n").over(every).alias("n_all"), F.sum("e").over(every).alias("errors_all"))
    inside = Window.partitionBy(*by, "slice", "part").orderBy(F.desc("conf"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sliced.withColumn("k", F.count(F.lit(1)).over(inside)).withColumn("k_errors", F.sum(1 - F.col("correct")).over(inside))
    return counted.join(offsets, [*by, "slice", "part"]).withColumn("k", F.col("k") + F.col("n0")).withColumn("k_errors", F.col("k_errors") + F.col("e0")).drop("n0", "e0", "slice", "part")


def right_before(outcomes: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """``cuts`` (by, conf, r) with ``right``: how many of the first r rows of
    that confidence, by ord, are right. Rows are counted in parts of the range
    of ord, and only those of the part that a cut falls into are ranked."""
    tie = [*by, "conf"]
    cuts = kept(cuts, "cuts")
    rows = outcomes.select(*tie, "ord", "correct").join(cuts.select(*tie).distinct(), tie)
    low, high = F.min("ord").cast("double"), F.max("ord").cast("double")
    ranges = kept(rows.groupBy(*tie).agg(low.alias("lo_"), ((high - low) / SLICES + 1e-9).alias("width_")), "ranges")
    part = F.coalesce(F.floor((F.col("ord") - F.col("lo_")) / F.col("width_")), F.lit(0)).alias("part")
    parted = outcomes.select(*tie, "ord", "correct").join(ranges, tie).select(*tie, "ord", "correct", part)
    counts = parted.groupBy(*tie, "part").agg(F.count(F.lit(1)).alias("n_"), F.sum("correct").alias("right_"))
    upto = Window.partitionBy(*tie).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.select(*tie, "part", (F.sum("n_").over(upto) - F.col("n_")).alias("n0"), F.sum("n_").over(upto).alias("n1"), (F.sum("right_").over(upto) - F.col("right_")).alias("right0"))
    met = kept(cuts.join(summed, tie).where("n0 < r AND r <= n1"), "met")
    inside = Window.partitionBy(*tie, "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = parted.join(met.select(*tie, "part").distinct(), [*tie, "part"])
    ranks = few.select(*tie, "part", F.count(F.lit(1)).over(inside).alias("k_"), F.sum("correct").over(inside).alias("right_"))
    found = met.withColumn("k_", F.col("r") - F.col("n0")).join(ranks, [*tie, "part", "k_"])
    return found.select(*tie, "r", (F.col("right0") + F.col("right_")).alias("right"))
