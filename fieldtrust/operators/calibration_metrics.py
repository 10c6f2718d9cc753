"""Calibration metrics of (conf, correct) rows, for any grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept
from fieldtrust.operators.prefix import cumulated, right_before, running, tie_groups


def edges(bins: int) -> list[float]:
    """Inner borders of equal bins, as multiples of the step."""
    step = 1.0 / bins
    return [i * step for i in range(1, bins)]


def bin_of(conf: Column, bins: int) -> Column:
    """Bin of (lo, hi]; 0 is in the first."""
    step = 1.0 / bins
    guess = F.least(F.lit(bins - 1), F.greatest(F.lit(0), (F.ceil(conf * bins) - 1).cast("int")))
    # the edges are multiples of a rounded step: one of them may lie on the other side of the guess
    low = F.when((guess > 0) & ~(guess * F.lit(step) < conf), guess - 1).otherwise(guess)
    return F.coalesce(F.when((low < bins - 1) & ((low + 1) * F.lit(step) < conf), low + 1).otherwise(low), F.lit(0))


def reliability_bins(outcomes: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """(by, bin, mean_confidence, accuracy, count) of the bins with rows."""
    ties = tie_groups(outcomes, by).withColumn("bin", bin_of(F.col("conf"), bins))
    return ties.groupBy(*by, "bin").agg(
        (F.sum(F.col("conf") * F.col("n")) / F.sum("n")).alias("mean_confidence"), (F.sum("pos") / F.sum("n")).alias("accuracy"), F.sum("n").alias("count")
    )


def ece_mce(outcomes: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    b = reliability_bins(outcomes, by, bins)
    return b.groupBy(*by).agg((F.sum(gap * F.col("count")) / F.sum("count")).alias("ece"), F.max(gap).alias("mce"))


def adaptive_ece(outcomes: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Equal-mass bins in order of confidence, then ord, the first ones a row
    larger. A tie group inside one bin only gives its counts; where a bin's
    border cuts it, the right rows before the border are found by ``right_before``."""
    ties = kept(tie_groups(outcomes, by), "ties")
    size, large = F.floor(F.col("n_all") / bins), F.col("n_all") % bins
    # the bin of a row by its place from 0, and a bin's first place
    chunk = lambda at: F.when(at < large * (size + 1), F.floor(at / (size + 1))).otherwise(large + F.floor((at - large * (size + 1)) / F.greatest(size, F.lit(1))))
    first = lambda c: c * size + F.least(c, large)
    below = F.col("n_all") - F.col("k")
    placed = cumulated(ties, by).where("conf IS NOT NULL").select(*by, "conf", "n", "pos", "n_all", below.alias("lo"), chunk(below).alias("c0"), chunk(below + F.col("n") - 1).alias("c1"))
    whole = placed.where("c0 = c1").select(*by, "n_all", F.col("c0").alias("chunk"), (F.col("pos") - F.col("conf") * F.col("n")).alias("g"))
    cut = placed.where("c0 < c1").withColumn("chunk", F.explode(F.sequence("c0", "c1")))
    start, end = F.greatest(F.lit(0), first(F.col("chunk")) - F.col("lo")), F.least(F.col("n"), first(F.col("chunk") + 1) - F.col("lo"))
    cut = cut.withColumn("start", start.cast("long")).withColumn("end", end.cast("long"))
    before = right_before(outcomes, cut.where("start > 0").select(*by, "conf", F.col("start").alias("r")), by)
    at = lambda r: before.select(*by, "conf", F.col("r").alias(r), F.col("right").alias(f"right_{r}"))
    joined = cut.join(at("start"), [*by, "conf", "start"], "left").join(at("end"), [*by, "conf", "end"], "left")
    right = F.coalesce("right_end", "pos") - F.coalesce("right_start", F.lit(0))
    parts = joined.select(*by, "n_all", "chunk", (right - F.col("conf") * (F.col("end") - F.col("start"))).alias("g"))
    return whole.unionByName(parts).groupBy(*by, "chunk", "n_all").agg(F.abs(F.sum("g")).alias("g")).groupBy(*by).agg((F.sum("g") / F.max("n_all")).alias("adaptive_ece"))


def proper_scores(outcomes: DataFrame, by: list[str], eps: float = 1e-12) -> DataFrame:
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col("conf")))
    y = F.col("correct")
    return outcomes.groupBy(*by).agg(F.avg((F.col("conf") - y) * (F.col("conf") - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("nll"))


#: Smooth ece: points of one bandwidth, and bandwidths beyond which the kernel
#: counts as zero (there it is under 2e-14 of its height).
PER_WIDTH, REACH = 64, 8


def smooth_ece(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Gaussian-kernel calibration error. Confidences closer than a
    ``PER_WIDTH``-th of the bandwidth h are one point, at their mean; exact where
    distinct confidences lie further apart, else off by at most 0.04 (a value
    moves by under h / 64, and the smoothed residual changes by at most 2.4 a
    bandwidth). A point meets the points within ``REACH`` bandwidths, found by
    blocks of that width: rows grow with the points, which the bandwidth bounds
    (some 64 / h), not with pairs of rows."""
    ties = tie_groups(outcomes, by).where(F.col("conf").isNotNull())
    total = ties.groupBy(*by).agg(F.sum("n").alias("n_all"))
    sized = total.withColumn("h", F.greatest(F.lit(1e-3), 0.15 * F.pow(F.col("n_all").cast("double"), F.lit(-0.2))))
    joined = ties.join(sized, by) if by else ties.crossJoin(sized)  # one row without keys
    keys = [*by, "n_all", "h"]
    point = F.floor(F.col("conf") / F.col("h") * PER_WIDTH)
    moved = F.when(F.min("conf") == F.max("conf"), F.min("conf")).otherwise(F.sum(F.col("conf") * F.col("n")) / F.sum("n"))
    points = joined.groupBy(*keys, point.alias("point")).agg(moved.alias("c"), F.sum("n").alias("m"), F.sum(F.col("pos") - F.col("conf") * F.col("n")).alias("r"))
    points = points.withColumn("block", F.floor(F.col("point") / (PER_WIDTH * REACH)))
    # both sides of a block's border
    near = points.select(*by, F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("r").alias("r2"), F.explode(F.array(*(F.col("block") + i for i in (-1, 0, 1)))).alias("block"))
    d = (F.col("c") - F.col("c2")) / F.col("h")
    w = F.exp(-0.5 * d * d)
    smooth = points.join(near, [*by, "block"]).groupBy(*keys, "c", "m").agg((F.sum(w * F.col("r2")) / F.sum(w * F.col("m2"))).alias("rhat"))
    return smooth.groupBy(*by).agg((F.sum(F.abs("rhat") * F.col("m")) / F.max("n_all")).alias("smooth_ece"))


def tce(outcomes: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """Threshold calibration error: thresholds from the predicted risk, the
    mean distance of the achieved risk from each alpha."""
    ties = tie_groups(outcomes, by)
    doubted = ties.withColumn("risk_", (1 - F.col("conf")) * F.col("n"))
    c = running(doubted, by, {"n": "k", "errors": "k_errors", "risk_": "doubts"}).withColumn("doubt", F.col("doubts") / F.col("k"))
    grid = c.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    last = grid.groupBy(*by, "alpha").agg(F.max(F.when(F.col("doubt") <= F.col("alpha"), F.struct("k", "k_errors"))).alias("b"))
    achieved = F.coalesce(F.col("b.k_errors") / F.col("b.k"), F.lit(0.0))
    return last.groupBy(*by).agg(F.avg(F.abs(achieved - F.col("alpha"))).alias("tce"))
