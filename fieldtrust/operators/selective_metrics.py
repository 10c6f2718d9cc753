"""Selective-prediction and detection metrics, for any grouping keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.operators.prefix import cumulated, ranked, running, tie_groups


def aurc_family(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """aurc, oracle_aurc, e_aurc and augrc."""
    rows = ranked(outcomes, by).withColumn("pos_all", F.col("n_all") - F.col("errors_all"))
    oracle = F.greatest(F.lit(0), F.col("k") - F.col("pos_all")) / F.col("k")
    return rows.groupBy(*by).agg(
        F.avg(F.col("k_errors") / F.col("k")).alias("aurc"),
        F.avg(oracle).alias("oracle_aurc"),
        F.avg(F.col("k_errors") / F.col("k") - oracle).alias("e_aurc"),
        F.avg(F.col("k_errors") / F.col("n_all")).alias("augrc"),
    )


def rc_curve(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, coverage, risk) after each row, most confident first."""
    rows = ranked(outcomes, by)
    return rows.select(*by, "ord", (F.col("k") / F.col("n_all")).alias("coverage"), (F.col("k_errors") / F.col("k")).alias("risk"))


def coverage_at_risk(outcomes: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """(by, alpha, coverage, threshold): the last confidence at which the risk
    is at most alpha; coverage 0 and a null threshold (review all) without one."""
    grid = cumulated(tie_groups(outcomes, by), by).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    ok = F.col("k_errors") / F.col("k") <= F.col("alpha")
    best = grid.groupBy(*by, "alpha", "n_all").agg(F.max(F.when(ok, F.struct("k", "conf"))).alias("b"))
    return best.select(*by, "alpha", F.coalesce(F.col("b.k") / F.col("n_all"), F.lit(0.0)).alias("coverage"), F.col("b.conf").alias("threshold"))


def risk_at_coverage(outcomes: DataFrame, by: list[str], coverages: list[float]) -> DataFrame:
    """Risk and accuracy of the top ceil(c * n) rows."""
    n = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"))
    cuts = n.withColumn("coverage", F.explode(F.array(*map(F.lit, coverages)))).withColumn("k", F.ceil(F.col("coverage") * F.col("n_all")))
    at = ranked(outcomes, by).join(cuts, [*by, "k"])
    risk = F.col("k_errors") / F.col("k")
    return at.select(*by, "coverage", risk.alias("risk"), (1 - risk).alias("accuracy"))


def detection(outcomes: DataFrame, by: list[str], tpr: float = 0.95) -> DataFrame:
    """auroc, aupr and fpr of finding errors by low confidence; null where
    only one class occurs. Tied confidences count as one step."""
    c = running(tie_groups(outcomes, by), by, {"errors": "tp", "pos": "fp"}, down=False).withColumnsRenamed({"errors_all": "p_all", "pos_all": "n_all"})
    # an error outranks the right values of larger confidence, and half of its tie group's
    wins = F.col("errors") * (F.col("n_all") - F.col("fp") + 0.5 * F.col("pos"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    both = (F.max("p_all") > 0) & (F.max("n_all") > 0)
    return c.groupBy(*by).agg(
        F.when(both, F.sum(wins) / F.max(F.col("p_all") * F.col("n_all"))).alias("auroc"),
        F.when(both, F.sum(precision * F.col("errors")) / F.max("p_all")).alias("aupr"),
        F.when(both, F.min(F.when(F.col("tp") >= tpr * F.col("p_all"), F.col("fp") / F.col("n_all")))).alias("fpr_at_tpr"),
    )


def acceptance(outcomes: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Straight-through rate: share of rows accepted at a threshold."""
    return outcomes.groupBy(*by).agg(F.avg((F.col("conf") >= threshold).cast("double")).alias("accept_rate"))
