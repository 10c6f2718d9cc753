"""Grounding metrics of rows with pred and gold boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.boxes import gold_iou


def box_metrics(rows: DataFrame, by: list[str], taus: tuple[float, ...] = (0.5, 0.7)) -> DataFrame:
    """acc_<tau> over gold-boxed rows, mean_iou over rows with both; 0 without any."""
    r = rows.withColumn("i", gold_iou(F.col("pred"), F.col("gold")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    acc = [zero(F.avg((F.col("i") >= t).cast("double"))).alias(f"acc_{int(t * 100)}") for t in taus]
    return r.groupBy(*by).agg(*acc, zero(F.avg(F.when(F.col("pred").isNotNull(), F.col("i")))).alias("mean_iou"))


def grounding_gap(rows: DataFrame, by: list[str], tau: float = 0.5) -> DataFrame:
    """Accuracy of rows grounded on the gold box against the others, and the gap."""
    r = rows.where(F.col("gold").isNotNull()).withColumn("hit", gold_iou(F.col("pred"), F.col("gold")) >= tau)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    on, off = zero(F.avg(F.when(F.col("hit"), F.col("correct").cast("double")))), zero(F.avg(F.when(~F.col("hit"), F.col("correct").cast("double"))))
    return r.groupBy(*by).agg(on.alias("grounded_accuracy"), off.alias("ungrounded_accuracy"), (on - off).alias("gap"), F.sum(F.col("hit").cast("int")).alias("n_grounded"), F.sum((~F.col("hit")).cast("int")).alias("n_ungrounded"))
