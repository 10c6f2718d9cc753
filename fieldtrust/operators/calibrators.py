"""Calibrators as parameter DataFrames: fit gives rows, transform joins them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept
from fieldtrust.operators.calibration_metrics import bin_of
from fieldtrust.operators.prefix import tie_groups

EPS = 1e-7


def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), p))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


# ------------------------------------------------------------- histogram


def fit_histogram(outcomes: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """(by, bin, calibrated): a bin's accuracy, the overall one where it is empty."""
    ties = tie_groups(outcomes, by)
    own = ties.groupBy(*by, bin_of(F.col("conf"), bins).alias("bin")).agg((F.sum("pos") / F.sum("n")).alias("acc"))
    every = ties.groupBy(*by).agg((F.sum("pos") / F.sum("n")).alias("overall")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(own, [*by, "bin"], "left").select(*by, "bin", F.coalesce("acc", "overall").alias("calibrated"))


def apply_histogram(rows: DataFrame, fitted: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """``rows`` with calibrated, null for keys that the fit hasn't seen."""
    return rows.withColumn("bin", bin_of(F.col("conf"), bins)).join(fitted, [*by, "bin"], "left").drop("bin")


# ------------------------------------------------------------- temperature


def fit_temperature(outcomes: DataFrame, by: list[str], steps: int = 41, rounds: int = 3) -> DataFrame:
    """(by, log_t): the logarithm of the temperature in [-4, 4] with the least
    log loss. A grid over the tie groups is refined around its best point."""
    ties = tie_groups(outcomes, by).withColumn("z", logit(F.col("conf")))
    best = ties.select(*by).distinct().withColumn("lo", F.lit(-4.0)).withColumn("hi", F.lit(4.0))
    for _ in range(rounds):
        grid = best.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("log_t", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (steps - 1))
        p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), sigmoid(F.col("z") / F.exp("log_t"))))
        loss = grid.join(ties, by).groupBy(*by, "lo", "hi", "i", "log_t").agg(F.round(F.sum(-(F.col("pos") * F.log(p) + F.col("errors") * F.log(1 - p))), 9).alias("loss"))
        found = loss.groupBy(*by, "lo", "hi").agg(F.min(F.struct("loss", "i", "log_t"))["log_t"].alias("log_t"))
        step = (F.col("hi") - F.col("lo")) / (steps - 1)
        best = found.select(*by, "log_t", F.greatest(F.lit(-4.0), F.col("log_t") - step).alias("lo"), F.least(F.lit(4.0), F.col("log_t") + step).alias("hi"))
    return best.select(*by, "log_t")


def apply_temperature(rows: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with calibrated, null for keys that the fit hasn't seen."""
    return rows.join(fitted, by, "left").withColumn("calibrated", sigmoid(logit(F.col("conf")) / F.exp("log_t"))).drop("log_t")


# ------------------------------------------------------------- learned


def _logistic(rows: DataFrame, features: list[Column], strength: float) -> tuple:
    """Fits on (features, correct) with loss sum + |w|^2 / (2 * strength).
    Rows of equal features are one weighted row, so that the passes of the fit
    don't make the rows again."""
    named = [f.alias(f"f{i}") for i, f in enumerate(features)]
    each = rows.groupBy(*named, F.col("correct").cast("double").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
    data = kept(each, "features")
    n, pos = data.agg(F.sum("n_rows"), F.sum(F.col("label") * F.col("n_rows"))).first()
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features")
    if not n or pos in (0, n):
        return None, assembler, (pos or 0) / n if n else 0.0
    model = LogisticRegression(regParam=1 / (strength * n), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-7, weightCol="n_rows").fit(assembler.transform(data))
    return model, assembler, pos / n


def _predict(rows: DataFrame, fitted: tuple, features: list[Column], output: str, otherwise: Column) -> DataFrame:
    model, assembler, _ = fitted
    if model is None:
        return rows.withColumn(output, otherwise)
    wide = rows
    for i, f in enumerate(features):
        wide = wide.withColumn(f"f{i}", f)
    scored = model.transform(assembler.transform(wide))
    return scored.withColumn(output, vector_to_array("probability")[1]).drop(*(f"f{i}" for i in range(len(features))), "features", "rawPrediction", "probability", "prediction")


def platt(cal: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with calibrated; a calibration set of one class leaves them as they are."""
    z = [logit(F.col("conf"))]
    return _predict(rows, _logistic(cal, z, 1e6), z, "calibrated", F.col("conf"))


def isotonic(cal: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with calibrated by pooled adjacent violators, linear between knots."""
    ties = tie_groups(cal, [])
    model = IsotonicRegression(featuresCol="conf", labelCol="label", weightCol="n").fit(ties.withColumn("label", F.col("pos") / F.col("n")).withColumn("n", F.col("n").cast("double")))
    return model.transform(rows).withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction"))).drop("prediction")


SIGNALS = ("consensus", "grounding", "token_prob", "verbalized")


def learned_features() -> list[Column]:
    """Each signal, or a half, and a flag that it is missing."""
    return [x for s in SIGNALS for x in (F.coalesce(F.col(s), F.lit(0.5)), F.col(s).isNull().cast("double"))]


def learned(cal: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with combined, from a regression over the four signals; with
    one class in the calibration rows, its base rate."""
    fitted = _logistic(cal, learned_features(), 1.0)
    return _predict(rows, fitted, learned_features(), "combined", F.lit(float(fitted[2])))
