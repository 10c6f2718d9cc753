"""Logistic fusion of signals for many keys at once.

A fit is Newton's method on sums: each round joins the keys' coefficients to the
rows, adds up the gradient and the curvature (outer products of the features)
for each key with map-side combining, and solves the small systems in Arrow
batches, a row a key. No key's rows meet in one task, and the number of keys
(folds, signals, taxonomies) isn't bounded by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept
from fieldtrust.operators.prefix import times

#: Newton rounds; the loss is convex and rounds converge quadratically.
ROUNDS = 10


def _dot(weights: Column, features: Sequence[Column]) -> Column:
    """The bias, first of the weights, plus the weighted features."""
    total = F.get(weights, F.lit(0))
    for i, f in enumerate(features, 1):
        total = total + F.get(weights, F.lit(i)) * f
    return total


def fit_logistic(rows: DataFrame, by: list[str], features: list[str], strength: float = 1.0, rounds: int = ROUNDS, label: str = "correct") -> DataFrame:
    """(by, weights, base_rate) of each key: bias and weights that minimise the
    log loss summed over rows plus the squared weights over 2 * ``strength``
    (the bias is free). ``n_rows`` counts repeat rows; features that are null
    are zero. ``weights`` are null for a key with rows of one class only."""
    n, y = times(rows).cast("double"), F.col(label).cast("double")
    named = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
    # equal rows are one cell
    cells = kept(rows.select(*by, *named, y.alias("y"), n.alias("m")).groupBy(*by, *(f"x{i}" for i in range(len(features))), "y").agg(F.sum("m").alias("m")), "cells")
    size = len(features) + 1
    x = [F.lit(1.0), *(F.col(f"x{i}") for i in range(len(features)))]
    current = cells.groupBy(*by).agg((F.sum(F.col("y") * F.col("m")) / F.sum("m")).alias("base_rate")).withColumn("w", F.array_repeat(F.lit(0.0), size))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    @F.pandas_udf("array<double>")
    def solved(w: pd.Series, gradient: pd.Series, curvature: pd.Series) -> pd.Series:
        out = []
        ridge = np.full(size, 1.0 / strength)
        ridge[0] = 0.0
        for w0, g0, c0 in zip(w, gradient, curvature, strict=True):
            h = np.zeros((size, size))
            for (i, j), c in zip(pairs, c0, strict=True):
                h[i, j] = h[j, i] = c
            at = np.asarray(w0, float)
            step = np.linalg.lstsq(h + np.diag(ridge + 1e-12), np.asarray(g0, float) - ridge * at, rcond=None)[0]
            out.append(at + step * min(1.0, 8.0 / max(1e-12, float(np.abs(step).max()))))
        return pd.Series(out)

    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-_dot(F.col("w"), x[1:])))
        joined = cells.join(current, by) if by else cells.crossJoin(current)  # one row without keys
        joined = joined.withColumn("d", F.col("m") * (F.col("y") - p)).withColumn("c", F.col("m") * p * (1 - p))
        sums = joined.groupBy(*by, "base_rate", "w").agg(
            F.array(*(F.sum(F.col("d") * x[i]) for i in range(size))).alias("g"), F.array(*(F.sum(F.col("c") * x[i] * x[j]) for i, j in pairs)).alias("h")
        )
        current = sums.select(*by, "base_rate", solved("w", "g", "h").alias("w"))
    both = (F.col("base_rate") > 0) & (F.col("base_rate") < 1)
    return current.select(*by, F.when(both, F.col("w")).alias("weights"), "base_rate")


def apply_logistic(rows: DataFrame, fitted: DataFrame, by: list[str], features: list[str], output: str = "fused") -> DataFrame:
    """``rows`` with the fitted chance: the base rate where a key's rows were of
    one class, null for keys that the fit hasn't seen."""
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    joined = rows.join(fitted, by, "left") if by else rows.crossJoin(fitted)  # one row without keys
    return joined.withColumn(output, F.coalesce(1.0 / (1.0 + F.exp(-_dot(F.col("weights"), x))), F.col("base_rate"))).drop("weights", "base_rate")


def quantile_cuts(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles, linear between neighbours, without a global sort: a
    sketch brackets each one, counts below the brackets and the distinct values
    inside them say where it lies."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return []
    places = [q * (n - 1) for q in shares]
    error = 1 / 1000
    low = [max(0.0, q - 2 * error) for q in shares]
    high = [min(1.0, q + 2 * error) for q in shares]
    ends = rows.agg(F.percentile_approx(column, F.array(*map(F.lit, low + high)), F.lit(int(1 / error)))).first()[0]
    value = F.col(column)
    out = []
    for i, place in enumerate(places):
        a, b = (ends[i] if low[i] > 0 else float("-inf")), (ends[len(shares) + i] if high[i] < 1 else float("inf"))
        below = rows.where(value < a).count()
        inside = rows.where((value >= a) & (value <= b)).groupBy(column).count().orderBy(column)
        # the values inside a bracket are a few thousandths of the distinct ones; sums run over those alone
        ranked = inside.selectExpr(column, "sum(count) over (order by " + column + ") as upto")
        k = int(place)
        first = ranked.where(F.col("upto") > k - below).agg(F.min(column)).first()[0]
        second = ranked.where(F.col("upto") > min(k + 1, n - 1) - below).agg(F.min(column)).first()[0]
        out.append(float(first) + (place - k) * (float(second) - float(first)))
    return out
