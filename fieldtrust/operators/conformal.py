"""Conformal abstention: pooled, grouped, taxonomies and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept
from fieldtrust.functions.text import loose_number
from fieldtrust.operators.prefix import cumulated, tie_groups, times
from fieldtrust.operators.resampling import uniform
from fieldtrust.operators.selective_metrics import detection

# ------------------------------------------------------------- taxonomies


def grounded_group(support: Column) -> Column:
    return F.when(support >= 0.5, F.lit("grounded")).otherwise(F.lit("ungrounded"))


def support_bin_group(support: Column) -> Column:
    return F.when(support.isNull(), F.lit("ungrounded")).when(support < 0.5, F.lit("supp0")).when(support < 0.8, F.lit("supp1")).otherwise(F.lit("supp2"))


def value_length_group(value: Column) -> Column:
    n = F.char_length(F.coalesce(value, F.lit("")))
    return F.when(n < 3, F.lit("len0")).when(n < 8, F.lit("len1")).otherwise(F.lit("len2"))


def field_type_group(value: Column) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), F.lit("empty")).when(loose_number(value).isNotNull(), F.lit("numeric")).otherwise(F.lit("text"))


def combined_group(*groups: Column) -> Column:
    return F.concat_ws("|", *groups)


def taxonomies(value: Column, support: Column) -> dict[str, Column]:
    """The catalogue, in order of preference on ties."""
    grounded, bins, length, kind = grounded_group(support), support_bin_group(support), value_length_group(value), field_type_group(value)
    return {
        "grounded": grounded,
        "support_bin": bins,
        "value_length": length,
        "field_type": kind,
        "grounded_x_length": combined_group(grounded, length),
        "support_x_type": combined_group(bins, kind),
    }


def by_taxonomy(outcomes: DataFrame, value: str = "value", support: str = "support") -> DataFrame:
    """Each row once for each taxonomy: columns taxonomy, rank and grp."""
    every = [F.struct(F.lit(i).alias("rank"), F.lit(k).alias("taxonomy"), g.alias("grp")) for i, (k, g) in enumerate(taxonomies(F.col(value), F.col(support)).items())]
    return outcomes.withColumn("t", F.explode(F.array(*every))).select("*", "t.rank", "t.taxonomy", "t.grp").drop("t")


def taxonomy_counts(outcomes: DataFrame, by: list[str], value: str = "value", support: str = "support") -> DataFrame:
    """(by, conf, correct, n_rows, rank, taxonomy, grp): rows are counted by all
    their groups at once, and only the counts are repeated for each taxonomy."""
    named = taxonomies(F.col(value), F.col(support))
    counts = outcomes.groupBy(*by, "conf", "correct", *(g.alias(f"in_{k}") for k, g in named.items())).agg(F.count(F.lit(1)).alias("n_rows"))
    every = [F.struct(F.lit(i).alias("rank"), F.lit(k).alias("taxonomy"), F.col(f"in_{k}").alias("grp")) for i, k in enumerate(named)]
    return counts.withColumn("each_", F.explode(F.array(*every))).select(*by, "conf", "correct", "n_rows", "each_.*")


# ------------------------------------------------------------- thresholds


def thresholds(outcomes: DataFrame, by: list[str], alphas: list[float], empirical: bool = False) -> DataFrame:
    """(by, alpha, threshold, abstention): the smallest confidence at which
    (errors + 1) / (accepted + 1), or the plain risk, is at most alpha. The
    threshold is null, and all is reviewed, where there is none."""
    grid = cumulated(tie_groups(outcomes, by), by).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    bound = F.col("k_errors") / F.col("k") if empirical else (F.col("k_errors") + 1) / (F.col("k") + 1)
    best = grid.groupBy(*by, "alpha", "n_all").agg(F.min(F.when(bound <= F.col("alpha"), F.struct("conf", "k"))).alias("b"))
    return best.select(*by, "alpha", F.col("b.conf").alias("threshold"), (1 - F.coalesce(F.col("b.k") / F.col("n_all"), F.lit(0.0))).alias("abstention"))


def policies(cal: DataFrame, by: list[str], alphas: list[float], method: str = "conformal") -> DataFrame:
    """(by, alpha, threshold, method, expected_coverage): operating points for
    target risks, with the finite-sample correction (conformal) or without
    (empirical); the coverage is that of the calibration rows."""
    if method not in ("conformal", "empirical"):
        raise ValueError(f"unknown method {method!r}; known: conformal, empirical")
    found = thresholds(cal, by, alphas, empirical=method == "empirical")
    return found.select(*by, "alpha", "threshold", F.lit(method).alias("method"), (1 - F.col("abstention")).alias("expected_coverage"))


def grouped_thresholds(cal: DataFrame, by: list[str], group: str, alphas: list[float]) -> DataFrame:
    """Thresholds of each group, and pooled ones under a null group."""
    own = thresholds(cal, [*by, group], alphas)
    return own.unionByName(thresholds(cal, by, alphas).withColumn(group, F.lit(None).cast("string")))


def apply_thresholds(test: DataFrame, fitted: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """``test`` for each alpha with ``accept``; keys without a threshold are reviewed."""
    each = test.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    return each.join(fitted, [*by, "alpha"], "left").withColumn("accept", F.coalesce(F.col("conf") >= F.col("threshold"), F.lit(False)))


def apply_grouped(test: DataFrame, fitted: DataFrame, by: list[str], group: str, alphas: list[float], pooled_fallback: bool = True) -> DataFrame:
    """``test`` for each alpha with ``accept``. A group that was not seen takes
    the pooled threshold, or is reviewed without the fallback; so are keys
    without any threshold."""
    own = fitted.where(F.col(group).isNotNull()).select(*by, group, "alpha", F.col("threshold").alias("t_own"), F.lit(True).alias("seen"))
    pooled = fitted.where(F.col(group).isNull()).select(*by, "alpha", F.col("threshold").alias("t_pooled"))
    each = test.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    both = each.join(pooled, [*by, "alpha"], "left").join(own, [*by, group, "alpha"], "left")
    fallback = F.col("t_pooled") if pooled_fallback else F.lit(None).cast("double")
    threshold = F.when(F.coalesce("seen", F.lit(False)), F.col("t_own")).otherwise(fallback)
    return both.withColumn("accept", F.coalesce(F.col("conf") >= threshold, F.lit(False))).drop("t_own", "t_pooled", "seen")


def coverage_and_risk(accepted: DataFrame, by: list[str]) -> DataFrame:
    rows = times(accepted)
    n = F.sum(F.col("accept").cast("int") * rows)
    wrong = F.sum((F.col("accept") & (F.col("correct") == 0)).cast("int") * rows)
    return accepted.groupBy(*by).agg((n / F.sum(rows)).alias("coverage"), F.when(n > 0, wrong / n).otherwise(F.lit(0.0)).alias("risk"))


def ablation(cal: DataFrame, test: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """(by, taxonomy, alpha, coverage, risk) of every taxonomy, and pooled."""
    keys = [*by, "taxonomy"]
    fitted = grouped_thresholds(taxonomy_counts(cal, by), keys, "grp", alphas)
    grouped = coverage_and_risk(apply_grouped(taxonomy_counts(test, by), fitted, keys, "grp", alphas), [*keys, "alpha"])
    counts = test.groupBy(*by, "conf", "correct").agg(F.count(F.lit(1)).alias("n_rows"))
    pooled = apply_thresholds(counts, thresholds(cal, by, alphas), by, alphas)
    return grouped.unionByName(coverage_and_risk(pooled, [*by, "alpha"]).withColumn("taxonomy", F.lit("pooled")))


def select_taxonomy(select: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """(by, alpha, taxonomy, coverage): largest in-sample coverage on the
    selection split, the first of the catalogue on ties."""
    keys = [*by, "taxonomy", "rank"]
    rows = taxonomy_counts(select, by)
    fitted = grouped_thresholds(rows, keys, "grp", alphas)
    found = coverage_and_risk(apply_grouped(rows, fitted, keys, "grp", alphas), [*keys, "alpha"])
    best = found.groupBy(*by, "alpha").agg(F.max(F.struct("coverage", (-F.col("rank")).alias("order"), "taxonomy")).alias("b"))
    return best.select(*by, "alpha", "b.taxonomy", "b.coverage")


def _halved(cal: DataFrame, by: list[str], group: Column, halvings: int) -> DataFrame:
    """(by, grp, conf, correct, n_rows, fit_h): rows only add to counts, in all
    and of the fitted half of each halving by a hash of doc_id."""
    fit = [F.sum((uniform(F.col("doc_id"), F.lit(h)) < 0.5).cast("long")).alias(f"fit_{h}") for h in range(halvings)]
    return kept(cal.withColumn("grp", group).groupBy(*by, "grp", "conf", "correct").agg(F.count(F.lit(1)).alias("n_rows"), *fit), "halves")


def _gain(counts: DataFrame, by: list[str], alpha: float, halvings: int) -> DataFrame:
    keys = [*by, "h"]
    halved = counts.select(*by, "grp", "conf", "correct", "n_rows", F.posexplode(F.array(*(f"fit_{h}" for h in range(halvings)))).alias("h", "fit_"))
    half = lambda n: halved.select(*keys, "grp", "conf", "correct", n.alias("n_rows")).where("n_rows > 0")
    fitted = grouped_thresholds(half(F.col("fit_")), keys, "grp", [alpha])
    held = half(F.col("n_rows") - F.col("fit_"))
    grouped = coverage_and_risk(apply_grouped(held, fitted, keys, "grp", [alpha]), keys).select(*keys, F.col("coverage").alias("g"))
    pooled = apply_thresholds(held, fitted.where(F.col("grp").isNull()).select(*keys, "alpha", "threshold"), keys, [alpha])
    both = coverage_and_risk(pooled, keys).select(*keys, F.col("coverage").alias("p")).join(grouped, keys)
    return both.groupBy(*by).agg(F.avg(F.col("g") - F.col("p")).alias("gain"))


def coverage_gain(cal: DataFrame, by: list[str], group: Column, alpha: float, halvings: int = 5) -> DataFrame:
    """(by, gain): mean coverage of grouped less pooled thresholds on the held
    half of random halvings of the calibration rows by a hash of doc_id."""
    return _gain(_halved(cal, by, group, halvings), by, alpha, halvings)


def characterize(cal: DataFrame, by: list[str], group: Column, alpha: float = 0.05, min_gain: float = 0.02, halvings: int = 5) -> DataFrame:
    """error_separation, within_group_auroc, min_group_size, predicted_gain,
    recommend, all of them from one count of the rows."""
    rows = _halved(cal, by, group, halvings)
    n = F.sum("n_rows")
    sizes = rows.groupBy(*by, "grp").agg(n.alias("n"), (F.sum((1.0 - F.col("correct")) * F.col("n_rows")) / n).alias("error"))
    auroc = detection(rows, [*by, "grp"]).select(*by, "grp", "auroc")
    joined = sizes.join(auroc, [*by, "grp"]).withColumn("auroc", F.when(F.col("n") >= 4, F.col("auroc")))
    out = joined.groupBy(*by).agg(
        (F.max("error") - F.min("error")).alias("error_separation"), F.coalesce(F.avg("auroc"), F.lit(0.5)).alias("within_group_auroc"), F.min("n").alias("min_group_size")
    )
    gain = _gain(rows, by, alpha, halvings).withColumnRenamed("gain", "predicted_gain")
    return out.join(gain, by).withColumn("recommend", F.col("predicted_gain") >= min_gain)


def decide(rows: DataFrame, threshold: Column | float, value: str = "value", conf: str = "conf") -> DataFrame:
    """accept where a value stands and its confidence reaches the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    ok = F.col(value).isNotNull() & F.coalesce(F.col(conf) >= t, F.lit(False))
    return rows.withColumn("decision", F.when(ok, F.lit("accept")).otherwise(F.lit("review")))
