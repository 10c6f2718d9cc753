"""The evaluation harness: extractor runs to outcomes of each signal, and the
grid of signals x calibrators x alphas as grouped queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept
from fieldtrust.operators import calibration_metrics as cm
from fieldtrust.operators import calibrators, conformal, extraction_metrics, fusion, grounding_metrics, selective_metrics, signals
from fieldtrust.operators.resampling import uniform

#: Slots of the hash scale in which keys are counted for an exact split.
SLOTS = 1 << 16
#: Random halvings whose sides one number holds.
SIDES = 60
#: The signals of a run and of the vote of all runs.
RUN_SIGNALS, VOTE_SIGNALS = ("token_prob", "verbalized", "grounding"), ("consensus", "combined")


def disjoint(a: DataFrame, b: DataFrame, key: str = "doc_id") -> None:
    """Raises if the splits share keys."""
    shared = [str(r[0]) for r in a.select(key).intersect(b.select(key)).limit(5).collect()]
    if shared:
        raise ValueError(f"splits share documents: {', '.join(shared)}")


def split_documents(documents: DataFrame, fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """``documents`` with split cal or test by a hash of doc_id."""
    return documents.withColumn("split", F.when(uniform(F.lit(seed), F.col("doc_id")) < fraction, F.lit("cal")).otherwise(F.lit("test")))


def exact_split(documents: DataFrame, fraction: float = 0.5, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """``documents`` with split cal or test: of the n different keys, exactly
    round(fraction * n), and at least one on each side, are cal, those that hash
    lowest. Keys are counted in ``SLOTS`` slots of the hash scale; only those
    of the slot with the border are ranked. Null keys are test."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie between 0 and 1")
    u = uniform(F.lit(seed), F.col(key))
    keys = documents.select(key).where(F.col(key).isNotNull()).distinct().withColumn("u", u).withColumn("slot", F.floor(F.col("u") * SLOTS))
    counts = sorted((r["slot"], r["count"]) for r in keys.groupBy("slot").count().collect())  # at most SLOTS rows
    n = sum(c for _, c in counts)
    if n < 2:
        raise ValueError("a split needs at least two different keys")
    wanted, border = max(1, min(n - 1, round(fraction * n))), -1
    for slot, count in counts:
        if wanted <= count:
            border = slot
            break
        wanted -= count
    ranked = keys.where(F.col("slot") == border).selectExpr(f"`{key}`", f"row_number() over (order by u, `{key}`) as n")
    low = ranked.where(F.col("n") <= wanted).select(key, F.lit(True).alias("low_"))
    cal = (F.floor(u * SLOTS) < border) | F.coalesce("low_", F.lit(False))
    return documents.join(low, key, "left").withColumn("split", F.when(F.coalesce(cal, F.lit(False)), F.lit("cal")).otherwise(F.lit("test"))).drop("low_")


def signal_outcomes(predictions: DataFrame, golds: DataFrame, runs: int, tau: float = 0.5) -> DataFrame:
    """(doc_id, path, ord, value, support, status, correct, signal, conf): each
    predicted value once for each signal. The first run's values have its token
    probability, stated confidence (a half where there is none, or zero) and
    grounding; the vote of ``runs`` runs has its agreement and the fusion of
    all. ``predictions`` are grounded: (doc_id, run, ord, path, value, support)
    and, where extractors give them, token_prob and verbalized."""
    given = [c for c in ("token_prob", "verbalized") if c in predictions.columns]
    base = predictions.withColumns({c: F.lit(None).cast("double") for c in ("token_prob", "verbalized") if c not in given})
    rows = signals.tallied(base, runs, ["token_prob", "verbalized"])
    # a path's rows are gathered once, for its first run and its vote; both meet their gold in one join
    kind = base.schema["ord"].dataType.simpleString()
    kind = kind if kind == "bigint" else "int"
    columns = ("value", "support", "token_prob", "verbalized")
    row = lambda x, place, agreement: F.struct(x[place].cast(kind).alias("ord"), *(x[c].alias(c) for c in columns), agreement.cast("double").alias("agreement"))
    first = F.transform(F.filter("rows", lambda x: x["run"] == 0), lambda x: row(x, "ord", F.lit(None)))
    vote = F.array(row(F.col("vote"), "first_ord", F.col("vote.agreement")))
    both = rows.select("doc_id", "path", F.explode(F.concat(first, vote)).alias("p")).select("doc_id", "path", "p.*")
    known, half = signals.grounding(F.col("support")), lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0.5))
    fused = signals.combined({"consensus": F.col("agreement"), "grounding": known, "token_prob": F.col("token_prob"), "verbalized": F.col("verbalized")})
    each = lambda names, confs: F.array(*(F.struct(F.lit(n).alias("signal"), c.cast("double").alias("conf")) for n, c in zip(names, confs, strict=True)))
    stands = F.when(F.col("agreement").isNull(), each(RUN_SIGNALS, (half("token_prob"), half("verbalized"), known))).otherwise(each(VOTE_SIGNALS, (F.col("agreement"), fused)))
    outcomes = extraction_metrics.field_outcomes(both, golds, tau)
    return outcomes.select("doc_id", "path", "ord", "value", "support", "status", "correct", F.explode(stands).alias("s")).select("*", "s.*").drop("s")


def calibrated_rows(cal: DataFrame, test: DataFrame) -> DataFrame:
    """(signal, calibrator, conf, correct, ord) of the test rows: raw, and by each calibrator."""
    by, columns = ["signal"], ["signal", "ord", "correct"]
    logit = lambda rows: rows.withColumn("z", calibrators.logit(F.col("conf")))
    platt = fusion.apply_logistic(logit(test), fusion.fit_logistic(logit(cal), by, ["z"], 1e6), by, ["z"], "platt_")
    found = {
        "raw": test.withColumn("calibrated", F.col("conf")),
        "histogram": calibrators.apply_histogram(test, calibrators.fit_histogram(cal, by), by),
        "temperature": calibrators.apply_temperature(test, calibrators.fit_temperature(cal, by), by),
        "platt": platt.withColumn("calibrated", F.col("platt_")),
    }
    every = [rows.select(*columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")).alias("conf"), F.lit(name).alias("calibrator")) for name, rows in found.items()]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def run(predictions: DataFrame, golds: DataFrame, runs: int, alphas: list[float], fraction: float = 0.5, seed: int = 0) -> dict[str, DataFrame]:
    """The harness from extractor runs to its seven tables and the summary.
    ``predictions`` as ``signal_outcomes`` takes them, with bbox where gold
    boxes (gold_box of ``golds``) are to be compared. ``ord`` orders rows of one
    confidence, so it should differ from row to row of a signal."""
    golds = extraction_metrics.unique_golds(golds)
    rows = kept(exact_split(kept(signal_outcomes(predictions, golds, runs), "outcomes"), fraction, seed), "outcomes")
    cal, test, by = rows.where("split = 'cal'"), rows.where("split = 'test'"), ["signal"]
    every = calibrated_rows(cal, test)
    keys = ["signal", "calibrator"]
    calibration = cm.ece_mce(every, keys).join(cm.adaptive_ece(every, keys), keys).join(cm.smooth_ece(every, keys), keys).join(cm.proper_scores(every, keys), keys)
    at = selective_metrics.coverage_at_risk(test, by, alphas).groupBy(*by).pivot("alpha", alphas).agg(F.first("coverage"))
    at = at.select(*by, *(F.col(f"`{a}`").alias(f"coverage_{round(a * 100)}") for a in alphas))
    selective = selective_metrics.aurc_family(test, by).join(selective_metrics.detection(test, by).select("signal", "auroc"), by).join(at, by)
    tested = conformal.apply_thresholds(test, conformal.thresholds(cal, by, alphas), by, alphas)
    held = (F.col("risk") <= F.col("alpha") + 1e-9).alias("guarantee_held")
    conform = conformal.coverage_and_risk(tested, [*by, "alpha"]).join(conformal.thresholds(cal, by, alphas), [*by, "alpha"]).select("*", held)
    extraction = extraction_metrics.macro(extraction_metrics.score(predictions.where("run = 0"), golds, ["doc_id"]))
    both = lambda df: df.where("signal = 'combined'").withColumn("grp", conformal.grounded_group(F.col("support")))
    fitted = conformal.grouped_thresholds(both(cal), [], "grp", alphas)
    own = conformal.coverage_and_risk(conformal.apply_grouped(both(test), fitted, [], "grp", alphas), ["alpha"]).withColumn("method", F.lit("grounded-group"))
    one = conformal.coverage_and_risk(conformal.apply_thresholds(both(test), fitted.where("grp IS NULL").drop("grp"), [], alphas), ["alpha"]).withColumn("method", F.lit("marginal"))
    grouped = one.unionByName(own).join(one.select("alpha", F.col("coverage").alias("base")), "alpha")
    grouped = grouped.select("method", "alpha", "coverage", "risk", held, (F.col("coverage") - F.col("base")).alias("gain"))
    ablation = conformal.ablation(cal.where("signal = 'combined'"), test.where("signal = 'combined'"), by, alphas)
    out = {"extraction": extraction, "calibration": calibration, "selective": selective, "conformal": conform, "grouped": grouped, "ablation": ablation}
    if "bbox" in predictions.columns and "gold_box" in golds.columns:
        voted = signals.consensus(predictions, runs, ["bbox"]).withColumnRenamed("first_ord", "ord")
        boxed = extraction_metrics.field_outcomes(voted, golds).join(golds.select("doc_id", "path", F.col("gold_box").alias("gold_at")), ["doc_id", "path"], "left")
        boxed = boxed.select("correct", F.col("bbox").alias("pred"), F.col("gold_at").alias("gold"))
        out["grounding"] = grounding_metrics.box_metrics(boxed, []).crossJoin(grounding_metrics.grounding_gap(boxed, []))  # one row each
    return out


def summary(tables: dict[str, DataFrame], dataset: str, extractor: str, alpha: float) -> DataFrame:
    """One row of a run's headline figures, as ``ranking`` takes them: the
    scores of the extraction, the auroc of the signal with the best coverage at
    ``alpha``, the least ece over signals and calibrators, the grounding gap."""
    cover = f"coverage_{round(alpha * 100)}"
    first = tables["selective"].agg(F.min_by("auroc", F.struct(-F.col(cover), "signal")).alias("best_AUROC"))
    least = tables["calibration"].agg(F.min("ece").alias("ECE"))
    gap = tables["grounding"].select(F.col("gap").alias("grounding_gap")) if "grounding" in tables else least.select(F.lit(0.0).alias("grounding_gap"))
    named = tables["extraction"].select(F.lit(dataset).alias("dataset"), F.lit(extractor).alias("extractor"), F.col("f1").alias("F1"), F.col("exact_match_rate").alias("exact"), F.col("hallucination_rate").alias("halluc"))
    return named.crossJoin(first).crossJoin(gap).crossJoin(least)  # one row each


def ranking(summaries: DataFrame, by: str = "best_AUROC") -> DataFrame:
    """Runs by a column, the largest first; figures rounded for reading."""
    places = {"F1": 3, "exact": 3, "halluc": 3, "best_AUROC": 3, "grounding_gap": 3, "ECE": 4}
    rounded = {c: F.round(F.coalesce(F.col(c), F.lit(0.0)), n) for c, n in places.items()}
    return summaries.withColumns(rounded).select("dataset", "extractor", *places).orderBy(F.desc(by), "dataset", "extractor")


def calibration_table(cal: DataFrame, test: DataFrame) -> DataFrame:
    """(signal, calibrator, ece, mce, brier, nll) raw, by histogram and by temperature."""
    by = ["signal"]
    raw = test.select("signal", "conf", "correct").withColumn("calibrator", F.lit("none"))
    hist = calibrators.apply_histogram(test, calibrators.fit_histogram(cal, by), by).select("signal", F.col("calibrated").alias("conf"), "correct").withColumn("calibrator", F.lit("histogram"))
    temp = calibrators.apply_temperature(test, calibrators.fit_temperature(cal, by), by).select("signal", F.col("calibrated").alias("conf"), "correct").withColumn("calibrator", F.lit("temperature"))
    every, keys = raw.unionByName(hist).unionByName(temp), ["signal", "calibrator"]
    return cm.ece_mce(every, keys).join(cm.proper_scores(every, keys), keys)


def leaderboard(cal: DataFrame, test: DataFrame, alphas: list[float]) -> DataFrame:
    """(signal, auroc, e_aurc, ece, coverage, risk, guarantee_held) for each
    alpha, by thresholds fitted on the calibration split, best auroc first."""
    by = ["signal"]
    fitted = conformal.thresholds(cal, by, alphas)
    accepted = conformal.apply_thresholds(test, fitted, by, alphas)
    held = conformal.coverage_and_risk(accepted, ["signal", "alpha"])
    scores = selective_metrics.detection(test, by).select("signal", "auroc").join(selective_metrics.aurc_family(test, by).select("signal", "e_aurc"), by).join(cm.ece_mce(test, by).select("signal", "ece"), by)
    out = held.join(scores, by).withColumn("guarantee_held", F.col("risk") <= F.col("alpha") + 1e-9)
    return out.orderBy(F.desc("auroc"), "signal", "alpha")


def multi_split(outcomes: DataFrame, by: list[str], alphas: list[float], splits: int = 40) -> DataFrame:
    """(by, alpha, coverage, risk): means over random halvings of the documents,
    all of them in one job; a split is a key like any other."""
    # a document's sides of all splits are one number each, drawn once a document; rows only add to counts
    words = range(0, splits, SIDES)
    side = lambda s: F.when(uniform(F.col("key_"), F.lit(s)) < 0.5, F.lit(1 << (s % SIDES))).otherwise(F.lit(0)).cast("long")
    drawn = [reduce(Column.__add__, map(side, range(at, min(splits, at + SIDES)))).alias(f"sides_{at}") for at in words]
    docs = outcomes.select(F.col("doc_id").alias("key_")).distinct().select("key_", *drawn)
    rows = outcomes.select("doc_id", *by, "conf", "correct").join(docs, F.col("doc_id").eqNullSafe(F.col("key_")))
    fit = [F.sum(F.shiftright(F.col(f"sides_{s - s % SIDES}"), s % SIDES).bitwiseAND(F.lit(1).cast("long"))).alias(f"fit_{s}") for s in range(splits)]
    counts = rows.groupBy(*by, "conf", "correct").agg(F.count(F.lit(1)).alias("n_"), *fit)
    each = F.posexplode(F.array(*(F.col(f"fit_{s}") for s in range(splits)))).alias("s", "fit_")
    counts = kept(counts.select(*by, "conf", "correct", "n_", each), "splits")
    sides = lambda n: counts.select(*by, "conf", "correct", "s", n.alias("n_rows")).where("n_rows > 0")
    fitted = conformal.thresholds(sides(F.col("fit_")), [*by, "s"], alphas)
    test = conformal.apply_thresholds(sides(F.col("n_") - F.col("fit_")), fitted, [*by, "s"], alphas)
    each = conformal.coverage_and_risk(test, [*by, "s", "alpha"])
    return each.groupBy(*by, "alpha").agg(F.avg("coverage").alias("coverage"), F.avg("risk").alias("risk"))


def best(table: DataFrame, metric: str, name: str, smallest: bool = True) -> DataFrame:
    """The row with the best metric; names break ties."""
    order = F.struct(F.col(metric) if smallest else -F.col(metric), name)
    return table.agg(F.min_by(name, order).alias(name), (F.min(metric) if smallest else F.max(metric)).alias(metric))
