"""Confidence signals, voting over runs and fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.text import folded

OMIT = "<omit>"
#: The default weights of the fused signals.
WEIGHTS = {"consensus": 0.5, "grounding": 0.3, "token_prob": 0.1, "verbalized": 0.1}


def unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def token_prob(logprobs: Column, how: str = "mean") -> Column:
    """exp of the mean, least or summed log-probability; null without any."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x)
    z = {"mean": total / F.size(logprobs), "min": F.array_min(logprobs), "prod": total}[how]
    return F.when(F.size(logprobs) > 0, unit(F.exp(z)))


def verbalized(c: Column) -> Column:
    return F.when(c.isNotNull(), unit(c))


def grounding(support: Column, floor: float = 0.0) -> Column:
    return F.coalesce(support, F.lit(floor))


def overwrite(confidence: Column, signal: Column) -> Column:
    """A signal in the place of the confidence, where it exists."""
    return F.coalesce(signal, confidence)


def combined(signals: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the signals that exist; null if none does."""
    if unknown := set(signals) - set(weights):
        raise ValueError(f"unknown signals: {sorted(unknown)}")
    zero = F.lit(0.0)
    top = bottom = zero
    for name, c in signals.items():
        top = top + F.when(c.isNotNull(), c * weights[name]).otherwise(zero)
        bottom = bottom + F.when(c.isNotNull(), F.lit(weights[name])).otherwise(zero)
    return F.when(bottom > 0, unit(top / bottom))


def _runs(predictions: DataFrame, runs: int, taken: Sequence[str]) -> DataFrame:
    """(doc_id, path, rows, cast): a path's rows of the first ``runs`` runs in
    order of run and ord, and the last of each run. They meet in one aggregate."""
    vote = F.coalesce(folded(F.col("value")), F.lit(OMIT)).alias("vote")
    row = F.struct(F.col("run").cast("int").alias("run"), F.col("ord").cast("long").alias("ord"), vote, *taken)
    used = F.when((F.col("run") >= 0) & (F.col("run") < runs), row)
    rows = predictions.groupBy("doc_id", "path").agg(F.sort_array(F.collect_list(used)).alias("rows"))
    return rows.withColumn("cast", F.filter("rows", lambda x, i: F.coalesce(F.get("rows", i + 1)["run"] != x["run"], F.lit(True))))


def _most(cast: Column, runs: int) -> Column:
    """struct<n, place>: the votes of the modal vote of ``runs`` runs, and the
    first run that has it, negated. A run that isn't cast votes to omit."""
    votes, silent = cast["vote"], F.lit(runs) - F.size(cast)
    having = lambda v: F.size(votes) - F.size(F.array_remove(votes, v))
    said = F.transform(cast, lambda x: F.struct((having(x["vote"]) + F.when(x["vote"] == OMIT, silent).otherwise(0)).alias("n"), (-x["run"]).alias("place")))
    lacking = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(runs - 1)), cast["run"]))
    unsaid = F.when(silent > 0, F.struct((having(F.lit(OMIT)) + silent).alias("n"), (-lacking).alias("place")))
    return F.greatest(F.array_max(said), unsaid)


def tallied(predictions: DataFrame, runs: int, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, path, rows, vote): the rows of each path, and its consensus as
    a struct of the columns of ``consensus``. The struct comes from a
    generator: no filter on it is moved below its steps."""
    taken = ["value", *(c for c in ("support", *keep) if c in predictions.columns)]
    used = predictions.where((F.col("run") >= 0) & (F.col("run") < runs))
    rows = _runs(used, runs, taken).withColumn("best", _most(F.col("cast"), runs))
    chosen = F.get("cast", F.array_position(F.col("cast.run"), -F.col("best.place")).cast("int") - 1)
    rows = rows.withColumn("first", chosen).withColumn("first", F.when(F.col("first.vote") != OMIT, F.col("first")))
    own = [F.col(f"first.{c}").alias(c) for c in taken]
    if "support" not in taken:
        own.append(F.lit(None).cast("double").alias("support"))
    seen = F.col("rows")[0]
    vote = F.struct(*own, (F.col("best.n") / runs).alias("agreement"), F.col("best.n").cast("long").alias("n_votes"), seen["run"].alias("first_run"), seen["ord"].cast("int").alias("first_ord"))
    return rows.select("doc_id", "path", "rows", F.explode(F.array(vote)).alias("vote"))


def consensus(predictions: DataFrame, runs: int, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, path, value, support, agreement, n_votes, first_run, first_ord,
    and ``keep``): the modal vote of each path, the first seen on ties. A run
    that lacks a path, or has no value for it, votes to omit; a won omit is a
    null value. The last row of a (run, path) counts; value, support and
    ``keep`` are those of the first run with the modal vote. A path's rows meet
    in one aggregate, and its at most ``runs`` votes are counted inside the row."""
    return tallied(predictions, runs, keep).select("doc_id", "path", "vote.*")


def adaptive_consensus(predictions: DataFrame, threshold: float = 0.5, margin: float = 0.25, k_min: int = 2, k_max: int = 5, budget: int | None = None) -> DataFrame:
    """(doc_id, k): runs drawn before every path's agreement is clear of the
    threshold by more than the margin. Consensus over each prefix of the runs
    decides which documents could stop there; a path's rows are gathered once
    for all prefixes, and so are a document's paths."""
    top = min(k_max, budget) if budget else k_max
    low = min(k_min, top)
    ks = range(low, top)
    if not ks:
        return predictions.select("doc_id").distinct().withColumn("k", F.lit(top))
    rows = _runs(predictions, top - 1, ())
    before = lambda k: F.filter("cast", lambda x: x["run"] < k).alias(f"cast_{k}")
    rows = rows.select("doc_id", *map(before, ks))
    close = lambda k: F.abs(_most(F.col(f"cast_{k}"), k)["n"] / k - threshold) <= margin
    # a path that no run of the prefix has says nothing, nor does a row without a document
    opened = [F.max((F.col("doc_id").isNotNull() & (F.size(f"cast_{k}") > 0) & close(k)).cast("int")).alias(f"open_{k}") for k in ks]
    docs = rows.groupBy("doc_id").agg(*opened)
    return docs.select("doc_id", F.coalesce(*(F.when(F.coalesce(F.col(f"open_{k}"), F.lit(0)) == 0, F.lit(k)) for k in ks), F.lit(top)).alias("k"))


def adjudicate(predictions: DataFrame, extractors: int, require_grounded: bool = False) -> DataFrame:
    """Fuses extractors (column run) into one prediction for each path: modal
    folded value, ties by the best support; value and support of the best
    supported agreeing extractor; confidence of agreement and support."""
    rows = predictions.where(F.col("value").isNotNull()).withColumn("vote", folded(F.col("value")))
    s = F.coalesce("support", F.lit(0.0))
    each = rows.groupBy("doc_id", "path", "vote").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(s.alias("s"), (-F.col("run")).alias("r"), "value", "support")).alias("best"), F.min("run").alias("first")
    )
    final = each.groupBy("doc_id", "path").agg(
        F.max(F.struct("n", F.col("best.s").alias("s"), (-F.col("first")).alias("f"), "vote", "best")).alias("w"), F.sort_array(F.collect_set("vote")).alias("all_votes"), F.count(F.lit(1)).alias("n_values")
    )
    agreement = F.col("w.n") / extractors
    fused = combined({"consensus": agreement, "grounding": F.col("w.best.support")})
    confidence = F.when(F.col("w.best.support").isNull(), F.lit(0.0)).otherwise(fused) if require_grounded else fused
    return final.select(
        "doc_id",
        "path",
        F.col("w.best.value").alias("value"),
        F.col("w.best.support").alias("support"),
        agreement.alias("agreement"),
        confidence.alias("confidence"),
        F.array_except("all_votes", F.array("w.vote")).alias("dissent"),
    )
