"""The composed verification plan and its loops, over all documents at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept
from fieldtrust.operators import ground, signals
from fieldtrust.operators.conformal import decide
from fieldtrust.operators.extract import infer_schema, text_search
from fieldtrust.sources.ingest import page_texts


def verify(documents: DataFrame, leaves: DataFrame, extract: Callable = text_search, threshold: float = 0.8, runs: int = 1, calibrate: Callable | None = None, penalty: str = "uniform", fuzzy: bool = True) -> DataFrame:
    """(doc_id, path, value, support, page, bbox, agreement, confidence,
    decision): extract, vote, ground, fuse, calibrate, decide."""
    preds = extract(documents, leaves)
    if runs > 1:
        preds = signals.consensus(preds, runs)
    else:
        preds = preds.withColumn("agreement", F.lit(None).cast("double"))
    extra = [c for c in ("token_prob", "verbalized") if c in preds.columns]
    grounded = ground.ground(preds.select("doc_id", "path", "value", "agreement", *extra), page_texts(documents), mode=penalty, use_fuzzy=fuzzy)
    support = F.when(F.col("value").isNotNull(), F.coalesce("support", F.lit(0.0)))
    fused = signals.combined({"consensus": F.col("agreement"), "grounding": support} | {c: F.col(c) for c in extra})
    rows = grounded.withColumn("confidence", F.coalesce(fused, F.lit(0.5)))
    if calibrate:
        rows = calibrate(rows)
    return decide(rows, threshold, conf="confidence").select("doc_id", "path", "value", "support", "page", "bbox", "agreement", "confidence", "decision")


def verify_auto(documents: DataFrame, threshold: float = 0.8, propose: Callable[[DataFrame], DataFrame] = infer_schema, **settings) -> DataFrame:
    """Verification of each document against a schema proposed from its own
    text; ``propose`` gives leaves with their doc_id."""
    return verify(documents, propose(documents), threshold=threshold, **settings)


def repair(base: DataFrame, tiers: list[Callable[[DataFrame], DataFrame]], require_grounded: bool = True, costs: list[int] | None = None) -> DataFrame:
    """``base`` decisions with fields under review replaced by the first tier
    that accepts them (and grounds them). A tier sees only the documents that
    still have such fields, and is not asked once none is left. With ``costs``,
    the extractor calls of the base and of each tier, ``calls`` says how many
    each row's document took."""
    columns = base.columns
    if costs:
        base = base.withColumn("calls", F.lit(costs[0]))
    current = base.withColumn("tier", F.lit(0))
    for n, tier in enumerate(tiers, 1):
        # what the tiers before have decided is read three times
        current = kept(current, "decisions")
        if current.where("decision = 'review'").isEmpty():
            break
        open_docs = current.where("decision = 'review'").select("doc_id").distinct()
        if costs:
            paid = open_docs.withColumn("paid_", F.lit(costs[n]))
            current = current.join(paid, "doc_id", "left").withColumn("calls", F.col("calls") + F.coalesce("paid_", F.lit(0))).drop("paid_")
        good = tier(open_docs).where(F.col("decision") == "accept").where(F.col("value").isNotNull())
        good = good.where(F.col("support").isNotNull()) if require_grounded else good
        better = good.select("doc_id", "path", F.struct(*(c for c in columns if c not in ("doc_id", "path"))).alias("better"))
        joined = current.join(better, ["doc_id", "path"], "left")
        take = (F.col("decision") == "review") & F.col("better").isNotNull()
        chosen = [F.when(take, F.col(f"better.{c}")).otherwise(F.col(c)).alias(c) for c in columns if c not in ("doc_id", "path")]
        current = joined.select("doc_id", "path", *chosen, *(["calls"] if costs else []), F.when(take, F.lit(n)).otherwise(F.col("tier")).alias("tier"))
    return current


def resolve(repaired: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Answers (doc_id, path, resolved) for fields still under review."""
    joined = repaired.join(resolutions.select("doc_id", "path", "resolved"), ["doc_id", "path"], "left")
    take = (F.col("decision") == "review") & F.col("resolved").isNotNull()
    outcome = F.when(take, F.lit("human_resolved")).when(F.col("decision") == "review", F.lit("escalated")).when(F.col("tier") > 0, F.lit("repaired")).otherwise(F.lit("accepted"))
    return joined.select(
        "*", outcome.alias("outcome"), F.when(take, F.col("resolved")).otherwise(F.col("value")).alias("final_value"), F.when(take, F.lit("accept")).otherwise(F.col("decision")).alias("final_decision")
    ).drop("resolved")


def ensemble(extractions: DataFrame, extractors: int, threshold: float = 0.8, require_grounded: bool = False) -> DataFrame:
    """Adjudicated extractors with decisions."""
    return decide(signals.adjudicate(extractions, extractors, require_grounded), threshold, conf="confidence")


def summary(decisions: DataFrame) -> DataFrame:
    """(doc_id, n_fields, n_accepted, n_review, n_grounded, mean_confidence)
    for each document, and in total under a null doc_id."""
    accepted = (F.col("decision") == "accept").cast("int")
    return decisions.rollup("doc_id").agg(
        F.count(F.lit(1)).alias("n_fields"), F.sum(accepted).alias("n_accepted"), F.sum(1 - accepted).alias("n_review"), F.sum(F.col("support").isNotNull().cast("int")).alias("n_grounded"), F.avg("confidence").alias("mean_confidence")
    )
