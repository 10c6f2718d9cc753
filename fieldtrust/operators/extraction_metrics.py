"""Extraction scoring: joins of predictions with golds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.functions import paths, text


def field_outcomes(predictions: DataFrame, golds: DataFrame, tau: float = 0.5) -> DataFrame:
    """Each prediction with a value: status matched or hallucinated, correct 0/1."""
    preds = predictions.where(F.col("value").isNotNull())
    g = golds.select("doc_id", "path", F.col("value").alias("gold"), "scoring", "numeric_tol", F.lit(True).alias("known"))
    joined = preds.join(g, ["doc_id", "path"], "left")
    right = F.coalesce(text.value_correct(F.col("value"), F.col("gold"), F.col("scoring"), F.col("numeric_tol"), tau), F.lit(False))
    return joined.withColumn("status", F.when(F.col("known"), F.lit("matched")).otherwise(F.lit("hallucinated"))).withColumn("correct", (F.coalesce("known", F.lit(False)) & right).cast("int")).drop("known")


def unique_golds(golds: DataFrame) -> DataFrame:
    """``golds``, failing where a document states one path twice. They are
    counted by the keys that they are joined by, so that it takes no shuffle more."""
    rest = [c for c in golds.columns if c not in ("doc_id", "path")]
    each = golds.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n_"), *(F.first(c).alias(c) for c in rest))
    problem = F.concat(F.lit("a document has several golds of path "), F.col("path"))
    return each.withColumn("path", F.when(F.col("n_") > 1, F.raise_error(problem)).otherwise(F.col("path"))).select(golds.columns)


def omitted(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """Golds without a predicted value."""
    return golds.join(predictions.where(F.col("value").isNotNull()), ["doc_id", "path"], "left_anti")


def hallucinated(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    return predictions.where(F.col("value").isNotNull()).join(golds, ["doc_id", "path"], "left_anti")


def score(predictions: DataFrame, golds: DataFrame, by: list[str], tau: float = 0.5) -> DataFrame:
    """precision, recall, f1, exact_match_rate, omission_rate, hallucination_rate
    for each group ``by`` (doc_id, or none for pooled counts)."""
    # one join tells matched, hallucinated and omitted leaves, so that the predictions are made once
    said = predictions.where(F.col("value").isNotNull()).select("doc_id", "path", "value", F.lit(True).alias("said"))
    known = golds.select("doc_id", "path", F.col("value").alias("gold"), "scoring", "numeric_tol", F.lit(True).alias("known"))
    both = F.col("said").isNotNull() & F.col("known").isNotNull()
    count = lambda c: F.sum((c & both).cast("int"))
    right = F.coalesce(text.value_correct(F.col("value"), F.col("gold"), F.col("scoring"), F.col("numeric_tol"), tau), F.lit(False))
    exact = F.coalesce(text.folded(F.col("value")) == text.folded(F.col("gold")), F.lit(False))
    p = said.join(known, ["doc_id", "path"], "full").groupBy(*by).agg(
        F.count("said").alias("n_pred"), count(right).alias("n_correct"), count(exact).alias("n_exact"),
        F.sum(F.col("known").isNull().cast("int")).alias("n_hallucinated"), F.sum(F.col("said").isNull().cast("int")).alias("n_omitted"),
    )
    g = golds.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gold"))
    joined = g.join(p, by, "full") if by else g.crossJoin(p)  # one row each
    counts = joined.na.fill(0)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    both = F.col("n_pred") + F.col("n_gold")
    return counts.select(
        *by, "n_gold", "n_pred", "n_correct",
        rate("n_correct", "n_pred").alias("precision"), rate("n_correct", "n_gold").alias("recall"),
        F.when(F.col("n_correct") > 0, 2.0 * F.col("n_correct") / both).otherwise(F.lit(0.0)).alias("f1"),
        rate("n_exact", "n_gold").alias("exact_match_rate"), rate("n_omitted", "n_gold").alias("omission_rate"), rate("n_hallucinated", "n_pred").alias("hallucination_rate"),
    )


def macro(scores: DataFrame) -> DataFrame:
    """Mean over documents of their rates."""
    return scores.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "exact_match_rate", "omission_rate", "hallucination_rate")))


def _leaves(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """(doc_id, prefix, rel, idx, theirs, value, form, scoring, numeric_tol) of
    both sides' array leaves, dealt out by document: what follows for a
    document's arrays needs no other shuffle. Paths are read and values folded
    once a leaf, not once a pair."""
    # a generator is evaluated once, where a filter on the split path would split it again
    part = lambda df, *columns: df.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.array_compact(F.array(paths.split_index(F.col("path"))))).alias("s"), *columns)
    mine = part(predictions, "value", F.lit(False).alias("theirs"), F.lit(None).cast("string").alias("scoring"), F.lit(None).cast("double").alias("numeric_tol"))
    theirs = part(golds, "value", F.lit(True).alias("theirs"), "scoring", F.col("numeric_tol").cast("double").alias("numeric_tol"))
    every = mine.unionByName(theirs).select("doc_id", "s.prefix", "s.rel", "s.idx", "theirs", "value", text.folded(F.col("value")).alias("form"), "scoring", "numeric_tol")
    return every.repartition("doc_id")


def _similar(leaves: DataFrame, tau: float) -> DataFrame:
    item = Window.partitionBy("doc_id", "prefix", "theirs", "idx")
    sized = leaves.withColumn("n_", F.size(F.collect_set("rel").over(item)))
    of = lambda side, *columns: F.collect_list(F.when(side, F.struct("idx", "n_", "value", "form", *columns)))
    met = sized.groupBy("doc_id", "prefix", "rel").agg(of(~F.col("theirs")).alias("p"), of(F.col("theirs"), "scoring", "numeric_tol").alias("g"))
    pairs = met.select("doc_id", "prefix", F.explode("p").alias("p"), "g").select("doc_id", "prefix", "p", F.explode("g").alias("g"))
    right = text.value_correct(F.col("p.value"), F.col("g.value"), F.col("g.scoring"), F.col("g.numeric_tol"), tau, (F.col("p.form"), F.col("g.form"))).cast("int")
    keys = ["doc_id", "prefix", F.col("p.idx").alias("i"), F.col("g.idx").alias("j")]
    found = pairs.groupBy(*keys).agg(F.sum(right).alias("matches"), F.count(F.lit(1)).alias("shared"), F.first("p.n_").alias("np"), F.first("g.n_").alias("ng"))
    return found.where("matches > 0").select("doc_id", "prefix", "i", "j", (F.col("matches") / (F.col("np") + F.col("ng") - F.col("shared"))).alias("sim"))


def item_similarity(predictions: DataFrame, golds: DataFrame, tau: float = 0.5) -> DataFrame:
    """(doc_id, prefix, i, j, sim): array items by the share of leaves that
    match, over the union of their leaves."""
    return _similar(_leaves(predictions, golds), tau)


def aligned(predictions: DataFrame, golds: DataFrame, tau: float = 0.5) -> DataFrame:
    """``predictions`` whose array items carry the index of the gold item they
    are greedily paired with, most similar first; items without a partner get
    indices above the golds'."""
    leaves = _leaves(predictions, golds)
    none = lambda kind: F.lit(None).cast(kind)
    # an item on its own, and its pairs; the other side only tells its largest index
    items = leaves.groupBy("doc_id", "prefix", "idx", "theirs").agg(F.lit(1)).select(
        "doc_id", "prefix", F.when(~F.col("theirs"), F.col("idx")).alias("i"), none("int").alias("j"), none("double").alias("sim"), F.when(F.col("theirs"), F.col("idx")).alias("top")
    )
    rows = items.unionByName(_similar(leaves, tau).withColumn("top", none("int")))

    # a greedy choice depends on the choices before it: one array of pairs for each (document, prefix), in Arrow batches
    @F.pandas_udf("array<struct<i: int, target: int>>")
    def assign(groups: pd.Series, tops: pd.Series) -> pd.Series:
        out = []
        for pairs, top in zip(groups, tops.fillna(-1), strict=True):
            target: dict[int, int] = {}
            taken: set[int] = set()
            for _, i, j in sorted((-r["sim"], r["i"], r["j"]) for r in pairs if r["j"] is not None):
                if i not in target and j not in taken:
                    target[i] = j
                    taken.add(j)
            free = int(top) + 1
            for i in sorted({r["i"] for r in pairs} - target.keys()):
                target[i], free = free, free + 1
            out.append([{"i": i, "target": t} for i, t in target.items()])
        return pd.Series(out)

    grouped = rows.groupBy("doc_id", "prefix").agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "j", "sim"))).alias("g"), F.max("top").alias("top"))
    moves = grouped.select("doc_id", "prefix", F.explode(assign("g", "top")).alias("m")).select("doc_id", "prefix", "m.i", "m.target")
    split = predictions.withColumn("s_", paths.split_index(F.col("path"))).withColumn("prefix", F.col("s_.prefix")).withColumn("i", F.col("s_.idx"))
    joined = split.join(moves, ["doc_id", "prefix", "i"], "left")
    return joined.withColumn("path", F.when(F.col("target").isNotNull(), paths.join_index(F.col("prefix"), F.col("target"), F.col("s_.rel"))).otherwise(F.col("path"))).select(predictions.columns)
