"""Inter-annotator agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa_of(po: Column, pe: Column) -> Column:
    """(po - pe) / (1 - pe); with pe 1, 1 if all agree, else 0."""
    return F.when(pe >= 1.0, (po >= 1.0).cast("double")).otherwise((po - pe) / (1.0 - pe))


def cohen(annotations: DataFrame) -> DataFrame:
    """(a, b, n, kappa) of each pair of annotators, over items both labelled."""
    left = annotations.select(F.col("annotator").alias("a"), "field_id", F.col("label").alias("x"))
    right = annotations.select(F.col("annotator").alias("b"), "field_id", F.col("label").alias("y"))
    both = left.join(right, "field_id").where("a < b")
    cells = both.groupBy("a", "b", "x", "y").count()
    totals = cells.groupBy("a", "b").agg(F.sum("count").alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("count")).otherwise(0)) / F.sum("count")).alias("po"))
    xs = cells.groupBy("a", "b", F.col("x").alias("k")).agg(F.sum("count").alias("nx"))
    ys = cells.groupBy("a", "b", F.col("y").alias("k")).agg(F.sum("count").alias("ny"))
    chance = xs.join(ys, ["a", "b", "k"]).groupBy("a", "b").agg(F.sum(F.col("nx") * F.col("ny")).alias("s"))
    joined = totals.join(chance, ["a", "b"], "left")
    pe = F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return joined.select("a", "b", "n", kappa_of(F.col("po"), pe).alias("kappa"))


def fleiss(annotations: DataFrame) -> DataFrame:
    """(n_items, n_raters, kappa) over the items that every annotator labelled."""
    raters = annotations.select("annotator").distinct().agg(F.count(F.lit(1)).alias("r"))
    per = annotations.groupBy("field_id", "label").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("annotator").alias("d"))
    items = per.groupBy("field_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).join(F.broadcast(raters), F.col("m") == F.col("r"))  # one row
    agree = items.agg(F.count(F.lit(1)).alias("n_items"), F.max("r").alias("n_raters"), F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("po"))
    shares = per.join(items.select("field_id"), "field_id", "left_semi").groupBy("label").agg(F.sum("c").alias("c"))
    pe = shares.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("pe"))
    return agree.crossJoin(pe).select("n_items", "n_raters", kappa_of(F.col("po"), F.col("pe")).alias("kappa"))  # one row each


def report(annotations: DataFrame) -> DataFrame:
    """(kind, a, b, n, kappa, band): every pair of annotators, the mean of the
    pairs, and all annotators together."""
    none = F.lit(None).cast("string")
    pairs = cohen(annotations).select(F.lit("pair").alias("kind"), "a", "b", "n", "kappa")
    mean = pairs.agg(F.sum("n").alias("n"), F.avg("kappa").alias("kappa")).select(F.lit("pairs").alias("kind"), none.alias("a"), none.alias("b"), "n", "kappa")
    whole = fleiss(annotations).select(F.lit("all").alias("kind"), none.alias("a"), none.alias("b"), F.col("n_items").alias("n"), "kappa")
    return pairs.unionByName(mean).unionByName(whole).withColumn("band", interpret(F.col("kappa")))


def interpret(kappa: Column) -> Column:
    """The published bands of agreement."""
    return (
        F.when(kappa < 0.0, F.lit("poor")).when(kappa <= 0.2, F.lit("slight")).when(kappa <= 0.4, F.lit("fair")).when(kappa <= 0.6, F.lit("moderate")).when(kappa <= 0.8, F.lit("substantial")).otherwise(F.lit("almost perfect"))
    )
