"""The per-field dump of signals, its backfill, and the study that reads it.

A dump is a Parquet table partitioned by ``schema_version`` and ``part`` (a hash
of the document), one row for each scored field. It is written once by
``dump``; ``backfill`` adds scores of a slow model later, part by part, and can
be stopped and run again. ``study`` fits a fusion for each of many halvings of
the documents and reports coverage and risk of single signals, of the fusion,
and of the taxonomy that a held-out part of the calibration documents selects.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions.store import kept
from fieldtrust.operators import conformal, fusion
from fieldtrust.operators.extraction_metrics import field_outcomes
from fieldtrust.operators.resampling import uniform
from fieldtrust.operators.signals import consensus

SCHEMA_VERSION = 1
#: The signals of a dump, and the verbalized confidence of a field that states none.
SIGNALS = ("verbalized", "consistency", "support", "grounded", "entailment")
UNSTATED = 0.9
#: Partitions of a dump; a backfill rewrites those that lack scores.
PARTS = 64
#: Random halvings whose sides one number holds.
SIDES = 60


# ------------------------------------------------------------- dump


def fields(predictions: DataFrame, golds: DataFrame, runs: int) -> DataFrame:
    """(doc_id, path, value, verbalized, consistency, support, grounded,
    correct, entailment): a row for each value of the consensus; entailment is
    null until a model has scored it, and 0 for values that aren't grounded."""
    voted = consensus(predictions, runs, [c for c in ("verbalized",) if c in predictions.columns])
    said = F.col("verbalized") if "verbalized" in voted.columns else F.lit(None).cast("double")
    grounded = F.col("support").isNotNull()
    return field_outcomes(voted, golds).select(
        "doc_id", "path", "value", F.coalesce(said, F.lit(UNSTATED)).alias("verbalized"), F.col("agreement").alias("consistency"),
        F.coalesce("support", F.lit(0.0)).alias("support"), grounded.cast("int").alias("grounded"), "correct",
        F.when(~grounded, F.lit(0.0)).alias("entailment"),
    )


def part_of(key: str = "doc_id", parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def dump(rows: DataFrame, path: str, parts: int = PARTS) -> None:
    """Writes ``rows`` (as ``fields`` gives them) with their schema version."""
    out = rows.withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("part", part_of(parts=parts))
    out.repartition("part").write.mode("overwrite").partitionBy("schema_version", "part").parquet(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest schema version that this library reads."""
    rows = spark.read.parquet(path).where(F.col("schema_version") == SCHEMA_VERSION)
    return rows.drop("schema_version", "part")


def backfill(spark: SparkSession, path: str, premises: DataFrame, scorer: Callable[[Column, Column], Column], parts: int = PARTS) -> int:
    """Scores the grounded fields of a dump that have no entailment yet, and
    returns how many there were. ``premises`` (doc_id, path, premise,
    hypothesis) say what is held against what, and fields without a premise
    get 0. Parts are rewritten whole, each by itself, after their scores are
    computed, and stay beside the dump (``<path>.next``) until the next backfill
    of that part; a part that is complete isn't read again, so a run that ends
    half-way is finished by the next, and running twice changes nothing."""
    every = spark.read.parquet(path).where(F.col("schema_version") == SCHEMA_VERSION)
    columns = every.columns
    lacking = [r["part"] for r in every.where(F.col("entailment").isNull()).select("part").distinct().orderBy("part").collect()]  # at most ``parts``
    total = 0
    for part in lacking:
        rows = spark.read.parquet(path).where((F.col("schema_version") == SCHEMA_VERSION) & (F.col("part") == part))
        scored = rows.where(F.col("entailment").isNull()).select("doc_id", "path").join(premises, ["doc_id", "path"])
        scored = scored.groupBy("doc_id", "path").agg(F.max(F.struct("premise", "hypothesis")).alias("p"))  # one a field
        scored = scored.select("doc_id", "path", scorer(F.col("p.premise"), F.col("p.hypothesis")).alias("score"))
        done = rows.join(scored, ["doc_id", "path"], "left").withColumn("entailment", F.coalesce("entailment", "score", F.lit(0.0)))
        # the new part stands beside the dump before it takes the old one's place
        beside = f"{path.rstrip('/')}.next/part={part}"
        total += rows.where(F.col("entailment").isNull()).count()
        done.select([c for c in columns if c not in ("schema_version", "part")]).write.mode("overwrite").parquet(beside)
        fresh = spark.read.parquet(beside).withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("part", F.lit(part))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema_version", "part").parquet(path)
    return total


# ------------------------------------------------------------- study


def binned(column: str, cuts: Sequence[float]) -> Column:
    """How many of the cuts a value reaches."""
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col(column) >= c).cast("int")
    return at


def taxonomies(rows: DataFrame) -> dict[str, Column]:
    """The study's groupings, by quantiles of all rows; in order of preference."""
    middle = {c: fusion.quantile_cuts(rows, c, [0.5]) for c in ("verbalized", "entailment")}
    thirds = fusion.quantile_cuts(rows, "support", [0.34, 0.67])
    g = F.col("grounded").cast("int")
    verb, supp, entail = binned("verbalized", middle["verbalized"]), binned("support", thirds), binned("entailment", middle["entailment"])
    found = {"pooled": F.lit(0), "grounded": g, "grounded x verb": g * 2 + verb, "grounded x support": g * 3 + supp, "grounded x entail": g * 2 + entail, "support x verb": supp * 2 + verb}
    return {k: c.cast("string") for k, c in found.items()}


def _in_groups(rows: DataFrame, named: Sequence[str]) -> DataFrame:
    """Each count once for each taxonomy: columns rank, taxonomy and grp."""
    every = [F.struct(F.lit(i).alias("rank"), F.lit(k).alias("taxonomy"), F.col(f"in_{i}").alias("grp")) for i, k in enumerate(named)]
    return rows.withColumn("each_", F.explode(F.array(*every))).select("*", "each_.*").drop("each_", *(f"in_{i}" for i in range(len(named))))


def grouped_results(fit: DataFrame, held: DataFrame, by: list[str], alphas: list[float]) -> DataFrame:
    """(by, alpha, coverage, risk) on ``held`` by thresholds of each ``grp`` of
    ``fit``. A group that the fit hasn't seen is reviewed."""
    fitted = conformal.thresholds(fit, [*by, "grp"], alphas)
    return conformal.coverage_and_risk(conformal.apply_thresholds(held, fitted, [*by, "grp"], alphas), [*by, "alpha"])


def select_bounded(fit: DataFrame, held: DataFrame, by: list[str], alphas: list[float], fallback: str = "pooled") -> DataFrame:
    """(by, alpha, taxonomy, coverage, risk): of the taxonomies whose risk on
    the held-out part of the calibration rows is at most alpha, the one that
    covers most of it, the first of the catalogue on ties; ``fallback`` (with
    null figures) where none holds. Both tables have rank, taxonomy and grp."""
    found = grouped_results(fit, held, [*by, "rank", "taxonomy"], alphas)
    holds = (F.col("risk") <= F.col("alpha")) & (F.col("coverage") > 0)
    best = found.groupBy(*by, "alpha").agg(F.max(F.when(holds, F.struct("coverage", (-F.col("rank")).alias("order"), "taxonomy", "risk"))).alias("b"))
    return best.select(*by, "alpha", F.coalesce("b.taxonomy", F.lit(fallback)).alias("taxonomy"), F.col("b.coverage").alias("coverage"), F.col("b.risk").alias("risk"))


def _sides(limit: float, at: int, splits: int) -> Column:
    """The splits from ``at`` in which a document's draw is under the limit, a bit each."""
    bit = lambda s: F.when(uniform(F.col("key_"), F.lit(s)) < limit, F.lit(1 << (s - at))).otherwise(F.lit(0)).cast("long")
    return reduce(Column.__add__, map(bit, range(at, min(splits, at + SIDES))))


def study(rows: DataFrame, alphas: list[float], splits: int = 40) -> DataFrame:
    """(alpha, score, taxonomy, coverage, risk, held, lift): means over random
    halvings of the documents, for the scores verbalized, support and fusion,
    each taxonomy, and the fusion with the taxonomy selected (SELECTED)."""
    rows = kept(rows.select("doc_id", *SIGNALS, "correct"), "fields")
    named = taxonomies(rows)
    signals = list(SIGNALS)
    # rows only add to counts of each split, which alone are repeated; a document's sides are drawn once
    drawn = [_sides(limit, at, splits).alias(f"{name}_{at}") for name, limit in (("fit", 0.25), ("cal", 0.5)) for at in range(0, splits, SIDES)]
    docs = rows.select(F.col("doc_id").alias("key_")).distinct().select("key_", *drawn)
    on = lambda name, s: F.sum(F.shiftright(F.col(f"{name}_{s - s % SIDES}"), s % SIDES).bitwiseAND(F.lit(1).cast("long")))
    cell = [*signals, "correct", *(c.alias(f"in_{i}") for i, c in enumerate(named.values()))]
    counts = rows.join(docs, F.col("doc_id").eqNullSafe(F.col("key_"))).groupBy(*cell).agg(F.count(F.lit(1)).alias("n_"), *(on(name, s).alias(f"{name}_of_{s}") for name in ("fit", "cal") for s in range(splits)))
    cells = [*signals, "correct", *(f"in_{i}" for i in range(len(named)))]
    each = F.array(*(F.struct(F.col(f"fit_of_{s}").alias("fit"), F.col(f"cal_of_{s}").alias("cal")) for s in range(splits)))
    # calibration documents are halved again for the selection
    role = lambda name, n: F.struct(F.lit(name).alias("role"), n.alias("n_rows"))
    roles = F.array(role("fit", F.col("c.fit")), role("select", F.col("c.cal") - F.col("c.fit")), role("test", F.col("n_") - F.col("c.cal")))
    halved = kept(counts.select(*cells, "n_", F.posexplode(each).alias("s", "c")).select(*cells, "s", F.explode(roles).alias("r")).select(*cells, "s", "r.*").where("n_rows > 0"), "halved")
    fitted = fusion.fit_logistic(halved.where("role <> 'test'"), ["s"], signals)
    fused = fusion.apply_logistic(halved, fitted, ["s"], signals, "fusion")
    scores = F.array(*(F.struct(F.lit(n).alias("score"), F.col(n).cast("double").alias("conf")) for n in ("verbalized", "support", "fusion")))
    scored = fused.withColumn("c", F.explode(scores)).select("s", "role", "correct", "n_rows", "c.*", *(f"in_{i}" for i in range(len(named))))
    scored = scored.groupBy("s", "role", "score", "conf", "correct", *(f"in_{i}" for i in range(len(named)))).agg(F.sum("n_rows").alias("n_rows"))
    grouped = _in_groups(kept(scored, "scored"), list(named))
    cal, test = grouped.where("role <> 'test'"), grouped.where("role = 'test'")
    each = kept(grouped_results(cal, test, ["s", "score", "taxonomy"], alphas), "splits")
    fusion_only = grouped.where("score = 'fusion'")
    chosen = select_bounded(fusion_only.where("role = 'fit'"), fusion_only.where("role = 'select'"), ["s"], alphas).select("s", "alpha", "taxonomy")
    selected = each.where("score = 'fusion'").join(chosen, ["s", "alpha", "taxonomy"]).withColumn("taxonomy", F.lit("SELECTED"))
    means = kept(each.unionByName(selected).groupBy("alpha", "score", "taxonomy").agg(F.avg("coverage").alias("coverage"), F.avg("risk").alias("risk")), "means")
    pooled = means.where("score = 'fusion' AND taxonomy = 'pooled'").select("alpha", F.col("coverage").alias("base"))
    return means.join(pooled, "alpha").select("alpha", "score", "taxonomy", "coverage", "risk", (F.col("risk") <= F.col("alpha") + 0.02).alias("held"), (F.col("coverage") - F.col("base")).alias("lift"))
