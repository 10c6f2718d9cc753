"""Runs to outcomes and tables, splits, fusion, the field dump and its backfill."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import fusion, signals
from fieldtrust.plans import harness, offline


def test_votes_of_runs(spark):
    kind = "doc_id int, run int, ord int, path string, value string, support double, said double"
    rows = [(1, 0, 0, "a", None, None, 0.1), (1, 2, 0, "a", "x", 0.9, 0.2), (2, 0, 0, "a", " Foo  Bar", 0.5, 0.3), (2, 1, 1, "a", "foo bar", 0.7, 0.4), (2, 2, 0, "b", "y", None, 0.5), (2, 1, 2, "a", "last", 0.6, 0.6), (3, 7, 0, "a", "late", 0.1, 0.7)]
    got = {(r.doc_id, r.path): tuple(r)[2:] for r in signals.consensus(spark.createDataFrame(rows, kind), 3, ["said"]).collect()}
    assert got[1, "a"] == (None, None, None, pytest.approx(2 / 3), 2, 0, 0)  # no value and no row are the same vote
    assert got[2, "a"] == (" Foo  Bar", 0.5, 0.3, pytest.approx(1 / 3), 1, 0, 0)  # the last row of a run counts, the first seen wins ties
    assert got[2, "b"] == (None, None, None, pytest.approx(2 / 3), 2, 2, 0)
    assert len(got) == 3


@pytest.mark.parametrize("n,fraction", [(2, 0.01), (7, 0.5), (1000, 0.3), (1001, 0.999)])
def test_exact_split(spark, n, fraction):
    docs = spark.range(n).select(F.concat(F.lit("d"), "id").alias("doc_id")).crossJoin(spark.range(2).select(F.col("id").alias("x")))
    out = harness.exact_split(docs, fraction, 5)
    counts = {r.split: r.n for r in out.groupBy("split").agg(F.count_distinct("doc_id").alias("n")).collect()}
    assert counts["cal"] == max(1, min(n - 1, round(fraction * n))) and sum(counts.values()) == n and out.count() == 2 * n
    harness.disjoint(out.where("split = 'cal'"), out.where("split = 'test'"))
    again = harness.exact_split(docs.repartition(5), fraction, 5)
    assert again.exceptAll(out).isEmpty()


def test_exact_split_needs_two_keys(spark):
    with pytest.raises(ValueError):
        harness.exact_split(spark.createDataFrame([("a",), ("a",), (None,)], "doc_id string"))
    with pytest.raises(ValueError):
        harness.exact_split(spark.createDataFrame([("a",), ("b",)], "doc_id string"), 1.0)


def newton(x, y, strength):
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(x.shape[1], 1 / strength)
    ridge[0] = 0
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return w


def test_fusion_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for key in range(4):
        x = rng.normal(size=(300, 2)).round(2)
        y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + key * x[:, 0] - x[:, 1])))).astype(int)
        rows += [(key, float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)]
        wanted[key] = newton(x, y, 2.0)
    rows += [(9, 0.1, 0.2, 1)] * 3
    df = spark.createDataFrame(rows, "k int, a double, b double, correct int")
    fitted = fusion.fit_logistic(df, ["k"], ["a", "b"], 2.0)
    got = {r.k: r for r in fitted.collect()}
    assert got[9].weights is None and got[9].base_rate == 1.0
    for key, w in wanted.items():
        assert got[key].weights == pytest.approx(list(w), abs=1e-6)
    more = spark.createDataFrame([(0, 1.0, -1.0), (9, 1.0, 1.0), (11, 0.0, 0.0), (0, None, None)], "k int, a double, b double")
    fused = [r.fused for r in fusion.apply_logistic(more, fitted, ["k"], ["a", "b"]).orderBy("k", F.desc("a")).collect()]
    z = wanted[0] @ [1, 1, -1]
    assert fused[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and fused[1] == pytest.approx(1 / (1 + math.exp(-wanted[0][0])), abs=1e-6)
    assert fused[2:] == [1.0, None]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    for values in (rng.random(5000), np.repeat([0.1, 0.7], [10, 3]), np.array([0.5])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        shares = [0.0, 0.34, 0.5, 0.67, 1.0]
        assert fusion.quantile_cuts(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)), abs=1e-12)
    assert fusion.quantile_cuts(df.where("v > 5"), "v", [0.5]) == []


@pytest.fixture(scope="module")
def runs(spark):
    """60 documents, three runs: the third field is often wrong and then poorly supported."""
    golds = spark.range(60).selectExpr("id as doc_id", "explode(array('a', 'b', 'c')) as path").selectExpr("doc_id", "path", "concat(path, doc_id) as value", "'exact' as scoring", "0.0D as numeric_tol", "struct(0.1D as x0, 0.1D as y0, 0.2D as x1, 0.2D as y1) as gold_box")
    made = golds.crossJoin(spark.range(3).selectExpr("cast(id as int) as run")).withColumn("bad", F.expr("path = 'c' and (doc_id * 7 + run) % 3 = 0"))
    preds = made.selectExpr(
        "doc_id", "run", "cast(doc_id * 10 + ascii(path) - 97 as int) as ord", "path", "if(bad, 'zzz', value) as value", "if(bad, null, 0.6D + doc_id / 200) as support", "if(bad, 0.0D, 0.9D) as verbalized",
        "if(bad, struct(0.7D as x0, 0.7D as y0, 0.8D as x1, 0.8D as y1), gold_box) as bbox",
    )
    return preds, golds


def test_outcomes_of_signals(spark, runs):
    preds, golds = runs
    out = harness.signal_outcomes(preds, golds, 3)
    rows = {(r.doc_id, r.path, r.signal): r for r in out.collect()}
    assert len(rows) == 60 * 3 * 5
    bad = rows[0, "c", "verbalized"]
    assert (bad.conf, bad.correct, bad.value) == (0.5, 0, "zzz") and rows[0, "c", "grounding"].conf == 0.0 and rows[0, "c", "token_prob"].conf == 0.5
    won = rows[0, "c", "consensus"]
    assert (won.conf, won.correct) == (pytest.approx(2 / 3), 1)
    assert rows[0, "c", "combined"].conf == pytest.approx((0.5 * 2 / 3 + 0.3 * 0.6 + 0.1 * 0.9) / 0.9)


def test_harness_tables(spark, runs):
    preds, golds = runs
    tables = harness.run(preds, golds, 3, [0.05, 0.1])
    rows = {k: v.collect() for k, v in tables.items()}
    assert set(rows) == {"extraction", "calibration", "selective", "conformal", "grouped", "ablation", "grounding"}
    assert {(r.signal, r.calibrator) for r in rows["calibration"]} == {(s, c) for s in (*harness.RUN_SIGNALS, *harness.VOTE_SIGNALS) for c in ("raw", "histogram", "temperature", "platt")}
    assert all(0 <= r.ece <= 1 and r.brier >= 0 for r in rows["calibration"])
    assert {r.signal: r.auroc for r in rows["selective"]}["grounding"] == 1.0
    assert all(r.guarantee_held == (r.risk <= r.alpha + 1e-9) for r in rows["conformal"]) and len(rows["conformal"]) == 10
    assert {r.method for r in rows["grouped"]} == {"marginal", "grounded-group"} and all(r.gain == 0 for r in rows["grouped"] if r.method == "marginal")
    assert rows["extraction"][0].recall == pytest.approx(1 - 20 / 180) and (rows["grounding"][0].acc_50, rows["grounding"][0].n_ungrounded) == (1.0, 0)
    one = harness.summary(tables, "forms", "x", 0.05)
    other = one.withColumn("extractor", F.lit("y")).withColumn("best_AUROC", F.lit(2.0))
    ranked = harness.ranking(one.unionByName(other)).collect()
    assert [r.extractor for r in ranked] == ["y", "x"] and ranked[1].F1 == round(ranked[1].F1, 3)


def test_dump_backfill_and_study(spark, runs, tmp_path):
    preds, golds = runs
    path = f"{tmp_path}/dump"
    rows = offline.fields(preds, golds, 3)
    offline.dump(rows, path, parts=8)
    back = offline.read_dump(spark, path)
    size = rows.count()
    assert back.exceptAll(rows.select(back.columns)).isEmpty() and back.count() == size
    grounded = back.where("grounded = 1").count()
    assert back.where("entailment IS NULL").count() == grounded and back.where("grounded = 0 AND entailment = 0").count() == size - grounded
    premises = rows.selectExpr("doc_id", "path", "value as premise", "path as hypothesis").where("doc_id <> 3")
    score = lambda p, h: F.char_length(p) / 10.0
    broken = F.udf(lambda p, h: float("nan") if p.endswith("59") and 1 / 0 else 0.5, "double")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        offline.backfill(spark, path, premises, broken, parts=8)
    assert offline.read_dump(spark, path).count() == size  # what was broken off lost nothing
    left = offline.read_dump(spark, path).where("entailment IS NULL").count()
    assert 0 < left <= grounded and offline.backfill(spark, path, premises, score, parts=8) == left
    done = offline.read_dump(spark, path)
    assert done.where("entailment IS NULL").count() == 0 and done.count() == size and done.where("doc_id = 3 AND entailment > 0").isEmpty()
    before = sorted(map(str, done.collect()))
    assert offline.backfill(spark, path, premises, score, parts=8) == 0 and sorted(map(str, offline.read_dump(spark, path).collect())) == before
    out = {(r.alpha, r.score, r.taxonomy): r for r in offline.study(done, [0.1, 0.2], splits=4).collect()}
    assert len(out) == 2 * (3 * 6 + 1) and out[0.2, "fusion", "pooled"].lift == 0.0
    assert all(0 <= r.coverage <= 1 and 0 <= r.risk <= 1 for r in out.values())
