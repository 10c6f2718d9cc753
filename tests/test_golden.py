"""Closed-form values of the operators on tiny inputs."""

import json

import pytest
from pyspark.sql import functions as F

from fieldtrust.functions import boxes, paths, text
from fieldtrust.operators import agreement, calibrators, conformal, extract, extraction_metrics, ground, resampling, selective_metrics, signals, tables
from fieldtrust.operators import calibration_metrics as cm
from fieldtrust.plans import harness, sinks, verify
from fieldtrust.sources import datasets, ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def scored(spark, conf, correct):
    rows = [("s", i, float(c), y) for i, (c, y) in enumerate(zip(conf, correct, strict=True))]
    return spark.createDataFrame(rows, "signal string, ord long, conf double, correct int")


# ---------------------------------------------------------------- text


def test_numbers(spark):
    cases = {
        "£9,871.25": 9871.25, "18,25": 18.25, "-3": -3.0, "see note": None, "CHF 12.5": 12.5, "7.25 EUR": 7.25, "GBP3,210.75": 3210.75, "12,900": 12900.0, "1,200,000": 1200000.0, "8 %": 8.0,
        "1,2,3": None, "12 boxes of 4": None, " ": None,
    }
    df = spark.createDataFrame([(r,) for r in [*cases, None]], "r string")
    assert {r[0]: r[1] for r in df.select("r", text.parse_number(F.col("r"))).collect()} == cases | {None: None}


def test_string_metrics(spark):
    lit = F.lit
    found = {
        "one letter of five": (text.similarity(lit("river"), lit("rover")), 0.8),
        "nothing in common": (text.similarity(lit("ab"), lit("xyz")), 0.0),
        "two empty texts": (text.similarity(lit(""), lit("")), 1.0),
        "a lost letter": (text.cer(lit("gren"), lit("green")), 0.2),
        "letters for none": (text.cer(lit("abc"), lit("")), 3.0),
        "an added word": (text.wer(lit("a big red dog"), lit("a big dog")), 1 / 3),
        "words for none": (text.wer(lit("one two three"), lit("")), 3.0),
        "marks and separators": (text.match_form(lit("  €12,750 ")), "12750"),
        "case and spaces": (text.match_form(lit("Lee,   Ann")), "lee, ann"),
        "a label": (text.slug(lit("Due Date [net]")), "due_date_net"),
        "a label without letters": (text.slug(lit("--")), "field"),
    }
    r = one(spark, *(c.alias(str(i)) for i, (c, _) in enumerate(found.values())))
    for value, (name, (_, wanted)) in zip(r, found.items(), strict=True):
        assert value == (pytest.approx(wanted) if isinstance(wanted, float) else wanted), name


def test_value_rules(spark):
    rows = [
        ("€18.30", "18.3", "numeric", True), ("18.309", "18.3", "numeric", True), ("18.32", "18.3", "numeric", False), ("none", "18.3", "numeric", False), (" po-77 ", "PO-77", "exact", True), ("PO-78", "PO-77", "exact", False),
        ("Northern Lights Ltd", "northern light", "semantic", True), ("Harbour", "northern light", "semantic", False), (None, None, "exact", True), (None, "x", "exact", False),
    ]
    df = spark.createDataFrame(rows, "p string, g string, s string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(text.value_correct(F.col("p"), F.col("g"), F.col("s"), F.lit(0.01)), "ok").collect())


def test_paths(spark):
    r = one(spark, paths.schema_path(F.lit("items[12].price")), paths.canonical(F.lit("items.0.name")), paths.split_index(F.lit("a.items[2].n"))["idx"], paths.join_index(F.lit("items"), F.lit(3), F.lit("n")))
    assert list(r) == ["items[].price", "items[0].name", 2, "items[3].n"]
    df = spark.createDataFrame([(1, '{"a":1,"b":{"c":"x"},"items":[{"n":"p"},{"n":"q"}],"e":{}}'), (2, "bad"), (3, None)], "doc_id int, j string")
    got = {(r.doc_id, r.path, r.value) for r in paths.flatten_json(df, "doc_id", "j").collect()}
    assert got == {(1, "a", "1"), (1, "b.c", "x"), (1, "items[0].n", "p"), (1, "items[1].n", "q")}
    leaves = spark.createDataFrame([(1, "xs[1]", "b"), (1, "y.z", "c")], "doc_id int, path string, value string")
    assert json.loads(paths.unflatten(leaves, "doc_id").first().json) == {"xs": [None, "b"], "y": {"z": "c"}}


def test_boxes(spark):
    b = lambda *v: boxes.box(*(F.lit(float(x)) for x in v))
    span = lambda s, e: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"))
    r = one(spark, boxes.iou(b(0, 0, 1, 1), b(0.5, 0, 1.5, 1)), boxes.iou(b(0, 0, 1, 1), b(1, 0, 2, 1)), boxes.iou(b(0, 0, 0, 1), b(0, 0, 0, 1)), boxes.span_f1(span(0, 10), span(5, 15)))
    assert list(r) == [pytest.approx(1 / 3), 0.0, 0.0, 0.5]


# ---------------------------------------------------------------- calibration, selection


def test_calibration_values(spark):
    s = scored(spark, [0.9, 0.85, 0.55, 0.5], [1, 0, 1, 1])
    r = cm.ece_mce(s, ["signal"], 5).first()
    assert r.ece == pytest.approx(0.425) and r.mce == pytest.approx(0.475) and cm.reliability_bins(s, ["signal"], 5).count() == 2
    t = scored(spark, [0.9, 0.8, 0.7, 0.1], [1, 1, 0, 0])
    assert cm.ece_mce(t, ["signal"], 2).first().ece == pytest.approx(0.125) and cm.adaptive_ece(t, ["signal"], 2).first().adaptive_ece == pytest.approx(0.275)
    u = cm.proper_scores(scored(spark, [0.9, 0.8, 0.7, 0.6], [1, 1, 0, 1]), ["signal"]).first()
    assert u.brier == pytest.approx(0.175) and u.nll == pytest.approx(0.510825624)
    assert cm.tce(scored(spark, [0.9] * 4, [1, 1, 1, 0]), ["signal"], [0.05, 0.1]).first().tce == pytest.approx(0.10)
    assert cm.smooth_ece(scored(spark, [0.9] * 200, [1] * 120 + [0] * 80), ["signal"]).first().smooth_ece > 0.2


def test_selective_values(spark):
    s = scored(spark, [0.9, 0.8, 0.7, 0.6], [1, 1, 0, 1])
    r = selective_metrics.aurc_family(s, ["signal"]).first()
    assert (r.aurc, r.oracle_aurc, r.e_aurc, r.augrc) == tuple(pytest.approx(x) for x in (7 / 48, 1 / 16, 1 / 12, 0.125))
    c = {x.alpha: (x.coverage, x.threshold) for x in selective_metrics.coverage_at_risk(s, ["signal"], [0.0, 0.25]).collect()}
    assert c == {0.0: (0.5, 0.8), 0.25: (1.0, 0.6)}
    assert selective_metrics.coverage_at_risk(scored(spark, [0.9, 0.9, 0.5], [1, 0, 1]), ["signal"], [0.0]).first().coverage == 0.0
    d = selective_metrics.detection(s, ["signal"]).first()
    assert (d.auroc, d.aupr, d.fpr_at_tpr) == tuple(pytest.approx(x) for x in (2 / 3, 0.5, 1 / 3))
    assert selective_metrics.detection(scored(spark, [0.9, 0.9], [1, 0]), ["signal"]).first().auroc == 0.5
    assert selective_metrics.detection(scored(spark, [0.9, 0.8], [1, 1]), ["signal"]).first().auroc is None
    assert selective_metrics.risk_at_coverage(s, ["signal"], [0.75]).first().risk == pytest.approx(1 / 3)


def test_conformal_values(spark):
    r = conformal.thresholds(scored(spark, [0.9, 0.8, 0.7, 0.6, 0.5], [1, 1, 1, 0, 0]), ["signal"], [0.25]).first()
    assert (r.threshold, r.abstention) == (0.7, pytest.approx(0.4))
    assert conformal.thresholds(scored(spark, [0.9, 0.8], [0, 0]), ["signal"], [0.01]).first().threshold is None
    assert conformal.thresholds(scored(spark, [0.9, 0.8, 0.7, 0.6, 0.5], [1, 1, 1, 0, 0]), ["signal"], [0.25], empirical=True).first().threshold == 0.6
    d = conformal.decide(spark.createDataFrame([(0.9, "x"), (0.5, "y"), (0.99, None)], "conf double, value string"), 0.8)
    assert [r.decision for r in d.collect()] == ["accept", "review", "review"]


def test_risk_guarantee_holds_on_average(spark):
    """Risk on fresh rows stays at alpha over many splits."""
    u = lambda salt: resampling.uniform(F.col("id"), F.lit(salt))
    rows = spark.range(20_000).select(F.col("id").alias("ord"), (F.col("id") % 20).alias("signal"), (F.floor(F.col("id") / 20) % 2).alias("side"), F.round(u("c"), 3).alias("conf"), (u("y") < u("c")).cast("int").alias("correct"))
    fitted = conformal.thresholds(rows.where("side = 0"), ["signal"], [0.2])
    test = rows.where("side = 1").join(fitted, "signal").withColumn("accept", F.coalesce(F.col("conf") >= F.col("threshold"), F.lit(False)))
    assert conformal.coverage_and_risk(test, ["signal"]).agg(F.avg("risk")).first()[0] <= 0.22


def test_calibrators(spark):
    hist = calibrators.fit_histogram(scored(spark, [0.9, 0.9, 0.6, 0.1], [1, 0, 1, 0]), ["signal"], 2)
    got = calibrators.apply_histogram(scored(spark, [0.3, 0.7], [0, 0]), hist, ["signal"], 2).orderBy("ord").collect()
    assert [r.calibrated for r in got] == [0.0, pytest.approx(2 / 3)]
    iso = calibrators.isotonic(scored(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1]), scored(spark, [0.15, 0.85], [0, 0])).orderBy("ord").collect()
    assert [r.calibrated for r in iso] == [0.0, 1.0]
    assert calibrators.platt(scored(spark, [0.7], [1]), scored(spark, [0.7], [1])).first().calibrated == 0.7


# ---------------------------------------------------------------- extraction, signals


def test_scores(spark):
    golds = spark.createDataFrame([(1, p, v, "exact", 0.0) for p, v in (("id", "A"), ("total", "9"), ("date", "d"), ("name", "n"))], "doc_id int, path string, value string, scoring string, numeric_tol double")
    preds = spark.createDataFrame([(1, "id", "A"), (1, "total", "8"), (1, "name", "n"), (1, "tax_id", "t"), (1, "date", None)], "doc_id int, path string, value string")
    r = extraction_metrics.score(preds, golds, ["doc_id"]).first()
    assert (r.precision, r.recall, r.f1, r.omission_rate, r.hallucination_rate, r.exact_match_rate) == (0.5, 0.5, 0.5, 0.25, 0.25, 0.5)
    assert [x.path for x in extraction_metrics.omitted(preds, golds).collect()] == ["date"] and [x.path for x in extraction_metrics.hallucinated(preds, golds).collect()] == ["tax_id"]


def test_alignment(spark):
    kinds = "doc_id int, path string, value string"
    golds = spark.createDataFrame([(1, f"items[{i}].{f}", f"{f}{i}", "exact", 0.0) for i in range(2) for f in "ab"], kinds + ", scoring string, numeric_tol double")
    preds = spark.createDataFrame([(1, f"items.{1 - i}.{f}", f"{f}{i}") for i in range(2) for f in "ab"] + [(1, "items.2.a", "zz")], kinds)
    assert extraction_metrics.score(preds, golds, ["doc_id"]).first().n_correct == 0
    r = extraction_metrics.score(extraction_metrics.aligned(preds, golds), golds, ["doc_id"]).first()
    assert r.n_correct == 4 and r.hallucination_rate == pytest.approx(0.2)


def test_votes(spark):
    def run(values):
        rows = [(1, i, "p", v, None, 0) for i, v in enumerate(values) if v != "-"] + [(1, i, "q", "z", None, 1) for i in range(len(values))]
        df = spark.createDataFrame(rows, "doc_id int, run int, path string, value string, support double, ord int")
        return signals.consensus(df, len(values)).where("path = 'p'").first()

    assert (run([" ACME Corp ", "acme corp", "Globex"]).value, run([" ACME Corp ", "acme corp", "Globex"]).agreement) == (" ACME Corp ", pytest.approx(2 / 3))
    r = run(["x", "-", "x", "-"])
    assert (r.value, r.agreement) == ("x", 0.5)
    r = run([None, "-", "x"])
    assert r.value is None and r.agreement == pytest.approx(2 / 3)  # no value and no row are one vote


def test_fusion(spark):
    f = lambda **k: signals.combined({n: F.lit(v) for n, v in k.items()})
    even = signals.combined({"consensus": F.lit(1.0), "grounding": F.lit(0.5)}, {"consensus": 1.0, "grounding": 1.0})
    assert list(one(spark, even, f(consensus=0.6), f(consensus=1.0, grounding=0.0), f(consensus=None))) == [0.75, pytest.approx(0.6), pytest.approx(0.625), None]
    with pytest.raises(ValueError):
        signals.combined({"x": F.lit(1.0)})
    rows = [(1, 0, "p", "100", 0.6), (1, 1, "p", "100", 0.92), (1, 2, "p", "999", 0.95)]
    r = signals.adjudicate(spark.createDataFrame(rows, "doc_id int, run int, path string, value string, support double"), 3).first()
    assert (r.value, r.agreement, r.support, r.dissent) == ("100", pytest.approx(2 / 3), 0.92, ["999"])


def test_schema_leaves(spark):
    schema = {"properties": {"id": {"type": "string"}, "total": {"type": "number"}, "v": {"type": "object", "properties": {"n": {"type": "string", "x-scoring": "semantic"}}}, "items": {"type": "array", "items": {"type": "object", "properties": {"p": {"type": "integer"}}, "required": ["p"]}}}, "required": ["id"]}
    leaves = {x["path"]: (x["scoring"], x["required"]) for x in extract.leaves_of(schema)}
    assert leaves == {"id": ("exact", True), "total": ("numeric", False), "v.n": ("semantic", False), "items[].p": ("numeric", True)}
    again = extract.json_schema(extract.leaves_of(schema))
    assert {x["path"] for x in extract.leaves_of(again)} == set(leaves)


# ---------------------------------------------------------------- grounding, verification


PAGE = "Invoice ID: INV-7\nTotal: $1,234.50\nTwice: 12\nAlso: 12\nBalance: -5.25"


def test_verify_and_ground(spark):
    docs = spark.createDataFrame([(1, PAGE)], "doc_id int, text string")
    leaves = extract.schema_table(spark, {"properties": {k: {"type": "string"} for k in ("invoice_id", "total", "twice", "balance", "missing")}})
    got = {r.path: r for r in verify.verify(docs, leaves).collect()}
    assert got["invoice_id"].support == 1.0 and got["invoice_id"].decision == "accept" and got["twice"].support == 0.5 and got["twice"].decision == "review"
    assert got["balance"].value == "-5.25" and "missing" not in got
    preds = spark.createDataFrame([(1, "a", "1234.50"), (1, "b", "1,432.50"), (1, "c", "nothing like it here"), (1, "d", None)], "doc_id int, path string, value string")
    g = {r.path: r.support for r in ground.ground(preds, ingest.words(docs)).collect()}
    assert g["a"] == 1.0 and 0.5 < g["b"] < 1.0 and g["c"] is None and g["d"] is None


def test_long_values(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after")], "doc_id int, text string")
    broken = " ".join(w if i % 3 else "zz" for i, w in enumerate(words))
    preds = spark.createDataFrame([(1, "exact", " ".join(words)), (1, "part", broken), (1, "none", " ".join(f"q{i}" for i in range(30)))], "doc_id int, path string, value string")
    g = {r.path: r.support for r in ground.ground(preds, ingest.words(docs)).collect()}
    assert g["exact"] == 1.0 and 0.6 < g["part"] < 0.75 and g["none"] is None


def test_penalties(spark):
    p = lambda n, mode: ground.penalty(F.lit(0.8), F.lit(n), mode)
    assert list(one(spark, p(1, "uniform"), p(4, "none"), p(4, "uniform"), p(4, "sqrt"), p(4, "log"))) == [0.8, 0.8, 0.2, 0.4, pytest.approx(0.8 / 2.386294361)]
    with pytest.raises(ValueError):
        p(2, "other")


def test_repair(spark):
    kinds = "doc_id int, path string, value string, support double, confidence double, decision string"
    base = spark.createDataFrame([(1, "a", "x", 1.0, 0.9, "accept"), (1, "b", "y", None, 0.2, "review"), (2, "a", "z", 1.0, 0.9, "accept")], kinds)
    good = spark.createDataFrame([(1, "b", "Y", 1.0, 0.95, "accept")], kinds)
    loose = spark.createDataFrame([(1, "b", "N", None, 0.95, "accept")], kinds)
    asked = []

    def tier(rows):
        def run(docs):
            asked.append(sorted(r[0] for r in docs.collect()))
            return rows

        return run

    got = {(r.doc_id, r.path): (r.value, r.tier) for r in verify.repair(base, [tier(loose), tier(good), tier(good)]).collect()}
    assert got == {(1, "a"): ("x", 0), (1, "b"): ("Y", 2), (2, "a"): ("z", 0)} and asked == [[1], [1]]
    answers = spark.createDataFrame([(1, "b", "human")], "doc_id int, path string, resolved string")
    final = {(r.doc_id, r.path): (r.final_value, r.outcome) for r in verify.resolve(verify.repair(base, []), answers).collect()}
    assert final[1, "b"] == ("human", "human_resolved") and final[2, "a"] == ("z", "accepted")


# ---------------------------------------------------------------- statistics, tables, shapes


def test_agreement(spark):
    def kappa(a, b):
        rows = [("a", i, x) for i, x in enumerate(a)] + [("b", i, x) for i, x in enumerate(b)]
        return agreement.cohen(spark.createDataFrame(rows, "annotator string, field_id int, label int")).first().kappa

    assert [kappa([1, 1, 0, 0], [1, 0, 0, 0]), kappa([1, 1, 0, 0], [0, 0, 1, 1]), kappa([1, 1], [1, 1]), kappa([1, 1], [1, 0])] == [0.5, -1.0, 1.0, 0.0]
    rows = [(a, i, x) for a in "abc" for i, x in enumerate([1, 0, 1])]
    assert agreement.fleiss(spark.createDataFrame(rows, "annotator string, field_id int, label int")).first().kappa == 1.0


def test_holm(spark):
    def reject(ps):
        df = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "fam int, ord int, p double")
        return [r.reject for r in resampling.holm(df, ["fam"]).orderBy("ord").collect()]

    assert reject([0.01, 0.04, 0.5]) == [True, False, False] and reject([0.5, 0.001]) == [False, True] and reject([0.04] * 3) == [False] * 3


def test_permutation_of_equal_rows(spark):
    df = spark.createDataFrame([(1, i, 0.5, 0.5) for i in range(10)], "g int, k int, x double, y double")
    assert resampling.paired_permutation(df, ["g"], "k", 50).first().p == 1.0


def test_tables():
    t = lambda *cells, attr="": "<table><tr>" + "".join(f"<td{attr}>{c}</td>" for c in cells) + "</tr></table>"
    assert tables.teds_of(t("a", "b"), t("a", "b")) == 1.0 and tables.teds_of(t("a", "x"), t("a", "b")) == 0.75 and tables.teds_of(t("a", "x"), t("a", "b"), True) == 1.0
    assert tables.teds_of(t("a"), t("a", "b")) == 0.75 and tables.teds_of(t("a", "bx"), t("a", "b")) == 0.875
    with pytest.raises(ValueError):
        tables.teds_of("<p>x</p>", t("a"))
    grid = lambda *rows: [[{"text": c} for c in r] for r in rows]
    assert tables.grits_of(grid("ab", "cd"), grid("ab", "cx"))[2] == 0.75 and tables.grits_of(grid(["ab"]), grid(["abcd"]))[2] == pytest.approx(2 / 3)
    assert tables.grits_of(grid("ab"), grid("ab", "cd")) == (1.0, 0.5, pytest.approx(2 / 3)) and tables.grits_of([], grid("ab")) == (0.0, 0.0, 0.0)


def test_forms(spark):
    entry = lambda i, label, text, box, link: {"id": i, "label": label, "text": text, "words": [{"text": text, "box": box}], "linking": link}
    form = [
        entry(10, "question", "Ship to", [0, 0, 160, 40], [[10, 12], [10, 11]]), entry(11, "answer", "Pier", [200, 10, 240, 40], []), entry(12, "answer", "Nine", [248, 0, 400, 30], [[10, 12]]),
        entry(13, "question", "ship-to:", [0, 50, 80, 70], [[13, 14]]), entry(14, "answer", "4,5", [80, 50, 160, 70], []), entry(15, "header", "Slip", [0, 900, 80, 950], []), entry(16, "question", "Weight", [0, 80, 80, 90], [[16, 15]]),
    ]
    kinds = "doc_id int, form array<struct<id: int, label: string, text: string, words: array<struct<text: string, box: array<int>>>, linking: array<array<int>>>>"
    got = {r.path: (r.value, r.scoring, r.bbox.x0, r.bbox.y0, r.bbox.x1, r.bbox.y1) for r in datasets.form_golds(spark.createDataFrame([(1, form)], kinds)).collect()}
    # answers in the order of their ids, boxes around all of them, paths numbered where they repeat, links to no answer left out
    assert got == {"ship_to": ("Pier Nine", "semantic", 0.25, 0.0, 0.5, 0.04), "ship_to_2": ("4,5", "numeric", 0.1, 0.05, 0.2, 0.07)}


def test_texts_and_annotations_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ftwo")
    (tmp_path / "in/b.bin").write_text("no")
    got = ingest.read_texts(spark, str(tmp_path / "in"))
    assert [(r.doc_id, r.text) for r in got.collect()] == [("a", "one\ftwo")] and ingest.lines(got).count() == 2
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann/kim.json").write_text('{"labels": {"f1": 1, "f2": 0}}')
    assert {tuple(r) for r in ingest.read_annotations(spark, str(tmp_path / "ann")).collect()} == {("kim", "f1", 1), ("kim", "f2", 0)}


def test_sinks(spark, tmp_path):
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 3, 8, "b"), (1, 5, 6, "c")], "doc_id int, start int, end int, label string")
    assert [r.label for r in sinks.highlights(spans).orderBy("start").collect()] == ["a", "c"]
    table = sinks.markdown(spark.createDataFrame([(1, 0.5)], "n int, x_y double"))
    assert "| 1 | 0.5000 |" in table and r"x\_y" in sinks.latex(table)


def test_splits(spark):
    docs = harness.split_documents(spark.range(200).withColumnRenamed("id", "doc_id"))
    cal, test = docs.where("split = 'cal'"), docs.where("split = 'test'")
    harness.disjoint(cal, test)
    assert 60 < cal.count() < 140
    with pytest.raises(ValueError):
        harness.disjoint(docs, test)


def test_model_extractor_and_ocr(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id int, text string")
    schema = {"properties": {"a": {"type": "string"}, "b": {"type": "number"}}}
    leaves = extract.schema_table(spark, schema)

    def client(prompts, temperature):
        return ['Sure: {"a": {"value": "v", "confidence": 0.9}, "b": 3}' if p.endswith("x") else "no idea" for p in prompts]

    rows = extract.model_extractor(schema, client, runs=2)(docs, leaves).collect()
    assert {(r.doc_id, r.run, r.path, r.value, r.verbalized) for r in rows} == {(1, k, "a", "v", 0.9) for k in (0, 1)} | {(1, k, "b", "3", None) for k in (0, 1)}
    box = lambda x0, y0: {"x0": x0, "y0": y0, "x1": x0 + 0.1, "y1": y0 + 0.02}
    tokens = [(1, 0, "$42.50", 0.75, box(0.5, 0.101)), (1, 0, "Total:", 0.9, box(0.1, 0.1)), (1, 0, "Date:", 0.9, box(0.1, 0.2))]
    df = spark.createDataFrame(tokens, "doc_id int, page int, text string, score double, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    found = extract.ocr_search(df, extract.schema_table(spark, {"properties": {"total": {"type": "number"}, "date": {"type": "string"}}})).collect()
    assert [(r.path, r.value, r.token_prob) for r in found] == [("total", "$42.50", pytest.approx(0.75))]
