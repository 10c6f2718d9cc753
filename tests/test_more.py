"""Noise, schemas from classes, premises, repair costs and loader options."""

import json
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import calibration_metrics as cm
from fieldtrust.operators import conformal, extract, extraction_metrics, ground, prefix, tables
from fieldtrust.plans import observe, sinks, verify
from fieldtrust.sources import datasets, ingest


def test_noisy_runs(spark):
    golds = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("total").alias("path"), F.concat(F.lit("1"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("value"), F.lit("numeric").alias("scoring"))
    out = extract.noisy(golds, runs=2, omit=0.1, error=0.2, invent=0.05)
    rows = out.join(golds.select("doc_id", "path", F.col("value").alias("gold")), ["doc_id", "path"], "left").collect()
    known = [r for r in rows if r.gold is not None]
    assert 0.87 < len(known) / 4000 < 0.93 and 100 < len(rows) - len(known) < 300
    assert all(sorted(r.value) == sorted(r.gold) for r in known) and 0.1 < sum(r.value != r.gold for r in known) / len(known) < 0.25
    assert all(0.8 < r.verbalized <= 1 and len(r.logprobs) == 3 and max(r.logprobs) <= 0 for r in rows)
    assert sorted(map(str, out.collect())) == sorted(map(str, extract.noisy(golds.repartition(7), runs=2, omit=0.1, error=0.2, invent=0.05).collect()))


@dataclass
class Line:
    name: str
    price: float | None


@dataclass
class Bill:
    lines: list[Line]
    count: int
    tags: list[str]
    paid: bool = False


def test_leaves_of_a_class():
    got = [(x["path"], x["type"], x["scoring"], x["required"]) for x in extract.leaves_of_class(Bill)]
    assert got == [("lines[].name", "string", "semantic", True), ("lines[].price", "number", "numeric", False), ("count", "integer", "numeric", True), ("tags[]", "string", "semantic", True), ("paid", "boolean", "exact", False)]


def test_premise_and_scorer(spark):
    df = spark.createDataFrame([(1, "total is 5 here", (9, 10)), (2, "abc", None), (3, None, None)], "id int, text string, span struct<start: int, end: int>")
    score = ground.entailment(lambda p, h: [float(len(a)) + float(len(b)) for a, b in zip(p, h, strict=True)])
    got = {r.id: (r.p, r.s) for r in df.select("id", ground.premise(F.col("text"), F.col("span")).alias("p"), score(ground.premise(F.col("text"), F.col("span")), F.lit("xy")).alias("s")).collect()}
    assert got == {1: ("5", 3.0), 2: ("abc", 5.0), 3: (None, None)}


def test_repair_counts_calls(spark):
    kind = "doc_id int, path string, value string, support double, decision string"
    base = spark.createDataFrame([(1, "a", "x", 0.9, "accept"), (2, "a", "y", None, "review"), (3, "a", "z", None, "review")], kind)
    tier = lambda value, ids: lambda docs: spark.createDataFrame([(i, "a", value, 0.9, "accept") for i in ids], kind).join(docs, "doc_id", "left_semi")
    got = {r.doc_id: (r.value, r.tier, r.calls) for r in verify.repair(base, [tier("p", [2]), tier("q", [2, 3])], costs=[1, 3, 5]).collect()}
    assert got == {1: ("x", 0, 1), 2: ("p", 1, 4), 3: ("q", 2, 9)}


ENTITIES = [
    {"id": 0, "label": "question", "text": "Datum:", "box": [0, 0, 90, 90], "linking": [[0, 1]], "words": [{"box": [0, 0, 90, 90], "text": "Datum:"}]},
    {"id": 1, "label": "answer", "text": "3. Mai", "box": [100, 0, 300, 90], "linking": [[0, 1]], "words": [{"box": [100, 0, 150, 90], "text": "3."}, {"box": [160, 0, 300, 90], "text": "Mai"}, {"box": [5, 5, 5, 9], "text": "flat"}]},
]


def test_forms_of_a_language_file(spark, tmp_path):
    documents = [
        {"id": "de_val_0", "uid": "x", "img": {"fname": "a.jpg", "width": 400, "height": 500}, "form": ENTITIES},
        {"id": "de_val_1", "document": ENTITIES},
        {"id": "de_val_2", "form": []},
    ]
    (tmp_path / "de.val.json").write_text(json.dumps({"lang": "de", "version": "1", "split": "val", "documents": documents}))
    words, golds = datasets.bench(spark, "forms", str(tmp_path), lang="de")
    got = {r.doc_id: r for r in golds.collect()}
    assert set(got) == {"forms-de-val-0000", "forms-de-val-0001"} and {(r.path, r.value) for r in got.values()} == {("datum", "3. Mai")}
    box = got["forms-de-val-0000"].gold_box
    assert (box.x0, box.x1, box.y1) == (0.0125, 0.75, 0.18)  # corners of all words, in shares of the stated size
    assert got["forms-de-val-0001"].gold_box.x1 == 0.3  # and of 1000 where none is stated
    assert sorted((r.doc_id[-1], r.line, r.pos, r.text) for r in words.collect()) == [(d, *w) for d in "01" for w in ((0, 0, "Datum:"), (1, 0, "3."), (1, 1, "Mai"))]
    assert {r.doc_id for r in datasets.load(spark, "forms", str(tmp_path), lang="de", limit=1).collect()} == {"forms-de-val-0000"}
    with pytest.raises(ValueError, match="unknown language"):
        datasets.load(spark, "forms", str(tmp_path), lang="xx")


def test_gold_boxes_of_scans(spark, tmp_path):
    row = {"doc_id": "s1", "lines": [{"text": "ACME LTD", "box": [80, 100, 400, 200]}, {"text": "TOTAL 9.80", "box": [0, 500, 800, 600]}], "entities": {"company": "ACME LTD", "total": "77.10", "date": " ", "address": None}}
    empty = {"doc_id": "s2", "lines": row["lines"], "entities": {"company": None, "total": None, "date": None, "address": None}}
    (tmp_path / "s.json").write_text(json.dumps([row, empty]))
    leaves = extract.schema_table(spark, {"type": "object", "properties": {"company": {"type": "string"}, "total": {"type": "number"}}})
    words, golds = datasets.bench(spark, "scans", f"{tmp_path}/s.json", leaves)
    got = {r.path: r.gold_box for r in golds.collect()}
    assert got["total"] is None and (got["company"].x0, got["company"].y1) == (0.1, 0.2)
    assert {r.doc_id for r in words.collect()} == {"s1"}


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"


def jpeg(width, height, frame=0xC0, before=b"\xff\xe0\x00\x04ab\xff\xff\xdb\x00\x03x"):
    return b"\xff\xd8" + before + bytes([0xFF, frame, 0, 17, 8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"\x00" * 9


def test_image_sizes(spark, tmp_path):
    files = {
        "a.png": png(640, 480), "b.jpg": jpeg(300, 200), "c.jpeg": jpeg(70000 % 65536, 9, 0xC2), "cut.png": png(640, 480)[:20], "cut.jpg": jpeg(300, 200)[:14], "text.png": b"no image", "empty.jpg": b"",
        "scan.jpg": b"\xff\xd8\xff\xda\x00\x02" + jpeg(5, 5)[2:], "zero.png": png(0, 3), "loop.jpg": b"\xff\xd8" + b"\xff\xe0\x00\x00" * 50,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.doc_id: (r.width, r.height, r.page) for r in ingest.read_images(spark, str(tmp_path)).collect()}
    assert {k: v[:2] for k, v in got.items() if v[0]} == {"a": (640, 480), "b": (300, 200), "c": (4464, 9)}
    # two files share a stem, and Spark lists no empty files
    assert len(got) == 8 and {v for k, v in got.items() if k not in "abc"} == {(None, None, 0)}


def test_layout_replies(spark):
    replies = [
        (1, '[{"bbox": [10, 20, 30, 40], "text": "a", "score": 0.5}, {"bbox": [0, 0, 1, 1]}, {"text": "no box"}, {"bbox": [1, 2, 3], "text": "short"}, {"bbox": [1, 1, 2, 2], "text": 5, "score": "high"}, 7]'),
        (2, '{"bbox": [1, 1, 2, 2], "text": "no list"}'), (3, "not json"), (4, None), (5, "[]"), (6, ""),
    ]
    pages = spark.createDataFrame([(i, 0, 100, 200, r) for i, r in replies], "doc_id int, page int, width int, height int, reply string")
    got = sorted((r.doc_id, r.text, r.score, r.bbox.x0, r.bbox.y0, r.bbox.x1, r.bbox.y1) for r in datasets.layout_tokens(pages).collect())
    assert got == [(1, "", 0.9, 0.0, 0.0, 0.01, 0.005), (1, "5", 0.9, 0.01, 0.005, 0.02, 0.01), (1, "a", 0.5, 0.1, 0.1, 0.3, 0.2)]


def test_observed_counts_equal_summary(spark, tmp_path, caplog):
    rows = [(i % 3, f"p{i}", "accept" if i % 4 else "review", 0.5 if i % 2 else None, i / 20) for i in range(20)]
    decisions = spark.createDataFrame(rows, "doc_id int, path string, decision string, support double, confidence double")
    caplog.set_level("INFO", logger="fieldtrust")
    made = observe.logged(decisions, lambda df: df.write.parquet(f"{tmp_path}/out"), 0.8, doc_id="all")
    total = verify.summary(decisions).where("doc_id IS NULL").first()
    assert {k: made[k] for k in ("n_fields", "n_accepted", "n_review", "n_grounded")} == {k: total[k] for k in ("n_fields", "n_accepted", "n_review", "n_grounded")}
    assert made["mean_confidence"] == round(total.mean_confidence, 4) and made["duration_ms"] > 0 and made["threshold"] == 0.8
    assert json.loads(caplog.records[-1].message) == made and spark.read.parquet(f"{tmp_path}/out").count() == 20
    nothing = observe.logged(decisions.where("doc_id > 9"), lambda df: df.collect(), 0.8)
    assert (nothing["n_fields"], nothing["n_accepted"], nothing["mean_confidence"]) == (0, 0, 0.0)
    assert "duration_ms" not in observe.event({k: 0 for k in ("n_fields", "n_accepted", "n_review", "n_grounded", "mean_confidence")}, 0.5)


def test_tables_that_cannot_be_read(spark):
    deep = "<table><tr><td>" * 700 + "x"
    flat = "<table><tr><td>a</td><td colspan='x' rowspan=' 2 '>b</td></tr></table>"
    same = flat.replace("'x'", "'1'")
    df = spark.createDataFrame([(1, deep, deep), (2, "no table", flat), (3, flat, ""), (4, None, flat), (5, flat, same)], "id int, p string, g string")
    assert {r.id: r.s for r in df.select("id", tables.teds(F.col("p"), F.col("g")).alias("s")).collect()} == {1: 1.0, 2: None, 3: None, 4: None, 5: 1.0}
    kind = "array<array<struct<text: string, rowspan: int, colspan: int, bbox: array<double>>>>"
    cell = lambda text, box=None: (text, 1, 1, box)
    box = [0.0, 0.0, 1.0, 1.0]
    grids = [(1, [[cell("a", box)]], [[cell("a", box)]]), (2, None, [[cell("a")]]), (3, [None, [cell(None), None]], [[cell("")]]), (4, [], [])]
    rows = spark.createDataFrame(grids, f"id int, p {kind}, g {kind}")
    con = {r.id: tuple(r.s) for r in rows.select("id", tables.grits(F.col("p"), F.col("g")).alias("s")).collect()}
    assert con == {1: (1.0, 1.0, 1.0), 2: (None, None, None), 3: (0.5, 1.0, 2 / 3), 4: (0.0, 0.0, 0.0)}
    loc = {r.id: r.f for r in rows.where("id IN (1, 3)").select("id", tables.grits(F.col("p"), F.col("g"), "loc")["f"].alias("f")).collect()}
    assert loc == {1: 1.0, 3: 0.0}


def test_segments_and_nested_results(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "plain"), (3, None)], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 2, 4, "x"), (1, 3, 6, "y"), (1, 6, 8, "z"), (1, 9, 9, "e"), (1, None, 4, "n")], "doc_id int, start int, end int, label string")
    got = sorted((r.doc_id, r.start, r.segment, r.label or "") for r in sinks.segments(docs, spans).collect())
    assert got == [(1, 0, "ab", ""), (1, 2, "cd", "x"), (1, 4, "ef", ""), (1, 6, "gh", "z"), (1, 8, "ij", ""), (2, 0, "plain", ""), (3, 0, "", "")]
    many = spark.range(1).selectExpr("1 as doc_id", "explode(sequence(0, 40000)) as i").selectExpr("doc_id", "cast(i * 2 as int) as start", "cast(i * 2 + 1 as int) as end", "'a' as label")
    assert sinks.highlights(many).count() == 40001
    kind = "doc_id int, path string, value string, confidence double, decision string, support double, page int, bbox struct<x0: double, y0: double, x1: double, y1: double>"
    rows = spark.createDataFrame([(1, "items[1].n", "v", 0.123456, "accept", 0.9, 0, (0.1, 0.2, 0.3, 0.4)), (1, "total", None, 0.5, "review", None, None, None)], kind)
    nested = json.loads(sinks.results(rows).first().json)
    assert nested["items"][0] is None and nested["items"][1]["n"] == {"value": "v", "confidence": 0.1235, "decision": "accept", "grounding": {"page": 0, "bbox": {"x0": 0.1, "y0": 0.2, "x1": 0.3, "y1": 0.4}, "support": 0.9}}
    assert nested["total"] == {"value": None, "confidence": 0.5, "decision": "review", "grounding": None}


def test_sums_in_slices_and_smooth_ece(spark):
    rng = np.random.default_rng(2)
    conf = np.concatenate([rng.random(400), np.repeat([0.25, 0.5, 1.0, 0.0], 20)])
    correct = (rng.random(len(conf)) < conf).astype(int)
    df = spark.createDataFrame([("a" if i % 2 else None, float(c), int(y)) for i, (c, y) in enumerate(zip(conf, correct, strict=True))], "s string, conf double, correct int")
    got = {(r.s, r.conf): r for r in prefix.cumulated(prefix.tie_groups(df, ["s"]), ["s"]).collect()}
    for s in ("a", None):
        mine = np.arange(len(conf)) % 2 == (1 if s else 0)
        for c in np.unique(conf[mine]):
            above = mine & (conf >= c)
            r = got[s, c]
            assert (r.k, r.k_errors, r.n_all, r.errors_all) == (above.sum(), (1 - correct[above]).sum(), mine.sum(), (1 - correct[mine]).sum())
    h = max(1e-3, 0.15 * len(conf) ** -0.2)
    w = np.exp(-0.5 * ((conf[:, None] - conf[None]) / h) ** 2)
    full = np.abs((w * (correct - conf)[None]).sum(1) / w.sum(1)).mean()
    assert cm.smooth_ece(df, []).first().smooth_ece == pytest.approx(full, abs=2e-3)
    conf = conf.round(1)
    few = spark.createDataFrame([(float(c), int(y)) for c, y in zip(conf, correct, strict=True)], "conf double, correct int")
    w = np.exp(-0.5 * ((conf[:, None] - conf[None]) / h) ** 2)
    assert cm.smooth_ece(few, []).first().smooth_ece == pytest.approx(np.abs((w * (correct - conf)[None]).sum(1) / w.sum(1)).mean(), abs=1e-9)


def test_policies_and_unique_golds(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)], "conf double, correct int")
    got = {m: conformal.policies(df, [], [0.25], m).first() for m in ("conformal", "empirical")}
    assert (got["conformal"].threshold, got["conformal"].expected_coverage) == (0.7, pytest.approx(0.6)) and (got["empirical"].threshold, got["empirical"].method) == (0.6, "empirical")
    with pytest.raises(ValueError, match="unknown method"):
        conformal.policies(df, [], [0.1], "guess")
    golds = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], "doc_id int, path string, value string")
    assert extraction_metrics.unique_golds(golds).exceptAll(golds).isEmpty()
    with pytest.raises(Exception, match="several golds of path a"):
        extraction_metrics.unique_golds(golds.union(golds.where("doc_id = 2"))).collect()
