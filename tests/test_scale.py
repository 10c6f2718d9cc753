"""Steps whose work must not grow faster than their tables."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtrust import queries
from fieldtrust.functions import text
from fieldtrust.operators import calibration_metrics, calibrators, conformal, extract, extraction_metrics, ground, resampling, signals, tables
from fieldtrust.plans import harness, offline, verify
from fieldtrust.sources import datasets, ingest

N = 600


@pytest.mark.parametrize("rows", [3, 40, 2500])
@pytest.mark.parametrize("weigh, absent", [(resampling.poisson_weights, 0.0), (resampling.signs, 1.0)])
def test_correlated_blocks_equal_single_draws(rows, weigh, absent):
    """Few rows, windows and transforms of a block give the sums of single draws."""
    rng = np.random.default_rng(rows)
    at, group, v = np.sort(rng.integers(0, 3000, rows)), rng.integers(0, 2, rows), rng.integers(-9, 9, rows).astype(float)
    at[0] = -1
    given, out = pa.schema({"g": pa.string(), "at": pa.int64(), "v0": pa.float64()}), pa.schema({"g": pa.string(), "rep": pa.int32(), "s0": pa.float64()})
    batch = pa.record_batch([pa.array([None if g else "a" for g in group]), pa.array(at), pa.array(v)], schema=given)
    run = resampling._correlated(["g"], N, weigh, absent, [True], out)
    found = {b["g"][0].as_py(): b["s0"].to_numpy() for b in run(iter([batch]))}
    w = weigh(resampling.drawn_at(at[:, None] + 1 + np.arange(N)))
    w[at < 0] = absent
    for g in np.unique(group):
        assert found[None if g else "a"].tolist() == (v[group == g] @ w[group == g]).tolist()


def test_mean_interval_equals_bootstrap_of_repeated_rows(spark):
    rows = spark.range(300).selectExpr("id % 2 AS g", "CASE WHEN id % 50 <> 0 THEN id DIV 3 END AS k", "CASE WHEN id % 7 <> 0 THEN id % 5 END AS v")
    mean = lambda df, keys: df.groupBy(*keys).agg((F.sum(F.col("v") * F.col("w")) / F.sum(F.col("v").isNotNull().cast("int") * F.col("w"))).alias("stat"))
    want = resampling.bootstrap(rows, ["g"], "k", mean, 50).orderBy("g").collect()
    got = resampling.bootstrap_mean(rows, ["g"], "k", F.col("v"), 50).orderBy("g").select("g", "estimate", "lo", "hi").collect()
    assert [tuple(round(x, 9) for x in r) for r in got] == [tuple(round(r[c], 9) for c in ("g", "estimate", "lo", "hi")) for r in want]


def plan(df) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain("extended")
    return out.getvalue()


def test_splits_repeat_counts_and_not_rows(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(harness, "kept", lambda df, name: sizes.append(df.count()) or df)
    rows = spark.range(400).selectExpr("id AS doc_id", "'s' AS signal", "(id % 2) / 2D AS conf", "CAST(id % 3 > 0 AS INT) AS correct")
    assert harness.multi_split(rows, ["signal"], [0.1, 0.5], 70).count() == 2
    assert sizes == [4 * 70]


def test_studies_repeat_counts_and_not_rows(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(offline, "kept", lambda df, name, f=offline.kept: (made := f(df, name), sizes.update({name: made.count()}))[0])
    rows = spark.range(400).selectExpr("id AS doc_id", "(id % 2) / 2D AS verbalized", "1D AS consistency", "(id % 2) / 2D AS support", "1 AS grounded", "0.5D AS entailment", "CAST(id % 3 > 0 AS INT) AS correct")
    assert offline.study(rows, [0.3], 2).count() > 0 and sizes["halved"] == 4 * 2 * 3


def test_shared_values_are_located_once(spark):
    docs = spark.createDataFrame([(1, "total: 12 apples\nname: Ann")], "doc_id int, text string")
    p = spark.createDataFrame([(1, f"p{i}", v) for i, v in enumerate(["12 apples", "12 Apples", "Ann", None, "  "])], "doc_id int, path string, value string")
    assert ground.targets(p).count() == 2
    found = {r.path: r.support for r in ground.ground(p, ingest.words(docs)).collect()}
    assert found == {"p0": 1.0, "p1": 1.0, "p2": 1.0, "p3": None, "p4": None}


def test_texts_of_pages_ground_as_their_words(spark):
    rng = random.Random(8)
    w = ["a", "b", "ab", "Total:", "$", "$5", "1,250", "x y", "\u00e9", "abcd", "abce", "GHOST", "a\tb", "\u03a3", ""]
    docs = [(i, "".join(rng.choice(w) + rng.choice([" ", " ", "\n", "\f"]) for _ in range(rng.randint(0, 20)))) for i in range(60)] + [(60, None), (None, "a b")]
    p = [(i, f"p{k}", " ".join(rng.choices(w, k=rng.choice([1, 1, 2, 3, 14])))) for i in range(61) for k in range(5)] + [(None, "p", "a")]
    docs, p = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(p, "doc_id int, path string, value string")
    got, want = (sorted(map(str, ground.ground(p, words, 0.4).collect())) for words in (ingest.page_texts(docs), ingest.words(docs)))
    assert got == want and sum("bbox=Row" in r for r in got) > 60


def test_predictions_are_made_where_their_document_is(spark):
    """Orders are shuffled, never the values of their runs, and no found place is filtered below its own steps."""
    made = plan(queries.QUERIES["ground_fuzzy"](spark, "/root/testdata/sf0.001"))
    optimized, physical = made.split("Optimized Logical Plan")[1].split("Physical Plan")
    assert "ENSURE_REQUIREMENTS" not in physical and optimized.count("levenshtein(") == 3


def test_words_of_a_document_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b\nc")], "doc_id int, text string")
    assert plan(ground.page_words(ingest.words(docs))).split("Physical Plan")[1].count("Exchange") == 1


def test_filter_on_a_vote_does_not_repeat_its_steps(spark):
    p = spark.createDataFrame([(1, "a", 0, 0, "x", 0.5)], "doc_id int, path string, run int, ord int, value string, support double")
    text = plan(signals.consensus(p, 5).where("value IS NOT NULL"))
    assert text.split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("try_element_at") + text.split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("element_at(") <= 8


@pytest.mark.parametrize("name", ["adaptive_k", "field_dump", "harness_outcomes"])
def test_rows_of_runs_are_not_shuffled(spark, name):
    """What is shuffled are orders, and what is left after the vote; a document's runs never are."""
    made = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    optimized, physical = made.split("Optimized Logical Plan")[1].split("Physical Plan")
    # golds meet the vote, and texts what is left; the harness lists places as well as runs
    assert physical.count("ENSURE_REQUIREMENTS") == {"adaptive_k": 0, "field_dump": 3, "harness_outcomes": 2}[name]
    assert optimized.count("collect_list(") == (2 if name == "harness_outcomes" else 1)


def test_prefixes_of_runs_equal_votes_of_those_runs(spark):
    rng = random.Random(9)
    p = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice("ab"), rng.choice([-1, 0, 0, 1, 2, 3, 4, 5]), i, rng.choice(["x", "X ", "y", None, "<omit>"])) for i in range(120)]
    p = spark.createDataFrame(p, "doc_id int, path string, run int, ord int, value string")
    for low, top in ((2, 5), (1, 3), (4, 4)):
        want = {r.doc_id: low if low < top else top for r in p.select("doc_id").distinct().collect()}
        for d in [d for d in want if d is not None]:
            shares = {k: [r.agreement for r in signals.consensus(p.where(f"doc_id = {d}"), k).collect()] for k in range(low, top)}
            want[d] = next((k for k in range(low, top) if all(abs(a - 0.5) > 0.25 for a in shares[k])), top)
        assert {r.doc_id: r.k for r in signals.adaptive_consensus(p, k_min=low, k_max=top).collect()} == want


def test_labelled_lines_are_matched_once(spark):
    docs = spark.createDataFrame([(1, "Subtotal: 4\nTotal - 5\ninvoice-id: x\nInvoice ID: é"), (2, "caf\u00e9 total: -6\rx\ntotal: -7"), (3, None)], "doc_id int, text string")
    schema = {"properties": {"total": {"type": "number"}, "invoice_id": {"type": "string"}}}
    found = extract.text_search(docs, extract.schema_table(spark, schema))
    assert sorted((r.doc_id, r.path, r.value) for r in found.collect()) == [(1, "invoice_id", "é"), (1, "total", "5"), (2, "total", "-7")]
    inferred = extract.infer_schema(docs)
    assert sorted((r.doc_id, r.path) for r in inferred.collect()) == [(1, "invoice_id"), (1, "subtotal"), (2, "total")]
    for df, steps in ((found, {"regexp_extract(": 1, "RLIKE(content": 2}), (inferred, {"regexp_extract(": 0, "regexp_replace(content": 2})):
        made = plan(df).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
        assert all(made.count(step) <= n for step, n in steps.items())


def test_entailment_splits_its_premise_once(spark):
    df = spark.createDataFrame([("Total is 5 5.", "total is 5 6"), ("x", " "), (None, "a")], "p string, h string").select(ground.lexical_entailment(F.col("p"), F.col("h")).alias("e"))
    assert [r.e for r in df.collect()][:2] == [0.75, 0.0]
    assert "array_contains(filter" not in plan(df).replace("'", "").lower()


@pytest.mark.parametrize("name", ["bounded_taxonomy", "group_taxonomies"])
def test_taxonomies_repeat_counts_and_not_rows(spark, name, monkeypatch):
    def refused(*_):
        raise AssertionError("rows are repeated for each taxonomy")

    monkeypatch.setattr(queries.conformal, "by_taxonomy", refused)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def _cells(rng, bare):
    cell = lambda: None if rng.random() < 0.1 else {"text": rng.choice([None, "", "ab", "abc", "b c"]), "rowspan": rng.choice([None, 1, 2]), "colspan": 1, "bbox": rng.choice([None, [0.0, 0.0, 1.0, 1.0], [0.5, 0.0, 1.5, 1.0]])}
    grid = [None if rng.random() < 0.1 else [cell() for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 4))]
    return [[{k: v for k, v in {"text": "", **(c or {})}.items() if v is not None} | ({} if c and c["text"] else {"text": ""}) for c in row or []] for row in grid] if bare else grid


@pytest.mark.parametrize("kind", ["con", "top", "loc"])
def test_grids_of_a_batch_equal_single_pairs(kind, monkeypatch):
    made = {bare: [_cells(random.Random(i), bare) for i in range(400)] for bare in (True, False)}
    form = pa.list_(pa.list_(pa.struct({"text": pa.string(), "rowspan": pa.int32(), "colspan": pa.int32(), "bbox": pa.list_(pa.float64())})))
    a, b = (tables._Grids(pa.array(x, form)) for x in (made[False][:200], made[False][200:]))
    assert a.n_cells.tolist() == [sum(map(len, g)) for g in made[True][:200]]
    want = [tables._best(p, g, lambda r, s: tables._best(r, s, tables._cell(kind))) for p, g in zip(made[True][:200], made[True][200:], strict=True)]
    assert tables._totals(a, b, kind).tolist() == want
    monkeypatch.setattr(tables, "HELD", 1)
    assert tables._totals(a, b, kind).tolist() == want


def test_pairs_of_a_shape_take_their_steps_together(monkeypatch):
    rng = random.Random(5)
    html = lambda: "<table>" + "".join("<tr>" + "".join(f"<t{c}>{rng.choice(['a', 'bc', 'abd', ''])}</t{c}>" for c in rng.choices("dh", k=rng.randint(1, 2))) + "</tr>" for _ in range(rng.randint(1, 2))) + "</table>"
    pairs = [(tables.read_nodes(html()), tables.read_nodes(html())) for _ in range(1000)]
    want = [[tables._similarity(a, b, m) for m in (False, True)] for a, b in pairs]
    calls, step = [], tables._distance
    monkeypatch.setattr(tables, "_distance", lambda *a: calls.append(1) or step(*a))
    assert tables._similarities([*pairs, None], [False, True])[:-1].tolist() == want and len(calls) < 150


@pytest.mark.parametrize("html", ["<table><tr><td>a b<td>c</tr></table> z <table></table>", "x<tr><table></td><thead><th> a\n b</thead>q<td>1 > 2</table>", "<table><tr><td>a<table><td>b</td></table>c</td>", "<p>", "", "<TABLE><td colspan=2>a &amp; b<br>c</td></TABLE>", "</table><table>", "<table <td>x</td></table>"])
def test_plain_texts_read_as_the_parser_reads_them(html):
    root, got = tables.tree(html), tables.read_nodes(html)
    nodes = root and tables._postorder(root)
    assert (got and ([n[:4] for n in got[0]], got[1])) == (nodes and ([n[:4] for n in nodes[0]], nodes[1]))


def test_bits_count_the_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
        assert tables.common(a, b) == row[-1]


def test_word_errors_list_their_words_once(spark):
    df = spark.createDataFrame([("a b  c", "a x c d"), ("", "a"), ("a a", ""), (None, "a"), ("\U0001f600 b", "b")], "p string, g string").select(text.wer(F.col("p"), F.col("g")).alias("w"))
    assert [r.w for r in df.collect()] == [0.5, 1.0, 2.0, None, 1.0]
    made = plan(df).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert made.count("array_distinct") == 1 and made.count("split(") == 2


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(calibrators, "kept", lambda df, name: sizes.append(df.count()) or df)
    rows = spark.range(600).selectExpr("id", "(id % 3) / 4D + 0.1 AS conf", "CAST(id % 5 > id % 3 AS INT) AS correct")
    once = calibrators.platt(rows, rows.where("id < 3")).orderBy("id").collect()
    assert sizes == [6] and once[0].calibrated == pytest.approx(0.8, abs=0.05)


def test_rows_of_a_dealt_order_need_no_shuffle(spark):
    text = plan(queries.learned_combiner(spark, "/root/testdata/sf0.001")).split("Physical Plan")[1]
    assert text.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(o_orderkey" in text


def test_halvings_repeat_counts_and_not_rows(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(conformal, "kept", lambda df, name: sizes.append(df.count()) or df)
    rows = spark.range(900).selectExpr("id AS doc_id", "'s' AS signal", "(id % 2) / 2D AS conf", "CAST(id % 3 > 0 AS INT) AS correct", "IF(id % 5 = 0, 0.1D, 0.9D) AS support")
    assert conformal.characterize(rows, ["signal"], conformal.grounded_group(F.col("support"))).count() == 1 and sizes == [8]


def test_tiers_read_what_was_decided(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(verify, "kept", lambda df, name: seen.append(df.count()) or df)
    base = spark.createDataFrame([(1, "a", None, None, "review"), (1, "b", "y", 0.5, "accept"), (2, "a", "z", 0.5, "accept")], "doc_id int, path string, value string, support double, decision string")
    tiers = [lambda docs, p=p: docs.selectExpr("doc_id", f"'{p}' AS path", "'x' AS value", "0.9D AS support", "'accept' AS decision") for p in "bab"]
    got = sorted(tuple(r) for r in verify.repair(base, tiers).collect())
    assert got == [(1, "a", "x", 0.9, "accept", 2), (1, "b", "y", 0.5, "accept", 0), (2, "a", "z", 0.5, "accept", 0)] and seen == [3, 3, 3]


def _items(spark):
    p = [(1, "r[0].a", "x"), (1, "r[0].b", "y "), (1, "r.1.a", "z"), (1, "r[2].a", None), (1, "t", "x"), (2, "q[0]", "1,5")]
    g = [(1, "r[0].a", "z", "exact", 0.0), (1, "r[1].a", "X", "exact", 0.0), (1, "r[1].b", "y", "semantic", 0.0), (2, "q[3]", "1.5", "numeric", 0.01), (3, "r[0].a", "x", "exact", 0.0)]
    return spark.createDataFrame(p, "doc_id int, path string, value string"), spark.createDataFrame(g, "doc_id int, path string, value string, scoring string, numeric_tol double")


def test_items_of_a_document_are_shuffled_once(spark):
    sims = extraction_metrics.item_similarity(*_items(spark))
    physical = plan(sims).split("Physical Plan")[1]
    assert sorted(tuple(r) for r in sims.collect()) == [(1, "r", 0, 1, 1.0), (1, "r", 1, 0, 1.0), (2, "q", 0, 3, 1.0)]
    assert physical.count("Exchange hashpartitioning") == 1 and "Join" not in physical


def test_scores_join_their_sides_once(spark):
    p, g = _items(spark)
    moved = extraction_metrics.aligned(p, g)
    assert sorted((r.doc_id, r.path) for r in moved.collect()) == [(1, "r[0].a"), (1, "r[1].a"), (1, "r[1].b"), (1, "r[2].a"), (1, "t"), (2, "q[3]")]
    found = extraction_metrics.score(moved, g, ["doc_id"])
    rates = {r.doc_id: (r.n_gold, r.n_pred, r.n_correct, r.omission_rate, r.hallucination_rate) for r in found.collect()}
    assert rates == {1: (3, 4, 3, 0.0, 0.25), 2: (1, 1, 1, 0.0, 0.0), 3: (1, 0, 0, 1.0, 0.0)}
    assert plan(extraction_metrics.score(p, g, ["doc_id"])).split("Physical Plan")[1].count("Join ") == 2


def test_bins_rank_only_the_rows_of_their_borders(spark, monkeypatch):
    ranks = []
    monkeypatch.setattr(calibration_metrics, "right_before", lambda o, c, by, f=calibration_metrics.right_before: ranks.append(c.count()) or f(o, c, by))
    rows = spark.range(1000).selectExpr("IF(id < 995, 's', 't') AS signal", "id AS ord", "CAST(id % 4 AS DOUBLE) / 7 AS conf", "CAST(id * id % 5 < 2 AS INT) AS correct")
    got = {r.signal: r.adaptive_ece for r in calibration_metrics.adaptive_ece(rows, ["signal"]).collect()}
    for s in "st":
        v = sorted((r.conf, r.ord, r.correct) for r in rows.collect() if r.signal == s)
        size, large = divmod(len(v), 15)
        ends = np.cumsum([size + (i < large) for i in range(15)])
        want = sum(abs(sum(c - p for p, _, c in v[e - size - (i < large) : e])) for i, e in enumerate(ends)) / len(v)
        assert got[s] == pytest.approx(want, abs=1e-12)
    assert ranks and ranks[0] < 20


def test_totals_come_with_the_ranks(spark):
    from fieldtrust.operators import selective_metrics

    rows = spark.range(50).selectExpr("'s' AS signal", "id AS ord", "id / 50D AS conf", "CAST(id % 3 > 0 AS INT) AS correct")
    df = selective_metrics.aurc_family(rows, ["signal"])
    assert plan(df).split("Optimized Logical Plan")[1].split("Physical Plan")[0].count("Join ") == 3 and 0 < df.first().aurc < 1


def test_layout_replies_are_read_in_one_pass(spark):
    made = plan(queries.QUERIES["layout_replies"](spark, "/root/testdata/sf0.001")).split("Optimized Logical Plan")[1]
    optimized, physical = made.split("Physical Plan")
    assert optimized.count("parseJson(") == 1 and optimized.count("try_variant_get(") == 1
    assert not any(step in physical for step in ("Window", "Sort", "Aggregate"))


def test_parts_of_a_reply_equal_single_reads(spark):
    rng = random.Random(4)
    v = ["1", "2.5", "1e3", '"3"', '"x"', "true", "null", "[1]", '{"a": 1}', "12345678901234567890", '"NaN"', "1.0", '"[1, 2, 3, 4]"']
    bbox = lambda: rng.choice([rng.choice(v), "[1, 2, 3, 4]", f"[{', '.join(rng.choices(v, k=rng.choice([3, 4, 5])))}]", f"[{', '.join(rng.choices(v[:4], k=4))}]"])
    item = lambda: rng.choice([f'{{"bbox": {bbox()}, "text": {rng.choice(v)}, "score": {rng.choice(v)}}}', f'{{"BBOX": [1, 2, 3, 4], "bbox": {bbox()}}}', rng.choice(v)])
    replies = ["[%s]" % ", ".join(item() for _ in range(3)) for _ in range(500)] + [None, "", "5", "[", "[]", '{"bbox": [1, 2, 3, 4]}', '[{"bbox": [1, 2, 3, 4], "bbox": 1}]']
    pages = spark.createDataFrame([(i, 0, 100, 200, r) for i, r in enumerate(replies)], "doc_id int, page int, width int, height int, reply string")
    got = datasets.layout_tokens(pages).select("doc_id", "text", "score", "bbox.*")
    rows = spark.sql("SELECT doc_id, value AS item FROM {p}, LATERAL variant_explode(try_parse_json(reply)) WHERE schema_of_variant(try_parse_json(reply)) LIKE 'ARRAY%'", p=pages)
    part = lambda path, kind: F.try_variant_get("item", path, kind)
    sides = [(part(f"$.bbox[{i}]", "double") / (200 if i % 2 else 100)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    want = rows.select("doc_id", F.coalesce(part("$.text", "string"), F.lit("")).alias("text"), F.coalesce(part("$.score", "double"), F.lit(0.9)).alias("score"), *sides).where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    made = sorted(map(str, got.collect()))
    assert len(made) > 100 and made == sorted(map(str, want.collect()))


def test_words_are_placed_without_windows(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "bc", " ", " ", "\n", "\f", "\t", "\U0001f600"], k=rng.randint(0, 60))) for _ in range(300)] + ["w " * 3000, "", " ", "\n\n", "\f"]
    found = ingest.words(spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id int, text string"))
    want = []
    for i, t in enumerate(texts):
        for page, body in enumerate(t.split("\f")):
            placed = [(n, sum(len(x) + 1 for x in line.split(" ")[:k]), w) for n, line in enumerate(body.split("\n")) for k, w in enumerate(line.split(" ")) if w]
            for pos, (n, col, w) in enumerate(placed):
                x0, y0 = min(0.98, 0.02 + 0.012 * col), min(0.98, n * 0.04)
                want.append((i, page, n, pos, w, x0, y0, min(0.99, x0 + 0.012 * max(1, len(w))), min(0.99, y0 + 0.9 * 0.04)))
    made = plan(found)
    assert "Window" not in made and made.split("Physical Plan")[1].count("Exchange") == 1
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert [r.s for r in spark.sql("SELECT sequence(1, n) AS a FROM VALUES (1), (2), (7), (8), (9) t(n)").select(ingest.sums(F.col("a"))[F.size("a") - 1].alias("s")).collect()] == [1, 3, 28, 36, 45]
