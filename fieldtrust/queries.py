"""Registered queries of the field-trust operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions import boxes, paths, text
from fieldtrust.functions.store import kept
from fieldtrust.operators import agreement, calibrators, conformal, extract, extraction_metrics, ground, grounding_metrics, resampling, selective_metrics, signals, tables
from fieldtrust.operators import calibration_metrics as cm
from fieldtrust.plans import harness, offline, sinks, verify
from fieldtrust.sources import datasets, ingest, testbed
from fieldtrust.sources.testbed import portable, rendered
from fieldtrust.streaming import monitor

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ALPHAS = [0.02, 0.05, 0.1]
OUT, INV, GOLD, PRED, ANN = map(portable, (testbed.OUTCOMES, testbed.INVOICES, testbed.GOLDS, testbed.PREDICTIONS, testbed.ANNOTATIONS))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(spark, sf, testbed.OUTCOMES)


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(spark, sf, testbed.INVOICES)


def golds(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(spark, sf, testbed.GOLDS)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(spark, sf, testbed.PREDICTIONS)


def of_documents(spark: SparkSession, sf: str, *statements: str) -> list[DataFrame]:
    """The statements' rows, dealt out by document alike."""
    return [testbed.by_document(spark, sf, s) for s in statements]


INVOICE_SCHEMA = {
    "type": "object",
    "properties": {
        "invoice_id": {"type": "string"},
        "customer": {"type": "string", "x-scoring": "semantic"},
        "segment": {"type": "string"},
        "priority": {"type": "string"},
        "total": {"type": "number", "x-numeric-tol": 0.01},
        "status": {"type": "string", "x-aliases": ["state"]},
    },
    "required": ["invoice_id", "total"],
}

# ---------------------------------------------------------------- text, paths

_RAW = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN concat('$', t) WHEN 1 THEN concat('RM ', t) WHEN 2 THEN concat(t, ' USD') WHEN 3 THEN replace(t, '.', ',')
  WHEN 4 THEN 'n/a' WHEN 5 THEN concat(CAST(o_orderkey % 900 + 100 AS VARCHAR(9)), ',', '500') ELSE concat('1,', substr(t, 1, 3), '.75 EUR') END AS raw
  FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR(20)) AS t FROM {orders}) x"""


@query(f"""
WITH a AS (SELECT doc_id, raw, regexp_replace(raw, '[$€£%\\s]', '', 'g') AS b FROM ({portable(_RAW)})),
c AS (SELECT *, regexp_replace(regexp_replace(b, '^[A-Za-z]{{1,5}}([-0-9.])', '\\1'), '([0-9.])[A-Za-z]{{1,5}}$', '\\1') AS s FROM a),
d AS (SELECT *, CASE WHEN regexp_matches(s, '^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.[0-9]+)?$') OR (s LIKE '%,%' AND s LIKE '%.%') THEN replace(s, ',', '') ELSE replace(s, ',', '.') END AS p FROM c)
SELECT doc_id, raw, try_cast(p AS DOUBLE) AS number FROM d""")
def parse_numbers(spark, sf):
    return rendered(spark, sf, _RAW).select("doc_id", "raw", text.parse_number(F.col("raw")).alias("number"))


@query("""SELECT l_returnflag, regexp_replace(concat('items[', CAST(l_linenumber AS VARCHAR), '].tax[', CAST(l_linenumber + 1 AS VARCHAR), '].rate'), '\\[[0-9]+\\]', '[]', 'g') AS path,
  count(*) AS n FROM lineitem GROUP BY ALL""")
def schema_path_norm(spark, sf):
    raw = F.format_string("items[%d].tax[%d].rate", "l_linenumber", F.col("l_linenumber") + 1)
    return testbed.table(spark, sf, "lineitem").groupBy("l_returnflag", paths.schema_path(raw).alias("path")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = "SELECT c_custkey, c_mktsegment, c_name AS gold, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN concat(substr(c_name, 1, 4), 'x', substr(c_name, 6)) ELSE concat('zz', substr(c_name, 12)) END AS pred FROM {customer}"
_NLS = "(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


@query(f"""WITH p AS ({portable(_PAIRS)}), s AS (SELECT *, {_NLS.format(a='lower(pred)', b='lower(gold)')} AS nls FROM p)
SELECT c_mktsegment, round(avg(CASE WHEN nls >= 0.5 THEN nls ELSE 0.0 END), 6) AS anls, round(avg(levenshtein(pred, gold)::DOUBLE / length(gold)), 6) AS cer FROM s GROUP BY 1""")
def anls_cer(spark, sf):
    p = rendered(spark, sf, _PAIRS)
    pred, gold = F.col("pred"), F.col("gold")
    return r6(p.groupBy("c_mktsegment").agg(F.avg(text.anls_term(pred, gold)).alias("anls"), F.avg(text.cer(pred, gold)).alias("cer")), "anls", "cer")


@query("""WITH p AS (SELECT p_partkey, string_split(p_name || ' of size ' || p_size::VARCHAR, ' ') AS g FROM part)
SELECT p_partkey, round((CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE / len(g), 6) AS wer FROM p""")
def wer_names(spark, sf):
    """Part titles with a word exchanged in every third and one added in every fifth."""
    p = testbed.table(spark, sf, "part")
    gold = F.concat_ws(" ", "p_name", F.lit("of size"), "p_size")
    pred = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit("at size")).otherwise(F.lit("of size")), "p_size", F.when(F.col("p_partkey") % 5 == 0, F.lit("extra")))
    return r6(p.select("p_partkey", text.wer(pred, gold).alias("wer")), "wer")


@query("""
WITH RECURSIVE t AS (
  SELECT event_id, '' AS path, props::JSON AS v FROM events WHERE props IS NOT NULL
  UNION ALL
  SELECT t.event_id, CASE WHEN t.path = '' THEN e.key ELSE t.path || '.' || e.key END, e.value FROM t, json_each(t.v) e WHERE json_type(t.v) = 'OBJECT'
)
SELECT event_id, path, v->>'$' AS value FROM t WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""")
def flatten_props(spark, sf):
    return paths.flatten_json(testbed.table(spark, sf, "events"), "event_id", "props").select("event_id", "path", "value")


# ---------------------------------------------------------------- extraction, grounding

_LINES = f"""inv AS ({INV}),
ln AS (SELECT doc_id, unnest(range(0, len(s))) AS line, unnest(s) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM inv)),
lab(ord, path, nth, label) AS (VALUES (0, 'invoice_id', 0, 'invoice id'), (1, 'customer', 0, 'customer'), (2, 'segment', 0, 'segment'), (3, 'priority', 0, 'priority'), (4, 'total', 0, 'total'), (5, 'status', 0, 'status'), (5, 'status', 1, 'state')),
hit AS (SELECT doc_id, ord, path, nth, line, trim(regexp_extract(content, '(?i)\\b' || label || '\\b(.*)$', 1), ' :') AS value FROM ln JOIN lab ON contains(lower(content), label) WHERE regexp_matches(content, '(?i)\\b' || label || '\\b')),
ext AS (SELECT doc_id, ord, path, value, line FROM hit WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY nth, line) = 1)"""


@query(f"WITH {_LINES} SELECT doc_id, ord, path, value, 0 AS page, line FROM ext")
def extract_label_search(spark, sf):
    return extract.text_search(invoices(spark, sf), extract.schema_table(spark, INVOICE_SCHEMA))


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, line, unnest(range(0, len(s))) AS place, unnest(s) AS text, s FROM (SELECT doc_id, line, string_split(content, ' ') AS s FROM ln)),
b AS (SELECT *, least(0.98::DOUBLE, 0.02::DOUBLE + 0.012::DOUBLE * coalesce(list_sum(list_transform(s[1:place], lambda x: length(x) + 1)), 0)) AS x0, least(0.98::DOUBLE, line * 0.04::DOUBLE) AS y0 FROM w WHERE text <> '')
SELECT doc_id, 0 AS page, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, place) - 1 AS pos, text, round(x0, 6) AS x0, round(y0, 6) AS y0,
  round(least(0.99::DOUBLE, x0 + 0.012::DOUBLE * greatest(1, length(text))), 6) AS x1, round(least(0.99::DOUBLE, y0 + 0.9::DOUBLE * 0.04::DOUBLE), 6) AS y1 FROM b""")
def page_word_boxes(spark, sf):
    return r6(ingest.words(invoices(spark, sf)), "x0", "y0", "x1", "y1")


@query(f"""SELECT doc_id, page, text, CASE WHEN pos % 2 = 0 THEN 0.5 ELSE 0.9 END AS score, x0, y0, x1, y1 FROM ({ORACLES['page_word_boxes']}) WHERE doc_id % 11 <> 0""")
def layout_replies(spark, sf):
    """Words of the invoices as a vision model's layout replies, every second
    item without a score and every eleventh reply broken, read back to tokens."""
    score = lambda pos: F.when(pos % 2 == 0, F.lit(0.5)).alias("score")
    bbox = lambda b: F.array(b["x0"] * 800, b["y0"] * 1000, b["x1"] * 800, b["y1"] * 1000).alias("bbox")
    item = lambda w, pos: F.struct(pos.alias("pos"), bbox(ingest.word_box(w)), w["text"].alias("text"), score(pos))
    pages = ingest.word_lists(invoices(spark, sf)).select("doc_id", "page", F.to_json(F.transform("words", item)).alias("reply"), F.lit(800).alias("width"), F.lit(1000).alias("height"))
    pages = pages.withColumn("reply", F.when(F.col("doc_id") % 11 == 0, F.substring("reply", 2, 1 << 20)).otherwise(F.col("reply")))
    return r6(datasets.layout_tokens(pages).select("doc_id", "page", "text", "score", "bbox.*"), "x0", "y0", "x1", "y1")


_MATCH = "regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({v}, '\\s+', ' ', 'g'))), '[$€£¥₹]', '', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"
_GROUND = f"""w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, place) AS i, {_MATCH.format(v='tok')} AS t FROM (SELECT doc_id, line, unnest(range(0, len(s))) AS place, unnest(s) AS tok FROM (SELECT doc_id, line, string_split(content, ' ') AS s FROM ln)) WHERE tok <> ''),
tg AS (SELECT doc_id, path, {_MATCH.format(v='value')} AS target FROM ext),
sp AS (SELECT doc_id, path, target, unnest(range(0, len(string_split(target, ' ')))) AS o, unnest(string_split(target, ' ')) AS tok, len(string_split(target, ' ')) AS n FROM tg),
g AS (SELECT doc_id, path, count(*) AS places FROM (SELECT sp.doc_id, path, w.i - o AS s, n FROM sp JOIN w ON w.doc_id = sp.doc_id AND w.t = sp.tok GROUP BY 1, 2, 3, 4 HAVING count(*) = n) GROUP BY 1, 2)"""


@query(f"""WITH {_LINES}, {_GROUND}
SELECT e.doc_id, e.path, e.value, CASE WHEN 1.0 / places >= 0.5 THEN round(1.0 / places, 6) END AS support, round(CASE WHEN 1.0 / places >= 0.5 THEN 1.0 / places ELSE 0.0 END, 6) AS confidence,
  CASE WHEN coalesce(1.0 / places, 0) >= 0.8 THEN 'accept' ELSE 'review' END AS decision FROM ext e LEFT JOIN g USING (doc_id, path)""")
def verify_invoices(spark, sf):
    out = verify.verify(*of_documents(spark, sf, testbed.INVOICES), extract.schema_table(spark, INVOICE_SCHEMA))
    return r6(out.select("doc_id", "path", "value", "support", "confidence", "decision"), "support", "confidence")


_FUZZY = f"""inv AS ({INV}), ln AS (SELECT doc_id, unnest(range(0, len(s))) AS line, unnest(s) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM inv)), ext AS (SELECT doc_id, path || '#' || run AS path, value FROM ({PRED}) WHERE value IS NOT NULL), {_GROUND},
wn AS (SELECT doc_id, i, t AS t1, lead(t) OVER d AS t2, lead(t, 2) OVER d AS t3, lead(t, 3) OVER d AS t4 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, k, CASE k WHEN 1 THEN t1 WHEN 2 THEN t1 || ' ' || t2 WHEN 3 THEN t1 || ' ' || t2 || ' ' || t3 ELSE t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 END AS txt FROM wn CROSS JOIN range(1, 5) r(k)),
op AS (SELECT tg.*, len(string_split(target, ' ')) AS n FROM tg ANTI JOIN g USING (doc_id, path) WHERE target <> ''),
st AS (SELECT op.doc_id, path, target, n, w.i FROM op JOIN w USING (doc_id) WHERE n = 1
  UNION SELECT DISTINCT op.doc_id, op.path, op.target, op.n, greatest(1, w.i - r.o) FROM op JOIN sp USING (doc_id, path) JOIN w ON w.doc_id = op.doc_id AND w.t = sp.tok JOIN range(0, 4) r(o) ON r.o <= op.n WHERE op.n > 1),
sm AS (SELECT st.doc_id, path, i, k, 1.0::DOUBLE - levenshtein(txt, target)::DOUBLE / greatest(length(txt), length(target)) AS score FROM st JOIN win USING (doc_id, i) WHERE k <= n + 1 AND txt IS NOT NULL),
bs AS (SELECT doc_id, path, max(score) AS best FROM sm GROUP BY 1, 2), nb AS (SELECT doc_id, path, best, count(*) AS n FROM sm JOIN bs USING (doc_id, path) WHERE score >= best - 1e-9 AND best > 0 GROUP BY 1, 2, 3),
al AS (SELECT doc_id, path, 1.0::DOUBLE / places AS s FROM g UNION ALL SELECT doc_id, path, best / n FROM nb)"""


@query(f"""WITH {_FUZZY}
SELECT e.doc_id, e.path, e.value, CASE WHEN s >= 0.5 THEN round(s, 6) END AS support, CASE WHEN s >= 0.5 THEN 0 END AS page FROM (SELECT doc_id, path || '#' || run AS path, value FROM ({PRED})) e LEFT JOIN al USING (doc_id, path)""")
def ground_fuzzy(spark, sf):
    """Corrupted values of all runs against the invoices' words."""
    p, inv = of_documents(spark, sf, testbed.PREDICTIONS, testbed.INVOICES)
    g = ground.ground(p.select("doc_id", F.concat_ws("#", "path", "run").alias("path"), "value"), ingest.page_texts(inv))
    return r6(g.select("doc_id", "path", "value", "support", "page"), "support")


@query(f"""WITH inv AS ({INV}), p AS (SELECT doc_id, path, value FROM ({PRED}) WHERE run = 0 AND value IS NOT NULL),
t AS (SELECT p.*, list_filter(regexp_split_to_array(lower(replace(path, '_', ' ') || ' is ' || value), '[^\\p{{L}}\\p{{N}}.]+'), lambda w: w <> '') AS h, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}.]+'), lambda w: w <> '') AS q FROM p JOIN inv USING (doc_id))
SELECT doc_id, path, round(len(list_filter(h, lambda w: list_contains(q, w)))::DOUBLE / len(h), 6) AS entailment FROM t""")
def entailment_lexical(spark, sf):
    p = predictions(spark, sf).where("run = 0 AND value IS NOT NULL").join(invoices(spark, sf), "doc_id")
    return r6(p.select("doc_id", "path", ground.lexical_entailment(F.col("text"), ground.hypothesis(F.col("path"), F.col("value"))).alias("entailment")), "entailment")


_RULE = r"^\s*([A-Za-z][\w /&.#-]{0,40}?)\s*:\s*(\S.*?)\s*$"
_INFER = rf"""nm AS (SELECT doc_id, line, lower(regexp_extract(content, '{_RULE}', 1)) AS label, regexp_extract(content, '{_RULE}', 2) AS v FROM ln WHERE regexp_matches(content, '{_RULE}')),
fs AS (SELECT *, trim(regexp_replace(label, '[^a-z0-9]+', '_', 'g'), '_') AS path, regexp_matches(label, 'id|no|number|ref|invoice|order|#') AS is_id FROM nm QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY line) = 1),
sc AS (SELECT doc_id, line AS ord, path, NOT is_id AND regexp_matches(v, '^[$€£]?\s?-?[\d,]+(\.\d+)?\s?%?$') AS num, is_id OR regexp_matches(v, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$|^\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}$') AS ex FROM fs WHERE path <> '')"""


@query(f"WITH {_LINES}, {_INFER} SELECT doc_id, ord, path, CASE WHEN num THEN 'number' ELSE 'string' END AS type, CASE WHEN num THEN 'numeric' WHEN ex THEN 'exact' ELSE 'semantic' END AS scoring, CASE WHEN num THEN 0.01 ELSE 1e-6 END AS numeric_tol FROM sc")
def schema_inference(spark, sf):
    return extract.infer_schema(invoices(spark, sf)).drop("required", "aliases")


@query(f"""WITH p AS (SELECT doc_id, path, value, instr(lower(text), lower(value)) AS found FROM ({PRED}) JOIN ({INV}) USING (doc_id) WHERE run = 0 AND value IS NOT NULL)
SELECT doc_id, path, CASE WHEN found > 0 THEN found - 1 END AS start_, CASE WHEN found > 0 THEN found - 1 + length(value) END AS end_ FROM p""")
def char_spans(spark, sf):
    p = predictions(spark, sf).where("run = 0 AND value IS NOT NULL").join(invoices(spark, sf), "doc_id")
    s = p.select("doc_id", "path", ground.char_span(F.col("text"), F.lower("value")).alias("s"))
    return s.select("doc_id", "path", F.col("s.start").alias("start_"), F.col("s.end").alias("end_"))


# ---------------------------------------------------------------- scoring

_RUN0 = f"p AS (SELECT * FROM ({PRED}) WHERE run = 0), g AS ({GOLD})"
_CORRECT = f"""fo AS (SELECT p.*, g.value AS gold, g.path IS NOT NULL AS known,
  CASE WHEN g.path IS NULL THEN 0 WHEN scoring = 'numeric' THEN CASE WHEN coalesce(abs(try_cast(replace(p.value, '$', '') AS DOUBLE) - try_cast(g.value AS DOUBLE)) <= numeric_tol, false) THEN 1 ELSE 0 END
       WHEN scoring = 'exact' THEN CASE WHEN lower(trim(p.value)) = lower(trim(g.value)) THEN 1 ELSE 0 END
       ELSE CASE WHEN {_NLS.format(a='lower(trim(p.value))', b='lower(trim(g.value))')} >= 0.5 THEN 1 ELSE 0 END END AS correct
  FROM p LEFT JOIN g USING (doc_id, path) WHERE p.value IS NOT NULL)"""
_SCORES = """SELECT {by} coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(n_correct, 0) AS n_correct,
  round(CASE WHEN n_pred > 0 THEN n_correct / n_pred ELSE 0 END, 6) AS precision, round(CASE WHEN n_gold > 0 THEN coalesce(n_correct, 0) / n_gold ELSE 0 END, 6) AS recall,
  round(CASE WHEN n_correct > 0 THEN 2.0 * n_correct / (n_pred + n_gold) ELSE 0 END, 6) AS f1, round(coalesce(n_exact, 0) / n_gold, 6) AS exact_match_rate,
  round(coalesce(n_omitted, 0) / n_gold, 6) AS omission_rate, round(CASE WHEN n_pred > 0 THEN n_hall / n_pred ELSE 0 END, 6) AS hallucination_rate"""
_COUNTS = """a AS (SELECT {by} count(*) AS n_pred, sum(correct)::BIGINT AS n_correct, sum(CASE WHEN known AND lower(trim(value)) = lower(trim(gold)) THEN 1 ELSE 0 END)::BIGINT AS n_exact, sum(CASE WHEN known THEN 0 ELSE 1 END)::BIGINT AS n_hall FROM fo {group}),
b AS (SELECT {by} count(*) AS n_gold FROM g {group}), c AS (SELECT {by} count(*) AS n_omitted FROM g ANTI JOIN fo USING (doc_id, path) {group})"""
_RATES = ("precision", "recall", "f1", "exact_match_rate", "omission_rate", "hallucination_rate")


@query(f"WITH {_RUN0}, {_CORRECT}, {_COUNTS.format(by='doc_id,', group='GROUP BY doc_id')} {_SCORES.format(by='doc_id,')} FROM b FULL JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)")
def score_per_document(spark, sf):
    return r6(extraction_metrics.score(predictions(spark, sf).where("run = 0"), golds(spark, sf), ["doc_id"]), *_RATES)


@query(f"WITH {_RUN0}, {_CORRECT}, {_COUNTS.format(by='', group='')} {_SCORES.format(by='')} FROM a, b, c")
def score_micro(spark, sf):
    return r6(extraction_metrics.score(predictions(spark, sf).where("run = 0"), golds(spark, sf), []), *_RATES)


@query(f"WITH {_RUN0} SELECT g.doc_id, g.path, g.value FROM g ANTI JOIN (SELECT * FROM p WHERE value IS NOT NULL) q USING (doc_id, path)")
def omitted_paths(spark, sf):
    return extraction_metrics.omitted(predictions(spark, sf).where("run = 0"), golds(spark, sf)).select("doc_id", "path", "value")


@query(f"WITH {_RUN0} SELECT p.doc_id, p.path, p.value FROM p ANTI JOIN g USING (doc_id, path) WHERE p.value IS NOT NULL")
def hallucinated_paths(spark, sf):
    return extraction_metrics.hallucinated(predictions(spark, sf).where("run = 0"), golds(spark, sf)).select("doc_id", "path", "value")


def _item_rows(spark, sf):
    """Order lines as array items; the prediction has them in reverse."""
    li = testbed.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    cell = lambda i, name, c: F.struct(F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{name}")).alias("path"), c.alias("value"))
    at = F.col("l_linenumber") - 1
    g = li.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(cell(at, "qty", F.col("q").cast("int").cast("string")), cell(at, "flag", F.col("f")))).alias("c")).select("doc_id", "c.*")
    p = li.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(cell(7 - F.col("l_linenumber"), "qty", F.col("q").cast("int").cast("string")), cell(7 - F.col("l_linenumber"), "flag", F.col("f")))).alias("c")).select("doc_id", "c.*")
    return p, g.withColumn("scoring", F.lit("exact")).withColumn("numeric_tol", F.lit(0.0))


_ITEMS = """li AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(CAST(max(l_quantity) AS INT) AS VARCHAR) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
pi AS (SELECT doc_id, 7 - n AS i, q, f FROM li), gi AS (SELECT doc_id, n - 1 AS j, q, f FROM li)"""


@query(f"WITH {_ITEMS} SELECT doc_id, 'items' AS prefix, i, j, round(((pi.q = gi.q)::INT + (pi.f = gi.f)::INT) / 2.0, 6) AS sim FROM pi JOIN gi USING (doc_id) WHERE pi.q = gi.q OR pi.f = gi.f")
def item_similarity(spark, sf):
    return r6(extraction_metrics.item_similarity(*_item_rows(spark, sf)), "sim")


@query()
def align_arrays(spark, sf):
    p, g = _item_rows(spark, sf)
    return r6(extraction_metrics.score(extraction_metrics.aligned(p, g), g, ["doc_id"]), *_RATES)


# ---------------------------------------------------------------- signals

_VOTES = f"""pr AS (SELECT *, CASE WHEN value IS NULL THEN '<omit>' ELSE lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) END AS vote FROM ({PRED})),
paths AS (SELECT DISTINCT doc_id, path FROM pr WHERE run < {{k}}), v AS (SELECT p.doc_id, p.path, r.run, coalesce(pr.vote, '<omit>') AS vote, pr.value, pr.support FROM paths p CROSS JOIN range(0, {{k}}) r(run) LEFT JOIN pr ON pr.doc_id = p.doc_id AND pr.path = p.path AND pr.run = r.run),
m AS (SELECT doc_id, path, vote, count(*) AS n, min(run) AS first, arg_min(value, run) AS value FROM v GROUP BY 1, 2, 3),
mode_ AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY n DESC, first) = 1)"""


@query(f"WITH {_VOTES.format(k=5)} SELECT doc_id, path, value, round(n / 5, 6) AS agreement, n AS n_votes FROM mode_")
def consensus_k5(spark, sf):
    return r6(signals.consensus(*of_documents(spark, sf, testbed.PREDICTIONS), 5).select("doc_id", "path", "value", "agreement", "n_votes"), "agreement")


_OPEN = "o{k} AS (WITH " + _VOTES + " SELECT doc_id, max(CASE WHEN abs(n / {k} - 0.5) <= 0.25 THEN 1 ELSE 0 END) AS open FROM mode_ GROUP BY 1)"


@query("WITH " + ", ".join(_OPEN.format(k=k) for k in (2, 3, 4)) + f"""
SELECT d.doc_id, CASE WHEN coalesce(o2.open, 0) = 0 THEN 2 WHEN coalesce(o3.open, 0) = 0 THEN 3 WHEN coalesce(o4.open, 0) = 0 THEN 4 ELSE 5 END AS k
FROM (SELECT DISTINCT doc_id FROM ({PRED})) d LEFT JOIN o2 USING (doc_id) LEFT JOIN o3 USING (doc_id) LEFT JOIN o4 USING (doc_id)""")
def adaptive_k(spark, sf):
    return signals.adaptive_consensus(*of_documents(spark, sf, testbed.PREDICTIONS))


@query(f"""WITH p AS (SELECT *, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS vote FROM ({PRED}) WHERE value IS NOT NULL),
e AS (SELECT doc_id, path, vote, count(*) AS n, max(coalesce(support, 0)) AS s, min(run) AS first FROM p GROUP BY 1, 2, 3),
w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY n DESC, s DESC, first) = 1),
b AS (SELECT p.doc_id, p.path, p.value, p.support, w.n, w.vote FROM p JOIN w USING (doc_id, path, vote) QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.path ORDER BY coalesce(p.support, 0) DESC, run) = 1)
SELECT doc_id, path, value, support, round(n / 5, 6) AS agreement, round(CASE WHEN support IS NULL THEN n / 5 ELSE (0.5 * n / 5 + 0.3 * support) / 0.8 END, 6) AS confidence,
  (SELECT count(*) FROM e WHERE e.doc_id = b.doc_id AND e.path = b.path AND e.vote <> b.vote) AS n_dissent FROM b""")
def ensemble_adjudicate(spark, sf):
    out = signals.adjudicate(predictions(spark, sf), 5)
    return r6(out.select("doc_id", "path", "value", "support", "agreement", "confidence", F.size("dissent").cast("long").alias("n_dissent")), "agreement", "confidence")


@query(f"""SELECT doc_id, path, round(exp((ln(verbalized) + ln(0.9) + ln(0.97)) / 3), 6) AS token_prob, round(least(verbalized, 0.9), 6) AS token_min, round(support, 6) AS grounding, verbalized,
  round((coalesce(0.3 * support, 0) + 0.1 * exp((ln(verbalized) + ln(0.9) + ln(0.97)) / 3) + 0.1 * verbalized) / (CASE WHEN support IS NULL THEN 0.2 ELSE 0.5 END), 6) AS combined FROM ({PRED}) WHERE run = 0""")
def signals_wide(spark, sf):
    p = predictions(spark, sf).where("run = 0")
    logs = F.array(F.log("verbalized"), F.log(F.lit(0.9)), F.log(F.lit(0.97)))
    fused = signals.combined({"grounding": F.col("support"), "token_prob": signals.token_prob(logs), "verbalized": signals.verbalized(F.col("verbalized"))})
    out = p.select("doc_id", "path", signals.token_prob(logs).alias("token_prob"), signals.token_prob(logs, "min").alias("token_min"), F.col("support").alias("grounding"), "verbalized", fused.alias("combined"))
    return r6(out, "token_prob", "token_min", "grounding", "combined")


# ---------------------------------------------------------------- calibration metrics

_O = f"o AS ({OUT})"
_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in cm.edges(15)) + "]"
_BIN = f"len(list_filter({_EDGES}, lambda e: e < conf))"


@query(f"WITH {_O} SELECT signal, {_BIN} AS bin, round(avg(conf), 11) AS mean_confidence, round(avg(correct), 11) AS accuracy, count(*) AS count FROM o GROUP BY 1, 2")
def reliability_bins(spark, sf):
    # eleven places: means of two hundredths may lie on the border of a sixth place
    bins = cm.reliability_bins(outcomes(spark, sf), ["signal"])
    return bins.withColumns({c: F.round(c, 11) for c in ("mean_confidence", "accuracy")})


@query(f"WITH {_O}, b AS (SELECT signal, {_BIN} AS bin, abs(avg(correct) - avg(conf)) AS gap, count(*) AS n FROM o GROUP BY 1, 2) SELECT signal, round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY 1")
def ece_mce(spark, sf):
    return r6(cm.ece_mce(outcomes(spark, sf), ["signal"]), "ece", "mce")


@query(f"""WITH {_O}, b AS (SELECT *, ntile(15) OVER (PARTITION BY signal ORDER BY conf, ord) AS t FROM o), c AS (SELECT signal, t, abs(sum(correct) - sum(conf)) AS g, count(*) AS n FROM b GROUP BY 1, 2)
SELECT signal, round(sum(g) / sum(n), 6) AS adaptive_ece FROM c GROUP BY 1""")
def adaptive_ece(spark, sf):
    return r6(cm.adaptive_ece(outcomes(spark, sf), ["signal"]), "adaptive_ece")


@query(f"""WITH {_O}, q AS (SELECT *, least(1 - 1e-12, greatest(1e-12, conf)) AS p FROM o)
SELECT signal, round(avg((conf - correct) * (conf - correct)), 6) AS brier, round(avg(-(correct * ln(p) + (1 - correct) * ln(1 - p))), 6) AS nll FROM q GROUP BY 1""")
def brier_nll(spark, sf):
    return r6(cm.proper_scores(outcomes(spark, sf), ["signal"]), "brier", "nll")


_TIES = "t AS (SELECT {by} conf, count(*) AS n, sum(correct)::BIGINT AS pos, sum(1 - correct)::BIGINT AS err FROM o GROUP BY ALL)"
_CUM = "c AS (SELECT *, sum(n) OVER w AS k, sum(err) OVER w AS ke, sum(n) OVER (PARTITION BY {p}) AS n_all FROM t WINDOW w AS (PARTITION BY {p} ORDER BY conf DESC ROWS UNBOUNDED PRECEDING))"


@query(f"""WITH {_O}, {_TIES.format(by='signal,')}, h AS (SELECT signal, sum(n) AS n_all, greatest(1e-3, 0.15 * pow(sum(n)::DOUBLE, -0.2)) AS h FROM t GROUP BY 1),
w AS (SELECT a.signal, a.conf, a.n, h.n_all, sum(exp(-0.5 * pow((a.conf - b.conf) / h.h, 2)) * (b.pos - b.conf * b.n)) / sum(exp(-0.5 * pow((a.conf - b.conf) / h.h, 2)) * b.n) AS rhat
  FROM t a JOIN h USING (signal) JOIN t b ON a.signal = b.signal GROUP BY 1, 2, 3, 4)
SELECT signal, round(sum(abs(rhat) * n) / max(n_all), 6) AS smooth_ece FROM w GROUP BY 1""")
def smooth_ece(spark, sf):
    return r6(cm.smooth_ece(outcomes(spark, sf), ["signal"]), "smooth_ece")


@query(f"""WITH {_O}, {_TIES.format(by='signal,')}, {_CUM.format(p='signal')}, d AS (SELECT *, sum((1 - conf) * n) OVER (PARTITION BY signal ORDER BY conf DESC ROWS UNBOUNDED PRECEDING) / k AS doubt FROM c),
a AS (SELECT signal, alpha, arg_max(ke / k, k) FILTER (doubt <= alpha) AS risk FROM d CROSS JOIN (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE)) x(alpha) GROUP BY 1, 2)
SELECT signal, round(avg(abs(coalesce(risk, 0) - alpha)), 6) AS tce FROM a GROUP BY 1""")
def tce(spark, sf):
    return r6(cm.tce(outcomes(spark, sf), ["signal"], [0.1, 0.2, 0.3, 0.4]), "tce")


# ---------------------------------------------------------------- selective metrics

_RANK = "r AS (SELECT *, row_number() OVER w AS k, sum(1 - correct) OVER w AS ke, count(*) OVER (PARTITION BY signal) AS n_all, sum(correct) OVER (PARTITION BY signal) AS pos_all FROM o WINDOW w AS (PARTITION BY signal ORDER BY conf DESC, ord ROWS UNBOUNDED PRECEDING))"
_A = "CROSS JOIN (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) x(alpha)"


@query(f"WITH {_O}, {_RANK} SELECT signal, ord, round(k / n_all, 6) AS coverage, round(ke / k, 6) AS risk FROM r")
def rc_curve(spark, sf):
    return r6(selective_metrics.rc_curve(outcomes(spark, sf), ["signal"]), "coverage", "risk")


@query(f"""WITH {_O}, {_RANK} SELECT signal, round(avg(ke / k), 6) AS aurc, round(avg(greatest(0, k - pos_all) / k), 6) AS oracle_aurc, round(avg(ke / k - greatest(0, k - pos_all) / k), 6) AS e_aurc, round(avg(ke / n_all), 6) AS augrc FROM r GROUP BY 1""")
def aurc_family(spark, sf):
    return r6(selective_metrics.aurc_family(outcomes(spark, sf), ["signal"]), "aurc", "oracle_aurc", "e_aurc", "augrc")


@query(f"""WITH {_O}, {_TIES.format(by='signal,')}, {_CUM.format(p='signal')} SELECT signal, alpha, round(coalesce(max(k) FILTER (ke / k <= alpha) / max(n_all), 0), 6) AS coverage, min(conf) FILTER (ke / k <= alpha) AS threshold FROM c {_A} GROUP BY 1, 2""")
def coverage_at_risk(spark, sf):
    return r6(selective_metrics.coverage_at_risk(outcomes(spark, sf), ["signal"], ALPHAS), "coverage")


@query(f"""WITH {_O}, {_RANK} SELECT signal, coverage, round(ke / k, 6) AS risk, round(1 - ke / k, 6) AS accuracy FROM r JOIN (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) x(coverage) ON k = ceil(coverage * n_all)""")
def risk_at_coverage(spark, sf):
    return r6(selective_metrics.risk_at_coverage(outcomes(spark, sf), ["signal"], [0.5, 0.75, 1.0]), "risk", "accuracy")


_DET = """u AS (SELECT *, sum(err) OVER w AS tp, sum(pos) OVER w AS fp, sum(err) OVER (PARTITION BY {p}) AS p_all, sum(pos) OVER (PARTITION BY {p}) AS neg_all FROM t WINDOW w AS (PARTITION BY {p} ORDER BY conf ROWS UNBOUNDED PRECEDING))"""
_AUROC = "sum(err * (neg_all - fp + 0.5 * pos)) / max(p_all * neg_all)"


@query(f"""WITH {_O}, {_TIES.format(by='signal,')}, {_DET.format(p='signal')} SELECT signal, round({_AUROC}, 6) AS auroc, round(sum(tp / (tp + fp) * err) / max(p_all), 6) AS aupr, round(min(fp / neg_all) FILTER (tp >= 0.95 * p_all), 6) AS fpr_at_tpr FROM u GROUP BY 1""")
def detection_metrics(spark, sf):
    return r6(selective_metrics.detection(outcomes(spark, sf), ["signal"]), "auroc", "aupr", "fpr_at_tpr")


@query(f"WITH {_O} SELECT signal, round(avg((conf >= 0.8)::INT), 6) AS accept_rate FROM o GROUP BY 1")
def accept_rate(spark, sf):
    return r6(selective_metrics.acceptance(outcomes(spark, sf), ["signal"], 0.8), "accept_rate")


# ---------------------------------------------------------------- conformal

_GRP = {
    "grounded": "CASE WHEN support >= 0.5 THEN 'grounded' ELSE 'ungrounded' END",
    "support_bin": "CASE WHEN support IS NULL THEN 'ungrounded' WHEN support < 0.5 THEN 'supp0' WHEN support < 0.8 THEN 'supp1' ELSE 'supp2' END",
    "value_length": "CASE WHEN length(coalesce(value, '')) < 3 THEN 'len0' WHEN length(coalesce(value, '')) < 8 THEN 'len1' ELSE 'len2' END",
    "field_type": "CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty' WHEN try_cast(regexp_replace(value, '[^0-9.\\-]', '', 'g') AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'text' END",
}
_GRP |= {"grounded_x_length": f"{_GRP['grounded']} || '|' || {_GRP['value_length']}", "support_x_type": f"{_GRP['support_bin']} || '|' || {_GRP['field_type']}"}
_TAX = "x AS (" + " UNION ALL ".join(f"SELECT *, {i} AS rank_, '{k}' AS taxonomy, {g} AS grp FROM o" for i, (k, g) in enumerate(_GRP.items())) + ")"


@query(f"WITH {_O}, {_TAX} SELECT taxonomy, grp, count(*) AS n, sum(correct)::BIGINT AS n_correct FROM x GROUP BY 1, 2")
def group_taxonomies(spark, sf):
    counts = conformal.taxonomy_counts(outcomes(spark, sf), []).groupBy("taxonomy", "grp")
    return counts.agg(F.sum("n_rows").alias("n"), F.sum(F.col("correct") * F.col("n_rows")).cast("long").alias("n_correct"))


@query(f"""WITH {_O}, {_TIES.format(by='signal,')}, {_CUM.format(p='signal')} SELECT signal, alpha, min(conf) FILTER ((ke + 1) / (k + 1) <= alpha) AS threshold, round(1 - coalesce(max(k) FILTER ((ke + 1) / (k + 1) <= alpha) / max(n_all), 0), 6) AS abstention FROM c {_A} GROUP BY 1, 2""")
def conformal_thresholds(spark, sf):
    return r6(conformal.thresholds(outcomes(spark, sf), ["signal"], ALPHAS), "abstention")


def _fitted(rows: str, keys: str, name: str, alphas: str = _A) -> str:
    on = ", ".join(keys.split())
    return f"""{name}_t AS (SELECT {on}, conf, count(*) AS n, sum(1 - correct) AS err FROM {rows} GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER w AS k, sum(err) OVER w AS ke FROM {name}_t WINDOW w AS (PARTITION BY {on} ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT {on}, alpha, min(conf) FILTER ((ke + 1) / (k + 1) <= alpha) AS t FROM {name}_c {alphas} GROUP BY ALL)"""


_COVER = "round(avg(acc::INT), 6) AS coverage, round(CASE WHEN sum(acc::INT) > 0 THEN sum((acc AND correct = 0)::INT) / sum(acc::INT) ELSE 0 END, 6) AS risk"
_APPLY = "CASE WHEN own.alpha IS NULL THEN coalesce(conf >= pool.t, false) ELSE coalesce(conf >= own.t, false) END AS acc"


@query(f"""WITH {_O}, x AS (SELECT *, {_GRP['grounded']} AS grp FROM o), cal AS (SELECT * FROM x WHERE split = 'cal'), {_fitted('cal', 'signal grp', 'own')}, {_fitted('cal', 'signal', 'pool')},
y AS (SELECT x.signal, pool.alpha, correct, {_APPLY} FROM x JOIN pool USING (signal) LEFT JOIN own ON own.signal = x.signal AND own.grp = x.grp AND own.alpha = pool.alpha WHERE split = 'test')
SELECT signal, alpha, {_COVER} FROM y GROUP BY 1, 2""")
def grouped_conformal(spark, sf):
    rows = outcomes(spark, sf).withColumn("grp", conformal.grounded_group(F.col("support")))
    fitted = conformal.grouped_thresholds(rows.where("split = 'cal'"), ["signal"], "grp", ALPHAS)
    return r6(conformal.coverage_and_risk(conformal.apply_grouped(rows.where("split = 'test'"), fitted, ["signal"], "grp", ALPHAS), ["signal", "alpha"]), "coverage", "risk")


@query(f"""WITH {_O}, {_TAX}, cal AS (SELECT * FROM x WHERE split = 'cal'), {_fitted('cal', 'signal taxonomy grp', 'own')}, {_fitted('cal', 'signal taxonomy', 'pool')},
y AS (SELECT x.signal, x.taxonomy, pool.alpha, correct, {_APPLY} FROM x JOIN pool USING (signal, taxonomy) LEFT JOIN own ON own.signal = x.signal AND own.taxonomy = x.taxonomy AND own.grp = x.grp AND own.alpha = pool.alpha WHERE split = 'test'),
pc AS (SELECT * FROM o WHERE split = 'cal'), {_fitted('pc', 'signal', 'one')}, z AS (SELECT o.signal, 'pooled' AS taxonomy, alpha, correct, coalesce(conf >= t, false) AS acc FROM o JOIN one USING (signal) WHERE split = 'test')
SELECT signal, taxonomy, alpha, {_COVER} FROM (SELECT * FROM y UNION ALL SELECT * FROM z) GROUP BY 1, 2, 3""")
def grouping_ablation(spark, sf):
    rows = outcomes(spark, sf)
    return r6(conformal.ablation(rows.where("split = 'cal'"), rows.where("split = 'test'"), ["signal"], ALPHAS), "coverage", "risk")


@query(f"""WITH {_O}, {_TAX}, cal AS (SELECT * FROM x WHERE split = 'cal'), {_fitted('cal', 'signal taxonomy rank_ grp', 'own')},
y AS (SELECT x.signal, x.taxonomy, x.rank_, own.alpha, avg(coalesce(conf >= own.t, false)::INT) AS cov FROM x JOIN own USING (signal, taxonomy, rank_, grp) WHERE split = 'cal' GROUP BY ALL)
SELECT signal, alpha, taxonomy, round(cov, 6) AS coverage FROM y QUALIFY row_number() OVER (PARTITION BY signal, alpha ORDER BY cov DESC, rank_) = 1""")
def taxonomy_selector(spark, sf):
    return r6(conformal.select_taxonomy(outcomes(spark, sf).where("split = 'cal'"), ["signal"], ALPHAS), "coverage")


_U = "(('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0)"


@query(f"""WITH {_O}, x AS (SELECT *, {_GRP['grounded']} AS grp FROM o WHERE split = 'cal'), gs AS (SELECT signal, grp, count(*) AS n, avg(1.0 - correct) AS e FROM x GROUP BY 1, 2),
t AS (SELECT signal, grp, conf, count(*) AS n, sum(correct) AS pos, sum(1 - correct) AS err FROM x GROUP BY ALL), {_DET.format(p='signal, grp')}, au AS (SELECT signal, grp, {_AUROC} AS a FROM u GROUP BY 1, 2),
s AS (SELECT gs.signal, max(e) - min(e) AS sep, coalesce(avg(a) FILTER (n >= 4), 0.5) AS au, min(n) AS mn FROM gs JOIN au USING (signal, grp) GROUP BY 1),
hv AS (SELECT x.*, h, {_U.format(x="doc_id::VARCHAR || '|' || h::VARCHAR")} < 0.5 AS fit FROM x CROSS JOIN range(0, 5) r(h)), ft AS (SELECT * FROM hv WHERE fit),
{_fitted('ft', 'signal h grp', 'own', 'CROSS JOIN (VALUES (0.05::DOUBLE)) q(alpha)')}, {_fitted('ft', 'signal h', 'pool', 'CROSS JOIN (VALUES (0.05::DOUBLE)) q(alpha)')},
cv AS (SELECT hv.signal, hv.h, avg((CASE WHEN own.alpha IS NULL THEN coalesce(conf >= pool.t, false) ELSE coalesce(conf >= own.t, false) END)::INT) - avg(coalesce(conf >= pool.t, false)::INT) AS d
  FROM hv JOIN pool USING (signal, h) LEFT JOIN own ON own.signal = hv.signal AND own.h = hv.h AND own.grp = hv.grp WHERE NOT fit GROUP BY 1, 2), gn AS (SELECT signal, avg(d) AS gain FROM cv GROUP BY 1)
SELECT s.signal, round(sep, 6) AS error_separation, round(au, 6) AS within_group_auroc, mn AS min_group_size, round(gain, 6) AS predicted_gain, gain >= 0.02 AS recommend FROM s JOIN gn USING (signal)""")
def characterize_groups(spark, sf):
    rows = outcomes(spark, sf).where("split = 'cal'")
    return r6(conformal.characterize(rows, ["signal"], conformal.grounded_group(F.col("support"))), "error_separation", "within_group_auroc", "predicted_gain")


# ---------------------------------------------------------------- calibrators


@query(f"""WITH {_O}, b AS (SELECT *, {_BIN} AS bin FROM o), f AS (SELECT signal, bin, avg(correct) AS a FROM b WHERE split = 'cal' GROUP BY 1, 2), w AS (SELECT signal, avg(correct) AS a FROM b WHERE split = 'cal' GROUP BY 1)
SELECT b.doc_id, b.signal, b.path, round(coalesce(f.a, w.a), 6) AS calibrated FROM b JOIN w USING (signal) LEFT JOIN f ON f.signal = b.signal AND f.bin = b.bin WHERE split = 'test'""")
def histogram_binning(spark, sf):
    rows = outcomes(spark, sf)
    fitted = calibrators.fit_histogram(rows.where("split = 'cal'"), ["signal"])
    return r6(calibrators.apply_histogram(rows.where("split = 'test'"), fitted, ["signal"]).select("doc_id", "signal", "path", "calibrated"), "calibrated")


def _each_signal(spark, sf, calibrator) -> DataFrame:
    out = None
    for name in ("token_prob", "verbalized", "grounding", "consensus", "combined"):
        rows = outcomes(spark, sf).where(F.col("signal") == name)
        one = calibrator(rows.where("split = 'cal'"), rows.where("split = 'test'")).select("doc_id", "signal", "path", "conf", "calibrated")
        out = one if out is None else out.unionByName(one)
    return r6(out, "calibrated")


@query()
def platt_scaling(spark, sf):
    return _each_signal(spark, sf, calibrators.platt)


@query()
def isotonic_calibration(spark, sf):
    return _each_signal(spark, sf, calibrators.isotonic)


@query()
def learned_combiner(spark, sf):
    # orders are dealt out before they become rows of signals, which then need no shuffle
    rows = rendered(spark, sf, testbed.OUTCOMES, orders=["o_orderkey", "o_orderstatus", "o_orderpriority"])
    each = [F.max(F.when(F.col("signal") == s, F.col("conf"))).alias(s) for s in calibrators.SIGNALS]
    wide = rows.groupBy("doc_id", "path", "split", "correct").agg(*each)
    return r6(calibrators.learned(wide.where("split = 'cal'"), wide.where("split = 'test'")).select("doc_id", "path", "combined"), "combined")


# ---------------------------------------------------------------- grounding metrics, tables

_BOXES = """SELECT l_orderkey AS doc_id, l_returnflag, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS has_gold, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE 1 END AS has_pred,
  CAST(l_orderkey * 7 % 50 AS DOUBLE) / 100 AS gx, CAST(l_partkey * 3 % 50 AS DOUBLE) / 100 AS gy, CAST((l_orderkey * 7 + l_linenumber) % 50 AS DOUBLE) / 100 AS px, CAST(l_partkey * 3 % 50 AS DOUBLE) / 100 AS py,
  CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS correct FROM {lineitem}"""


def _box_rows(spark, sf):
    rows = rendered(spark, sf, _BOXES.replace("/ 100", "/ CAST(100 AS DOUBLE)"))
    make = lambda x, y, flag: F.when(F.col(flag) == 1, boxes.box(F.col(x), F.col(y), F.col(x) + 0.25, F.col(y) + 0.25))
    return rows.withColumn("gold", make("gx", "gy", "has_gold")).withColumn("pred", make("px", "py", "has_pred"))


_IOU = f"""b AS ({portable(_BOXES)}), m AS (SELECT *, greatest(0, least(px + 0.25, gx + 0.25) - greatest(px, gx)) * greatest(0, least(py + 0.25, gy + 0.25) - greatest(py, gy)) AS i,
 (px + 0.25 - px) * (py + 0.25 - py) + (gx + 0.25 - gx) * (gy + 0.25 - gy) AS a FROM b), q AS (SELECT *, CASE WHEN has_gold = 0 THEN NULL WHEN has_pred = 0 THEN 0.0 WHEN i > 0 THEN i / (a - i) ELSE 0.0 END AS iou FROM m)"""


@query(f"WITH {_IOU} SELECT l_returnflag, round(coalesce(avg((iou >= 0.5)::INT), 0), 6) AS acc_50, round(coalesce(avg((iou >= 0.7)::INT), 0), 6) AS acc_70, round(coalesce(avg(iou) FILTER (has_pred = 1), 0), 6) AS mean_iou FROM q GROUP BY 1")
def box_iou(spark, sf):
    return r6(grounding_metrics.box_metrics(_box_rows(spark, sf), ["l_returnflag"]), "acc_50", "acc_70", "mean_iou")


@query(f"""WITH {_IOU} SELECT l_returnflag, round(avg(correct) FILTER (iou >= 0.5), 6) AS grounded_accuracy, round(avg(correct) FILTER (iou < 0.5), 6) AS ungrounded_accuracy, round(avg(correct) FILTER (iou >= 0.5) - avg(correct) FILTER (iou < 0.5), 6) AS gap,
  count(*) FILTER (iou >= 0.5) AS n_grounded, count(*) FILTER (iou < 0.5) AS n_ungrounded FROM q WHERE has_gold = 1 GROUP BY 1""")
def grounding_gap(spark, sf):
    return r6(grounding_metrics.grounding_gap(_box_rows(spark, sf), ["l_returnflag"]), "grounded_accuracy", "ungrounded_accuracy", "gap")


@query("""WITH s AS (SELECT l_returnflag, l_orderkey % 40 AS gs, l_orderkey % 40 + 10 AS ge, (l_orderkey + l_linenumber) % 40 AS ps, (l_orderkey + l_linenumber) % 40 + l_linenumber * 2 AS pe FROM lineitem)
SELECT l_returnflag, round(avg(2.0 * greatest(0, least(ge, pe) - greatest(gs, ps)) / ((ge - gs) + (pe - ps))), 6) AS span_f1 FROM s GROUP BY 1""")
def span_f1(spark, sf):
    li = testbed.table(spark, sf, "lineitem")
    at = (F.col("l_orderkey") + F.col("l_linenumber")) % 40
    gold = F.struct((F.col("l_orderkey") % 40).alias("start"), (F.col("l_orderkey") % 40 + 10).alias("end"))
    pred = F.struct(at.alias("start"), (at + F.col("l_linenumber") * 2).alias("end"))
    return r6(li.groupBy("l_returnflag").agg(F.avg(boxes.span_f1(pred, gold)).alias("span_f1")), "span_f1")


def _tables(spark, sf):
    """Each order's lines as a table of gold and predicted cells."""
    # lines are dealt out by order: what follows for an order needs no other shuffle
    lines = testbed.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").repartition("l_orderkey")
    li = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    cells = lambda q: F.array(F.struct(q.alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan")), F.struct(F.col("f").alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan")))
    gold, pred = F.col("q").cast("string"), F.when(F.col("l_linenumber") == 2, F.lit("9")).otherwise(F.col("q").cast("string"))
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("c")))), lambda x: x["c"])
    return li.groupBy("l_orderkey").agg(order(cells(gold)).alias("gold"), order(cells(pred)).alias("pred"))


def _html(grid: str):
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c["text"], F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(grid, row), ""), F.lit("</table>"))


@query()
def table_teds(spark, sf):
    t = _tables(spark, sf).select("l_orderkey", tables.teds_both(_html("pred"), _html("gold")).alias("both"))
    return r6(t.select("l_orderkey", "both.teds", "both.teds_struct"), "teds", "teds_struct")


@query()
def table_grits(spark, sf):
    kinds = {k: tables.grits(F.col("pred"), F.col("gold"), k) for k in ("con", "top")}
    t = _tables(spark, sf).select("l_orderkey", *(g.alias(k) for k, g in kinds.items()))
    out = t.select("l_orderkey", *(F.col(f"{k}.{m}").alias(f"{k}_{m}") for k in kinds for m in "prf"))
    return r6(out, *(c for c in out.columns if c != "l_orderkey"))


# ---------------------------------------------------------------- statistics, agreement

_W = "(" + " + ".join(f"({{u}} >= {t!r})::INT" for t in [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758851, 0.999989750803]) + ")"


_SEED = "('0x' || substr(md5({x}::VARCHAR), 1, 8))::BIGINT % 2147483647"
_X = "((h + (rep + 1) * 1640531527) % 2147483647)"
for _m, _k in zip(resampling.MULTIPLIERS, (15, 13, 16), strict=True):
    _X = f"list_transform([{_X}], lambda x: (xor(x, x >> {_k}) * {_m}) % 2147483647)[1]"
_DRAW = f"({_X} / 2147483647.0::DOUBLE)"


def _mean_ci(cluster: bool) -> str:
    key = "doc_id" if cluster else "ord"
    src = "(SELECT signal, doc_id, sum(correct) AS s, count(*) AS c FROM o GROUP BY 1, 2)" if cluster else "(SELECT signal, ord, correct AS s, 1 AS c FROM o)"
    return f"""WITH {_O}, d AS (SELECT signal, s, c, rep, {_DRAW} AS u FROM (SELECT *, {_SEED.format(x=key)} AS h FROM {src}) CROSS JOIN range(0, 2000) r(rep)), w AS (SELECT signal, s, c, rep, {_W.format(u='u')} AS w FROM d), st AS (SELECT signal, rep, sum(s * w) / sum(c * w) AS stat FROM w GROUP BY 1, 2)
SELECT e.signal, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT signal, avg(correct) AS estimate FROM o GROUP BY 1) e JOIN (SELECT signal, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM st GROUP BY 1) q USING (signal)"""


@query(_mean_ci(False))
def bootstrap_ci(spark, sf):
    return r6(resampling.bootstrap_mean(outcomes(spark, sf), ["signal"], "ord", F.col("correct")), "estimate", "lo", "hi")


@query(_mean_ci(True))
def cluster_bootstrap_ci(spark, sf):
    return r6(resampling.bootstrap_mean(outcomes(spark, sf), ["signal"], "doc_id", F.col("correct")), "estimate", "lo", "hi")


def _pairs(spark, sf):
    rows = outcomes(spark, sf).where("signal IN ('combined', 'verbalized')")
    of = lambda name: F.max(F.when(F.col("signal") == name, F.col("conf")))
    return rows.groupBy("doc_id", "path").agg(of("combined").alias("x"), of("verbalized").alias("y"))


_D = "d AS (SELECT a.doc_id, a.path, a.conf - b.conf AS d, {s} AS h FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.path = b.path WHERE a.signal = 'combined' AND b.signal = 'verbalized')"
_D = _D.format(s=_SEED.format(x="a.doc_id"))
_UD = _DRAW


@query(f"""WITH {_O}, {_D}, f AS (SELECT path, rep, avg(d * CASE WHEN {_UD} < 0.5 THEN -1 ELSE 1 END) AS t FROM d CROSS JOIN range(0, 10000) r(rep) GROUP BY 1, 2), s AS (SELECT path, avg(d) AS diff FROM d GROUP BY 1)
SELECT path, round(diff, 6) AS diff, round((sum((abs(t) >= abs(diff) - 1e-12)::INT) + 1) / 10001, 6) AS p FROM f JOIN s USING (path) GROUP BY path, diff""")
def permutation_test(spark, sf):
    return r6(resampling.paired_permutation(_pairs(spark, sf), ["path"], "doc_id"), "diff", "p")


@query(f"""WITH {_O}, {_D}, f AS (SELECT path, d, rep, {_W.format(u=_UD)} AS w FROM d CROSS JOIN range(0, 10000) r(rep)), m AS (SELECT path, rep, sum(d * w) / sum(w) AS t FROM f GROUP BY 1, 2), s AS (SELECT path, avg((t <= 0)::INT) AS le, avg((t >= 0)::INT) AS ge FROM m GROUP BY 1)
SELECT path, round(diff, 6) AS diff, round(least(1, 2 * least(le, ge)), 6) AS p FROM s JOIN (SELECT path, avg(d) AS diff FROM d GROUP BY 1) USING (path)""")
def paired_bootstrap_test(spark, sf):
    return r6(resampling.paired_bootstrap(_pairs(spark, sf), ["path"], "doc_id"), "diff", "p")


_PS = "SELECT p_brand AS fam, p_partkey AS ord, CAST((p_partkey * 7919 % 9973) AS DOUBLE) / CAST(997300 AS DOUBLE) AS p FROM {part}"


@query(f"""WITH t AS ({portable(_PS)}), s AS (SELECT *, (p > 0.05 / (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p, ord) + 1))::INT AS f FROM t)
SELECT fam, ord, p, max(f) OVER (PARTITION BY fam ORDER BY p, ord ROWS UNBOUNDED PRECEDING) = 0 AS reject FROM s""")
def holm_bonferroni(spark, sf):
    return resampling.holm(rendered(spark, sf, _PS), ["fam"])


_KAPPA = "CASE WHEN pe >= 1 THEN (po >= 1)::INT::DOUBLE ELSE (po - pe) / (1 - pe) END"


@query(f"""WITH n AS ({ANN}), b AS (SELECT x.annotator AS a, y.annotator AS b, x.label AS lx, y.label AS ly FROM n x JOIN n y USING (field_id) WHERE x.annotator < y.annotator),
t AS (SELECT a, b, count(*) AS n, avg((lx = ly)::INT) AS po, (sum(lx) * sum(ly) + sum(1 - lx) * sum(1 - ly)) / (count(*) * count(*)) AS pe FROM b GROUP BY 1, 2) SELECT a, b, n, round({_KAPPA}, 6) AS kappa FROM t""")
def cohen_kappa(spark, sf):
    return r6(agreement.cohen(rendered(spark, sf, testbed.ANNOTATIONS)), "kappa")


@query(f"""WITH n AS ({ANN}), i AS (SELECT field_id, sum(label) AS one, count(*) - sum(label) AS zero FROM n GROUP BY 1 HAVING count(*) = 3),
t AS (SELECT count(*) AS n_items, avg((one * one + zero * zero - 3) / 6) AS po, (sum(one) * sum(one) + sum(zero) * sum(zero)) / (sum(one + zero) * sum(one + zero)) AS pe FROM i)
SELECT n_items, 3 AS n_raters, round({_KAPPA}, 6) AS kappa, CASE WHEN {_KAPPA} < 0 THEN 'poor' WHEN {_KAPPA} <= 0.2 THEN 'slight' WHEN {_KAPPA} <= 0.4 THEN 'fair' WHEN {_KAPPA} <= 0.6 THEN 'moderate' WHEN {_KAPPA} <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM t""")
def fleiss_kappa(spark, sf):
    out = agreement.fleiss(rendered(spark, sf, testbed.ANNOTATIONS))
    return r6(out.withColumn("band", agreement.interpret(F.col("kappa"))), "kappa")


_BAND = "CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END"


_EXACT = ORACLES["cohen_kappa"].replace(f"round({_KAPPA}, 6)", _KAPPA)


@query(f"""WITH co AS ({_EXACT}), fl AS ({ORACLES['fleiss_kappa']}), al AS (SELECT 'pair' AS kind, a, b, n, kappa FROM co UNION ALL SELECT 'pairs', NULL, NULL, sum(n)::BIGINT, avg(kappa) FROM co UNION ALL SELECT 'all', NULL, NULL, n_items, kappa FROM fl)
SELECT kind, a, b, n, round(kappa, 6) AS kappa, {_BAND} AS band FROM al""")
def iaa_report(spark, sf):
    return r6(agreement.report(rendered(spark, sf, testbed.ANNOTATIONS)), "kappa")


# ---------------------------------------------------------------- plans


@query(f"""WITH {_O}, pc AS (SELECT * FROM o WHERE split = 'cal'), te AS (SELECT * FROM o WHERE split = 'test'), {_fitted('pc', 'signal', 'one')}, cv AS (SELECT te.signal, alpha, {_COVER} FROM (SELECT te.*, alpha, coalesce(conf >= t, false) AS acc FROM te JOIN one USING (signal)) te GROUP BY 1, 2),
t AS (SELECT signal, conf, count(*) AS n, sum(correct) AS pos, sum(1 - correct) AS err FROM te GROUP BY ALL), {_DET.format(p='signal')}, au AS (SELECT signal, round({_AUROC}, 6) AS auroc FROM u GROUP BY 1),
{_RANK.replace('FROM o WINDOW', 'FROM te WINDOW')}, ea AS (SELECT signal, round(avg(ke / k - greatest(0, k - pos_all) / k), 6) AS e_aurc FROM r GROUP BY 1),
bb AS (SELECT signal, {_BIN} AS bin, abs(avg(correct) - avg(conf)) AS gap, count(*) AS n FROM te GROUP BY 1, 2), ec AS (SELECT signal, round(sum(gap * n) / sum(n), 6) AS ece FROM bb GROUP BY 1)
SELECT signal, alpha, coverage, risk, auroc, e_aurc, ece, risk <= alpha + 1e-9 AS guarantee_held FROM cv JOIN au USING (signal) JOIN ea USING (signal) JOIN ec USING (signal)""")
def leaderboard(spark, sf):
    rows = outcomes(spark, sf)
    out = harness.leaderboard(rows.where("split = 'cal'"), rows.where("split = 'test'"), ALPHAS)
    return r6(out, "coverage", "risk", "auroc", "e_aurc", "ece")


@query(f"""WITH {_O}, v AS (SELECT o.*, s, {_U.format(x="doc_id::VARCHAR || '|' || s::VARCHAR")} < 0.5 AS fit FROM o CROSS JOIN range(0, 40) r(s)), ft AS (SELECT * FROM v WHERE fit), {_fitted('ft', 'signal s', 'one')},
e AS (SELECT v.signal, v.s, alpha, avg(coalesce(conf >= t, false)::INT) AS c, CASE WHEN sum(coalesce(conf >= t, false)::INT) > 0 THEN sum((coalesce(conf >= t, false) AND correct = 0)::INT) / sum(coalesce(conf >= t, false)::INT) ELSE 0 END AS k FROM v JOIN one USING (signal, s) WHERE NOT fit GROUP BY 1, 2, 3)
SELECT signal, alpha, round(avg(c), 6) AS coverage, round(avg(k), 6) AS risk FROM e GROUP BY 1, 2""")
def multi_split_conformal(spark, sf):
    return r6(harness.multi_split(outcomes(spark, sf), ["signal"], ALPHAS), "coverage", "risk")


_HALF = "coalesce(nullif({c}, 0), 0.5)"
_KEPT = """coalesce(0.5 * agreement, 0) + 0.3 * coalesce(sup, 0) + 0.1 * tp + 0.1 * verbalized"""
#: Runs of the test bed, their values grounded in the invoices, to outcomes of each signal.
_SIGNALS = f"""{_FUZZY},
{_VOTES.format(k=5)},
gr AS (SELECT pr.*, exp((ln(verbalized) + ln(0.9) + ln(0.97)) / 3) AS tp, CASE WHEN al.s >= 0.5 THEN al.s END AS sup FROM pr LEFT JOIN al ON al.doc_id = pr.doc_id AND al.path = pr.path || '#' || pr.run),
gd AS ({GOLD}),
bs0 AS (SELECT doc_id, path, ord, value, sup, tp, verbalized, NULL::DOUBLE AS agreement, false AS voted FROM gr WHERE run = 0
  UNION ALL SELECT m.doc_id, m.path, gr.ord, gr.value, gr.sup, gr.tp, gr.verbalized, m.n / 5, true FROM mode_ m JOIN gr ON gr.doc_id = m.doc_id AND gr.path = m.path AND gr.run = m.first WHERE m.vote <> '<omit>'),
{_CORRECT.replace('FROM p LEFT JOIN g USING', 'FROM bs0 AS p LEFT JOIN gd AS g USING')},
so AS (SELECT doc_id, path, ord, CASE WHEN known THEN 'matched' ELSE 'hallucinated' END AS status, correct, sup AS support, value, unnest(CASE WHEN voted THEN
    [{{{{'signal': 'consensus', 'conf': agreement}}}}, {{{{'signal': 'combined', 'conf': least(1.0, {_KEPT})}}}}]
    ELSE [{{{{'signal': 'token_prob', 'conf': {_HALF.format(c='tp')}}}}}, {{{{'signal': 'verbalized', 'conf': {_HALF.format(c='verbalized')}}}}}, {{{{'signal': 'grounding', 'conf': coalesce(sup, 0)}}}}] END, recursive := true) FROM fo)""".replace("{{", "{").replace("}}", "}")


def _runs(spark, sf) -> DataFrame:
    """All runs' values, grounded in the invoices."""
    logs = F.array(F.log("verbalized"), F.log(F.lit(0.9)), F.log(F.lit(0.97)))
    p, inv = of_documents(spark, sf, testbed.PREDICTIONS, testbed.INVOICES)
    p = p.select("doc_id", "run", "ord", "path", "value", "verbalized", signals.token_prob(logs).alias("token_prob"))
    return ground.ground(p, ingest.page_texts(inv)).drop("page", "bbox")


@query(f"WITH {_SIGNALS} SELECT doc_id, path, signal, round(conf, 6) AS conf, status, correct FROM so")
def harness_outcomes(spark, sf):
    return r6(harness.signal_outcomes(_runs(spark, sf), *of_documents(spark, sf, testbed.GOLDS), 5).select("doc_id", "path", "signal", "conf", "status", "correct"), "conf")


# confidences are rounded first, so that both sides agree on what is tied
_HARNESS = f"""{_SIGNALS}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY {_U.format(x="'0|' || doc_id::VARCHAR")}, doc_id) AS n, count(*) OVER () AS n_all FROM (SELECT DISTINCT doc_id FROM so)),
o AS (SELECT doc_id, path, doc_id * 10 + ord AS ord, signal, round(conf, 6) AS conf, correct, support, value, CASE WHEN n <= greatest(1, least(n_all - 1, round_even(n_all * 0.5, 0))) THEN 'cal' ELSE 'test' END AS split FROM so JOIN ids USING (doc_id))"""


def _harness_rows(spark, sf) -> DataFrame:
    rows = harness.signal_outcomes(_runs(spark, sf), *of_documents(spark, sf, testbed.GOLDS), 5).withColumn("ord", F.col("doc_id") * 10 + F.col("ord"))
    return kept(harness.exact_split(kept(r6(rows, "conf"), "outcomes")), "outcomes")


@query("WITH " + _HARNESS + ORACLES["leaderboard"][len(f"WITH {_O}"):])
def harness_leaderboard(spark, sf):
    """The leaderboard of signals from extractor runs, over an exact split."""
    rows = _harness_rows(spark, sf)
    out = harness.leaderboard(rows.where("split = 'cal'"), rows.where("split = 'test'"), ALPHAS)
    return r6(out, "coverage", "risk", "auroc", "e_aurc", "ece")


@query(f"""WITH {_O}, ids AS (SELECT doc_id, row_number() OVER (ORDER BY {_U.format(x="'3|' || doc_id::VARCHAR")}, doc_id) AS n, count(*) OVER () AS n_all FROM (SELECT DISTINCT doc_id FROM o))
SELECT doc_id, CASE WHEN n <= greatest(1, least(n_all - 1, round_even(n_all * 0.3, 0))) THEN 'cal' ELSE 'test' END AS split FROM ids""")
def exact_split(spark, sf):
    return harness.exact_split(outcomes(spark, sf), 0.3, 3).select("doc_id", "split").distinct()


_BOUND = f"""{_O}, {_TAX}, cal AS (SELECT *, {_U.format(x="doc_id::VARCHAR || '|7'")} < 0.5 AS fit FROM x WHERE split = 'cal'), ft AS (SELECT * FROM cal WHERE fit), {_fitted('ft', 'signal taxonomy rank_ grp', 'own')},
y AS (SELECT h.signal, a.alpha, h.taxonomy, h.rank_, h.correct, coalesce(h.conf >= own.t, false) AS acc FROM cal h CROSS JOIN (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}]) AS alpha) a
  LEFT JOIN own ON own.signal = h.signal AND own.taxonomy = h.taxonomy AND own.grp = h.grp AND own.alpha = a.alpha WHERE NOT fit),
z AS (SELECT signal, alpha, taxonomy, rank_, avg(acc::INT) AS coverage, CASE WHEN sum(acc::INT) > 0 THEN sum((acc AND correct = 0)::INT) / sum(acc::INT) ELSE 0 END AS risk FROM y GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM z WHERE risk <= alpha AND coverage > 0 QUALIFY row_number() OVER (PARTITION BY signal, alpha ORDER BY coverage DESC, rank_) = 1)"""


@query(f"WITH {_BOUND} SELECT k.signal, k.alpha, coalesce(taxonomy, 'pooled') AS taxonomy, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM (SELECT DISTINCT signal, alpha FROM y) k LEFT JOIN b USING (signal, alpha)")
def bounded_taxonomy(spark, sf):
    """The taxonomy with the most coverage among those that hold their risk on a held-out half."""
    rows = outcomes(spark, sf).where("split = 'cal'")
    fit = resampling.uniform(F.col("doc_id"), F.lit(7)) < 0.5
    counts = lambda part: conformal.taxonomy_counts(rows.where(part), ["signal"])
    return r6(offline.select_bounded(counts(fit), counts(~fit), ["signal"], ALPHAS), "coverage", "risk")


def _dump_rows(spark, sf) -> DataFrame:
    """The study's rows: fields of the test bed's vote, with lexical entailment for the model's."""
    p, g, inv = of_documents(spark, sf, testbed.PREDICTIONS, testbed.GOLDS, testbed.INVOICES)
    rows = offline.fields(p, g, 5).join(inv, "doc_id", "left")
    return rows.withColumn("entailment", F.coalesce("entailment", ground.lexical_entailment(F.col("text"), ground.hypothesis(F.col("path"), F.col("value"))))).drop("text")


_DUMP = f"""{_VOTES.format(k=5)}, gd AS ({GOLD}), vt AS (SELECT m.doc_id, m.path, pr.value, pr.verbalized, m.n / 5 AS consistency, pr.support FROM mode_ m JOIN pr ON pr.doc_id = m.doc_id AND pr.path = m.path AND pr.run = m.first WHERE m.vote <> '<omit>'),
{_CORRECT.replace('FROM p LEFT JOIN g USING', 'FROM vt AS p LEFT JOIN gd AS g USING')}, tx AS (SELECT fo.*, list_filter(regexp_split_to_array(lower(replace(path, '_', ' ') || ' is ' || value), '[^\\p{{L}}\\p{{N}}.]+'), lambda w: w <> '') AS h, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}.]+'), lambda w: w <> '') AS q FROM fo LEFT JOIN ({INV}) i USING (doc_id))"""


@query(f"""WITH {_DUMP} SELECT doc_id, path, value, verbalized, consistency, coalesce(support, 0) AS support, (support IS NOT NULL)::INT AS grounded, correct,
  round(CASE WHEN support IS NULL THEN 0 ELSE len(list_filter(h, lambda w: list_contains(q, w)))::DOUBLE / len(h) END, 6) AS entailment FROM tx""")
def field_dump(spark, sf):
    return r6(_dump_rows(spark, sf), "entailment")


@query()
def offline_study(spark, sf):
    out = offline.study(_dump_rows(spark, sf), [0.05, 0.1, 0.2])
    return out.withColumns({c: F.round(c, 4) for c in ("coverage", "risk", "lift")})


_AUTO = _GROUND.replace("FROM ext)", "FROM au)")


@query(f"""WITH {_LINES}, {_INFER}, ah AS (SELECT l.doc_id, path, line, trim(regexp_extract(content, '(?i)\\b' || replace(path, '_', ' ') || '\\b(.*)$', 1), ' :') AS value FROM ln l JOIN sc ON sc.doc_id = l.doc_id AND regexp_matches(content, '(?i)\\b' || replace(path, '_', ' ') || '\\b')),
au AS (SELECT * FROM ah WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY line) = 1), {_AUTO}
SELECT path, CASE WHEN coalesce(1.0 / places, 0) >= 0.8 THEN 'accept' ELSE 'review' END AS decision, count(*) AS n, round(avg(CASE WHEN 1.0 / places >= 0.5 THEN 1.0 / places ELSE 0.0 END), 6) AS confidence FROM au LEFT JOIN g USING (doc_id, path) GROUP BY 1, 2""")
def verify_auto(spark, sf):
    out = verify.verify_auto(*of_documents(spark, sf, testbed.INVOICES))
    return r6(out.groupBy("path", "decision").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence")), "confidence")


def _least(source: str, lo: str, hi: str, name: str) -> str:
    """The grid point of 41 with the least log loss of the calibration rows."""
    return f"""{name} AS (SELECT signal, log_t FROM (SELECT t.signal, i, log_t, round(sum(-(pos * ln(p) + err * ln(1 - p))), 9) AS loss FROM
  (SELECT z.*, i, log_t, least(1 - 1e-12, greatest(1e-12, 1 / (1 + exp(-(z.z / exp(log_t)))))) AS p FROM z JOIN (SELECT signal, i, {lo} + ({hi} - {lo}) * i / 40 AS log_t FROM {source} CROSS JOIN range(0, 41) r(i)) gr USING (signal)) t GROUP BY 1, 2, 3) l QUALIFY row_number() OVER (PARTITION BY signal ORDER BY loss, i) = 1)"""


_TEMPERATURE = f"""z AS (SELECT signal, pos, err, ln(least(1 - 1e-7, greatest(1e-7, conf)) / (1 - least(1 - 1e-7, greatest(1e-7, conf)))) AS z FROM t),
{_least('(SELECT DISTINCT signal FROM t) d', '-4.0::DOUBLE', '4.0::DOUBLE', 't1')},
b1 AS (SELECT signal, greatest(-4.0::DOUBLE, log_t - 0.2::DOUBLE) AS lo, least(4.0::DOUBLE, log_t + 0.2::DOUBLE) AS hi FROM t1), {_least('b1', 'lo', 'hi', 't2')},
b2 AS (SELECT signal, greatest(-4.0::DOUBLE, t2.log_t - (hi - lo) / 40) AS lo, least(4.0::DOUBLE, t2.log_t + (hi - lo) / 40) AS hi FROM t2 JOIN b1 USING (signal)), {_least('b2', 'lo', 'hi', 't3')}"""


@query(f"""WITH {_O}, {_TIES.format(by='signal,')}, {_TEMPERATURE} SELECT signal, round(log_t, 6) AS log_t FROM t3""")
def temperature_grid(spark, sf):
    """Three rounds of refinement."""
    return r6(calibrators.fit_temperature(outcomes(spark, sf), ["signal"]), "log_t")


@query(f"""WITH {_O}, ca AS (SELECT * FROM o WHERE split = 'cal'), te AS (SELECT * FROM o WHERE split = 'test'), {_TIES.format(by='signal,').replace('FROM o', 'FROM ca')}, {_TEMPERATURE},
hb AS (SELECT signal, {_BIN} AS bin, avg(correct) AS a FROM ca GROUP BY 1, 2), hw AS (SELECT signal, avg(correct) AS a FROM ca GROUP BY 1),
al AS (SELECT signal, 'none' AS calibrator, conf, correct FROM te
  UNION ALL SELECT te.signal, 'histogram', coalesce(hb.a, hw.a), correct FROM te JOIN hw USING (signal) LEFT JOIN hb ON hb.signal = te.signal AND hb.bin = {_BIN}
  UNION ALL SELECT signal, 'temperature', 1 / (1 + exp(-ln(least(1 - 1e-7, greatest(1e-7, conf)) / (1 - least(1 - 1e-7, greatest(1e-7, conf)))) / exp(log_t))), correct FROM te JOIN t3 USING (signal)),
bi AS (SELECT signal, calibrator, {_BIN} AS bin, abs(avg(correct) - avg(conf)) AS gap, count(*) AS n FROM al GROUP BY 1, 2, 3), ec AS (SELECT signal, calibrator, sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM bi GROUP BY 1, 2),
pr AS (SELECT signal, calibrator, avg((conf - correct) * (conf - correct)) AS brier, avg(-(correct * ln(least(1 - 1e-12, greatest(1e-12, conf))) + (1 - correct) * ln(1 - least(1 - 1e-12, greatest(1e-12, conf))))) AS nll FROM al GROUP BY 1, 2)
SELECT signal, calibrator, round(ece, 10) AS ece, round(mce, 10) AS mce, round(brier, 10) AS brier, round(nll, 10) AS nll FROM ec JOIN pr USING (signal, calibrator)""")
def calibration_table(spark, sf):
    rows = outcomes(spark, sf)
    out = harness.calibration_table(rows.where("split = 'cal'"), rows.where("split = 'test'"))
    return out.withColumns({c: F.round(c, 10) for c in ("ece", "mce", "brier", "nll")})  # ten places: a mean may lie on the border of a sixth place


def _decided(spark, sf, run: int, threshold: float = 0.7):
    p = predictions(spark, sf).where(f"run = {run}").select("doc_id", "path", "value", "support", F.col("verbalized").alias("confidence"))
    return conformal.decide(p, threshold, conf="confidence")


_DEC = f"d{{r}} AS (SELECT doc_id, path, value, support, verbalized AS confidence, CASE WHEN value IS NOT NULL AND verbalized >= 0.7 THEN 'accept' ELSE 'review' END AS decision FROM ({PRED}) WHERE run = {{r}})"


@query(f"""WITH {_DEC.format(r=0)} SELECT doc_id, count(*) AS n_fields, sum((decision = 'accept')::INT)::BIGINT AS n_accepted, sum((decision = 'review')::INT)::BIGINT AS n_review, sum((support IS NOT NULL)::INT)::BIGINT AS n_grounded, round(avg(confidence), 6) AS mean_confidence
FROM d0 GROUP BY ROLLUP (doc_id)""")
def batch_summary(spark, sf):
    return r6(verify.summary(_decided(spark, sf, 0)), "mean_confidence")


@query(f"""WITH {_DEC.format(r=0)}, {_DEC.format(r=1)}, {_DEC.format(r=2)},
s1 AS (SELECT a.doc_id, a.path, CASE WHEN t THEN b.value ELSE a.value END AS value, CASE WHEN t THEN b.support ELSE a.support END AS support, CASE WHEN t THEN b.confidence ELSE a.confidence END AS confidence, CASE WHEN t THEN 'accept' ELSE a.decision END AS decision, CASE WHEN t THEN 1 ELSE 0 END AS tier
  FROM (SELECT a.*, a.decision = 'review' AND b.path IS NOT NULL AS t FROM d0 a LEFT JOIN (SELECT * FROM d1 WHERE decision = 'accept' AND support IS NOT NULL) b USING (doc_id, path)) a LEFT JOIN d1 b USING (doc_id, path)),
s2 AS (SELECT a.doc_id, a.path, CASE WHEN t THEN b.value ELSE a.value END AS value, CASE WHEN t THEN b.support ELSE a.support END AS support, CASE WHEN t THEN b.confidence ELSE a.confidence END AS confidence, CASE WHEN t THEN 'accept' ELSE a.decision END AS decision, CASE WHEN t THEN 2 ELSE a.tier END AS tier
  FROM (SELECT a.*, a.decision = 'review' AND b.path IS NOT NULL AS t FROM s1 a LEFT JOIN (SELECT * FROM d2 WHERE decision = 'accept' AND support IS NOT NULL) b USING (doc_id, path)) a LEFT JOIN d2 b USING (doc_id, path))
SELECT doc_id, path, value, support, confidence, decision, tier FROM s2""")
def repair_tiers(spark, sf):
    tiers = [lambda docs, r=r: _decided(spark, sf, r).join(docs, "doc_id", "left_semi") for r in (1, 2)]
    return verify.repair(_decided(spark, sf, 0), tiers)


@query(f"WITH {_DEC.format(r=0)} SELECT doc_id, path, value, confidence, decision, support, NULL::INT AS page FROM d0")
def flat_records(spark, sf):
    return sinks.records(_decided(spark, sf, 0).withColumn("page", F.lit(None).cast("int")))


@query("""WITH e AS (SELECT page_id, length(html) % 17 AS a, page_id % 23 AS b FROM pages), s AS (SELECT page_id, a AS start_, a + 10 AS end_, 'x' AS label FROM e UNION ALL SELECT page_id, b, b + 5, 'y' FROM e)
SELECT page_id AS doc_id, start_, end_, label FROM (SELECT *, lag(end_) OVER (PARTITION BY page_id ORDER BY start_, end_) AS before FROM s) WHERE before IS NULL OR start_ >= before""")
def highlight_spans(spark, sf):
    e = testbed.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), (F.char_length("html") % 17).cast("int").alias("a"), (F.col("page_id") % 23).cast("int").alias("b"))
    row = lambda at, n, label: F.struct(at.alias("start"), (at + n).alias("end"), F.lit(label).alias("label"))
    s = e.select("doc_id", F.explode(F.array(row(F.col("a"), 10, "x"), row(F.col("b"), 5, "y"))).alias("s")).select("doc_id", "s.*")
    return sinks.highlights(s).withColumnsRenamed({"start": "start_", "end": "end_"})


# ---------------------------------------------------------------- streaming

_DAY = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum((NOT coalesce(value >= 50, false))::INT)::BIGINT AS n_review, round(avg((NOT coalesce(value >= 50, false))::INT), 6) AS review_rate FROM events GROUP BY 1, 2"


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_DAY)
def review_rate_tumbling(spark, sf):
    return _stamped(r6(monitor.review_rate(testbed.table(spark, sf, "events"), 50.0), "review_rate"))


@query("""WITH e AS (SELECT date_trunc('day', ts) AS day, coalesce(value >= 50, false) AS ok FROM events), w AS (SELECT unnest([day - INTERVAL 1 DAY, day]) AS start, ok FROM e)
SELECT CASE WHEN epoch(start)::BIGINT // 86400 % 1 = 0 THEN start END AS start, count(*) AS n, sum((NOT ok)::INT)::BIGINT AS n_review FROM w GROUP BY 1""")
def review_rate_sliding(spark, sf):
    return _stamped(monitor.sliding_rate(testbed.table(spark, sf, "events"), 50.0))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end_, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf):
    out = monitor.sessions(testbed.table(spark, sf, "events"), "6 hours")
    return _stamped(out).select("user_id", "start", F.col("end").cast("timestamp_ntz").alias("end_"), "n")
