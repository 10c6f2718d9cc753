"""Dataset shapes of annotated documents to words and golds.

Each function takes rows whose columns follow the raw JSON (as ``spark.read.json``
gives them) and returns DataFrames; nothing is downloaded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.functions.boxes import box, clamped
from fieldtrust.functions.paths import flatten_json
from fieldtrust.functions.text import parse_number, slug
from fieldtrust.operators import ground

#: Page sizes of the shapes that state none, and their gold paths.
RECEIPT_SIZE, FORM_SIZE = (864.0, 1296.0), (800.0, 1000.0)
RECEIPT_PATHS = ("company", "date", "address", "total")


def placed(words: DataFrame, raw: Column, width: Column, height: Column) -> DataFrame:
    """Words with clamped boxes; those without area go."""
    return words.withColumn("bbox", clamped(raw, width, height)).where("bbox IS NOT NULL")


def quad_words(receipts: DataFrame) -> DataFrame:
    """(doc_id, line, pos, text, bbox) of ``valid_line`` quads."""
    size = [F.coalesce(F.col(c), F.lit(d)) for c, d in zip(("width", "height"), RECEIPT_SIZE, strict=True)]
    rows = receipts.select("doc_id", *(s.cast("double").alias(n) for s, n in zip(size, ("width", "height"), strict=True)), F.posexplode("valid_line").alias("line", "l"))
    rows = rows.select("doc_id", "width", "height", "line", F.posexplode("l.words").alias("pos", "w"))
    q = lambda axis: [F.col(f"w.quad.{axis}{i}").cast("double") for i in range(1, 5)]
    raw = box(F.least(*q("x")), F.least(*q("y")), F.greatest(*q("x")), F.greatest(*q("y")))
    return placed(rows, raw, F.col("width"), F.col("height")).select("doc_id", "line", "pos", F.col("w.text").alias("text"), "bbox")


def parse_golds(receipts: DataFrame, leaves: DataFrame) -> DataFrame:
    """Golds of the nested ``gt_parse`` JSON; scoring by schema leaf, else exact."""
    flat = flatten_json(receipts, "doc_id", "gt_parse").where("value IS NOT NULL AND trim(value) <> ''")
    rules = leaves.select(F.col("path").alias("leaf"), "scoring", "numeric_tol")
    joined = flat.join(F.broadcast(rules), F.regexp_replace("path", r"\[\d+\]", "[]") == F.col("leaf"), "left")  # a schema's leaves
    return joined.select("doc_id", "path", "value", F.coalesce("scoring", F.lit("exact")).alias("scoring"), F.coalesce("numeric_tol", F.lit(1e-6)).alias("numeric_tol"))


def relative_words(documents: DataFrame) -> DataFrame:
    """Words whose boxes are shares of the page, one line each."""
    rows = documents.select("doc_id", F.posexplode("words").alias("pos", "w"))
    b = F.col("w.bbox")
    return placed(rows, box(b[0], b[1], b[2], b[3]), F.lit(1.0), F.lit(1.0)).select("doc_id", F.col("pos").alias("line"), "pos", F.col("w.text").alias("text"), "bbox")


def typed_golds(documents: DataFrame, leaves: DataFrame) -> DataFrame:
    """First annotation of each known field type; line items and blanks go."""
    rows = documents.select("doc_id", F.posexplode("annotations").alias("ord", "a")).select("doc_id", "ord", "a.*")
    rows = rows.where("line_item_id IS NULL AND trim(text) <> ''")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "fieldtype").orderBy("ord"))).where("n = 1")
    return first.join(F.broadcast(leaves), first["fieldtype"] == leaves["path"]).select("doc_id", "path", F.col("text").alias("value"), "scoring", "numeric_tol", "page", "bbox")


def line_words(documents: DataFrame) -> DataFrame:
    """One word for each line box of receipts."""
    rows = documents.select("doc_id", F.posexplode("lines").alias("pos", "l"))
    b = F.col("l.box")
    raw = box(b[0].cast("double"), b[1].cast("double"), b[2].cast("double"), b[3].cast("double"))
    return placed(rows, raw, F.lit(FORM_SIZE[0]), F.lit(FORM_SIZE[1])).select("doc_id", F.col("pos").alias("line"), "pos", F.col("l.text").alias("text"), "bbox")


def entity_golds(documents: DataFrame, leaves: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"entities.{p}").alias("value")) for p in RECEIPT_PATHS))
    rows = documents.select("doc_id", F.explode(pairs).alias("e")).select("doc_id", "e.*").where("value IS NOT NULL AND trim(value) <> ''")
    return rows.join(F.broadcast(leaves.select("path", "scoring", "numeric_tol")), "path")


def _page_size(forms: DataFrame) -> tuple[Column, Column]:
    """Page sizes of forms: the rows' own, or the fixed ones."""
    own = [F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in forms.columns else F.lit(d) for c, d in zip(("width", "height"), FORM_SIZE, strict=True)]
    return own[0], own[1]


def form_words(forms: DataFrame) -> DataFrame:
    """(doc_id, line, pos, text, bbox): the words of each entity of a form."""
    width, height = _page_size(forms)
    rows = forms.select("doc_id", width.alias("width"), height.alias("height"), F.posexplode("form").alias("line", "e")).select("doc_id", "width", "height", "line", F.posexplode("e.words").alias("pos", "w"))
    b = lambda i: F.get("w.box", F.lit(i)).cast("double")
    return placed(rows.where("trim(w.text) <> ''"), box(b(0), b(1), b(2), b(3)), F.col("width"), F.col("height")).select("doc_id", "line", "pos", F.col("w.text").alias("text"), "bbox")


def form_golds(forms: DataFrame) -> DataFrame:
    """Question and answer links: (doc_id, path, value, scoring, numeric_tol,
    bbox). Answers of a question are joined by spaces, paths are slugs of the
    questions, numbered where they repeat."""
    e = forms.select("doc_id", F.explode("form").alias("e")).select("doc_id", "e.*")
    links = e.select("doc_id", F.explode("linking").alias("l")).select("doc_id", F.col("l")[0].alias("q"), F.col("l")[1].alias("a")).distinct()
    q = e.where("label = 'question'").select("doc_id", F.col("id").alias("q"), F.col("text").alias("question"))
    a = e.where("label = 'answer' AND trim(text) <> ''").select("doc_id", F.col("id").alias("a"), F.col("text").alias("answer"), "words")
    pairs = links.join(q, ["doc_id", "q"]).join(a, ["doc_id", "a"])
    corner = lambda i, f: f(F.transform("words", lambda w: w["box"][i]))
    joined = pairs.groupBy("doc_id", "q", "question").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "answer"))), lambda x: x["answer"]), " ").alias("value"),
        F.min(corner(0, F.array_min)).alias("x0"), F.min(corner(1, F.array_min)).alias("y0"), F.max(corner(2, F.array_max)).alias("x1"), F.max(corner(3, F.array_max)).alias("y1"),
    )
    width, height = _page_size(forms)
    joined = joined.join(forms.select("doc_id", width.alias("width"), height.alias("height")), "doc_id")
    named = joined.withColumn("slug", slug(F.col("question"))).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("q")))
    numeric = parse_number(F.col("value")).isNotNull()
    raw = box(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    return named.select(
        "doc_id", F.when(F.col("n") > 1, F.concat_ws("_", "slug", "n")).otherwise(F.col("slug")).alias("path"), "value",
        F.when(numeric, F.lit("numeric")).otherwise(F.lit("semantic")).alias("scoring"), F.when(numeric, F.lit(0.01)).otherwise(F.lit(1e-6)).alias("numeric_tol"),
        clamped(raw, F.col("width"), F.col("height")).alias("bbox"),
    )


def boxed_golds(golds: DataFrame, words: DataFrame, min_support: float) -> DataFrame:
    """``golds`` with gold_page and gold_box: where their values stand among the
    document's words, null where no place reaches ``min_support``."""
    page = F.col("page") if "page" in words.columns else F.lit(0)
    placed_words = words.select("doc_id", page.alias("page"), (F.col("line").cast("long") * (1 << 31) + F.col("pos")).alias("pos"), "text", "bbox.*")
    plain = golds.drop("page", "bbox", "support")
    found = ground.ground(plain, placed_words, min_support, mode="none")
    return found.select(*plain.columns, F.col("page").alias("gold_page"), F.col("bbox").alias("gold_box"))


#: Layout replies: the score of a token that states none, and the parts that are read of each item.
LAYOUT_SCORE = 0.9
LAYOUT_ITEMS = "array<struct<bbox: array<double>, text: string, score: double>>"


def layout_tokens(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, score, bbox) from the layout replies of a vision
    model, JSON lists of {bbox, text, score} whose shape may differ from row to
    row. Pages are (doc_id, page, width, height, reply). Replies that are no
    JSON list and items without a box of four numbers give no tokens; a missing
    text is empty, a missing or unreadable score ``LAYOUT_SCORE``."""
    # a reply is parsed and its parts are read in one pass: what cannot be read is null there, and what follows looks up struct fields only
    items = F.try_variant_get(F.try_parse_json("reply"), "$", LAYOUT_ITEMS)
    rows = pages.select("doc_id", "page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.explode(items).alias("item"))
    b = box(*(F.get("item.bbox", F.lit(i)) / F.col("width" if i % 2 == 0 else "height") for i in range(4)))
    out = rows.select("doc_id", "page", F.coalesce("item.text", F.lit("")).alias("text"), F.coalesce("item.score", F.lit(LAYOUT_SCORE)).alias("score"), b.alias("bbox"))
    return out.where("bbox.x0 IS NOT NULL AND bbox.y0 IS NOT NULL AND bbox.x1 IS NOT NULL AND bbox.y1 IS NOT NULL")


def ocr_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, line, pos, text, score, bbox): tokens (doc_id, page, text,
    score, bbox) in reading order. A token joins the first line whose mean band
    holds its middle, which depends on the order, so a page is one group."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def order(group: pd.DataFrame) -> pd.DataFrame:
        found: list[list[dict]] = []
        rows = sorted(group.to_dict("records"), key=lambda r: (r["bbox"]["y0"], r["bbox"]["x0"]))
        for r in rows:
            mid = (r["bbox"]["y0"] + r["bbox"]["y1"]) / 2
            for members in found:
                mean = lambda c, m=members: sum(x["bbox"][c] for x in m) / len(m)
                if mean("y0") <= mid <= mean("y1"):
                    members.append(r)
                    break
            else:
                found.append([r])
        out = [(i, r) for i, members in enumerate(found) for r in sorted(members, key=lambda r: r["bbox"]["x0"])]
        return pd.DataFrame([{"doc_id": r["doc_id"], "page": r["page"], "line": i, "pos": n, "text": r["text"], "score": r["score"], "bbox": r["bbox"]} for n, (i, r) in enumerate(out)])

    box_type = "struct<x0: double, y0: double, x1: double, y1: double>"
    return tokens.groupBy("doc_id", "page").applyInPandas(order, f"doc_id {kind}, page int, line int, pos int, text string, score double, bbox {box_type}")


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """Clamped box around a polygon, array<array<double>> of x and y."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return clamped(box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), width, height)


LOADERS = {"receipts": quad_words, "invoices": relative_words, "scans": line_words, "forms": form_golds}
#: Least support of gold boxes, by shape.
GOLD_SUPPORT = {"receipts": 0.7, "invoices": 0.6, "scans": 0.6}
#: Languages of the form shape beside English, and the page size of their files where none is stated.
FORM_LANGUAGES = ("de", "es", "fr", "it", "ja", "pt", "zh")
LANGUAGE_SIZE = 1000.0
_ENTITY = "array<struct<id: int, label: string, text: string, box: array<double>, linking: array<array<int>>, words: array<struct<box: array<double>, text: string>>>>"
#: Both names that files give the list of a document's entities.
LANGUAGE_FILE = f"documents array<struct<id: string, img: struct<width: double, height: double>, form: {_ENTITY}, document: {_ENTITY}>>"


def language_forms(spark: SparkSession, path: str, lang: str, split: str = "val") -> DataFrame:
    """(doc_id, pos, width, height, form) of a language's file, which holds all
    its documents in one list; ids are numbered by place in the list."""
    if lang not in FORM_LANGUAGES or split not in ("train", "val"):
        raise ValueError(f"unknown language {lang!r} or split {split!r}; known: {FORM_LANGUAGES}, train and val")
    raw = spark.read.schema(LANGUAGE_FILE).option("multiLine", True).json(f"{path.rstrip('/')}/{lang}.{split}.json")
    size = lambda c: F.coalesce(F.col(f"d.img.{c}"), F.lit(LANGUAGE_SIZE)).alias(c)
    number = F.concat(F.lit(f"forms-{lang}-{split}-"), F.lpad(F.col("pos").cast("string"), F.greatest(F.lit(4), F.length(F.col("pos").cast("string"))), F.lit("0")))
    rows = raw.select(F.posexplode("documents").alias("pos", "d"))
    return rows.select(number.alias("doc_id"), "pos", size("width"), size("height"), F.coalesce("d.form", "d.document").alias("form"))


def _rows(spark: SparkSession, kind: str, path: str, lang: str | None, split: str, limit: int | None) -> DataFrame:
    if kind not in LOADERS:
        raise ValueError(f"unknown dataset shape {kind!r}; known: {sorted(LOADERS)}")
    if lang is not None:
        rows = language_forms(spark, path, lang, split)
        return rows.where(F.col("pos") < limit) if limit is not None else rows
    rows = spark.read.option("multiLine", True).json(path)
    return rows.orderBy("doc_id").limit(limit) if limit is not None else rows


def load(spark: SparkSession, kind: str, path: str, lang: str | None = None, split: str = "val", limit: int | None = None) -> DataFrame:
    """Rows of a cached dataset by the name of its shape. With ``lang``, the
    forms of that language's file (``de.val.json``); with ``limit``, those of
    the first documents."""
    return LOADERS[kind](_rows(spark, kind, path, lang, split, limit))


def bench(spark: SparkSession, kind: str, path: str, leaves: DataFrame | None = None, lang: str | None = None, split: str = "val", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(words, golds) of a cached dataset, golds with gold_box; documents
    without a gold are left out. All shapes but forms need a schema's ``leaves``."""
    rows = _rows(spark, kind, path, lang, split, limit)
    if kind == "forms":
        words, golds = form_words(rows), form_golds(rows).withColumnRenamed("bbox", "gold_box").withColumn("gold_page", F.lit(0))
    else:
        words = LOADERS[kind](rows)
        made = {"receipts": parse_golds, "invoices": typed_golds, "scans": entity_golds}[kind](rows, leaves)
        golds = boxed_golds(made, words, GOLD_SUPPORT[kind])
    return words.join(golds.select("doc_id").distinct(), "doc_id", "left_semi"), golds
