"""Extractors: (documents, leaves) to predictions."""

from __future__ import annotations

import json
import typing
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions.paths import flatten_json
from fieldtrust.functions.text import slug
from fieldtrust.operators.resampling import uniform
from fieldtrust.sources.datasets import ocr_lines
from fieldtrust.sources.ingest import lines

#: Label words that mark an identifier, and the forms of a
#: labelled line, of a number and of a date.
ID_WORDS = ("id", "no", "number", "ref", "invoice", "order", "#")
LABEL_LINE = r"(?U)^\s*([A-Za-z][\w /&.#-]{0,40}?)\s*:\s*(\S.*?)\s*$"
NUMBER_VALUE = r"(?U)^[$€£]?\s?-?[\d,]+(?:\.\d+)?\s?%?$"
DATE_VALUE = r"(?U)^\d{4}-\d{1,2}-\d{1,2}$|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"


def leaves_of(schema: dict[str, Any], prefix: str = "", required: bool = True) -> list[dict]:
    """Leaves of a JSON Schema with the x- annotations; unknown types are strings."""
    out, needed = [], set(schema.get("required", []))
    for name, node in (schema.get("properties") or {}).items():
        path, must = f"{prefix}.{name}" if prefix else name, name in needed if "required" in schema else required
        kind = node.get("type")
        if kind == "object":
            out += leaves_of(node, path, must)
        elif kind == "array":
            item = node.get("items") or {}
            out += leaves_of(item, path + "[]", must) if item.get("type") == "object" else leaves_of({"properties": {"": item}, "required": [""] if must else []}, path + "[]")
        else:
            kind = kind if kind in ("number", "integer", "boolean") else "string"
            scoring = node.get("x-scoring", "numeric" if kind in ("number", "integer") else "exact")
            out.append({"path": path.rstrip("."), "type": kind, "scoring": scoring, "numeric_tol": float(node.get("x-numeric-tol", 1e-6)), "required": must, "aliases": list(node.get("x-aliases", []))})
    return out


def schema_table(spark: SparkSession, schema: dict[str, Any] | str) -> DataFrame:
    """(ord, path, type, scoring, numeric_tol, required, aliases)."""
    parsed = json.loads(schema) if isinstance(schema, str) else schema
    rows = [(i, x["path"], x["type"], x["scoring"], x["numeric_tol"], x["required"], x["aliases"]) for i, x in enumerate(leaves_of(parsed))]
    return spark.createDataFrame(rows, "ord int, path string, type string, scoring string, numeric_tol double, required boolean, aliases array<string>")


def json_schema(leaves: list[dict], name: str = "schema") -> dict[str, Any]:
    """The JSON Schema of leaves, nested again."""
    root: dict[str, Any] = {"title": name, "type": "object", "properties": {}}
    for x in leaves:
        node, parts = root, x["path"].split(".")
        for i, part in enumerate(parts):
            key, many, last = part.removesuffix("[]"), part.endswith("[]"), i == len(parts) - 1
            leaf = {"type": x["type"], "x-scoring": x["scoring"]} | ({"x-numeric-tol": x["numeric_tol"]} if x["scoring"] == "numeric" else {}) | ({"x-aliases": x["aliases"]} if x.get("aliases") else {})
            if x.get("required", True) and key not in node.setdefault("required", []):
                node["required"].append(key)
            made = leaf if last else {"type": "object", "properties": {}}
            child = node["properties"].setdefault(key, {"type": "array", "items": made} if many else made)
            node = child["items"] if many else child
    return root


def text_search(documents: DataFrame, leaves: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ord, path, value, page, line): for each leaf outside arrays the
    rest of the first line that holds its label, then its aliases. The leaves
    are one schema's, which travel with each line, or, with a doc_id, each
    document's own; the first hit is kept by a minimum, so no document's lines
    meet in a sort."""
    label = F.regexp_replace(F.element_at(F.split("path", r"\."), -1), "_", " ")
    own = ["doc_id"] if "doc_id" in leaves.columns else []
    wanted = leaves.where(~F.col("path").contains("[")).select(*own, "ord", "path", F.posexplode(F.concat(F.array(label), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "label"))
    flat = lines(documents, text).withColumn("low", F.lower("content"))
    # in lines of ASCII, a label of words is sought with a space for whatever is no word; else by its own pattern
    spaced = F.concat(F.lit(" "), F.regexp_replace("low", "[^a-z0-9_]", " "), F.lit(" "))
    flat = flat.withColumn("spaced", F.when(F.col("content").rlike(r"\A[ -~]*\z"), spaced))
    wanted = wanted.withColumn("low_label", F.lower("label")).withColumn("sought", F.when(F.col("label").rlike(r"\A[A-Za-z0-9_]([A-Za-z0-9_ ]*[A-Za-z0-9_])?\z"), F.concat(F.lit(" "), F.lower("label"), F.lit(" "))))
    if own:
        hits = flat.join(wanted, "doc_id").where(F.col("low").contains(F.col("low_label")))
    else:
        hits = flat.join(F.broadcast(wanted), F.col("low").contains(F.col("low_label")))  # a schema's labels
    rule = F.concat(F.lit(r"(?i)\b\Q"), F.col("label"), F.lit(r"\E\b(.*)$"))
    at, size = F.coalesce("at", F.lit(-1)), F.char_length("low_label")
    after = F.when(at > 0, F.when(F.substring(F.col("low"), F.col("at"), size) == F.col("low_label"), F.substring(F.col("content"), F.col("at") + size, F.char_length("content"))))
    slow = F.when(F.regexp_like(F.col("content"), rule), F.call_function("regexp_extract", F.col("content"), rule, F.lit(1)))
    after = F.when(at != 0, F.coalesce(after, slow))
    # a dash is a separator only where no digit follows: a minus sign stays
    rest = F.trim(F.regexp_replace(after, r"^[ \t:—–]*(-(?!\d)[ \t:—–-]*)?", ""))
    # a generator's value is made once, where a filter on it would make it again
    found = hits.withColumn("at", F.instr("spaced", F.col("sought"))).select("doc_id", "ord", "path", "nth", "page", "line", F.explode(F.array_compact(F.array(F.nullif(rest, F.lit(""))))).alias("value"))
    best = found.groupBy("doc_id", "ord", "path").agg(F.min(F.struct("nth", "page", "line", "value")).alias("b"))
    return best.select("doc_id", "ord", "path", "b.value", "b.page", "b.line")


def replay(documents: DataFrame, canned: DataFrame) -> DataFrame:
    """Predictions given for each document."""
    return canned.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def canned_map(documents: DataFrame, values: Column) -> DataFrame:
    """A map of values on each document as predictions; nulls are left out."""
    rows = documents.select("doc_id", F.posexplode(F.map_entries(values)).alias("ord", "e"))
    return rows.select("doc_id", "ord", F.col("e.key").alias("path"), F.col("e.value").alias("value")).where("value IS NOT NULL")


def _swapped(value: Column, i: Column, j: Column) -> Column:
    """The text with its i-th and j-th characters exchanged."""
    at = lambda k: F.substring(value, k, F.lit(1))
    place = F.sequence(F.lit(1), F.char_length(value))
    return F.array_join(F.transform(place, lambda k: F.when(k == i, at(j)).when(k == j, at(i)).otherwise(at(k))), "")


def noisy(golds: DataFrame, runs: int = 1, seed: int = 0, omit: float = 0.05, error: float = 0.1, invent: float = 0.05) -> DataFrame:
    """(doc_id, run, path, value, verbalized, logprobs): golds as a faulty
    extractor would give them. Values are left out, or wrong with two
    characters exchanged (two digits of numbers), and some documents get a path
    that has no gold. Verbalized confidence is high whatever the value; token
    scores are a little lower for wrong ones. Draws are hashes of the keys."""
    u = lambda *salt: uniform(F.lit(seed), F.col("doc_id"), F.col("run"), *salt)
    rows = golds.select("doc_id", "path", "value", "scoring", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("roll", u(F.col("path"), F.lit("roll")))
    text = F.col("value")
    digits = F.filter(F.sequence(F.lit(1), F.char_length("value")), lambda k: F.substring(text, k, F.lit(1)).rlike("[0-9]"))
    first = F.least(F.size("digits") - 1, 1 + F.floor(u(F.col("path"), F.lit("i")) * (F.size("digits") - 1))).cast("int")
    spot = F.least(F.char_length("value") - 1, 1 + F.floor(u(F.col("path"), F.lit("j")) * (F.char_length("value") - 1))).cast("int")
    numeric = F.when(F.size("digits") >= 2, _swapped(text, F.element_at("digits", first), F.element_at("digits", first + 1))).otherwise(F.concat(text, F.lit("0")))
    plain = F.when(F.char_length("value") >= 2, _swapped(text, spot, spot + 1)).otherwise(F.concat(text, F.lit("x")))
    kept = rows.where(F.col("roll") >= omit).where("value <> ''").withColumn("digits", digits)
    wrong = F.col("roll") < omit + error
    told = kept.select("doc_id", "run", "path", F.when(wrong, F.when(F.col("scoring") == "numeric", numeric).otherwise(plain)).otherwise(text).alias("value"), wrong.alias("wrong"))
    ghosts = rows.select("doc_id", "run").distinct().where(u(F.lit("invent")) < invent)
    ghosts = ghosts.select("doc_id", "run", F.concat(F.lit("spurious_"), F.floor(u(F.lit("name")) * 1000).cast("string")).alias("path"), F.lit("ghost").alias("value"), F.lit(True).alias("wrong"))
    both = told.unionByName(ghosts)
    score = lambda k: F.log(F.least(F.lit(1.0), F.when(F.col("wrong"), F.lit(0.90)).otherwise(F.lit(0.97)) + 0.1 * (u(F.col("path"), F.lit(f"t{k}")) - 0.5)))
    verbal = F.least(F.lit(1.0), 0.85 + 0.13 * u(F.col("path"), F.lit("verbal")))
    return both.select("doc_id", "run", "path", "value", verbal.alias("verbalized"), F.array(*map(score, range(3))).alias("logprobs"))


def leaves_of_class(model: type, prefix: str = "", required: bool = True) -> list[dict]:
    """Leaves of a class with annotated fields: numbers are scored as numbers,
    flags exactly, other types by likeness. Nested classes and lists of them
    are followed; optional fields, and fields with a default, aren't required."""
    out = []
    for name, kind in typing.get_type_hints(model).items():
        path, must = f"{prefix}.{name}" if prefix else name, required and not hasattr(model, name)
        args = typing.get_args(kind)
        if type(None) in args:
            kind, must = next(a for a in args if a is not type(None)), False
        many = typing.get_origin(kind) in (list, tuple)
        if many:
            path, kind = path + "[]", (*typing.get_args(kind), str)[0]
        if getattr(kind, "__annotations__", None):
            out += leaves_of_class(kind, path, must)
            continue
        named, scoring = {int: ("integer", "numeric"), float: ("number", "numeric"), bool: ("boolean", "exact")}.get(kind, ("string", "semantic"))
        out.append({"path": path, "type": named, "scoring": scoring, "numeric_tol": 1e-6, "required": must, "aliases": []})
    return out


def parse_model_json(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(doc_id, path, value, verbalized) of model replies: the outermost braces
    of each reply, flattened; ``x.value`` and ``x.confidence`` are a pair."""
    body = replies.select("doc_id", F.regexp_extract(column, r"(?s)(\{.*\})", 1).alias("body"))
    flat = flatten_json(body, "doc_id", "body")
    base, part = F.regexp_extract("path", r"^(.*?)(\.(value|confidence))?$", 1), F.regexp_extract("path", r"\.(value|confidence)$", 1)
    value = F.max(F.when(F.col("part") != "confidence", F.col("value")))
    conf = F.max(F.when(F.col("part") == "confidence", F.col("value"))).try_cast("double")
    return flat.withColumn("base", base).withColumn("part", part).groupBy("doc_id", F.col("base").alias("path")).agg(value.alias("value"), conf.alias("verbalized"))


def infer_schema(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, ord, path, type, scoring, numeric_tol, required, aliases): each
    document's own schema, from its ``Label: value`` lines. The first line of a
    label decides; its order is that of the lines."""
    # a labelled line is matched once, to its label and value with a line end between; lines themselves have none
    both = F.regexp_replace("content", LABEL_LINE, "$1\n$2")
    found = lines(documents, text).select("doc_id", "page", "line", F.explode(F.array_compact(F.array(F.when(both.contains("\n"), both)))).alias("both"))
    found = found.select("doc_id", "page", "line", F.substring_index("both", "\n", 1).alias("label"), F.substring_index("both", "\n", -1).alias("v"))
    named = found.select("*", F.explode(F.array_compact(F.array(F.nullif(slug(F.col("label"), None), F.lit(""))))).alias("path"))
    first = named.groupBy("doc_id", "path").agg(F.min(F.struct("page", "line", "label", "v")).alias("f"))
    is_id = F.lit(False)
    for w in ID_WORDS:
        is_id = is_id | F.lower("f.label").contains(w)
    number, date = ~is_id & F.col("f.v").rlike(NUMBER_VALUE), F.col("f.v").rlike(DATE_VALUE)
    return first.select(
        "doc_id", (F.col("f.page").cast("long") * (1 << 31) + F.col("f.line")).alias("ord"), "path", F.when(number, F.lit("number")).otherwise(F.lit("string")).alias("type"),
        F.when(number, F.lit("numeric")).when(is_id | date, F.lit("exact")).otherwise(F.lit("semantic")).alias("scoring"),
        F.when(number, F.lit(0.01)).otherwise(F.lit(1e-6)).alias("numeric_tol"), F.lit(True).alias("required"), F.array().cast("array<string>").alias("aliases"),
    )


def schemas_of(inferred: DataFrame) -> DataFrame:
    """(doc_id, schema): the JSON Schema text of each document's leaves."""

    @F.pandas_udf("string")
    def made(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: json.dumps(json_schema([dict(x) for x in r]), ensure_ascii=False))

    leaf = F.struct("ord", "path", "type", "scoring", "numeric_tol", "required")
    return inferred.groupBy("doc_id").agg(F.sort_array(F.collect_list(leaf)).alias("r")).select("doc_id", made("r").alias("schema"))


def ocr_search(tokens: DataFrame, leaves: DataFrame) -> DataFrame:
    """Label search over OCR tokens (doc_id, page, text, score, bbox) in
    reading order; token_prob is the mean score of the value's words, each by
    its first token on the document, null for words without one."""
    placed = ocr_lines(tokens)
    line = placed.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), " ").alias("content"))
    body = line.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "content"))), lambda x: x["content"]), "\n").alias("text"))
    found = text_search(body, leaves)
    first = placed.groupBy("doc_id", F.lower("text").alias("word")).agg(F.min_by("score", F.struct("page", "pos")).alias("score"))
    parts = found.select("doc_id", "path", F.explode(F.split(F.lower("value"), " ")).alias("word")).join(first, ["doc_id", "word"])
    p = F.least(F.lit(1.0), F.greatest(F.lit(1e-6), "score"))
    return found.join(parts.groupBy("doc_id", "path").agg(F.exp(F.avg(F.log(p))).alias("token_prob")), ["doc_id", "path"], "left")


def prompt(schema: dict[str, Any]) -> str:
    """Instruction for a model client; the document's text follows it."""
    return "Return one JSON object of this schema, each leaf as {value, confidence}.\n" + json.dumps(schema) + "\n\nDocument:\n"


def model_extractor(schema: dict[str, Any], client: Callable[[list[str], float], list[str]], runs: int = 1) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """An extractor around ``client(prompts, temperature) -> replies``, called
    with Arrow batches of documents on the executors. One run is drawn at
    temperature 0, several at 0.7. Unreadable replies give no predictions."""
    if runs < 1:
        raise ValueError("runs must be at least 1")
    head = prompt(schema)

    def extract(documents: DataFrame, leaves: DataFrame) -> DataFrame:
        @F.pandas_udf("array<string>")
        def ask(texts: pd.Series) -> pd.Series:
            asked = [head + (t or "") for t in texts]
            drawn = [client(asked, 0.0 if runs == 1 else 0.7) for _ in range(runs)]
            return pd.Series([list(r) for r in zip(*drawn, strict=True)])

        replies = documents.select("doc_id", F.posexplode(ask("text")).alias("run", "reply"))
        # a run is a document of its own while its reply is parsed
        keyed = replies.select(F.struct("doc_id", "run").alias("doc_id"), "reply")
        parsed = parse_model_json(keyed).select("doc_id.doc_id", "doc_id.run", "path", "value", "verbalized")
        order = leaves.select(F.col("path").alias("leaf"), "ord")
        joined = parsed.join(F.broadcast(order), F.regexp_replace("path", r"\[\d+\]", "[]") == F.col("leaf"), "left").drop("leaf")  # a schema's leaves
        return joined.withColumn("support", F.lit(None).cast("double"))

    return extract


REGISTRY = {"text_search": text_search, "ocr_search": ocr_search, "replay": replay, "canned": canned_map}


def extractor(name: str):
    """An extractor by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown extractor {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]
