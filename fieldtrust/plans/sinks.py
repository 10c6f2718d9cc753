"""Sinks: flat records, nested documents, markdown tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.functions.paths import unflatten


def records(decisions: DataFrame) -> DataFrame:
    """Seven flat columns, confidence to four places."""
    return decisions.select("doc_id", "path", "value", F.round("confidence", 4).alias("confidence"), "decision", F.round("support", 4).alias("support"), "page")


def write_csv(decisions: DataFrame, path: str) -> None:
    records(decisions).write.option("header", True).csv(path)


def write_jsonl(decisions: DataFrame, path: str) -> None:
    """One JSON line for each document: its fields by path."""
    field = F.struct("path", F.struct("value", F.round("confidence", 4).alias("confidence"), "decision", "support", "page").alias("f"))
    decisions.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(field))).alias("fields")).write.json(path)


def nested_values(decisions: DataFrame) -> DataFrame:
    """(doc_id, json): the values as nested JSON."""
    return unflatten(decisions.select("doc_id", "path", "value"), "doc_id")


def _kept(spans: Column) -> Column:
    """Of spans in order those that start where the last kept one has ended."""

    @F.pandas_udf("array<struct<start: int, end: int, label: string>>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for spans in column:
            at, kept = 0, []
            for s in spans:
                if s["start"] >= at and s["end"] > s["start"]:
                    kept.append(s)
                    at = s["end"]
            out.append(kept)
        return pd.Series(out)

    return run(spans)


def highlights(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, label): spans by start, empty ones and those that
    overlap an earlier kept one left out."""
    item = F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label")))
    kept = spans.where("start IS NOT NULL AND end IS NOT NULL").groupBy("doc_id").agg(item.alias("s")).select("doc_id", F.explode(_kept(F.col("s"))).alias("k"))
    return kept.select("doc_id", "k.start", "k.end", "k.label")


def segments(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, start, segment, label): each text cut into its highlights and
    what lies between them, which has a null label. A text without spans is one
    segment; an empty or null one too."""
    kept = highlights(spans)
    gap = Window.partitionBy("doc_id").orderBy("start")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(kept, "doc_id", "left").withColumn("before", F.coalesce(F.lag("end").over(gap), F.lit(0))).withColumn("last", F.lead("start").over(gap).isNull())
    size = F.char_length("text")
    piece = lambda start, end, label: F.struct(start.alias("start"), F.substring("text", start + 1, end - start).alias("segment"), label.alias("label"))
    none, start, end = F.lit(None).cast("string"), F.col("start"), F.col("end")
    parts = F.when(start.isNull(), F.array(piece(F.lit(0), size, none))).otherwise(F.array(piece(F.col("before"), start, none), piece(start, end, F.col("label")), piece(end, F.when(F.col("last"), size).otherwise(end), none)))
    out = rows.select("doc_id", F.col("start").isNull().alias("whole"), F.explode(parts).alias("p")).where("whole OR p.segment <> ''")
    return out.select("doc_id", "p.start", "p.segment", "p.label")


def results(decisions: DataFrame) -> DataFrame:
    """(doc_id, json): each document's fields as nested JSON, every leaf with
    value, confidence, decision and grounding."""
    place = F.when(F.col("support").isNotNull(), F.struct("page", "bbox", "support"))
    leaf = F.to_json(F.struct("value", F.round("confidence", 4).alias("confidence"), "decision", place.alias("grounding")), {"ignoreNullFields": "false"})
    return unflatten(decisions.select("doc_id", "path", leaf.alias("value")), "doc_id", parsed=True)


def markdown(rows: DataFrame) -> str:
    """A small result as a markdown table."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    body = [rows.columns, ["---"] * len(rows.columns), *([cell(v) for v in r] for r in rows.collect())]
    return "\n".join("| " + " | ".join(line) + " |" for line in body)


def latex(table: str) -> str:
    """A markdown table as LaTeX."""
    lines = [[c.strip() for c in line.strip().strip("|").split("|")] for line in table.strip().splitlines()]
    escape = lambda c: "".join("\\" + x if x in "&%$#_{}" else x for x in c)
    rows = [" & ".join(map(escape, line)) + r" \\" for i, line in enumerate(lines) if i != 1]
    return "\n".join([r"\begin{tabular}{" + "l" * len(lines[0]) + "}", r"\toprule", rows[0], r"\midrule", *rows[1:], r"\bottomrule", r"\end{tabular}"])
