"""Path language of leaves: ``a.b``, ``items[2].price``, ``items[].price``."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_path(c: Column) -> Column:
    """``items[12].price`` as ``items[].price``."""
    return F.regexp_replace(c, r"\[\d+\]", "[]")


def canonical(c: Column) -> Column:
    """Dotted integers as brackets: ``items.0.name`` as ``items[0].name``."""
    return F.regexp_replace(c, r"\.(\d+)(?=\.|$|\[)", r"[$1]")


def split_index(c: Column) -> Column:
    """struct<prefix, idx, rel> of the outermost array index; null without one."""
    rule = r"^([^\[]*)\[(\d+)\]\.?(.*)$"
    part = lambda p, n: F.regexp_extract(p, rule, n)
    # the path is brought to its form once, as a variable of the function, and not for each part
    split = lambda p: F.when(p.rlike(rule), F.struct(part(p, 1).alias("prefix"), part(p, 2).cast("int").alias("idx"), part(p, 3).alias("rel")))
    return F.get(F.transform(F.array(canonical(c)), split), F.lit(0))


def join_index(prefix: Column, idx: Column, rel: Column) -> Column:
    return F.concat(prefix, F.lit("["), idx.cast("string"), F.lit("]"), F.when(rel == "", F.lit("")).otherwise(F.concat(F.lit("."), rel)))


def flatten_json(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value, value_type) of every leaf of JSON texts, whatever
    their depth. Each level opens the containers that the one before left; the
    loop asks only whether any is left. Unreadable texts and empty containers
    have no leaves."""
    spark = docs.sparkSession
    level = docs.select(F.col(key).alias("k"), F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        level = level.withColumn("kind", F.schema_of_variant("v"))
        opens = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        leaves = level.where(~opens).select(F.col("k").alias(key), "path", F.col("v").cast("string").alias("value"), F.col("kind").alias("value_type"))
        found = leaves if found is None else found.unionAll(leaves)
        level = level.where(opens)
        if level.isEmpty():
            return found
        entry = spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "item")
        inner = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        level = level.lateralJoin(entry).select("k", inner.alias("path"), F.col("item").alias("v"))


def nest(leaves: dict[str, Any]) -> Any:
    """The nested value of {path: value}; missing array places are null."""
    root: dict = {}
    for path, value in leaves.items():
        node, steps = root, [s for part in path.split(".") for s in _steps(part)]
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = value
    return _lists(root)


def _steps(part: str) -> list:
    name, *rest = part.split("[")
    return ([name] if name else []) + [int(r.rstrip("]")) for r in rest]


def _lists(node: Any) -> Any:
    if not isinstance(node, dict):
        return node
    node = {k: _lists(v) for k, v in node.items()}
    if node and all(isinstance(k, int) for k in node):
        return [node.get(i) for i in range(max(node) + 1)]
    return node


def unflatten(leaves: DataFrame, key: str, parsed: bool = False) -> DataFrame:
    """(key, json): nested JSON text of each key's (path, value) rows; with
    ``parsed``, values are JSON texts themselves."""
    read = json.loads if parsed else lambda v: v

    @F.pandas_udf("string")
    def to_json(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: json.dumps(nest({x["path"]: read(x["value"]) for x in r}), ensure_ascii=False))

    return leaves.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("r")).select(key, to_json("r").alias("json"))
