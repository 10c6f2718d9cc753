"""Boxes as struct<x0, y0, x1, y1> and spans as struct<start, end>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def clamped(b: Column, width: Column, height: Column) -> Column:
    """Page-relative box inside [0, 1]; null where it has no area."""
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    x0, y0, x1, y1 = unit(b["x0"] / width), unit(b["y0"] / height), unit(b["x1"] / width), unit(b["y1"] / height)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 for boxes that only touch or have no area."""
    both = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def gold_iou(pred: Column, gold: Column) -> Column:
    """Null without a gold box, 0 without a predicted one."""
    return F.when(gold.isNull(), F.lit(None).cast("double")).when(pred.isNull(), F.lit(0.0)).otherwise(iou(pred, gold))


def span_f1(pred: Column, gold: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(pred["end"], gold["end"]) - F.greatest(pred["start"], gold["start"]))
    sizes = (pred["end"] - pred["start"]) + (gold["end"] - gold["start"])
    return F.when(pred.isNull() | (sizes == 0), F.lit(0.0)).otherwise(2.0 * both / sizes)
