"""Metrics of a verification run without a second pass over its rows."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("fieldtrust")
#: Fixed value: the name of the event.
EVENT = "fieldtrust.verification"


def observed(decisions: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """``decisions`` whose counts are taken while they pass by, and where to
    read them after the first action on the result."""
    seen = Observation(name) if name else Observation()
    accepted = (F.col("decision") == "accept").cast("int")
    counts = [
        F.count(F.lit(1)).alias("n_fields"), F.coalesce(F.sum(accepted), F.lit(0)).alias("n_accepted"), F.coalesce(F.sum(1 - accepted), F.lit(0)).alias("n_review"),
        F.coalesce(F.sum(F.col("support").isNotNull().cast("int")), F.lit(0)).alias("n_grounded"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    ]
    return decisions.observe(seen, *counts), seen


def event(metrics: dict, threshold: float, seconds: float | None = None, **more) -> dict:
    """The structured event of a run; a duration only where it is known."""
    out = {"event": EVENT, **more, "threshold": threshold, **{k: metrics[k] for k in ("n_fields", "n_accepted", "n_review", "n_grounded")}, "mean_confidence": round(metrics["mean_confidence"], 4)}
    if seconds is not None:
        out["duration_ms"] = round(seconds * 1000.0, 1)
    return out


@dataclass
class Timer:
    seconds: float = 0.0


@contextmanager
def timed() -> Iterator[Timer]:
    """A timer whose ``seconds`` stand when the block ends, also by an error."""
    timer, start = Timer(), time.perf_counter()
    try:
        yield timer
    finally:
        timer.seconds = time.perf_counter() - start


def logged(decisions: DataFrame, action: Callable[[DataFrame], object], threshold: float, **more) -> dict:
    """Runs ``action`` (a write, say) on the decisions, logs one event as JSON
    and returns it. The counts are those of the rows that the action took."""
    rows, seen = observed(decisions)
    with timed() as timer:
        action(rows)
    made = event(seen.get, threshold, timer.seconds, **more)
    LOG.info(json.dumps(made))
    return made
