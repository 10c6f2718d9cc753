"""Shared helpers: lineage cuts in the shared folder, Arrow text access and
vectorised word hashing.

The hashing works on the bytes of a whole Arrow batch at once. A word is a
maximal run of bytes other than space and ``\\x09-\\x0D``; its 64-bit hash is a
polynomial in a random byte table, so the hash of every word and of every run
of words falls out of one prefix sum.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- lineage


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``. Where it is unset,
    a temporary one if executors are threads of this machine (as in tests);
    on a cluster that is an error, as each would see a folder of its own."""
    if not (got := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"file://{tempfile.gettempdir()}/fieldtrust-checkpoints"
    return got.rstrip("/")


#: Ends of an execution at which Spark may delete its shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither
    recompute it nor depend on the executors that made it. The shuffle files
    of the write are deleted at its end."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, when nothing will read them again."""
    for df in cuts:
        root = shared_dir(df.sparkSession)
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.rpartition("/")[0].endswith(root.partition(":")[2].lstrip("/")):
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# ---------------------------------------------------------------- arrow


def lean(run: Callable) -> Callable:
    """A map over Arrow batches whose worker, which Spark uses again for other
    tasks, keeps no table and no freed memory after it."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``max_bytes``; a
    single longer text stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return values, offsets - offsets[0]


# ---------------------------------------------------------------- hashing

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1 << 60, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = (n + 1 + 0xFFFF) & ~0xFFFF
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = out[0], out[1]
        if size <= 1 << 21:  # a single giant text doesn't stay in memory
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the buffer, and for each row the index of
    its first word (one more entry than rows)."""
    if not len(values):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[values]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(values))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes that are hashed at once, so that the tables stay in a core's cache.
_STEP = 1 << 16


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    borders = np.append(np.searchsorted(starts, np.arange(0, len(values), _STEP)), len(starts)).tolist()
    for i, j in zip(borders, borders[1:], strict=False):
        if i < j:
            base, last = int(starts[i]), int(ends[j - 1])
            power, inverse = powers(_BASE, last - base)
            sums = np.zeros(last - base + 1, np.uint64)
            np.cumsum(_BYTE[values[base:last]] * power[: last - base], out=sums[1:])
            first = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[first]) * inverse[first]
    return mix(out)


class RunHash:
    """Hashes of runs of consecutive words, from their word hashes."""

    def __init__(self, hashes: np.ndarray):
        power, self.inverse = powers(_WORD_BASE, len(hashes))
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def normal_words(values: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
    """The rows' words in lower case, each with one space behind it, end to
    end, and the offsets of the rows."""
    inside = ~_SPACE[values]
    behind = np.append(ends, 0)[:-1]
    close = np.zeros(len(values) + 1, np.int64)
    close[behind] = 1
    keep = inside.astype(np.int64)
    sums = np.append(0, np.cumsum(keep)) + np.append(0, np.cumsum(close[1:]))  # bytes before each place
    out = np.full(int(sums[-1]), 32, np.uint8)
    out[sums[:-1][inside]] = LOWER[values[inside]]
    return out.tobytes(), sums[offsets].tolist()


# ---------------------------------------------------------------- components


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable over ``edges`` (src, dst).

    Rounds of minimum-label hooking with pointer jumping; each round's labels
    are written to the shared folder. Only ids that have an edge take part, a
    hub's edges are reduced map-side by ``min``, and the loop ends when no
    label falls: a count of changes is all that reaches the driver.
    """
    both = cut(
        edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(),
        "edges",
    )
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        # the smallest label over each id's neighbours ...
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("now"))
        # ... also pulls down the label's own representative, and everyone jumps to it
        hook = step.groupBy(F.col("label").alias("rep")).agg(F.min("now").alias("hook"))
        new = cut(
            step.join(hook.withColumnRenamed("rep", "label"), "label")
            .withColumn("now", F.least("now", "hook"))
            .select("id", F.col("label").alias("old"), F.col("now").alias("label")),
            "labels",
        )
        jumped = new.join(new.select(F.col("id").alias("j"), F.col("label").alias("up")), F.col("label") == F.col("j"), "left").select(
            "id", "old", F.least("label", F.coalesce("up", "label")).alias("label")
        )
        jumped = cut(jumped, "labels")
        moved = not jumped.where("label <> old").isEmpty()
        labels = jumped.select("id", "label")
        if not moved:
            break
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component_id"))


def dealt(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """Blocks of some ``block`` rows of two sides (group, id, label, v) against
    one another: rows (group, i, j, id, label, v, left) of each pair of blocks."""
    sized = lambda df, name: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = cut(sized(left, "xs").join(sized(right, "ys"), "group"), "blocks")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = left.join(blocks, "group").select("group", own("xs").alias("i"), every("ys").alias("j"), "id", "label", "v", F.lit(True).alias("left"))
    y = right.join(blocks, "group").select("group", every("xs").alias("i"), own("ys").alias("j"), "id", "label", "v", F.lit(False).alias("left"))
    return x.unionAll(y)
