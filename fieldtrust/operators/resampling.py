"""Resampling statistics; draws come from hashes of the keys, so they are the
same on every run and in every partition.

The draw of replicate r for a key is a function of seed + (r + 1) * STEP modulo
PRIME. Keys are therefore placed on a circle of PRIME places on which STEP is one
place: a replicate's draws are those of the replicate before, moved by one. Sums
of weighted keys for all replicates are then one correlation of the keys' values
with the weights along the circle, which is cut into blocks that tasks correlate
by themselves. The work is bounded by the circle, whatever the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def uniform(*keys: Column) -> Column:
    """Double in [0, 1) from the md5 of the keys."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw of a uniform number. The distribution."""
    w, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        w = w + (u >= round(total, 12)).cast("int")
        term /= k
    return w


#: Modulus and multipliers of the draws.
PRIME, STEP, MULTIPLIERS = 2147483647, 1640531527, (48271, 69621, 16807)
SHIFTS = (15, 13, 16)
#: Turns a seed into its place on the circle.
BACK = pow(STEP, -1, PRIME)
#: Tasks that share the circle; rows a task holds at once; groups whose sums it holds; rows of a group and block from which a transform is cheaper than windows.
PARTS, ROWS, GROUPS, DENSE = 128, 1 << 17, 64, 64


def seed(key: Column) -> Column:
    """31-bit number of a key, from its md5: one for each row, not for each draw."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(PRIME))


def draw(seed: Column, rep: Column) -> Column:
    """Uniform number in [0, 1] of a seed and a replicate: multiplications and
    shifts of whole numbers, cheap enough for thousands of replicates."""
    x = (seed + (rep + 1) * F.lit(STEP)) % PRIME
    for m, k in zip(MULTIPLIERS, SHIFTS, strict=True):
        x = (x.bitwiseXOR(F.shiftright(x, k)) * F.lit(m)) % PRIME
    return x / float(PRIME)


def replicates(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Each row ``n`` times, with rep and the uniform number u of its key."""
    seeded = rows.withColumn("seed_", seed(F.col(key)))
    return seeded.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", draw(F.col("seed_"), F.col("rep").cast("long"))).drop("seed_")


def bootstrap(rows: DataFrame, by: list[str], key: str, statistic: Callable[[DataFrame, list[str]], DataFrame], n: int = 2000, level: float = 0.95) -> DataFrame:
    """(by, estimate, lo, hi): percentile interval of any statistic by Poisson
    bootstrap over ``key``, which may be a row's or a cluster's; a key's weight
    is its own, so nothing is resampled by position. ``statistic(rows, keys)``
    gives (keys, stat) of rows with their weights in ``w``."""
    drawn = replicates(rows, key, n).withColumn("w", poisson_weight(F.col("u")))
    stats, tail = statistic(drawn, [*by, "rep"]), (1 - level) / 2
    ends = stats.groupBy(*by).agg(F.percentile("stat", F.lit(tail)).alias("lo"), F.percentile("stat", F.lit(1 - tail)).alias("hi"))
    seen = statistic(rows.withColumn("w", F.lit(1)), by).withColumnRenamed("stat", "estimate")
    return seen.join(ends, by) if by else seen.crossJoin(ends)  # one row each


# ------------------------------------------------------------- sums of all replicates


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, which is a power of 2 less 1, for x below 2^62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    x[x >= PRIME] -= PRIME
    return x


def drawn_at(places: np.ndarray) -> np.ndarray:
    """The numbers of ``draw`` at places of the circle: that of a key at place y
    and replicate r is at y + r + 1."""
    x = _mod(_mod(places) * STEP)
    for m, k in zip(MULTIPLIERS, SHIFTS, strict=True):
        x = _mod((x ^ (x >> k)) * m)
    return x / float(PRIME)


def poisson_weights(u: np.ndarray) -> np.ndarray:
    """``poisson_weight`` of an array."""
    w, total, term = np.zeros(u.shape), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += term
        w += u >= round(total, 12)
        term /= k
    return w


def signs(u: np.ndarray) -> np.ndarray:
    return np.where(u < 0.5, -1.0, 1.0)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _coded(table: pa.Table, by: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's group, and the groups."""
    code, keys = np.zeros(table.num_rows, "int64"), [()]
    for c in by:
        found = table[c].combine_chunks().dictionary_encode()
        values = [*found.dictionary.to_pylist(), None]
        own = found.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)
        seen, code = np.unique(code * len(values) + own, return_inverse=True)
        keys = [(*keys[x // len(values)], values[x % len(values)]) for x in seen.tolist()]
    return code, keys


def _correlated(by: list[str], n: int, weigh: Callable[[np.ndarray], np.ndarray], absent: float, whole: list[bool], schema: pa.Schema) -> Callable:
    """The task: rows in order of their place to (by, rep, s0, s1, ...), the sums
    for each replicate of the task's share of the circle. Blocks with few rows
    draw for these alone; those with more draw each place once and add up
    windows, or for groups with many rows correlate by Fourier transforms, whose
    products are summed before they are turned back."""
    size = 1 << max(12, (8 * n - 1).bit_length())
    width, reps = size - n, np.arange(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        waves: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, total in sums.items():
                if key in waves:
                    back = np.fft.irfft(waves[key], size)[:, :n]
                    total = total + np.where(np.array(whole)[:, None], np.rint(back), back)
                names = [pa.array([k] * n, schema.field(c).type) for c, k in zip(by, key, strict=True)]
                yield pa.record_batch([*names, pa.array(reps.astype("int32")), *map(pa.array, total)], schema=schema)
            sums.clear()
            waves.clear()

        for table in _gathered(batches):
            code, keys = _coded(table, by)
            at = table["at"].to_numpy()
            values = np.stack([table[f"v{i}"].to_numpy() for i in range(len(whole))])
            order = np.argsort(at, kind="stable")
            code, at, values = code[order], at[order], values[:, order]
            block = at // width
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                groups, place, start = code[lo:hi], at[lo:hi], int(block[lo]) * width
                few = (hi - lo) * n <= size
                if start < 0:  # rows without a key
                    windows = np.full((1, n), absent)
                    place, few = np.zeros(hi - lo, "int64"), False
                elif few:
                    windows = weigh(drawn_at(place[:, None] + 1 + reps))
                else:
                    line = weigh(drawn_at(np.arange(start + 1, start + 1 + size)))
                    windows, wave, place = np.lib.stride_tricks.sliding_window_view(line, n), None, place - start
                for g in np.unique(groups).tolist():
                    if keys[g] not in sums and len(sums) >= GROUPS:
                        yield from flush()
                    total = sums.setdefault(keys[g], np.zeros((len(whole), n)))
                    mine = np.flatnonzero(groups == g)
                    v = values[:, lo:hi][:, mine]
                    if start < 0:
                        total += v.sum(axis=1, keepdims=True) * windows
                    elif few or len(mine) < DENSE:
                        total += v @ windows[mine if few else place[mine]]
                    else:
                        wave = np.fft.rfft(line) if wave is None else wave
                        spread = np.stack([np.bincount(place[mine], x, size) for x in v])
                        product = np.conj(np.fft.rfft(spread)) * wave
                        waves[keys[g]] = waves[keys[g]] + product if keys[g] in waves else product
        yield from flush()

    return run


def replicate_sums(rows: DataFrame, by: list[str], key: str, values: list[Column], n: int, weigh: Callable[[np.ndarray], np.ndarray] = poisson_weights, absent: float = 0.0) -> DataFrame:
    """(by, rep, s0, s1, ...): for each of ``n`` replicates the sums of
    ``values``, each times the weight that ``weigh`` gives the draw of the row's
    key. Rows without a key have the weight ``absent``. Sums of whole numbers
    are exact. Rows of a key are summed first, then dealt out by blocks."""
    names = [f"v{i}" for i in range(len(values))]
    size = 1 << max(12, (8 * n - 1).bit_length())
    at = F.coalesce(seed(F.col(key)) * F.lit(BACK) % F.lit(PRIME), F.lit(-1)).alias("at")
    placed = rows.select(*by, at, *(v.alias(c) for v, c in zip(values, names, strict=True)))
    whole = [placed.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in names]
    summed = placed.groupBy(*by, "at").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in names))
    dealt = summed.repartition(PARTS, F.floor(F.col("at") / (size - n))).sortWithinPartitions("at")
    schema = StructType([*(summed.schema[c] for c in by), StructField("rep", IntegerType()), *(StructField(f"s{i}", DoubleType()) for i in range(len(values)))])
    parts = dealt.mapInArrow(_correlated(by, n, weigh, absent, whole, to_arrow_schema(schema)), schema)
    return parts.groupBy(*by, "rep").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(values))))


# ------------------------------------------------------------- intervals and tests


def bootstrap_mean(rows: DataFrame, by: list[str], key: str, value: Column, n: int = 2000, level: float = 0.95) -> DataFrame:
    """The interval of a mean over rows, or over clusters if ``key`` repeats:
    that of ``bootstrap`` for this statistic, whose replicates are sums."""
    valued = rows.select(*by, key, value.alias("value_"))
    one = F.col("value_").isNotNull().cast("int")
    stats = replicate_sums(valued, by, key, [F.col("value_"), one], n).withColumn("stat", F.try_divide("s0", "s1"))
    tail = (1 - level) / 2
    ends = stats.groupBy(*by).agg(F.percentile("stat", F.lit(tail)).alias("lo"), F.percentile("stat", F.lit(1 - tail)).alias("hi"))
    seen = valued.groupBy(*by).agg(F.try_divide(F.sum("value_"), F.sum(one)).alias("estimate"))
    return seen.join(ends, by) if by else seen.crossJoin(ends)  # one row each


def _differences(pairs: DataFrame, by: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    d = pairs.withColumn("d", F.col("x") - F.col("y")).where("d IS NOT NULL").select(*by, key, "d")
    return d, d.groupBy(*by).agg(F.avg("d").alias("diff"), F.count("d").alias("n_"))


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b, by) if by else a.crossJoin(b)  # one row for each group


def paired_permutation(pairs: DataFrame, by: list[str], key: str, n: int = 10_000) -> DataFrame:
    """(by, diff, p): two-sided sign-flip test of columns x and y, add-one."""
    d, seen = _differences(pairs, by, key)
    flipped = _beside(replicate_sums(d, by, key, [F.col("d")], n, signs, 1.0), seen, by)
    far = F.abs(F.col("s0") / F.col("n_")) >= F.abs("diff") - 1e-12
    hits = flipped.groupBy(*by, "diff").agg(F.sum(far.cast("int")).alias("hits"))
    return hits.select(*by, "diff", ((F.col("hits") + 1) / (n + 1)).alias("p"))


def paired_bootstrap(pairs: DataFrame, by: list[str], key: str, n: int = 10_000) -> DataFrame:
    """(by, diff, p): twice the smaller share of replicates on either side of 0."""
    d, seen = _differences(pairs, by, key)
    means = replicate_sums(d, by, key, [F.col("d"), F.lit(1)], n).withColumn("t", F.try_divide("s0", "s1"))
    sides = means.groupBy(*by).agg(F.avg((F.col("t") <= 0).cast("double")).alias("le"), F.avg((F.col("t") >= 0).cast("double")).alias("ge"))
    return _beside(seen, sides, by).select(*by, "diff", F.least(F.lit(1.0), 2 * F.least("le", "ge")).alias("p"))


def holm(tests: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """``tests`` (p, ord) with reject: step-down until the first failure."""
    order = Window.partitionBy(*by).orderBy("p", "ord")
    whole = Window.partitionBy(*by)
    rank, m = F.row_number().over(order), F.count(F.lit(1)).over(whole)
    step = tests.withColumn("fail", (F.col("p") > F.lit(alpha) / (m - rank + 1)).cast("int"))
    return step.withColumn("reject", F.max("fail").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0).drop("fail")
