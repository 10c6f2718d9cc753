"""Hard negatives by a Voronoi-partitioned distributed kNN join.

Scores are integer inner products of vectors whose components are rounded down
to 1/256. Norm augmentation turns the largest inner product into the smallest
distance: rows get one more component, so that all have the norm of the longest,
anchors get a zero. Pivots are rows; every row and every anchor belongs to the
cell of its nearest pivot. The anchors of a cell are one group (or several of
``GROUP`` anchors). Statistics of cells bound how far an answer can lie from
an anchor of a group, and by the triangle inequality a row can only serve groups
whose pivot is within that bound and the group's radius of it: only to these is
the row replicated. Groups with many rows are cut into shards, which the anchors
visit all; inside (group, shard) the join is exact, and so is the merge of the
shards' lists.

There are two such joins. The first finds each anchor's positives: its best rows
of the same label. Bounds for it are, for each label and group, the distances of
the ``k`` rows nearest to each cell's pivot. The second finds the negatives of
each pair of anchor and positive: rows of other labels whose scores lie between
``LOW_PERCENT`` percent of the positive's score and that score. Both ends are
known by then, so the bounds are a ring around each anchor.

Of rows with equal label and vector, only the ``k + 1`` smallest ids can be among
the first ``k`` of anything, so the rest take no further part; anchors with
equal label and vector are looked up once. So groups of copies cost nothing.

Edge cases: rows with a null id, label, vector or component, or with a component
that isn't finite, take no part; rows alike in id, label and vector count once;
rows that share an id only are different rows, and each anchor among them gets
its result; vectors of different lengths are filled with zeros; sums beyond the
integers that doubles hold exactly are computed with whole numbers, and scores
beyond a long are the nearest long; anchors without a positive and
positives without a negative have no rows; empty tables give none; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import cut

#: Positives of an anchor, negatives of a positive.
K = 5
#: A negative's score is at least this part of the positive's.
LOW_PERCENT = 80
#: Most pivots, anchors of a pivot (fewer pivots if there are fewer anchors),
#: anchors of a group, and rows of a shard: they bound tasks, not results.
PIVOTS, ANCHORS, GROUP, SHARD = 64, 256, 2048, 32768
#: Anchors scored at once, and the sum up to which doubles hold every integer.
_STEP, _EXACT = 64, 2.0**53
_LONG = 2**63 - 1


def prepared(rows: DataFrame, key: str, label: Column, vector: str, anchor: Column) -> DataFrame:
    """(id, label, v, anchor) of the rows that take part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0))
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    made = rows.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.when(good, whole).alias("v"), anchor.alias("anchor"))
    return made.where("id is not null and label is not null and v is not null")


def matrix(v: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of a matrix of int64, shorter ones filled with zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    lengths = np.diff(v.offsets.to_numpy())
    flat, width = v.flatten().to_numpy(zero_copy_only=False), int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two matrices of integers: as doubles where these
    hold them, else as Python's integers, those beyond a long the nearest long."""
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(a) * most(b) * max(1, width) < _EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.minimum(np.maximum(a.astype(object) @ b.astype(object).T, -_LONG - 1), _LONG)


class Space:
    """Distances to the pivots after norm augmentation; ``top`` is the largest
    squared norm of a row."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.top = top
        self.pivots = self.augmented(pivots.astype(np.float64))
        self.slack = 1e-6 * (1 + np.sqrt(top))

    def augmented(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))
        return np.column_stack([x, last])

    def distances(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = v.astype(np.float64)
        width = max(x.shape[1], self.pivots.shape[1] - 1)
        x = self.augmented(_widened(x, width), anchors)
        p = np.column_stack([_widened(self.pivots[:, :-1], width), self.pivots[:, -1]])
        square = (x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T
        return np.sqrt(np.maximum(square, 0))


def mapped(df: DataFrame, schema: str, made) -> DataFrame:
    """``made`` over Arrow batches, given as columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(made({n: b.column(n) for n in b.schema.names}))

    return df.mapInArrow(run, schema)


def best(scores: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row the places of its up to ``k`` largest scores, the first of
    equal ones first; minus infinity is none."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    for i, row in enumerate(scores):
        at = np.flatnonzero((row >= least[i]) & (row > -np.inf))
        yield i, at[np.argsort(-row[at], kind="stable")][:k]


_JOINED = "q long, high long, id long, score long, tie long, same boolean"


def join_shard(k: int, low_percent: int, same_label: bool):
    """The exact join of one group's anchors with one shard's rows: for each
    anchor the ``k`` best rows of its label, or for each score in ``highs`` the
    ``k`` best rows of other labels between the two bounds."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("id", "ascending"), ("tie", "ascending")])
            q, rows = matrix(left["v"]), matrix(right["v"])
            width = max(q.shape[1], rows.shape[1])
            q, rows = _widened(q, width), _widened(rows, width)
            names, ids, ties = left["q"].to_numpy(), right["id"].to_numpy(), right["tie"].to_numpy()
            codes = pa.chunked_array([*left["label"].chunks, *right["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            mine, theirs = codes[: len(names)], codes[len(names) :]
            highs = left["highs"].to_pylist()
            for i in range(0, len(names), _STEP):
                part = slice(i, i + _STEP)
                scores = products(q[part], rows)
                alike = mine[part, None] == theirs[None]
                rounds = max(len(h) for h in highs[part]) if not same_label else 1
                for r in range(rounds):
                    if same_label:
                        allowed = alike
                    else:
                        high = np.array([h[r] if r < len(h) else -1 for h in highs[part]], scores.dtype)[:, None]
                        low = np.array([-(-low_percent * h[r] // 100) if r < len(h) else 0 for h in highs[part]], scores.dtype)[:, None]
                        allowed = ~alike & (scores <= high) & (scores >= low)
                    for j, at in best(np.where(allowed, scores, -np.inf), k):
                        if not (n := len(at)):
                            continue
                        out[0] += [names[i + j]] * n
                        out[1] += [0 if same_label else highs[i + j][r]] * n
                        out[2] += ids[at].tolist()
                        out[3] += map(int, scores[j, at])
                        out[4] += ties[at].tolist()
                        out[5] += (rows[at] == q[i + j]).all(1).tolist() if same_label else [False] * n
        kinds = [pa.int64()] * 5 + [pa.bool_()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["q", "high", "id", "score", "tie", "same"])

    return run


def joined(anchors: DataFrame, rows: DataFrame, shards: int, k: int, low_percent: int, same_label: bool) -> DataFrame:
    """Both sides have (cell, split), the rows also a shard; lists of shards
    are merged to the ``k`` best."""
    spread = anchors.select("cell", "split", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", "label", "v", "highs")
    # the sum makes a column of its own: both sides' cells come from the same table
    dealt = rows.select((F.col("cell") + 0).alias("cell"), (F.col("split") + 0).alias("split"), F.pmod(F.xxhash64("id", "tie"), F.lit(shards)).cast("int").alias("shard"), "id", "label", "v", "tie")
    keys = ["cell", "split", "shard"]
    found = spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(join_shard(k, low_percent, same_label), _JOINED)
    return found.selectExpr("*", "row_number() over (partition by q, high order by score desc, id, tie) as n").where(F.col("n") <= k)


def mine(
    embeddings: DataFrame,
    label: Column | str = "label",
    key: str = "vec_id",
    vector: str = "embedding",
    anchors: Column | None = None,
    k: int = K,
    low_percent: int = LOW_PERCENT,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor (``anchors``, by default those whose key
    100 divides) and each of its first ``k`` positives, the first ``k`` rows of
    other labels that score at least ``low_percent`` percent of the positive
    and no more than it."""
    spark = embeddings.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    marked = embeddings.withColumn("__anchor", F.coalesce(anchors if anchors is not None else F.col(key) % 100 == 0, F.lit(False)))
    every = prepared(marked, key, label, vector, F.col("__anchor"))
    ranked = every.select("id", "label", "v").distinct().selectExpr("*", "row_number() over (partition by label, v order by id) as n").where(F.col("n") <= k + 1)
    few = cut(ranked.select("id", "label", "v", F.xxhash64("v").alias("tie")), "negatives_rows")
    chosen = cut(every.where("anchor").select("id", "label", "v").distinct(), "negatives_chosen")
    asked = cut(chosen.select("label", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "negatives_asked")
    n_rows, n_asked = few.count(), asked.count()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_asked:
        return empty
    # pivots: rows with the smallest hashes, a bounded number of them
    n_pivots = int(min(max(2, n_asked // ANCHORS), pivots))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = few.agg(F.max(norm)).first()[0]
    picked = few.select("v", "tie").dropDuplicates(["tie"]).orderBy("tie").limit(n_pivots).toArrow()
    space = Space(matrix(picked["v"]), top)
    shards = -(-n_rows // SHARD)

    def placed(df: DataFrame, of_anchors: bool) -> DataFrame:
        names = [f.name for f in df.schema if f.name not in ("cell", "dist")]

        def made(b: dict) -> dict:
            d = space.distances(matrix(b["v"]), of_anchors)
            cell = d.argmin(1)
            return {n: b[n] for n in names} | {"cell": pa.array(cell.astype(np.int32)), "dist": pa.array(d[np.arange(len(d)), cell])}

        return mapped(df, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int, dist double", made)

    sized = placed(asked, True).withColumn("split", F.lit(0))
    counts = {r["cell"]: r["count"] for r in sized.groupBy("cell").count().collect()}  # at most a row a pivot
    splits = {c: -(-n // GROUP) for c, n in counts.items()}
    split_of = F.coalesce(*(F.when(F.col("cell") == c, F.pmod(F.col("q"), F.lit(n))) for c, n in splits.items())).cast("int")
    groups = cut(sized.withColumn("split", split_of), "negatives_groups")

    def replicated(df: DataFrame) -> DataFrame:
        """A row for each split of ``cell``."""
        n = F.coalesce(*(F.when(F.col("cell") == c, F.lit(n)) for c, n in splits.items()))
        return df.withColumn("split", F.explode(F.sequence(F.lit(0), n - 1)))

    # the first join's bounds, by label and cell: the (k + 1)-th of the distances
    # anchor to its pivot, to another pivot, to one of the rows nearest to that
    near = placed(few.select("label", "v"), False).selectExpr("label", "cell as other", "dist", "row_number() over (partition by label, cell order by dist) as n")
    radius = groups.groupBy("label", "cell").agg(F.max("dist").alias("radius"))
    between = space.distances(space.pivots[:, :-1])
    legs = spark.createDataFrame([(i, j, float(d)) for i, row in enumerate(between) for j, d in enumerate(row)], "cell int, other int, leg double")
    ways = radius.join(near.where(F.col("n") <= k + 1), "label").join(F.broadcast(legs), ["cell", "other"])  # at most PIVOTS squared legs
    ways = ways.selectExpr("label", "cell", "radius", "radius + leg + dist as far", "row_number() over (partition by label, cell order by radius + leg + dist) as n")
    reach = ways.groupBy("label", "cell", "radius").agg(F.max(F.when(F.col("n") == k + 1, F.col("far"))).alias("far"))
    reach = reach.select("label", "cell", (F.coalesce("far", F.lit(float("inf"))) + F.col("radius") + space.slack).alias("reach"))

    def with_distances(b: dict) -> dict:
        d = space.distances(matrix(b["v"]))
        flat = pa.array(d.astype(np.float32).ravel())
        return {n: b[n] for n in ("id", "label", "v", "tie")} | {"far": pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), flat)}

    row_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema)
    spaced = mapped(few, row_schema + ", far array<float>", with_distances)
    serving = spaced.join(reach, "label").where(~(F.get("far", F.col("cell")).cast("double") * (1 - 1e-6) > F.col("reach")))
    first = joined(groups.withColumn("highs", F.array().cast("array<long>")), replicated(serving), shards, k + 1, low_percent, True)
    found = cut(first.select("q", "id", "score", "tie", "same"), "negatives_positives")

    # an anchor isn't its own positive; anchors with equal label and vector share a list
    pairs = chosen.join(asked, ["label", "v"]).select(F.col("id").alias("anchor_id"), "q").join(found, "q")
    pairs = pairs.where(~(F.col("same") & (F.col("id") == F.col("anchor_id"))))
    pairs = pairs.selectExpr("anchor_id", "q", "id as positive_id", "score as positive_score", "row_number() over (partition by anchor_id, q order by score desc, id, tie) as n")
    pairs = pairs.where(F.col("n") <= k)

    # the second join's bounds, by cell: the ring that holds all negatives
    highs = found.where("score >= 0").groupBy("q").agg(F.array_sort(F.collect_set("score")).alias("highs"))
    asking = groups.join(highs, "q")
    square = norm + F.lit(top)
    ring = asking.select(
        "cell",
        "dist",
        F.sqrt(F.greatest(square - 2 * F.floor(F.element_at("highs", 1).cast("double") * (low_percent / 100.0)).cast("double") + 2, F.lit(0.0))).alias("far"),
        # the largest long stands for all scores beyond it too
        F.when(F.element_at("highs", -1) == _LONG, 0.0).otherwise(F.sqrt(F.greatest(square - 2 * F.element_at("highs", -1).cast("double"), F.lit(0.0)))).alias("near"),
    )
    rings = ring.groupBy("cell").agg(F.max("dist").alias("radius"), F.max("far").alias("far"), F.min("near").alias("near")).collect()  # at most a row a pivot

    def to_cells(b: dict) -> dict:
        d = space.distances(matrix(b["v"]))
        at, cells = [], []
        for r in rings:
            x = d[:, r["cell"]]
            rows = np.flatnonzero(~(x - r["radius"] > r["far"] + space.slack) & ~(x + r["radius"] < r["near"] - space.slack))
            at.append(rows)
            cells.append(np.full(len(rows), r["cell"], np.int32))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        return {n: b[n].take(pa.array(at)) for n in ("id", "label", "v", "tie")} | {"cell": pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32))}

    second = joined(asking, replicated(mapped(few, row_schema + ", cell int", to_cells)), shards, k, low_percent, False)
    negatives = second.selectExpr("q", "high as positive_score", "id as negative_id", "score as negative_score", "cast(n as int) as rank")
    out = pairs.drop("n").join(negatives, ["q", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
