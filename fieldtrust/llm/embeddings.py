"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A vector's hash under one rotation is the axis, with sign, that its rotated
form is nearest to; three rounds of random signs and a fast Hadamard transform
rotate. A table's bucket joins some such values (``settings``: as many as keep
unrelated vectors apart at the table's size). Every vector is stored in its own
bucket of each table and also probes the next best buckets. Cosines, in double
precision, confirm every link.

Equal vectors are one from the start. The vectors of a bucket meet in three
steps, after which no two of them that are linked are apart:

1. each is compared with the bucket's hub, a stored one of them (stars);
2. those that aren't linked with the hub are compared with one another, block
   by block inside tasks, unless all are in one component already;
3. one of another component within twice the angle of a hub is compared with
   the hub's star: only there can a vector be that is linked with both.

Links inside a component are counted without writing its pairs: angles obey
the triangle inequality, so two vectors whose angles to the component's mean
direction add up to no more than the bound are linked. Only vectors for which
that leaves some pair open are compared with one another, in blocks.

Edge cases: vectors that are null, zero, empty, or hold null or non-finite
components link with nothing; vectors of different lengths link only with
their like; equal vectors link; rows with equal ids are one vector, the first
in order of its components; a null id links with nothing; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import components, cut, dealt, drop, lean, mix

#: Hash values joined in a bucket key at least, tables for each of them, and
#: probed buckets beside a vector's own.
HASHES, TABLES_EACH, PROBES = 3, 4, 3
#: Tables that are hashed and shuffled at once, which bounds the disk.
PASS = 6
#: Rows of one block in comparisons inside tasks.
BLOCK = 2048


def settings(count: int, dim: int) -> tuple[int, int]:
    """Tables and hash values: so many values that ``count`` spread vectors are
    about one a bucket, and more tables as each then finds less."""
    values = max(HASHES, math.ceil(math.log(max(2, count)) / math.log(2 * max(2, dim))))
    return TABLES_EACH * values, values


class Hasher:
    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int = 5):
        self.dim, self.size = dim, 1 << max(2, (dim - 1).bit_length())
        self.tables, self.hashes, self.probes = tables, hashes, min(probes, self.size - 1)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables * hashes, 3, self.size))

    def rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = x * s
            step = 1
            while step < self.size:
                pairs = x.reshape(len(x), -1, 2, step)
                x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), self.size)
                step *= 2
            x = x / math.sqrt(self.size)
        return x

    def keys(self, x: np.ndarray, tables: range | None = None) -> np.ndarray:
        """n x tables x (1 + probes) bucket keys, a vector's own first. A probe
        changes the one hash value whose runner-up is nearest to its best."""
        tables = range(self.tables) if tables is None else tables
        n = len(x)
        x = np.pad(x, ((0, 0), (0, self.size - self.dim)))
        out = np.empty((n, len(tables), 1 + self.probes), np.uint64)
        weight = mix(np.arange(7, 7 + self.hashes, dtype=np.uint64)) | np.uint64(1)
        depth = min(self.size, 1 + self.probes)
        rows = np.arange(n)
        for place, t in enumerate(tables):
            best, loss = [], []
            for h in range(self.hashes):
                y = self.rotate(x, self.signs[t * self.hashes + h])
                size = np.abs(y)
                top = np.argpartition(size, self.size - depth, axis=1)[:, self.size - depth :]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, axis=1), axis=1, kind="stable"), axis=1)
                near = np.take_along_axis(y, top, axis=1)
                best.append((2 * top + (near < 0)).astype(np.uint64))
                loss.append(np.abs(near[:, :1]) - np.abs(near[:, 1:]))
            own = sum(b[:, 0] * w for b, w in zip(best, weight, strict=True)) + mix(np.uint64([t + 1 + (self.dim << 16)]))
            out[:, place, 0] = mix(own)
            order = np.argsort(np.concatenate(loss, axis=1), axis=1)[:, : self.probes]
            best = np.stack(best)
            for p in range(self.probes):
                h, d = np.divmod(order[:, p], depth - 1)
                values, base = best[h, rows, d + 1], best[h, rows, 0]
                out[:, place, 1 + p] = mix(own + (values - base) * weight[h])
        return out


def usable(v: Column) -> Column:
    return F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length that occurs, and their vectors scaled to length 1."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = column.take(pa.array(at)).flatten().to_numpy().astype(float).reshape(len(at), size)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(vectors: DataFrame, tables: int, hashes: int, probes: int, part: range) -> DataFrame:
    """(bucket, id, own): buckets of each vector in some tables, and whether it
    is stored there."""
    kind = vectors.schema["id"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                ids, column = b.column("id").slice(low, 1024), b.column("v").slice(low, 1024)
                for at, x in unit(column):
                    dim = x.shape[1]
                    if dim not in hashers:
                        hashers[dim] = Hasher(dim, tables, hashes, probes)
                    keys = hashers[dim].keys(x, part)
                    own = np.zeros(keys.shape, bool)
                    own[:, :, 0] = True
                    rows = pa.array(np.repeat(at, keys.shape[1] * keys.shape[2]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), ids.take(rows), pa.array(own.reshape(-1))], ["bucket", "id", "own"])

    return vectors.select("id", "v").mapInArrow(run, f"bucket bigint, id {kind}, own boolean")


def judged(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (src, dst) within twice the linked angle, with ``linked``: cosine
    at or above ``least``."""
    kind = pairs.schema["src"].dataType.simpleString()
    wide = math.cos(min(math.pi, 2 * math.acos(least))) - 1e-9

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = np.flatnonzero((b.column("x").value_lengths().to_numpy() == b.column("y").value_lengths().to_numpy()))
            b, cosine = b.take(pa.array(same)), np.zeros(len(same))
            for (at, x), (_, y) in zip(unit(b.column("x")), unit(b.column("y")), strict=True):
                cosine[at] = np.einsum("ij,ij->i", x, y)
            out = pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(cosine >= least)], ["src", "dst", "linked"])
            yield out.filter(pa.array(cosine >= wide))

    joined = pairs.join(vectors.select(F.col("id").alias("dst"), F.col("v").alias("y")), "dst").join(vectors.select(F.col("id").alias("src"), F.col("v").alias("x")), "src")
    return joined.select("src", "dst", "x", "y").mapInArrow(run, f"src {kind}, dst {kind}, linked boolean")


def linked_blocks(table: pa.Table, least: float) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """Left and right rows of equal length, and which of them are linked."""
    table = table.combine_chunks()
    sides = [table.filter(pa.array(m)) for m in (table["left"].to_numpy(), ~table["left"].to_numpy())]
    if all(map(len, sides)):
        parts = [{x.shape[1]: (at, x) for at, x in unit(s["v"].combine_chunks())} for s in sides]
        for size in parts[0].keys() & parts[1].keys():
            (at, x), (to, y) = parts[0][size], parts[1][size]
            yield sides[0].take(pa.array(at)), sides[1].take(pa.array(to)), x @ y.T >= least


def across(rows: DataFrame, least: float) -> DataFrame:
    """(src, dst): pairs of labels between which a link exists in the blocks."""
    field = rows.schema["label"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        src, dst = [], []
        for a, b, linked in linked_blocks(table, least):
            x, y = (side["label"].combine_chunks().dictionary_encode() for side in (a, b))
            i, j = np.nonzero(linked)
            pairs = np.unique(np.stack([x.indices.to_numpy()[i], y.indices.to_numpy()[j]]), axis=1)
            src += x.dictionary.take(pa.array(pairs[0])).to_pylist()
            dst += y.dictionary.take(pa.array(pairs[1])).to_pylist()
        kept = [(min(s, d), max(s, d)) for s, d in zip(src, dst, strict=True) if s != d]
        kind = table.schema.field("label").type
        return pa.table([pa.array([k[0] for k in kept], kind), pa.array([k[1] for k in kept], kind)], ["src", "dst"])

    return rows.groupBy("group", "i", "j").applyInArrow(compare, f"src {field}, dst {field}").distinct()


def classes(vectors: DataFrame, least: float, tables: int, hashes: int, probes: int) -> DataFrame:
    """(id, component_id) of distinct vectors (id, v)."""
    stars, members = [], []
    for low in range(0, tables, PASS):
        placed = cut(buckets(vectors, tables, hashes, probes, range(low, min(tables, low + PASS))), "placed")
        hub = F.min(F.when(F.col("own"), F.struct(F.xxhash64("bucket", "id").alias("h"), "id")))["id"]
        hubs = placed.groupBy("bucket").agg(hub.alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1 AND hub IS NOT NULL")
        found = placed.join(cut(hubs.select("bucket", "hub"), "hubs"), "bucket").where("hub <> id")
        members.append(cut(found.select("bucket", "id", "own", "hub"), "members"))
        stars.append(members[-1].select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct())
        drop(placed)
    members = _union(members)
    pairs = cut(judged(cut(_union(stars).distinct(), "pairs"), vectors, least), "judged")
    labels = cut(components(vectors.select("id"), pairs.where("linked")).withColumnRenamed("component_id", "label"), "labels")
    # those of a bucket that its hub isn't linked with, unless one component holds them all
    close = pairs.where("linked").select(F.col("src").alias("hub"), F.col("dst").alias("id"))
    rest = cut(members.join(close, ["hub", "id"], "left_anti").join(labels, "id").select("bucket", "id", "own", "label"), "rest")
    open_ = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("own").alias("stored")).where("lo <> hi AND stored")
    rest = cut(rest.join(cut(open_.select("bucket"), "open"), "bucket").join(vectors, "id").select(F.col("bucket").alias("group"), "id", "label", "v").distinct(), "rest")
    inside = cut(across(dealt(rest, rest, BLOCK), least), "inside")
    # those of other components near a hub against its star
    near = pairs.where("NOT linked").join(labels.select(F.col("id").alias("src"), F.col("label").alias("p")), "src").join(labels.select(F.col("id").alias("dst"), "label"), "dst").where("p <> label")
    near = cut(near.join(vectors.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("group"), F.col("dst").alias("id"), "label", "v"), "near")
    hubs = cut(near.select("group").distinct(), "hubs")
    star = pairs.where("linked").join(hubs, F.col("src") == F.col("group")).join(labels.withColumnRenamed("id", "dst"), "dst").join(vectors.withColumnRenamed("id", "dst"), "dst")
    star = cut(star.select("group", F.col("dst").alias("id"), "label", "v"), "star")
    outside = cut(across(dealt(near, star, BLOCK), least), "outside")
    named = components(labels.select(F.col("label").alias("id")).distinct(), inside.unionAll(outside)).withColumnRenamed("id", "label")
    return labels.join(named, "label").select("id", "component_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def counted(members: DataFrame, dim: int, least: float) -> DataFrame:
    """(id, n_links) of the members (id, v, copies, component_id, n) of
    components, where n is the number of all vectors in the component."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    # by the largest component first: squares of tiny ones would vanish, of huge ones overflow
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    scaled = members.withColumn("top", largest).withColumn("u", F.transform("v", lambda x: x.cast("double") / F.col("top"))).withColumn("length", F.sqrt(dot("u", "u"))).drop("top")
    mean = cut(scaled.groupBy("component_id").agg(F.array(*(F.avg(F.get("u", F.lit(i)) / F.col("length")) for i in range(dim))).alias("mean")), "means")
    norm = F.sqrt(dot("mean", "mean"))
    cosine = F.when((norm > 1e-9) & (F.col("length") > 0), dot("u", "mean") / norm / F.col("length")).otherwise(F.lit(-1.0))
    angles = scaled.join(mean, "component_id").withColumn("angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))
    angles = cut(angles.select("id", "v", "copies", "component_id", "n", "angle"), "angles")
    widest = cut(angles.groupBy("component_id").agg(F.max("angle").alias("widest")), "widest")
    bound = math.acos(least) - 1e-7
    # a vector is open if its angle and the widest of its component exceed the bound
    told = cut(angles.join(widest, "component_id").withColumn("open", F.coalesce(F.col("angle") + F.col("widest") > bound, F.lit(True))), "told")
    outer = told.where("open").select(F.col("component_id").alias("group"), "id", F.col("copies").alias("label"), "v")
    size = cut(outer.groupBy(F.col("group").alias("component_id")).agg(F.sum("label").alias("n_outer")), "outer")
    kind = outer.schema["id"].dataType.simpleString()

    def count(table: pa.Table) -> pa.Table:
        ids, n = [], []
        for a, b, linked in linked_blocks(table, least):
            copies = b["label"].to_numpy().astype(float)
            ids.append(a["id"].combine_chunks())
            n.append((linked @ copies).round().astype(np.int64))
        return pa.table([pa.concat_arrays(ids) if ids else pa.array([], table.schema.field("id").type), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["id", "n"])

    opened = dealt(outer, outer, BLOCK).groupBy("group", "i", "j").applyInArrow(count, f"id {kind}, n bigint")
    opened = cut(opened.groupBy("id").agg(F.sum("n").alias("n_open")), "opened")
    # open vectors are linked with every vector that isn't open, and with those counted, themselves among them
    inner = told.select("id", "component_id", "n", "open").join(size, "component_id", "left").join(opened, "id", "left")
    return inner.select("id", (F.when(F.col("open"), F.col("n") - F.col("n_outer") + F.coalesce("n_open", F.lit(0))).otherwise(F.col("n")) - 1).alias("n_links"))


def link(embeddings: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95, tables: int | None = None, hashes: int | None = None, probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept): one row for each distinct id."""
    rows = embeddings.where(F.col(key).isNotNull() & usable(F.col(embedding))).select(F.col(key).alias("id"), F.col(embedding).alias("v"))
    digest = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("digest", digest), "vectors")
    once = cut(rows.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.count(F.lit(1)).alias("copies")), "distinct")
    size = once.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = size[1] or 1
    want = settings(size[0], dim)
    labels = cut(classes(once.select("id", "v"), least, tables or want[0], hashes or want[1], probes), "labels")
    whole = once.select("id", "copies").join(labels, "id").groupBy("component_id").agg(F.sum("copies").alias("n")).where("n > 1")
    members = once.join(labels, "id").join(cut(whole, "sizes"), "component_id").select("id", "v", "copies", "component_id", "n")
    links = counted(cut(members, "members"), dim, least)
    told = once.select("digest", "id").join(labels, "id").join(links, "id", "left").select("digest", "component_id", "n_links")
    found = rows.select(F.col("id").alias(key), "digest").join(cut(told, "told"), "digest").drop("digest")
    out = embeddings.select(key).distinct().join(found, key, "left")
    component = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col(key)).alias("kept"))
