"""MinHash near-dedup: one-permutation hashing with optimal densification,
banded buckets and star-shaped candidate edges, confirmed on full sets.

A document's set is its distinct word shingles. One hash of each shingle gives
both its bin and its value, so a signature costs one pass over the set; an
empty bin takes the value of the first non-empty bin in a random order of its
own, the same for all documents (optimal densification). Bands of bins are
bucket keys.

Documents with the same words in the same order, by a digest of these, form a
class with one representative; only those enter buckets. The members of a
bucket meet in three steps, after which no two of them that are linked are
apart; all links are confirmed on the full sets:

1. each is paired with the bucket's hub, the member that shares most buckets
   with others (stars);
2. those of one hub's buckets that aren't linked with it are compared with one
   another, unless all are in one component already;
3. one of another component whose distance from a hub is at most twice that of
   a link is compared with the hub's star: only there can a document be that is
   linked with both, as Jaccard distances obey the triangle inequality.

Steps 2 and 3 go over blocks of ``BLOCK`` rows as matrix products inside tasks,
and give pairs of components only. Shingles are compared by 64-bit hashes.

Edge cases: null or blank text has an empty set and is linked with nothing;
fewer words than a shingle make one shingle; repeated rows and equal texts are
one class; rows that share a doc_id are one document in ``classes``, while
``dedup`` tells them apart by their texts; extra columns are kept by ``dedup``
and not read otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import LOWER, RunHash, blocks, components, cut, dealt, fresh, lean, mix, normal_words, text_buffer, word_hashes, words

#: 48 bands of 6 bins: a pair at similarity 0.8 shares no bucket once in 2 million.
BANDS, ROWS = 48, 6
#: Rows of a block in the comparison inside families, and columns at a time.
BLOCK, SLICE = 512, 4096


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    values, offsets = text_buffer(column)
    return shingled(values, *words(values, offsets), size)


def shingled(values: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    hashes = word_hashes(LOWER[values], s, e)
    run = RunHash(hashes)
    at = np.arange(max(0, len(hashes) - size + 1))
    grams = run(at, at + size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:  # the whole sequence; its length keeps it apart from longer shingles
            yield mix(run(np.array([a]), np.array([b])) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        # place of bin j in bin i's own random order; a bin comes first in its own
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).argsort(axis=1).astype(np.int16)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.weight = mix(np.arange(101, rows + 101, dtype=np.uint64)) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest value of each bin, bins without one densified."""
        bins = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        by_bin = np.lexsort((shingles & np.uint64(0xFFFFFFFF), bins))
        b = bins[by_bin].astype(np.int64)
        lead = np.ones(len(b), bool)
        lead[1:] = b[1:] != b[:-1]
        full = b[lead]
        values = mix(shingles[by_bin[lead]])
        if len(full) < self.bins:
            pick = self.order[:, full].argmin(axis=1)
            # a bin that has a value keeps it
            pick[full] = np.arange(len(full))
            return values[pick]
        return values

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Bucket keys, one a band."""
        sig = self.signature(mix(shingles)).reshape(self.bands, self.rows)
        return mix((sig * self.weight).sum(axis=1, dtype=np.uint64) + self.salt)


def signatures(documents: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(key, n_shingles, same, keys): size of the set, digest of the words, and
    bucket keys."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in blocks(batches, text):
            values, offsets = text_buffer(b.column(text))
            s, e, first = words(values, offsets)
            n, keys = [], []
            for shingles in shingled(values, s, e, first, size):
                n.append(len(shingles))
                keys.append(signer.keys(shingles) if len(shingles) else np.zeros(0, np.uint64))
            data, at = normal_words(values, offsets, e)
            same = [hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(at, at[1:], strict=False)]
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                [key, "n_shingles", "same", "keys"],
            )

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, n_shingles bigint, same binary, keys array<bigint>")


def full_sets(documents: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, shingles array<bigint>): the full sets of the rows named in ids."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            sets = list(shingle_sets(b.column(text), size))
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "shingles"])

    return documents.select(key, text).join(ids.select(F.col("id").alias(key)), key, "left_semi").mapInArrow(run, f"id {kind}, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (src, dst) with ``linked``: 100 * intersection >= percent *
    union, and ``near``: within twice the distance of a link."""
    kind = pairs.schema["src"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = []
            for c in ("x", "y"):
                lists = b.column(c)
                flat, ends = lists.flatten().to_numpy(), np.cumsum(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False)))
                columns.append([flat[i:j].view(np.uint64) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            near, linked = [], []
            for x, y in zip(*columns, strict=True):
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                near.append(100 * both >= (2 * percent - 100) * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(linked, pa.bool_()), pa.array(near, pa.bool_())], ["src", "dst", "linked", "near"])

    joined = pairs.join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("y")), "dst").join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("x")), "src")
    return joined.select("src", "dst", "x", "y").mapInArrow(run, f"src {kind}, dst {kind}, linked boolean, near boolean")


def cross_links(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): pairs of labels between which some link exists in pairs of
    blocks, as ``dealt`` gives them. A task counts common shingles of two
    blocks as a product of 0/1 matrices, a slice of columns at a time."""
    kind = rows.schema["label"].dataType.simpleString()

    def places(lists: pa.ListArray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
        ok = wanted[at] == flat
        return row[ok], at[ok]

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left = table["left"].to_numpy()
        x, y = table.filter(pa.array(left)), table.filter(pa.array(~left))
        src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(x) and len(y):
            xs, ys = x["v"].combine_chunks(), y["v"].combine_chunks()
            shared = np.intersect1d(xs.flatten().to_numpy(), ys.flatten().to_numpy())
            common = np.zeros((len(x), len(y)), np.float32)
            if len(shared):
                (xr, xc), (yr, yc) = places(xs, shared), places(ys, shared)
                for lo in range(0, len(shared), SLICE):
                    a, b = np.zeros((len(x), SLICE), np.float32), np.zeros((len(y), SLICE), np.float32)
                    i, j = (xc >= lo) & (xc < lo + SLICE), (yc >= lo) & (yc < lo + SLICE)
                    a[xr[i], xc[i] - lo] = 1
                    b[yr[j], yc[j] - lo] = 1
                    common += a @ b.T
            n = xs.value_lengths().to_numpy()[:, None] + ys.value_lengths().to_numpy()[None, :]
            linked = 100 * common.astype(np.int64) >= percent * (n - common.astype(np.int64))
            xl, yl = x["label"].to_pandas().to_numpy(), y["label"].to_pandas().to_numpy()
            i, j = np.nonzero(linked & (xl[:, None] != yl[None, :]))
            pairs = sorted(set(zip(np.minimum(xl[i], yl[j]).tolist(), np.maximum(xl[i], yl[j]).tolist(), strict=True)))
            src, dst = [p[0] for p in pairs], [p[1] for p in pairs]
        out = table.schema.field("label").type
        return pa.table([pa.array(src, out), pa.array(dst, out)], ["src", "dst"])

    return rows.groupBy("group", "i", "j").applyInArrow(compare, f"src {kind}, dst {kind}").distinct()


def link_classes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component_id) of the ids in buckets; ``members`` is (bucket, id, pop)."""
    hubs = cut(members.groupBy("bucket").agg(F.max(F.struct("pop", "id"))["id"].alias("hub")), "hubs")
    pairs = cut(members.join(hubs, "bucket").where("hub <> id").select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct(), "pairs")
    tested = cut(confirmed(pairs, sets, percent), "tested")
    ids = cut(members.select("id").distinct(), "ids")
    labels = cut(components(ids, tested.where("linked")).withColumnRenamed("component_id", "label"), "labels")
    ends = labels.select(F.col("id").alias("src"), F.col("label").alias("p")), labels.select(F.col("id").alias("dst"), "label")
    strays = cut(tested.where("NOT linked").join(ends[0], "src").join(ends[1], "dst").where("p <> label").select(F.col("src").alias("group"), F.col("dst").alias("id"), "label", "near"), "strays")
    several = strays.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    full = sets.withColumnRenamed("shingles", "v")
    loose = cut(strays.join(cut(several.select("group"), "several"), "group").select("group", "id", "label").join(full, "id"), "loose")
    inside = cut(cross_links(dealt(loose, loose, BLOCK), percent), "inside")
    near = cut(strays.where("near").select("group", "id", "label").join(full, "id"), "near")
    wanted = cut(near.select("group").distinct(), "wanted")
    star = tested.where("linked").join(wanted, F.col("src") == F.col("group")).join(ends[1], "dst")
    star = cut(star.select("group", F.col("dst").alias("id"), "label").join(full, "id"), "star")
    outside = cut(cross_links(dealt(near, star, BLOCK), percent), "outside")
    named = components(labels.select(F.col("label").alias("id")).distinct(), inside.unionAll(outside)).withColumnRenamed("id", "label")
    return labels.join(named, "label").select("id", "component_id")


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row for each input row. A row
    with a null key belongs to the group of the rows with its words; one whose
    words no row with a key has is linked with nothing (``dedup`` gives such
    rows keys of their own, and so loses no link)."""
    signed = cut(signatures(documents, key, text, size, bands, rows), "signatures")
    reps = signed.where("n_shingles > 0").groupBy("same").agg(F.min_by(F.struct(key, "keys"), key).alias("r")).where(F.col(f"r.{key}").isNotNull())
    reps = cut(reps.select("same", F.col(f"r.{key}").alias("id"), "r.keys"), "classes")
    buckets = reps.select("id", F.explode("keys").alias("bucket"))
    several = buckets.groupBy("bucket").count().where("count > 1")
    members = cut(buckets.join(cut(several, "several"), "bucket"), "members")
    pop = members.groupBy("id").agg(F.sum("count").alias("pop"))
    members = cut(members.join(pop, "id").select("bucket", "id", "pop"), "members")
    sets = cut(full_sets(documents, members.select("id").distinct(), key, text, size), "sets")
    labels = link_classes(members, sets, percent)
    named = cut(reps.join(labels, "id", "left").select("same", F.coalesce("component_id", "id").alias("component_id")), "named")
    out = signed.select(key, "n_shingles", "same").join(named, "same", "left")
    component = F.coalesce("component_id", key)
    return out.select(key, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(key)).alias("kept"))


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``documents`` with one row of each group of near copies: the smallest
    key, null after all others. Where keys are null or repeat, documents are
    told apart by key and text; rows equal in both are one document."""
    doc, other = fresh(documents, "doc"), fresh(documents, "kept_key")
    if documents.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        kept = classes(documents, key, text, **settings).where("kept").select(F.col(key).alias(other))
        return documents.join(kept, F.col(key) == F.col(other), "left_semi")
    parts = (F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in (key, text))
    named = documents.withColumn(doc, F.md5(F.concat_ws("\0", *parts).cast("binary")))
    placed = classes(named, doc, text, **settings).select(F.col(doc).alias(other), "component_id").distinct()
    keys = named.select(F.col(doc).alias(other), F.col(key).alias("key")).distinct()
    first = F.min_by(other, F.struct(F.col("key").isNull(), "key", other)).alias(other)
    kept = cut(placed.join(keys, other).groupBy("component_id").agg(first).select(other), "kept")
    return named.join(kept, F.col(doc) == F.col(other), "left_semi").dropDuplicates([doc]).drop(doc)
