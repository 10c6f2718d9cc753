"""Substring dedup by compaction of a de Bruijn graph of word k-mers.

Edges of the graph are the windows of ``k`` consecutive words, nodes the
``k - 1`` words that two windows in a row share. Only edges that occur twice or
more matter, and a nonbranching path of such edges repeats as a whole, so it is
one long span at every place where it occurs:

1. Consecutive edges of a document that share their minimiser (the smallest
   hash among the ``m``-word runs inside) are one row, a *path*. Equal windows
   share their minimiser, so minimisers that occur once drop out by a partial
   count and a join.
2. Paths with equal contents form a class with its earliest source coordinate
   (doc_id, start). Where a minimiser has several classes the graph branches
   inside; the edges of one representative of each class are opened and
   compared one by one.
3. Elsewhere a class knows which paths come before and after it. The node
   between two of them has in-degree and out-degree one if all occurrences of
   the first are followed by the second and all of the second preceded by the
   first: a self-join of the classes finds these, and runs of them along the
   source compact into one long path, of which only the first class is looked
   up again in the documents.
4. Every repeat is verified at its source coordinates: a digest of the words
   there must equal that of the words to be removed. Where it doesn't (a
   collision of 64-bit hashes) the words stay.
5. The words that verified repeats cover are removed.

Joins are on keys with a reduced side that has one row for each, so a frequent
passage is a skewed join that Spark can split, never one group.

Edge cases: null text has no words; texts with fewer than ``k`` words lose
nothing; rows with equal doc_id and text are one document and each gets its
result; several rows of one doc_id with different texts are read as different
documents in the order of their texts' hashes, null doc_ids before all; very
long texts stay whole in one task; extra columns are kept by ``dedup``, and
where one has the name of a result column the result's name gets a ``_`` at
its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import RunHash, blocks, cut, fresh, lean, text_buffer, word_hashes, words

#: Words of a window, and of the runs whose smallest hash joins windows.
K, M = 20, 6
#: Bytes of text that a worker handles at once.
BLOCK_BYTES = 1 << 20
_HIGH = np.uint64(0xFFFFFFFF00000000)


def minimisers(hashes: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, RunHash]:
    """Starts of all windows inside a row, each window's minimiser's place
    (leftmost on ties) and hash. ``first``: index of each row's first word."""
    n = len(hashes)
    run = RunHash(hashes)
    starts = np.arange(max(0, n - k + 1))
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    starts = starts[starts + k <= first[1:][row[starts]]] if len(starts) else starts
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), run
    at = np.arange(n - m + 1)
    grams = run(at, at + m)
    key = (grams & _HIGH) | at.astype(np.uint64)
    span, size, low = k - m + 1, 1, key
    while size * 2 <= span:  # minimum over size, then over two overlapping halves
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    place = (low[starts] & ~_HIGH).astype(np.int64)
    return starts, place, grams[place], run


def paths(documents: DataFrame, key: str, text: str, k: int, m: int) -> DataFrame:
    """(key, mini, content, start, n, before, after): the paths of each text, the
    contents of their neighbours in it, 0 at its ends."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, BLOCK_BYTES):
            values, offsets = text_buffer(b.column(text))
            s, e, first = words(values, offsets)
            starts, place, mini, runs = minimisers(word_hashes(values, s, e), first, k, m)
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(starts)))
            begin = starts[at]
            content = runs(begin, begin + n + k - 1) + (place[at] - begin).astype(np.uint64)
            row = np.searchsorted(first, begin, "right") - 1
            inner = row[1:] == row[:-1]
            before, after = np.zeros_like(content), np.zeros_like(content)
            before[1:][inner], after[:-1][inner] = content[:-1][inner], content[1:][inner]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(key).take(pa.array(row)),
                    pa.array(mini[at].view(np.int64)),
                    pa.array(content.view(np.int64)),
                    pa.array((begin - first[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(before.view(np.int64)),
                    pa.array(after.view(np.int64)),
                ],
                [key, "mini", "content", "start", "n", "before", "after"],
            )

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, mini bigint, content bigint, start int, n int, before bigint, after bigint")


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def opened(documents: DataFrame, chosen: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, pos, window, words): hash and digest of each window of the chosen
    paths, read from the texts. ``chosen`` has one row for each key."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, BLOCK_BYTES):
            values, offsets = text_buffer(b.column(text))
            s, e, first = words(values, offsets)
            runs = RunHash(word_hashes(values, s, e))
            row, begin, n = listed(b.column("paths"))
            path = np.repeat(np.arange(len(n)), n)
            pos = begin[path] + np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
            at = first[row[path]] + pos
            parts, told, data = -1, [], values.tobytes()
            for r, p in zip(row[path].tolist(), pos.tolist(), strict=True):
                if r != parts:
                    parts, own = r, data[offsets[r] : offsets[r + 1]].split()
                told.append(digest(own[p : p + k]))
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(row[path])), pa.array(pos.astype(np.int32)), pa.array(runs(at, at + k).view(np.int64)), pa.array(told, pa.binary())], [key, "pos", "window", "words"]
            )

    joined = documents.select(key, text).join(chosen, key)
    return joined.select(key, text, "paths").mapInArrow(run, f"{key} {kind}, pos int, window bigint, words binary")


def listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and n of the structs in a column of lists."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return row, flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy()


def source_digests(documents: DataFrame, wanted: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, start, n, words): digests of the words of n windows from start, for
    the coordinates in ``wanted``, which are as many as compacted paths."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, BLOCK_BYTES):
            row, start, n = listed(b.column("paths"))
            own, parts, told = -1, [], []
            for r, i, j in zip(row.tolist(), start.tolist(), n.tolist(), strict=True):
                if r != own:
                    own, parts = r, (b.column(text)[r].as_py() or "").encode().split()
                told.append(digest(parts[i : i + j + k - 1]))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n, pa.int32()), pa.array(told, pa.binary())], [key, "start", "n", "words"])

    each = wanted.groupBy(key).agg(F.collect_list(F.struct("start", "n")).alias("paths"))
    return documents.select(key, text).join(each, key).select(key, text, "paths").mapInArrow(run, f"{key} {kind}, start int, n int, words binary")


def compacted(classes: DataFrame, key: str) -> DataFrame:
    """(mini, content, source, n): runs of classes whose nodes in between have
    in-degree and out-degree one, as their first class with the windows of all."""
    one = classes.select("mini", "content", "source", "n", F.when(F.col("b0") == F.col("b1"), F.col("b0")).alias("before"), F.when(F.col("a0") == F.col("a1"), F.col("a0")).alias("after"))
    one = cut(one, "classes")
    left = one.where("after <> 0").select(F.col("after").alias("content"), F.col("content").alias("before"), F.struct(F.col(f"source.{key}").alias(key), (F.col("source.start") + F.col("n")).alias("start")).alias("source"))
    inner = cut(left.join(one.where("before <> 0"), ["content", "before", "source"]).select("mini", "content").distinct(), "inner")
    marked = one.join(inner.withColumn("inner", F.lit(True)), ["mini", "content"], "left").select("mini", "content", "source", "n", F.col("inner").isNull().alias("head"))
    along = Window.partitionBy(f"source.{key}").orderBy("source.start")  # the paths of one document
    chained = marked.withColumn("chain", F.last(F.when(F.col("head"), F.col("source.start")), ignorenulls=True).over(along))
    return chained.groupBy(F.col(f"source.{key}").alias("at"), "chain").agg(F.min(F.when(F.col("head"), F.struct("mini", "content", "source"))).alias("h"), F.sum("n").cast("int").alias("n")).select("h.*", "n")


def repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """(key, spans array<struct<start, stop, words>>): word ranges of windows
    that also start earlier, and the digest of the words at their sources where
    it isn't compared yet. Keys must be unique here."""
    rows = paths(documents, key, text, k, m)
    shared = rows.groupBy("mini").agg(F.count(F.lit(1)).alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("c > 1")
    # written first, so that the join's sides are plain shuffles, which Spark can split where a minimiser is frequent
    shared = cut(shared.select("mini", (F.col("lo") != F.col("hi")).alias("branches")), "shared")
    found = cut(rows.join(shared, "mini"), "paths")
    source = F.struct(key, "start")
    ends = (f(c).alias(n) for f, c, n in ((F.min, "before", "b0"), (F.max, "before", "b1"), (F.min, "after", "a0"), (F.max, "after", "a1")))
    classes = cut(found.groupBy("mini", "content").agg(F.min(source).alias("source"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c"), F.first("branches").alias("branches"), *ends), "classes")
    # edges where the graph branches inside a minimiser
    chosen = classes.where("branches").select(f"source.{key}", F.struct("source.start", "n").alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("paths"))
    windows = cut(opened(documents, chosen, key, text, k), "windows")
    earliest = windows.groupBy("window").agg(F.min(F.struct(key, "pos", "words")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = windows.join(cut(earliest.select("window", "first"), "earliest"), "window").where((F.struct(key, "pos") != F.struct(F.col(f"first.{key}"), F.col("first.pos"))) & (F.col("words") == F.col("first.words")))
    single = later.select(key, F.struct(F.col("pos").alias("start"), (F.col("pos") + k).alias("stop"), F.lit(None).cast("binary").alias("words")).alias("span"))
    # whole paths that repeat an earlier one
    several = classes.where("c > 1")
    chains = compacted(several.where("NOT branches"), key).unionAll(several.where("branches").select("mini", "content", "source", "n"))
    chains = cut(chains, "chains")
    told = source_digests(documents, chains.select(f"source.{key}", "source.start", "n"), key, text, k)
    told = cut(chains.join(told.select(F.struct(key, "start").alias("source"), "n", "words"), ["source", "n"]), "told")
    whole = found.select(key, "start", "mini", "content").join(told, ["mini", "content"]).where(source != F.col("source"))
    whole = whole.select(key, F.struct("start", (F.col("start") + F.col("n") + (k - 1)).alias("stop"), "words").alias("span"))
    return cut(single.unionAll(whole).groupBy(key).agg(F.array_sort(F.collect_list("span")).alias("spans")), "spans")


def kept_words(spans: pa.Array, words: list[bytes]) -> np.ndarray:
    """Words that no span covers whose words are those of its source."""
    keep = np.zeros(len(words) + 1, np.int64)
    start, stop = spans.field("start").to_numpy(), spans.field("stop").to_numpy()
    good = [d is None or digest(words[i:j]) == d for i, j, d in zip(start.tolist(), stop.tolist(), spans.field("words").to_pylist(), strict=True)]
    np.add.at(keep, start[good], 1)
    np.add.at(keep, stop[good], -1)
    return np.cumsum(keep)[: len(words)] == 0


def _keyed(documents: DataFrame, key: str, text: str, named: str) -> tuple[DataFrame, str]:
    """``documents`` and the column that tells them apart: the key itself or,
    where keys are null or repeat, the key with a hash of the text."""
    if documents.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        return documents, key
    return documents.withColumn(named, F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h"))), named


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``documents`` with n_words, n_removed and the text of the kept words,
    joined by single spaces where anything was removed."""
    return _apply(documents, key, text, k, m, digested=False)


def dedup_digest(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256): the digest of the kept words
    joined by one space."""
    return _apply(documents.select(key, text), key, text, k, m, digested=True)


def _apply(documents: DataFrame, key: str, text: str, k: int, m: int, digested: bool) -> DataFrame:
    keep = [key] if digested else documents.columns
    held, other, named = fresh(documents, "spans"), fresh(documents, "repeat_key"), fresh(documents, "doc")
    counts = [fresh(documents.select(keep), c) for c in ("n_words", "n_removed")]
    documents, unique = _keyed(documents, key, text, named)
    spans = repeats(documents, unique, text, k, m)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, BLOCK_BYTES):
            n_words, n_removed, out = [], [], []
            column, lists = b.column(text).cast(pa.binary()).to_pylist(), b.column(held)
            valid = lists.is_valid().to_pylist()
            for i, data in enumerate(column):
                parts = (data or b"").split()
                n_words.append(len(parts))
                if valid[i]:
                    mask = kept_words(lists[i].values, parts)
                    left = [w for w, m in zip(parts, mask.tolist(), strict=True) if m]
                    n_removed.append(len(parts) - len(left))
                    data = b" ".join(left)
                else:
                    n_removed.append(0)
                    data = b" ".join(parts) if digested else data
                out.append(hashlib.sha256(data).hexdigest() if digested else data)
            arrays = {c: b.column(c) for c in keep}
            arrays |= {c: pa.array(n, pa.int64()) for c, n in zip(counts, (n_words, n_removed), strict=True)}
            arrays |= {"kept_sha256": pa.array(out)} if digested else {text: pa.array(out, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    kinds = {c: kinds[c] for c in keep} | dict.fromkeys(counts, "bigint") | ({"kept_sha256": "string"} if digested else {})
    need = documents.select(*dict.fromkeys([*keep, text, unique]))
    joined = need.join(spans.select(F.col(unique).alias(other), F.col("spans").alias(held)), F.col(unique) == F.col(other), "left").drop(other)
    return joined.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))
