"""Sequence packing by lexical retrieval.

Documents are put in an order in which like ones are neighbours, by two
MinHash values of their words, and dealt to shards of about ``SHARD_BYTES``
along it: two documents are in one shard as likely as they share words,
wherever in the input they stand. Each shard has a BM25 inverted index over its
documents, whose document frequencies, count and mean length come from the
whole corpus. A seed document opens a window; all its terms query the index,
and the unused neighbours that it returns fill the window greedily, best first,
as whole pieces while they fit; the best one left is then cut to close the
window exactly, and its rest stays unused. Without neighbours the next unused
document takes their place. Only a shard's last window is not full.

A word that many documents choose as their MinHash fills many shards, in the
order of the second value and then of a hash, so no task grows with it. Corpus
frequencies are held for ``SLOTS`` hash slots of the terms, so their size is
fixed: colliding terms share a count, which only blurs rare terms.

Edge cases: a null or empty text is the end id alone; very long documents fill
windows of their own and their last piece is a seed; repeated rows are packed
each on its own, with null or equal keys too; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.bpe import PATTERN, byte_alphabet
from fieldtrust.llm.common import LOWER, blocks, cut, lean, mix, text_buffer, word_hashes, words

WINDOW, END_ID = 2048, 1
#: Bytes of text of a shard, and shards of a task.
SHARD_BYTES, TASK_SHARDS = 4 << 20, 4
SLOTS = 1 << 18
ROWS32 = (1 << 32) // SLOTS
#: BM25's parameters.
K1, B = 1.2, 0.75
#: A term that so large a share of a shard's documents has is a matrix column.
DENSE = 1 / 8


class Tokens:
    """Ids of whole texts as the tokenizer file defines them; the merge work is
    done by tiktoken where ids follow the merge order, else by tokenizers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        if made == sorted(made) and spec.get("normalizer") is None:
            import tiktoken

            self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self.split, self.encode = None, lambda text: whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.split is None or not any(s in text for s in self.special):
            return self.encode(text)
        return [i for part in self.split.split(text) for i in ([self.special[part]] if part in self.special else self.encode(part))]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """A worker's tokenizer, kept for its next task: some 20 MB."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def term_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def signed(documents: DataFrame) -> DataFrame:
    """``documents`` (key, text) with two MinHash values of the words, near and
    far; and at the end of each task rows (slot, n) without a text: document
    frequencies of the slots and, as slots -1 to -3, documents, words, bytes."""
    kind = documents.schema["key"].dataType.simpleString()
    names = ["key", "text", "near", "far", "slot", "n"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, total, size, key_type = np.zeros(SLOTS, np.int64), 0, 0, 0, None
        for b in blocks(batches, "text"):
            key_type = b.column("key").type
            values, offsets = text_buffer(b.column("text"))
            s, e, first = words(values, offsets)
            hashes = word_hashes(LOWER[values], s, e)
            slots = term_slots(hashes)
            for lo in range(0, b.num_rows, ROWS32):  # so many rows that row and slot fit in 32 bits
                hi = min(b.num_rows, lo + ROWS32)
                row = np.repeat(np.arange(hi - lo, dtype=np.uint32), np.diff(first[lo : hi + 1]))
                pairs = np.sort(row * np.uint32(SLOTS) + slots[first[lo] : first[hi]].astype(np.uint32))
                new = np.ones(len(pairs), bool)
                new[1:] = pairs[1:] != pairs[:-1]
                counts += np.bincount(pairs[new] % np.uint32(SLOTS), minlength=SLOTS)
            docs, total, size = docs + b.num_rows, total + len(s), size + len(values)
            least = np.zeros((2, b.num_rows), np.uint64)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                for i, salt in enumerate((3, 5)):
                    least[i, some] = np.minimum.reduceat(mix(hashes ^ np.uint64(salt)), first[:-1][some])
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text"), *(pa.array(x.view(np.int64)) for x in least), none.cast(pa.int32()), none], names)
        if docs:
            at = np.flatnonzero(counts)
            slot, n = np.concatenate([at, [-1, -2, -3]]), np.concatenate([counts[at], [docs, total, size]])
            none = pa.nulls(len(slot), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), key_type), pa.nulls(len(slot), pa.string()), none, none, pa.array(slot, pa.int32()), pa.array(n)], names)

    return documents.mapInArrow(run, f"key {kind}, text string, near bigint, far bigint, slot int, n bigint")


def corpus_statistics(rows: DataFrame) -> tuple[np.ndarray, int, float, int]:
    """Document frequency of each slot, number of documents, mean of their
    words, bytes of all texts, from the rows of ``signed``."""
    sums = rows.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = sums["slot"].to_numpy(), sums["n"].to_numpy()  # at most SLOTS + 3 rows
    frequency = np.zeros(SLOTS + 3, np.int64)
    frequency[slots] = n  # the negative ones are the last places
    docs, total, size = map(int, frequency[[-1, -2, -3]])
    return frequency[:SLOTS], docs, total / max(1, docs), size


class Index:
    """BM25 postings of a shard's documents, sorted by term; those of frequent
    terms as columns of a matrix."""

    def __init__(self, column: pa.Array, frequency: np.ndarray, docs: int, mean: float):
        values, offsets = text_buffer(column)
        s, e, first = words(values, offsets)
        self.n = len(offsets) - 1
        hashes = word_hashes(LOWER[values], s, e)
        row = np.repeat(np.arange(self.n), np.diff(first))
        which, terms = pd.factorize(hashes)  # a term's number: its first place
        pairs = np.sort(which * max(1, self.n) + row)
        new = np.flatnonzero(np.diff(pairs, prepend=-1))
        tf, pairs = np.diff(np.append(new, len(pairs))), pairs[new]
        term, self.doc = np.divmod(pairs, max(1, self.n))
        self.start = np.searchsorted(term, np.arange(len(terms) + 1))
        df = frequency[term_slots(terms)]
        idf = np.log1p((docs - df + 0.5) / (df + 0.5))
        length = np.diff(first)[self.doc]
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))
        own = np.diff(self.start)
        wide = own > max(1, DENSE * self.n)
        at = np.flatnonzero(wide[term])
        self.dense = np.zeros((self.n, int(wide.sum())), np.float32)
        self.dense[self.doc[at], np.cumsum(wide)[term[at]] - 1] = self.weight[at]
        # of each document, the other terms that some other document has too
        shared = np.flatnonzero(((own > 1) & ~wide)[term])
        by_doc = shared[np.argsort(self.doc[shared], kind="stable")]
        ends = np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))
        self.query = np.split(term[by_doc], ends[1:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's terms."""
        terms = self.query[seed]
        score = np.zeros(self.n)
        if len(terms):
            begin, size = self.start[terms], self.start[terms + 1] - self.start[terms]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        if self.dense.shape[1]:  # no matrix product: its library would start threads of its own
            score += np.einsum("ij,j->i", self.dense, (self.dense[seed] > 0).astype(np.float32))
        return score

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents with a term of the seed, best first."""
        score = self.scores(seed)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def plan(sizes: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard."""
    out: list[tuple[int, int, int, int, int]] = []
    left = sizes.copy()
    sequence, space, following = 0, window, 0

    def take(d: int, most: int) -> None:
        nonlocal space
        n = int(min(left[d], most))
        out.append((d, int(sizes[d] - left[d]), n, sequence, window - space))
        left[d] -= n
        space -= n

    while True:
        while following < len(sizes) and not left[following]:
            following += 1
        if following == len(sizes):
            return out
        seed = following
        while left[seed]:  # whole windows of a long document, then its last piece
            take(seed, space)
            if not space:
                sequence, space = sequence + 1, window
        if space == window:
            continue
        score = index.scores(seed) * (left > 0)
        while space:  # the best that fits; what doesn't fit now won't fit later
            fit = np.where(left <= space, score, 0.0)
            best = int(fit.argmax())
            if not fit[best] > 0:
                break
            take(best, space)
            score[best] = 0
        while space:  # the best of all is cut, without any the next
            best = int(score.argmax())
            if not score[best] > 0:
                rest = np.flatnonzero(left[following:])[:1] + following
                if not len(rest):
                    return out
                best = int(rest[0])
            take(best, space)
            score[best] = 0
        sequence, space = sequence + 1, window


def _packed(documents: DataFrame, tokenizer: str, window: int, end_id: int, key: str, text: str, fields: list[str], values) -> DataFrame:
    rows = cut(signed(documents.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))), "signed")
    frequency, docs, mean, size = corpus_statistics(rows)
    statistics = documents.sparkSession.sparkContext.broadcast(frequency)  # SLOTS counts
    kind, shard_bytes = documents.schema[key].dataType.simpleString(), SHARD_BYTES
    kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}

    def packed(keys: pa.Array, texts: pa.Array, encode: Tokens, number: int) -> tuple[pa.RecordBatch, int]:
        ids = [np.frombuffer(array("I", encode(t) + [end_id]), np.uint32) for t in texts.to_pylist()]
        sizes = np.array(list(map(len, ids)), np.int64)
        pieces = plan(sizes, Index(texts, statistics.value, docs, mean), window)
        d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        extra = [values(ids[i][s : s + n]) for i, s, n, _, _ in pieces]
        arrays = [start, length, extra, sizes[d], sequence + number, offset]
        made = pa.RecordBatch.from_arrays([keys.take(pa.array(d)), *(pa.array(a, kinds[f.split()[1]]) for a, f in zip(arrays, fields, strict=True))], [key, *(f.split()[0] for f in fields)])
        return made, number + int(sequence[-1]) + 1

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, held, full = tokens(tokenizer), TaskContext.get().partitionId() << 32, [], 0
        for b in blocks(batches, "text", shard_bytes // 4):
            held.append(b)
            full += b.column("text").nbytes
            if full >= shard_bytes:
                shard = pa.Table.from_batches(held).combine_chunks()
                held, full = [], 0
                made, number = packed(*(shard[c].combine_chunks() for c in ("key", "text")), encode, number)
                yield made
        if held:
            shard = pa.Table.from_batches(held).combine_chunks()
            yield packed(*(shard[c].combine_chunks() for c in ("key", "text")), encode, number)[0]

    order = ["near", "far", F.xxhash64("key", "text")]
    dealt = rows.where("slot IS NULL").repartitionByRange(max(1, -(-size // (shard_bytes * TASK_SHARDS))), *order).sortWithinPartitions(*order)
    return dealt.select("key", "text").mapInArrow(run, f"{key} {kind}, {', '.join(fields)}")


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece, with its ids."""
    fields = ["start bigint", "length bigint", "ids array<int>", "doc_tokens bigint", "sequence_id bigint", "offset bigint"]
    return _packed(documents, tokenizer, window, end_id, key, text, fields, lambda ids: ids.astype(np.int32))


def pack_digest(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with a checksum in the place of the ids."""
    fields = ["start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"]
    return _packed(documents, tokenizer, window, end_id, key, text, fields, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
