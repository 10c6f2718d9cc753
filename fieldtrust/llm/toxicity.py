"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, other documents are unlabelled: they
are mostly clean, but their share ``prior`` is toxic too. A classifier over the
words of a text minimises the corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

whose second part is the risk on clean documents; where it falls below zero,
which clean risk can't, the step goes the other way. A text's logit is a bias
plus its ``POOL`` weightiest features, so that a long clean text doesn't add up
thousands of small weights and one insult in a long text counts in full.

The prior, if not given, is the larger of two estimates: the share of toxic ones
among the labelled documents, and that of the best bin: over held-back halves,
the least ratio of unlabelled to positive documents above a score.

The model is fitted on a bounded sample (``MAX_POSITIVE`` and ``MAX_UNLABELLED``
different rows of up to ``MAX_CHARS`` characters, those with the smallest hashes,
of those that share a passage one); scores are of every word of every text. Features are words,
runs of letters in lower case, and their first bytes; of those in the sample, up
to ``MAX_FEATURES`` that mark positives by more than chance have weights.

Edge cases: a null or empty text has the score of a text without marked words;
without a positive all scores are 0; null ids carry no label and are not held
out; repeated rows count once in the sample and get equal scores; a document
with several labels is toxic if one of them says so; extra columns are kept and
not read, and where one has the name of a result the result's name gets a ``_``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import RunHash, blocks, fresh, lean, mix, text_buffer, word_hashes, words

#: Bounds of the sample, and of the features that have weights.
MAX_POSITIVE, MAX_UNLABELLED, MAX_CHARS, MAX_FEATURES = 2000, 6000, 50_000, 1024
#: Documents of both samples that a feature must be in, and the share of the
#: chosen features that may be more frequent in positives by chance.
LEAST_DOCUMENTS, FALSE_SHARE = 5, 0.05
#: Features of a text whose weights are added up.
POOL = 1
THRESHOLD, MAX_WEIGHT = 0.7, 12.0
#: Bytes of a word's first letters that are a feature, as the word itself is.
PREFIXES = (4, 5, 6, 7, 8)
#: Hashes of five words by which documents of the sample that share a passage
#: are told.
KEYS = 16
#: ASCII characters other than letters part words.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32
_SALTS = mix(np.arange(70, 70 + len(PREFIXES), dtype=np.uint64)) | np.uint64(1)


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes of the features: of all words, then of all prefixes of
    each length of the words that are longer. Rows ascend."""
    values, offsets = text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    values = _LETTERS[values]
    starts, ends, first = words(values, offsets)
    rows = np.repeat(np.arange(len(texts)), np.diff(first))
    yield rows, word_hashes(values, starts, ends)
    for n, salt in zip(PREFIXES, _SALTS, strict=False):
        long = ends - starts > n
        rows, starts, ends = rows[long], starts[long], ends[long]
        yield rows, word_hashes(values, starts, starts + n) ^ salt


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, by row."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))[: len(rows)]
    return rows[new], hashes[new]


def copy_keys(n: int, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The ``KEYS`` smallest hashes of each row's runs of five words (of all its
    words where it has fewer): rows with a passage in common share some."""
    out = np.zeros((n, KEYS), np.uint64)
    runs = RunHash(hashes)
    ends = np.searchsorted(rows, np.arange(n), "right")
    for i, (start, end) in enumerate(zip(np.searchsorted(rows, np.arange(n)), ends, strict=True)):
        if end > start:
            at = np.arange(start, max(start + 1, end - 4))
            found = np.unique(runs(at, np.minimum(at + 5, end)))[:KEYS]
            out[i] = np.resize(found, KEYS)
    return out


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    prior: float
    seen: np.ndarray | None = None  # by the lowest bits, for speed

    def marked(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places in ``features`` of the hashes that have a weight."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.seen is None:
            self.seen = np.zeros(1 << 16, bool)
            self.seen[self.features & np.uint64(0xFFFF)] = True
        maybe = self.seen[hashes & np.uint64(0xFFFF)]
        rows, hashes = rows[maybe], hashes[maybe]
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        known = self.features[at] == hashes
        return rows[known], at[known]

    def chances(self, texts: pa.Array) -> np.ndarray:
        if not self.prior:
            return np.zeros(len(texts))
        found = [self.marked(*x) for x in hashed(texts)]
        rows, at = distinct(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        return _sigmoid(self.logits(len(texts), rows, at))

    def logits(self, n: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        kept = pooled(rows, self.weights[at])
        return self.bias + np.bincount(rows[kept], self.weights[at[kept]], n)


def pooled(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Places of the ``POOL`` largest absolute weights of each row; the
    result is in the order of rows."""
    order = np.lexsort((-np.abs(weights), rows))
    sorted_rows = rows[order]
    rank = np.arange(len(rows)) - np.searchsorted(sorted_rows, sorted_rows)
    return order[rank < POOL]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, rows: np.ndarray, hashes: np.ndarray, prior: float, steps: int = 300, decay: float = 0.001) -> Model:
    """Minimises the non-negative risk by gradient steps (Adam) on numpy arrays:
    ``positive`` says of each row which sample it is of, ``rows`` and ``hashes``
    are its words."""
    n, n_pos = len(positive), max(1, int(positive.sum()))
    n_unl = max(1, n - n_pos)
    vocabulary, at = np.unique(hashes, return_inverse=True)
    both = np.bincount(at, minlength=len(vocabulary))
    pos = np.bincount(at, positive[rows], len(vocabulary))
    unl = both - pos
    p, u = pos / n_pos, unl / n_unl
    term = lambda k, rate: k * np.log(np.where(k > 0, rate, 1.0) / np.where(k > 0, both / (n_pos + n_unl), 1.0))
    evidence = np.where(p > u, 2 * (term(pos, p) + term(unl, u)), 0.0)
    good = np.flatnonzero(both >= LEAST_DOCUMENTS)
    good = good[np.lexsort((vocabulary[good], -evidence[good]))]
    # Benjamini and Hochberg's bound over the tails of the chi-squared distribution
    tail = np.exp(-evidence[good] / 2) / np.sqrt(2 * np.pi * np.maximum(evidence[good], 1))
    passed = np.flatnonzero(tail * len(good) <= FALSE_SHARE * np.arange(1, len(good) + 1))
    good = np.sort(good[: min(passed[-1] + 1 if len(passed) else 0, MAX_FEATURES)])
    bias = float(np.log(prior / (1 - prior)))
    toxic = np.clip(prior * p[good] / (u[good] + 1 / n_unl), 0.02, 0.98)
    model = Model(vocabulary[good], np.log(toxic / (1 - toxic)) - bias, bias, prior)
    rows, at = model.marked(rows, hashes)
    share = np.where(positive, 1 / n_pos, 1 / n_unl)
    theta = np.append(model.weights, model.bias)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        if step % 10 == 1:
            kept = pooled(rows, theta[at])
            r, a = rows[kept], at[kept]
        chance = _sigmoid(theta[-1] + np.bincount(r, theta[a], n))
        loss = np.logaddexp(0, theta[-1] + np.bincount(r, theta[a], n))  # of calling a row toxic where it is clean
        clean = float((loss * share)[~positive].sum() - prior * (loss * share)[positive].sum())
        of_clean = np.where(positive, -prior, 1.0) * share * chance
        g = of_clean + np.where(positive, prior * share * (chance - 1), 0.0) if clean >= 0 else -of_clean
        gradient = np.append(np.bincount(a, g[r], len(theta) - 1), g.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[:-1] *= 1 - decay
        theta = np.clip(theta, -MAX_WEIGHT, MAX_WEIGHT)
    return Model(model.features, theta[:-1], float(theta[-1]), prior)


def estimated_prior(positive: np.ndarray, rows: np.ndarray, hashes: np.ndarray, labelled: float) -> float:
    """The larger of the labelled share and the best bin's estimate."""
    half = np.arange(len(positive)) % 2 == 0
    found = min(max(labelled, 0.005), 0.9)
    if positive[half].sum() < 10 or positive[~half].sum() < 10:
        return found
    inside, number = half[rows], np.cumsum(half) - 1
    model = fit(positive[half], number[rows[inside]], hashes[inside], found, 100)
    logit = model.logits(len(positive), *model.marked(rows, hashes))[~half]
    pos, unl = np.sort(logit[positive[~half]]), np.sort(logit[~positive[~half]])
    if not len(unl):
        return found
    cuts = np.unique(pos)[1:]
    above_pos = 1 - np.searchsorted(pos, cuts) / len(pos)
    above_unl = 1 - np.searchsorted(unl, cuts) / len(unl)
    sure = (above_pos >= 0.1) & (above_pos * len(pos) >= 8)
    if not sure.any():
        return found
    doubt = np.sqrt(above_unl[sure] / len(unl)) / above_pos[sure]
    ratio = above_unl[sure] / above_pos[sure]
    return float(min(max(found, ratio[np.argmin(ratio + doubt)]), 0.9))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _drawn(rows: DataFrame, most: int, n: int) -> DataFrame:
    """Different rows (h, text) with the smallest ``h``, ``most`` of them; ``n``
    is about the number of rows."""
    share = min(1.0, 4 * most / max(1, n))
    some = rows.where(F.pmod("h", F.lit(1 << 32)) <= int(share * (1 << 32)))
    bound = some.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return some.where(F.col("h") <= F.lit(bound)).dropDuplicates(["h"])


def train(documents: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Fits on ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    known = labels.select("doc_id", "toxic").where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rows = documents.where((F.char_length("text") <= MAX_CHARS) & ~held_out()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    toxic = marks.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(4 * MAX_POSITIVE)
    confirmed = rows.join(F.broadcast(toxic), "doc_id", "left_semi").drop("doc_id")  # bounded ids
    sample = _drawn(confirmed, MAX_POSITIVE, toxic.count()).withColumn("positive", F.lit(True)).unionByName(
        _drawn(rows.drop("doc_id"), MAX_UNLABELLED, documents.count()).withColumn("positive", F.lit(False))
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            found = list(hashed(b.column("text")))
            keys = copy_keys(b.num_rows, *found[0]).view(np.int64)
            at, hashes = distinct(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            cuts = np.searchsorted(at, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("positive"), pa.FixedSizeListArray.from_arrays(keys.ravel(), KEYS).cast(pa.list_(pa.int64())), lists],
                ["h", "positive", "keys", "features"],
            )

    # bounded, see above
    got = sample.mapInArrow(run, "h long, positive boolean, keys array<long>, features array<long>").toArrow().combine_chunks()
    got = got.sort_by([("positive", "ascending"), ("h", "ascending")]).combine_chunks()
    positive = got["positive"].to_numpy(zero_copy_only=False).astype(bool)
    if not positive.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0, 0.0)
    # of documents that share a passage, the first of each sample stays: words
    # of the passage would count once for each
    keys = pc.list_flatten(got["keys"]).to_numpy().reshape(-1, KEYS)
    keys = np.where(keys == 0, -1 - np.arange(len(keys))[:, None], keys ^ (positive.astype(np.int64) << 62)[:, None])
    _, first, which = np.unique(keys.ravel(), return_index=True, return_inverse=True)
    again = (first[which].reshape(keys.shape) // KEYS < np.arange(len(keys))[:, None]).any(1)
    kept = np.flatnonzero(~again)
    got, positive = got.take(kept), positive[kept]
    lengths = pc.list_value_length(got["features"]).to_numpy()
    rows = np.repeat(np.arange(len(positive)), lengths)
    hashes = pc.list_flatten(got["features"]).to_numpy().view(np.uint64)
    return fit(positive, rows, hashes, prior or estimated_prior(positive, rows, hashes, labelled))


def score(
    documents: DataFrame, model: Model, text: str = "text", name: str = "score", predicted: str = "predicted", keep: Sequence[str] | None = None
) -> DataFrame:
    """``documents`` (or their columns ``keep``) with the chance that each is
    toxic, and whether it reaches the threshold; a narrow map."""
    name, predicted = fresh(documents, name), fresh(documents, predicted)
    kept = list(keep if keep is not None else documents.columns)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES
    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept] + [f"`{name}` double", f"`{predicted}` int"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in blocks(batches, text, 1 << 20):
            chance = model.chances(b.column(text))
            added = [pa.array(chance), pa.array((chance >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *added], [*kept, name, predicted])

    return documents.mapInArrow(run, ", ".join(kinds))
