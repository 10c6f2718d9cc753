"""Language ID with a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; label transitions
are learned with them. The lexicon is learned too: words that the labelled rows
have at least ``LEXICON_COUNT`` times, nearly always in one language. The
training sequences are spliced from stretches of documents in different
languages, so the model sees code-switched text, and forward-backward gives
every word its label distribution: ``label_words`` returns it. A document's
language is the label with the largest sum over its words; the score is that
label's mean.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS`` rows of
up to ``MAX_CHARS`` characters, ``MAX_WORDS`` words); prediction covers every
word of every text. Features are 64-bit hashes in a sorted array.

Edge cases: null text, or text without a letter, is ``und`` with score 0; so
is every text if no labelled row exists; words without letters are neutral;
very long texts are read whole; equal texts get equal results; null or repeated
keys change neither which rows are in the sample nor how many languages; extra columns are kept and not read, and where one has the name of a
result column the result's name gets a ``_`` at its end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import RunHash, blocks, fresh, lean, mix

#: Bounds of the labelled sample: rows over all languages, words, and characters
#: of a row that may be in it.
MAX_ROWS, MAX_WORDS, MAX_CHARS = 600, 150_000, 50_000
#: A word of the lexicon: how often at least, and the share of its language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9
#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 100_000
#: Bytes of text in one call of the recursions, and words that they go over one by one.
BLOCK_BYTES, STRETCH = 1 << 20, 256
UNKNOWN = "und"
_OTHER = re.compile(r"[^\w\n]|[\d_]")
_PLACE = mix(np.arange(31, 35, dtype=np.uint64)) | np.uint64(1)
_KIND = {k: mix(np.uint64([i]))[0] for i, k in enumerate(("gram", "prefix", "suffix", "word"), 900)}


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words' features, the word that each belongs to, and the
    hash of each whole word (0 without a letter). A word's features are n-grams
    of one to three letters with its borders, affixes of four, and itself."""
    text = _OTHER.sub("", "\n".join(words).lower())
    codes = np.frombuffer(("^" + text.replace("\n", "$\n^") + "$").encode("utf-32-le"), np.uint32)
    line = codes == 10
    owner = np.cumsum(line)
    breaks = np.flatnonzero(line)
    first, last = np.append(0, breaks + 1) + 1, np.append(breaks, len(codes)) - 1  # inside the borders
    some = last > first
    letter = mix(codes.astype(np.uint64) + np.uint64(77))
    at = np.flatnonzero(~line & some[owner])
    hashes, owners = [], []
    for n in (1, 2, 3):
        i = at[at + n <= len(codes)]
        i = i[(owner[i] == owner[i + n - 1]) & ~line[i + n - 1]]
        h = np.full(len(i), _KIND["gram"] + np.uint64(n))
        for j in range(n):
            h += letter[i + j] * _PLACE[j]
        hashes.append(mix(h))
        owners.append(owner[i])
    run, have = RunHash(letter), np.flatnonzero(some)
    first, last = first[have], last[have]
    whole = np.zeros(len(words), np.uint64)
    whole[have] = run(first, last)
    for kind, h in (("prefix", run(first, np.minimum(last, first + 4))), ("suffix", run(np.maximum(first, last - 4), last)), ("word", whole[have])):
        hashes.append(mix(h + _KIND[kind]))
        owners.append(have)
    return np.concatenate(hashes), np.concatenate(owners), whole


class Places:
    """Finds 64-bit keys in a sorted array, through a table of their high bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.shift = np.uint64(64 - max(8, min(20, 4 + int(len(keys)).bit_length())))
        edges = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.float64) * 2.0 ** int(self.shift)
        self.start = np.append(np.searchsorted(keys, edges[:-1].astype(np.uint64)), len(keys)).astype(np.int32)
        self.depth = int(np.diff(self.start).max(initial=0))

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``wanted`` are there, and where."""
        slot = (wanted >> self.shift).astype(np.int64)
        at, stop = self.start[slot], self.start[slot + 1]
        open_ = np.flatnonzero(at < stop)
        found, place = [], []
        for _ in range(self.depth):
            hit = self.keys[at[open_]] == wanted[open_]
            found.append(open_[hit])
            place.append(at[open_[hit]])
            at[open_] += 1
            open_ = open_[~hit]
            open_ = open_[at[open_] < stop[open_]]
        return (np.concatenate(found), np.concatenate(place)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    labels: list[str]
    keys: np.ndarray  # sorted hashes of the features
    weights: np.ndarray  # (features, then one row for each label's lexicon) x labels
    lexicon: np.ndarray  # sorted hashes of words
    language: np.ndarray  # label of each word of the lexicon
    moves: np.ndarray  # labels x labels, log space

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of weights that the words' features have, and their words."""
        if not hasattr(self, "_places"):
            self._places = Places(self.keys), Places(self.lexicon)
        hashes, owner, whole = features(words)
        at, row = self._places[0](hashes)
        word, entry = self._places[1](whole)
        return np.concatenate([row, len(self.keys) + self.language[entry]]), np.concatenate([owner[at], word])

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words for each label."""
        row, owner = self.rows(words)
        return np.stack([np.bincount(owner, self.weights[row, j], len(words)) for j in range(len(self.labels))], 1)


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label distribution of each word. Long sequences are cut into stretches
    that the recursions go over side by side; what a stretch does to the
    messages at its borders is a matrix, so the result is the same."""
    counts = -(-lengths // STRETCH)
    if counts.max(initial=0) <= 1:
        return forward_backward(scores, lengths, moves)[0]
    k, total = scores.shape[1], int(counts.sum())
    last = np.cumsum(counts) - 1
    sizes = np.full(total, STRETCH)
    sizes[last] = lengths - (counts - 1) * STRETCH
    before, behind = np.ones((total, k)), np.ones((total, k))
    inner = np.flatnonzero(np.repeat(counts > 1, counts))
    begin = (np.cumsum(sizes) - sizes)[inner]
    t = np.exp(moves - moves.max())
    emit = np.maximum(np.exp(scores - scores.max(1, keepdims=True)), 1e-30)
    maps = np.broadcast_to(np.eye(k), (len(inner), k, k)).copy()
    for i in range(STRETCH):  # each stretch's product of steps, from the message before to the one behind
        on = np.flatnonzero(sizes[inner] > i)
        m = (maps[on] @ t) * emit[begin[on] + i][:, None, :]
        maps[on] = m / m.sum((1, 2), keepdims=True)
    place = dict(zip(inner.tolist(), range(len(inner)), strict=True))
    end, n = last[counts > 1], counts[counts > 1]
    head = (np.cumsum(lengths) - lengths)[counts > 1]
    ahead = emit[head]  # the first word of a sequence has no step before it
    for i in range(1, STRETCH):
        ahead = (ahead @ t) * emit[head + i]
        ahead /= ahead.sum(1, keepdims=True)
    for a, end, first in zip(ahead, end.tolist(), (end - n + 1).tolist(), strict=True):
        for c in range(first + 1, end + 1):
            before[c] = a @ t
            a = a @ maps[place[c]]
            a = a / a.sum()
        b = np.ones(k)
        for c in range(end, first, -1):
            b = maps[place[c]] @ b
            b = b / b.sum()
            behind[c - 1] = b
    return forward_backward(scores, sizes, moves, before, behind)[0]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label distribution of each word, and the expected counts of transitions.
    ``before`` and ``behind`` are messages into each sequence, if any.

    ``scores`` holds the sequences' emission scores end to end. The steps run
    over all sequences at once, longest first, so step t has those left."""
    n, labels = scores.shape
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")
    emit = np.exp(scores - scores.max(1, keepdims=True))
    emit = np.maximum(emit, 1e-30)
    t = np.exp(moves - moves.max())
    first = np.concatenate(([0], np.cumsum(alive)))
    place = np.empty(n, np.int64)  # of each step's words, step by step
    for i in range(steps):
        place[first[i] : first[i + 1]] = starts[: alive[i]] + i
    e = emit[place]
    f = np.empty_like(e)
    a = None
    for i in range(steps):
        k, now = alive[i], e[first[i] : first[i + 1]]
        a = (now if before is None else now * before[order]) if i == 0 else (a[:k] @ t) * now
        a = a / a.sum(1, keepdims=True)
        f[first[i] : first[i + 1]] = a
    b = np.ones((alive[0] if steps else 0, labels)) if behind is None else behind[order]
    counts = np.zeros((labels, labels))
    for i in range(steps - 1, -1, -1):
        k, here = alive[i], slice(first[i], first[i + 1])
        if i < steps - 1:
            k2 = alive[i + 1]
            out = e[first[i + 1] : first[i + 2]] * b[:k2]
            back = out @ t.T
            joint = f[here][:k2]
            norm = (joint * back).sum(1, keepdims=True)
            counts += t * ((joint / norm).T @ out)
            b[:k2] = back / back.sum(1, keepdims=True)
        e2 = f[here] * b[:k]
        f[here] = e2 / e2.sum(1, keepdims=True)  # the forward values are not needed any more
    out = np.empty_like(f)
    out[place] = f
    return out, counts


def fit(rows: list[tuple[str, str]], steps: int = 30, stretch: int = 25, seed: int = 7) -> Model:
    """Gradient ascent on the conditional likelihood (Adam, small L2)."""
    labels = sorted({lang for _, lang in rows})
    rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(labels)}
    pieces = []
    budget = max(1, MAX_WORDS // max(1, len(labels)))
    used: dict[str, int] = defaultdict(int)
    for text, lang in rows:
        w = text.split()
        if used[lang] and used[lang] + len(w) > budget:
            continue
        used[lang] += len(w)
        pieces += [(w[i : i + stretch], number[lang]) for i in range(0, len(w), stretch)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    types = sorted({w for p, _ in pieces for w in p})
    which = {w: i for i, w in enumerate(types)}
    words = np.array([which[w] for p, _ in pieces for w in p], np.int64)
    gold = np.repeat([k for _, k in pieces], [len(p) for p, _ in pieces])
    lengths = np.array([sum(len(p) for p, _ in pieces[i : i + 8]) for i in range(0, len(pieces), 8)], np.int64)
    k = len(labels)
    goal = np.stack([np.bincount(words, gold == j, len(types)) for j in range(k)], 1)
    hashes, owner, whole = features(types)
    model = Model(labels, np.unique(hashes), np.zeros((0, k)), *lexicon(whole, goal), np.zeros((k, k)))
    flat, owner = model.rows(types)
    n = len(model.keys) + k
    theta = [np.zeros((n, k)), np.zeros((k, k))]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    inner = np.ones(len(words), bool)
    inner[np.cumsum(lengths)[:-1]] = False
    inner = np.flatnonzero(inner[1:]) + 1
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[inner - 1], gold[inner]), 1)
    for step in range(1, steps + 1):
        e = np.stack([np.bincount(owner, theta[0][flat, j], len(types)) for j in range(k)], 1)
        post, moved = forward_backward(e[words], lengths, theta[1])
        gap = goal - np.stack([np.bincount(words, post[:, j], len(types)) for j in range(k)], 1)
        grads = [np.stack([np.bincount(flat, gap[owner, j], n) for j in range(k)], 1) - 0.1 * theta[0], pairs - moved - 0.1 * theta[1]]
        for x, g, a, b in zip(theta, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    model.weights, model.moves = theta[0].astype(np.float32), theta[1]
    del model._places  # each worker makes its own
    return model


def lexicon(whole: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, label of each) of frequent words of one language."""
    keys, at = np.unique(whole, return_inverse=True)
    sums = np.stack([np.bincount(at, c, len(keys)) for c in counts.T], 1)
    total = sums.sum(1)
    good = (keys != 0) & (total >= LEXICON_COUNT) & (sums.max(1) >= LEXICON_SHARE * total)
    return keys[good], sums[good].argmax(1)


class Predictor:
    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.scores = np.zeros((0, len(model.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def posteriors(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Label distributions of the documents' words end to end, and which
        of the words have a letter."""
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
        new: set[str] = set()
        for d in docs:
            new.update(d)
        if new := [w for w in new if w not in self.rows]:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.emissions(new).astype(np.float32)])
            self.letters = np.concatenate([self.letters, [any(map(str.isalpha, w)) for w in new]])
        lengths = np.array([len(d) for d in docs], np.int64)
        ids = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(docs)), np.int64, lengths.sum())
        return posteriors(self.scores[ids], lengths[lengths > 0], self.model.moves), self.letters[ids]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        model, docs = self.model, [t.split() if t else [] for t in texts]
        lengths = np.array([len(d) for d in docs], np.int64)
        labels, score = [UNKNOWN] * len(docs), np.zeros(len(docs))
        if not model.labels or not lengths.sum():
            return labels, score
        post, weight = self.posteriors(docs)
        full = lengths > 0
        first = (np.cumsum(lengths) - lengths)[full]
        post *= weight[:, None]
        sums = np.add.reduceat(post, first)
        count = np.add.reduceat(weight, first, dtype=np.int64)
        best = sums.argmax(1)
        for d, b, s, c in zip(np.flatnonzero(full), best, sums.max(1), count, strict=True):
            if c:
                labels[d], score[d] = model.labels[b], min(1.0, s / c)
        return labels, score

    def words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, label, probability) of each word; ``und`` without a letter."""
        parts = text.split() if text else []
        if not parts or not self.model.labels:
            return [(w, UNKNOWN, 0.0) for w in parts]
        post, letter = self.posteriors([parts])
        return [(w, self.model.labels[b], p) if ok else (w, UNKNOWN, 0.0) for w, b, p, ok in zip(parts, post.argmax(1).tolist(), post.max(1).tolist(), letter.tolist(), strict=True)]


def held_out(key: str = "doc_id"):
    """Rows that the model never sees: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train(documents: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled rows, as many of each language as
    there are: those with the smallest hashes of id, text and language, so that
    neither null or repeated ids nor the order of files matter. Rows equal in
    all three count once. Two narrow passes: the hashes that are in for each
    language, then their rows."""
    known = (
        documents.select("doc_id", "text", "lang")
        .where(F.col("lang").isNotNull() & (F.char_length("text") <= MAX_CHARS) & ~F.coalesce(held_out(), F.lit(False)))
        .select("text", "lang", F.xxhash64("doc_id", "text", "lang").alias("h"))
    )
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()]
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 0)))
    each = max(1, max_rows // len(langs))
    first = known.where(F.col("lang").isin(langs)).selectExpr("lang", "h", "dense_rank() over (partition by lang order by h) as n").where(F.col("n") <= each)
    bounds = first.groupBy("lang").agg(F.max("h").alias("most")).collect()
    inside = F.coalesce(*(F.when(F.col("lang") == b["lang"], F.col("h") <= b["most"]) for b in bounds), F.lit(False))
    rows = known.where(inside).dropDuplicates(["h"]).collect()
    return fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["h"], r["text"], r["lang"]))])


def predict(documents: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` with the language and its score; a narrow map."""
    label, score = fresh(documents, label), fresh(documents, score)
    return _mapped(documents, model, text, {label: "string", score: "double"}, lambda p, texts: [pa.array(x) for x in p(texts)])


def label_words(documents: DataFrame, model: Model, text: str = "text", words: str = "words") -> DataFrame:
    """``documents`` with array<struct<word, lang, score>>: each word's language."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
    named = lambda p, texts: [pa.array([[dict(zip(("word", "lang", "score"), w, strict=True)) for w in p.words(t)] for t in texts], kind)]
    return _mapped(documents, model, text, {fresh(documents, words): "array<struct<word: string, lang: string, score: double>>"}, named)


def _mapped(documents: DataFrame, model: Model, text: str, added: dict[str, str], made) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS
    keep = documents.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema] + [f"`{c}` {t}" for c, t in added.items()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for b in blocks(batches, text, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([*b.columns, *made(predictor, b.column(text).to_pylist())], [*keep, *added])

    return documents.mapInArrow(run, ", ".join(kinds))
