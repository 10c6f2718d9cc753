"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a block of texts form a trie. Walking it depth first
(the sorted word list is that walk), each node keeps its *last-token state*:
the last token of the encoding of the prefix that ends there. A token ``t``
that ends at a node is that state exactly if the state ``t`` bytes up forms a
stable pair with it, so every shared prefix is encoded once and a word's ids
are read off by following the states back.

Edge cases: null text is empty; an empty text has no ids, the digest of an
empty string and decodes to itself; very long words cost time linear in their
length; repeated rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldtrust.llm.common import blocks, lean

#: The byte-level pre-tokeniser's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct chunks and words that a worker remembers before it starts afresh.
CACHE_WORDS = 500_000
NEVER = 1 << 60
#: A space before other white space or the end: not every space is a cut.
SIMPLE = re.compile(r" (?:\s|$)")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes sets of words; ``ids`` of one word are a tuple of ints."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = lambda token: bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): n for n, (a, b) in enumerate(merges)}
        self.halves = {a + b: ((a, b), n) for (a, b), n in reversed(self.rank.items())}  # a token's first merge wins
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.stable: dict[int, bool] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(PATTERN)

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of a token while it is merged, from
        a single byte up, each with the rank of the merge that ends it."""
        out = [(token, NEVER)]
        while len(token) > 1:
            parts, rank = self.halves[token]
            token = parts[side]
            out.append((token, rank))
        return out[::-1]

    def pair(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side: no merge over
        their border outranks the merges that build them."""
        a, b = self.edge(self.bytes[left], 1), self.edge(self.bytes[right], 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            over = self.rank.get((x, y), NEVER)
            if over < x_ends and over <= y_ends and over < NEVER:  # of equal ranks the leftmost goes first
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_words(self, words: set[str]) -> None:
        """Adds the words' ids to ``self.words``: one depth-first walk. The
        automaton lists the tokens that end at each byte, longest first."""
        pair, stable, tokens = self.pair, self.stable, self.automaton.iter
        if len(stable) > 1_000_000:
            stable.clear()
        path, states, sizes = "", [-1], [0]  # states[n]: the last token of path[:n]
        for data, word in sorted((w if w.isascii() else w.encode().decode("latin-1"), w) for w in words):
            shared = 0
            for a, b in zip(path, data, strict=False):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], sizes[shared + 1 :]
            done = shared + 1  # the next prefix length without a state
            if shared < len(data):
                for end, (token, size) in tokens(data):
                    if end + 1 < done:
                        continue
                    before = states[end + 1 - size]
                    if before >= 0:
                        key = before << 20 | token
                        if (ok := stable.get(key)) is None:
                            ok = stable[key] = pair(before, token)
                        if not ok:
                            continue
                    states.append(token)
                    sizes.append(size)
                    done += 1
            if len(states) <= len(data):
                raise ValueError("the vocabulary lacks a byte")
            path, end, found = data, len(data), []
            while end:
                found.append(states[end])
                end -= sizes[end]
            self.words[word] = tuple(found[::-1])

    def chunks(self, text: str) -> list[str]:
        """Cuts where a space precedes a non-space: always a word boundary of
        the pattern, so chunks can be split into words on their own."""
        if not text:
            return []
        out = text.split(" ") if SIMPLE.search(text) is None else re.split(r" (?=\S)", text)
        return [out[0], *(" " + x for x in out[1:])] if out[0] else [" " + x for x in out[1:]]

    def spans(self, text: str) -> list[str]:
        """The text around special tokens, and those."""
        return [x for x in self.split.split(text) if x] if self.split and any(t in text for t in self.special) else [text] if text else []

    def learn(self, chunks: set[str], memo: dict) -> None:
        """memo[chunk] = its ids, through the trie of the chunks' words."""
        findall = self.pattern.findall
        # ASCII letters behind one character, a letter or the chunk's space, are one word of the pattern
        split = {c: (c,) if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else findall(c) for c in chunks}
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        self.encode_words({w for parts in split.values() for w in parts if w not in self.words})
        for c, parts in split.items():
            memo[c] = tuple(i for w in parts for i in self.words[w]) if len(parts) > 1 else self.words[parts[0]]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts, special tokens read as the library reads them."""
        cut = [[(s, None) if s in self.special else (s, self.chunks(s)) for s in self.spans(t or "")] for t in texts]
        memo: dict[str, tuple[int, ...]] = {}
        self.learn({c for doc in cut for _, cs in doc if cs for c in cs}, memo)
        return [[i for s, cs in doc for part in ([(self.special[s],)] if cs is None else map(memo.__getitem__, cs)) for i in part] for doc in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Digests:
    """Per text: count of ids, their decimal text and the decoded bytes, joined
    from what was computed once for each distinct chunk."""

    def __init__(self, path: str):
        self.bpe, self.memo = TrieEncoder(path), {}
        self.decimal = {i: b",%d" % i for i in self.bpe.bytes}

    def value(self, ids: tuple[int, ...]) -> tuple[int, bytes, bytes]:
        return len(ids), b"".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.bpe.bytes.__getitem__, ids))

    def __call__(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """No cycles arise here, and the collector would walk the caches again and again."""
        gc.disable()
        try:
            return list(self.each(texts))
        finally:
            gc.enable()

    def each(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        bpe, memo = self.bpe, self.memo
        docs = [[c for s in bpe.spans(t) for c in ([s] if s in bpe.special else bpe.chunks(s))] if t else [] for t in texts]
        if len(memo) > CACHE_WORDS:
            memo.clear()
        new: set[str] = set()
        for d in docs:
            new.update(d)
        new = {c for c in new if c not in memo}
        ids = {s: (bpe.special[s],) for s in new if s in bpe.special}
        bpe.learn(new - ids.keys(), ids)
        memo.update((c, self.value(x)) for c, x in ids.items())
        for d in docs:
            if d:
                counts, decimal, data = zip(*map(memo.__getitem__, d), strict=True)
                yield sum(counts), hashlib.sha256(b"".join(decimal)[1:]).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()
            else:
                yield 0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest()


_made: dict[tuple[str, str], object] = {}


def made(kind, path: str):
    """One encoder for each worker process."""
    key = kind.__name__, path
    if key not in _made:
        _made[key] = kind(path)
    return _made[key]


def encode(documents: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded string): encodes and decodes whole texts.
    A narrow map: no shuffle, memory bounded by a block of texts."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = made(TrieEncoder, tokenizer)
        for b in blocks(batches, text):
            ids = bpe.encode_batch(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], [key, "ids", "decoded"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")


def encode_digest(documents: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s results,
    without sending the ids through Arrow."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = made(Digests, tokenizer)
        for b in blocks(batches, text):
            n, ids, decoded = zip(*digests(b.column(text).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
