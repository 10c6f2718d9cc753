"""URL filters over a sorted digest array.

Rules (host, path, verdict) become sorted 64-bit xxhash keys with their full
strings. Executors memory-map the keys, probe all candidates of a batch of urls
(host suffixes at label borders, with the path prefixes of the lengths that
rules have) by one vectorised binary search, and confirm hits on the stored
strings, so that a colliding key changes nothing. The longest fitting rule wins.

An array of up to ``MAX_BYTES`` is sent to all executors. Larger rule sets are
dealt to several such arrays by a hash; the distinct candidates are dealt alike
and probe the array of their shard in the same way.

Edge cases: a null url, or one without ``://``, has empty host and path and no
rule; an empty rule set gives every url the default verdict; of repeated rules
the first verdict in alphabetical order holds; repeated rows give equal rows;
extra columns are not read; only host suffixes of lengths that rules have are
tried, so a host of very many labels costs no more than its length times these.
Verdicts are whatever strings the rules hold.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import cut, lean

#: Largest rule table that is sent whole.
MAX_BYTES = 64 << 20
DEFAULT = "allow"
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def rule_text(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode()


def candidates(host: str, path: str, sizes: list[int], lengths: frozenset[int]) -> list[bytes]:
    """Strings of the rules that would fit, longest hosts first. ``sizes`` and
    ``lengths``: those of the rules' paths and hosts."""
    if not host:
        return []
    starts, at = [0], 0
    while (at := host.find(".", at) + 1) > 0:
        starts.append(at)
    hosts = [host[i:] for i in starts if len(host) - i in lengths]
    return [rule_text(h, path[:n]) for h in hosts if h for n in sizes if n <= len(path)]


class DigestTable:
    """The memory-mapped array: keys, offsets and strings in one file, which
    has no name any more once it is mapped."""

    def __init__(self, packed: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.map, np.int64, 1)[0])
        self.keys = np.frombuffer(self.map, np.uint64, n, 8)
        self.ends = np.frombuffer(self.map, np.int64, n, 8 + 8 * n)
        self.code = np.frombuffer(self.map, np.int32, n, 8 + 16 * n)
        self.base = 8 + 20 * n

    @staticmethod
    def pack(rules: list[tuple[bytes, int]]) -> bytes:
        """rules: (string, code), distinct strings."""
        rules = sorted((xxhash.xxh64_intdigest(t), t, b) for t, b in rules)
        parts = [
            np.array([len(rules)], np.int64),
            np.array([k for k, _, _ in rules], np.uint64),
            np.cumsum([len(t) for _, t, _ in rules], dtype=np.int64),
            np.array([b for _, _, b in rules], np.int32),
        ]
        return b"".join(p.tobytes() for p in parts) + b"".join(t for _, t, _ in rules)

    def text(self, i: int) -> bytes:
        start = int(self.ends[i - 1]) if i else 0
        return self.map[self.base + start : self.base + int(self.ends[i])]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """Index of each string's rule, -1 without one."""
        found = np.full(len(texts), -1)
        if not texts or not len(self.keys):
            return found
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal keys of different strings
                if self.text(j) == texts[i]:
                    found[i] = j
                    break
                j += 1
        return found


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict). ``rules``: host, path, verdict."""
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    total = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    length = lambda c: [r[0] for r in rules.select(F.char_length(c)).distinct().collect()]  # noqa: E731  as many as lengths occur
    sizes, lengths = sorted(length("path")), frozenset(length("host"))
    kind = pages.schema[key].dataType.simpleString()
    if total > max_bytes:
        return _sharded(pages, rules, sizes, lengths, key, url, default, total, max_bytes)
    listed = rules.collect()
    verdicts = sorted({r["verdict"] or default for r in listed})
    packed = pages.sparkSession.sparkContext.broadcast(DigestTable.pack([(rule_text(r["host"], r["path"]), verdicts.index(r["verdict"] or default)) for r in listed]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestTable(packed.value)
        for b in batches:
            parts = [split_url(u) for u in b.column(url).to_pylist()]
            tried = [candidates(h, p, sizes, lengths) for h, p in parts]
            flat = [t for c in tried for t in c]
            hits, at, rule, verdict = table.find(flat), 0, [], []
            for c in tried:
                best = max(((len(flat[i]), flat[i], int(hits[i])) for i in range(at, at + len(c)) if hits[i] >= 0), default=None)
                at += len(c)
                rule.append(best and best[1].replace(b"\0", b"").decode())
                verdict.append(verdicts[table.code[best[2]]] if best else default)
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                [key, "host", "path", "rule", "verdict"],
            )

    return pages.select(key, url).mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")


def _sharded(pages: DataFrame, rules: DataFrame, sizes: list[int], lengths: frozenset[int], key: str, url: str, default: str, total: int, max_bytes: int) -> DataFrame:
    """The same with arrays of about ``max_bytes``, as many as the rules or the
    candidates need, whichever are more: rules and candidates of one digest range
    meet in a task. Candidates are distinct, so no shard holds a frequent host
    more than once."""
    kind = pages.schema[key].dataType.simpleString()

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [split_url(u) for u in b.column(url).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([x[i] for x in parts], pa.string()) for i in (0, 1))], [key, "host", "path"])

    @lean
    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tried = [candidates(h, p, sizes, lengths) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            row = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, tried))))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("host", "path")), pa.array([t for c in tried for t in c], pa.binary())], ["host", "path", "tried"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, verdicts = left["tried"].to_pylist(), right["verdict"].to_pylist()
        table = DigestTable(DigestTable.pack(list(zip(right["text"].to_pylist(), range(len(right)), strict=True))))
        found = [(t, verdicts[table.code[i]]) for t, i in zip(texts, table.find(texts).tolist(), strict=True) if i >= 0]
        return pa.table([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], ["tried", "verdict"])

    parts = cut(pages.select(key, url).mapInArrow(split, f"{key} {kind}, host string, path string"), "urls")
    tried = cut(parts.select("host", "path").distinct().mapInArrow(tries, "host string, path string, tried binary"), "tried")
    once = cut(tried.select("tried").distinct(), "once")
    asked = once.agg(F.sum(F.octet_length("tried") + 32)).first()[0] or 0
    shards = max(1, -(-max(total, asked) // max(max_bytes, 256)))  # a rule or candidate at least
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    listed = rules.select(F.concat(F.col("host").cast("binary"), F.lit(b"\0"), F.col("path").cast("binary")).alias("text"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
    hits = once.withColumn("shard", shard("tried")).groupBy("shard").cogroup(listed.withColumn("shard", shard("text")).groupBy("shard")).applyInArrow(probe, "tried binary, verdict string")
    best = tried.join(cut(hits, "hits"), "tried").groupBy("host", "path").agg(F.max(F.struct(F.octet_length("tried").alias("n"), "tried", "verdict")).alias("b"))
    rule = F.replace(F.decode("b.tried", "UTF-8"), F.lit("\0"), F.lit(""))
    return parts.join(cut(best, "rules"), ["host", "path"], "left").select(key, "host", "path", rule.alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
