"""Secret scans in DataFrame functions: known forms, and high entropy.

Base kinds are leftmost non-overlapping matches of three patterns. The method
adds ``entropy`` spans: candidates are maximal runs of token characters; a
window of ``WINDOW`` characters slides over each. One fold carries how often
each character stands in the window, and how many of each character class; the
Shannon entropy changes with the counts of the character that leaves and the
one that enters. The classes in a window (digits, hexadecimal digits, letters
of one case, mixed) decide which bound holds. Candidates on the allow list
(plain words, numbers, paths, identifiers of a known public form) are
suppressed, placeholder words end a candidate, and spans inside base ones go.

Positions are code points, ends exclusive. Null or empty text has no spans.
Every text is scanned whole; repeated rows, and rows of repeated or null keys,
give equal results; other columns are kept by ``redact``, whatever their names,
and not read otherwise. ``scan`` replaces columns named like its results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import fresh

#: The base patterns, in the order of their kinds, and the least
#: length of what is measured (the value, the match, the match).
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so shorter ones may be left out at once
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits at which a window counts, by the classes of its characters; a window of
#: digits alone never does.
HEX_BITS, LETTER_BITS, MIXED_BITS = 3.0, 4.0, 3.7
#: Forms that are no secrets, and words that end a candidate. The
#: repeated group is possessive: Java's engine then loops, where a group that
#: could give something back recurses for each separator.
ALLOWED = (
    r"^[A-Za-z_=-]+$",
    r"^[0-9_=+/-]+$",
    r"^(?:/|[a-z0-9]++-)?(?:[A-Za-z]++[/_-])++[A-Za-z]*[0-9]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
PLACEHOLDERS = ("example", "placeholder", "changeme", "xxxxxx", "0123456789", "abcdefgh")
#: A candidate's characters, class by class.
DIGITS, LOW_HEX, LOW, HIGH_HEX, HIGH, SYMBOLS = "0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-"
CLASSES = {"digits": DIGITS, "low_hex": LOW_HEX, "low": LOW, "high_hex": HIGH_HEX, "high": HIGH, "symbols": SYMBOLS}
ALPHABET = "".join(CLASSES.values())
#: Elements that a fold appends one by one before it starts another array.
CHUNK = 128


def collected(items: Column, state: Column, step, element: str) -> Column:
    """The elements that a fold makes, as one array. ``step(acc, x)`` gives the
    fields of the next state and the new element. Elements are appended to
    arrays of at most ``CHUNK``, so no long array is copied for each of them."""
    kind = f"array<{element}>"
    none = F.array().cast(kind)
    start = F.struct(state.alias("s"), none.alias("few"), F.array().cast(f"array<{kind}>").alias("done"))

    def next_(acc: Column, x: Column) -> Column:
        new, made = step(acc["s"], x)
        full = F.size(acc["few"]) >= CHUNK
        few = F.array_append(F.when(full, none).otherwise(acc["few"]), made).cast(kind)
        return F.struct(new.alias("s"), few.alias("few"), F.when(full, F.array_append(acc["done"], acc["few"])).otherwise(acc["done"]).cast(f"array<{kind}>").alias("done"))

    return F.aggregate(items, start, next_, lambda acc: F.flatten(F.array_append(acc["done"], acc["few"])))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the pattern's matches in order: the
    lengths of the pieces between the matches and of these add up."""
    element = "struct<start:int,end:int,hit:string>"
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["piece"])
        end = start + F.char_length(x["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    return F.when(text.rlike(pattern), collected(pairs, F.lit(0), step, element)).otherwise(F.array().cast(f"array<{element}>"))


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>>, by start and then kind."""
    def of(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        long = F.filter(located(text, pattern), lambda s: F.char_length(F.regexp_extract(s["hit"], pattern, group)) >= least)
        return F.transform(long, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [of(rank, kind, *spec) for rank, (kind, spec) in enumerate(KINDS.items())]
    return F.array_sort(F.concat(*parts))


def hot_range(hit: Column) -> Column:
    """struct<first, last>: starts of the first and last window of a candidate
    whose entropy reaches the bound of its classes, -1 if none does. One fold
    over pairs of a leaving and an entering character, so time is linear."""
    # entropy = log2(w) - sum(c * log2 c) / w: the sum is what changes by counts
    most = lambda bits: (math.log2(WINDOW) - bits) * WINDOW + 1e-9
    clog = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    codes = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    come = F.filter(codes, lambda c: c > 0)
    pairs = F.zip_with(F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), come), 1, F.size(come)), come, lambda o, i: F.struct(o.alias("out"), i.alias("come")))
    ranges, at = {}, 0
    for name, chars in CLASSES.items():
        ranges[name] = at + 1, at + len(chars)
        at += len(chars)

    def step(acc: Column, x: Column) -> Column:
        out, into = x["out"], x["come"]
        n_out = F.get(acc["counts"], out - 1)
        n_in = F.get(acc["counts"], into - 1)
        moved = F.when(out == into, F.lit(0.0)).otherwise(F.when(out > 0, clog(n_out - 1) - clog(n_out)).otherwise(F.lit(0.0)) + clog(n_in + 1) - clog(n_in))
        counts = F.when(out == into, acc["counts"]).otherwise(F.transform(acc["counts"], lambda n, j: F.when(j == into - 1, n + 1).when(j == out - 1, n - 1).otherwise(n)))
        n = {c: acc[c] + into.between(*r).cast("int") - out.between(*r).cast("int") for c, r in ranges.items()}
        total, place = acc["sum"] + moved, acc["at"] + 1
        return F.struct(place.alias("at"), total.alias("sum"), counts.alias("counts"), *(v.alias(c) for c, v in n.items()), *marks(acc, place, total, n))

    def marks(acc: Column, place: Column, total: Column, n: dict[str, Column]) -> list[Column]:
        plain = n["symbols"] == 0
        lows, highs = n["low_hex"] + n["low"], n["high_hex"] + n["high"]
        digits = n["digits"] == WINDOW
        hexes = plain & (n["low"] + n["high"] == 0) & ((n["low_hex"] == 0) | (n["high_hex"] == 0))
        letters = (lows == WINDOW) | (highs == WINDOW)
        bound = F.when(digits, F.lit(-1.0)).when(hexes, F.lit(most(HEX_BITS))).when(letters, F.lit(most(LETTER_BITS))).otherwise(F.lit(most(MIXED_BITS)))
        hot, start = (place >= WINDOW) & (total <= bound), place - WINDOW
        return [F.when(hot & (acc["first"] < 0), start).otherwise(acc["first"]).alias("first"), F.when(hot, start).otherwise(acc["last"]).alias("last")]

    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), *(F.lit(0).alias(c) for c in CLASSES), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(pairs, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def blanked(text: Column) -> Column:
    """The text with placeholder words blanked, of the same length."""
    out = text
    for word in PLACEHOLDERS:
        out = F.regexp_replace(out, f"(?i){word}", " " * len(word))
    return F.when(text.rlike("(?i)" + "|".join(PLACEHOLDERS)), out).otherwise(text)


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of the method, in the form of ``base_spans``."""
    kind = len(KINDS)
    allowed = lambda hit: F.array_contains(F.array(*(hit.rlike(p) for p in ALLOWED)), F.lit(True))
    candidates = F.filter(located(blanked(text), CANDIDATE), lambda s: ~allowed(s["hit"]))
    ranged = F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), hot_range(s["hit"]).alias("r")))
    hot = F.transform(
        F.filter(ranged, lambda s: s["r"]["first"] >= 0),
        lambda s: F.struct((s["start"] + s["r"]["first"]).alias("start"), F.lit(kind).alias("rank"), (s["start"] + s["r"]["last"] + WINDOW).alias("end"), F.lit("entropy").alias("kind")),
    )
    inside = lambda s: F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    return F.filter(hot, lambda s: ~inside(s))


def scan(documents: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``documents`` with the two span columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    based = documents.withColumn(base, base_spans(body))
    return based.withColumn(spans, F.array_sort(F.concat(base, entropy_spans(body, F.col(base)))))


def listed(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_digest(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(documents.select(key, text), text).select(key, *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(documents: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span, overlapping ones as one, replaced by ``mark``."""
    columns = documents.columns
    base, spans = fresh(documents, "base"), fresh(documents, "spans")
    body = F.col(text)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        # the first code point that isn't dealt with, and the piece kept before this span, null inside the last one
        kept = F.when((s["start"] >= at), F.struct(at.alias("at"), (s["start"] - at).alias("n")))
        return F.greatest(at, s["end"]), kept

    kept = F.filter(collected(F.col(spans), F.lit(0), step, "struct<at:int,n:int>"), lambda x: x.isNotNull())
    pieces = F.transform(kept, lambda x: F.concat(body.substr(x["at"] + 1, x["n"]), F.lit(mark)))
    rest = body.substr(F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.char_length(body))
    clean = F.concat(F.array_join(pieces, ""), rest)
    return scan(documents, text, base, spans).withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body)).select(columns)
