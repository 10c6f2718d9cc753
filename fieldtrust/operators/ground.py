"""Grounding: where a value stands on its pages, and how surely.

Words are one array for each page, which meets the document's
values in one join; a pair of page and value is judged inside its row. A
verbatim window decides a page; it is searched for in one text of the page's
words, if no word or value repeats in a way that needs their places. Only pages
without one are searched for near matches, among the windows near a word that equals one of the value's, or for
long values by bags of words. A window holds places and text only, never a copy
of its page, so a row grows with the page and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.text import bare, match_form
from fieldtrust.sources import ingest

#: Values of more words are matched by their bags of words.
LONG = 12
#: White space inside of words that are joined by line ends.
INSIDE = r"(?U)[\s&&[^\n]]"
NO_TIE = 1e-9


def penalty(score: Column, n: Column, mode: str = "uniform") -> Column:
    """Support of a value that stands at n places alike."""
    by = {"none": F.lit(1.0), "uniform": n.cast("double"), "sqrt": F.sqrt(n.cast("double")), "log": 1.0 + F.log(n.cast("double"))}
    if mode not in by:
        raise ValueError(f"unknown penalty {mode!r}; known: {sorted(by)}")
    return F.when(n <= 1, score).otherwise(score / by[mode])


def targets(predictions: DataFrame) -> DataFrame:
    """(doc_id, target, tokens, n_tokens, n_chars) of the values to find: a value that
    several paths or runs of a document share is looked for once."""
    each = predictions.where(F.col("value").isNotNull()).select("doc_id", "value").distinct()
    t = each.select("doc_id", match_form(F.col("value")).alias("target")).distinct().where("target <> ''")
    return t.withColumn("tokens", F.split("target", " ")).withColumn("n_tokens", F.size("tokens")).withColumn("n_chars", F.char_length("target"))


def page_words(words: DataFrame) -> DataFrame:
    """(doc_id, page, ws, ts, bs): the words of each page in order, their texts and boxes."""
    rows = words.select("doc_id", "page", F.struct("pos", match_form(F.col("text")).alias("t"), F.struct("x0", "y0", "x1", "y1").alias("b")).alias("w"))
    ws = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return ws.select("doc_id", "page", F.col("ws.t").alias("ts"), F.col("ws.b").alias("bs"))


def text_words(pages: DataFrame) -> DataFrame:
    """The same of pages as texts (doc_id, page, body), with ``at``, the words
    in their form with a line end at each side of each; null where a word has
    white space inside. Words are brought to their form as one text."""
    rows = pages.select("doc_id", "page", "body", F.trim(F.regexp_replace("body", "[ \n]+", "\n"), F.lit("\n")).alias("text"))
    rows = rows.where("text <> ''").withColumn("form", F.when(~F.col("text").rlike(INSIDE), bare(F.lower("text"))))
    ts = F.when(F.col("form").isNotNull(), F.split("form", "\n")).otherwise(F.transform(F.split("text", "\n"), match_form))
    at = F.concat(F.lit("\n"), F.replace("form", F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
    return rows.select("doc_id", "page", ts.alias("ts"), F.transform(ingest.page_words(F.col("body")), lambda w: ingest.word_box(w)).alias("bs"), at.alias("at"))


def _box(start: Column, width: Column) -> Column:
    part = F.slice("bs", start, width)
    edge = lambda f, c: f(F.transform(part, lambda w: w[c])).alias(c)
    return F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))


def _upto(last: Column) -> Column:
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _joined(start: Column, width: Column) -> Column:
    return F.array_join(F.slice("ts", start, width), " ")


def _verbatim() -> Column:
    """array<struct<start, width>>: places where a window equals the target, the
    narrowest of each start. Only words that the target begins with are tried."""
    target, n = F.col("target"), F.size("ts")
    begin = F.filter(_upto(n), lambda i: (F.element_at("ts", i) != "") & target.startswith(F.element_at("ts", i)))
    fitting = lambda i: F.filter(_upto(F.least(F.col("n_tokens") + 1, n - i + 1)), lambda w: _joined(i, w) == target)
    return F.filter(F.transform(begin, lambda i: F.struct(i.alias("start"), F.get(fitting(i), F.lit(0)).alias("width"))), lambda x: x["width"].isNotNull())


def _scored(text: Column, start: Column, width: Column, min_support: float) -> Column:
    """struct<score, start, width> of a window, null where its length tells that it can't reach ``min_support``."""
    n, size = F.char_length(text), F.col("n_chars")
    place = F.struct((1.0 - F.levenshtein(text, F.col("target")) / F.greatest(n, size)).alias("score"), start.alias("start"), width.alias("width"))
    return F.when(F.abs(n - size) <= (1 - min_support) * F.greatest(n, size), place)


def _near_word(min_support: float) -> Column:
    """array<struct<score, start, width>> of the windows that may reach
    ``min_support``, for values of one word: all words and pairs of neighbours."""
    one = F.transform("ts", lambda t, i: _scored(t, i + 1, F.lit(1), min_support))
    # what follows a word begins as the list without its first
    two = F.zip_with(F.slice("ts", F.lit(1), F.size("ts") - 1), F.slice("ts", F.lit(2), F.size("ts")), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.when(F.size("ts") > 1, F.transform(two, lambda t, i: _scored(t, i + 1, F.lit(2), min_support)))
    return F.array_compact(F.concat(one, F.coalesce(pairs, F.array().cast("array<struct<score: double, start: int, width: int>>"))))


def _near(min_support: float) -> Column:
    """The same for values of several words: the windows of the starts near a
    word that equals one of theirs."""
    n = F.size("ts")
    hit = F.filter(_upto(n), lambda i: F.array_contains(F.col("tokens"), F.element_at("ts", i)))
    starts = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.transform(F.sequence(F.lit(0), F.col("n_tokens")), lambda o: F.greatest(F.lit(1), i - o)))))
    wide = lambda i: F.transform(_upto(F.least(F.col("n_tokens") + 1, n - i + 1)), lambda w: _scored(_joined(i, w), i, w, min_support))
    return F.array_compact(F.flatten(F.transform(starts, wide)))


def _bags() -> Column:
    """The same for long values: overlap of bags of words, in windows of the value's length."""
    hit = F.filter(_upto(F.size("ts")), lambda i: F.array_contains(F.col("tokens"), F.element_at("ts", i)))
    offsets = F.array(F.lit(0), F.floor(F.col("n_tokens") / 2).cast("int"), F.col("n_tokens") - 1)
    starts = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.transform(offsets, lambda o: F.greatest(F.lit(1), i - o)))))
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    # a word counts as often as both sides have it: its places on one side that the other has room for
    overlap = lambda window: F.aggregate(F.array_distinct("tokens"), F.lit(0), lambda s, x: s + F.least(count(F.col("tokens"), x), count(window, x)))

    def scored(i: Column) -> Column:
        window = F.slice("ts", i, F.col("n_tokens"))
        return F.struct((2.0 * overlap(window) / (F.size(window) + F.col("n_tokens"))).alias("score"), i.alias("start"), F.size(window).alias("width"))

    return F.transform(starts, scored)


def _marked(rows: DataFrame) -> DataFrame:
    """Pages with ``at``, their words with a line end at each side of each; null
    where a word has white space inside or is null."""
    joined = rows.withColumn("at", F.array_join("ts", "\n\n"))
    plain = ~F.col("at").rlike(INSIDE) & (F.size(F.split("at", "\n\n")) == F.size("ts"))
    return joined.withColumn("at", F.when(plain, F.concat(F.lit("\n"), "at", F.lit("\n"))))


def _sought(rows: DataFrame) -> DataFrame:
    """Values with ``key``, what stands for them in the marked words; null where
    windows could overlap (the first word occurs again) or none can begin."""
    first = F.get("tokens", F.lit(0))
    alone = (first != "") & (F.array_position(F.slice("tokens", F.lit(2), F.col("n_tokens")), first) == 0)
    return rows.withColumn("key", F.when(alone, F.concat(F.lit("\n"), F.replace("target", F.lit(" "), F.lit("\n\n")), F.lit("\n"))))


def _read() -> Column:
    """struct<n, start>: how often the key stands in the marked words, and the
    place of the first; null where either is null."""
    without = lambda c, x: F.octet_length(c) - F.octet_length(F.replace(c, x, F.lit("")))
    n = without(F.col("at"), F.col("key")) / F.octet_length("key")
    start = without(F.call_function("substring_index", F.col("at"), F.col("key"), F.lit(1)), F.lit("\n")) / 2 + 1
    return F.when(F.col("at").isNotNull() & F.col("key").isNotNull(), F.struct(n.cast("int").alias("n"), start.cast("int").alias("start")))


def located(predictions: DataFrame, words: DataFrame, min_support: float = 0.5, use_fuzzy: bool = True) -> DataFrame:
    """(doc_id, target, page, score, n, bbox): the best place of each value, in
    its match form, on each page, and at how many it stands alike, which may be
    none. ``words`` are rows of words or, with column body, texts of pages."""
    pages = text_words(words) if "body" in words.columns else _marked(page_words(words))
    # no filter on what is found: Spark would move it down, and have all steps done twice
    rows = pages.join(_sought(targets(predictions)), "doc_id").withColumn("read", _read())
    nowhere = F.array().cast("array<struct<start: int, width: int>>")
    rows = rows.withColumn("exact", F.when(F.col("read").isNull(), _verbatim()).otherwise(nowhere))
    none = F.array().cast("array<struct<score: double, start: int, width: int>>")
    verbatim = F.transform("exact", lambda x: F.struct(F.lit(1.0).alias("score"), x["start"].alias("start"), x["width"].alias("width")))
    long = F.lit(False)
    if use_fuzzy:
        long = (F.col("n_tokens") > LONG) & (F.size("exact") == 0) & (F.coalesce(F.col("read.n"), F.lit(0)) == 0)
        near = F.when(long, _bags()).when(F.col("n_tokens") == 1, _near_word(min_support)).otherwise(_near(min_support))
    else:
        near = none
    rows = rows.withColumn("places", F.when(F.col("read.n") > 0, none).when(F.size("exact") > 0, verbatim).otherwise(near))
    # the best score, the first place that has it, and how many places do
    rows = rows.withColumn("top", F.array_max(F.transform("places", lambda x: x["score"])))
    rows = rows.withColumn("tied", F.filter("places", lambda x: (x["score"] > 0) & (x["score"] >= F.col("top") - NO_TIE)))
    # one-word values list their pairs after all single words
    least = F.array_min(F.transform("tied", lambda x: F.struct(x["start"].alias("start"), x["width"].alias("width"), x["score"].alias("score"))))
    listed = F.struct(*(F.col("tied")[0][c].alias(c) for c in ("start", "width", "score")))
    rows = rows.withColumn("first", F.when(F.size("tied") > 0, F.when(F.col("n_tokens") == 1, least).otherwise(listed)))
    near = F.struct(F.col("first.score").alias("score"), F.size("tied").alias("n"), F.col("first.start").alias("start"), F.col("first.width").alias("width"))
    read = F.struct(F.lit(1.0).alias("score"), F.col("read.n").alias("n"), F.col("read.start").alias("start"), F.col("n_tokens").alias("width"))
    rows = rows.withColumn("b", F.when(F.coalesce(F.col("read.n"), F.lit(0)) > 0, read).when(F.col("first").isNotNull(), near))
    n = F.when(F.col("b").isNull(), F.lit(0)).when(long, F.lit(1)).otherwise(F.col("b.n")).cast("long")
    return rows.select("doc_id", "target", "page", "b.score", n.alias("n"), F.when(F.col("b").isNotNull(), _box(F.col("b.start"), F.col("b.width"))).alias("bbox"))


def ground(predictions: DataFrame, words: DataFrame, min_support: float = 0.5, mode: str = "uniform", use_fuzzy: bool = True) -> DataFrame:
    """``predictions`` with page, bbox and support of the best place; pages
    later in the document win ties; null where support is under min_support.
    A prediction that has a support already keeps its place."""
    given = [c for c in ("support", "page", "bbox") if c in predictions.columns]
    asked = predictions.where(F.col("support").isNull()) if "support" in given else predictions
    found = located(asked, words, min_support, use_fuzzy)
    s = found.withColumn("support", penalty(F.col("score"), F.col("n"), mode))
    enough = (F.col("n") > 0) & (F.col("support") >= min_support)
    order = F.when(enough, F.struct("support", "page"))
    best = s.groupBy("doc_id", "target").agg(F.max(order).alias("g"), F.max_by("bbox", order).alias("bbox"))
    # a document's places are one row: its predictions meet them by their document alone, and stay where they are;
    # boxes are a column of their own, which Spark drops where they aren't asked for
    listed = lambda c: F.map_from_entries(F.collect_list(F.struct("target", c)))
    places = best.groupBy("doc_id").agg(listed("g").alias("places_"), listed("bbox").alias("boxes_"))
    joined = predictions.join(places, "doc_id", "left").withColumn("target_", match_form(F.col("value")))
    found = {"support": F.col("places_")[F.col("target_")]["support"], "page": F.col("places_")[F.col("target_")]["page"], "bbox": F.col("boxes_")[F.col("target_")]}
    own = [(F.coalesce(F.col(c), x) if c in given else x).alias(c) for c, x in found.items()]
    return joined.select(*(c for c in predictions.columns if c not in given), *own)


def char_span(text: Column, target: Column) -> Column:
    """struct<start, end> of the folded target in the folded text, else null."""
    at = F.instr(F.lower(text), target)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.char_length(target)).alias("end")))


def lexical_entailment(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis's words that the premise has."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}.]+"), lambda w: w != "")
    # both sides are split once, as a variable of the outer function, and not for each word
    shared = lambda x: F.when(F.size(x["h"]) > 0, F.size(F.filter(x["h"], lambda w: F.array_contains(x["q"], w))) / F.size(x["h"])).otherwise(F.lit(0.0))
    return F.get(F.transform(F.array(F.struct(words(hypothesis).alias("h"), words(premise).alias("q"))), shared), F.lit(0))


def hypothesis(path: Column, value: Column) -> Column:
    return F.concat(F.regexp_replace(F.element_at(F.split(path, r"\."), -1), "_", " "), F.lit(" is "), value)


def premise(text: Column, span: Column) -> Column:
    """What a hypothesis is held against: the grounded span of the text, or all of it."""
    return F.when(span.isNull(), text).otherwise(F.substring(text, span["start"] + 1, span["end"] - span["start"]))


def entailment(scorer: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column function around a model's ``scorer(premises, hypotheses)``,
    called with Arrow batches on the executors; null where either is null."""

    @F.pandas_udf("double")
    def score(premises: pd.Series, hypotheses: pd.Series) -> pd.Series:
        ok = premises.notna() & hypotheses.notna()
        out = pd.Series(float("nan"), index=premises.index, dtype="float64").astype(object).where(ok, None)
        if ok.any():
            out[ok] = scorer(premises[ok].tolist(), hypotheses[ok].tolist())
        return out

    return score


def fold_entailment(support: Column, entailed: Column, how: str = "min") -> Column:
    """Support with an entailment score folded in, within [0, 1]."""
    by = {"min": F.least(support, entailed), "product": support * entailed, "mean": (support + entailed) / 2, "replace": entailed}
    if how not in by:
        raise ValueError(f"unknown combination {how!r}; known: {sorted(by)}")
    return F.when(support.isNull() | entailed.isNull(), support).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), by[how])))
