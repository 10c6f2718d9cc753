"""Text and number expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency signs that carry no value, and a number's clutter.
CURRENCY = "[$€£¥₹]"
CLUTTER = "[$€£%\\s]"
#: Values whose match form is their lower case: words without currency signs and
#: commas, in ASCII, one space apart.
PLAIN = r"\A[!-#%-+\--~]++(?: [!-#%-+\--~]++)*+\z"


def normalize(c: Column) -> Column:
    """White space, Unicode's included, collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    return F.lower(normalize(c))


def match_form(c: Column) -> Column:
    """Form in which values and page words are compared: folded, without
    currency signs and without commas between digits. Most values have nothing
    of that, which one look at them tells."""
    return F.when(c.rlike(PLAIN), F.lower(c)).otherwise(bare(folded(c)))


def bare(c: Column) -> Column:
    """Without currency signs and without commas between digits."""
    return F.regexp_replace(F.regexp_replace(c, CURRENCY, ""), r"(?<=\d),(?=\d)", "")


def parse_number(c: Column) -> Column:
    """Double of a number as documents write it, else null. A comma groups
    thousands where all groups have three digits or a point follows too; a lone
    comma is a decimal point; a currency code beside the digits is dropped."""
    bare = F.regexp_replace(F.regexp_replace(c, CLUTTER, ""), r"^[A-Za-z]{1,5}(?=[-\d.])|(?<=[\d.])[A-Za-z]{1,5}$", "")
    grouped = bare.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$") | (bare.contains(",") & bare.contains("."))
    plain = F.when(grouped, F.regexp_replace(bare, ",", "")).otherwise(F.regexp_replace(bare, ",", "."))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def loose_number(c: Column) -> Column:
    """Number of a value's digits, points and minus signs alone, else null."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are alike."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def cer(pred: Column, gold: Column) -> Column:
    return F.when(F.char_length(gold) == 0, F.char_length(pred).cast("double")).otherwise(F.levenshtein(pred, gold) / F.char_length(gold))


def wer(pred: Column, gold: Column) -> Column:
    """Word error rate: each distinct word of the pair becomes one private-use
    character, so the built-in edit distance counts words."""
    words = lambda c: F.filter(F.split(normalize(c), " "), lambda w: w != "")
    # both sides are split once, and their distinct words listed once, as variables of outer functions and not for each word
    listed = lambda x: F.struct(x["p"], x["g"], F.array_distinct(F.concat(x["p"], x["g"])).alias("both"))

    def rate(x: Column) -> Column:
        distance, n = F.levenshtein(_coded(x["p"], x["both"]), _coded(x["g"], x["both"])), F.size(x["g"])
        return F.when(n == 0, F.size(x["p"]).cast("double")).otherwise(distance / n)

    pair = F.array(F.struct(words(pred).alias("p"), words(gold).alias("g")))
    return F.get(F.transform(F.transform(pair, listed), rate), F.lit(0))


def _coded(words: Column, known: Column) -> Column:
    """A character for each word's place in ``known``, which may reach a
    million: four bytes of UTF-32 from U+10000 on."""
    digits = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "utf-32")


def anls_term(pred: Column, gold: Column, tau: float = 0.5) -> Column:
    """A pair's share in ANLS: its similarity, 0 below tau."""
    s = similarity(folded(pred), folded(gold))
    return F.when(s >= tau, s).otherwise(F.lit(0.0))


def value_correct(pred: Column, gold: Column, scoring: Column, tolerance: Column, tau: float = 0.5, forms: tuple[Column, Column] | None = None) -> Column:
    """Whether a value counts as right under its field's scoring rule;
    ``forms`` are the folded forms of both, where they are at hand."""
    p, g = forms or (folded(pred), folded(gold))
    near = F.coalesce(F.abs(parse_number(pred) - parse_number(gold)) <= tolerance, F.lit(False))
    ruled = F.when(scoring == "numeric", near).when(scoring == "exact", p == g).otherwise(similarity(p, g) >= tau)
    return F.when(pred.isNull() | gold.isNull(), pred.isNull() & gold.isNull()).otherwise(ruled)


def slug(c: Column, empty: str | None = "field") -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", F.lit(empty)).otherwise(s) if empty else s
