"""Texts to pages, lines and words with normalised boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions.boxes import box

#: Suffixes a directory scan takes.
TEXT_GLOB = "*.{txt,text,md}"


def lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, line, content): pages are cut at form feeds."""
    return _pages(documents, text).select("doc_id", "page", F.posexplode(F.split("body", "\n")).alias("line", "content"))


def _pages(documents: DataFrame, text: str) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split(text, "\f")).alias("page", "body"))


def sums(sizes: Column) -> Column:
    """Running sums of an array by doubling: each round adds the sum that ends
    as far before as sums reach, so rounds grow with the length's logarithm."""
    steps = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), F.lit(1), F.ceil(F.log2(F.size(sizes))).cast("int"))
    return F.aggregate(steps, sizes, lambda a, step: F.transform(a, lambda x, i: x + F.when(i >= step, F.get(a, i - step)).otherwise(0)))


def page_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, body), where the documents are."""
    return _pages(documents, text)


def page_words(body: Column) -> Column:
    """A page's words in order, array<struct<line, text, col>>: they are counted
    inside the page's row, without a sort or a window."""

    def placed(tokens: Column, line: Column) -> Column:
        # a token's column: the characters and spaces before it on its line
        ends = sums(F.transform(tokens, lambda t: F.char_length(t) + 1))
        found = F.zip_with(tokens, ends, lambda t, end: F.struct(line.alias("line"), t.alias("text"), (end - F.char_length(t) - 1).alias("col")))
        return F.filter(found, lambda w: w["text"] != "")

    # a line's tokens are the variable of an outer function: lines are split once
    return F.flatten(F.transform(F.transform(F.split(body, "\n"), lambda content: F.split(content, " ")), placed))


def word_box(w: Column, line_height: float = 0.04) -> Column:
    """The box of a word of ``word_lists``."""
    cap = lambda limit, c: F.least(F.lit(limit), c)
    y0, x0 = cap(0.98, w["line"] * F.lit(line_height)), cap(0.98, 0.02 + 0.012 * w["col"])
    return box(x0, y0, cap(0.99, x0 + 0.012 * F.greatest(F.lit(1), F.char_length(w["text"]))), cap(0.99, y0 + 0.9 * line_height))


def word_lists(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, words): the words of ``words``, a page's in one row."""
    return _dealt_pages(documents, text).select("doc_id", "page", page_words(F.col("body")).alias("words"))


def words(documents: DataFrame, text: str = "text", line_height: float = 0.04) -> DataFrame:
    """(doc_id, page, line, pos, text, x0, y0, x1, y1): tokens between single
    spaces; empty ones advance the column and are dropped."""
    rows = _dealt_pages(documents, text).select("doc_id", "page", F.posexplode(page_words(F.col("body"))).alias("pos", "w"))
    return rows.select("doc_id", "page", "w.line", "pos", "w.text", word_box(F.col("w"), line_height).alias("b")).select("doc_id", "page", "line", "pos", "text", "b.*")


def _dealt_pages(documents: DataFrame, text: str) -> DataFrame:
    # texts are dealt out before they are cut: all that follows for a document needs no shuffle of words
    return _pages(documents.select("doc_id", text).repartition("doc_id"), text)


def read_texts(spark: SparkSession, path: str, glob: str = TEXT_GLOB) -> DataFrame:
    """(doc_id, source_path, text) of text files below a folder; the id is the
    file's stem. Files of other kinds are left out; an empty folder is an error."""
    read = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    out = read.select(name.alias("doc_id"), F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    if out.isEmpty():
        raise ValueError(f"no text files in {path}")
    return out


def read_binaries(spark: SparkSession, path: str, glob: str = "*.{pdf,png,jpg,jpeg}") -> DataFrame:
    """(doc_id, source_path, content): bytes for a parser given by the caller."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return read.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("doc_id"), F.col("path").alias("source_path"), "content")


#: Bytes at the start of an image in which its size must stand.
HEADER = 1 << 20
#: Signatures, and the markers of JPEG frames (all start-of-frame ones).
PNG_START, JPEG_START = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
JPEG_FRAMES = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})


def size_of(head: bytes | None) -> tuple[int, int] | None:
    """Width and height that the first bytes of a PNG or JPEG file state."""
    if head is None:
        return None
    if head.startswith(PNG_START):
        width, height = int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
        return (width, height) if head[12:16] == b"IHDR" and len(head) >= 24 and width and height else None
    at = 2 if head.startswith(JPEG_START) else len(head)
    while at + 9 <= len(head) and head[at] == 0xFF:
        marker = head[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a length
            at += 2
            continue
        if marker in JPEG_FRAMES:
            height, width = int.from_bytes(head[at + 5 : at + 7], "big"), int.from_bytes(head[at + 7 : at + 9], "big")
            return (width, height) if width and height else None
        if marker in (0xD9, 0xDA):  # image data starts or ends: no frame before
            return None
        at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


def image_size(content: Column) -> Column:
    """struct<width, height> of an image's bytes, null for broken ones and
    other formats. Only the first ``HEADER`` bytes go to Python."""

    @F.pandas_udf("width double, height double")
    def run(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([size_of(h) or (None, None) for h in heads], columns=["width", "height"], dtype="float64")

    size = run(F.substring(content, 1, HEADER))
    return F.when(size["width"].isNotNull(), size)


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(doc_id, source_path, page, width, height) of image files below a folder:
    one page each, with null sizes where the file states none. Files of no
    bytes are not listed."""
    read = read_binaries(spark, path, glob).withColumn("size", image_size(F.col("content")))
    return read.select("doc_id", "source_path", F.lit(0).alias("page"), "size.width", "size.height")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(annotator, field_id, label) of label files; without a name in the file,
    the annotator is the file's stem."""
    read = spark.read.schema("annotator string, labels map<string,int>").option("multiLine", True).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return read.select(F.coalesce("annotator", stem).alias("annotator"), F.explode("labels").alias("field_id", "label"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries, unreadable ones left out."""
    schema = """dataset string, extractor string, extraction struct<f1: double, exact_match: double, hallucination_rate: double>,
      grounding struct<grounding_gap: double>, best_coverage struct<auroc: double>, best_ece struct<ece: double>"""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("dataset IS NOT NULL")
