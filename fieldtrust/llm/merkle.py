"""Merkle manifest of a dataset: every row is a leaf, rows of one source make a
tree of a fixed fanout, and the sources' roots make the tree above them.

A level is a DataFrame. Nodes are numbered by range partitions (``row_number``
in each, plus the rows of the partitions before it, so that a source with a
third of all rows isn't one task), floor-divided by the fanout, and the at most
``fanout`` children of a parent are gathered in order and hashed. Going down
again, each level joins its parents' children and the path that these have, so
that siblings are appended once for each run and not for each leaf; texts are
read once, to make the leaves, and never shuffled.

Edge cases: null fields are ``-``; a null source is a source of its own, before
all others; null keys come first, rows with equal keys are ordered by their
leaf, and equal rows are leaves side by side; an empty table has no rows and no
root; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import cut, drop

#: Children of a node.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
_HEX = 64


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` where null, else the number
    of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``idx``, the place from 0 of each row in its ``grp`` by the columns of
    ``order``, and ``n``, the rows of the group. Equal rows are told apart by
    where they were read, so that they too are dealt to several partitions."""
    by = ["grp", *order, "tie"]
    parts = cut(
        rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "merkle_parts"
    )
    counts = parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.selectExpr(
        "grp", "part", "sum(rows) over (partition by grp order by part) - rows as before", "sum(rows) over (partition by grp) as n"
    )
    local = parts.selectExpr("*", f"row_number() over (partition by grp, part order by {', '.join([*order, 'tie'])}) - 1 as at")
    out = cut(local.join(before, ["grp", "part"]).withColumn("idx", F.col("before") + F.col("at")).drop("part", "tie", "before", "at"), "merkle_nodes")
    drop(parts)
    return out


def climb(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above ``nodes`` (grp, idx, n, digest): runs of up to
    ``fanout`` nodes with the text of their digests (``children``) and its
    digest; ``n`` is the number of nodes that the group has on this level. A
    group takes part until it has one node."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, at = [], nodes
    while largest > 1:
        kids = at.where("n > 1").selectExpr("grp", f"idx div {fanout} as idx", f"(n + {fanout - 1}) div {fanout} as n", f"struct(idx % {fanout} as at, digest) as kid")
        runs = kids.groupBy("grp", "idx", "n").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        text = F.array_join(F.col("kids.digest"), "")
        at = cut(runs.select("grp", "idx", "n", text.alias("children"), F.sha2(text, 256).alias("digest")), "merkle_level")
        levels.append(at)
        largest = -(-largest // fanout)
    return levels


_PATH = "array<struct<left:string,right:string>>"


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` with ``path``: for each level the digests left and right of
    the node in its run, from its own run up to the path of its group's top in
    ``tops`` (grp, path and what else it has, which is handed down too)."""
    handed = [c for c in tops.columns if c not in ("grp", "path")]
    above = None
    for level in reversed([nodes, *levels]):
        out = level.where("n = 1").join(tops, "grp")
        if above is not None:
            at = f"cast(idx % {fanout} as int) * {_HEX}"
            beside = F.expr(f"struct(substring(kids, 1, {at}) as left, substring(kids, {at} + {_HEX + 1}) as right)")
            runs = above.select("grp", F.col("idx").alias("up"), F.col("children").alias("kids"), "path", *handed)
            under = level.where("n > 1").withColumn("up", F.expr(f"idx div {fanout}")).join(runs, ["grp", "up"])
            out = out.unionByName(under.withColumn("path", F.concat(F.array(beside), "path").cast(_PATH)).drop("up", "kids"))
        above = out
    return above


def proof(path: Column) -> Column:
    """Digest of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda got, p: F.sha2(F.concat(p["left"], got, p["right"]), 256))


def build(
    rows: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, fanout: int = FANOUT, claims: dict[str, Column] | None = None
) -> DataFrame:
    """The manifest: a row for each row, with its key, ``source``, ``position``
    in it, ``leaf``, ``subroot``, ``root`` and ``path``; and with what
    ``claims`` computes from the row, such as a leaf to be verified."""
    claims = claims or {}
    made = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("grp"),
        F.col(key).alias("key"),
        digest(*(F.col(f) for f in fields)).alias("digest"),
        *(c.alias(f"claim_{name}") for name, c in claims.items()),
    )
    leaves = numbered(made, ["key", "digest"])
    levels = climb(leaves, fanout)
    # the groups' tops are the leaves of the tree above them
    single = [x.where("n = 1").select("grp", "digest") for x in (leaves, *levels)]
    subroots = single[0]
    for more in single[1:]:
        subroots = subroots.unionByName(more)
    tops = numbered(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    upper = climb(tops, fanout)
    last = (upper[-1] if upper else tops).where("n = 1").select("grp", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    found = descend(tops, upper, last, fanout)
    named = cut(found.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"), "merkle_tops")
    out = descend(leaves, levels, named, fanout)
    return out.select(
        F.col("key").alias(key),
        F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(source),
        F.col("idx").alias("position"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        *(F.col(f"claim_{name}").alias(name) for name in claims),
    )


def lowered(text: str) -> Column:
    """A text with A-Z in lower case."""
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verify_digest(documents: DataFrame) -> DataFrame:
    """Per document its leaf, roots and the digest of its proof, and whether
    the proof still leads to the root after every fifth document (by the
    CRC-32 of its id) was tampered with."""
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, digest(*(lowered(f) if f == "text" else F.col(f) for f in FIELDS))
    )
    out = build(documents.select(*FIELDS), claims={"now": tampered})
    folded = fold(F.coalesce("now", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
