"""Documents, golds, predictions and outcomes rendered from the star schema.

The statements are portable SQL with integer arithmetic only, so that the same
text describes the rows to Spark and to the oracle; ``{name}`` is a table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: One row for each (document, signal, path): a confidence with many ties and whether the value is right.
OUTCOMES = """
SELECT t.doc_id, t.signal, t.path, t.ord, t.correct, t.value, t.support, t.split, t.valid,
       CAST(least(200, 40 + t.correct * (90 - 15 * t.sid) + t.noise) AS DOUBLE) / CAST(200 AS DOUBLE) AS conf
FROM (
  SELECT o.o_orderkey AS doc_id, s.sid, s.signal, p.path, o.o_orderkey * 15 + p.pid * 5 + s.sid AS ord,
         CASE WHEN (o.o_orderkey * 48271 + p.pid * 69621) % 1000 < 640 + p.pid * 80 THEN 1 ELSE 0 END AS correct,
         (o.o_orderkey * (7919 + 2 * s.sid) + p.pid * 131 + s.sid * 17) % (60 + 30 * s.sid) AS noise,
         CASE p.pid WHEN 0 THEN o.o_orderstatus WHEN 1 THEN CAST(o.o_orderkey AS VARCHAR(20)) ELSE o.o_orderpriority END AS value,
         CASE WHEN (o.o_orderkey * 31 + p.pid * 7) % 6 = 0 THEN NULL ELSE CAST((o.o_orderkey * 37 + p.pid * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS support,
         CASE WHEN (o.o_orderkey * 2654435761) % 1000 < 500 THEN 'cal' ELSE 'test' END AS split,
         (o.o_orderkey * 40503) % 2 AS valid
  FROM {orders} o
  CROSS JOIN (VALUES (0, 'token_prob'), (1, 'verbalized'), (2, 'grounding'), (3, 'consensus'), (4, 'combined')) AS s(sid, signal)
  CROSS JOIN (VALUES (0, 'status'), (1, 'invoice_id'), (2, 'priority')) AS p(pid, path)
) t
"""

#: Invoice texts, one page each.
INVOICES = """
SELECT o.o_orderkey AS doc_id,
       concat('Invoice ID: INV-', CAST(o.o_orderkey AS VARCHAR(20)), chr(10), 'Customer: ', c.c_name, chr(10), 'Segment: ', c.c_mktsegment, chr(10),
              'Priority: ', o.o_orderpriority, chr(10), 'Subtotal: ', CAST(CAST(o.o_totalprice AS DECIMAL(18, 2)) AS VARCHAR(20)), chr(10),
              'Status: ', o.o_orderstatus, chr(10), 'Total: $', CAST(CAST(o.o_totalprice AS DECIMAL(18, 2)) AS VARCHAR(20))) AS text
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

#: Gold leaves of the invoices.
GOLDS = """
SELECT o.o_orderkey AS doc_id, p.path, p.scoring, p.tol AS numeric_tol,
       CASE p.path WHEN 'invoice_id' THEN concat('INV-', CAST(o.o_orderkey AS VARCHAR(20))) WHEN 'customer' THEN c.c_name WHEN 'segment' THEN c.c_mktsegment
                   WHEN 'priority' THEN o.o_orderpriority WHEN 'total' THEN CAST(CAST(o.o_totalprice AS DECIMAL(18, 2)) AS VARCHAR(20)) ELSE o.o_orderstatus END AS value
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
CROSS JOIN (VALUES ('invoice_id', 'exact', CAST(0 AS DOUBLE)), ('customer', 'semantic', CAST(0 AS DOUBLE)), ('segment', 'exact', CAST(0 AS DOUBLE)),
                   ('priority', 'exact', CAST(0 AS DOUBLE)), ('total', 'numeric', CAST(1 AS DOUBLE) / CAST(100 AS DOUBLE)), ('status', 'exact', CAST(0 AS DOUBLE))) AS p(path, scoring, tol)
"""

#: Five noisy runs over the golds: some leaves are left out, some are wrong, and some documents get a path that no gold has.
PREDICTIONS = f"""
SELECT * FROM (
  SELECT g.doc_id, r.run, g.path,
         CASE WHEN g.h < 50 THEN NULL WHEN g.h < 170 + r.run * 20 THEN concat(substr(g.value, 2), substr(g.value, 1, 1)) ELSE g.value END AS value,
         CAST(50 + (g.h * 7 + r.run * 13) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS verbalized,
         CASE WHEN (g.h + r.run) % 4 = 0 THEN NULL ELSE CAST((g.h * 3 + r.run * 5) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS support,
         (g.h + r.run * 101) % 1000 AS u, g.pos AS ord
  FROM (SELECT t.*, (t.doc_id * 7919 + length(t.path) * 104729) % 1000 AS h,
               CASE t.path WHEN 'invoice_id' THEN 0 WHEN 'customer' THEN 1 WHEN 'segment' THEN 2 WHEN 'priority' THEN 3 WHEN 'total' THEN 4 ELSE 5 END AS pos FROM ({GOLDS}) t) g
  CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS r(run)
) p WHERE (p.u * 17 + p.run * 29) % 100 >= 8
UNION ALL
SELECT o.o_orderkey AS doc_id, r.run, 'spurious_0' AS path, 'ghost' AS value, CAST(90 AS DOUBLE) / CAST(100 AS DOUBLE) AS verbalized, CAST(NULL AS DOUBLE) AS support, CAST(0 AS BIGINT) AS u, 6 AS ord
FROM {{orders}} o CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS r(run) WHERE (o.o_orderkey * 31 + r.run * 7) % 20 = 0
"""
PREDICTIONS = PREDICTIONS.replace("{{", "{").replace("}}", "}")

#: Three annotators' labels.
ANNOTATIONS = """
SELECT a.annotator, l.doc_id AS field_id,
       CASE WHEN (l.doc_id * a.k) % 10 < 2 THEN 1 - l.quality ELSE l.quality END AS label
FROM {labels} l CROSS JOIN (VALUES ('a1', 7), ('a2', 13), ('a3', 29)) AS a(annotator, k) WHERE (l.doc_id * a.k) % 50 <> 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(spark: SparkSession, sf_dir: str, statement: str, **dealt: list[str]) -> DataFrame:
    """The statement's rows. Of a table in ``dealt`` only the columns named are
    read, and its rows are dealt out by the first of them: what the statement
    makes of a row stays where the row is."""
    read = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **read | {t: read[t].select(columns).repartition(columns[0]) for t, columns in dealt.items()})


#: How the statements join orders with their customers.
SOLD = "{orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"
#: Orders of a partition; a row of them becomes some thirty predictions.
DEALT = 25_000


def by_document(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """The statement's rows, dealt out by doc_id before orders become rows of
    fields and runs: what is made of a document's rows needs no shuffle then,
    and only orders are written to disk. Partitions grow with the orders, so that
    what a task sorts stays in its memory."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // DEALT))
    # an order and its customer are one row of the statement
    sold = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).repartition(parts, "o_orderkey")
    tables = {"sold": sold, "orders": orders.repartition(parts, "o_orderkey")}

    def rows(part: str) -> DataFrame:
        joined = re.sub(r"\bc\.c_", "o.c_", part.replace(SOLD, "{sold} o"))
        made = spark.sql(joined, **{t: df for t, df in tables.items() if "{" + t + "}" in joined})
        # under a name without the subquery's, else Spark doesn't see that both sides of a union are dealt alike
        return made.select(F.col("doc_id").alias("key_"), *(c for c in made.columns if c != "doc_id")).toDF("doc_id", *(c for c in made.columns if c != "doc_id"))

    return reduce(DataFrame.unionAll, map(rows, statement.split("UNION ALL")))


def portable(statement: str) -> str:
    """The statement over the oracle's views."""
    for t in TABLES:
        statement = statement.replace("{" + t + "}", t)
    return statement
