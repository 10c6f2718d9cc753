"""Command line: ``python -m fieldtrust extract|batch|iaa ...``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators import agreement, extract
from fieldtrust.plans import sinks, verify
from fieldtrust.sources import ingest


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fieldtrust")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("extract", "print the verified fields of texts"), ("batch", "write verified fields and totals of a folder")):
        c = commands.add_parser(name, help=text)
        c.add_argument("path")
        c.add_argument("--schema", required=True, help="JSON Schema file")
        c.add_argument("--threshold", type=float, default=0.8)
        if name == "batch":
            c.add_argument("--out", required=True)
    commands.add_parser("iaa", help="agreement of annotators' label files").add_argument("path")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "iaa":
        labels = ingest.read_annotations(spark, args.path)
        print(sinks.markdown(agreement.cohen(labels).withColumn("band", agreement.interpret(F.col("kappa")))))
        return
    leaves = extract.schema_table(spark, json.loads(Path(args.schema).read_text()))
    decisions = verify.verify(ingest.read_texts(spark, args.path), leaves, threshold=args.threshold)
    if args.command == "extract":
        print(sinks.markdown(sinks.records(decisions).orderBy("doc_id", "path")))
        return
    sinks.write_jsonl(decisions, f"{args.out}/documents")
    sinks.write_csv(decisions, f"{args.out}/fields")
    verify.summary(decisions).write.json(f"{args.out}/summary")


if __name__ == "__main__":
    main()
