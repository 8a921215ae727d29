"""convert, batch and info on the command line: python -m leafmill.cli batch IN OUT --to markdown"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from leafmill.operators import render
from leafmill.sources.reader import gathered_files

_TO = {"markdown": render.to_markdown, "json": render.to_json, "text": render.to_plain_text}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("convert", "batch", "info"):
        p = commands.add_parser(name)
        p.add_argument("source")
        if name == "batch":
            p.add_argument("out")
        if name != "info":
            p.add_argument("--to", choices=_TO, default="markdown")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    elements = gathered_files(spark, a.source)
    if a.command == "batch":
        done = _TO[a.to](elements)
        done.write.mode("overwrite").partitionBy("format").parquet(a.out)
        print(render.batch_summary(spark.read.parquet(a.out)).toJSON().first())
        return 0
    row = (_TO[a.to] if a.command == "convert" else render.to_json)(elements).first()
    if row is None or row["error"]:
        print(row["error"] if row else "no such file", file=sys.stderr)
        return 1
    print(row[2])
    return 0


if __name__ == "__main__":
    sys.exit(main())
