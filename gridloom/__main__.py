"""Command line: ``python -m gridloom --df table.parquet --target y --outdir out``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from gridloom import options
from gridloom.plans.analysis import analyse
from gridloom.sources.readers import read_spreadsheet


def main(args: list[str]) -> None:
    o = options.parse(args)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if o.spreadsheet:
        o = options.parse(args, read_spreadsheet(spark, o.spreadsheet, o.separator)[1])
    report = analyse(spark, o)
    print(report.to_markdown() if o.verbosity else report.folder or "")


if __name__ == "__main__":
    main(sys.argv[1:])
