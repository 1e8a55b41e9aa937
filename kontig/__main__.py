"""``python -m kontig VERB -conf FILE -o FOLDER``: the program on a Spark session."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kontig.params import INDEL_SIZE, MIN_QUERY_LEN
from kontig.plans.program import VERBS, Options
from kontig.sources.text_formats import parse_config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kontig", description="Assess assembled sequences against a reference and a library of read pairs.")
    out.add_argument("verb", choices=sorted(VERBS))
    out.add_argument("-conf", required=True, help="sections QUERY, REF and READS, each closed by END")
    out.add_argument("-o", "-out", dest="out", required=True, help="folder of the results")
    out.add_argument("-report", help="pairwise text report of the queries on the reference")
    out.add_argument("-m", dest="min_len", type=int, default=MIN_QUERY_LEN, help="least length of a query")
    out.add_argument("-i", dest="indel", type=int, default=INDEL_SIZE, help="least size of an indel")
    out.add_argument("-sc", dest="single_cell", action="store_true", help="coverage is judged by deviations, as for single cells")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"kontig-{args.verb}").getOrCreate()
    lines = [r.value for r in spark.read.text(args.conf).collect()]  # a few lines
    VERBS[args.verb](spark, parse_config(lines), Options(args.out, args.report, args.min_len, args.indel, args.single_cell))


if __name__ == "__main__":
    main()
