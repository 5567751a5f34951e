"""Command line: python -m quillweave.cli -i seqs.fasta -m blosum62 -a sw -s 10 -e 1 -o out"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillweave.functions.matrices import catalog_text
from quillweave.plans.config import ScoringConfig
from quillweave.plans.run import WRITERS, align


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillweave", description="All-against-all sequence alignment on Spark.")
    a = p.add_argument
    a("-i", "--input", help="sequence file: FASTA or delimited text")
    a("-o", "--output", help="where the results go")
    a("-m", "--matrix", help="substitution matrix")
    a("-a", "--align", help="method: nw, ga or sw")
    a("-p", "--gap-penalty", type=int, help="linear gap")
    a("-s", "--gap-open", type=int)
    a("-e", "--gap-extend", type=int)
    a("-l", "--list-matrices", action="store_true")
    a("-f", "--filter", type=float, help="drop sequences this similar to an earlier one")
    a("-z", "--compression", type=int, default=0, choices=range(10), metavar="0-9")
    a("-B", "--benchmark", action="store_true", help="print seconds per stage")
    a("-T", "--threads", type=int, default=0, help="threads of this machine, 0 for all")
    a("-C", "--no-cuda", action="store_true", help="accepted for old scripts; changes nothing")
    a("-W", "--no-write", action="store_true")
    a("-P", "--no-progress", action="store_true")
    a("-D", "--no-detail", action="store_true")
    a("-F", "--force-proceed", action="store_true", help="replace existing results")
    a("-Q", "--quiet", action="store_true")
    a("-V", "--verbose", action="store_true")
    a("--format", choices=sorted(WRITERS), default="parquet")
    a("--seq-col", help="name of the sequence column")
    a("--no-header", action="store_true", help="the first row is data; give --seq-col as a number from 0")
    a("--matrix-folder", help="folder of matrix files")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.list_matrices:
        print(catalog_text())
        return 0
    for name in ("input", "matrix", "align"):
        if getattr(args, name) is None:
            p.error(f"--{name} is needed")
    if args.no_write == (args.output is not None):
        p.error("give either --output or --no-write")
    if not 0 <= args.threads <= 1024:
        p.error("--threads is a number from 0 to 1024")
    if args.filter is not None and not 0 <= args.filter <= 1:
        p.error("--filter is a share, from 0 to 1")
    try:
        config = ScoringConfig(args.align, args.matrix, args.gap_penalty, args.gap_open, args.gap_extend, matrix_folder=args.matrix_folder)
        config.load()
    except ValueError as e:
        p.error(str(e))
    builder = SparkSession.builder.appName("quillweave").config("spark.ui.showConsoleProgress", str(not args.no_progress).lower())
    if "spark.master" not in dict(SparkSession.builder._options):
        builder = builder.master(f"local[{args.threads or '*'}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    options = {}
    if args.seq_col is not None:
        options["seq_col"] = int(args.seq_col) if args.seq_col.isdigit() else args.seq_col
    if args.no_header:
        options["header"] = False
    try:
        result = align(spark, args.input, config, args.output, args.filter, args.compression, args.force_proceed, not args.no_write, args.format, **options)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not args.quiet and not args.no_detail:
        print("\n".join(result.notes))
    if args.benchmark:
        total = result.seconds["total"]
        for name, s in result.seconds.items():
            print(f"{name}: {s:.3f} s ({100 * s / total if total else 0:.1f} %)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
