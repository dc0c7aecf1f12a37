"""spark-submit job: report on files, and normalise them.

    spark-submit job.py [-v] [-a] [-n] [-m] [-r] [-f] [-i] [-t THRESHOLD] FILE...

A FILE of - is the standard input. Exit status: 1 for arguments that don't go together, 2 if writing failed, else 0, files without an encoding included.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.detect import Options
from .operators.detection import charset_matches, report_rows, to_json
from .sources.files import read_files, sink


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description="Encodings of files, and files in UTF-8.")
    p.add_argument("files", nargs="+")
    p.add_argument("-v", "--verbose", action="store_true", help="what detection noted")
    p.add_argument("-a", "--with-alternative", action="store_true", help="matches after the best one too")
    p.add_argument("-n", "--normalize", action="store_true", help="write files in UTF-8")
    p.add_argument("-m", "--minimal", action="store_true", help="names of encodings alone")
    p.add_argument("-r", "--replace", action="store_true", help="write over the files; needs --normalize")
    p.add_argument("-f", "--force", action="store_true", help="don't ask; needs --replace")
    p.add_argument("-i", "--no-preemptive", action="store_true", help="don't believe declarations")
    p.add_argument("-t", "--threshold", type=float, default=0.2, help="noise at which an encoding is given up, 0 to 1")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    wrong = ("--replace needs --normalize" if a.replace and not a.normalize else "--force needs --replace" if a.force and not a.replace else "the threshold is from 0 to 1" if not 0 <= a.threshold <= 1 else None)
    if wrong:
        print(wrong, file=sys.stderr)
        return 1
    if a.replace and not a.force and input("Write over the files? [y/N] ").strip().lower() not in ("y", "yes"):
        return 0
    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    options = Options(threshold=a.threshold, preemptive=not a.no_preemptive, explain=a.verbose)
    paths = [x for x in a.files if x != "-"]
    files = read_files(spark, *paths).select("path", "payload") if paths else None
    if "-" in a.files:
        given = spark.createDataFrame([("-", sys.stdin.buffer.read())], "path string, payload binary")
        files = given if files is None else files.unionByName(given)
    write = sink(replace=a.replace) if a.normalize else None
    # what comes from the standard input has no place to be written to
    report = report_rows(files, "path", "payload", options, a.with_alternative, write and (lambda path, match: None if path == "-" else write(path, match)), ranked=True)
    rows = (r.asDict(recursive=True) for r in report.orderBy("path", "rank").drop("rank").toLocalIterator())
    try:
        if a.minimal:
            for _, own in groupby(rows, key=lambda r: r["path"]):
                print(", ".join(r["encoding"] or "undefined" for r in own))
        else:
            for part in to_json(rows):
                print(part, end="")
            print()
    except Exception as error:  # of the store
        print(error, file=sys.stderr)
        return 2
    if a.verbose:
        for r in charset_matches(files, "payload", options).select("path", F.explode("trace").alias("t")).select("path", "t.*").orderBy("path").toLocalIterator():
            print(f"{r.path} | {logging.getLevelName(r.level)} | {r.message}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
