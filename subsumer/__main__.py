"""Command line: ``spark-submit --py-files subsumer.zip -m subsumer`` or ``python -m subsumer``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import Dialect, DiscoveryConfig, Duplicates, Nulls
from .plans.discover import discover
from .plans.report import write
from .sources import PRESETS, from_folder, from_parquet, read_preset


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="subsumer", description="Discover inclusion dependencies among tables.")
    p.add_argument("folder", help="folder of the tables, in any store that Spark reads")
    p.add_argument("--parquet", nargs="+", metavar="TABLE", help="read <folder>/<TABLE>.parquet instead of delimited files")
    p.add_argument("--preset", choices=sorted(PRESETS), help="dialect and tables of a known corpus")
    p.add_argument("--tables", nargs="+", metavar="TABLE", help="read these delimited files only (names without ending)")
    p.add_argument("--separator", default=",")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--null-string", default="")
    p.add_argument("--single-line", action="store_true", help="no value holds a line break: split large files")
    p.add_argument("--threshold", type=float, default=1.0)
    p.add_argument("--max-nary", type=int)
    p.add_argument("--nulls", choices=[n.value for n in Nulls], default="subset")
    p.add_argument("--duplicates", choices=[d.value for d in Duplicates], default="aware")
    p.add_argument("--name", default="discovery", help="label in the run's figures")
    p.add_argument("--out", help="folder for the reports; without it the dependencies are shown")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName(a.name).getOrCreate()
    if a.parquet:
        tables = from_parquet(spark, a.folder, a.parquet)
    elif a.preset:
        tables = read_preset(spark, a.preset, a.folder, a.tables)
    else:
        tables = from_folder(spark, a.folder, Dialect(separator=a.separator, header=not a.no_header, null_string=a.null_string, multi_line=not a.single_line), a.tables)
    config = DiscoveryConfig(a.threshold, a.max_nary, Nulls(a.nulls), Duplicates(a.duplicates), a.null_string, a.name)
    found = discover(tables, config)
    if a.out:
        write(found, a.out)
    else:
        found.table().orderBy("layer", "dep", "ref").show(10_000, truncate=False)
        found.summary().show()
    found.clean()


if __name__ == "__main__":
    main()
