"""Command line: ``spark-submit``-able, or ``python -m lakesift COMMAND``.

    scan ROOT [--config FILE] [--out DIR] [--baseline DIR] [--fail-on LEVEL]    scan a tree; prints the worst findings, exit code 1 if the gate fails
    report SCAN FRAMEWORK [--html]                                              a regulation report of a saved scan
    diff OLD NEW [--json DIR]                                                   what changed between two saved scans
    suggest SCAN [ROOT] [--json DIR]                                            suggested lines for the findings of a saved scan
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from lakesift import pipeline
from lakesift.config import Config, read_config
from lakesift.operators import baseline, reports, suggest
from lakesift.runtime import workspace
from lakesift.sources.files import discover, saved_scan

SHOWN = 100


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakesift", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("root")
    for name in ("--config", "--out", "--baseline", "--fail-on"):
        scan.add_argument(name)
    report = commands.add_parser("report")
    report.add_argument("scan")
    report.add_argument("framework")
    report.add_argument("--html", action="store_true")
    diff = commands.add_parser("diff")
    diff.add_argument("old")
    diff.add_argument("new")
    diff.add_argument("--json")
    fix = commands.add_parser("suggest")
    fix.add_argument("scan")
    fix.add_argument("root", nargs="?")
    fix.add_argument("--json")
    return p


def _print(rows: DataFrame) -> None:
    """The first rows of a table that a person reads."""
    print("\t".join(rows.columns))
    for r in rows.limit(SHOWN).collect():
        print("\t".join("" if v is None else str(v) for v in r))


def _scan(spark: SparkSession, args: argparse.Namespace) -> int:
    config = read_config(args.config) if args.config else Config()
    files, skipped = discover(spark, args.root, config)
    out = args.out
    with workspace(spark) as work:
        out = out or f"{work}/scan"
        found = pipeline.scan(files, config=config).select(*pipeline.COLUMNS)
        about = {"path": args.root, "files_scanned": files.count(), "files_skipped": skipped.first()[0], "frameworks": config.frameworks}
        reports.save_scan(pipeline.shown(found, config.min_display), out, about)
        saved = saved_scan(spark, out)
        if args.baseline:
            changed = baseline.diff(saved_scan(spark, args.baseline), saved)
            _print(reports.diff_rows(baseline.in_order(changed)))
            saved = changed.where("change in ('added', 'modified')").select("finding.*")
        else:
            _print(reports.table_rows(pipeline.in_order(saved)))
        return int(pipeline.fails(saved, args.fail_on or config.fail_on))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lakesift").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "scan":
        return _scan(spark, args)
    if args.command == "report":
        text = reports.html_report if args.html else reports.markdown
        print(text(saved_scan(spark, args.scan), args.framework))
    elif args.command == "diff":
        changed = baseline.diff(saved_scan(spark, args.old), saved_scan(spark, args.new))
        if args.json:
            reports.diff_lines(changed).select("entry").write.mode("overwrite").text(args.json)
        _print(reports.diff_rows(baseline.in_order(changed)))
    else:
        sources = discover(spark, args.root)[0].select("path", "source") if args.root else None
        made = suggest.suggest(saved_scan(spark, args.scan), sources)
        if args.json:
            reports.suggestion_lines(made).select("suggestion").write.mode("overwrite").text(args.json)
        _print(made.select("file", "line", "description", "replacement_line"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
