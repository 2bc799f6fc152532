"""Command line: ``python -m sundew version``, ``config PATH``, ``scan FOLDER... --output FOLDER [--format csv ...]
[--config FILE] [--rules FILE]`` and ``report RESULT --output FOLDER [--format html ...]``."""

from __future__ import annotations

import argparse
import json
import platform

from sundew import __version__
from sundew.sources import config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sundew")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    run = commands.add_parser("scan", help="scan a folder and write reports")
    run.add_argument("folder", nargs="+")
    run.add_argument("--output", required=True)
    run.add_argument("--format", nargs="+", choices=config.FORMATS, help="by default the settings' one")
    run.add_argument("--config", help="settings, in YAML")
    run.add_argument("--rules", help="rules of the rule detector, in TOML")
    again = commands.add_parser("report", help="write reports from a scan's saved result")
    again.add_argument("result")
    again.add_argument("--output", required=True)
    again.add_argument("--format", nargs="+", default=["html"], choices=config.FORMATS[1:])
    again.add_argument("--config")
    example = commands.add_parser("config", help="write the default settings")
    example.add_argument("path")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(f"sundew {__version__} (Python {platform.python_version()})")
        return 0
    if args.command == "config":
        config.save(config.DEFAULTS, args.path)
        return 0
    from pyspark.sql import SparkSession

    from sundew.plans import scan

    settings = config.load(args.config)
    spark = SparkSession.builder.appName("sundew").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "report":
        print(json.dumps(scan.report(spark, args.result, args.output, tuple(args.format), settings), indent=2, sort_keys=True))
        return 0
    if args.rules:
        settings["detectors"]["rule_file"] = args.rules
    failed = 0
    for i, folder in enumerate(args.folder):
        out = args.output if len(args.folder) == 1 else f"{args.output}/{i}"
        head = scan.scan(spark, folder, out, formats=tuple(args.format or [settings["report"]["format"]]), settings=settings)
        print(json.dumps(head, indent=2, sort_keys=True))
        failed += "error" in head
    return 1 if failed == len(args.folder) else 0


if __name__ == "__main__":
    raise SystemExit(main())
