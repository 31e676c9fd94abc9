"""Command line: ``python -m sheaf.cli unzip ARCHIVE TARGET`` and ``zip SOURCE ARCHIVE``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from sheaf import api
from sheaf.functions.tuning import PUT_CONCURRENCY
from sheaf.operators.selection import Selection
from sheaf.plans.options import PackOptions, SyncOptions
from sheaf.plans.reports import transcript
from sheaf.sources.stores import is_remote


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sheaf")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    sub = p.add_subparsers(dest="command", required=True)
    u = sub.add_parser("unzip")
    u.add_argument("source")
    u.add_argument("destination")
    u.add_argument("--store", action="store_true", help="compare with what is there, by tags and the catalog")
    u.add_argument("--prefix", default="")
    u.add_argument("--include", action="append", default=[])
    u.add_argument("--exclude", action="append", default=[])
    for flag in ("--delete-extra", "--dry-run", "--ignore-catalog", "--diagnostics", "--fail-fast"):
        u.add_argument(flag, action="store_true")
    u.add_argument("--concurrency", type=int, default=64)
    u.add_argument("--report", nargs="?", const="-")
    z = sub.add_parser("zip")
    z.add_argument("source")
    z.add_argument("destination")
    z.add_argument("--dry-run", action="store_true")
    z.add_argument("--no-catalog", action="store_true")
    z.add_argument("--compression", choices=("stored", "deflate", "zstd"), default="deflate")
    z.add_argument("--report", nargs="?", const="-")
    return p


def options(args: argparse.Namespace) -> SyncOptions:
    chosen = Selection()
    for glob in args.include:
        chosen = chosen.include(glob)
    for glob in args.exclude:
        chosen = chosen.exclude(glob)
    if args.delete_extra and not (args.store or is_remote(args.destination)):
        raise SystemExit("--delete-extra needs --store or a bucket")
    _, where = api.destination(args.destination, SyncOptions(prefix=args.prefix))
    return SyncOptions(
        prefix=args.prefix or where.prefix, profile="object_zip" if is_remote(args.source) else "local_zip", delete_extra=args.delete_extra, use_catalog=not args.ignore_catalog, fail_fast=args.fail_fast,
        selection=chosen, concurrency=args.concurrency, put_concurrency=min(args.concurrency, PUT_CONCURRENCY), collect_operations=bool(args.report),
    )


def _write(report: dict, to: str | None) -> None:
    if to == "-":
        print(json.dumps(report))
    elif to:
        with open(to, "w") as f:
            json.dump(report, f)


def _plain(row) -> dict:
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def _unzip(spark: SparkSession, args: argparse.Namespace) -> tuple[dict, dict]:
    opts = options(args)
    if args.store or is_remote(args.destination):
        root = api.destination(args.destination, SyncOptions())[0]
        report = (api.dry_run if args.dry_run else api.sync)(spark, args.source, root, opts)
    else:
        report = api.extract_local(spark, args.source, args.destination, opts, args.dry_run)
    summary = report.summary.first().asDict()
    document = {"source": args.source, "destination": args.destination, "summary": summary}
    if args.diagnostics and report.attempts is not None:
        document["diagnostics"] = {"puts": _plain(report.put_diagnostics().first()), "gets": [_plain(r) for r in report.source_diagnostics().collect()], "planned": _plain(report.planned.first())}
    if args.report and report.operations is not None:
        document["operations"] = [_plain(r) for r in report.operations.toLocalIterator()]
    return summary, document


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sheaf").getOrCreate()
    if args.command == "zip":
        opts = PackOptions(include_catalog=not args.no_catalog, compression=args.compression)
        summary = api.plan_pack(spark, args.source, opts).first().asDict() if args.dry_run else api.pack(spark, args.source, args.destination, opts)
        document = {"source": args.source, "destination": args.destination, "summary": summary}
    else:
        summary, document = _unzip(spark, args)
    _write(document, args.report)
    failed = summary.get("errors", 0) > 0
    if not args.quiet and args.report != "-":
        text = transcript(summary, args.dry_run)
        if document.get("diagnostics"):
            text += "\n" + json.dumps(document["diagnostics"])
        coloured = args.color == "always" or (args.color == "auto" and sys.stdout.isatty())
        print(f"\033[{31 if failed else 32}m{text}\033[0m" if coloured else text)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
