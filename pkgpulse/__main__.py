"""Command line: ``python -m pkgpulse update --root ... --feed name=path``
(on a cluster: ``spark-submit --py-files pkgpulse.zip pkgpulse/__main__.py update ...``).

``update`` runs the update job (``plans.update.run_update``) once; a
scheduler calls it daily with the newest snapshot files. ``report`` writes
one page's reports (``plans.pages``) as JSON lines / Parquet / CSV folders,
what a web layer or an API cache serves.
"""

from __future__ import annotations

import argparse
import json
import sys

from pkgpulse.schemas import RAW_FEEDS

FEEDS = [name for name in RAW_FEEDS if name != "registry"]


def parse_args(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pkgpulse")
    sub = parser.add_subparsers(dest="command", required=True)
    up = sub.add_parser("update", help="load snapshot feeds into the curated tables")
    up.add_argument("--root", required=True, help="warehouse folder of the curated tables")
    up.add_argument("--feed", action="append", default=[], metavar="NAME=PATH", help=f"one of {FEEDS}")
    up.add_argument("--registry", action="append", default=[], metavar="PATH", help="registry extract (CSV), in priority order")
    up.add_argument("--partitions", type=int, default=None, help="redistribute feeds after reading")
    up.add_argument("--combine", choices=("sum", "last"), default="sum")
    up.add_argument("--refresh-names", action="store_true")
    up.add_argument("--master", default=None)
    rep = sub.add_parser("report", help="write a page's reports (one folder per report)")
    rep.add_argument("--root", required=True, help="warehouse folder of the curated tables")
    rep.add_argument("--page", required=True, choices=("all", "package", "top", "api"))
    rep.add_argument("--out", required=True, help="output folder")
    rep.add_argument("--package", default=None, help="package name (page 'package')")
    rep.add_argument("--names", default=None, help="CSV with a package_name column (page 'api')")
    rep.add_argument("--timeframe", default="30d")
    rep.add_argument("--client-types", default="1", help="comma list of ids: 1 user, 2 ci, 3 other")
    rep.add_argument("--system-mode", default="Full", choices=("Full", "CPU Arch", "OS"))
    rep.add_argument("--format", default="json", choices=("json", "parquet", "csv"))
    rep.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    if args.command == "report":
        if args.page == "package" and not args.package:
            parser.error("--page package needs --package")
        if args.page == "api" and not args.names:
            parser.error("--page api needs --names")
        args.client_type_ids = tuple(int(x) for x in args.client_types.split(",") if x.strip())
        return args
    feeds = {}
    for item in args.feed:
        name, sep, path = item.partition("=")
        if not sep or name not in FEEDS:
            parser.error(f"--feed expects NAME=PATH with NAME in {FEEDS}, got {item!r}")
        feeds[name] = path
    args.feeds = feeds
    return args


def write_reports(spark, args) -> list[str]:
    """Build the page's reports over the tables and write each one."""
    from pkgpulse.plans import pages

    tables = pages.Tables.load(spark, args.root)
    ct = args.client_type_ids
    if args.page == "all":
        frames = pages.all_packages_page(tables, args.timeframe, ct, args.system_mode)
    elif args.page == "package":
        frames = pages.package_page(tables, args.package, args.timeframe, ct)
    elif args.page == "api":
        names = spark.read.option("header", True).csv(args.names).select("package_name")
        frames = pages.api_downloads(tables, names)
    else:
        frames = pages.top_page(tables, ct, display=False)
    for name, df in frames.items():
        df.write.mode("overwrite").format(args.format).option("header", True).save(f"{args.out}/{args.page}/{name}")
    return sorted(frames)


def main(argv: list[str] | None = None) -> int:
    args = parse_args(sys.argv[1:] if argv is None else argv)
    from pkgpulse.plans.update import run_update
    from pkgpulse.session import build_session

    if args.command == "report":
        spark = build_session(args.master, app_name="pkgpulse-report")
        print(json.dumps({"reports_written": write_reports(spark, args)}))
        return 0

    spark = build_session(args.master, app_name="pkgpulse-update")
    written = run_update(
        spark,
        args.root,
        args.feeds,
        args.registry,
        partitions=args.partitions,
        combine=args.combine,
        refresh_names=args.refresh_names,
    )
    print(json.dumps({"tables_written": sorted(written)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
