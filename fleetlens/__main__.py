"""Command line: ``python -m fleetlens <report> ...`` writes each report as parquet.

  access-report   LOG_DIR SITE OUT [--recent N] [--master URL]
  watchdog-report LOG_PATH TODAY OUT [--master URL]
"""

from __future__ import annotations

import argparse

from .plans import reports
from .session import get_session


def main(argv: list[str] | None = None) -> int:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    ap = argparse.ArgumentParser(prog="fleetlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("access-report", parents=[common], help="access and PHP error log reports of one site")
    a.add_argument("log_dir")
    a.add_argument("site")
    a.add_argument("out")
    a.add_argument("--recent", type=int, default=None, help="preview: only the last N lines of every file")
    w = sub.add_parser("watchdog-report", parents=[common], help="application log reports")
    w.add_argument("path")
    w.add_argument("today", help="yyyy-MM-dd")
    w.add_argument("out")
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    if args.cmd == "access-report":
        rep = reports.access_log_report(spark, args.log_dir, args.site, recent_lines=args.recent)
    else:
        rep = reports.watchdog_report(spark, args.path, args.today)
    for name, path in reports.write_reports(rep, args.out).items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
