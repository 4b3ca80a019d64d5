"""Command line: python -m pagewright {run,report,config,version}.

    python -m pagewright run --pages pages.parquet [--out folder]      audit a table of pages (url, html), print the summary
    python -m pagewright config FILE {list,add,remove} [ID NAME DOMAIN]  projects in a settings file
"""

from __future__ import annotations

import argparse
import json
import os

VERSION = "0.2"


def run(args) -> int:
    from pyspark.sql import functions as F

    from .audit import run_audit, summary
    from .functions.url import netloc
    from .operators import report
    from .operators.parse import parse_pages
    from .session import session

    spark = session("audit", None if args.master == "cluster" else args.master)
    raw = spark.read.parquet(args.pages)
    if "ord" not in raw.columns:
        raw = raw.withColumn("ord", F.monotonically_increasing_id())
    frames = run_audit({"pages": parse_pages(raw.select("url", "html", "ord")).withColumn("site", netloc(F.col("url"))).drop("html")})
    found = summary(frames)
    print(json.dumps(found, ensure_ascii=False, default=str))
    if args.out:
        t = frames.tables
        parts = report.sections(t["scores"], t["severities"], t["categories"], t["actions"].select("priority", "severity", "type", "site", "affected_url", "effort_hours", "roi"))
        print(report.write(spark, report.page("Audit", parts), args.out, "audit"))
    return 0


def config(args) -> int:
    """Settings are kept as JSON; {project id: settings}."""
    have = {}
    if os.path.exists(args.file):
        with open(args.file, encoding="utf-8") as f:
            have = json.load(f).get("projects", {})
    if args.action == "list":
        for k, v in have.items():
            print(f"{k}\t{v.get('name', k)}\t{v.get('domain', '')}\t{'enabled' if v.get('enabled', True) else 'disabled'}")
        return 0
    if not args.id:
        raise SystemExit("an id is needed")
    if args.action == "add":
        have[args.id] = {"name": args.name or args.id, "domain": args.domain or "", "tenant_id": "default", "enabled": True}
    elif have.pop(args.id, None) is None:
        raise SystemExit(f"there is no project {args.id}")
    with open(args.file, "w", encoding="utf-8") as f:
        json.dump({"projects": have}, f, indent=2, ensure_ascii=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagewright")
    of = p.add_subparsers(dest="command", required=True)
    r = of.add_parser("run")
    r.add_argument("--pages", required=True)
    r.add_argument("--out")
    r.add_argument("--master", default="local[*]", help="a Spark master, or cluster where spark-submit names one")
    r.set_defaults(do=run)
    c = of.add_parser("config")
    c.add_argument("file")
    c.add_argument("action", choices=["list", "add", "remove"])
    for n in ("id", "name", "domain"):
        c.add_argument(n, nargs="?")
    c.set_defaults(do=config)
    v = of.add_parser("version")
    v.set_defaults(do=lambda _: print(VERSION) or 0)
    args = p.parse_args(argv)
    return args.do(args)


if __name__ == "__main__":
    raise SystemExit(main())
