"""Command line: list queries, run one, plan tiles, estimate a survey."""

from __future__ import annotations

import argparse
import sys

from sitewright import queries
from sitewright.functions import categories as K
from sitewright.plans.package import Request, plan_tiles
from sitewright.session import delete_cuts, local


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="sitewright", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    sub.add_parser("categories", help="names of all categories")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="folder for the result as Parquet; without it the first rows are shown")
    tiles = sub.add_parser("tiles", help="tiles of a box west,south,east,north")
    tiles.add_argument("box")
    tiles.add_argument("--size", type=float, default=2_000.0)
    args = parser.parse_args(argv)
    queries.load()
    if args.command == "queries":
        print("\n".join(sorted(queries.QUERIES)))
    elif args.command == "categories":
        print("\n".join(K.CATEGORIES))
    elif args.command == "tiles":
        plan_tiles(local(), Request.parse(args.box, sources=("any",), tile_size=args.size)).show(50, truncate=False)
    else:
        if args.name not in queries.QUERIES:
            parser.error(f"no query {args.name!r}")
        spark = local()
        try:
            df = queries.QUERIES[args.name](spark, args.tables)
            df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, truncate=False)
        finally:
            delete_cuts(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
