"""python -m lakeweave ingest|integrate|benchmark|audit --lake FOLDER --data FOLDER [--dataset KEY|all] [--force]"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time


def session():
    """A session in UTC throughout; call before any other starts."""
    os.environ["TZ"] = "UTC"
    time.tzset()
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lakeweave").config("spark.sql.session.timeZone", "UTC").config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC").getOrCreate()


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="lakeweave")
    parser.add_argument("command", choices=["ingest", "integrate", "benchmark", "audit"])
    parser.add_argument("--lake", required=True, help="the lake's root folder")
    parser.add_argument("--data", default="datasets", help="the folder of the source files")
    parser.add_argument("--contracts", help="a JSON or YAML file of contracts, instead of the city's")
    parser.add_argument("--dataset", default="all", help="a dataset key, or all")
    parser.add_argument("--force", action="store_true", help="take a source in again that was taken in before")
    parser.add_argument("--on-zone-miss", default="fail", choices=["fail", "keep", "quarantine"])
    parser.add_argument("--report", help="the folder for the benchmark's report")
    args = parser.parse_args(argv)

    from lakeweave import contracts
    from lakeweave.plans import city, ingest, layouts
    from lakeweave.sources.snapshots import Lake

    registry = contracts.load(args.contracts) if args.contracts else city.registry(args.data)
    chosen = registry.select(args.dataset)
    own = spark is None
    spark = spark or session()
    try:
        lake = Lake(spark, args.lake)
        if args.command == "ingest":
            out = [ingest.ingest(spark, lake, c, force=args.force) for c in chosen]
        elif args.command == "audit":
            out = {c.key: ingest.audit(lake, c) for c in chosen}
        elif args.command == "integrate":
            out = city.integrate(spark, lake, args.on_zone_miss)
        else:
            out = city.benchmark(spark, lake)
            if args.report:
                layouts.write_report(lake.store, out, args.report)
            out["queries"] = {x: {n: {k: v for k, v in q.items() if k != "plan"} for n, q in qs.items()} for x, qs in out["queries"].items()}
        print(json.dumps(out, default=str, indent=2, sort_keys=True))
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
