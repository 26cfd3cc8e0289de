"""Production flow: date-sharded nested visits → flat events saved by session
(hot sessions in a table of their own) → analyses written as Parquet.

    spark-submit scripts/run_journeys.py --visits PATH --table NAME --out DIR \
        [--from 20170101 --to 20170108] [--buckets 4096] [--flat-path PATH] [--update-sizes] [KEY ...]

``--update-sizes`` counts the sessions of new or changed shards into the manifest
beside them, so that no later run counts. KEY defaults to every analysis of the
catalog. ``spark.checkpoint.dir`` must name a shared folder.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from journeykit.plans.catalog import QUERY_BUILDERS, JourneyData  # noqa: E402
from journeykit.sources.manifest import update_manifest  # noqa: E402
from journeykit.sources.tables import write_split_by_session  # noqa: E402
from journeykit.sources.visits import read_visits  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("keys", nargs="*")
    parser.add_argument("--visits", required=True, help="folder of nested visits partitioned by date")
    parser.add_argument("--table", required=True, help="name of the flat event table to (re)write")
    parser.add_argument("--out", required=True, help="folder for the analysis results")
    parser.add_argument("--from", dest="date_from")
    parser.add_argument("--to", dest="date_to")
    parser.add_argument("--buckets", type=int, default=64)
    parser.add_argument("--flat-path", default=None, help="location of the flat table's files")
    parser.add_argument("--update-sizes", action="store_true", help="count new shards into the manifest first")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("journeykit").getOrCreate()
    if args.update_sizes:
        update_manifest(spark, args.visits, read_visits(spark, args.visits))
    visits = JourneyData.from_visits(spark, args.visits, args.date_from, args.date_to)
    write_split_by_session(visits.flat, args.table, visits.plan, buckets=args.buckets, path=args.flat_path)
    data = JourneyData.from_split(spark, args.table)
    for key in args.keys or list(QUERY_BUILDERS):
        QUERY_BUILDERS[key](data).write.mode("overwrite").parquet(os.path.join(args.out, key))


if __name__ == "__main__":
    main()
