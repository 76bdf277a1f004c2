"""Run the jobs: ``python -m tallyframe --mode all --root ... --history ... --billing ...``."""

from __future__ import annotations

import argparse
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tallyframe.params import DEFAULT_RATE, Params
from tallyframe.plans.jobs import run_ingest_files, run_recompute, run_sync
from tallyframe.schemas import BILLING_USAGE, QUERY_HISTORY
from tallyframe.sources.state import create_state
from tallyframe.sources.views import query_history


def _history(spark: SparkSession, args: argparse.Namespace, params: Params) -> DataFrame:
    return query_history(spark.read.schema(QUERY_HISTORY).parquet(args.history), params)


def _ingest(spark: SparkSession, args: argparse.Namespace, params: Params, now: datetime) -> None:
    run_ingest_files(spark, args.root, args.history, params, now)


def _recompute(spark: SparkSession, args: argparse.Namespace, params: Params, now: datetime) -> None:
    billing = spark.read.schema(BILLING_USAGE).parquet(args.billing)
    run_recompute(spark, args.root, _history(spark, args, params), billing, params, only_changed=True, now=now)


def _sync(spark: SparkSession, args: argparse.Namespace, params: Params, now: datetime) -> None:
    run_sync(spark, args.root, args.rules, args.out, now)


# What each job needs, and the job; in the order in which "all" runs them.
JOBS = {
    "ingest": (("history",), _ingest),
    "recompute": (("history", "billing"), _recompute),
    "sync": (("rules", "out"), _sync),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyframe")
    parser.add_argument("--mode", choices=[*JOBS, "all"], default="all")
    parser.add_argument("--root", required=True, help="folder of the state tables")
    parser.add_argument("--history", help="query history, Parquet")
    parser.add_argument("--billing", help="billing usage, Parquet")
    parser.add_argument("--rules", help="rule documents, JSON")
    parser.add_argument("--out", help="folder for the effectiveness documents of this run")
    parser.add_argument("--as-of", type=date.fromisoformat, default=None)
    parser.add_argument("--lookback", type=int, default=30)
    parser.add_argument("--rate", type=float, default=DEFAULT_RATE)
    args = parser.parse_args(argv)
    chosen = JOBS if args.mode == "all" else {args.mode: JOBS[args.mode]}
    absent = sorted({name for needed, _ in chosen.values() for name in needed if getattr(args, name) is None})
    if absent:
        parser.error(f"--mode {args.mode} needs {', '.join('--' + n for n in absent)}")
    now = datetime.now(timezone.utc)
    try:
        params = Params(args.as_of or now.date(), lookback=args.lookback, rate=args.rate)
    except ValueError as exc:
        parser.error(str(exc))

    spark = SparkSession.builder.appName("tallyframe").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The default timestamp format has no statistics, so a filter on start_time could skip nothing.
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    create_state(spark, args.root)
    for _, job in chosen.values():
        job(spark, args, params, now)


if __name__ == "__main__":
    main()
