"""Command line: one subcommand per job.

python -m sluicebox preprocess 20180601 s3a://bucket/raw/ s3a://bucket/events/
python -m sluicebox warehouse-to-lake 20180601 dataset table s3a://bucket/target/
python -m sluicebox lake-to-warehouse 20180601 s3a://bucket/source/ dataset table
python -m sluicebox country-chain 20180601 s3a://bucket/user_info_test/ events.user_info test.result test.copy
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql.types import StructType

from sluicebox.functions.predicates import DENIED_TYPES
from sluicebox.operators.flatten import DROPPED_FIELDS
from sluicebox.plans.preprocess import preprocess_day
from sluicebox.plans.transfer import country_chain, lake_to_warehouse, warehouse_to_lake
from sluicebox.session import build_session
from sluicebox.sources.sinks import MAX_ROWS_PER_FILE


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sluicebox")
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("preprocess")
    for name in ("day", "source", "target"):
        job.add_argument(name)
    job.add_argument("--hours", default="0-23", help="0-23, or a list such as 0,1")
    job.add_argument("--layout", choices=["narrow", "wide"], default="narrow")
    job.add_argument("--publish", choices=["move", "run"], default="move")
    job.add_argument("--fix-locale", action="store_true")
    job.add_argument("--schema-file", help="file with the schema of the raw events as DDL text; spares a scan")
    job.add_argument("--denied", help="event types that are left out, with commas; empty for none")
    job.add_argument("--dropped", help="top-level fields that are left out, with commas; empty for none")
    job.add_argument("--order", choices=["text", "numeric"], default="text", help="order of versions")
    job.add_argument("--rows", type=int, help="rows of the newest version that show a type's schema; default all")
    job.add_argument("--order-by", default="", help="columns that order these rows, such as event_id")
    job.add_argument("--max-rows", type=int, default=MAX_ROWS_PER_FILE, help="rows per Parquet file")
    job.add_argument("--hour-column", default="hh")
    job.add_argument("--work", help="folder in which a run leaves what it staged, for its repetition if it fails")

    job = jobs.add_parser("warehouse-to-lake")
    for name in ("day", "dataset", "table", "directory"):
        job.add_argument(name)
    job.add_argument("--overwrite", action="store_true")

    job = jobs.add_parser("lake-to-warehouse")
    for name in ("day", "directory", "dataset", "table"):
        job.add_argument(name)

    job = jobs.add_parser("country-chain")
    for name in ("day", "directory", "source", "result", "copy"):
        job.add_argument(name)
    job.add_argument("--overwrite", action="store_true", help="replace the result table and the lake path")
    job.add_argument("--run", help="name that retries share; a repeated run replaces what it wrote before")
    return parser.parse_args(argv)


def parse_hours(text: str) -> list[int]:
    first, dash, last = text.partition("-")
    return list(range(int(first), int(last) + 1)) if dash else [int(hour) for hour in text.split(",")]


def names(text: str) -> list[str]:
    return [name for name in text.split(",") if name]


def read_schema(path: str) -> StructType:
    return StructType.fromDDL(Path(path).read_text())


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    spark = build_session(f"sluicebox {args.job}")
    if args.job == "preprocess":
        preprocess_day(
            spark,
            args.day,
            args.source,
            args.target,
            hours=parse_hours(args.hours),
            layout=args.layout,
            publish=args.publish,
            work=args.work,
            fix_locale=args.fix_locale,
            schema=read_schema(args.schema_file) if args.schema_file else None,
            order=args.order,
            rows=args.rows,
            order_by=names(args.order_by),
            max_rows=args.max_rows,
            hour_column=args.hour_column,
            denied=DENIED_TYPES if args.denied is None else names(args.denied),
            dropped=DROPPED_FIELDS if args.dropped is None else names(args.dropped),
        )
    elif args.job == "warehouse-to-lake":
        mode = "overwrite" if args.overwrite else "errorifexists"
        warehouse_to_lake(spark, args.day, f"{args.dataset}.{args.table}", args.directory, mode=mode)
    elif args.job == "lake-to-warehouse":
        lake_to_warehouse(spark, args.day, args.directory, f"{args.dataset}.{args.table}")
    else:
        modes = {"mode": "overwrite", "lake_mode": "overwrite"} if args.overwrite else {}
        tables = {"source": args.source, "result": args.result, "copy": args.copy}
        country_chain(spark, args.day, args.directory, **tables, **modes, run=args.run)


if __name__ == "__main__":
    main()
