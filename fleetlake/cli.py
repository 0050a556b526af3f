"""Command line: ``python -m fleetlake.cli <command> …`` (spark-submit friendly).

  load    DIR TABLE --ingest-id ID [--audit A] [--rejects R] [--mode strict|permissive]
  import  FILE VEHICLE_ID TABLE --ingest-id ID [--audit A] [--rejects R]
  stream  DIR TABLE --checkpoint C [--audit A] [--rejects R] [--available-now]
  build   TABLE [--mart PATH]
  export  TABLE OUT [--vehicle ID] [--format csv|json]

``load`` prints one line per file (``name: inserted=…, skipped=…, rejected=…``)
from the ingest audit, then the totals.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import functions as F

from fleetlake.session import build_session


def _load(args, spark) -> int:
    from fleetlake.plans.ingest import load_directory, per_file_counts

    audit = args.audit or f"{args.table.rstrip('/')}_audit"
    res = load_directory(
        spark, args.dir, args.table, args.ingest_id, args.mode, args.rejects, audit,
        files_per_batch=args.files_per_batch,
    )
    counts = per_file_counts(spark, audit, args.ingest_id, family=bool(args.files_per_batch)).select(
        F.regexp_extract("source_file", r"([^/]+)$", 1).alias("name"),
        "rows_inserted", "rows_skipped", "rows_rejected",
    )
    for row in counts.toLocalIterator():  # one line per file, streamed
        print(f"{row['name']}: inserted={row['rows_inserted']}, skipped={row['rows_skipped']}, "
              f"rejected={row['rows_rejected']}")
    print(res.as_dict())
    return 0


def _import(args, spark) -> int:
    from fleetlake.plans.ingest import import_file

    res = import_file(spark, args.file, args.vehicle_id, args.table, args.ingest_id, args.rejects, args.audit)
    print({"inserted": res.rows_inserted, "skipped": res.rows_skipped, "rejected": res.rows_rejected})
    return 0 if res.files_rejected == 0 else 2


def _stream(args, spark) -> int:
    from fleetlake.streaming.ingest_stream import start_ingest_stream

    query = start_ingest_stream(
        spark, args.dir, args.table, args.checkpoint, rejects_path=args.rejects, audit_path=args.audit,
        available_now=args.available_now, max_files_per_trigger=args.max_files,
    )
    query.awaitTermination()
    return 0


def _build(args, spark) -> int:
    from fleetlake.plans.build import build_with_tests
    from fleetlake.sources.tables import read_telemetry

    summary = build_with_tests(spark, read_telemetry(spark, args.table), mart_path=args.mart)
    rows = summary.orderBy("step").collect()  # one row per model or check
    for r in rows:
        print(f"{r['step']:>3} {r['model']:<22} {r['check_name']:<20} {r['column_name'] or '':<32} "
              f"{'' if r['failures'] is None else r['failures']:>8} {r['status']}")
    return 1 if any(r["status"] == "fail" for r in rows) else 0


def _export(args, spark) -> int:
    from fleetlake.plans.export import VehicleNotFound, export_fleet, export_vehicle
    from fleetlake.sources.tables import read_telemetry

    table = read_telemetry(spark, args.table)
    try:
        if args.vehicle:
            manifest = export_vehicle(spark, table, args.vehicle, args.out, args.format)
        else:
            manifest = export_fleet(table, args.out, args.format)
    except VehicleNotFound as exc:
        print(exc, file=sys.stderr)
        return 4
    manifest.write.mode("overwrite").json(f"{args.out.rstrip('/')}_manifest")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fleetlake", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="command", required=True)

    p = sub.add_parser("load")
    p.add_argument("dir")
    p.add_argument("table")
    p.add_argument("--ingest-id", default=None)
    p.add_argument("--audit")
    p.add_argument("--rejects")
    p.add_argument("--mode", choices=("strict", "permissive"), default="strict")
    p.add_argument("--files-per-batch", type=int, default=None)
    p.set_defaults(run=_load)

    p = sub.add_parser("import")
    p.add_argument("file")
    p.add_argument("vehicle_id")
    p.add_argument("table")
    p.add_argument("--ingest-id", default=None)
    p.add_argument("--audit")
    p.add_argument("--rejects")
    p.set_defaults(run=_import)

    p = sub.add_parser("stream")
    p.add_argument("dir")
    p.add_argument("table")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--audit")
    p.add_argument("--rejects")
    p.add_argument("--max-files", type=int, default=None)
    p.add_argument("--available-now", action="store_true")
    p.set_defaults(run=_stream)

    p = sub.add_parser("build")
    p.add_argument("table")
    p.add_argument("--mart")
    p.set_defaults(run=_build)

    p = sub.add_parser("export")
    p.add_argument("table")
    p.add_argument("out")
    p.add_argument("--vehicle")
    p.add_argument("--format", choices=("csv", "json"), default="csv")
    p.set_defaults(run=_export)

    args = parser.parse_args(argv)
    if getattr(args, "ingest_id", "unset") is None:
        args.ingest_id = f"{args.command}-{uuid.uuid4().hex[:12]}"
    spark = build_session("fleetlake")
    try:
        return args.run(args, spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
