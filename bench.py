"""Time the headline operations; prints one JSON line.

Input text is prepared untimed. Each operation runs once to warm up and then ``BENCH_RUNS``
times (default 2); the best time counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.history import updates  # noqa: E402
from checks.registry import table, write_csv  # noqa: E402
from tableload import (  # noqa: E402
    Dialect,
    Transform,
    advise,
    apply_schema,
    infer_schema,
    ingest_dir,
    job_states,
    latest_jobs,
    load_csv,
    plan_load,
    profile,
    profile_approx,
    profile_exact,
    read_text,
    structure_report,
    write_table,
)
from tableload.session import scratch_database, scratch_path  # noqa: E402


def _done(result):
    if not result.success:
        raise RuntimeError(result.error)


def _noop(df):
    df.write.format("noop").mode("overwrite").save()


def operations(spark, sf_dir):
    """Name → (rows handled, thunk)."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    events, documents = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    parts = spark.sparkContext.defaultParallelism
    lineitem_csv = write_csv(lineitem.repartition(parts), "lineitem")
    orders_csv = write_csv(orders.repartition(parts), "orders")
    documents_csv = write_csv(documents.repartition(parts), "documents")
    text = read_text(spark, lineitem_csv)
    schema = infer_schema(text)
    declared = json.dumps(
        [{"name": f.name, "type": f.dataType.simpleString().replace("bigint", "long")
          .replace("timestamp_ntz", "timestamp")} for f in schema]
    )
    n, m = lineitem.count(), orders.count()
    db = scratch_database(spark)
    names = iter(range(1_000_000))

    def fresh():
        return f"{db}.t{next(names)}"

    return {
        "csv_scan_typed": (n, lambda: _noop(apply_schema(text, schema))),
        "infer_schema": (n, lambda: infer_schema(text)),
        "infer_schema_sample": (1000, lambda: infer_schema(text, sample_rows=1000)),
        "profile": (n, lambda: profile_exact(lineitem).collect()),
        "profile_sketched": (n, lambda: profile_approx(lineitem).collect()),
        "advise_csv": (
            m,
            lambda: advise(
                profile(apply_schema(read_text(spark, orders_csv), infer_schema(
                    read_text(spark, orders_csv))))
            ).collect(),
        ),
        "load_csv": (n, lambda: _done(load_csv(spark, lineitem_csv, fresh()))),
        "load_csv_declared": (
            n,
            lambda: _done(load_csv(spark, lineitem_csv, fresh(), schema=declared)),
        ),
        "load_multiline": (
            documents.count(),
            lambda: _done(
                load_csv(spark, documents_csv, fresh(), dialect=Dialect(multiline=True))
            ),
        ),
        "write_partitioned": (
            n,
            lambda: write_table(lineitem, fresh(), transforms=[Transform("l_shipdate", "month")]),
        ),
        "dry_run": (m, lambda: plan_load(spark, orders_csv, fresh()).collect()),
        "structure_check": (n, lambda: structure_report(spark, lineitem_csv).collect()),
        "stream_ingest": (
            m,
            lambda: ingest_dir(spark, orders_csv, fresh(), scratch_path(spark, "checkpoint")),
        ),
        "job_states": (events.count(), lambda: latest_jobs(job_states(updates(events))).collect()),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tableload-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    chosen = sys.argv[1:]
    for name, (rows, run) in operations(spark, sf_dir).items():
        if chosen and name not in chosen:
            continue
        run()
        times = []
        for _ in range(runs):
            began = time.monotonic()
            run()
            times.append(time.monotonic() - began)
        seconds[name] = round(min(times), 3)
        rates[name] = round(rows / min(times))
        print(f"{name}: {seconds[name]} s, {rates[name]} rows/s", file=sys.stderr)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf[1]) if sf else None,
                "rows_per_second": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
