"""Run registered queries against DuckDB: python tests/run_checks.py [sf] [name ...]"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import REGISTRY  # noqa: E402
from oracle import connect, difference  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(REGISTRY)
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in names:
        began = time.monotonic()
        try:
            df = REGISTRY[name].run(spark, sf_dir)
            sql = REGISTRY[name].sql
            problem = difference(df, con, sql) if sql else None
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.monotonic() - began:.2f}s")
        if problem:
            print("     ", problem)
    print(f"{len(names) - bad}/{len(names)} match")
    spark.stop()
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
