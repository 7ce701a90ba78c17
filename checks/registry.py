"""The query registry and what queries share: reading tables, staging text, naming databases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tableload.operators.schema import text_columns
from tableload.session import scratch_path
from tableload.sources.csv import Dialect

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}

# Columns and their inferred types of the tables without nested columns.
FLAT_TABLES = {
    "region": {"r_regionkey": "long", "r_name": "string"},
    "nation": {"n_nationkey": "long", "n_name": "string", "n_regionkey": "long"},
    "customer": {
        "c_custkey": "long",
        "c_name": "string",
        "c_nationkey": "long",
        "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "supplier": {
        "s_suppkey": "long",
        "s_name": "string",
        "s_nationkey": "long",
        "s_acctbal": "double",
    },
    "part": {
        "p_partkey": "long",
        "p_name": "string",
        "p_brand": "string",
        "p_type": "string",
        "p_size": "long",
        "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "long",
        "o_custkey": "long",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp",
        "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "long",
        "l_partkey": "long",
        "l_suppkey": "long",
        "l_linenumber": "long",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp",
    },
    "events": {
        "event_id": "long",
        "ts": "timestamp",
        "user_id": "long",
        "event_type": "string",
        "value": "double",
        "props": "string",
    },
    "documents": {
        "doc_id": "long",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "long",
    },
    "labels": {"doc_id": "long", "quality": "long", "toxic": "long"},
    "pages": {"page_id": "long", "url": "string", "html": "string"},
    "benchmark": {"item_id": "long", "text": "string"},
    "conversations": {"conv_id": "long", "turn": "long", "role": "string", "text": "string"},
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL."""

    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_csv(df: DataFrame, path: str) -> None:
    """The frame as one more file of delimited text in a folder."""
    text_columns(df).coalesce(1).write.mode("append").options(header="true", escape='"').csv(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt anew over as many partitions as their bytes ask for, so that no task gets
    more of them as tables grow."""
    return df.hint("rebalance")


def write_csv(
    df: DataFrame, name: str, dialect: Dialect = Dialect(), *, extension: str = "csv"
) -> str:
    """The frame as delimited text in a fresh folder; returns the folder."""
    path = scratch_path(df.sparkSession, name)
    (
        text_columns(df)
        .write.options(
            sep=dialect.sep,
            quote=dialect.quote,
            escape=dialect.quote,
            header=str(dialect.header).lower(),
            extension=extension,
            ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
        )
        .csv(path)
    )
    return path


def write_lines(df: DataFrame, name: str) -> str:
    """A one-column text frame as plain lines in a fresh folder; returns the folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path
