"""Target table steps: resolve, look up, create, drop."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.layout import Transform, parse_transform
from ..operators.schema import create_table_sql, schema_rows

TRANSFORMS_PROPERTY = "tableload.transforms"
# Properties that Spark or the metastore sets itself.
_SPARKS_OWN = ("spark.sql.", "transient_lastDdlTime", "numFiles", "totalSize", "EXTERNAL")


def quoted(name: str) -> str:
    """A dotted table name with every part quoted."""
    return ".".join("`" + p.strip("`").replace("`", "``") + "`" for p in name.split("."))


def quoted_part(name: str) -> str:
    """One column or table name, quoted; a dot in it is part of the name."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def resolve_table(spark: SparkSession, name: str) -> str:
    """``catalog.database.table`` from one to three parts, the session filling the rest."""
    parts = [p.strip() for p in name.split(".")]
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise ValueError(f"not a table name: {name!r}")
    defaults = [spark.catalog.currentCatalog(), spark.catalog.currentDatabase()]
    return ".".join(defaults[: 3 - len(parts)] + parts)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(resolve_table(spark, name))


def table_rows(spark: SparkSession, name: str) -> DataFrame:
    """The table's columns as schema rows, in ordinal order."""
    return schema_rows(spark, spark.table(name).schema)


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION {sql_text(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}{place}")


def table_location(base: str, catalog: str, database: str, table: str) -> str:
    """Default folder of a table below a warehouse base."""
    return f"{base.rstrip('/')}/{catalog}/{database}.db/{table}"


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    *,
    using: str = "parquet",
    transforms: Sequence[Transform] = (),
    properties: dict[str, str] | None = None,
    location: str | None = None,
) -> None:
    """Create an empty table. ``schema`` already holds any derived partition columns."""
    ddl = create_table_sql(quoted(name), schema, using=using)
    if transforms:
        cols = ", ".join(quoted_part(t.partition_column) for t in transforms)
        ddl += f" PARTITIONED BY ({cols})"
    if location:
        ddl += f" LOCATION {sql_text(location)}"
    if properties:
        ddl += f" TBLPROPERTIES ({_pairs(properties)})"
    spark.sql(ddl)
    remember_transforms(spark, name, transforms)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def remember_transforms(
    spark: SparkSession, name: str, transforms: Sequence[Transform]
) -> None:
    """Keep the partition transforms as a table property, for later appends and reads."""
    if transforms:
        text = json.dumps([[t.column, t.kind, t.width] for t in transforms])
        set_properties(spark, name, {TRANSFORMS_PROPERTY: text})


def _pairs(properties: dict[str, str]) -> str:
    return ", ".join(f"{sql_text(k)} = {sql_text(v)}" for k, v in properties.items())


def set_properties(spark: SparkSession, name: str, properties: dict[str, str]) -> None:
    if properties:
        spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({_pairs(properties)})")


def comment_on(spark: SparkSession, name: str, text: str) -> None:
    spark.sql(f"COMMENT ON TABLE {quoted(name)} IS {sql_text(text)}")


def table_transforms(spark: SparkSession, name: str) -> list[Transform]:
    """The partition transforms a table was created with."""
    text = table_properties(spark, name).get(TRANSFORMS_PROPERTY, "")
    if text.startswith("["):
        return [Transform(*t) for t in json.loads(text)]
    return [parse_transform(t) for t in text.split(";") if t.strip()]


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """The table's properties, without those Spark keeps for itself."""
    props = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()
    return {r["key"]: r["value"] for r in props if not r["key"].startswith(_SPARKS_OWN)}


class TableDetails(NamedTuple):
    """What the catalog tells of a table beside its columns; ``managed`` tables own their files."""

    provider: str
    location: str
    managed: bool
    comment: str | None


def table_details(spark: SparkSession, name: str) -> TableDetails:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").collect()
    # The details stand behind the columns, one of which may have the same name.
    titles = [i for i, r in enumerate(rows) if r["col_name"] == "# Detailed Table Information"]
    told = {r["col_name"]: r["data_type"] for r in rows[titles[-1] :]}
    return TableDetails(
        told["Provider"].lower(), told["Location"], told["Type"] == "MANAGED", told.get("Comment")
    )


def table_storage(spark: SparkSession, name: str) -> tuple[str, str]:
    """(provider, location) of a table."""
    return table_details(spark, name)[:2]
