"""Infer, declare, check and apply schemas."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import (
    as_text,
    cell_kind,
    column,
    loses_digits,
    parse_cell,
    type_of_mask,
)
from ..functions.names import clean_name, clean_names
from ..functions.samples import random_sample
from ..functions.typenames import declared_type, logical_type, sql_type, type_label

_MASKS = range(64)


def _field(name: str, data_type: T.DataType, field_id: int, required: bool) -> T.StructField:
    return T.StructField(name, data_type, not required, {"field_id": field_id})


def _label_of_mask(mask: Column, label) -> Column:
    labels = ";".join(label(type_of_mask(m)) for m in _MASKS)
    return F.get(F.split(F.lit(labels), ";"), mask)


def text_columns(df: DataFrame) -> DataFrame:
    """Every column as the text a CSV cell would hold."""
    return df.select([as_text(column(f.name), f.dataType).alias(f.name) for f in df.schema])


def column_kinds(df: DataFrame) -> DataFrame:
    """The kinds of cells in each column of an all-text frame, in one pass.

    One row per column: ``field_id``, ``name``, ``mask``, ``filled``, ``nulls``. Each task
    reduces its rows to one row per column before anything is shuffled, and the cell grammar is
    compiled once however many columns there are.
    """
    cells = df.select(F.posexplode(F.array(*[column(n) for n in df.columns])))
    # A constant: parsed once, when the plan is optimised.
    names = F.from_json(F.lit(json.dumps(df.columns)), "array<string>")
    return (
        cells.groupBy("pos")
        .agg(
            F.bit_or(cell_kind(F.col("col"))).alias("mask"),
            F.count("col").alias("filled"),
            F.count_if(F.col("col").isNull()).alias("nulls"),
        )
        .select(
            (F.col("pos") + 1).alias("field_id"),
            F.get(names, F.col("pos")).alias("name"),
            "mask",
            "filled",
            "nulls",
        )
    )


def inferred_columns(df: DataFrame) -> DataFrame:
    """Inferred schema as rows: ``field_id``, ``name``, ``type``, ``sql_type``, ``required``."""
    return column_kinds(df).select(
        "field_id",
        "name",
        _label_of_mask(F.col("mask"), type_label).alias("type"),
        _label_of_mask(F.col("mask"), sql_type).alias("sql_type"),
        F.lit(False).alias("required"),
    )


def infer_schema(df: DataFrame, sample_rows: int | None = None) -> T.StructType:
    """The narrowest type per column of an all-text frame.

    Looks at every row unless ``sample_rows`` asks for a random sample of about that many, which
    counts the rows but types only the sample. One small row per column reaches the driver.
    """
    if not df.columns:
        return T.StructType()
    seen = df if sample_rows is None else random_sample(df, sample_rows)
    masks = {r["field_id"]: r["mask"] for r in column_kinds(seen).collect()}
    return T.StructType(
        [
            _field(n.strip(), type_of_mask(masks.get(i, 0)), i, False)
            for i, n in enumerate(df.columns, 1)
        ]
    )


def schema_of(df: DataFrame) -> T.StructType:
    """The schema a frame would be loaded under: cleaned names, logical types."""
    names = clean_names(df.columns)
    return T.StructType(
        [
            _field(n, logical_type(f.dataType), i, False)
            for i, (n, f) in enumerate(zip(names, df.schema), 1)
        ]
    )


def declared_schema(declaration: str | Iterable[dict]) -> T.StructType:
    """A schema from JSON ``[{"id", "name", "type", "required"}]``; unknown types are text."""
    items = json.loads(declaration) if isinstance(declaration, str) else list(declaration)
    return T.StructType(
        [
            _field(
                item["name"],
                declared_type(item.get("type", "String")),
                item.get("id", i),
                bool(item.get("required", False)),
            )
            for i, item in enumerate(items, 1)
        ]
    )


def edit_schema(
    schema: T.StructType,
    *,
    rename: dict[str, str] | None = None,
    retype: dict[str, str] | None = None,
    require: dict[str, bool] | None = None,
    remove: Iterable[str] = (),
) -> T.StructType:
    """A schema after edits keyed by source name. Each field remembers its source column."""
    rename, retype, require = rename or {}, retype or {}, require or {}
    dropped = set(remove)
    fields = []
    for f in schema:
        if f.name in dropped:
            continue
        edited = T.StructField(
            rename.get(f.name, f.name),
            declared_type(retype[f.name]) if f.name in retype else f.dataType,
            not require.get(f.name, not f.nullable),
            {**f.metadata, "source": f.metadata.get("source", f.name)},
        )
        fields.append(edited)
    return T.StructType(fields)


def _sources(df: DataFrame, schema: T.StructType) -> dict[str, str | None]:
    """For each field the input column it is read from: of the same name, else of the same
    name once cleaned."""
    exact = {n.strip(): n for n in df.columns}
    cleaned = {clean_name(n): n for n in df.columns}
    found = {}
    for f in schema:
        wanted = f.metadata.get("source", f.name).strip()
        found[f.name] = exact.get(wanted, cleaned.get(wanted))
    return found


def typed_columns(
    df: DataFrame, schema: T.StructType, *, enforce_required: bool = False
) -> list[Column]:
    """Projection of an all-text frame onto ``schema``; a declared column absent from the input
    is null. With ``enforce_required`` a null in a required column fails the job before it
    commits anything."""
    sources = _sources(df, schema)
    out = []
    for f in schema:
        source = sources[f.name]
        if source is None:
            value = F.lit(None).cast(f.dataType)
        else:
            value = parse_cell(column(source), f.dataType)
        if enforce_required and not f.nullable:
            message = F.lit(f"required column {f.name} holds a null")
            value = F.coalesce(value, F.raise_error(message).cast(f.dataType))
        out.append(value.alias(f.name, metadata=dict(f.metadata)))
    return out


def apply_schema(
    df: DataFrame, schema: T.StructType, *, enforce_required: bool = False
) -> DataFrame:
    """Type an all-text frame; a cell that does not parse becomes null, the row stays."""
    return df.select(typed_columns(df, schema, enforce_required=enforce_required))


def _typed_with_losses(
    df: DataFrame, schema: T.StructType, enforce_required: bool = False, kept: Sequence[str] = ()
) -> tuple[DataFrame, list[Column]]:
    """The typed frame with a flag per cell that held something and per decimal cell that lost
    digits, and the aggregates ``rejected:<column>`` and ``rounded:<column>`` over it. Columns
    ``kept`` pass as they are."""
    sources = _sources(df, schema)
    losable = [
        f.name
        for f in schema
        if sources[f.name] is not None and not isinstance(f.dataType, T.StringType)
    ]
    given = [column(sources[n]).isNotNull().alias(f"__given:{n}") for n in losable]
    decimals = {
        f.name: f.dataType.scale
        for f in schema
        if f.name in losable and isinstance(f.dataType, T.DecimalType)
    }
    cut = [
        loses_digits(column(sources[n]), scale).alias(f"__rounded:{n}")
        for n, scale in decimals.items()
    ]
    typed = df.select(
        *typed_columns(df, schema, enforce_required=enforce_required),
        *given,
        *cut,
        *[column(n) for n in kept],
    )
    lost = [
        F.count_if(column(f"__given:{n}") & column(n).isNull()).alias(f"rejected:{n}")
        for n in losable
    ]
    lost += [
        F.count_if(column(f"__rounded:{n}") & column(n).isNotNull()).alias(f"rounded:{n}")
        for n in decimals
    ]
    return typed, lost


def load_counts(
    df: DataFrame, schema: T.StructType, *others: Column, kept: Sequence[str] = ()
) -> DataFrame:
    """One row on an all-text frame under a schema: ``total_rows``, ``rejected`` (cells lost per
    column), ``rounded`` (decimals that lose digits) and ``required_nulls`` (per required column),
    without zeros; and other aggregates of the typed columns and of those ``kept`` as they are."""
    typed, lost = _typed_with_losses(df, schema, kept=kept)
    required = [f.name for f in schema if not f.nullable]
    nulls = [F.count_if(column(n).isNull()).alias(f"null:{n}") for n in required]
    counted = typed.agg(F.count("*").alias("total_rows"), *lost, *nulls, *others)

    def positive(prefix: str) -> Column:
        pairs = [
            part
            for n in counted.columns
            if n.startswith(prefix)
            for part in (F.lit(n.removeprefix(prefix)), column(n))
        ]
        found = F.create_map(*pairs) if pairs else F.create_map()
        return F.map_filter(found.cast("map<string,bigint>"), lambda _, n: n > 0)

    kept = [c for c in counted.columns if not c.startswith(("rejected:", "rounded:", "null:"))]
    return counted.select(
        *[column(c) for c in kept],
        positive("rejected:").alias("rejected"),
        positive("rounded:").alias("rounded"),
        positive("null:").alias("required_nulls"),
    )


def apply_schema_observed(
    df: DataFrame,
    schema: T.StructType,
    observation: Observation | str,
    *,
    enforce_required: bool = False,
) -> DataFrame:
    """``apply_schema`` that counts rows and rejected cells per column as they stream past.

    Metrics are ``rows``, ``batches`` (input partitions read), ``rejected:<column>`` and, of
    decimal columns, ``rounded:<column>``. Cells are parsed once: the count compares each typed value with whether its cell held anything.
    """
    typed, lost = _typed_with_losses(df, schema, enforce_required)
    typed = typed.withColumn("__batch", F.spark_partition_id())
    batches = F.coalesce(F.max("__batch") + 1, F.lit(0)).alias("batches")
    watched = typed.observe(observation, F.count(F.lit(1)).alias("rows"), batches, *lost)
    return watched.select([column(f.name) for f in schema])


def rejected_counts(metrics: dict) -> dict[str, int]:
    """Columns that lost cells, from observed metrics."""
    return _counts(metrics, "rejected:")


def rounded_counts(metrics: dict) -> dict[str, int]:
    """Decimal columns whose cells lost digits, from observed metrics."""
    return _counts(metrics, "rounded:")


def _counts(metrics: dict, prefix: str) -> dict[str, int]:
    return {
        k.removeprefix(prefix): v for k, v in metrics.items() if k.startswith(prefix) and v
    }


def required_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Nulls in each required column of a typed frame: ``name``, ``violations``."""
    required = [f.name for f in schema if not f.nullable]
    if not required:
        return df.sparkSession.createDataFrame([], "name string, violations bigint")
    counted = df.agg(*[F.count_if(column(n).isNull()).alias(n) for n in required])
    pairs = [F.struct(F.lit(n).alias("name"), column(n).alias("violations")) for n in required]
    return counted.select(F.inline(F.array(*pairs)))


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as rows, like ``inferred_columns``."""
    rows = [
        (
            f.metadata.get("field_id", i),
            f.name,
            type_label(f.dataType),
            sql_type(f.dataType),
            not f.nullable,
        )
        for i, f in enumerate(schema, 1)
    ]
    return spark.createDataFrame(
        rows, "field_id int, name string, type string, sql_type string, required boolean"
    )


def schema_problems(rows: DataFrame) -> DataFrame:
    """One row: column count, repeated names, repeated ids, and whether the schema is valid."""
    counts = rows.agg(
        F.count("*").alias("columns"),
        (F.count("*") - F.count_distinct("name")).alias("repeated_names"),
        (F.count("*") - F.count_distinct("field_id")).alias("repeated_ids"),
    )
    sound = (
        (F.col("columns") > 0) & (F.col("repeated_names") == 0) & (F.col("repeated_ids") == 0)
    )
    return counts.withColumn("valid", sound)


def type_distribution(rows: DataFrame) -> DataFrame:
    """Columns per type: ``type``, ``columns``."""
    return rows.groupBy("type").agg(F.count("*").alias("columns"))


def sample_values(df: DataFrame, order_by: str, *, per_column: int = 3) -> DataFrame:
    """The first few rows' values per column, as text: ``name``, ``position``, ``value``.

    The order makes the choice repeatable and turns the limit into a distributed top-k.
    """
    fields = list(df.schema)
    head = df.orderBy(column(order_by)).limit(per_column)
    # Ranks only the few rows the limit left.
    order = F.row_number().over(Window.orderBy(column(order_by)))
    numbered = head.select("*", order.alias("__position"))
    pairs = [
        F.struct(F.lit(f.name).alias("name"), as_text(column(f.name), f.dataType).alias("value"))
        for f in fields
    ]
    return numbered.select(
        F.col("__position").alias("position"), F.inline(F.array(*pairs))
    ).select("name", "position", "value")


def create_table_sql(table: str, schema: T.StructType, *, using: str = "parquet") -> str:
    """The DDL that would create a table for this schema."""
    cols = ", ".join(
        f"`{f.name}` {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL")
        for f in schema
    )
    return f"CREATE TABLE {table} ({cols}) USING {using}"
