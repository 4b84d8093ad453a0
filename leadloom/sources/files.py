"""Append-only JSON-lines logs, payload archives and CSV export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON-lines log; a missing path is an empty table, blank lines are skipped, a bad line fails the read."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Appends rows as JSON lines; an empty frame appends no rows."""
    writer = rows.write.mode("append").option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def archive_payloads(pages: DataFrame, path: str, by: tuple[str, ...] = ("company_id", "run_id")) -> None:
    """The raw payloads, a folder for each company and run (or the columns given, where those are too many), each overwritten as a whole."""
    rows = pages.select("company_id", "run_id", "page_id", "payload", *[c for c in by if c not in ("company_id", "run_id")]).repartition(*by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def csv_rows(rows: DataFrame) -> DataFrame:
    """Every column as text for export: nulls as "", doubles with three digits, instants in ISO form, structures as JSON; struct columns are flattened to parent_child."""
    out: list[Column] = []
    for field in rows.schema.fields:
        parts = [(f"{field.name}_{f.name}", F.col(f"`{field.name}`.`{f.name}`"), f.dataType) for f in field.dataType.fields] if isinstance(field.dataType, StructType) else [(field.name, F.col(f"`{field.name}`"), field.dataType)]
        for name, column, kind in parts:
            if kind.typeName() == "double":
                text = F.format_string("%.3f", column)
                text = F.when(column.isNotNull(), text)
            elif kind.typeName() == "timestamp":
                text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ssXXX")
            elif isinstance(kind, (ArrayType, MapType, StructType)):
                text = F.to_json(column)
            else:
                text = column.cast("string")
            out.append(F.coalesce(text, F.lit("")).alias(name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    """Writes the export as CSV parts with a header each."""
    csv_rows(rows).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def read_fixture(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The elements of one JSON array in a file, or of several files."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
