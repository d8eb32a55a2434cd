"""Append-only tables: layout, creation, appends and schema changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.session import materialise

FIELD_ROW = "field string, position int, type string"


def clustered_by_day(df: DataFrame, ts: str, cluster: list[str]) -> DataFrame:
    """Add the day partition column ``date`` and lay rows out by (date, cluster).

    Range partitioning on all of them spreads one heavy day over several tasks and files.
    """
    dated = df.withColumn("date", F.to_date(ts))
    return dated.repartitionByRange("date", *cluster).sortWithinPartitions("date", *cluster)


def append_rows(df: DataFrame, path: str, ts: str, cluster: list[str], required: list[str]) -> dict[str, int]:
    """Append rows as day-partitioned parquet and report counts.

    Rows without a required value are not written and count as failed; the append itself is atomic. The rows
    are staged once in scratch, so that whatever made them runs once for the counts, the range sampling of
    the layout and the append.
    """
    broken = F.lit(False)
    for name in required:
        broken = broken | F.col(name).isNull()
    staged = materialise(df, "append")
    counts = staged.agg(F.count("*").alias("total_rows"), F.count_if(broken).alias("failed_rows")).first().asDict()
    clustered_by_day(staged.filter(~broken), ts, cluster).write.mode("append").partitionBy("date").parquet(path)
    return {**counts, "successful_rows": counts["total_rows"] - counts["failed_rows"]}


def write_processed(df: DataFrame, root: str, day: Column) -> None:
    """Cleaned rows under ``root``/date=.../ as parquet."""
    df.withColumn("date", day).write.mode("append").partitionBy("date").parquet(root)


def list_run_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and modification time of the files below ``path``; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("updated"))


def expired_runs(runs: DataFrame, source: str, name: str, as_of: Column, keep: int, days: int) -> DataFrame:
    """Runs to delete: beyond the newest ``keep`` of their source and older than ``days`` or without a readable name."""
    newest = Window.partitionBy(source).orderBy(F.col(name).desc())
    started = F.try_to_timestamp(F.col(name), F.lit("yyyy-MM-dd_HHmmss")).cast("timestamp_ntz")
    ranked = runs.withColumns({"_rank": F.row_number().over(newest), "started": started})
    old = F.col("started").isNull() | (F.col("started") < as_of - F.make_dt_interval(days=F.lit(days)))
    return ranked.filter((F.col("_rank") > keep) & old).drop("_rank")


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{where}")


def ensure_table(
    spark: SparkSession, table: str, schema: T.StructType, partition: str = "date", comment: str = ""
) -> None:
    """Create a parquet table with a day partition column if it does not exist."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    text = comment.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, `{partition}` date) USING parquet "
        f"PARTITIONED BY (`{partition}`) COMMENT '{text}'"
    )


def append_to_table(df: DataFrame, table: str, ts: str, cluster: list[str]) -> None:
    names = [c.name for c in df.sparkSession.catalog.listColumns(table)]
    clustered_by_day(df, ts, cluster).select(*names).write.mode("append").insertInto(table)


def table_schema(spark: SparkSession, table: str) -> T.StructType | None:
    return spark.table(table).schema if spark.catalog.tableExists(table) else None


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def recreate_tables(spark: SparkSession, tables: dict[str, T.StructType]) -> None:
    for table, schema in tables.items():
        drop_table(spark, table)
        ensure_table(spark, table, schema)


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    rows = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, FIELD_ROW)


def schema_diff(spark: SparkSession, left: T.StructType, right: T.StructType) -> DataFrame:
    """One row per field of either side: types and same / type / position / missing_left / missing_right."""
    a = schema_rows(spark, left).selectExpr("field", "position AS left_position", "type AS left_type")
    b = schema_rows(spark, right).selectExpr("field", "position AS right_position", "type AS right_type")
    status = (
        F.when(F.col("left_type").isNull(), "missing_left")
        .when(F.col("right_type").isNull(), "missing_right")
        .when(F.col("left_type") != F.col("right_type"), "type")
        .when(F.col("left_position") != F.col("right_position"), "position")
        .otherwise("same")
    )
    return a.join(b, "field", "full").select("field", "left_type", "right_type", status.alias("status"))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add null columns of the given types; existing ones are left alone."""
    missing = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def add_table_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> list[str]:
    """The same on a stored table; returns the names that were added."""
    present = {c.name for c in spark.catalog.listColumns(table)}
    added = [name for name in columns if name not in present]
    if added:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{n}` {columns[n]}' for n in added)})")
    return added


def rename_by_copy(df: DataFrame, old: str, new: str) -> DataFrame:
    """Copy ``old`` into ``new`` where that is null; ``old`` stays. Nothing is done if ``new`` is already filled in."""
    if old not in df.columns:
        raise ValueError(f"column {old} does not exist")
    if new in df.columns:
        return df.withColumn(new, F.coalesce(F.col(new), F.col(old)))
    return df.withColumn(new, F.col(old))


def backfill_column(df: DataFrame, column: str, expression: str, where: str) -> DataFrame:
    """Set ``column`` to an SQL expression on the rows that meet ``where``."""
    return df.withColumn(column, F.when(F.expr(where), F.expr(expression)).otherwise(F.col(column)))


def backfill_count(df: DataFrame, where: str) -> int:
    """Dry run: the number of rows a backfill would change."""
    return df.filter(F.expr(where)).count()


def set_column_comment(df: DataFrame, column: str, text: str) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"column {column} does not exist")
    return df.withMetadata(column, {"comment": text})


def set_table_column_comment(spark: SparkSession, table: str, column: str, text: str) -> None:
    if column not in [c.name for c in spark.catalog.listColumns(table)]:
        raise ValueError(f"column {column} does not exist in {table}")
    spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{column}` COMMENT '{text.replace(chr(39), chr(92) + chr(39))}'")
