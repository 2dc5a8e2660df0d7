"""Scans and sinks: CSV, compressed CSV, Parquet and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str


def read_loan_csv(spark: SparkSession, path: str, schema: Schema | None = None, *,
                  multi_line: bool = True) -> DataFrame:
    """CSV with quoted line breaks; bad rows are kept, their bad fields NULL.

    With ``schema`` the file is read once; without it Spark infers the types in
    an extra pass. A file with line breaks inside fields cannot be split: give
    a folder of files, or ``multi_line=False`` where no field has one.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_csv(spark: SparkSession, path: str, *, header: bool = True, infer_schema: bool = True,
             schema: Schema | None = None) -> DataFrame:
    reader = spark.read.option("header", header)
    return (reader.schema(schema) if schema else reader.option("inferSchema", infer_schema)).csv(path)


def read_compressed_csv(spark: SparkSession, path: str, schema: Schema | None = None,
                        partitions: int | None = None, multi_line: bool = True) -> DataFrame:
    """Gzip files as they are. Each is one task to read; the rows are then spread."""
    frame = read_loan_csv(spark, path, schema, multi_line=multi_line)
    return frame.repartition(partitions) if partitions else frame.repartition()


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str, *, header: bool = True,
                   infer_schema: bool = True, schema: Schema | None = None) -> DataFrame:
    """Convert and give back the Parquet table, so the CSV is parsed once."""
    write_parquet(read_csv(spark, csv_path, header=header, infer_schema=infer_schema, schema=schema), parquet_path)
    return read_parquet(spark, parquet_path)


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def write_parquet(df: DataFrame, path: str, *, key: str | None = None, partitions: int | None = None) -> None:
    """Overwrite; with ``key`` the rows are first placed by that key."""
    if key:
        df = df.repartition(partitions, key) if partitions else df.repartition(key)
    df.write.mode("overwrite").parquet(path)


def write_reports(df: DataFrame, path: str, by: str = "feature") -> None:
    """One CSV folder per report (``by=value``) from one long table.

    Report tables are small, so each folder gets a single file.
    """
    df.repartition(by).sortWithinPartitions(by).write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: Schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row is kept with probability ``fraction``."""
    return df.sample(fraction=fraction, seed=seed)


def file_count(df: DataFrame) -> DataFrame:
    """Number of files and rows a scan reads."""
    return df.select(F.input_file_name().alias("f")).agg(
        F.count_distinct("f").alias("files"), F.count(F.lit(1)).alias("rows"))
