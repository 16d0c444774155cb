"""Sources and sinks: parquet, CSV, JSON side files, gridded files, incremental ingest."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = r"(\d{8})-S(\d{6})-E(\d{6})"


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet, only the named columns."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and a given schema; values that don't fit it become NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON side files with a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet with zstd, overwriting, partitioned if asked."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with header; sorted over all files by range partitions if an order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """Lines of a Markdown table (line): header, rule and one line a row, for bounded reports."""
    spark = df.sparkSession
    head = [(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))]
    body = df.select(F.lit(2).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("line"))
    return spark.createDataFrame(head, "part int, line string").unionByName(body)


def file_steps(spark: SparkSession, root: str, glob: str = "*.npz") -> DataFrame:
    """Gridded files below ``root``: (path, step_start, depth), the deepest path of each half-hour, then the first by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    rows = files.select("path", F.regexp_extract("path", STEP, 0).alias("step_start"), F.length(F.regexp_replace("path", "[^/]", "")).alias("depth")).filter("step_start <> ''")
    return rows.groupBy("step_start").agg(F.min(F.struct((-F.col("depth")).alias("d"), "path")).alias("f")).select("f.path", "step_start", (-F.col("f.d")).alias("depth"))


def read_npz_grid(spark: SparkSession, root: str, glob: str = "*.npz", variable: str = "precipitation") -> DataFrame:
    """Long table (path, step_minute, i, j, rate) of npz grids [lon, lat]; negative and non-finite rates become NULL.

    Each file is decoded by the task that reads it; store the result partitioned by day and read that.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(content)) as z:
                    grid = np.asarray(z[variable], dtype=np.float64)
                    at = int(z["time"]) if "time" in z else 0
                i, j = np.indices(grid.shape)
                v = grid.ravel()
                yield pd.DataFrame({"path": path, "step_minute": at, "i": i.ravel(), "j": j.ravel(), "rate": np.where(np.isfinite(v) & (v >= 0), v, np.nan)})

    rows = raw.mapInPandas(decode, "path string, step_minute bigint, i int, j int, rate double")
    return rows.withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))


def not_yet_ingested(found: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files that the manifest does not list: an incremental run reads only these."""
    return found.join(manifest.select(key).distinct(), key, "left_anti")
