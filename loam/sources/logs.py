"""Reading and writing sensor logs, whole directories at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the sensors' logs.
SENSOR_COLUMNS = {"acc": ("t", "ax", "ay", "az"), "gyro": ("t", "gx", "gy", "gz"), "odo": ("t", "v1", "v2"), "pose": ("t", "x", "y", "heading", "tilt")}
REQUIRED = ("acc", "gyro", "odo")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df


def parse_lines(lines: DataFrame, columns: Sequence[str], *, value: str = "value", use: Sequence[int] | None = None) -> DataFrame:
    """Text lines to doubles: what follows % is comment, white space parts fields; short or bad fields are null."""
    parts = F.split(F.trim(F.regexp_replace(F.col(value), "%.*$", "")), r"\s+")
    places = use if use is not None else range(len(columns))
    fields = [F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(c) for i, c in zip(places, columns, strict=True)]
    return lines.select(*(c for c in lines.columns if c != value), *fields)


def clean_rows(rows: DataFrame, required: Sequence[str], *, keys: Sequence[str] = ("run_id",), time: str = "t", arrival: Sequence[Column | str] | None = None) -> DataFrame:
    """Without rows that lack a required value; of rows with equal keys and time only the first by `arrival`."""
    order = Window.partitionBy(*keys, time).orderBy(*(arrival or [F.monotonically_increasing_id()]))
    return rows.dropna(subset=list(required)).withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def run_of(path: Column) -> Column:
    """The run folder's name (log_...) in a file's path, also of a folder that `write_runs` made (run_id=log_...)."""
    return F.nullif(F.regexp_extract(path, r"/(?:[^/=]+=)?(log_[^/]+)/", 1), F.lit(""))


def read_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All CSV files with a header below a path, however deep: run_id by folder (`run_of`) and the schema's columns. Files
    outside a run's folder are left out; a run that lies in several places is one."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    return rows.select(run_of(F.col("_metadata.file_path")).alias("run_id"), "*").where("run_id is not null")


def read_log(spark: SparkSession, glob: str, sensor: str) -> DataFrame:
    """All logs of a sensor below a path: run_id and the sensor's columns. Text logs by white space."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{sensor}*.txt").text(glob)
    lines = lines.select(run_of(F.col("_metadata.file_path")).alias("run_id"), F.monotonically_increasing_id().alias("_line"), "value")
    parsed = parse_lines(lines, SENSOR_COLUMNS[sensor])
    return clean_rows(parsed, SENSOR_COLUMNS[sensor], arrival=["_line"]).drop("_line")


def read_csv(spark: SparkSession, glob: str, sensor: str) -> DataFrame:
    """As read_log, for CSV with a header; further columns are kept, missing ones are an error."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{sensor}*.csv").csv(glob)
    require_columns(rows, SENSOR_COLUMNS[sensor])
    rows = rows.select(run_of(F.col("_metadata.file_path")).alias("run_id"), F.monotonically_increasing_id().alias("_line"), *(F.col(c).try_cast("double").alias(c) if c in SENSOR_COLUMNS[sensor] else F.col(c) for c in rows.columns))
    return clean_rows(rows, SENSOR_COLUMNS[sensor], arrival=["_line"]).drop("_line")


def complete_runs(samples: DataFrame, *, run: str = "run_id", sensor: str = "sensor", required: Sequence[str] = REQUIRED) -> DataFrame:
    """Samples of runs that hold every required sensor."""
    have = samples.where(F.col(sensor).isin(*required)).groupBy(run).agg(F.count_distinct(sensor).alias("_n")).where(F.col("_n") == len(required))
    return samples.join(have.select(run), run, "left_semi")


def relative_time(samples: DataFrame, *, run: str = "run_id", time: str = "t") -> DataFrame:
    """Adds t_rel: time since the run's first sample of any sensor."""
    start = samples.groupBy(run).agg(F.min(time).alias("_t0"))
    return samples.join(start, run).withColumn("t_rel", F.col(time) - F.col("_t0")).drop("_t0")


def write_runs(df: DataFrame, path: str, fmt: str = "parquet", by: str = "run_id") -> None:
    """One folder per run; fmt: parquet, csv (with header) or json. A run's rows go to one task, which writes one file;
    runs go to as many tasks as the session shuffles to."""
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n_tasks, by).write.mode("overwrite").partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV or Parquet by suffix."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown suffix: {path}")


def sensor_frames(spark: SparkSession, root: str, have: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Each sensor's table; have: the format ('csv' or 'txt') by sensor, CSV where not given."""
    have = have or {}
    return {s: (read_log if have.get(s, "csv") == "txt" else read_csv)(spark, root, s) for s in SENSOR_COLUMNS if s in REQUIRED or s in have}
