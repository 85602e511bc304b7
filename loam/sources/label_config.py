"""Label configurations: JSON of intervals, their fallback from run to parent, lists of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def label_intervals(configs: DataFrame, *, run: str = "run_id", config: str = "config") -> DataFrame:
    """{label: [[start, end], ...]} to rows run_id, label, label_ord, range_ord, t0, t1, in the JSON's order."""
    entries = configs.select(run, F.posexplode(F.map_entries(F.from_json(config, "map<string, array<array<double>>>"))).alias("label_ord", "entry"))
    ranges = entries.select(run, F.col("entry.key").alias("label"), "label_ord", F.posexplode("entry.value").alias("range_ord", "range"))
    return ranges.select(run, "label", "label_ord", "range_ord", F.col("range")[0].alias("t0"), F.col("range")[1].alias("t1"))


def config_of_runs(runs: DataFrame, own: DataFrame, parents: DataFrame, *, run: str = "run_id", parent: str = "parent") -> DataFrame:
    """runs (run, parent) with the run's own config, else its parent's; `level` says which."""
    joined = runs.join(own.select(run, F.col("config").alias("_own")), run, "left").join(parents.select(parent, F.col("config").alias("_parent")), parent, "left")
    return joined.select(run, F.coalesce("_own", "_parent").alias("config"), F.when(F.col("_own").isNotNull(), "run").when(F.col("_parent").isNotNull(), "parent").alias("level"))


def discover_configs(spark: SparkSession, root: str, *, name: str = "labels_config.json") -> DataFrame:
    """run_dir, run_id, config and level of all labelled runs below a folder; files are listed and read by tasks.

    Runs are folders log_* one or more levels down, with their own config or else their parent's, and other folders with
    a config of their own and sensor logs log_t0_*. Folders without a config are left out (`config_of_runs` keeps them).
    """
    folder = lambda path: F.regexp_extract(path, "^(.*)/[^/]+$", 1)
    path = F.col("_metadata.file_path")
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    configs = found.select(folder(path).alias("dir"), F.col("value").alias("config")).dropDuplicates(["dir"])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"))
    files = files.select(folder(F.col("file")).alias("run_dir"), F.regexp_extract("file", "([^/]+)$", 1).alias("file"))
    files = files.withColumn("run_id", F.regexp_extract("run_dir", "([^/]+)$", 1)).withColumn("parent", folder(F.col("run_dir")))
    sensor = F.col("file").rlike(r"^log_t0_.*\.(txt|csv)$")
    runs = files.groupBy("run_dir", "run_id", "parent").agg(F.bool_or(sensor).alias("_logs"))
    own, parents = configs.select(F.col("dir").alias("run_dir"), "config"), configs.select(F.col("dir").alias("parent"), "config")
    level = config_of_runs(runs.select("run_dir", "parent"), own, parents, run="run_dir").where("level is not null")
    log = F.col("run_id").startswith("log_")
    return runs.drop("parent").join(level, "run_dir").where(log | (F.col("_logs") & (F.col("level") == "run"))).select("run_dir", "run_id", "config", "level")


def top_features(rows: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Feature names from JSON that is a list, {"top_features": [...]} or a map whose keys they are."""
    plain, wrapped, keyed = F.from_json(column, "array<string>"), F.from_json(column, "top_features array<string>")["top_features"], F.map_keys(F.from_json(column, "map<string, string>"))
    names = F.when(F.trim(F.col(column)).startswith("["), plain).otherwise(F.coalesce(wrapped, keyed))
    return rows.select(*keep, F.explode(names).alias("feature"))
