"""A folder per run holds one file, however many tasks a run's rows come from."""

import pytest

from loam.sources import logs


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_a_file_per_run(spark, tmp_path, fmt):
    rows = [(f"log_{i % 3}", float(i)) for i in range(90)]
    logs.write_runs(spark.createDataFrame(rows, "run_id string, t double").repartition(6), str(tmp_path / fmt), fmt)
    for run in range(3):
        assert len(list((tmp_path / fmt / f"run_id=log_{run}").glob(f"*.{fmt}"))) == 1
    back = spark.read.format(fmt).option("header", True).schema("t double, run_id string").load(str(tmp_path / fmt))
    assert sorted((r.run_id, r.t) for r in back.collect()) == sorted(rows)
