"""Windows that meet a bound exactly: sums in the order of rows, whatever order tasks bring them in."""

import shutil

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def met(tmp_path_factory):
    """A supplier's 600 windows of 50 lines, all with mean speed 0.78 but for the last bits, by the order of their lines."""
    d, rng = tmp_path_factory.mktemp("met"), np.random.default_rng(3)
    for t in oracle.TABLES:
        if t != "lineitem":
            shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", d)
    one = np.array([(q, c / 100) for q, c in zip([21, 23, 24, 26, 27, 29, 30, 28, 24, 28] * 5, [2, 3, 4, 5, 6, 7, 8, 9, 6, 2] * 5, strict=True)])
    assert one.sum(0) == pytest.approx([1300, 2.6])  # 0.5 x (26 / 25 + 10 x 0.052) = 0.78
    lines = np.concatenate([rng.permutation(one) for _ in range(600)])
    n = np.arange(len(lines))
    made = {"l_orderkey": n, "l_quantity": lines[:, 0], "l_discount": lines[:, 1]}
    pq.write_table(pa.table(made), d / "made.parquet")
    duckdb.sql(f"COPY (SELECT m.l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1 AS l_linenumber, m.l_quantity, 1000.0::DOUBLE AS l_extendedprice, m.l_discount, 0.04::DOUBLE AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1995-01-01' AS l_shipdate FROM '{d}/made.parquet' m) TO '{d}/lineitem.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["speed_regime_split", "regime_class_report"])
def test_whatever_is_spilled(spark, met, name):
    con = oracle.connection(met)
    con.sql("SET threads = 1")  # with several, SQL's own sums come in any order
    spark.conf.set("spark.sql.TungstenAggregate.testFallbackStartsAt", "0, 113")  # aggregates spill, as in little memory
    try:
        assert oracle.difference(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], met) == ""
    finally:
        spark.conf.unset("spark.sql.TungstenAggregate.testFallbackStartsAt")
