"""Exact quantiles without a buffer that grows with the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the approximate quantiles that bracket the exact ones, in shares of a key's rows.
ERROR = 1e-4
#: Rows of a key up to which one buffer of distinct values serves.
SMALL = 50_000


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, c in enumerate(keys):
        on &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return on


def exact_quantiles(rows: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), *, small: int = SMALL, error: float = ERROR) -> DataFrame:
    """keys, n, q: the quantiles of a key's values, interpolated between the two next in rank; nulls are left out.

    Approximate quantiles a little below and above each one bracket it; a second pass counts what lies below each bracket
    and groups the few in a thousand values within, of which the ranks asked for are exact. Passes and buffers are the same
    whatever the rows' number; a key of up to `small` rows is one buffer of that size. Null keys are keys of their own;
    a key without values is left out; values may repeat at will. A bracket that misses its rank is an error, not a
    wrong result."""
    named = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    around = [min(1.0, max(0.0, p + d)) for p in probs for d in (-2 * error, 2 * error)]
    per = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", around, int(1 / error)).alias("_around"))
    per = per.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "n", "_around")
    both = named.join(per, _same(keys))
    few = both.where(F.col("n") <= small).groupBy(*keys).agg(F.first("n").alias("n"), F.percentile("_v", F.array(*map(F.lit, map(float, probs)))).alias("q"))
    many = both.where(F.col("n") > small)
    low, high = (lambda j: F.get("_around", 2 * j)), (lambda j: F.get("_around", 2 * j + 1))
    under = many.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*(F.count_if(F.col("_v") < low(F.lit(j))) for j in range(len(probs)))).alias("_under"))
    which = F.filter(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda j: F.col("_v").between(low(j), high(j)))
    cells = many.select(*keys, "_v", F.explode(which).alias("_j")).groupBy(*keys, "_j", "_v").agg(F.count(F.lit(1)).alias("_c"))
    line = Window.partitionBy(*keys, "_j").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_up", F.sum("_c").over(line))
    ranked = cells.join(under.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "n", "_under"), _same(keys))
    at = F.get(F.array(*map(F.lit, map(float, probs))), F.col("_j")) * (F.col("n") - 1)
    rank, upto = F.floor(at), F.get("_under", "_j") + F.col("_up")
    found = ranked.groupBy(*keys, "_j").agg(F.first("n").alias("n"), F.first(at).alias("_at"), F.min(F.when(upto > rank, F.col("_v"))).alias("_lo"), F.min(F.when(upto > F.least(rank + 1, F.col("n") - 1), F.col("_v"))).alias("_hi"), F.first(F.get("_under", "_j")).alias("_u"))
    inside = (F.col("_u") <= F.floor("_at")) & F.col("_hi").isNotNull()
    q = F.when(inside, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).otherwise(F.raise_error(F.lit("a bracket missed its quantile")).cast("double"))
    found = found.groupBy(*keys).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_j", q.alias("q")))), lambda x: x["q"]).alias("q"))
    return few.unionByName(found).where(F.col("n").isNotNull())  # without keys, no rows still make a row
