"""Labels from interval tables, and reports on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.operators.long_runs import with_place


#: Ends of a run's intervals at most.
MOST_ENDS = (1 << 20) - 1


def elementary(ranges: Sequence[tuple]) -> tuple[list, list[str | None]]:
    """Disjoint pieces of closed intervals (.., t0, t1, name), the first of which wins where they overlap.

    The ends in order, and a name or None for each piece: piece 2k is the k-th end itself, 2k + 1 what lies between it
    and the next. Every piece is named once: what is named already is skipped over, so work grows with the intervals'
    number, not with how many overlap. Intervals with a missing end, or that end before they begin, hold nothing."""
    held = [r for r in ranges if r["t0"] is not None and r["t1"] is not None and r["t0"] <= r["t1"]]
    ends = sorted({e for r in held for e in (r["t0"], r["t1"])})
    if len(ends) > MOST_ENDS:
        raise ValueError(f"a run has more than {MOST_ENDS} ends of intervals")
    place = {e: 2 * k for k, e in enumerate(ends)}
    names: list[str | None] = [None] * (2 * len(ends))
    free = list(range(2 * len(ends) + 1))  # the first piece from here on that has no name yet

    def first_free(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    for r in held:
        i = first_free(place[r["t0"]])
        while i <= place[r["t1"]]:
            names[i], free[i] = r["name"], i + 1
            i = first_free(i)
    return ends, names


def label_samples(samples: DataFrame, intervals: DataFrame, *, run: str = "run_id", time: str = "t") -> DataFrame:
    """Adds label: of the first interval (by label_ord, range_ord) with t0 <= time <= t1, null if there is none.

    A run's intervals become disjoint pieces once (`elementary`) and travel as one sorted array, so samples are joined on
    the run alone and never multiplied; a sample finds its piece by binary search. Null times and runs have no label;
    repeated and overlapping intervals are settled by order; NaN times have none either.
    """
    kind = intervals.schema["t0"].dataType
    arrays = intervals.where(F.col(run).isNotNull()).groupBy(run).agg(F.array_sort(F.collect_list(F.struct("label_ord", "range_ord", "t0", "t1", F.col("label").alias("name")))).alias("_ranges"))
    pieces = F.udf(lambda ranges: elementary(ranges), T.StructType([T.StructField("ends", T.ArrayType(kind)), T.StructField("names", T.ArrayType(T.StringType()))]))
    arrays = arrays.select(run, pieces("_ranges").alias("_pieces")).select(run, F.col("_pieces.ends").alias("_ends"), F.col("_pieces.names").alias("_names"))
    placed = with_place(samples.drop("label").join(arrays, run, "left"), "_ends", time, MOST_ENDS, "_place")
    piece = F.when(F.get("_ends", "_place") == F.col(time), 2 * F.col("_place")).otherwise(2 * F.col("_place") - 1)
    return placed.withColumn("label", F.get("_names", F.when(piece >= 0, piece))).drop("_ends", "_names", "_place")


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """label (null: unlabeled), n, percent."""
    per = rows.groupBy(F.coalesce(F.col(label), F.lit("unlabeled")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_all"))
    return per.join(F.broadcast(total)).select("label", "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def crosstab(rows: DataFrame, run: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Rows per run and label, 0 where there are none."""
    return rows.groupBy(run).pivot(label, list(labels)).count().fillna(0, list(labels))


def label_changes(rows: DataFrame, *, run: str = "run_id", label: str = "label", position: str = "i", around: int = 2, most: int = 3) -> DataFrame:
    """The rows from `around` before to `around` after each run's first `most` changes of label: run, change, position,
    offset, label. Two nulls are no change."""
    line = Window.partitionBy(run).orderBy(position)
    flagged = rows.withColumn("_change", (F.lag(position).over(line).isNotNull() & ~F.col(label).eqNullSafe(F.lag(label).over(line))).cast("int"))
    numbered = flagged.withColumn("_no", F.sum("_change").over(line))
    # only rows near a change are looked at, from both sides of it
    offsets = F.array(*map(F.lit, range(-around, around + 1)))
    at = numbered.where((F.col("_change") == 1) & (F.col("_no") <= most)).select(run, F.col("_no").cast("bigint").alias("change"), F.col(position).alias("_at"), F.explode(offsets).alias("offset"))
    return at.withColumn(position, F.col("_at") + F.col("offset")).join(rows.select(run, position, label), [run, position]).select(run, "change", position, F.col("offset").cast("bigint").alias("offset"), label)


def without_config(runs: DataFrame, configs: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(runs that have a configuration, runs that have none)."""
    return runs.join(configs.select(run), run, "left_semi"), runs.join(configs.select(run), run, "left_anti")


def unexpected_labels(rows: DataFrame, expected: DataFrame, label: str = "label") -> DataFrame:
    """label, issue: labels that are in one of both tables only ('unexpected' or 'missing')."""
    have, want = rows.select(label).dropna().distinct(), expected.select(label).dropna().distinct()
    return have.join(want, label, "left_anti").withColumn("issue", F.lit("unexpected")).unionByName(want.join(have, label, "left_anti").withColumn("issue", F.lit("missing")))
