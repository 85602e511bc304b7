"""The CUSUM bank over runs longer than a task: chunks run in parallel, and again where what comes in turns out other.

A chunk's alarms follow from its rows and the sums that come into it. At first every chunk but a run's first guesses: the
most probable class of its first row, and no sums. Then each takes what its predecessor has passed on, and those for whom
that differs in any bit from what they took before run again. After an alarm nothing depends on what was before it, so
what a chunk with one passes on is soon right; where none comes, sums grow through one chunk after the other, in as many
rounds, of which all but the first few take only the front chunk of those that differ. A run's k-th chunk is right after
k rounds at the latest or when those before it no longer change, and the loop ends when no chunk's input changes: then
all is, to the last bit, as if the rows had passed in one line.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.cusum import Sums, advance, argmax, log_probabilities
from loam.operators.long_runs import CHUNK_ROWS, with_chunks
from loam.shared import removed, shared_path

#: What a chunk passes on.
PASSED = ("active", "g", "s", "low", "low_at")
#: Rounds in which all chunks run whose input differs; then only the first of those that follow each other.
GUESSED = 3


def cusum_alarms(rows: DataFrame, classes: Sequence[str], thresholds: Sequence[float], *, keys: Sequence[str] = ("model", "run_id"), proba: str = "proba", position: str = "i", time: str = "t", label: str | None = None, warmup: int = 0, eps: float = 1e-9, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As `cusum.cusum_alarms`, for runs of any length; positions are unique within a run, keys have no nulls.

    Each round reads the rows of the chunks that run in it; sums, alarms and inputs are tables in the shared folder, of a
    row per chunk or alarm. Only whether a chunk is left comes to the driver. Rows are removed when the rounds are over;
    the alarms stay, as they are what is read."""
    spark, keys, n_classes = rows.sparkSession, list(keys), len(classes)
    hs, by = np.asarray(thresholds, dtype=float), [*keys, "_chunk"]
    folder = shared_path(spark, "cusum")

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    narrow = rows.select(*keys, F.col(position).cast("long").alias("_i"), F.col(time).cast("double").alias("_t"), F.col(proba).cast("array<double>").alias("_p"), (F.col(label) if label else F.lit(None)).cast("string").alias("_label"))
    data = table(with_chunks(narrow, keys, "_i", chunk_rows), "rows")
    line, whole = Window.partitionBy(*keys).orderBy("_chunk"), Window.partitionBy(*keys)
    known = F.when(F.col("_label").isNotNull(), F.struct("_i", F.col("_label").alias("name")))
    per = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(known).alias("_known"), F.min_by("_p", "_i").alias("_first"))
    named = F.array_position(F.array(*map(F.lit, classes)), F.min("_known").over(whole)["name"])
    guess = (F.array_position(F.array(*map(F.lit, classes)), argmax("_first", classes)) - 1).cast("int")
    begins = F.row_number().over(line) == 1
    lanes = lambda x: F.array_repeat(x, len(hs))
    base = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.when(begins & (named > 0), (named - 1).cast("int")).otherwise(guess)
    none = lambda x: F.array_repeat(F.lit(x), len(hs) * n_classes)
    entries = per.select(*by, base.alias("base"), lanes(start).alias("active"), *(none(0.0).alias(c) for c in ("g", "s", "low")), none(0).cast("array<bigint>").alias("low_at"))
    entries = table(entries, "entries-0")
    kinds = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in by)
    columns = [*by, "h", "k_a", "alarm_time", "to", "k0_hat", "g_max", *PASSED]
    kind = f"{kinds}, h double, k_a bigint, alarm_time double, to int, k0_hat bigint, g_max double, active array<int>, g array<double>, s array<double>, low array<double>, low_at array<bigint>"

    def run(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(entry):
            return pd.DataFrame(columns=columns)
        frame, own = frame.sort_values("_i"), entry.iloc[0]
        p = np.stack(frame["_p"].to_numpy()).astype(float)
        if p.shape[1] != n_classes:
            raise ValueError(f"every row needs {n_classes} probabilities")
        sums = Sums(np.array(own["active"], np.int64), *(np.array(own[c], np.int64 if c == "low_at" else float).reshape(len(hs), n_classes) for c in PASSED[1:]))
        k, t, n = int(own["base"]) + np.arange(len(frame)), frame["_t"].to_numpy(), len(frame)
        lane, row, to, low_at, top = advance(sums, log_probabilities(p, eps), k, np.zeros(len(hs), np.int64), np.full(len(hs), n), hs, warmup)
        key = [own[c] for c in by]
        out = [[*key, hs[j], k[i], t[i], c, low, g, *[None] * len(PASSED)] for j, i, c, low, g in zip(lane.tolist(), row.tolist(), to.tolist(), low_at.tolist(), top.tolist(), strict=True)]
        out.append([*key, None, None, None, None, None, None, *(x.ravel().tolist() for x in sums.all())])
        return pd.DataFrame(out, columns=columns)

    todo, done, round_ = entries, None, 0
    while True:
        some = data.join(todo.select(*by), by, "left_semi") if round_ else data
        found = table(some.groupBy(*by).cogroup(todo.groupBy(*by)).applyInPandas(run, kind).withColumn("_round", F.lit(round_)), f"found-{round_}")
        done = found if done is None else done.unionByName(found)
        latest = done.where("active is not null").groupBy(*by).agg(F.max_by(F.struct(*PASSED), "_round").alias("_x"))
        into = latest.select(*by, F.lag("_x").over(line).alias("_in")).where("_in is not null")
        round_ += 1
        both = entries.select(*by, "base", F.struct(*PASSED).alias("_had")).join(into, by, "left")
        both = both.withColumn("_new", F.coalesce(F.col("_in") != F.col("_had"), F.lit(False)))
        if round_ > GUESSED:  # what comes in behind a chunk that runs again is not yet right
            both = both.withColumn("_new", F.col("_new") & ~F.lag("_new", 1, False).over(line))
        entries = table(both.withColumn("_had", F.when(F.col("_new"), F.col("_in")).otherwise(F.col("_had"))).select(*by, "base", "_had.*", "_new"), f"entries-{round_}")
        todo = entries.where("_new")
        if todo.isEmpty():
            break
    last = done.groupBy(*by).agg(F.max("_round").alias("_round"))
    alarms = done.where("k_a is not null").join(last, [*by, "_round"])
    names = F.array(*map(F.lit, classes))
    out = table(alarms.select(*keys, "h", "k_a", "alarm_time", F.get(names, F.col("to")).alias("c_hat"), "k0_hat", "g_max"), "alarms")
    removed(spark, f"{folder}/rows")
    return out
