"""Scans over runs that are too long for one task.

A run of more than `chunk_rows` rows is cut into chunks of about equal size along its order, at approximate quantiles of
time. Every chunk is scanned by itself; a summary row per chunk goes through a window by run, which gives each chunk what
the run has before and after it, and the rows take that from a join on (run, chunk), by which they lie already. A run's
rows never meet in one task, and its summaries are one row in chunk_rows. Runs of fewer rows are a chunk each, so results
are those of `segments`, `transitions` and `align`, whatever chunk_rows is. Rows of equal time are one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000
#: Chunks of one run at most.
MOST_CHUNKS = 1024
_PAST, _NOW = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def with_place(rows: DataFrame, bounds: str, x: str, most: int, name: str) -> DataFrame:
    """Adds how many of a sorted array's values, `most` at most, are less than x; 0 for null arrays and values. Binary
    search, a projection per step: all steps are in one generated loop, and an array of a thousand costs ten looks."""
    out = rows.withColumn(name, F.lit(0))
    for k in reversed(range(most.bit_length())):
        out = out.withColumn(name, F.col(name) + F.when(F.get(bounds, F.col(name) + ((1 << k) - 1)) < F.col(x), 1 << k).otherwise(0))
    return out


def with_chunks(rows: DataFrame, keys: Sequence[str], time: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds _chunk, which grows with time within a key; 0 throughout keys of up to chunk_rows rows, null keys and times.

    What is broadcast is a number per chunk of long keys, so less than one in chunk_rows rows. The bounds come from the
    times whose hash is among one in chunk_rows / 1000: about a thousand of each chunk; what they leave uneven is even
    enough, and no result depends on it. Rows are read three times: store them before, if they are dear to make."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows)
    some = rows.select(*keys, time).where(F.pmod(F.xxhash64(*keys, time), F.lit(max(1, chunk_rows // 1000))) == 0)
    quantiles = F.percentile_approx(time, [k / MOST_CHUNKS for k in range(1, MOST_CHUNKS)], 10 * MOST_CHUNKS)
    per = some.join(F.broadcast(counts), list(keys)).groupBy(*keys).agg(F.first("_n").alias("_n"), quantiles.alias("_q"))
    m = F.least(F.lit(MOST_CHUNKS), F.ceil(F.col("_n") / chunk_rows)).cast("int")
    bounds = F.array_distinct(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.get("_q", F.floor(k * MOST_CHUNKS / m).cast("int") - 1)))
    found = per.where("_q is not null").select(*keys, bounds.alias("_bounds"))
    return with_place(rows.join(F.broadcast(found), list(keys), "left"), "_bounds", time, MOST_CHUNKS - 1, "_chunk").drop("_bounds")


def _lines(keys: Sequence[str], order: Sequence[Column]) -> tuple:
    """Windows over a chunk in order and over its key's chunks in order."""
    return Window.partitionBy(*keys, "_chunk").orderBy(*order), Window.partitionBy(*keys).orderBy("_chunk")


def with_segments(samples: DataFrame, gap: float, *, run: str = "run_id", time: str = "t", tie: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS, counted: bool = False) -> DataFrame:
    """As `segments.with_segments`; counted: adds segment_rows, how many rows the segment has (for `segments.window_rows`)."""
    rows = with_chunks(samples.where(F.col(run).isNotNull()), [run], time, chunk_rows)
    order = [F.col(c) for c in (time, *tie)]
    line, chunks = _lines([run], order)
    back = Window.partitionBy(run, "_chunk").orderBy(*(c.desc_nulls_last() for c in order)).rowsBetween(*_PAST)
    local = rows.withColumn("_no", F.row_number().over(line) - 1).withColumn("_cut", F.coalesce(F.col(time) - F.lag(time).over(line) > gap, F.lit(False)))
    place = F.when(F.col("_cut"), F.col("_no"))
    local = local.withColumn("_cuts", F.sum(F.col("_cut").cast("bigint")).over(line.rowsBetween(*_NOW))).withColumn("_at", F.max(place).over(line.rowsBetween(*_NOW)))
    if counted:
        local = local.withColumn("_end", F.min(place).over(back))
    per = local.groupBy(run, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.max("_cuts").alias("_c"), F.max("_at").alias("_tail"), F.min(place).alias("_head"))
    before = lambda c: F.coalesce(c.over(chunks.rowsBetween(*_PAST)), F.lit(0))
    per = per.withColumn("_new", F.coalesce(F.col("_t0") - F.lag("_t1").over(chunks) > gap, F.lit(False))).withColumn("_base", before(F.sum("_n")))
    edge = F.when(F.col("_new"), F.col("_base"))  # a segment begins with the chunk
    per = per.withColumn("_id", F.sum(F.col("_new").cast("bigint")).over(chunks.rowsBetween(*_NOW)) + before(F.sum("_c")))
    per = per.withColumn("_open", F.coalesce(F.col("_base") + F.col("_tail"), edge)).withColumn("_first", F.coalesce(edge, F.col("_base") + F.col("_head")))
    later = Window.partitionBy(run).orderBy(F.col("_chunk").desc()).rowsBetween(*_PAST)
    per = per.withColumn("_start", F.coalesce(edge, before(F.max("_open")))).withColumn("_stop", F.coalesce(F.min("_first").over(later), F.sum("_n").over(Window.partitionBy(run))))
    joined = local.join(per.select(run, "_chunk", "_base", "_id", "_start", "_stop"), [run, "_chunk"])
    start = F.coalesce(F.col("_base") + F.col("_at"), F.col("_start"))
    size = [(F.coalesce(F.col("_base") + F.col("_end"), F.col("_stop")) - start).alias("segment_rows")] if counted else []
    return joined.select(*samples.columns, (F.col("_id") + F.col("_cuts")).alias("segment_id"), (F.col("_base") + F.col("_no") - start).alias("row"), *size)


def with_steps(rows: DataFrame, keys: Sequence[str], time: str = "t", chunk_rows: int = CHUNK_ROWS, name: str = "_dt") -> DataFrame:
    """Adds each row's time less that of the row before it in its key; null for the first. Keys without nulls."""
    line, chunks = _lines(keys, [F.col(time)])
    local = with_chunks(rows, keys, time, chunk_rows).withColumn("_lag", F.lag(time).over(line))
    per = local.groupBy(*keys, "_chunk").agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    head = per.select(*keys, "_chunk", "_t0", F.lag("_t1").over(chunks).alias("_earlier")).where("_earlier is not null")
    joined = local.join(head, [*keys, "_chunk"], "left")
    first = F.col("_lag").isNull() & (F.col(time) == F.col("_t0"))
    return joined.withColumn(name, F.col(time) - F.coalesce("_lag", F.when(first, F.col("_earlier")))).drop("_chunk", "_lag", "_t0", "_earlier")


def _with_before(rows: DataFrame, keys: Sequence[str], label: str, position: str, chunk_rows: int) -> DataFrame:
    """rows in chunks with _before (the last known label before) and n_rows of the key."""
    line, chunks = _lines(keys, [F.col(position)])
    local = with_chunks(rows, keys, position, chunk_rows).withColumn("_before", F.last(label, ignorenulls=True).over(line.rowsBetween(*_PAST)))
    per = local.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.max_by(label, F.when(F.col(label).isNotNull(), F.col(position))).alias("_known"))
    per = per.select(*keys, "_chunk", F.last("_known", ignorenulls=True).over(chunks.rowsBetween(*_PAST)).alias("_earlier"), F.sum("_n").over(Window.partitionBy(*keys)).alias("n_rows"))
    return local.join(per, [*keys, "_chunk"]).withColumn("_before", F.coalesce("_before", "_earlier")).drop("_earlier")


def _changed(label: str) -> Column:
    return F.coalesce(F.col(label) != F.col("_before"), F.lit(False))


def true_transitions(rows: DataFrame, *, keys: Sequence[str] = ("run_id",), label: str = "label", position: str = "i", time: str = "t", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As `transitions.true_transitions`; keys without nulls, as rows join their chunk by them."""
    found = _with_before(rows, keys, label, position, chunk_rows).where(_changed(label))
    out = found.select(*keys, "_chunk", F.col(position).alias("transition_idx"), F.col("_before").alias("from_label"), F.col(label).alias("to_label"), F.col(time).alias("gt_time"), "n_rows")
    line, chunks = _lines(keys, [F.col("transition_idx")])
    per = out.groupBy(*keys, "_chunk").agg(F.min("transition_idx").alias("_i")).select(*keys, "_chunk", F.lead("_i").over(chunks).alias("_i"))
    out = out.withColumn("next_idx", F.lead("transition_idx").over(line)).join(per, [*keys, "_chunk"])
    return out.withColumn("next_idx", F.coalesce("next_idx", "_i", "n_rows")).drop("_chunk", "_i")


def prediction_islands(rows: DataFrame, *, keys: Sequence[str], label: str, pred: str, position: str, time: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As `transitions.prediction_islands`; islands that touch a chunk's end, two per chunk, are joined by key."""
    line, chunks = _lines(keys, [F.col(position)])
    marked = _with_before(rows, keys, label, position, chunk_rows).withColumn("_c", _changed(label))
    change = F.when(F.col("_c"), F.struct(F.col(position).alias("epoch"), F.col(label).alias("target")))
    marked = marked.withColumn("_no", F.row_number().over(line)).withColumn("_state", F.last(change, ignorenulls=True).over(line.rowsBetween(*_NOW)))
    per = marked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"), F.max_by("_state", "_no").alias("_left"))
    per = per.select(*keys, "_chunk", "_size", F.row_number().over(chunks).alias("_k"), F.last("_left", ignorenulls=True).over(chunks.rowsBetween(*_PAST)).alias("_entered"))
    marked = marked.join(per, [*keys, "_chunk"]).withColumn("_state", F.coalesce("_state", "_entered")).where("_state is not null")
    hit = F.coalesce(F.col(pred) == F.col("_state.target"), F.lit(False))
    marked = marked.withColumn("_hit", hit).withColumn("_island", F.sum((~F.col("_hit") | F.col("_c")).cast("bigint")).over(line.rowsBetween(*_NOW)))
    own = marked.where("_hit").groupBy(*keys, "_chunk", "_island").agg(
        F.first("_state.epoch").alias("epoch"), F.min(position).alias("start_idx"), F.min(time).alias("start_time"), F.count(F.lit(1)).alias("length"),
        F.first("_k").alias("_k"), F.bool_or((F.col("_no") == 1) & ~F.col("_c")).alias("_begins"), F.bool_or(F.col("_no") == F.col("_size")).alias("_ends"),
    )
    names = [*keys, "epoch", "start_idx", "start_time", "length"]
    at_edge = own.where("_begins or _ends")
    along = Window.partitionBy(*keys).orderBy("_k", "start_idx")
    goes_on = F.col("_begins") & F.lag("_ends").over(along) & (F.lag("_k").over(along) == F.col("_k") - 1) & (F.lag("epoch").over(along) == F.col("epoch"))
    at_edge = at_edge.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("bigint")).withColumn("_group", F.sum("_new").over(along.rowsBetween(*_NOW)))
    joined = at_edge.groupBy(*keys, "_group").agg(F.first("epoch").alias("epoch"), F.min("start_idx").alias("start_idx"), F.min("start_time").alias("start_time"), F.sum("length").alias("length"))
    return own.where("not (_begins or _ends)").select(*names).unionByName(joined.select(*names))


def align(samples: DataFrame, points: DataFrame, values: Sequence[str], how: str = "linear", *, keys: Sequence[str] = ("run_id",), time: str = "t", point: str = "i", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As `align.align`: samples and grid points are one line, cut into chunks; the last sample before a chunk and the
    first one after it come from the summaries of the others."""
    if how not in ("backward", "forward", "nearest", "linear"):
        raise ValueError(f"unknown method: {how}")
    own = F.struct(F.col(time).alias("t"), *values)
    known = samples.select(*keys, F.col(time).alias("_t"), F.lit(None).cast("bigint").alias(point), own.alias("_own"))
    asked = points.select(*keys, F.col(time).alias("_t"), F.col(point).cast("bigint").alias(point), F.lit(None).cast(known.schema["_own"].dataType).alias("_own"))
    both = with_chunks(known.unionByName(asked), keys, "_t", chunk_rows)
    # a sample sorts before a grid point of the same time
    line, chunks = _lines(keys, [F.col("_t"), F.col(point).asc_nulls_first()])
    back = Window.partitionBy(*keys, "_chunk").orderBy(F.col("_t").desc_nulls_last(), F.col(point).desc_nulls_last())
    local = both.withColumn("_a", F.last("_own", ignorenulls=True).over(line.rowsBetween(*_NOW))).withColumn("_b", F.last("_own", ignorenulls=True).over(back.rowsBetween(*_PAST)))
    there = F.when(F.col("_own").isNotNull(), F.col("_t"))
    per = both.groupBy(*keys, "_chunk").agg(F.max_by("_own", there).alias("_last"), F.min_by("_own", there).alias("_head"))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(*_PAST)
    per = per.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(chunks.rowsBetween(*_PAST)).alias("_a0"), F.last("_head", ignorenulls=True).over(later).alias("_b0"))
    found = local.where(F.col(point).isNotNull()).join(per, [*keys, "_chunk"]).withColumn("_a", F.coalesce("_a", "_a0")).withColumn("_b", F.coalesce("_b", "_b0"))
    found = found.withColumn("_lo", F.coalesce("_a", "_b")).withColumn("_hi", F.coalesce("_b", "_a")).where("_lo is not null")
    t, at, to = F.col("_t"), F.col("_lo.t"), F.col("_hi.t")
    first = {"backward": F.lit(True), "forward": at >= t, "nearest": (at >= t) | (t - at <= to - t) | (to <= t), "linear": to <= at}[how]
    out = []
    for v in values:
        lo, hi = F.col(f"_lo.{v}"), F.col(f"_hi.{v}")
        out.append(F.when(first, lo).otherwise(lo + (hi - lo) / (to - at) * (t - at) if how == "linear" else hi).alias(v))
    return found.select(*keys, point, t.alias(time), *out)


def merge_sensors(samples: DataFrame, points: DataFrame, names: Sequence[str], *, run: str = "run_id", sensor: str = "sensor", time: str = "t", value: str = "v", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As `align.merge_sensors`, on grid points that `align.grid` gives."""
    asked = points.withColumn(sensor, F.explode(F.array(*map(F.lit, names))))
    long = align(samples.where(F.col(sensor).isin(*names)), asked, [value], "linear", keys=(run, sensor), time=time, chunk_rows=chunk_rows)
    return long.groupBy(run, "i", time).pivot(sensor, list(names)).agg(F.first(value)).select(run, "i", time, *names)
