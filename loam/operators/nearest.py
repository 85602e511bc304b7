"""Mutual information of numbers and classes by nearest neighbours, for columns longer than a task (Ross 2014)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.long_runs import CHUNK_ROWS, with_chunks


def psi(n: np.ndarray) -> np.ndarray:
    """The digamma function of whole numbers above 0: sums of fractions up to 4096, the series beyond."""
    n = np.asarray(n, dtype=np.int64)
    sums = np.r_[0.0, np.cumsum(1 / np.arange(1, 4097))]
    x = np.maximum(n, 4097).astype(float)
    return np.where(n <= 4096, sums[np.minimum(n, 4097) - 1] - np.euler_gamma, np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    i = (x + 0.0).view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


def _doubles(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, np.int64(-(2**63)) - i, i).view(np.float64)


def farthest(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The greatest double whose difference to x, as it is rounded, is at most radius: bisection over all doubles."""
    low, high = _ordered(x), np.full(len(x), _ordered(np.array([np.finfo(float).max]))[0])
    while (low < high).any():
        mid = (low >> 1) + (high >> 1) + (low & high & 1)
        mid = np.where(mid == low, mid + (low < high), mid)
        with np.errstate(over="ignore"):
            near = _doubles(mid) - x <= radius
        low, high = np.where(near, mid, low), np.where(near, high, np.maximum(mid - 1, low))
    return _doubles(low)


def reach(v: np.ndarray, before: np.ndarray, after: np.ndarray, near: int) -> np.ndarray:
    """The distance of each sorted value to its near-th neighbour, given as many values in front and behind, or all."""
    lack = lambda x: np.full(near - len(x), np.inf)
    line = np.concatenate([-lack(before), before, v, after, lack(after)])
    m = len(v)
    return np.min([np.maximum(v - line[near - j : near - j + m], line[2 * near - j : 2 * near - j + m] - v) for j in range(near + 1)], axis=0)


def mi_knn(table: DataFrame, features: Sequence[str], *, label: str = "label", k: int = 5, keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """keys, feature, mi (nats): as `selection.knn_information` of each column, without a column in one task.

    A column is cut into chunks at quantiles of its values, equal values in one. A chunk takes the k last values of each
    class from the chunks before it and the k first from those behind, so it knows every radius; how many values lie
    within a radius is its end's rank, which the chunk knows itself, or the chunk's bounds tell, or which is asked of the
    chunk where the end lies. NaN, infinities and nulls of features count as 0, a null label is a class; classes of one
    are left out; an empty column, or one with single classes only, has 0; no rows give no features."""
    from loam.operators.selection import melt

    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")) | F.col("value").isNull(), 0.0).otherwise(F.col("value") + 0.0)
    long = melt(table.withColumn("_class", F.coalesce(F.col(label).cast("string"), F.lit("None"))), [*keys, "_class"], features).withColumn("value", value)
    column = [*keys, "feature"]
    sizes = long.groupBy(*column, "_class").agg(F.count(F.lit(1)).alias("_size"))
    rows = with_chunks(long, column, "value", chunk_rows)
    chunk = [*column, "_chunk"]
    fields = ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in column) + ", _chunk int"

    def first(t: pa.Table, n: int = 1) -> dict:
        return {c: t[c].slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in chunk}

    def ends(t: pa.Table) -> pa.Table:
        x, c = t["value"].to_numpy(), t["_class"].to_numpy()
        order = np.lexsort((x, c))
        x, c = x[order], c[order]
        cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        parts = [x[a:b] for a, b in zip(cut, np.r_[cut[1:], len(x)], strict=True)]
        own = {"_class": c[cut].tolist(), "n": [len(p) for p in parts], "low": [p[0] for p in parts], "high": [p[-1] for p in parts], "head": [p[:k].tolist() for p in parts], "tail": [p[-k:].tolist() for p in parts]}
        return pa.table(first(t, len(parts)) | own)

    per = rows.select(*chunk, "_class", "value").groupBy(*chunk).applyInArrow(ends, fields + ", _class string, n bigint, low double, high double, head array<double>, tail array<double>")
    per = per.join(sizes, [*column, "_class"]).where("_size > 1")
    line = Window.partitionBy(*column, "_class").orderBy("_chunk")
    before = F.slice(F.reverse(F.flatten(F.collect_list("tail").over(line.rowsBetween(-k, -1)))), 1, k)
    after = F.slice(F.flatten(F.collect_list("head").over(line.rowsBetween(1, k))), 1, k)
    per = per.withColumn("before", F.reverse(before)).withColumn("after", after)
    bounds = per.groupBy(*chunk).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).groupBy(*column).agg(F.array_sort(F.collect_list(F.struct("low", "high", "_chunk", "n"))).alias("bounds"))  # a row per chunk
    halo = per.groupBy(*chunk).agg(F.collect_list(F.struct("_class", "_size", "before", "after")).alias("classes")).join(bounds, column)

    def ranks(y: np.ndarray, x: np.ndarray, own: int, bounds: list, side: str) -> tuple[np.ndarray, np.ndarray]:
        """How many values of the column are less than y (side left) or at most y, -1 where a chunk has to be asked, and
        the place of the chunk where y lies."""
        low, high = (np.array([b[c] for b in bounds]) for c in ("low", "high"))
        base = np.r_[0, np.cumsum([b["n"] for b in bounds])]
        at = np.searchsorted(low, y, side=side) - 1
        whole = (at < 0) | (y > high[at]) | ((y >= high[at]) & (side == "right"))
        mine = at == own
        return np.where(whole, base[at + 1], np.where(mine, base[own] + np.searchsorted(x, y, side=side), -1)), at

    def near(data: pa.Table, halo: pa.Table) -> pa.Table:
        empty = {"k_sum": 0.0, "n": 0, "chunk_to": None, "y": None, "side": None, "id": None, "known": None}
        if not data.num_rows or not halo.num_rows:  # classes of one alone
            return pa.table({**first(data if data.num_rows else halo), **{c: [v] for c, v in empty.items()}}, schema=answer)
        classes, bounds = {c["_class"]: c for c in halo["classes"][0].as_py()}, halo["bounds"][0].as_py()
        x, c = data["value"].to_numpy(), data["_class"].to_numpy()
        keep = np.isin(c, list(classes))
        order = np.argsort(x[keep], kind="stable")
        x, c = x[keep][order], c[keep][order]
        own = next(i for i, b in enumerate(bounds) if b["_chunk"] == data["_chunk"][0].as_py())
        radius, total = np.empty(len(x)), 0.0
        for name, info in classes.items():
            at = np.flatnonzero(c == name)
            m = min(k, info["_size"] - 1)
            radius[at] = np.nextafter(reach(x[at], np.array(info["before"][-m:], float), np.array(info["after"][:m], float), m), 0)
            total += len(at) * float(psi(np.array([m]))[0] - psi(np.array([info["_size"]]))[0])
        top, bottom = farthest(x, radius), -farthest(-x, radius)
        (right, to), (left, since) = ranks(top, x, own, bounds, "right"), ranks(bottom, x, own, bounds, "left")
        done = (right >= 0) & (left >= 0)
        total -= float(psi(right[done] - left[done]).sum())
        open_ = np.flatnonzero(~done)
        number = np.array([b["_chunk"] for b in bounds])
        out = {"k_sum": [total], "n": [len(x)], "chunk_to": [None], "y": [None], "side": [None], "id": [None], "known": [None]}
        for side, rank, y, place in (("right", right, top, to), ("left", left, bottom, since)):
            ask = rank[open_] < 0
            out["k_sum"] += [None] * len(open_)
            out["n"] += [None] * len(open_)
            out["chunk_to"] += [int(number[p]) if a else None for p, a in zip(place[open_], ask, strict=True)]
            out["y"] += y[open_].tolist()
            out["side"] += [side] * len(open_)
            out["id"] += open_.tolist()
            out["known"] += [None if a else int(r) for r, a in zip(rank[open_], ask, strict=True)]
        return pa.table({**first(data, len(out["n"])), **out}, schema=answer)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = fields + ", k_sum double, n bigint, chunk_to int, y double, side string, id bigint, known bigint"
    answer = to_arrow_schema(table.sparkSession.createDataFrame([], kind).schema)
    base = Window.partitionBy(*column).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.select(*chunk, "_class", "value").groupBy(*chunk).cogroup(halo.groupBy(*chunk)).applyInArrow(near, kind)
    sums = found.where("side is null").groupBy(*column).agg(F.sum("k_sum").alias("s"), F.sum("n").alias("n"))
    open_ = found.where("side is not null")
    asked = open_.where("chunk_to is not null").select(*column, F.col("chunk_to").alias("_chunk"), "y", "side", F.col("_chunk").alias("chunk_of"), "id")

    def answered(data: pa.Table, asked: pa.Table) -> pa.Table:
        y, side = asked["y"].to_numpy(), asked["side"].to_numpy()
        x = np.sort(data["value"].to_numpy())
        n = np.where(side == "right", np.searchsorted(x, y, side="right"), np.searchsorted(x, y, side="left"))
        return pa.table({**{c: asked[c] for c in chunk}, "chunk_of": asked["chunk_of"], "id": asked["id"], "side": asked["side"], "n": pa.array(n, pa.int64())})

    counted = rows.join(sizes.where("_size > 1"), [*column, "_class"], "left_semi")
    told = counted.select(*chunk, "value").groupBy(*chunk).cogroup(asked.groupBy(*chunk)).applyInArrow(answered, fields + ", chunk_of int, id bigint, side string, n bigint")
    starts = per.groupBy(*chunk).agg(F.sum("n").alias("_n")).select(*chunk, F.coalesce(F.sum("_n").over(base), F.lit(0)).alias("_base"))
    told = told.join(starts, chunk).select(*column, F.col("chunk_of").alias("_chunk"), "id", "side", (F.col("n") + F.col("_base")).alias("rank"))
    known = open_.where("known is not null").select(*column, "_chunk", "id", "side", F.col("known").alias("rank"))
    within = told.unionByName(known).groupBy(*chunk, "id").agg(F.sum(F.when(F.col("side") == "right", F.col("rank")).otherwise(-F.col("rank"))).alias("m"))
    digamma = F.pandas_udf(lambda n: pd.Series(psi(n.to_numpy())), "double")
    more = within.groupBy(*column).agg(F.sum(digamma("m")).alias("more"))
    out = sums.join(more, column, "left")
    mi = F.greatest(F.lit(0.0), digamma(F.greatest("n", F.lit(1))) + (F.col("s") - F.coalesce("more", F.lit(0.0))) / F.col("n"))
    return out.select(*column, F.when(F.col("n") > 0, mi).otherwise(0.0).alias("mi"))
