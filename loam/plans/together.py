"""Logistic regression of many folds, feature sets and settings at once: each step is one pass over the table for all.

Spark sums losses and slopes; the driver keeps what a model is, its coefficients and the last few slopes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.channels import finite
from loam.shared import stored

#: Coefficients of all models that are fitted in one pass: 2 MB from each task, further models take further passes.
PASS = 1 << 18
#: Tasks' sums that are added up at a time.
FAN = 64
#: Scores (rows x models x classes) that a task holds at a time.
SCORES = 1 << 20
_NEVER = -1e30


@dataclass(frozen=True)
class Case:
    """A model to fit: on all rows but those of the run `held`, from these features."""

    held: object
    features: tuple[str, ...]
    params: dict = field(default_factory=dict)


class _Descent:
    """L-BFGS for one model, whose objective is computed elsewhere: `trial` is where it wants to know value and slope."""

    def __init__(self, size: int, tol: float, kept: int = 10):
        self.trial, self.tol, self.done = np.zeros(size), tol, False
        self.at = self.value = self.slope = None
        self.pairs: deque = deque(maxlen=kept)

    def tell(self, value: float, slope: np.ndarray) -> None:
        if self.at is not None:
            if not value <= self.value + 1e-4 * self.step * self.fall:
                self._shorter(value)
                return
            s, y = self.trial - self.at, slope - self.slope
            if s @ y > 1e-10 * (y @ y):
                self.pairs.append((s, y, 1 / (s @ y)))
        self.at, self.value, self.slope = self.trial, value, slope
        if np.abs(slope).max(initial=0.0) <= self.tol:
            self.done = True
            return
        self.way = self._direction()
        self.fall = self.way @ slope
        self.step = 1.0 if self.pairs else min(1.0, 1 / np.sqrt(slope @ slope))
        self.trial = self.at + self.step * self.way

    def _shorter(self, value: float) -> None:
        """The least point of the parabola through what is known, but no more than a tenth and no less than a half."""
        best = -self.fall * self.step**2 / (2 * (value - self.value - self.fall * self.step))
        self.step = min(max(best, 0.1 * self.step), 0.5 * self.step) if np.isfinite(best) else 0.1 * self.step
        if self.step < 1e-10:  # no digits are left to gain
            self.done = True
            return
        self.trial = self.at + self.step * self.way

    def _direction(self) -> np.ndarray:
        q, shares = self.slope.copy(), []
        for s, y, r in reversed(self.pairs):
            shares.append(r * (s @ q))
            q -= shares[-1] * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(shares), strict=True):
            q += (a - r * (y @ q)) * s
        return -q


def moments(table: DataFrame, features: Sequence[str], by: Sequence[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows, means and population variances of the features per group: a row per run and class for the driver."""
    found = table.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array(*map(F.avg, features)).alias("_m"), F.array(*map(F.var_pop, features)).alias("_v")).collect()
    shape = (len(found), len(features))
    return [tuple(r[b] for b in by) for r in found], np.array([float(r["_n"]) for r in found]), np.array([r["_m"] for r in found]).reshape(shape), np.array([r["_v"] for r in found]).reshape(shape)


def pooled(n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squares about it, of groups that weigh n each."""
    centre = n @ mean / max(n.sum(), 1e-300)
    return centre, n @ (var + (mean - centre) ** 2)


def spread(rows: DataFrame, n: int, per_task: int) -> DataFrame:
    """rows dealt to tasks of some per_task of the n units of work that they make: a table of one file may be read by one."""
    return rows.repartition(-(-n // per_task)) if n > per_task else rows


def _matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(table: DataFrame, width: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, held: np.ndarray, centre: np.ndarray, scale: np.ndarray, n_tasks: int) -> np.ndarray:
    """Over all rows, for models with coefficients a (model, feature, class) and b (model, class): their weighted losses,
    slopes by b and slopes by a, one after another. Tasks' sums are added up by Spark, FAN at a time, until FAN are left."""
    m, _, k = a.shape
    flat = np.ascontiguousarray(a.transpose(1, 0, 2)).reshape(width, m * k)
    most = max(1, SCORES // (m * k))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        loss, by_b, by_a = np.zeros(m), np.zeros((m, k)), np.zeros((width, m * k))
        for batch in batches:
            x = (_matrix(batch.column(2), width) - centre) / scale
            runs, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(x), most):
                part, y, r = x[at : at + most], labels[at : at + most], runs[at : at + most]
                score = (part @ flat).reshape(-1, m, k) + b
                score -= score.max(axis=2, keepdims=True)
                w = weight[:, y].T * (r[:, None] != held)
                own = np.take_along_axis(score, y[:, None, None], 2)[:, :, 0]
                np.exp(score, out=score)
                total = score.sum(axis=2)
                loss += (w * (np.log(total) - own)).sum(axis=0)
                score *= (w / total)[:, :, None]
                score[np.arange(len(y)), :, y] -= w
                by_b += score.sum(axis=0)
                by_a += part.T @ score.reshape(len(y), m * k)
        out = np.concatenate([loss, by_b.ravel(), by_a.ravel()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": [out.tobytes()]})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in rows["sums"])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = table.mapInArrow(one, "part bigint, sums binary")
    while n_tasks > FAN:
        rows = rows.select(F.floor(F.col("part") / FAN).alias("part"), "sums").groupBy("part").applyInArrow(add, "part bigint, sums binary")
        n_tasks = -(-n_tasks // FAN)
    return sum(np.frombuffer(r.sums) for r in sorted(rows.collect(), key=lambda r: r.part))


class Models:
    """Fitted models: coefficients (model, feature, class) on features less `centre` over `scale`, and their constants."""

    def __init__(self, features: list[str], classes: list, a: np.ndarray, b: np.ndarray, centre: np.ndarray, scale: np.ndarray):
        self.features, self.classes, self.a, self.b, self.centre, self.scale = features, classes, a, b, centre, scale

    def predict(self, rows: DataFrame, case: str) -> DataFrame:
        """rows, whose column `case` numbers their model, with proba in the order of all classes (0 for those that the
        model never saw) and pred, in one pass. Features that are null, NaN or infinite count as 0; columns of rows that
        are called proba or pred give way."""
        a, b, centre, scale, width = self.a, self.b, self.centre, self.scale, len(self.features)
        kept = [c for c in rows.columns if c.lower() not in ("proba", "pred")]
        names = [f"_c{i}" for i in range(len(kept))]
        x = F.array(*(F.col(f).cast("double") for f in self.features)).alias("_x")
        taken = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col(case).cast("int").alias("_case"), x)
        out = T.StructType([*taken.schema.fields[:-2], T.StructField("_p", T.ArrayType(T.DoubleType())), T.StructField("_k", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which = batch.column(len(names)).to_numpy()
                part = _matrix(batch.column(len(names) + 1), width)
                part = (np.where(np.isfinite(part), part, 0.0) - centre) / scale
                p = np.zeros((len(which), b.shape[1]))
                for m in np.unique(which):
                    own = np.flatnonzero(which == m)
                    p[own] = part[own] @ a[m] + b[m]
                p = np.exp(p - p.max(axis=1, keepdims=True, initial=_NEVER))
                p /= p.sum(axis=1, keepdims=True)
                offsets = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
                best = p.argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, pa.array(p.ravel())), pa.array(best)], names=out.names)

        done = taken.mapInArrow(run, out)
        pred = F.get(F.array(*map(F.lit, self.classes)), F.col("_k"))
        return done.select(*(F.col(n).alias(c) for n, c in zip(names, kept, strict=True)), F.col("_p").alias("proba"), pred.alias("pred"))

    def _classes_of(self, rows: DataFrame, case: str, kept: Sequence[str], extra: str, n: int, score) -> DataFrame:
        """kept and `place` (0..n - 1), _pred, _n: how often the n cases of score(x, mask, extra's column, model) have each class."""
        a, b, centre, scale, width = self.a, self.b, self.centre, self.scale, len(self.features)
        names = [f"_c{i}" for i in range(len(kept))]
        x = F.array(*(F.col(f).cast("double") for f in self.features)).alias("_x")
        taken = rows.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(kept, names, strict=True)), F.col(case).cast("int").alias("_case"), x, F.col(extra).alias("_extra"))
        out = T.StructType([*taken.schema.fields[: len(names)], T.StructField("_k", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which, found = batch.column(len(names)).to_numpy(), np.zeros((batch.num_rows, n), np.int32)
                x = _matrix(batch.column(len(names) + 1), width)
                mask = np.isfinite(x)
                x = np.where(mask, x, 0.0)
                for m in np.unique(which):
                    mine = np.flatnonzero(which == m)
                    base = ((x[mine] - centre) / scale) @ a[m] + b[m]
                    score(base, x[mine], mask[mine], batch.column(len(names) + 2).take(pa.array(mine)), a[m], found, mine)
                offsets = pa.array(np.arange(len(found) + 1) * n, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=out.names)

        each = taken.mapInArrow(run, out).select(*names, F.posexplode("_k").alias("place", "_k"))
        cells = each.groupBy(*names, "place", "_k").agg(F.count(F.lit(1)).alias("_n"))
        pred = F.get(F.array(*map(F.lit, self.classes)), F.col("_k")).alias("pred")
        return cells.select(*(F.col(o).alias(c) for c, o in zip(kept, names, strict=True)), "place", pred, "_n")

    def predict_along(self, rows: DataFrame, case: str, move: str, factors: Sequence[float], kept: Sequence[str]) -> DataFrame:
        """How many rows of each `kept` are predicted as what, with `move` (an array in the order of `features`) added to the
        features once for each factor (`place`): kept, place, pred, _n. A step is a multiple of a row's scores, so that
        all factors need its features once."""
        scale, width = self.scale, len(self.features)
        order = [float(f) for f in factors]

        def score(base: np.ndarray, x: np.ndarray, mask: np.ndarray, move: pa.Array, a: np.ndarray, found: np.ndarray, mine: np.ndarray) -> None:
            step = (np.where(mask, _matrix(move, width), 0.0) / scale) @ a
            for j, f in enumerate(order):
                found[mine, j] = (base + f * step).argmax(axis=1)

        return self._classes_of(rows, case, kept, move, len(order), score)

    def predict_swapped(self, rows: DataFrame, case: str, new: str, repeats: int, kept: Sequence[str]) -> DataFrame:
        """As `predict_along`, with a single feature's value changed: `new` has structs of place (feature x repeats + repeat)
        and value, one for each place. The last place is the row as it is."""
        scale, width = self.scale, len(self.features)

        def score(base: np.ndarray, x: np.ndarray, mask: np.ndarray, new: pa.Array, a: np.ndarray, found: np.ndarray, mine: np.ndarray) -> None:
            places, values = (c.to_numpy(zero_copy_only=False) for c in new.flatten().flatten())
            dealt = np.empty((len(mine), width * repeats))
            dealt[np.repeat(np.arange(len(mine)), width * repeats), places] = values
            dealt = np.where(np.isfinite(dealt), dealt, 0.0).reshape(len(mine), width, repeats)
            for f in range(width):
                step = (dealt[:, f] - x[:, f : f + 1]) / scale[f]
                found[mine, f * repeats : (f + 1) * repeats] = (base[:, None] + step[:, :, None] * a[f]).argmax(axis=2)
            found[mine, -1] = base.argmax(axis=1)

        return self._classes_of(rows, case, kept, new, width * repeats + 1, score)


def fit(table: DataFrame, cases: Sequence[Case], *, run: str = "run_id", label: str = "label", balanced: bool = True, most_steps: int = 200, tol: float = 1e-6) -> Models:
    """All cases' models: multinomial logistic regression on features over their deviation in the case's weighted
    training rows, with an L2 penalty (params: regParam, 1e-3), by what pyspark.ml minimises (for two classes too).

    The table is written once; a pass over it per step gives the slopes of all models that are not done (no entry of the
    slope above tol), whatever run they leave out. Rows without a run or a label are left out; null, NaN or infinite
    features count as 0; a feature that is constant in training has no coefficient; a model never sees what its held run
    alone has: such classes get probability 0. A table without rows for some case is an error.
    """
    features = sorted({f for c in cases for f in c.features})
    width = len(features)
    clean = finite(table.where(F.col(run).isNotNull() & F.col(label).isNotNull()).select(run, label, *(F.col(f).cast("double").alias(f) for f in features)), features)
    keys, n, mean, var = moments(clean, features, [run, label])
    runs, classes = sorted({k[0] for k in keys}), sorted({k[1] for k in keys})
    if not keys:
        raise ValueError("no rows to fit on")
    spark = table.sparkSession
    run_of, class_of = ({v: i for i, v in enumerate(x)} for x in (runs, classes))
    small = spark.createDataFrame([(*k, run_of[k[0]], class_of[k[1]]) for k in keys], T.StructType([clean.schema[run], clean.schema[label], T.StructField("_run", T.IntegerType()), T.StructField("_label", T.IntegerType())]))
    rows = clean.join(F.broadcast(small), [run, label]).select("_run", "_label", F.array(*features).alias("_x"))  # a row per run and class
    rows = stored(spread(rows, int(n.sum()), 8192), "folds")
    n_tasks = rows.rdd.getNumPartitions()
    group_run, group_class = np.array([run_of[k[0]] for k in keys]), np.array([class_of[k[1]] for k in keys])
    centre, squares = pooled(n, mean, var)
    scale = np.sqrt(squares / n.sum())
    scale[scale == 0] = 1.0
    m, k = len(cases), len(classes)
    held = np.array([run_of.get(c.held, -1) for c in cases])
    weight, mu, inverse, reg, total = np.zeros((m, k)), np.zeros((m, width)), np.zeros((m, width)), np.zeros(m), np.zeros(m)
    for i, case in enumerate(cases):
        trained = np.where(group_run != held[i], n, 0.0)
        per = np.bincount(group_class, trained, k)
        if not per.sum():
            raise ValueError(f"no rows to train on without {case.held!r}")
        seen = per > 0
        weight[i, seen] = per.sum() / (seen.sum() * per[seen]) if balanced else 1.0
        share = trained * weight[i, group_class]
        total[i] = share.sum()
        mu[i], squares = pooled(share, mean, var)
        free = total[i] - (trained * weight[i, group_class] ** 2).sum() / total[i]
        std = np.sqrt(squares / free) if free > 0 else np.zeros(width)
        use = np.isin(features, case.features) & (std > 1e-12 * np.maximum(1.0, np.abs(mu[i])))
        inverse[i, use] = 1 / std[use]
        reg[i] = case.params.get("regParam", 1e-3) * (2 if seen.sum() == 2 else 1)
    shift = (centre - mu) * inverse  # what is taken out before, in each model's own units
    gain = scale * inverse
    never = np.where(weight > 0, 0.0, _NEVER)
    descents = [_Descent((width + 1) * k, tol) for _ in cases]

    def own(x: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A model's coefficients in its own units, and a and b in the table's."""
        x = x.reshape(width + 1, k)
        return x[:-1], x[:-1] * gain[i][:, None], x[-1] + shift[i] @ x[:-1] + never[i]

    at_once = max(1, PASS // ((width + 1) * k))
    for begin in range(0, m, at_once):
        mine = range(begin, min(m, begin + at_once))
        for _ in range(most_steps):
            live = [i for i in mine if not descents[i].done]
            if not live:
                break
            coefficients, a, b = (np.stack(v) for v in zip(*(own(descents[i].trial, i) for i in live), strict=True))
            found = _sums(rows, width, a, b, weight[live], held[live], centre, scale, n_tasks)
            loss, by_b, by_a = np.split(found, np.cumsum([len(live), len(live) * k]))
            by_b, by_a = by_b.reshape(-1, k), by_a.reshape(width, len(live), k)
            for j, i in enumerate(live):
                slope = (by_a[:, j] * gain[i][:, None] + np.outer(shift[i], by_b[j])) / total[i] + reg[i] * coefficients[j]
                value = loss[j] / total[i] + 0.5 * reg[i] * (coefficients[j] ** 2).sum()
                descents[i].tell(value, np.vstack([slope, by_b[j : j + 1] / total[i]]).ravel())
    a, b = (np.stack(v) for v in zip(*(own(d.at, i)[1:] for i, d in enumerate(descents)), strict=True))
    return Models(features, classes, a, b, centre, scale)
