"""A quality classifier learned from trusted positives and unlabelled texts (non-negative PU learning)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import as_binary, saved

N_FEATURES = 24
_CLASSES = [b"#*$%&|<>", b".,;:?", b"!", b"'\"()[]{}", b"/\\@_=+-~^`", b" ", b"\n\r", b"\t\x0b\x0c", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256))]
_GROUP = np.zeros((len(_CLASSES), 256), dtype=np.float64)
for _i, _c in enumerate(_CLASSES):
    _GROUP[_i, list(_c)] = 1.0


def features(text: bytes, packer: zstandard.ZstdCompressor) -> np.ndarray:
    """Numbers about a whole text: shares of byte classes, entropy, words, repeats, lines, how well it packs.

    An empty text has all zeros but its length.
    """
    out = np.zeros(N_FEATURES, dtype=np.float32)
    n = len(text)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(np.float64)
    out[: len(_CLASSES)] = _GROUP @ counts / n
    share = counts[counts > 0] / n
    out[12] = -(share * np.log2(share)).sum() / 8
    words = text.split()
    k = max(len(words), 1)
    distinct = set(words)
    out[13] = np.log1p(len(words)) / 10
    out[14] = min(n / k, 50.0) / 10
    out[15] = len(distinct) / k
    out[16] = len(set(zip(words, words[1:]))) / max(k - 1, 1)
    out[17] = len({w.lower() for w in distinct}) / max(len(distinct), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[18] = 1 - len(set(lines)) / max(len(lines), 1)
    out[19] = np.log1p(n / max(len(lines), 1)) / 10
    out[20] = min(len(packer.compress(text)) / n, 1.5)
    out[21] = sum(w[:1].isupper() for w in words[:]) / k
    out[22] = sum(1 for w in distinct if len(w) > 25) / max(len(distinct), 1)
    out[23] = np.log1p(n) / 10
    return out


def document_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and its feature vector, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            column = as_binary(batch.column(1))
            x = np.stack([features(column[i].as_py() or b"", packer) for i in range(batch.num_rows)]) if batch.num_rows else np.zeros((0, N_FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.ravel()))], names=["id", "x"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.FloatType()))])
    return docs.select(id_col, text_col).mapInArrow(run, kind)


@dataclass(frozen=True)
class PUModel:
    """A network of one hidden layer; prior is the estimated share of positives among the unlabelled."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


#: Without any trusted positive nothing can be learned: every text scores 0.5 and is kept.
NO_MODEL = PUModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)


def risk(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, float]:
    """The two terms of the risk of a network w = [w1, b1, w2, b2] on positives p and unlabelled u: prior x E_p[l(f)]
    and E_u[l(-f)] - prior x E_p[l(-f)], with l(z) = ln(1 + e^-z); without a prior, E_p[l(f)] and E_u[l(-f)]."""
    zp, zu = (np.tanh(x @ w[0] + w[1]) @ w[2] + w[3] for x in (p, u))
    if prior is None:
        return float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean())
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def slopes(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """The step's direction: the gradient of both terms of the risk, or, where the second is negative, against its own."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def grad(x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dz, w[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    hp, hu = np.tanh(p @ w[0] + w[1]), np.tanh(u @ w[0] + w[1])
    zp, zu = hp @ w[2] + w[3], hu @ w[2] + w[3]
    up, down_u = grad(p, hp, -sig(-zp) / len(zp)), grad(u, hu, sig(zu) / len(zu))
    if prior is None:
        return [a + b for a, b in zip(up, down_u, strict=True)]
    second = [a - prior * b for a, b in zip(down_u, grad(p, hp, sig(zp) / len(zp)), strict=True)]
    if risk(w, p, u, prior)[1] < 0:
        return [-a for a in second]
    return [prior * a + b for a, b in zip(up, second, strict=True)]


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int = 16, steps: int = 600, rate: float = 0.02, seed: int = 11) -> PUModel:
    """Adam on the logistic loss. With a prior the risk is the non-negative one: prior E_p[l(f)] + max(0, E_u[l(-f)] -
    prior E_p[l(-f)]), stepping against the second term where it is negative; without, positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    w = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    batch = 2048
    for step in range(1, steps + 1):
        g = slopes(w, *(x if len(x) <= batch else x[rng.integers(0, len(x), batch)] for x in (p, u)), prior)
        for i, a in enumerate(g):
            a = a + 1e-4 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * a, 0.999 * v[i] + 0.001 * a * a
            w[i] = w[i] - rate * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return PUModel(mean, scale, w[0], w[1], w[2], float(w[3][0]), 1.0 if prior is None else prior)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, slack: float = 0.05) -> float:
    """The share of positives among the unlabelled: the least ratio of tail masses P_u(g >= t) / P_p(g >= t) over
    thresholds t, with a deviation bound on each (best bin estimation). Scores come from a first classifier of
    positives against unlabelled; at a high enough threshold nothing but positives is left, and the ratio is the prior."""
    p, u = np.sort(pos), np.sort(unl)
    t = np.quantile(p, np.linspace(0, 0.9, 91))
    qp = 1 - np.searchsorted(p, t) / len(p)
    qu = 1 - np.searchsorted(u, t) / len(u)
    dev = np.sqrt(np.log(4 / slack) / 2 / len(u)) + np.sqrt(np.log(4 / slack) / 2 / len(p))
    best = int(np.argmin((qu + dev) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.95))


def learns(id_col: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 != 1


def fit_quality(found: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_positives: int = 20_000, max_unlabelled: int = 20_000) -> PUModel:
    """Learn from features (`found`: id, x) and labels.

    Trusted positives are rows with label 1 in the learning fold; the unlabelled are rows of that fold, whatever
    their label. At most max_positives and max_unlabelled rows, the first by a hash of the id, are fetched to fit the
    network: the bound of what the driver holds (100 bytes each). The held-out part of the positives (each fourth)
    serves to estimate the class prior. Null ids have no label. Repeated label rows count once.
    """
    fold = found.where(learns(F.col("id")))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()

    def first(df: DataFrame, n: int) -> DataFrame:
        # a share of the hashes that holds the first n for sure, so that what one task sorts does not grow with the corpus
        share = (n + 10 * n**0.5 + 100) / max(df.count(), 1)
        ranked = df.withColumn("_h", F.xxhash64("id", "x"))
        if share < 1:
            ranked = ranked.where(F.col("_h") < int((2 * share - 1) * (1 << 63)))
        return ranked.orderBy("_h", "id").limit(n)

    both = first(fold.join(good, "id", "left_semi"), max_positives).select(F.lit(1).alias("s"), "x").unionByName(first(fold, max_unlabelled).select(F.lit(0).alias("s"), "x"))
    table = both.toArrow()
    if not table.num_rows:
        return NO_MODEL
    x = np.asarray(pc.list_flatten(table["x"])).astype(np.float64).reshape(-1, N_FEATURES)
    s = np.asarray(table["s"])
    order = np.lexsort([*x.T, s])  # whatever order the rows came in
    x, s = x[order], s[order]
    pos, unl = x[s == 1], x[s == 0]
    if not len(pos):
        return NO_MODEL
    held = np.arange(len(pos)) % 4 == 3
    if len(pos) < 8:
        held[:] = False
    first_model = _fit(pos[~held], unl, None)
    prior = estimate_prior(first_model.logit(pos[held] if held.any() else pos), first_model.logit(unl))
    return _fit(pos, unl, prior)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted.

    The score depends on the text alone. Null and empty texts are scored by their (zero) features; null ids stay null
    and count as the id ''; repeated rows give repeated rows; other columns are ignored; empty gives empty.
    """
    found = saved(document_features(docs, id_col, text_col))  # numbers only: 100 bytes a row
    model = fit_quality(found, labels, id_col=id_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(pc.list_flatten(batch.column(1))).astype(np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scored = found.mapInArrow(run, kind)
    return scored.select(F.col("id").alias(id_col), (~learns(F.col("id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that the classifier scores at the threshold or above, all columns kept, no shuffle of texts."""
    model = fit_quality(saved(document_features(docs, id_col, text_col)), labels, id_col=id_col, **options)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if batch.num_rows:
                column = as_binary(batch.column(at))
                x = np.stack([features(column[i].as_py() or b"", packer) for i in range(batch.num_rows)]).astype(np.float64)
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out_crc(doc_id: object, mod: int) -> int:
    """crc32 of an id as text, modulo."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod
