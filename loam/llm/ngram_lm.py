"""An interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words have ids (their rank among all sorted word hashes). An n-gram is its ids, packed into as few 64-bit numbers as
they need; its key is a bijection of that number (exact and even over buckets), or a hash of several numbers if the
vocabulary and the order ask for more than 64 bits.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import SortedArrays, WordHash, bucket_rows, buckets_for, doc_words, finish, new_folder, rank_of, save_arrays, saved

#: The end of a text is counted as a token. No word holds a space, so its hash is a word's only by collision.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
#: Words that a task works on at a time: what bounds its memory.
SLICE = 300_000
_OPEN: dict[str, Model] = {}
_A, _B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_A1, _B1 = pow(_A, -1, 1 << 64), pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_B)
    return x ^ (x >> np.uint64(32))


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_B1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_A1)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Packing:
    """How ids below 2^bits are packed: `per` of them in each 64-bit number."""

    bits: int

    @property
    def per(self) -> int:
        return 64 // self.bits

    def numbers(self, order: int) -> int:
        return -(-order // self.per)

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids to rows of numbers."""
        out = np.zeros((len(ids), self.numbers(ids.shape[1])), dtype=np.uint64)
        for k in range(ids.shape[1]):
            at = k // self.per
            out[:, at] = out[:, at] << np.uint64(self.bits) | ids[:, k].astype(np.uint64)
        return out

    def ids(self, packed: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros((len(packed), order), dtype=np.int64)
        for k in range(order):
            last = min(order, (k // self.per + 1) * self.per) - 1
            out[:, k] = (packed[:, k // self.per] >> np.uint64((last - k) * self.bits)) & np.uint64((1 << self.bits) - 1)
        return out

    def key(self, packed: np.ndarray) -> np.ndarray:
        if packed.shape[1] == 1:
            return mix(packed[:, 0])
        key = np.zeros(len(packed), dtype=np.uint64)
        for k in range(packed.shape[1]):
            key = finish(key * np.uint64(_A) + packed[:, k])
        return key


@dataclass(frozen=True)
class Figures:
    """tokens: N; types: V, both with ends; bits: of an id; d: discounts of the counts 1, 2 and more, by order from 1;
    contexts: distinct bigrams, what the words' continuation counts add up to; uniform: what the words' distribution
    leaves to the uniform one; start: total and left-over weight after the start of a text."""

    order: int
    n_buckets: int
    word_buckets: int
    tokens: int
    types: int
    bits: int
    d: list[tuple[float, float, float]]
    contexts: int
    uniform: float
    start: tuple[float, float]


def _count_type(tokens: int) -> type:
    return np.uint32 if tokens < 1 << 32 else np.uint64


class Model:
    """The arrays of a folder. word: count, left (distinct words before it), total and gamma as a context; gram2, gram3,
    ...: the count that the order goes by; context2, ...: total and gamma of what goes before an n-gram's last word."""

    def __init__(self, folder: str, most_open: int | None = None):
        with open(os.path.join(folder, "figures.json")) as f:
            self.figures = fig = Figures(**json.load(f))
        kind = _count_type(fig.tokens)
        self.packing = Packing(fig.bits)
        self.ranks = np.load(os.path.join(folder, "ranks.npy"), mmap_mode="r")
        self.words = SortedArrays(folder, "unigram", {"count": np.int64, "left": np.int64, "total": np.int64, "gamma": np.float32}, fig.word_buckets, most_open)
        self.grams = {m: SortedArrays(folder, f"gram{m}", {"times": kind}, fig.n_buckets, most_open) for m in range(2, fig.order + 1)}
        self.contexts = {m: SortedArrays(folder, f"context{m}", {"total": kind, "gamma": np.float32}, fig.n_buckets, most_open) for m in range(2, fig.order)}


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2 and D3+ from the numbers of types with count 1 to 4; where one of these is missing, as
    in tiny corpora, 0.5, 0.75 and 0.9."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(float(min(max(x, 0.05), k - 0.05)) for k, x in zip((1, 2, 3), d, strict=True))


def discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(count <= 0, 0.0, np.where(count == 1, d[0], np.where(count == 2, d[1], d[2])))


def _with_ends(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end after each text, and where each text's tokens begin."""
    at = np.cumsum(lens)
    return np.insert(h, at, END), np.r_[0, np.cumsum(lens + 1)[:-1]]


def _groups(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together by their keys, and where groups begin in it."""
    order = np.argsort(keys, kind="stable") if rows.shape[1] == 1 else np.lexsort((*rows.T, keys))
    r, k = rows[order], keys[order]
    new = np.r_[len(k) > 0, (k[1:] != k[:-1]) | (r[1:] != r[:-1]).any(axis=1)][: len(k)]
    return order, np.flatnonzero(new)


def _summed(rows: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order of their keys, their keys, and the sums of their counts."""
    order, new = _groups(rows, keys)
    return rows[order[new]], keys[order[new]], np.add.reduceat(counts[order], new, axis=0) if len(new) else counts[:0]


def _windows(ids: np.ndarray, begin: np.ndarray, order: int, bos: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `order` neighbouring ids of each text, its start before it; and where each row's last token stands."""
    padded = np.insert(ids, begin, bos)
    size = len(padded) - order + 1
    if size <= 0:
        return np.zeros((0, order), np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(ids)]) + 1)
    at = np.flatnonzero(text[:size] == text[order - 1 :])
    return padded[at[:, None] + np.arange(order)], at + order - 1 - text[at] - 1


_COUNTED = "level int, bucket bigint, grams binary, counts binary, large binary"


def _counted(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], n_buckets: int, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """(level, grams, their keys) to distinct grams and how often each occurs, as bytes by bucket: partial sums of this
    task, sent on whenever about `most` are held. Counts are a byte each, large ones are kept aside."""
    held: dict[int, list] = {}
    size = 0

    def emit() -> pa.RecordBatch:
        out = []
        for level, own in held.items():
            g, k, n = _summed(*(np.concatenate(x) for x in zip(*own, strict=True)))
            out += [(level, b, g[s].tobytes(), np.minimum(n[s], 255).astype(np.uint8).tobytes(), n[s][n[s] > 254].tobytes()) for b, s in bucket_rows(k, n_buckets)]
        held.clear()
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["level", "bucket", "grams", "counts", "large"])

    for level, grams, keys in parts:
        held.setdefault(level, []).append(_summed(grams, keys, np.ones(len(keys), np.int64)))
        size += len(held[level][-1][1])
        if size >= most:
            yield emit()
            size = 0
    if held:
        yield emit()


def _merged(table: pa.Table, numbers: int, key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, counts = [], []
    for g, c, large in zip(*(table[x].to_pylist() for x in ("grams", "counts", "large")), strict=True):
        n = np.frombuffer(c, dtype=np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(large, dtype=np.int64)
        grams.append(np.frombuffer(g, dtype=np.uint64).reshape(-1, numbers))
        counts.append(n)
    grams = np.concatenate(grams)
    return _summed(grams, key(grams), np.concatenate(counts))


def _squeezed(a: np.ndarray) -> bytes:
    """Compressed: most figures are small, and many are 0."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


_STATS = "level int, bucket bigint, grams binary, stats binary, c1 bigint, c2 bigint, c3 bigint, c4 bigint, types bigint"


class _Down:
    """What the grams of one order say to the order below, by bucket of that order: of each (n - 1)-gram the number of
    distinct words before it, and, as the context of n-grams, their sum and how many have the count 1, 2 and more."""

    def __init__(self, packing: Packing, n_buckets: int, ranks: np.ndarray):
        self.packing, self.n_buckets, self.ranks = packing, n_buckets, ranks

    def place(self, packed: np.ndarray, order: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The order that brings grams to their buckets, and each bucket's part of it."""
        if order == 1:  # the buckets of words are ranges of ids; the start of a text goes with the last
            b = np.minimum(np.searchsorted(self.ranks[1:], packed[:, 0].astype(np.int64), side="right"), len(self.ranks) - 2)
            o = np.argsort(b, kind="stable")
            edges = np.flatnonzero(np.r_[len(o) > 0, b[o][1:] != b[o][:-1]][: len(o)])
            return o, [(int(b[o][x]), slice(int(x), int(y))) for x, y in zip(edges, np.r_[edges[1:], len(o)], strict=True)]
        key = self.packing.key(packed)
        o = np.argsort(key, kind="stable")
        return o, list(bucket_rows(key[o], self.n_buckets))

    def rows(self, packed: np.ndarray, order: int, n: np.ndarray) -> pa.Table:
        ids = self.packing.ids(packed, order)
        once, zero = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
        suffix = np.stack([once, zero, zero, zero, zero], axis=1)
        context = np.stack([zero, n, n == 1, n == 2, n > 2], axis=1).astype(np.int64)
        lower = self.packing.pack(np.concatenate([ids[:, 1:], ids[:, :-1]]))
        lower, _, stats = _summed(lower, self.packing.key(lower), np.concatenate([suffix, context]))
        counts = [int((n == i).sum()) for i in (1, 2, 3, 4)] + [len(n)]
        return self.table(order - 1, lower, stats, counts)

    def table(self, order: int, packed: np.ndarray, stats: np.ndarray, counts: list[int]) -> pa.Table:
        o, parts = self.place(packed, order)
        out = [(order, b, _squeezed(np.diff(packed[o[s]], axis=0, prepend=np.uint64(0))), _squeezed(stats[o[s]].T), *[None] * 5) for b, s in parts]
        out.append((0, 0, None, None, *counts))
        names = [x.split()[0] for x in _STATS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})


def _said(table: pa.Table, numbers: int, key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    grams = np.concatenate([np.cumsum(np.frombuffer(unpack(x), dtype=np.uint64).reshape(-1, numbers), axis=0, dtype=np.uint64) for x in table["grams"].to_pylist()])
    stats = np.concatenate([np.frombuffer(unpack(x), dtype=np.int64).reshape(5, -1).T for x in table["stats"].to_pylist()])
    return _summed(grams, key(grams), stats)


def _gamma(stats: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The weight that a context leaves to the order below, from its sum and numbers of counts (1 without any)."""
    total = stats[:, 1]
    return np.where(total > 0, (stats[:, 2:] @ np.array(d)) / np.maximum(total, 1), 1.0)


def train(docs: DataFrame, *, text_col: str = "text", order: int = 2, mb_per_bucket: int = 2) -> str:
    """Count n-grams of all texts up to `order` (2 or more) and write the model; its folder, in the shared folder.

    Words are A-Z lower-cased; a null text is empty: just its end; before a text stands one start. The highest order
    goes by counts, lower ones by the number of distinct words before a gram (by counts where that is the start). What
    is written grows with the corpus; nothing is cut off or pruned. Every pass sums up in the task first, so that a
    frequent word costs a row per task. No texts, no words: a model that gives every text the score 0.
    """
    if order < 2:
        raise ValueError("the order has to be 2 or more")
    spark, n_buckets, word_buckets = docs.sparkSession, buckets_for(docs, mb_per_bucket), buckets_for(docs, 32 * mb_per_bucket)
    folder = new_folder(spark, "lm")
    texts = docs.select(F.col(text_col).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(150_000, lower=True)

        def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, _, h, lens in doc_words(batch, "text", hasher, SLICE):
                    h = _with_ends(h, lens)[0]
                    yield 1, h[:, None], h

        yield from _counted(parts(), word_buckets)

    def keep_words(key: tuple, table: pa.Table) -> pa.Table:
        _, k, n = _merged(table, 1, lambda g: g[:, 0])
        b = key[0].as_py()
        save_arrays(folder, "word", b, k, count=n)
        return pa.table({"bucket": [b], "tokens": [int(n.sum())], "types": [len(k)]})

    # a row per 64 MB of input
    sizes = texts.mapInArrow(words, _COUNTED).groupBy("bucket").applyInArrow(keep_words, "bucket bigint, tokens bigint, types bigint").collect()
    tokens, types = sum(r.tokens for r in sizes), sum(r.types for r in sizes)
    per_bucket = np.zeros(word_buckets + 1, dtype=np.int64)
    per_bucket[[r.bucket + 1 for r in sizes]] = [r.types for r in sizes]
    ranks = np.cumsum(per_bucket)
    np.save(os.path.join(folder, "ranks.npy"), ranks)
    packing = Packing(max(1, types.bit_length()))
    if not types:
        return _finish(folder, Figures(order, n_buckets, word_buckets, 0, 0, 1, [(0.5,) * 3] * order, 0, 1.0, (0.0, 1.0)))
    down, kind = _Down(packing, n_buckets, ranks), _count_type(tokens)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, index = WordHash(150_000, lower=True), SortedArrays(folder, "word", {}, word_buckets)

        def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, _, h, lens in doc_words(batch, "text", hasher, SLICE):
                    h, begin = _with_ends(h, lens)
                    own, where = np.unique(h, return_inverse=True)
                    ids = rank_of(index, own, ranks)[where]
                    for m in range(2, order + 1):
                        rows = _windows(ids, begin, m, types)[0]
                        packed = packing.pack(rows if m == order else rows[rows[:, 0] == types])
                        yield m, packed, packing.key(packed)

        yield from _counted(parts(), n_buckets)

    def keep_top(key: tuple, table: pa.Table) -> pa.Table:
        m, b = key[0].as_py(), key[1].as_py()
        g, k, n = _merged(table, packing.numbers(m), packing.key)
        if m < order:  # grams behind a start: their counts are what their order goes by
            return down.table(m, g, np.pad(n[:, None], ((0, 0), (0, 4))), [0] * 5)
        save_arrays(folder, f"gram{m}", b, k, times=n.astype(kind))
        return down.rows(g, m, n)

    def keep(m: int, above: tuple[float, float, float]):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            b = key[1].as_py()
            g, k, stats = _said(table, packing.numbers(m), packing.key)
            n, follows = stats[:, 0], stats[:, 1] > 0
            save_arrays(folder, f"context{m}", b, k[follows], total=stats[follows, 1].astype(kind), gamma=_gamma(stats[follows], above).astype(np.float32))
            there = n > 0
            save_arrays(folder, f"gram{m}", b, k[there], times=n[there].astype(kind))
            return down.rows(g[there], m, n[there])

        return run

    said = saved(texts.mapInArrow(grams, _COUNTED).groupBy("level", "bucket").applyInArrow(keep_top, _STATS))
    d: list[tuple[float, float, float]] = []
    for m in range(order - 1, 0, -1):
        # counts of counts of order m + 1: the discounts of what its contexts, the grams of order m, are followed by
        c = said.where("level = 0").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in (1, 2, 3, 4)), F.sum("types").alias("types")).first()
        d.insert(0, discounts([c.c1, c.c2, c.c3, c.c4]))
        above = d[0]
        if m == 1:
            break

        lower = said.where(f"level = {m}").groupBy("level", "bucket").applyInArrow(keep(m, above), _STATS)
        said = saved(lower.unionByName(said.where(f"level between 1 and {m - 1}")))

    def keep_unigrams(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        g, _, stats = _said(table, 1, lambda g: g[:, 0])
        none = np.zeros(0, dtype=np.int64)
        own = SortedArrays(folder, "word", {"count": np.int64}, word_buckets).bucket(b) or (none, {"count": none})
        at = g[:, 0].astype(np.int64) - ranks[b]
        size = ranks[b + 1] - ranks[b]
        mine = at < size  # the start of a text has the id behind the last word's
        full = np.zeros((size, 5), dtype=np.int64)
        full[at[mine]] = stats[mine]
        save_arrays(folder, "unigram", b, np.array(own[0]), count=np.array(own[1]["count"]), left=full[:, 0], total=full[:, 1], gamma=_gamma(full, above).astype(np.float32))
        left, start = full[:, 0], stats[~mine].sum(axis=0)
        return pa.table({name: [int(x)] for name, x in zip(_UNIGRAM, (*((left == i).sum() for i in (1, 2, 3, 4)), (left > 2).sum(), left.sum(), *start[1:]), strict=True)})

    ends = said.where("level = 1").groupBy("bucket").applyInArrow(keep_unigrams, ", ".join(f"{c} bigint" for c in _UNIGRAM))
    s = ends.agg(*(F.sum(c).alias(c) for c in _UNIGRAM)).first()
    e = discounts([s.c1, s.c2, s.c3, s.c4])
    uniform = (e[0] * s.c1 + e[1] * s.c2 + e[2] * s.more) / s.left
    start = np.array([[0, s.total, s.s1, s.s2, s.s3]])
    return _finish(folder, Figures(order, n_buckets, word_buckets, tokens, types, packing.bits, [e, *d], s.left, uniform, (float(s.total), float(_gamma(start, above)[0]))))


_UNIGRAM = ("c1", "c2", "c3", "c4", "more", "left", "total", "s1", "s2", "s3")


def _finish(folder: str, figures: Figures) -> str:
    with open(os.path.join(folder, "figures.json"), "w") as f:
        json.dump(asdict(figures), f)
    return folder


def token_scores(model: Model, h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the model's log10 probability, the base's, and the number of known tokens."""
    fig, packing = model.figures, model.packing
    h, begin = _with_ends(h, lens)
    own, where = np.unique(h, return_inverse=True)
    there, values = model.words.find(own)
    rank = np.where(there, rank_of(model.words, own, model.ranks), -1)
    base = np.log10((values["count"].astype(np.float64) + 1) / (fig.tokens + (fig.types + 1)))
    left = values["left"].astype(np.float64)
    unigram = np.maximum(left - discount(left, fig.d[0]), 0) / fig.contexts + fig.uniform / (fig.types + 1)
    ids, p = rank[where], unigram[where]
    # order 2: a context is a word, or the start of a text
    total = np.r_[0.0, values["total"][where][:-1].astype(np.float64)]
    gamma = np.r_[1.0, values["gamma"][where][:-1].astype(np.float64)]
    total[begin], gamma[begin] = fig.start
    for m in range(2, fig.order + 1):
        rows, at = _windows(ids, begin, m, fig.types)
        if m > 2:
            total, gamma = np.zeros(len(h)), np.ones(len(h))
            seen = np.flatnonzero((rows[:, :-1] >= 0).all(axis=1))
            _, got = _looked_up(model.contexts[m - 1], packing.key(packing.pack(rows[seen, :-1])))
            total[at[seen]], gamma[at[seen]] = got["total"], np.where(got["total"] > 0, got["gamma"], 1.0)
        top = np.zeros(len(h))
        seen = np.flatnonzero((rows >= 0).all(axis=1) & (total[at] > 0))
        _, got = _looked_up(model.grams[m], packing.key(packing.pack(rows[seen])))
        times = got["times"].astype(np.float64)
        top[at[seen]] = np.maximum(times - discount(times, fig.d[m - 1]), 0) / total[at[seen]]
        p = top + np.where(total > 0, gamma, 1.0) * p
    return np.add.reduceat(np.log10(p), begin), np.add.reduceat(base[where], begin), np.add.reduceat((ids >= 0).astype(np.int64), begin)


def _looked_up(arrays: SortedArrays, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    own, where = np.unique(keys, return_inverse=True)
    there, values = arrays.find(own)
    return there[where], {v: x[where] for v, x in values.items()}


def trains(id_col: Column, mod: int = 7, rest: int = 2) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not `rest` modulo `mod`."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % mod != rest


def score_texts(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text, its end included. Null and empty texts are just an end; repeated
    rows give repeated rows; other columns are ignored.
    """
    kind = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(150_000, lower=True)
        if folder not in _OPEN:
            _OPEN.clear()
            _OPEN[folder] = Model(folder)
        model = _OPEN[folder]
        for batch in batches:
            for begin, end, h, lens in doc_words(batch, text_col, hasher, SLICE):
                if model.figures.types:
                    score, base, known = token_scores(model, h, lens)
                else:
                    score = base = np.zeros(len(lens))
                    known = np.zeros(len(lens), np.int64)
                n = lens + 1
                columns = [n, known, np.full(len(n), model.figures.tokens), base, score, 10 ** np.minimum(-score / n, 300)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], *map(pa.array, columns)], names=[f.name for f in kind])

    return docs.select(id_col, text_col).mapInArrow(run, kind)


def held_out_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Train on the learning fold (crc32 of the id modulo 7 is not 2; a null id counts as '') and score all rows. The
    scores are written once; then the model's arrays are removed."""
    folder = train(docs.where(trains(F.col(id_col))), text_col=text_col, order=order)
    scored = saved(score_texts(docs, folder, id_col=id_col, text_col=text_col))
    shutil.rmtree(folder, ignore_errors=True)
    return scored.withColumn("held_out", ~trains(F.col(id_col)))
