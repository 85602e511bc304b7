"""Document fingerprints by SimHash, and the fingerprints within a Hamming radius by tables of their bits."""

from __future__ import annotations

import hashlib
import math
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import WordHash, as_binary, finish, new_folder, rolling, saved

BITS = 128
SHINGLE = 5
#: Terms that vote at a time: 64 bits of 4 bytes each make some 8 MB.
TERMS = 1 << 15
_LANES = np.uint64(0xA0761D6478BD642F)


def fingerprint(text: bytes, hasher: WordHash) -> np.ndarray:
    """Two 64-bit halves. Terms are 5-word shingles (a shorter text is one term), weighing 1 + ln(frequency); each
    term's hash votes for or against every bit. No words: all bits 0. Equal word sequences have equal fingerprints."""
    words = text.split()
    if not words:
        return np.zeros(2, dtype=np.uint64)
    h, n = np.unique(rolling(hasher.of(words), min(SHINGLE, len(words))), return_counts=True)
    weight, votes = 1 + np.log(n), np.zeros((2, 64))
    for at in range(0, len(h), TERMS):  # a vote of every term on 128 bits, so many terms at a time
        w = weight[at : at + TERMS].astype(np.float32)
        for lane, salt in enumerate((np.uint64(0), _LANES)):
            x = finish(h[at : at + TERMS] ^ salt)
            votes[lane] += w @ np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return np.packbits(2 * votes > weight.sum(), axis=1, bitorder="little").view(np.uint64)[:, 0].copy()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal bits."""
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def as_hex(fp: np.ndarray) -> str:
    return f"{int(fp[0]):016x}{int(fp[1]):016x}"


_RESULT = [("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]


def _edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    own = text.decode("utf-8", "replace")
    half = len(own) // 2
    # as many code points of the next text; no code point has more than 4 bytes, so longer texts aren't decoded whole
    head = following[: 4 * half].decode("utf-8", "ignore")[:half]
    return len(own), (own[: len(own) - half] + head).encode()


def _row(text: bytes, fp: np.ndarray, following: bytes, next_fp: np.ndarray, hasher: WordHash) -> tuple:
    n, edited = _edited(text, following)
    own = fingerprint(edited, hasher)
    return n, hashlib.sha256(edited).hexdigest(), as_hex(fp), as_hex(own), likeness(fp, own), likeness(fp, next_fp)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, the fingerprint, and how it likens to the next document's and to that of
    an edited text (its second half replaced by the start of the next document, ascending id; after the last, the first).

    Texts are dealt by ranges of the id and sorted there, one shuffle. Each partition streams through; only its first
    and last document stay open, and a partition's last meets the next one's first by a join on the partition's number. Null texts are empty (all bits
    0); null ids come last; rows of equal id follow one another in text order; extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    fields = ", ".join(f"{c} {t}" for c, t in _RESULT)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    schema = T.StructType([T.StructField("id", kind), T.StructField("open", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.BinaryType()), *T._parse_datatype_string(fields).fields])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, before, first, part = WordHash(), None, True, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts, out = batch.column(0), as_binary(batch.column(1)), []
            for i in range(batch.num_rows):
                one, text = ids[i].as_py(), texts[i].as_py() or b""
                fp = fingerprint(text, hasher)
                if first:
                    out.append((one, "first", part, text) + (None,) * 6)
                    first = False
                else:
                    out.append((before[0], None, None, None, *_row(before[1], before[2], text, fp, hasher)))
                before = (one, text, fp)
            yield _batch(out, schema)
        if before is not None:
            yield _batch([(before[0], "last", part, before[1]) + (None,) * 6], schema)

    done = saved(rows.mapInArrow(stream, schema))  # fingerprints, and two texts per partition
    ends = done.where("open is not null")
    order = Window.orderBy("part")  # numbers only, one per partition
    numbers = ends.where("open = 'first'").select("part")
    after = numbers.select(F.col("part").alias("_p"), F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    heads = ends.where("open = 'first'").select(F.col("part").alias("_next"), F.col("text").alias("following"))
    ends = ends.where("open = 'last'").join(after, F.col("part") == F.col("_p")).join(heads, "_next").select("id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append((r["id"], None, None, None, *_row(r["text"], fingerprint(r["text"], hasher), r["following"], fingerprint(r["following"], hasher), hasher)))
            yield _batch(out, schema)

    return done.where("open is null").unionByName(ends.mapInArrow(close, schema)).drop("open", "part", "text").withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def radius_for(similarity: float, share: float = 0.99) -> int:
    """The least radius that holds `share` of the pairs of texts whose shingle sets have this Jaccard similarity. Sets of
    one size have the cosine 2J / (1 + J), and each bit of SimHash differs with the probability angle / pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    held = 0.0
    for r in range(BITS + 1):
        held += math.comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
        if held >= share:
            return r
    return BITS


@dataclass(frozen=True)
class BlockTable:
    """A permuted table: fingerprints that agree in the `shard` bits meet in one group, and there those whose `key` bits
    differ in up to `flips` places, and their `both` bits in up to `within`."""

    shard: tuple[int, ...]
    key: tuple[int, ...]
    flips: int
    both: tuple[int, ...] = ()
    within: int = BITS

    @cached_property
    def masks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _mask(self.shard), _mask(self.key), _mask(self.both)

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Whether this table brings together pairs whose fingerprints differ in the bits x."""
        shard, key, both = self.masks
        return ~(x & shard).any(axis=1) & (np.bitwise_count(x & key).sum(axis=1) <= self.flips) & (np.bitwise_count(x & both).sum(axis=1) <= self.within)


def _mask(bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(2, dtype=np.uint64)
    for b in bits:
        out[b // 64] |= np.uint64(1 << (b % 64))
    return out


def _bits(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """These bits of each fingerprint as a number."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= (((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)).astype(np.int64)
    return out


def exact_tables(radius: int, blocks: int) -> list[BlockTable]:
    """Tables, one per block of bits, that miss no two fingerprints within the radius: were all blocks beyond their
    flips, these being radius + 1 - blocks in all, more than `radius` bits would differ (pigeonhole). Two neighbouring
    blocks hold a pair together by the same rule, so what they may differ in is bounded too. A block of -1 is in no table.
    A key meets the more others the narrower blocks are, and is flipped the oftener the fewer."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    bits = [tuple(range(a, b)) for a, b in pairwise(edges)]
    flips = [(radius + 1) // blocks - 1 + (k < (radius + 1) % blocks) for k in range(blocks)]
    out = []
    for k in range(blocks):
        pair = [x for x in (k & ~1, k | 1) if x < blocks]
        if flips[k] >= 0:
            out.append(BlockTable((), bits[k], flips[k], sum((bits[x] for x in pair), ()), sum(flips[x] for x in pair) + len(pair) - 1))
    return out


def slices_for(n: int) -> int:
    """Slices of n fingerprints for the exact search: a task per two of them, of 2^18 at most; few for few."""
    return max(min(8, math.ceil(n / 4096)), math.ceil(n / (1 << 18)), 1)


def drawn_tables(n: int, radius: int, recall: float, rows_per_task: int, flips: int = 2, seed: int = 10) -> list[BlockTable]:
    """Tables of drawn bits, so many that a pair at the radius meets in one with probability `recall` (a nearer pair with
    more). Shard bits keep a group of random fingerprints near rows_per_task, key bits leave about two to a key."""
    s = max(0, math.ceil(math.log2(max(n, 1) / rows_per_task)))
    b = min(BITS - s, 40, max(0, round(math.log2(max(n, 1) / (1 << s) / 2))))
    hit = sum(math.comb(b, d) * math.comb(BITS - s - b, radius - d) for d in range(min(flips, radius, b) + 1)) / math.comb(BITS, radius)
    count = 1 if hit > 1 - 1e-12 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
    rng = np.random.default_rng(seed)
    drawn = [tuple(map(int, rng.choice(BITS, s + b, replace=False))) for _ in range(count)]
    return [BlockTable(d[:s], d[s:], flips) for d in drawn]


def _met(a: np.ndarray, b: np.ndarray, tables: list[BlockTable], radius: int, same: bool, batch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of b each of a has within the radius, and of a each of b, by tables without shards; same: a is b,
    whose pairs count once. A pair counts in the first table that holds it."""
    near_a, near_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    for t, table in enumerate(tables):
        key = table.key[:16]  # of wider blocks these bits are no more apart than all
        ka, kb = _bits(a, key), _bits(b, key)
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka, own, other = ka[oa], a[oa], b[ob]
        start = np.searchsorted(kb[ob], np.arange((1 << len(key)) + 1)).astype(np.int32)
        size = np.diff(start)
        narrow = len(table.both) <= 32
        ha, hb = ((_bits(x, table.both) if narrow else np.zeros(len(x))).astype(np.uint32) for x in (own, other))
        for d in range(min(table.flips, len(key)) + 1):
            for flipped in combinations(range(len(key)), d):
                at = ka ^ sum(1 << f for f in flipped)
                n = size[at]
                ends = np.cumsum(n, dtype=np.int64)
                if not len(ends) or not ends[-1]:
                    continue
                shift = start[at] - (ends - n)
                cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(batch, ends[-1], batch)) + 1, len(n)])
                for lo, hi in pairwise(cuts.tolist()):
                    i = np.repeat(np.arange(lo, hi, dtype=np.int32), n[lo:hi])
                    j = np.repeat(shift[lo:hi], n[lo:hi]) + np.arange(ends[lo] - n[lo], ends[hi - 1])
                    if narrow:
                        kept = np.flatnonzero(np.bitwise_count(ha[i] ^ hb[j]) <= table.within)
                        i, j = i[kept], j[kept]
                    x = own[i, :2] ^ other[j, :2]
                    near = np.flatnonzero(np.bitwise_count(x).sum(axis=1) <= radius)
                    if same:
                        near = near[oa[i[near]] < ob[j[near]]]
                    near = near[table.holds(x[near])]
                    for before in tables[:t]:
                        near = near[~before.holds(x[near])]
                    np.add.at(near_a, oa[i[near]], other[j[near], 2].astype(np.int64))
                    np.add.at(near_b, ob[j[near]], own[i[near], 2].astype(np.int64))
    return near_a, near_b


class _Group:
    """Fingerprints of one group of a table, sorted by key, and how many others each has within the radius. A pair counts
    in the first table that holds it."""

    def __init__(self, rows: np.ndarray, tables: list[BlockTable], t: int, radius: int, batch: int = 1 << 20):
        key = _bits(rows, tables[t].key)
        order = np.argsort(key, kind="stable")
        self.rows, self.key, self.tables, self.t, self.radius, self.batch = rows[order], key[order], tables, t, radius, batch
        self.n = np.zeros(len(rows), dtype=np.int64)

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        """Candidate pairs of rows."""
        x = self.rows[i, :2] ^ self.rows[j, :2]
        near = np.flatnonzero(np.bitwise_count(x).sum(axis=1) <= self.radius)
        for table in self.tables[: self.t]:
            if not len(near):
                return
            near = near[~table.holds(x[near])]
        i, j = i[near], j[near]
        np.add.at(self.n, i, self.rows[j, 2].astype(np.int64))
        np.add.at(self.n, j, self.rows[i, 2].astype(np.int64))

    def ranges(self, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, same: bool) -> None:
        """All pairs of a[k] to a[k] + m[k] and b[k] to b[k] + n[k], for all k; within one range if they are the same."""
        total = m * n
        ends = np.cumsum(total)
        begin = 0
        while begin < len(a):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + self.batch, side="right")))
            of = np.repeat(np.arange(begin, end), total[begin:end])
            at = np.arange(len(of)) - np.repeat(ends[begin:end] - total[begin:end] - done, total[begin:end])
            i, j = a[of] + at // n[of], b[of] + at % n[of]
            if same:
                i, j = i[i < j], j[i < j]
            self.meet(i, j)
            begin = end

    def probe(self, most: int) -> list[tuple[int, int, int, int]]:
        """Meets all keys with those `flips` bits away; what is too large a pair of ranges is returned instead."""
        own = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        keys, size = self.key[own], np.diff(np.r_[own, len(self.key)])
        hot: list[tuple[int, int, int, int]] = []
        width = len(self.tables[self.t].key)
        for d in range(min(self.tables[self.t].flips, width) + 1):
            for bits in combinations(range(width), d):
                other = keys ^ sum(1 << b for b in bits)
                at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == other) & (keys <= other)) if len(keys) else at
                left, right = hit, at[hit]
                if d == 0:
                    hit = left = right = left[size[left] > 1]
                large = size[left] * size[right] > most * most
                hot += [(int(own[x]), int(size[x]), int(own[y]), int(size[y])) for x, y in zip(left[large], right[large], strict=True)]
                x, y = left[~large], right[~large]
                self.ranges(own[x], size[x], own[y], size[y], d == 0)
        return hot

    def counted(self) -> list[tuple]:
        return [x + (None,) * 6 for x in _counted(self.rows, self.n)]


def _counted(rows: np.ndarray, n: np.ndarray) -> list[tuple[str, int]]:
    """Fingerprints that have others near them, and how many."""
    some = np.flatnonzero(n)
    digits = rows[some, :2].astype(">u8").tobytes().hex()
    return [(digits[32 * i : 32 * i + 32], int(x)) for i, x in enumerate(n[some])]


_NEAR = T.StructType([T.StructField("fp", T.StringType()), T.StructField("n", T.LongType()), T.StructField("t", T.IntegerType()), T.StructField("hot", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("a", "m", "b", "k"))])


def near_fingerprints(found: DataFrame, *, fp_col: str = "fingerprint", radius: int = radius_for(0.8), exact: bool = False, blocks: int = 8, recall: float = 0.99, flips: int = 2, most: int = 4096, rows_per_task: int = 1 << 22) -> DataFrame:
    """Per distinct fingerprint (32 hex digits): n_same, how many rows of `found` have it, and n_near, how many other
    rows have a fingerprint that differs in at most `radius` bits. Null fingerprints are left out; none give none.

    Fingerprints go to permuted tables and meet there by their key bits, each key with those a few flipped bits away;
    what meets is compared bit by bit, and a pair counts in the first table that holds it, so none counts twice or
    falsely. exact: a table per block, which misses nothing at any radius (`exact_tables`); fingerprints are dealt to
    slices by hash, and any two slices meet in all tables in a task of their own (`slices_for`): no group holds all, and
    the work per fingerprint grows with their number. Otherwise drawn bits (`drawn_tables`), enough to find a pair at the
    radius with probability `recall`; more flips need fewer tables and more comparisons. There a distinct fingerprint is
    sent once per table, 20 bytes each, by Spark's exchange; a group holds a table's share of about rows_per_task. Two
    ranges of keys of over most x most pairs are cut into pieces that are tasks of their own, from a copy of the group in
    the shared folder: nothing is capped.
    """
    if radius < 0 or not 1 <= blocks <= BITS:
        raise ValueError("the radius has to be 0 or more and blocks 1 to 128")
    spark = found.sparkSession
    same = saved(found.where(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.count(F.lit(1)).alias("n_same")))
    n = same.count()
    if exact:
        return _with_near(same, saved(_sliced(same, exact_tables(radius, blocks), radius, slices_for(n)).groupBy("fp").agg(F.sum("n").alias("n"))), fp_col)
    tables = drawn_tables(n, radius, recall, rows_per_task, flips)
    folder = new_folder(spark, "fingerprints")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            fp, packed = _packed(held)
            for t, table in enumerate(tables):
                shard = _bits(fp, table.shard)
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
                blobs = [packed[order[x:y]].tobytes() for x, y in pairwise(cut)]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(blobs), pa.int32()), pa.array(shard[order[cut[:-1]]], pa.int64()), pa.array(blobs, pa.binary())], names=["t", "shard", "rows"])

        for batch in batches:
            if batch.num_rows:
                held.append((_numbers(batch.column(0).to_pylist()), np.minimum(batch.column(1).to_numpy(), 2**32 - 1)))
                size += batch.num_rows
            if size >= 1 << 16:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    def table(group: pa.Table) -> pa.Table:
        t, shard = group["t"][0].as_py(), group["shard"][0].as_py()
        own = _Group(_unpacked(group["rows"].to_pylist()), tables, t, radius)
        rows = []
        if hot := own.probe(most):
            name = f"hot-{t}-{shard}.npy"
            _save(os.path.join(folder, name), own.rows)
            for a, m, b, k in hot:
                for x in range(0, m, most):
                    rows += [(None, None, t, name, a + x, min(most, m - x), b + y, min(most, k - y)) for y in range(x if a == b else 0, k, most)]
        return pa.Table.from_batches([_batch(own.counted() + rows, _NEAR)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = np.load(os.path.join(folder, r["hot"]), mmap_mode="r")
                spans = sorted({(r["a"], r["m"]), (r["b"], r["k"])})
                own = _Group(np.concatenate([rows[a : a + m] for a, m in spans]), tables, r["t"], radius)
                here = np.concatenate([np.full(m, k) for k, (_, m) in enumerate(spans)])
                own.rows = np.concatenate([rows[a : a + m] for a, m in spans])
                i, j = np.flatnonzero(here == 0), np.flatnonzero(here == len(spans) - 1)
                for at in range(0, len(i), 256):
                    x, y = np.repeat(i[at : at + 256], len(j)), np.tile(j, len(i[at : at + 256]))
                    own.meet(*((x, y) if len(spans) > 1 else (x[x < y], y[x < y])))
                yield _batch(own.counted(), _NEAR)

    dealt = same.mapInArrow(deal, "t int, shard bigint, rows binary")
    near = saved(dealt.groupBy("t", "shard").applyInArrow(table, _NEAR))
    hot = near.where("hot is not null")
    if n_hot := hot.count():
        near = near.unionByName(hot.repartition(min(n_hot, 4096)).mapInArrow(pieces, _NEAR))
    near = saved(near.where("fp is not null").groupBy("fp").agg(F.sum("n").alias("n")))
    shutil.rmtree(folder, ignore_errors=True)
    return _with_near(same, near, fp_col)


def _with_near(same: DataFrame, near: DataFrame, fp_col: str) -> DataFrame:
    return same.join(near, "fp", "left").select(F.col("fp").alias(fp_col), "n_same", (F.col("n_same") - 1 + F.coalesce("n", F.lit(0))).alias("n_near"))


def _sliced(same: DataFrame, tables: list[BlockTable], radius: int, slices: int) -> DataFrame:
    """Fingerprints with what each has near it, slice by slice: a fingerprint is sent to every slice, its own with it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, packed = _packed([(_numbers(batch.column(0).to_pylist()), np.minimum(batch.column(1).to_numpy(), 2**32 - 1))])
            of = finish(fp[:, 0] ^ fp[:, 1]) % np.uint64(slices)
            out = []
            for s in np.unique(of).tolist():
                rows = packed[of == s].tobytes()
                out += [(min(s, x), max(s, x), int(s > x), rows) for x in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["p", "q", "side", "rows"])

    def meet(group: pa.Table) -> pa.Table:
        blobs = list(zip(group["side"].to_pylist(), group["rows"].to_pylist(), strict=True))
        alone = group["p"][0].as_py() == group["q"][0].as_py()
        a = _unpacked([x for side, x in blobs if side == 0])
        b = a if alone else _unpacked([x for side, x in blobs if side == 1])
        near_a, near_b = _met(a, b, tables, radius, alone)
        found = _counted(a, near_a + near_b) if alone else _counted(a, near_a) + _counted(b, near_b)
        return pa.table({"fp": pa.array([x[0] for x in found], pa.string()), "n": pa.array([x[1] for x in found], pa.int64())})

    dealt = same.mapInArrow(deal, "p int, q int, side int, rows binary").repartition(min(4096, slices * (slices + 1) // 2), "p", "q")
    return dealt.groupBy("p", "q").applyInArrow(meet, "fp string, n bigint")


#: A fingerprint and how many rows have it, as it is sent.
_PACKED = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<u4")])


def _packed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    fp, n = (np.concatenate(x) for x in zip(*held, strict=True))
    packed = np.zeros(len(fp), dtype=_PACKED)
    packed["a"], packed["b"], packed["n"] = fp[:, 0], fp[:, 1], n
    return fp, packed


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(blobs), dtype=_PACKED)
    return np.stack([packed["a"], packed["b"], packed["n"].astype(np.uint64)], axis=1)


def _save(path: str, a: np.ndarray) -> None:
    """A task that runs twice replaces the file by an equal one."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, a)
    os.replace(part, path)


def _numbers(fp: list[str]) -> np.ndarray:
    return np.array([(int(x[:16], 16), int(x[16:], 16)) for x in fp], dtype=np.uint64).reshape(-1, 2)


def fingerprint_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, radius: int | None = None, exact: bool = False, salts: int = 64) -> DataFrame:
    """`fingerprints` with n_near: how many other rows have a fingerprint within the radius; unless given, the radius that
    holds texts of this similarity (`radius_for`). exact: as in `near_fingerprints`.

    Null and empty texts share the fingerprint of all bits 0 and so are near each other; repeated rows are near each other
    and each have their row; null ids come last; empty gives empty. Rows meet their fingerprint's count salted, so that a
    fingerprint which a third of all rows have is no task's alone."""
    found = saved(fingerprints(docs, id_col=id_col, text_col=text_col))
    near = near_fingerprints(found, radius=radius_for(similarity) if radius is None else radius, exact=exact)
    many = max(1000, found.count() // 100_000)  # so at most 100,000 fingerprints are hot, which bounds what is broadcast
    near = near.withColumn("_salt", F.explode(F.when(F.col("n_same") > many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))))
    hot = near.where("_salt = 0").select("fingerprint", F.lit(True).alias("_hot"))
    salted = found.join(F.broadcast(hot), "fingerprint", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("edited_sha256", id_col), F.lit(salts))).otherwise(-1).cast("int"))
    return salted.join(near.select("fingerprint", "_salt", "n_near"), ["fingerprint", "_salt"]).select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
