"""Helpers that the corpus operators share: words, hashing, the shared folder, bucket sizes."""

from __future__ import annotations

import os
import resource
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.shared import shared_dir, shared_path, stored

#: The ASCII white space that parts words: space and U+0009 to U+000D (bytes.split() parts at the same).
SPACES = " \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)
M64 = (1 << 64) - 1


def words_column(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array, in order; null counts as empty."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(flat, " "), "")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder for arrays that workers map into memory.

    The shared folder has to be mounted on every machine (a local disk in tests, NFS or a FUSE mount on a
    cluster), as memory mapping needs a path; a folder that only Hadoop's clients reach is refused.
    """
    url = urlparse(shared_path(spark, kind))
    if url.scheme not in ("", "file"):
        raise ValueError(f"arrays are memory-mapped: spark.checkpoint.dir has to be a mounted path, not {url.geturl()}")
    path = unquote(url.path)
    os.makedirs(path, exist_ok=True)
    return path


def buckets_for(df: DataFrame, mb: int = 2) -> int:
    """A number of hash buckets that grows with the input: parallelism only. The input's size is Catalyst's estimate;
    where there is none (a petabyte or more is what Spark says then), texts are measured in one pass."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        texts = [F.sum(F.octet_length(f"`{c}`").cast("long")) for c, kind in df.dtypes if kind in ("string", "binary")]
        size = sum(x or 0 for x in df.agg(*texts).first()) if texts else 0
    return max(16, 1 << (size // (mb << 20)).bit_length())


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder: survives lost executors, cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class WordHash(dict):
    """Word bytes to 64-bit hashes; a bounded cache, as frequent words make up most of a corpus."""

    def __init__(self, most: int = 400_000, lower: bool = False):
        super().__init__()
        self.most, self.lower = most, lower

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.lower() if self.lower else word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def as_binary(column) -> pa.Array:
    return column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column


def doc_words(batch: pa.RecordBatch, text: str, hasher: WordHash, most: int = 1_500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes of these rows one after another, words per row), at most `most` words at
    a time unless one text alone has more. bytes.lower() lower-cases A-Z only."""
    column = as_binary(batch.column(batch.schema.get_field_index(text)))
    begin, parts, lens, total = 0, [], [], 0
    for i in range(batch.num_rows):
        ws = (column[i].as_py() or b"").split()
        if total and total + len(ws) > most:
            yield begin, i, np.concatenate(parts), np.array(lens, dtype=np.int64)
            begin, parts, lens, total = i, [], [], 0
        parts.append(hasher.of(ws))
        lens.append(len(ws))
        total += len(ws)
    if lens:
        yield begin, batch.num_rows, np.concatenate(parts), np.array(lens, dtype=np.int64)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection), so that ranges of the result are even."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX2
    h ^= h >> np.uint64(29)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def rolling(h: np.ndarray, k: int, mult: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hash of each k consecutive values; len(h) - k + 1 of them. Built by doubling: log k passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, size = h, 1
    out, done = None, 0
    mult %= 1 << 64
    while True:
        if k & size:
            if out is None:
                out, done = power, size
            else:  # out covers `done` values, `power` the `size` that follow
                shift = np.uint64(pow(mult, size, 1 << 64))
                m = len(h) - done - size + 1
                out = out[:m] * shift + power[done : done + m]
                done += size
        size *= 2
        if size > k:
            break
        shift = np.uint64(pow(mult, size // 2, 1 << 64))
        m = len(h) - size + 1
        power = power[:m] * shift + power[size // 2 : size // 2 + m]
    return finish(out[:n])


def save_arrays(folder: str, name: str, bucket: int, keys: np.ndarray, **values: np.ndarray) -> None:
    """Write a bucket's sorted keys and their values as one file: how many, then array after array. A task that runs
    twice replaces the file by an equal one."""
    path = _file(folder, name, bucket)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.int64(len(keys)).tobytes())
        for a in (keys.astype(np.uint64, copy=False), *values.values()):
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


def _file(folder: str, name: str, bucket: int) -> str:
    return os.path.join(folder, name, f"{bucket >> 10:06d}", f"{bucket & 1023:04d}.bin")


class SortedArrays:
    """Hash arrays, cut into buckets by the key's leading bits and sorted, one file each. A bucket is mapped into memory
    when its keys are asked for; the last `most_open` stay mapped, so open files are bounded at any size (unless given, by
    an eighth of what the process may open)."""

    def __init__(self, folder: str, name: str, values: dict[str, type], n_buckets: int, most_open: int | None = None):
        most_open = most_open or max(16, min(8192, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 8))
        self.shift = np.uint64(64 - (n_buckets - 1).bit_length())
        self.folder, self.name, self.kinds, self.most_open = folder, name, {v: np.dtype(t) for v, t in values.items()}, most_open
        self.open: OrderedDict[int, tuple[np.ndarray, dict[str, np.ndarray]] | None] = OrderedDict()

    def bucket(self, b: int) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
        """A bucket's keys and values; None if no key fell there."""
        if b in self.open:
            self.open.move_to_end(b)
            return self.open[b]
        if len(self.open) >= self.most_open:
            self.open.popitem(last=False)
        self.open[b] = found = self._map(b)
        return found

    def _map(self, b: int) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
        try:
            raw = np.memmap(_file(self.folder, self.name, b), dtype=np.uint8, mode="r")
        except FileNotFoundError:
            return None
        n, at, values = int(raw[:8].view(np.int64)[0]), 8, {}
        keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        for v, t in self.kinds.items():
            values[v] = raw[at : at + t.itemsize * n].view(t)
            at += -(-t.itemsize * n // 8) * 8
        return keys, values

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each key is there, and its values (0 where it is absent). keys: sorted."""
        there = np.zeros(len(keys), dtype=bool)
        out = {v: np.zeros(len(keys), dtype=t) for v, t in self.kinds.items()}
        for b, own in bucket_rows(keys, 1 << (64 - int(self.shift))):
            got = self.bucket(b)
            if got is None or not len(got[0]):
                continue
            at = np.minimum(np.searchsorted(got[0], keys[own]), len(got[0]) - 1)
            hit = got[0][at] == keys[own]
            there[own] = hit
            for v, x in out.items():
                x[own][hit] = got[1][v][at[hit]]
        return there, out


def rank_of(arrays: SortedArrays, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Each key's rank among all keys, for keys that are there; keys: sorted, ranks: how many keys lie before each bucket."""
    out = np.zeros(len(keys), dtype=np.int64)
    for b, own in bucket_rows(keys, len(ranks) - 1):
        got = arrays.bucket(b)
        out[own] = ranks[b] + (np.searchsorted(got[0], keys[own]) if got is not None else 0)
    return out


def bucket_rows(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted keys and where each lies."""
    if len(keys):
        bucket = keys >> np.uint64(64 - (n_buckets - 1).bit_length())
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(edges, np.r_[edges[1:], len(keys)], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))
