"""Documents whose sets of word shingles are alike (Jaccard), by a chosen-path join.

Sets are embedded by min-hashing into COORDINATES values, whose expected share of equal ones is the Jaccard similarity.
A run starts with all sets in one bucket. A bucket that is too large chooses coordinates at random, each with
probability 1 / (threshold x COORDINATES), and a set goes on to one bucket per chosen coordinate, keyed by its value
there: similar sets share such tokens, others part ways. Small buckets are compared by brute force. Runs repeat until
the expected recall of a pair at the threshold reaches the target (Christiani, Pagh and Sivertsen's CPSJoin).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import WordHash, as_binary, doc_words, finish, rolling, saved

COORDINATES = 64
SHINGLE = 5
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64)


def shingles(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts one after another, and how many each has; a text of 1 to 4 words is one shingle."""
    n = np.where(lens >= SHINGLE, lens - SHINGLE + 1, (lens > 0).astype(np.int64))
    begin = np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)
    long = rolling(h, SHINGLE)
    out = np.zeros(int(n.sum()), dtype=np.uint64)
    at = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
    big = lens >= SHINGLE
    if big.any():
        own = np.repeat(big, n)
        place = np.arange(len(out)) - np.repeat(at, n) + np.repeat(begin, n)
        out[own] = long[place[own]]
    for i in np.flatnonzero((lens > 0) & ~big):
        out[at[i]] = rolling(h[begin[i] : begin[i] + lens[i]], int(lens[i]))[0] ^ np.uint64(lens[i])
    return out, n


def signatures(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """COORDINATES min-hashes of each set (rows with n > 0)."""
    out = np.zeros((len(n), COORDINATES), dtype=np.uint32)
    some = n > 0
    begin = np.r_[0, np.cumsum(n)[:-1]][some]
    if len(begin):
        for c in range(COORDINATES):
            out[some, c] = np.minimum.reduceat(((s * _MUL[c] + _ADD[c]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, set_key (null without words), n_set, sig: a row per row."""
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("n_set", T.IntegerType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in batches:
            for begin, end, h, lens in doc_words(batch, "text", hasher, 300_000):
                s, n = shingles(h, lens)
                sig = signatures(s, n)
                keys, sizes = [], []
                for part in np.split(s, np.cumsum(n)[:-1]):
                    own = np.unique(part)
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    sizes.append(len(own))
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], batch.column(1)[begin:end], pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array([x.tobytes() if k else None for x, k in zip(sig, keys, strict=True)], pa.binary())], names=[f.name for f in kind])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def _chosen(node: np.ndarray, threshold: float) -> np.ndarray:
    """Which coordinates a node chooses: the same for all sets that come to it."""
    c = finish(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (finish(node[:, None] ^ c[None, :]) >> np.uint64(11)) < np.uint64((1 << 53) / (threshold * COORDINATES))


def _children(rows: DataFrame, threshold: float, runs: list[int] | None = None) -> DataFrame:
    """rows (set_key, sig and, unless runs are started, node and n) to (node, set_key, above) of the next level; above:
    the size of the bucket that was split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
            above = np.full(len(sig), np.iinfo(np.int64).max)
            if runs is not None:
                roots = finish(np.array(runs, dtype=np.uint64) + np.uint64(1))
                todo = [(np.full(len(sig), r, dtype=np.uint64), np.broadcast_to(m, sig.shape)) for r, m in zip(roots, _chosen(roots, threshold), strict=True)]
            else:
                node, above = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
                own, where = np.unique(node, return_inverse=True)
                todo = [(node, _chosen(own, threshold)[where])]
            for node, mask in todo:
                row, c = np.nonzero(mask)
                child = finish(finish(node[row] ^ (c.astype(np.uint64) + np.uint64(77))) + sig[row, c])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(above[row])], names=["node", "set_key", "above"])

    columns = ["set_key", "sig"] if runs is not None else ["set_key", "sig", "node", "n"]
    return rows.select(columns).mapInArrow(run, "node bigint, set_key binary, above bigint")


class Missed:
    """The share of pairs at the threshold that no run has found yet. A pair agrees in a binomial number of the
    coordinates, which all runs share; with m of them each split passes it on to a number of common buckets that is
    Poisson with mean m / (coordinates x threshold)."""

    def __init__(self, threshold: float):
        self.mean = np.arange(COORDINATES + 1) / (COORDINATES * threshold)
        self.share = np.array([math.comb(COORDINATES, m) * threshold**m * (1 - threshold) ** (COORDINATES - m) for m in range(COORDINATES + 1)])

    def runs(self, n: int, depth: int) -> None:
        """n runs in which a pair had to share a bucket after `depth` splits."""
        found = np.ones(COORDINATES + 1)
        for _ in range(depth):
            found = 1 - np.exp(-self.mean * found)
        self.share *= (1 - found) ** n

    def total(self) -> float:
        return float(self.share.sum())


def candidate_stars(reps: DataFrame, threshold: float, recall: float, small: int, per_batch: int = 14, deepest: int = 24, alike: float = 0.6) -> DataFrame:
    """Pairs (a, b) of set keys, a star per bucket and group of sets in it whose signatures are alike: linear in the
    bucket, yet it connects every pair that was found.

    A bucket is split no further if it has at most `small` sets, or if at least the share `alike` of the bucket above
    came along: then its sets are alike, and it is compared in pieces. Buckets of equal members are compared once."""
    leaves, missed, start = [], Missed(threshold), 0
    while missed.total() > 1 - recall:
        level, depth = _children(reps, threshold, list(range(start, start + per_batch))), 0
        start += per_batch
        while True:
            depth += 1
            level = saved(level)
            sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("members"), F.first("above").alias("above")).where("n > 1")
            done = (F.col("n") <= small) | (F.col("n") >= alike * F.col("above")) | F.lit(depth == deepest)
            shared = saved(level.select("node", "set_key").join(sizes.select("node", "n", "members", done.alias("done")), "node"))  # most sets are alone by now
            leaves.append(shared.where("done").select("node", "set_key", "n", "members"))
            large = shared.where("not done")
            if large.isEmpty():
                break
            level = _children(large.join(reps, "set_key"), threshold)
        missed.runs(per_batch, depth)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    first = out.groupBy("n", "members").agg(F.min("node").alias("node")).select("node")
    return _compare(out.join(first, "node", "left_semi"), reps, threshold, small).distinct()


def _dealt(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows with their group's size n to pairs of pieces (p, q), p <= q, of at most about `most` rows: each pair of rows
    of a group meets in exactly one, except that rows of one piece meet in (p, p) only."""
    pieces = F.ceil(F.col("n") / most).cast("int")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("set_key"), pieces).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), pieces - 1), lambda x: F.struct(F.least(F.col("piece"), x).alias("p"), F.greatest(F.col("piece"), x).alias("q")))
    return rows.withColumn("pq", F.explode(pairs)).select("*", "pq.p", "pq.q").drop("pq", "n")


def _stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray, keys: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """A spanning star per connected group of the links left x right (indices into keys)."""
    root = np.arange(len(keys))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(linked.any(1)):
        a = find(left[i])
        for j in np.flatnonzero(linked[i]):
            b = find(right[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                a = min(a, b)
    pairs = [(keys[i], keys[r]) for i in range(len(keys)) if (r := find(i)) != i]
    return [x for x, _ in pairs], [y for _, y in pairs]


def _compare(shared: DataFrame, reps: DataFrame, threshold: float, small: int) -> DataFrame:
    """Brute force within buckets, on signatures: 3.5 standard deviations below the threshold count as alike."""
    least = np.ceil(COORDINATES * (threshold - 3.5 * np.sqrt(threshold * (1 - threshold) / COORDINATES)))

    def alike(key: tuple, table: pa.Table) -> pa.Table:
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        keys, piece, n = table["set_key"].to_pylist(), table["piece"].to_numpy(), table["n_set"].to_numpy().astype(np.float64)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        left, right = np.flatnonzero(piece == p), np.flatnonzero(piece == q)
        linked = np.zeros((len(left), len(right)), dtype=bool)
        for i, x in enumerate(left):
            near = (np.minimum(n[right], n[x]) >= threshold * np.maximum(n[right], n[x]) - 1e-9) & (right != x)
            at = np.flatnonzero(near)
            linked[i, at] = (sig[right[at]] == sig[x]).sum(1) >= least
        a, b = _stars(linked, left, right, keys)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    own = shared.join(reps.select("set_key", "n_set", "sig"), "set_key")
    return _dealt(own, ["node"], small).groupBy("node", "p", "q").applyInArrow(alike, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its connected component) for all nodes of edges (a, b).

    Each round every node takes the least label among its neighbours' and then its label's label (pointer jumping),
    so rounds grow with the logarithm of a component's width. Tables of labels stay in the cluster; only the number of
    changes comes to the driver.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("root").alias("before"), F.least("root", "least").alias("root"))
        jump = step.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = saved(step.join(jump, F.col("root") == F.col("via")).select("node", "before", F.least("root", "far").alias("root")))
        labels = step.select("node", "root")
        if step.where("before != root").isEmpty():
            return labels


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The exact sets of the wanted (id, text_hash, set_key, ...): all columns of wanted and `shingles`, sorted."""
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("text"))
    rows = texts.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))).select("set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in batches:
            for begin, end, h, lens in doc_words(batch, "text", hasher, 300_000):
                s, n = shingles(h, lens)
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], pa.array([np.unique(x).tobytes() for x in np.split(s, np.cumsum(n)[:-1])], pa.binary())], names=["set_key", "shingles"])

    return rows.mapInArrow(run, "set_key binary, shingles binary").dropDuplicates(["set_key"])


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from 0/1 matrices of the shingles that both sides have, a slice of them at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, len(common), 4096):
        part = common[begin : begin + 4096]
        sides = []
        for values, rows, n in ((a, ra, len(left)), (b, rb, len(right))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            x = np.zeros((n, len(part)), dtype=np.float32)
            x[rows[hit], at[hit]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _verify(clusters: DataFrame, threshold: float, most: int) -> DataFrame:
    """Rows (cluster, set_key, copies, shingles, n) to a, n_links and b: exact links within each cluster, counted per
    set with copies; b, where not null, is a set that a is connected to."""

    def exact(key: tuple, table: pa.Table) -> pa.Table:
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        keys, piece, copies = table["set_key"].to_pylist(), table["piece"].to_numpy(), table["copies"].to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets], dtype=np.float64)
        left, right = np.flatnonzero(piece == p), np.flatnonzero(piece == q)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.binary()), "n_links": pa.array([], pa.int64()), "b": pa.array([], pa.binary())})
        inter = _intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
        linked = inter >= threshold * (n[left][:, None] + n[right][None, :] - inter) - 1e-9
        if p == q:
            linked &= left[:, None] != right[None, :]
        links = np.zeros(len(keys), dtype=np.int64)
        links[left] += linked @ copies[right]
        if p != q:
            links[right] += copies[left] @ linked
        a, b = _stars(linked, left, right, keys)
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array([*(keys[i] for i in some), *a], pa.binary()), "n_links": pa.array([*links[some].tolist(), *[0] * len(a)], pa.int64()), "b": pa.array([*[None] * len(some), *b], pa.binary())})

    return _dealt(clusters, ["cluster"], most).groupBy("cluster", "p", "q").applyInArrow(exact, "a binary, n_links bigint, b binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.99, small: int = 2048, most: int = 512) -> DataFrame:
    """One row per row of docs: id, text_hash, class_id, n_links, class_size, keeper_hash.

    Linked are rows whose sets of 5-word shingles have a Jaccard similarity of `threshold` or more; a class is a
    connected group of links, class_id its least id, n_links how many other rows a row is linked to (all of them,
    copies included), keeper_hash the text hash of the row of class_id. Equal sets are found by their 128-bit digest
    and go on as one; a text of 1 to 4 words is one shingle. Sets that the chosen-path join brings together form candidate
    clusters, within which every pair is checked on the exact sets, in pieces of at most about `most` sets (16 MB of
    them): only counts and stars leave a task, never pairs. Texts without words (or null) link to nothing. Null ids are larger
    than others; repeated rows are copies; other columns are ignored; an empty table gives an empty one.
    """
    rows = saved(signed(docs, id_col, text_col))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("text_hash"))
    reps = rows.where("set_key is not null").groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("least"), F.first("n_set").alias("n_set"), F.first("sig").alias("sig"))
    reps = saved(reps)
    stars = saved(candidate_stars(reps, threshold, recall, small))
    clusters = components(stars)
    wanted = saved(reps.join(clusters, F.col("set_key") == F.col("node")).select("set_key", "copies", "least.id", "least.text_hash", "n_set", F.col("root").alias("cluster")))
    # a piece has about `most` sets, or fewer where they are long: 16 MB of shingles
    sizes = wanted.groupBy("cluster").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum(F.col("n_set").cast("long")) * most / (1 << 21))).alias("n"))
    sets = _sets(docs, wanted.select("id", "text_hash", "set_key"), id_col, text_col)
    found = saved(_verify(sets.join(wanted.select("set_key", "copies", "cluster"), "set_key").join(sizes, "cluster"), threshold, most))
    links = found.groupBy("a").agg(F.sum("n_links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    own = reps.select("set_key", "copies", "least").join(links, F.col("set_key") == F.col("a"), "left").join(roots, F.col("set_key") == F.col("node"), "left")
    own = saved(own.select("set_key", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_key").alias("root")))
    classes = own.groupBy("root").agg(F.min("least").alias("keeper"), F.sum("copies").alias("class_size"))
    of_set = own.join(classes, "root").select("set_key", "keeper", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    joined = rows.select("id", "text_hash", "set_key").join(of_set, "set_key", "left")
    alone = F.col("keeper").isNull()
    return joined.select(
        F.col("id").alias(id_col), "text_hash", F.when(alone, F.col("id")).otherwise(F.col("keeper.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.when(alone, F.col("text_hash")).otherwise(F.col("keeper.text_hash")).alias("keeper_hash"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that are near-duplicates of another that stays: of each class the row of least id.

    Rows that are equal in id and text count as one; null and empty texts are like nothing, so they stay; null ids are
    larger than others; of one id and class the least text hash stays. All columns are kept, whatever they are called; an
    empty table gives an empty one.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where("class_size > 1").where(~F.col(id_col).eqNullSafe(F.col("class_id")) | (F.col("text_hash") != F.col("keeper_hash")))
    gone = saved(gone.select(F.col(id_col).alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct())
    names = [f"_c{i}" for i in range(len(docs.columns))]  # whatever docs' columns are called
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col(id_col).alias("_own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_own_hash"))
    kept = keyed.join(gone, F.col("_own").eqNullSafe(F.col("_gone")) & (F.col("_own_hash") == F.col("_gone_hash")), "left_anti").dropDuplicates(["_own", "_own_hash"])
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
