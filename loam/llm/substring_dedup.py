"""Remove word sequences that stand earlier in the corpus: a compacted De Bruijn graph of repeated token k-mers.

Every 20-word window is an edge between two nodes, its first and its last 19 words. Nodes are dealt to buckets by the
least hash of their 8-word parts (their minimizer), so all edges of a node meet in its bucket, and neighbouring nodes
mostly travel as one piece. Minimizers that occur once belong to no repeated node: they are found first, and only
pieces of the others are exchanged. A bucket finds the repeated edges, where each stands first, the degrees of its
nodes, and fragments: edges that follow one another at their source through nodes with one edge in and one out.
Fragments of different buckets are glued to nonbranching paths by joins on their end nodes. What repeats is then laid
along its path, span by span, and every span's words are compared with the words at its source before they are cut.
"""

from __future__ import annotations

import hashlib
import re
import shutil
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import MIX, SortedArrays, WordHash, as_binary, bucket_rows, buckets_for, doc_words, finish, new_folder, rolling, save_arrays, saved, stored
from loam.shared import removed, scratch

K = 20
NODE = K - 1
M = 8
#: Words that a task works on at a time: what bounds its memory.
SLICE = 200_000
#: A minimizer that this many slices hold is hot: its nodes are dealt by their own hash instead, so that a bucket holds
#: a few hundred bytes of at most so many slices for each of its minimizers.
HOT_SLICES = 4096
_LAST = (1 << 63) - 1
_OPEN: dict[str, SortedArrays] = {}


def least(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each `width` consecutive values, the first of equals."""
    at = np.arange(len(g))
    size = 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at = np.where(g[b] < g[a], b, a)
        size *= 2
    if rest := width - size:
        a, b = at[: len(at) - rest], at[rest:]
        at = np.where(g[b] < g[a], b, a)
    return at


def nodes_of(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node of a document with an edge: the document's index, the node's start in the words, the position of its
    minimizer; and a number for each M-word part (least hashes lie near 0, so they are spread once more)."""
    g = rolling(h, M)
    if len(h) < K:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, g
    at = least(g, NODE - M + 1)
    doc = np.repeat(np.arange(len(lens)), lens)
    start = np.flatnonzero((doc[: len(h) - NODE + 1] == doc[NODE - 1 :]) & (lens[doc[: len(h) - NODE + 1]] >= K))
    return doc[start], start, at[start], finish(g)


def _text_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows of equal id apart: their text's hash, or nothing (0) where no id comes twice."""
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return F.lit(0).cast("long") if repeated < 2 else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _row_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """docs and a whole number that orders its rows as their ids do, nulls last; rows of equal id have the same.

    A number for ids that are whole numbers; other ids are sorted once, their place is joined back (a shuffle of the
    texts)."""
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if whole:
        top = docs.agg(F.max(id_col).alias("most"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
        if not (top.nulls and top.most == _LAST):
            return docs, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    ids = docs.select(F.col(id_col).alias("_ranked")).where("_ranked is not null").distinct().repartitionByRange("_ranked").sortWithinPartitions("_ranked")
    ranks = saved(ids.withColumn("_rank", F.monotonically_increasing_id()))
    joined = docs.join(ranks, F.col(id_col) == F.col("_ranked"), "left")
    return joined, F.coalesce(F.col("_rank"), F.lit(_LAST))


def _repeated_minimizers(rows: DataFrame, folder: str, n_buckets: int) -> None:
    """Write the hashes of all minimizers that occur twice or more in the corpus, as sorted arrays; hot: 1 for those
    that many slices hold."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(150_000)
        for batch in batches:
            for _, _, h, lens in doc_words(batch, "text", hasher, SLICE):
                _, _, at, g = nodes_of(h, lens)
                keys, n = np.unique(g[np.unique(at)], return_counts=True)
                out = [(b, keys[s].tobytes(), np.packbits(n[s] > 1).tobytes()) for b, s in bucket_rows(keys, n_buckets)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary()), "twice": pa.array([x[2] for x in out], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts, twice = [], []
        for keys, more in zip(table["keys"].to_pylist(), table["twice"].to_pylist(), strict=True):
            parts.append(np.frombuffer(keys, dtype=np.uint64))
            twice.append(np.unpackbits(np.frombuffer(more, dtype=np.uint8), count=len(parts[-1])).astype(bool))
        k, more = np.concatenate(parts), np.concatenate(twice)
        order = np.argsort(k, kind="stable")
        k, more = k[order], more[order]
        new = np.flatnonzero(np.r_[len(k) > 0, k[1:] != k[:-1]][: len(k)])
        slices = np.diff(np.r_[new, len(k)])
        again = (slices > 1) | (np.add.reduceat(more, new) > 0 if len(new) else False)
        save_arrays(folder, "minimizer", key[0].as_py(), k[new][again], hot=(slices[again] >= HOT_SLICES).astype(np.uint8))
        return pa.table({"n": pa.array([int(again.sum())], pa.int64())})

    found = rows.mapInArrow(gather, "bucket long, keys binary, twice binary").groupBy("bucket").applyInArrow(merge, "n bigint")
    found.agg(F.sum("n")).collect()  # one number


#: What buckets say: 0 a run of repeated edges that stand earlier; 1 a fragment; 2 where the edges of a piece stand that
#: had equals in its slice; 3 a stretch of pieces that equals a stretch of another text of the slice; 4 a piece of the
#: latter; 5 a run of edges that goes round: it equals what stands in the same text so few words before that both overlap
#: or touch.
_SAID = ("kind", "id", "text_hash", "start", "n", "src_id", "src_hash", "src_start", "head", "at", "left", "right")
_SAID_DDL = ", ".join(f"{c} {'int' if c == 'kind' else 'bigint'}" for c in _SAID)
_PIECE_COLUMNS = {"ids": np.int64, "texts": np.int64, "starts": np.int32, "sizes": np.uint8, "nodes": np.uint64}


def graph(docs: DataFrame, key: Column, text_key: Column, text_col: str) -> DataFrame:
    """What all buckets say (see _SAID), written once. A run of edges names its first edge's place and its source's;
    the others follow both. head: where the fragment begins at the source; left, right: a fragment's end nodes; at (1):
    1 if the left one has one edge in and one out; at (2): the run's first edge within its piece.

    In each slice equal pieces are exchanged once, and neighbours that equal neighbours are one stretch: a passage that
    every document holds costs its pieces once per slice, and a row per document. A text that goes round (two words in
    turns, say) has a row for all rounds but the first, not one per round.
    """
    rows = docs.select(key.alias("_id"), text_key.alias("_hash"), F.col(text_col).alias("text"))
    spark, n_buckets = docs.sparkSession, buckets_for(docs)
    folder = new_folder(spark, "minimizers")
    _repeated_minimizers(rows, folder, n_buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(150_000)
        if folder not in _OPEN:
            _OPEN.clear()
            _OPEN[folder] = SortedArrays(folder, "minimizer", {"hot": np.uint8}, n_buckets)
        index = _OPEN[folder]
        for batch in batches:
            for begin, end, h, lens in doc_words(batch, "text", hasher, SLICE):
                doc, start, at, g = nodes_of(h, lens)
                own, where = np.unique(g[at], return_inverse=True)
                there, values = index.find(own)
                keep = there[where]
                if keep.any():
                    ids, texts = (batch.column(c).to_numpy()[begin:end] for c in (0, 1))
                    yield _pieces_out(h, lens, doc[keep], start[keep], at[keep], g, values["hot"][where][keep] > 0, ids, texts, n_buckets)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        parts = []
        for kind, column in ((3, "equals"), (4, "leads"), (5, "rounds")):
            found = [np.frombuffer(x, dtype=np.int64).reshape(-1, 7) for x in table[column].to_pylist() if x is not None]
            parts += [_said(kind, *x.T) for x in found]
        table = table.filter(table["ids"].is_valid())
        if table.num_rows:
            parts += _settle(*(np.concatenate([np.frombuffer(x, dtype=t) for x in table[c].to_pylist()]) for c, t in _PIECE_COLUMNS.items()))
        return pa.concat_tables(parts) if parts else _said(0, np.zeros(0, np.int64))

    names = ", ".join(f"{c} binary" for c in (*_PIECE_COLUMNS, "equals", "leads", "rounds"))
    said = stored(rows.mapInArrow(emit, f"bucket long, {names}").groupBy("bucket").applyInArrow(settle, _SAID_DDL), "graph")
    shutil.rmtree(folder, ignore_errors=True)
    return said


def _runs(*breaks: np.ndarray) -> np.ndarray:
    """Where runs begin, given for each row but the first whether one does."""
    new = breaks[0]
    for x in breaks[1:]:
        new = new | x
    return np.flatnonzero(np.r_[True, new])


def _pieces_out(h: np.ndarray, lens: np.ndarray, doc: np.ndarray, start: np.ndarray, at: np.ndarray, g: np.ndarray, hot: np.ndarray, ids: np.ndarray, texts: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Runs of neighbouring nodes with one minimizer as pieces, each with the node before and behind it (0 for none);
    of equal ones the first, and the others as references to it: a row per stretch of others that follow one another as
    the first ones do, and the pieces of every stretch referred to once. What goes round in a text refers to the round
    before, a row for all of them."""
    node = np.maximum(rolling(h, NODE), np.uint64(1))
    head = _runs(start[1:] != start[:-1] + 1, at[1:] != at[:-1], doc[1:] != doc[:-1], hot[1:] | hot[:-1])
    n = np.diff(np.r_[head, len(start)])
    first, own = start[head], doc[head]
    offset = np.r_[0, np.cumsum(lens)[:-1]]
    before, behind = first > offset[own], first + n + NODE <= offset[own] + lens[own]
    lo = np.where(before, node[np.maximum(first - 1, 0)], np.uint64(0))
    hi = np.where(behind, node[np.minimum(first + n, len(node) - 1)], np.uint64(0))
    # the first and last node and their neighbours hold all words of a piece
    key = np.zeros(len(head), dtype=np.uint64)
    for part in (lo, node[first], node[first + n - 1], hi, n.astype(np.uint64)):
        key = finish(key * MIX + part)
    local, i, t = first - offset[own], ids[own], texts[own]
    order = np.lexsort((local, t, i, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    place = (i[lead] == i[order]) & (local[lead] == local[order])
    new |= place & (t[lead] != t[order])  # another text of the same id: sent as well
    same = np.r_[False, (key[order][1:] == key[order][:-1]) & (i[order][1:] == i[order][:-1]) & (t[order][1:] == t[order][:-1])]
    twice = same & np.r_[False, local[order][1:] == local[order][:-1]]  # an equal row: what holds for the first holds for it
    other = ~new & ~place & ~twice
    again = np.zeros(len(head), dtype=bool)
    again[lead[other]] = True
    rounds, in_rounds = _rounds(*_by_place(order[other & same], order[np.flatnonzero(other & same) - 1]), own, first, n, i, t, local)
    other &= ~np.isin(order, in_rounds)
    x, y = _by_place(order[other], lead[other])
    equals, leads = _stretches(x, y, own, first, n, i, t, local)
    chosen = order[new]
    minimizer = g[at[head]]
    deal = np.where(hot[head], finish(node[first] ^ minimizer), minimizer)
    chosen = chosen[np.argsort(deal[chosen], kind="stable")]
    out = []
    for b, s in bucket_rows(deal[chosen], n_buckets):
        o = chosen[s]
        size = n[o] + 2
        index = np.repeat(first[o] - 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat = node[np.clip(index, 0, len(node) - 1)]
        ends = np.cumsum(size)
        flat[ends - size], flat[ends - 1] = lo[o], hi[o]
        out.append((b, i[o].tobytes(), t[o].tobytes(), local[o].astype(np.int32).tobytes(), (n[o] | again[o] << 7).astype(np.uint8).tobytes(), flat.tobytes(), None, None, None))
    if len(some := equals if len(equals) else rounds):
        any_bucket = finish(some[:1, 0].astype(np.uint64) * MIX + some[:1, 2].astype(np.uint64))[0] % np.uint64(n_buckets)
        out.append((int(any_bucket), *[None] * 5, equals.tobytes(), leads.tobytes(), rounds.tobytes()))
    names = ["bucket", *_PIECE_COLUMNS, "equals", "leads", "rounds"]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary() if k else pa.int64()) for k in range(9)], names=names)


def _by_place(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(x)
    return x[o], y[o]


def _rounds(x: np.ndarray, y: np.ndarray, own: np.ndarray, first: np.ndarray, n: np.ndarray, i: np.ndarray, t: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces x, in order of their places, that equal pieces y before them in the same text: those that follow one
    another at one distance from theirs, if they are as long as it, so that they go round. A row per such run (id, text,
    start and number of nodes, and id, text and start of what it equals), and its pieces. All nodes have an edge out, as
    those of y have."""
    if not len(x):
        return np.zeros((0, 7), np.int64), x
    far = local[x] - local[y]
    begin = _runs((own[x][1:] != own[x][:-1]) | (first[x][1:] != first[x][:-1] + n[x][:-1]), far[1:] != far[:-1])
    pieces, size = np.diff(np.r_[begin, len(x)]), np.add.reduceat(n[x], begin)
    round_ = size >= far[begin]
    a, b = x[begin[round_]], y[begin[round_]]
    return np.stack([i[a], t[a], local[a], size[round_], i[b], t[b], local[b]], axis=1), x[np.repeat(round_, pieces)]


def _stretches(x: np.ndarray, y: np.ndarray, own: np.ndarray, first: np.ndarray, n: np.ndarray, i: np.ndarray, t: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces x, in order of their places, that equal pieces y, as stretches in which both go on: id, text, start and
    number of nodes of the stretch, and id, text and start of what it equals; and for each that is referred to the same
    of every piece: its id, text and start, the stretch's number of nodes, id, text and start."""
    if not len(x):
        return np.zeros((0, 7), np.int64), np.zeros((0, 7), np.int64)
    apart = np.zeros(len(x) - 1, dtype=bool)
    for z in (x, y):
        apart |= (own[z][1:] != own[z][:-1]) | (first[z][1:] != first[z][:-1] + n[z][:-1])
    begin = _runs(apart)
    pieces = np.diff(np.r_[begin, len(x)])
    size = np.add.reduceat(n[x], begin)
    a, b = x[begin], y[begin]
    equals = np.stack([i[a], t[a], local[a], size, i[b], t[b], local[b]], axis=1)
    # a stretch that several equal: its pieces once
    chosen = np.unique(np.stack([b, size]), axis=1, return_index=True)[1]
    of = np.repeat(chosen, pieces[chosen])
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces[chosen]) - pieces[chosen], pieces[chosen])
    piece, head = y[begin[of] + k], b[of]
    leads = np.stack([i[piece], t[piece], local[piece], size[of], i[head], t[head], local[head]], axis=1)
    return equals, leads


def _said(kind: int, *columns: np.ndarray) -> pa.Table:
    n = len(columns[0])
    filled = [np.full(n, kind, np.int32), *(np.ascontiguousarray(c).astype(np.int64, copy=False) for c in columns)]
    filled += [np.zeros(n, np.int64)] * (len(_SAID) - len(filled))
    return pa.table(dict(zip(_SAID, map(pa.array, filled), strict=True)))


def _edges(a: np.ndarray, b: np.ndarray, ids: np.ndarray, start: np.ndarray, texts: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges a -> b in order of their nodes, then their places: that order, the number of each one's edge, and whether
    an edge stands at two places or more."""
    order = np.lexsort((texts, start, ids, b, a))
    a, b, i, s = a[order], b[order], ids[order], start[order]
    new = np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    edge = np.cumsum(new) - 1
    place = new | np.r_[False, (i[1:] != i[:-1]) | (s[1:] != s[:-1])][: len(a)]
    n = int(new.sum())
    return order, edge, (np.bincount(edge, place, n) > 1) | (np.bincount(edge, again[order], n) > 0)


def _settle(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> list[pa.Table]:
    """Of a bucket's pieces: runs of edges that stand earlier, fragments, and where the edges of pieces with equals stand."""
    n, again = (sizes & 0x7F).astype(np.int64), (sizes >> 7).astype(bool)
    piece = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(n + 2) - n - 2)[piece] + 1 + j
    node, before, after = nodes[at], nodes[at - 1], nodes[at + 1]
    start, i, t, more = starts[piece].astype(np.int64) + j, ids[piece], texts[piece], again[piece]
    # edges into this bucket's nodes: their number only
    into = before != 0
    order, edge, repeated = _edges(node[into], before[into], i[into], start[into], t[into], more[into])
    known = np.unique(node)
    heads = np.flatnonzero(np.diff(edge, prepend=-1))
    entries = np.bincount(np.searchsorted(known, node[into][order][heads][repeated]), minlength=len(known))
    # edges out of them are this bucket's own
    out = np.flatnonzero(after != 0)
    order, edge, repeated = _edges(node[out], after[out], i[out], start[out], t[out], more[out])
    order, keep = out[order], repeated[edge] if len(edge) else np.zeros(0, bool)
    heads = order[np.flatnonzero(np.diff(edge, prepend=-1))]  # where each edge stands first
    exits = np.bincount(np.searchsorted(known, node[heads][repeated]), minlength=len(known))
    plain = (entries == 1) & (exits == 1)
    # fragments: edges in the order of their sources
    rep = heads[repeated]
    if not len(rep):
        return []
    rep = rep[np.lexsort((start[rep], t[rep], i[rep]))]
    a, open_left = rep[1:], plain[np.searchsorted(known, node[rep])]
    begin = _runs((i[a] != i[rep[:-1]]) | (t[a] != t[rep[:-1]]), start[a] != start[rep[:-1]] + 1, ~open_left[1:])
    length = np.diff(np.r_[begin, len(rep)])
    first, last = rep[begin], rep[begin + length - 1]
    none = np.zeros(len(begin), np.int64)
    tables = [_said(1, none, none, none, length, i[first], t[first], start[first], start[first], open_left[begin], node[first].view(np.int64), after[last].view(np.int64))]
    head_of = np.zeros(len(node), dtype=np.int64)
    head_of[rep] = np.repeat(start[first], length)
    # every place of a repeated edge, with the edge's first
    place, src = order[keep], heads[edge[keep]]
    other = (i[place] != i[src]) | (start[place] != start[src])
    x, y = place[other], src[other]
    o = np.lexsort((start[x], t[x], i[x]))
    x, y = x[o], y[o]
    if len(x):
        b = _runs((i[x][1:] != i[x][:-1]) | (t[x][1:] != t[x][:-1]), start[x][1:] != start[x][:-1] + 1, *_source_breaks(i, t, start, head_of, y))
        tables.append(_said(0, i[x[b]], t[x[b]], start[x[b]], np.diff(np.r_[b, len(x)]), i[y[b]], t[y[b]], start[y[b]], head_of[y[b]]))
    mine = more[place]
    x, y = place[mine], src[mine]
    o = np.lexsort((j[x], piece[x]))
    x, y = x[o], y[o]
    if len(x):
        b = _runs(piece[x][1:] != piece[x][:-1], *_source_breaks(i, t, start, head_of, y))
        tables.append(_said(2, i[x[b]], t[x[b]], starts[piece[x[b]]], np.diff(np.r_[b, len(x)]), i[y[b]], t[y[b]], start[y[b]], head_of[y[b]], j[x[b]]))
    return tables


def _source_breaks(i: np.ndarray, t: np.ndarray, start: np.ndarray, head_of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the source's line, or its fragment, ends."""
    a, b = y[1:], y[:-1]
    return i[a] != i[b], t[a] != t[b], start[a] != start[b] + 1, head_of[a] != head_of[b]


def nonbranching_paths(said: DataFrame, rounds: int = 40) -> DataFrame:
    """Each fragment (src_id, src_hash, head, n) with its path and its edges' place on it (path_at, of the first).

    A fragment follows the one whose right node is its left node, if that has one edge in and one out: a join on nodes.
    Followers that continue the same source line are joined to it by a window over the line; what follows across
    sources by doubling: each round joins every line with the one it points to, so n lines take log n rounds. Lines on
    a cycle never reach a beginning: each stays a path of its own.
    """
    f = said.where("kind = 1").select("src_id", "src_hash", "head", "n", "left", "right", F.col("at").alias("open"))
    ends = f.select(F.col("right").alias("_node"), F.col("src_id").alias("_pi"), F.col("src_hash").alias("_ph"), F.col("head").alias("_ps"), (F.col("head") + F.col("n")).alias("_pe"))
    linked = f.join(ends, (F.col("open") == 1) & (F.col("left") == F.col("_node")), "left")
    goes_on = (F.col("_pi") == F.col("src_id")) & (F.col("_ph") == F.col("src_hash")) & (F.col("_pe") == F.col("head"))
    line = Window.partitionBy("src_id", "src_hash").orderBy("head")
    linked = linked.withColumn("_line", F.last(F.when(F.coalesce(~goes_on, F.lit(True)), F.col("head")), ignorenulls=True).over(line))
    name = lambda i, h, s: F.xxhash64(i, h, s)
    linked = stored(linked.withColumn("_name", name("src_id", "src_hash", "_line")).withColumn("_own", name("src_id", "src_hash", "head")).withColumn("_before", F.when(~goes_on, name("_pi", "_ph", "_ps"))).select("src_id", "src_hash", "head", "n", "_line", "_name", "_own", "_before"), "lines")
    # a line: its name, and the line before it with the edges up to there
    lines = linked.where("head = _line").select("_name", "_before")
    before = linked.select(F.col("_own").alias("_before"), F.col("_name").alias("_to"), (F.col("head") + F.col("n") - F.col("_line")).alias("_far"))
    lines = saved(lines.where("_before is not null").join(before, "_before").select("_name", "_to", "_far").dropDuplicates(["_name"]))
    done = None
    for _ in range(rounds):
        step = lines.select(F.col("_name").alias("_to"), F.col("_to").alias("_to2"), F.col("_far").alias("_far2"))
        joined = saved(lines.join(step, "_to", "left").select("_name", F.coalesce("_to2", "_to").alias("_to"), (F.col("_far") + F.coalesce("_far2", F.lit(0))).alias("_far"), F.col("_to2").isNull().alias("_done")))
        still = joined.agg(F.count_if(~F.col("_done")).alias("n")).first().n
        lines = joined.drop("_done")
        if not still or still == done:  # only cycles are left
            lines = joined.where("_done").drop("_done")
            break
        done = still if (done is None or still < done) else done
    out = linked.join(lines, "_name", "left")
    return out.select("src_id", "src_hash", "head", "n", F.coalesce("_to", "_name").alias("path"), (F.col("head") - F.col("_line") + F.coalesce("_far", F.lit(0))).alias("path_at"))


_PLACE = ("src_id", "src_hash", "src_start", "path", "path_at")


def repeated_pieces(said: DataFrame) -> DataFrame:
    """Runs of repeated edges: id, text_hash, start, n, each of which stands earlier too, at src_id, src_hash, src_start;
    and on which path, from where (null for what goes round in its text: it stands a round earlier)."""
    paths = nonbranching_paths(said).select(F.col("src_id").alias("_i"), F.col("src_hash").alias("_h"), F.col("head").alias("_s"), "path", "path_at")
    found = said.where("kind in (0, 2)").join(paths, (F.col("src_id") == F.col("_i")) & (F.col("src_hash") == F.col("_h")) & (F.col("head") == F.col("_s")))
    found = stored(found.select("kind", "id", "text_hash", "start", "n", "at", "src_id", "src_hash", "src_start", "path", (F.col("path_at") + F.col("src_start") - F.col("head")).alias("path_at")), "pieces")
    own = found.where("kind = 0").select("id", "text_hash", "start", "n", *_PLACE)
    # what stands where in a stretch that others equal, once, then laid onto each of these: a join on the stretch
    where = found.where("kind = 2").select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"), F.col("start").alias("_s"), F.col("n").alias("_n"), "at", *_PLACE)
    named = ["_ri", "_rh", "_rs", "_rn"]
    stretch = [F.col(c).alias(a) for c, a in zip(("src_id", "src_hash", "src_start", "n"), named, strict=True)]
    leads = said.where("kind = 4").select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"), F.col("start").alias("_s"), *stretch).distinct()
    inside = leads.join(where, ["_i", "_h", "_s"]).select(*named, (F.col("_s") + F.col("at") - F.col("_rs")).alias("start"), F.col("_n").alias("n"), *_PLACE).distinct()
    inside = _glued(inside, named).groupBy(*named).agg(F.collect_list(F.struct(F.col("start").alias("from"), F.col("n").alias("long"), *_PLACE)).alias("_runs"))
    equal = said.where("kind = 3").select("id", "text_hash", "start", *stretch).join(inside, named)
    equal = equal.select("id", "text_hash", "start", F.explode("_runs").alias("r")).select("id", "text_hash", (F.col("start") + F.col("r.from")).alias("start"), F.col("r.long").alias("n"), *(f"r.{c}" for c in _PLACE))
    # what goes round has no path: it stands a round earlier, whichever path that is on
    rounds = said.where("kind = 5").select("id", "text_hash", "start", "n", "src_id", "src_hash", "src_start", *(F.lit(None).cast("long").alias(c) for c in ("path", "path_at")))
    return own.unionByName(equal).unionByName(rounds)


def _glued(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (start, n and their source) that go on where the one before them ends, here, at the source and on the path,
    as one; per keys."""
    line = Window.partitionBy(*keys).orderBy("start", "src_id", "src_start")
    goes_on = F.lit(True)
    for c in ("start", "src_start", "path_at"):
        goes_on &= F.lag(F.col(c) + F.col("n")).over(line) == F.col(c)
    for c in ("src_id", "src_hash", "path"):
        goes_on &= F.lag(c).over(line) == F.col(c)
    glued = pieces.withColumn("_new", F.coalesce(~goes_on, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.min(c).alias(c) for c in ("start", *_PLACE)]
    return glued.groupBy(*keys, "_span").agg(*first, F.sum("n").alias("n")).select(*keys, "start", "n", *_PLACE)


def repeated_spans(said: DataFrame) -> DataFrame:
    """What stands earlier, laid along the nonbranching paths: id, text_hash, start, n (edges), src_id, src_hash,
    src_start, path, path_at. Words start .. start + n + 18 also stand at the source, along one path (null: a round
    earlier in the same text)."""
    return _glued(repeated_pieces(said), ["id", "text_hash"])


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words stand in a repeated window."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(n, starts + lengths + NODE), -1)
    return np.cumsum(change[:n]) > 0


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _lists(column: pa.ListArray) -> Iterator[list[np.ndarray]]:
    """The fields of each row's structs as arrays; empty ones for null."""
    offsets, flat = column.offsets.to_numpy(), column.values
    fields = [flat.field(k).to_numpy() for k in range(flat.type.num_fields)]
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for i, ok in enumerate(there):
        own = slice(offsets[i], offsets[i + 1]) if ok else slice(0, 0)
        yield [f[own] for f in fields]


_CLAIM = pa.struct([("src_id", pa.int64()), ("src_hash", pa.int64()), ("src_start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_FACT = pa.struct([("start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_CHECKS = "_claims array<struct<src_id: bigint, src_hash: bigint, src_start: bigint, n: bigint, digest: binary>>, _facts array<struct<start: bigint, n: bigint, digest: binary>>"


def _cut(docs: DataFrame, key: Column, text_key: Column, text_col: str, spans: DataFrame, judge: Callable, columns: list[T.StructField]) -> DataFrame:
    """judge(rows' columns, words per row, covered words per row) for rows with their spans; one shuffle of the texts.

    Every span's words are digested where they are cut and where they come from, in the same pass
    (_claims and _facts), so that `_verified` can compare them."""
    own = spans.select("id", "text_hash", F.struct("start", "n", "src_id", "src_hash", "src_start").alias("_span"), F.lit(None).cast("struct<start: bigint, n: bigint>").alias("_ask"))
    asked = spans.select(F.col("src_id").alias("id"), F.col("src_hash").alias("text_hash"), F.lit(None).cast(own.schema["_span"].dataType).alias("_span"), F.struct(F.col("src_start").alias("start"), "n").alias("_ask"))
    per = own.unionByName(asked).groupBy("id", "text_hash").agg(F.collect_list("_span").alias("_spans"), F.collect_set("_ask").alias("_asked"))
    names = [f"_c{i}" for i in range(len(columns))]  # whatever docs' columns are called
    rows = docs.select(*(F.col(f"`{c.name}`").alias(n) for c, n in zip(columns, names, strict=True)), key.alias("_id"), text_key.alias("_hash"), F.col(text_col).alias("_text"))
    joined = rows.join(per, (F.col("_id") == F.col("id")) & (F.col("_hash") == F.col("text_hash")), "left").select(*names, "_id", "_hash", "_text", "_spans", "_asked")
    kinds, ddl = judge.fields, T.StructType([*(T.StructField(n, c.dataType) for n, c in zip(names, columns, strict=True)), T.StructField("_id", T.LongType()), T.StructField("_hash", T.LongType()), *judge.fields, *T._parse_datatype_string(_CHECKS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(names)
            texts, claims, facts, out = as_binary(batch.column(at + 2)), set(), [], []
            for i, ((starts, lengths, *src), (ask, ask_n)) in enumerate(zip(_lists(batch.column(at + 3)), _lists(batch.column(at + 4)), strict=True)):
                text = texts[i].as_py()
                words = (text or b"").split()
                claims.update((a, b, c, n, _digest(words[s : s + n + NODE])) for s, n, a, b, c in zip(starts.tolist(), lengths.tolist(), *(x.tolist() for x in src), strict=True))
                facts.append([{"start": s, "n": n, "digest": _digest(words[s : s + n + NODE])} for s, n in zip(ask.tolist(), ask_n.tolist(), strict=True)])
                out.append(judge(text, words, _covered(len(words), starts, lengths) if len(starts) else None))
            made = zip(*out, strict=True) if out else [()] * len(kinds)
            arrays = [judge.array(x, k) for k, x in enumerate(made)]
            # what the batch claims, once, with its first row
            said = [[dict(zip(("src_id", "src_hash", "src_start", "n", "digest"), c, strict=True)) for c in claims], *[[]] * (batch.num_rows - 1)][: batch.num_rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 2], *arrays, pa.array(said, pa.list_(_CLAIM)), pa.array(facts, pa.list_(_FACT))], names=[f.name for f in ddl])

    return joined.mapInArrow(run, ddl)


class _Report:
    """n_words, n_removed, kept_sha256 of a row."""

    fields = [T.StructField("_n", T.LongType()), T.StructField("_m", T.LongType()), T.StructField("_d", T.StringType())]

    def __call__(self, text: bytes | None, words: list[bytes], gone: np.ndarray | None) -> tuple:
        kept = words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    def array(self, values: tuple, k: int) -> pa.Array:
        return pa.array(values, pa.string() if k == 2 else pa.int64())


class _Text:
    """The row's text without its repeated words; the white space around the rest stays."""

    fields = [T.StructField("_kept", T.StringType())]
    word = re.compile(rb"[^\x20\x09-\x0D]+\s*")

    def __call__(self, text: bytes | None, words: list[bytes], gone: np.ndarray | None) -> tuple:
        if gone is None:
            return (text,)
        found = [m.span() for m in self.word.finditer(text)]
        lead = text[: found[0][0]]
        return (lead + b"".join(text[a:b] for (a, b), x in zip(found, gone.tolist(), strict=True) if not x),)

    def array(self, values: tuple, k: int) -> pa.Array:
        return pa.array(values, pa.binary()).cast(pa.string())


def _verified(docs: DataFrame, id_col: str, text_col: str, judge: Callable, columns: list[T.StructField]) -> DataFrame:
    """The rows of `_cut` once every span that was cut is known to hold at its source. What led to them (arrays, lines,
    pieces, spans) is removed when they are written."""
    with scratch() as made:
        rows, written = _checked(docs, id_col, text_col, judge, columns)
    for path in made[:-1] if written else ():  # the last one holds the rows
        removed(docs.sparkSession, path)
    return rows


def _checked(docs: DataFrame, id_col: str, text_col: str, judge: Callable, columns: list[T.StructField]) -> tuple[DataFrame, bool]:
    """Rows, and whether they are written: if hashes collide within single windows too, they are yet to be made."""
    docs, key = _row_keys(docs, id_col)
    text_key = _text_key(docs, id_col, text_col)
    spans = stored(repeated_spans(graph(docs, key, text_key, text_col)), "spans")
    where = ["src_id", "src_hash", "src_start", "n"]
    for windows in (True, False):
        out = stored(_cut(docs, key, text_key, text_col, spans, judge, columns), "cut")
        claims = out.select(F.explode("_claims").alias("c")).select("c.*").distinct()
        facts = out.select(F.col("_id").alias("src_id"), F.col("_hash").alias("src_hash"), F.explode("_facts").alias("f")).select("src_id", "src_hash", F.col("f.start").alias("src_start"), "f.n", F.col("f.digest").alias("fact"))
        wrong = saved(claims.join(facts, where, "left").where("fact is null or fact <> digest").select(*where).distinct())
        if wrong.isEmpty():
            return out, True
        # hashes collided: the windows of these spans are compared one by one, and those that differ stay
        held = spans.join(wrong, where, "left_anti")
        each = spans.join(wrong, where, "left_semi").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({c: F.col(c) + F.col("_k") for c in ("start", "src_start", "path_at")} | {"n": F.lit(1).cast("long")}).drop("_k")
        spans = stored(held.unionByName(each), "spans") if windows else held
    return _cut(docs, key, text_key, text_col, spans, judge, columns), False


def dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A word goes if a window of 20 words that covers it stands earlier too: in a document of smaller id, or earlier in
    the same one. Windows are judged on the input. Ids may be of any type that Spark orders. Null texts have no words;
    null ids are the largest; rows of equal id are the same document, and equal rows keep or lose the same words; other
    columns are ignored, whatever they are called; empty gives empty.
    """
    out = _verified(docs.select(id_col, text_col), id_col, text_col, _Report(), [docs.schema[id_col]])
    return out.select(F.col("_c0").alias(id_col), F.col("_n").alias("n_words"), F.col("_m").alias("n_removed"), F.col("_d").alias("kept_sha256"))


def dedup_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with repeated words cut out of the text (white space around the rest stays), and chars_col, if there is
    one, counted anew.

    Rows that lose nothing are returned as they were; none is dropped, also not those that lose all words. Null texts
    stay null; null ids are the largest; repeated rows are cut alike; other columns are kept, whatever they are called;
    empty gives empty."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    out = _verified(docs, id_col, text_col, _Text(), others)
    place = {f.name: F.col(f"_c{i}") for i, f in enumerate(others)} | {text_col: F.col("_kept")}
    if chars_col in place:
        place[chars_col] = F.when(F.col("_kept").isNull(), place[chars_col]).otherwise(F.char_length("_kept")).cast(docs.schema[chars_col].dataType)
    return out.select(*(place[c].alias(c) for c in docs.columns))
