"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the lattice of pieces.

A text is a space followed by its characters. Pieces of the model hold spaces only in front (one before letters, or
nothing but a run of them), so the lattice falls apart before every run of spaces, and around every line feed (which no
piece holds): units. A model with other pieces is refused. A unit's segmentation is drawn with the
probability that the product of its pieces' weights has among all segmentations. The model has ranks, not
probabilities; a piece of rank r weighs (r + 10)^-theta (Zipf's law). Characters that are no piece are
spelled in byte pieces, as is a literal U+2581, which the library turns into a space: decoding is lossless.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loam.llm.common import as_binary, finish

#: Stands for a space within units: no UTF-8 text holds this byte.
SPACE = b"\xff"
UNIT = re.compile(rb"\xff*[^\xff\n]+|\xff+|\n")
_OPEN: dict[tuple[str, float], Lattice] = {}
_B = np.uint64(0x100000001B3)
_STEP = np.uint64(0x9E6C63D0876A9A47)
#: Units up to so many bytes are worked on side by side; longer ones one by one.
SHORT = 40


def _first_bytes(text: bytes) -> list[bool]:
    return [c & 0xC0 != 0x80 for c in text]


class Lattice:
    """The pieces of a model file, ready to be looked up by their bytes."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weight: dict[bytes, tuple[int, float]] = {}
        self.byte_id = np.zeros(256, dtype=np.int32)
        self.bytes: list[bytes] = []
        usable = []
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            elif model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            else:
                raw = model.id_to_piece(i).encode("utf-8").replace("▁".encode(), SPACE)
                self.bytes.append(raw)
                if b"\n" in raw or raw.lstrip(SPACE).find(SPACE) >= 0:
                    raise ValueError(f"piece {i} holds a line feed, or a space behind other characters")
                usable.append((i, raw))
        rank = {i: r for r, (i, _) in enumerate(sorted(usable))}
        n = len(usable)
        total = np.log(((np.arange(n) + 10.0) ** -theta).sum())
        self.rare = float(-theta * np.log(n + 10.0) - total)
        for i, raw in usable:
            self.weight[raw] = (i, float(-theta * np.log(rank[i] + 10.0) - total))
        self.longest = max(map(len, self.weight))
        if self.longest > SHORT:
            raise ValueError(f"a piece is longer than {SHORT} bytes")
        self.single = np.array([len(x) for x in self.bytes])
        #: of each length, the sorted hashes of the pieces, with ids and weights
        self.tables = {}
        for size in range(1, self.longest + 1):
            own = [(x, i, w) for x, (i, w) in self.weight.items() if len(x) == size]
            if own:
                h = np.array([self._hash(x) for x, _, _ in own], dtype=np.uint64)
                order = np.argsort(h)
                self.tables[size] = h[order], np.array([i for _, i, _ in own], dtype=np.int32)[order], np.array([w for _, _, w in own])[order]

    @staticmethod
    def _hash(x: bytes) -> int:
        h = 0
        for c in x:
            h = (h * int(_B) + c + 1) % (1 << 64)
        return h

    def spelled(self, unit: bytes) -> list[bool]:
        """Which bytes belong to characters that are no piece, so that byte pieces are allowed for them."""
        out, i = [], 0
        while i < len(unit):
            j = i + 1
            while j < len(unit) and unit[j] & 0xC0 == 0x80:
                j += 1
            out += [unit[i:j] not in self.weight] * (j - i)
            i = j
        return out

    def edges(self, unit: bytes) -> tuple[np.ndarray, ...]:
        """All edges of one unit's lattice in the order of their ends: begin, end, piece, weight."""
        text = np.frombuffer(unit, dtype=np.uint8)
        n = len(text)
        first = (text & 0xC0) != 0x80
        char_end = np.r_[first[1:], True]
        known, found = np.zeros(n, dtype=bool), []
        h = np.zeros(n, dtype=np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            h = h[: n - k + 1] * _B + text[k - 1 :].astype(np.uint64) + np.uint64(1)
            if k not in self.tables:
                continue
            hashes, ids, weights = self.tables[k]
            at = np.flatnonzero(first[: n - k + 1] & char_end[k - 1 :])
            place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            hit = hashes[place] == h[at]
            at, place = at[hit], place[hit]
            found.append((at, at + k, ids[place], weights[place]))
            if k <= 4:
                known[at[~np.any([first[at + j] for j in range(1, k)], axis=0)] if k > 1 else at] = True
        # the character that a byte belongs to begins at or before it
        spelled = np.flatnonzero(~known[np.maximum.accumulate(np.where(first, np.arange(n), 0))])
        found.append((spelled, spelled + 1, self.byte_id[text[spelled]], np.full(len(spelled), self.rare)))
        begin, end, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, end))
        return begin[order], end[order], piece[order], weight[order]

    def long_unit(self, unit: bytes, draw) -> np.ndarray:
        """One unit of any length, in time and memory proportional to it. draw(k): the random numbers of an array k."""
        begin, end, piece, weight = self.edges(unit)
        n = len(unit)
        alpha = array("d", [0.0]) + array("d", [-math.inf]) * n
        exp, log1p = math.exp, math.log1p
        for s in range(0, len(begin), 1 << 16):
            t = slice(s, s + (1 << 16))
            for b, e, w in zip(begin[t].tolist(), end[t].tolist(), weight[t].tolist(), strict=True):
                x, a = alpha[b] + w, alpha[e]
                if x > a:
                    alpha[e] = x if a == -math.inf else x + log1p(exp(a - x))
                elif x > -math.inf:
                    alpha[e] = a + log1p(exp(x - a))
        cuts = np.searchsorted(end, np.arange(1, n + 2))
        out, at, k, drawn = array("i"), n, 0, []
        while at:
            if k % 4096 == 0:
                drawn = draw(np.arange(k, k + 4096)).tolist()
            left, base = drawn[k % 4096], alpha[at]
            for j in range(int(cuts[at - 1]), int(cuts[at])):
                score = alpha[begin[j]]
                if score > -math.inf:
                    chosen = j
                    left -= exp(score + weight[j] - base)
                    if left < 0:
                        break
            out.append(int(piece[chosen]))
            at, k = int(begin[chosen]), k + 1
        return np.array(out, dtype=np.int32)[::-1]

    def short_units(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """The lattices of units of up to SHORT bytes, as one table of edges: per node (unit x (SHORT + 1) + offset) its
        edges' cumulated probabilities lie in (node, node + 1]. Returns cumulated, edge's origin, edge's piece."""
        m, width = len(units), max(map(len, units))
        size = np.array([len(u) for u in units])
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), dtype=np.uint8).reshape(m, width)
        inside = np.arange(width) < size[:, None]
        first = (text & 0xC0) != 0x80
        spell = np.zeros((m, width), dtype=bool)
        found = []  # size, unit, begin, piece, weight
        h = np.zeros((m, width), dtype=np.uint64)
        char_end = np.concatenate([first[:, 1:] | ~inside[:, 1:], np.ones((m, 1), bool)], axis=1)
        known = np.zeros((m, width), dtype=bool)  # the character that begins here is a piece
        for k in range(1, min(self.longest, width) + 1):
            h = h[:, : width - k + 1] * _B + text[:, k - 1 :].astype(np.uint64) + np.uint64(1)
            if k not in self.tables:
                continue
            hashes, ids, weights = self.tables[k]
            rows, cols = np.nonzero(inside[:, k - 1 :] & first[:, : width - k + 1] & char_end[:, k - 1 :])
            values = h[rows, cols]
            at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            hit = hashes[at] == values
            rows, cols, at = rows[hit], cols[hit], at[hit]
            found.append((k, rows, cols, ids[at], weights[at]))
            if k <= 4:
                # one character: no other begins within
                one = np.ones(len(rows), dtype=bool)
                for j in range(1, k):
                    one &= ~first[rows, cols + j]
                known[rows[one], cols[one]] = True
        spell[:] = inside & ~np.take_along_axis(known, np.maximum.accumulate(np.where(first, np.arange(width), 0), axis=1), axis=1)
        rows, cols = np.nonzero(spell)
        if len(rows):
            found.append((1, rows, cols, self.byte_id[text[rows, cols]], np.full(len(rows), self.rare)))
        unit = np.concatenate([f[1] for f in found])
        begin = np.concatenate([f[2] for f in found])
        end = np.concatenate([f[2] + f[0] for f in found])
        piece, weight = np.concatenate([f[3] for f in found]), np.concatenate([f[4] for f in found])
        order = np.lexsort((begin, unit, end))
        unit, begin, end, piece, weight = (x[order] for x in (unit, begin, end, piece, weight))
        # forward: all units at once, one offset after another; weights are products of few, so no logarithms needed
        alpha = np.zeros((m, width + 1))
        alpha[:, 0] = 1.0
        mass = np.exp(weight)
        cuts = np.searchsorted(end, np.arange(1, width + 2))
        cum, scale = np.empty(len(unit)), 1e3
        for j in range(1, width + 1):
            a, b = cuts[j - 1], cuts[j]
            if a == b:
                continue
            u = unit[a:b]
            # each byte of an offset is worth a factor, to keep long units from underflowing
            part = alpha[u, begin[a:b]] * mass[a:b] * scale ** (j - begin[a:b])
            alpha[:, j] = np.bincount(u, weights=part, minlength=m)
            run = np.cumsum(part)
            new = np.r_[True, u[1:] != u[:-1]]
            base = np.where(new, run - part, 0)
            base = np.maximum.accumulate(base)
            with np.errstate(invalid="ignore", divide="ignore"):
                cum[a:b] = np.where(alpha[u, j] > 0, (run - base) / alpha[u, j], 1.0)
            last = np.r_[new[1:], True]
            cum[a:b][last] = 1.0
        node = unit * (SHORT + 1) + end
        order = np.lexsort((begin, node))
        node, begin, piece, cum = node[order], begin[order], piece[order], np.minimum(cum[order], 1.0)
        return node + cum, node - end[order] + begin, piece

    def sample(self, texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after another, and how many each has. The k-th draw of a unit is a hash of the
        text's seed, the unit's number in the text and k: whatever the texts are batched with, the ids are the same."""
        index: dict[bytes, int] = {}
        parts, counts = [], []
        for text in texts:
            units = UNIT.findall(SPACE + text.replace(b" ", SPACE)) if text else []
            parts.append(np.fromiter((index.setdefault(u, len(index)) for u in units), dtype=np.int64, count=len(units)))
            counts.append(len(units))
        counts = np.array(counts, dtype=np.int64)
        occ = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place = np.arange(len(occ)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = finish(np.repeat(seeds, counts) ^ finish(place.astype(np.uint64) * _STEP + np.uint64(1)))
        draw = lambda s, k: (finish(s + np.asarray(k, dtype=np.uint64) * _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        units = list(index)
        length = np.array([len(u) for u in units], dtype=np.int64)
        by_unit = np.argsort(occ, kind="stable")
        first = np.searchsorted(occ[by_unit], np.arange(len(units) + 1))
        order = np.argsort(length, kind="stable")
        order = order[length[order] <= SHORT]
        got: list[tuple[np.ndarray, np.ndarray, int]] = []  # occurrences, pieces, how many come after them
        for c in range(0, len(order), 16384):
            chunk = order[c : c + 16384]
            cum, origin, piece = self.short_units([units[i] for i in chunk])
            where = np.concatenate([by_unit[first[i] : first[i + 1]] for i in chunk])
            n = first[chunk + 1] - first[chunk]
            node = np.repeat(np.arange(len(chunk)) * (SHORT + 1) + length[chunk], n)
            k = 0
            while len(where):
                # u below 1 and cum's last at 1 keep the edge within its node
                edge = np.searchsorted(cum, node + draw(seed[where], k), side="right")
                got.append((where, piece[edge], k))
                node = origin[edge]
                more = node % (SHORT + 1) > 0
                where, node, k = where[more], node[more], k + 1
        size = np.zeros(len(occ), dtype=np.int64)
        for where, _, k in got:
            size[where] = np.maximum(size[where], k + 1)
        long: list[tuple[int, np.ndarray]] = []
        for i in np.flatnonzero(length > SHORT):
            for o in by_unit[first[i] : first[i + 1]].tolist():
                long.append((o, self.long_unit(units[i], lambda k, o=o: draw(seed[o], k))))
                size[o] = len(long[-1][1])
        end = np.cumsum(size)
        out = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.int32)
        for where, piece, k in got:
            out[end[where] - 1 - k] = piece
        for o, ids in long:
            out[end[o] - len(ids) : end[o]] = ids
        ends = np.r_[0, end][np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return out, np.diff(np.r_[0, ends])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text that was encoded."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).replace(SPACE, b" ")[1:]


def lattice(path: str, theta: float) -> Lattice:
    if (path, theta) not in _OPEN:
        _OPEN[path, theta] = Lattice(path, theta)
    return _OPEN[path, theta]


def row_seeds(ids: list, seed: int) -> np.ndarray:
    """A row's seed depends on its key (as text; null is '') and the seed alone."""
    return np.array([xxhash.xxh3_64_intdigest("" if x is None else str(x), seed=seed) for x in ids], dtype=np.uint64)


def sample_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", theta: float = 1.0, seed: int = 1, digest: bool = False, keep: bool = False) -> DataFrame:
    """One row per row of docs: id (or, with keep, all columns), piece_ids, n_pieces, lossless; with digest a SHA-256 of
    the ids (32-bit little-endian) and of the decoded text instead of the ids.

    lossless tells whether decoding the ids gave the text back, byte by byte. Null and empty texts have no pieces; rows
    of equal key and text have equal ids; extra columns are ignored or, with keep, passed on (not those named like a
    result); an empty table gives an empty one.
    """
    made = [T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())]
    made += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest else [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]
    own = [f for f in docs.schema if f.name not in {m.name for m in made}] if keep else [docs.schema[id_col]]
    columns = list(dict.fromkeys([*(f.name for f in own), id_col, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model_path, theta)
        for batch in batches:
            texts = [x or b"" for x in as_binary(batch.column(columns.index(text_col))).to_pylist()]
            seeds = row_seeds(batch.column(columns.index(id_col)).to_pylist(), seed)
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= 6_000_000):
                    size += len(texts[end])
                    end += 1
                ids, n = pieces.sample(texts[begin:end], seeds[begin:end])
                at = np.r_[0, np.cumsum(n)]
                split = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                decoded = list(map(pieces.decode, split))
                out = [pa.array(n, pa.int64()), pa.array([a == b for a, b in zip(decoded, texts[begin:end], strict=True)], pa.bool_())]
                if digest:
                    out += [pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in split]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(f.name))[begin:end] for f in own), *out], names=[f.name for f in [*own, *made]])
                begin = end

    return docs.select(columns).mapInArrow(run, T.StructType([*own, *made]))


def decode_pieces(rows: DataFrame, model_path: str, *, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """rows with text_col decoded from the ids; null ids give null, no ids the empty text."""
    kind = T.StructType([*(f for f in rows.schema if f.name != text_col), T.StructField(text_col, T.StringType())])
    names = [f.name for f in kind][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model_path, 1.0)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = [None if x is None else pieces.decode(np.array(x, dtype=np.int64)) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, text_col])

    return rows.mapInArrow(run, kind)
