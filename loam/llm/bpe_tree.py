"""Byte-pair encoding and decoding of whole documents, long ones by tree concatenation."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import as_binary

#: Fixed value: the published pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space between two Latin letters: whatever stands around it, no pre-token reaches over it.
BOUNDARY = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ɏ]) (?=[A-Za-zÀ-ÖØ-öø-ɏ])")
#: What a piece of a long text is: text that is encoded for itself, or the first or a further leaf of one long pre-token.
TEXT, LEAF, NEXT_LEAF = 0, 1, 2
#: Characters before a cut end whose pre-tokens are not believed: more than the pattern looks ahead.
MARGIN = 4
_WORKER: dict[str, Bpe] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level file of the tokenizers library whose merges stand in the order of their tokens' ids.

    The library decodes and finds pre-tokens. Merging follows the same ranks in tiktoken, which takes a third of the
    time; the tests hold it against the library over every code point.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before, letters = file["model"], file["pre_tokenizer"] or {}, _byte_letters()
        vocab, added = model["vocab"], file["added_tokens"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        plain = model["type"] == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")) and not file["normalizer"]
        plain &= before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        plain &= not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        ids = [vocab[m] for m in merges]
        if not plain or ids != sorted(ids) or len(set(ids)) + 256 != len(set(vocab) - {a["content"] for a in added}):
            raise ValueError(f"not a plain byte-level file with merges in the order of ids: {path}")
        special = {a["content"]: a["id"] for a in added}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.merger = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def text(self, text: str) -> list[int]:
        return self.merger.encode(text, allowed_special="all")

    def unsplit(self, piece: bytes) -> list[int]:
        """Tokens of bytes that lie within one pre-token."""
        return self.merger._encode_single_piece(piece) if piece else []

    def decode(self, rows: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(rows, skip_special_tokens=False)

    def join(self, left: Sequence[int], right: Sequence[int], first: int = 8) -> tuple[list[int], int]:
        """The tokens of two neighbouring stretches of one pre-token as one, and how often the window grew.

        The last tokens of left and the first of right are encoded anew as one. If that begins with left's own token and
        ends with right's own, it replaces them; a side that differs is doubled, at last to all of it. This is exact:
        merging by rank gives a sequence of tokens if and only if it gives each pair of neighbours for the pair alone, and
        then all pairs are pairs of left's, of the window's or of right's encoding.
        """
        a, b, grown = first, first, 0
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            own = [*left[len(left) - a :], *right[:b]]
            window = self.unsplit(b"".join(map(self.bytes_of.__getitem__, own)))
            fits_left = a == len(left) or window[0] == own[0]
            fits_right = b == len(right) or window[-1] == own[-1]
            if fits_left and fits_right:
                return [*left[: len(left) - a], *window, *right[b:]], grown
            a, b, grown = a if fits_left else 2 * a, b if fits_right else 2 * b, grown + 1

    def tree(self, leaves: list[list[int]]) -> tuple[list[int], int]:
        """Neighbours are joined, level by level, until one is left."""
        grown = 0
        while len(leaves) > 1:
            above = []
            for k in range(0, len(leaves) - 1, 2):
                both, n = self.join(leaves[k], leaves[k + 1])
                above.append(both)
                grown += n
            leaves = above + leaves[len(leaves) & ~1 :]
        return leaves[0], grown

    def _segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Special strings, and what stands between them."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield at, m.start(), False
            yield *m.span(), True
            at = m.end()
        yield at, len(text), False

    def cut(self, text: str, leaf: int) -> Iterator[tuple[int, int, int]]:
        """(begin, end, kind) of the pieces of a text, of up to `leaf` characters each (a special string is one), in order.

        Cuts are at special strings, at proven boundaries, else where the library's pre-tokenizer parts what follows the
        last cut; a pre-token longer than a leaf is cut anywhere, and its leaves have to be joined by `tree`."""
        for s, e, special in self._segments(text):
            while e - s > leaf and not special:
                if found := BOUNDARY.search(text, s + leaf // 2, s + leaf):
                    yield s, found.start(), TEXT
                    s = found.start()
                    continue
                width, ends = leaf, []
                while not ends:
                    end = min(e, s + width)
                    ends = [b for _, (_, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text[s:end]) if end == e or b <= end - s - MARGIN]
                    width *= 2
                if ends[0] > leaf:
                    for k in range(0, ends[0], leaf):
                        yield s + k, s + min(ends[0], k + leaf), NEXT_LEAF if k else LEAF
                    s += ends[0]
                else:
                    yield s, s + (cut := max(b for b in ends if b <= leaf)), TEXT
                    s += cut
            if s < e:
                yield s, e, TEXT

    def piece(self, text: str, kind: int) -> list[int]:
        return self.text(text) if kind == TEXT else self.unsplit(text.encode())

    def whole(self, parts: Iterable[tuple[int, list[int]]]) -> tuple[list[int], int]:
        """All pieces' tokens, (kind, ids) each, as one, and how often a window grew."""
        out, leaves, grown = [], [], 0

        def close() -> None:
            nonlocal grown
            if leaves:
                ids, n = self.tree(list(leaves))
                out.extend(ids)
                leaves.clear()
                grown += n

        for kind, ids in parts:
            if kind != NEXT_LEAF:
                close()
            if kind == TEXT:
                out.extend(ids)
            else:
                leaves.append(ids)
        close()
        return out, grown

    def encode(self, text: str, leaf: int) -> tuple[list[int], int, int]:
        """Tokens, number of pieces, how often a window grew."""
        if len(text) <= leaf:
            return self.text(text), 1, 0
        parts = list(self.cut(text, leaf))
        ids, grown = self.whole((kind, self.piece(text[a:b], kind)) for a, b, kind in parts)
        return ids, len(parts), grown


def _bpe(path: str) -> Bpe:
    if path not in _WORKER:
        _WORKER[path] = Bpe(path)
    return _WORKER[path]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 1 << 15, spread_chars: int = 1 << 20, batch_chars: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id, n_tokens, n_pieces, n_grown, ids, and decoded, which the ids were decoded to.

    Texts of up to leaf_chars go through in one call, longer ones in pieces (`Bpe.cut`) that are put together again
    (`Bpe.tree` where they lie within one pre-token). Pieces of texts of more than spread_chars are rows of their own, dealt
    over the cluster by text and number, and meet again by text: a task then holds one text's ids. Other texts stay
    where they were read. Special strings within a text become special tokens, as is the library's default.
    Null and empty texts have no tokens and decode to the empty text; repeated rows give repeated rows; a null id stays
    null; other columns are ignored; empty gives empty; bytes that are no UTF-8 count as the replacement character.
    """
    kind = docs.schema[id_col].dataType
    ids_type = T.ArrayType(T.IntegerType())
    fields = [T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_pieces", "n_grown")), T.StructField("ids", ids_type), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def put(keys: pa.Array, done: list[tuple[list[int], int, int]], bpe: Bpe) -> pa.RecordBatch:
        ids = [d[0] for d in done]
        columns = [pa.array([len(i) for i in ids], pa.int64()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)), pa.array(ids, pa.list_(pa.int32())), pa.array(bpe.decode(ids), pa.string())]
        return pa.RecordBatch.from_arrays([keys, *columns], names=names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            raw, begin, size, done = as_binary(batch.column(1)), 0, 0, []
            for i in range(batch.num_rows):
                text = raw[i].as_py().decode("utf-8", "replace")
                done.append(bpe.encode(text, leaf_chars))
                size += len(text)
                if size >= batch_chars or i == batch.num_rows - 1:
                    yield put(batch.column(0).slice(begin, len(done)), done, bpe)
                    begin, size, done = i + 1, 0, []

    parts = T.StructType([T.StructField(id_col, kind), T.StructField("_key", T.BinaryType()), T.StructField("_no", T.LongType()), T.StructField("_kind", T.IntegerType()), T.StructField("_piece", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            for i, raw in enumerate(as_binary(batch.column(1))):
                text, key = (data := raw.as_py()).decode("utf-8", "replace"), hashlib.sha256(data).digest()
                for no, (a, b, what) in enumerate(bpe.cut(text, leaf_chars)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([key], pa.binary()), pa.array([no], pa.int64()), pa.array([what], pa.int32()), pa.array([text[a:b]], pa.string())], names=parts.fieldNames())

    encoded = T.StructType([*parts.fields[:4], T.StructField("_copies", T.LongType()), T.StructField("_ids", ids_type)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = bpe.piece(batch.column(4)[i].as_py(), batch.column(3)[i].as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in (0, 1, 2, 3, 5)), pa.array([ids], pa.list_(pa.int32()))], names=encoded.fieldNames())

    def meet(table: pa.Table) -> pa.Table:
        bpe, table = _bpe(tokenizer_path), table.sort_by("_no").combine_chunks()
        own = ((k.as_py(), i.as_py()) for k, i in zip(table["_kind"], table["_ids"], strict=True))
        row = (*bpe.whole(own),)
        one = put(table[id_col].combine_chunks().slice(0, 1), [(row[0], table.num_rows, row[1])], bpe)
        return pa.concat_tables([pa.Table.from_batches([one])] * table["_copies"][0].as_py())

    size = F.length("_text")
    pieces = rows.where(size > spread_chars).mapInArrow(cut, parts)
    # the shuffle that deals pieces also counts repeated rows, so that a text's pieces meet once
    once = pieces.groupBy(id_col, "_key", "_no", "_kind").agg(F.first("_piece").alias("_piece"), F.count(F.lit(1)).alias("_copies"))
    far = once.mapInArrow(encode, encoded).groupBy(id_col, "_key").applyInArrow(meet, T.StructType(fields))
    return rows.where(size <= spread_chars).mapInArrow(near, T.StructType(fields)).unionByName(far)
