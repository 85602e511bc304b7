"""Token counts of whole documents, however long, by overlap resynchronisation."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loam.llm.common import SPACES, as_binary

#: Fixed value: a published pattern of pre-tokens, none of which holds white space.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORKER: dict[str, Encoder] = {}


@dataclass
class Stretch:
    """The library's encoding of text[start:end]: token ids, their first and last character in the whole text, and
    whether a token is the first of a pre-token."""

    start: int
    end: int
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def at(self, place: int) -> int:
        """The first token of the pre-token that begins at a place."""
        hit = np.flatnonzero(self.first & (self.begins == place))
        return int(hit[0]) if len(hit) else -1


def parts_at_spaces(file: dict) -> bool:
    """Whether a tokenizer file encodes each word `[^\\x20\\x09-\\x0D]+` for itself, whatever stands around it.

    Files known to do so: their normalizers look at a character and its combining marks (ASCII white space takes part in
    no composition) or at a run of white space; pre-tokens are what matches `SPACELESS`, which looks neither ahead nor
    back, and the rest is left out; merging stays within a pre-token; no special string holds white space.
    """

    def steps(x: dict | None, key: str) -> list[dict]:
        return [] if x is None else x[key] if x["type"] == "Sequence" else [x]

    normalizers, splits = steps(file["normalizer"], "normalizers"), steps(file["pre_tokenizer"], "pretokenizers")
    known = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in normalizers)
    known &= splits[:1] == [{"type": "Split", "pattern": {"Regex": SPACELESS}, "behavior": "Removed", "invert": True}]
    known &= all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p.get("use_regex", True) for p in splits[1:])
    known &= file["model"]["type"] == "BPE" and not file["model"].get("dropout")
    return known and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or set(a["content"]) & set(SPACES) for a in file["added_tokens"])


class Encoder:
    """A tokenizer file of the tokenizers library, without added begin and end, truncation and padding.

    If the file parts at spaces, the library's ids of up to most_words words are kept, and dropped when there are more.
    """

    def __init__(self, path: str, most_words: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Characters before a cut end of which nothing is believed: more than a special string or a pattern looks ahead.
        self.margin = max(64, 2 * max(special, default=0))
        with open(path, encoding="utf-8") as f:
            self.by_word = parts_at_spaces(json.load(f))
        self.most_words = most_words
        self.known: dict[bytes, bytes] = {}  # a word's ids, four bytes each

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of whole texts; if the file parts at spaces, a word that is known is not encoded again."""
        if not self.by_word:
            return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words = [t.encode().split() for t in texts]
        new = set(chain.from_iterable(words)).difference(self.known)
        if len(self.known) + len(new) > self.most_words:
            self.known.clear()
            new = set(chain.from_iterable(words))
        self._learn(list(new))
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), dtype=np.int32) for ws in words]
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return ids

    def _learn(self, words: list[bytes], at_once: int = 4096) -> None:
        for i in range(0, len(words), at_once):
            some = words[i : i + at_once]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, dtype=np.int32).tobytes()

    def stretch(self, text: str, start: int, end: int) -> Stretch:
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + start
        # a special string's token is of no word, and one of its own
        word = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
        first = np.r_[True, (word[1:] != word[:-1]) | (word[1:] < 0)][: len(word)]
        return Stretch(start, end, np.array(e.ids, dtype=np.int64), at[:, 0], at[:, 1], first)


def common_boundary(left: Stretch, right: Stretch, since: int, margin: int) -> tuple[int, int] | None:
    """Tokens (of left, of right) at which both begin the same pre-token, after left's token `since`.

    Left's tokens are the whole text's, but for its last `margin` characters. A pre-tokenizer reads from left to right,
    so once both begin a pre-token at one place they go on alike, whatever stood before: such a place is a proven
    boundary. It has to be behind right's first pre-token, which the cut may have made, and all tokens from there to the
    believed end of left have to be equal, with their offsets.
    """
    stable = int(np.searchsorted(left.ends, left.end - margin, side="right"))
    mine = np.flatnonzero(left.first[:stable])
    mine = mine[mine > since]
    theirs = np.flatnonzero(right.first)
    theirs = theirs[right.begins[theirs] > right.start]
    _, a, b = np.intersect1d(left.begins[mine], right.begins[theirs], return_indices=True)
    fails = -1
    for i, j in zip(mine[a].tolist(), theirs[b].tolist(), strict=True):
        if i <= fails:
            continue
        n = min(stable - i, len(right.ids) - j)
        differ = (left.ids[i : i + n] != right.ids[j : j + n]) | (left.begins[i : i + n] != right.begins[j : j + n]) | (left.ends[i : i + n] != right.ends[j : j + n])
        if n and not differ.any() and j:
            return i, j
        fails = i + int(np.flatnonzero(differ)[-1]) if differ.any() else i
    return None


def splice(encoder: Encoder, text: str, chunk: int, overlap: int) -> tuple[np.ndarray, int, int]:
    """Token ids of one long text, the number of chunks encoded, and how often an overlap had to be widened.

    A chunk begins `overlap` characters before the end of the one before. The two are spliced at a common boundary in
    the overlap. Without one the overlap doubles backwards; when it has taken all of the left chunk that is not yet
    spliced, the left chunk itself is encoded anew at twice its length, at last to the end of the text.
    """
    n, parts, chunks, widened = len(text), [], 1, 0
    left, since, place = encoder.stretch(text, 0, min(n, chunk + overlap)), 0, 0
    width = overlap
    while left.end < n:
        begin = left.end - width
        if begin > place:
            right = encoder.stretch(text, begin, min(n, left.end + chunk))
            chunks += 1
            cut = common_boundary(left, right, since, encoder.margin)
            if cut is not None:
                parts.append(left.ids[since : cut[0]])
                place, left, since, width = int(left.begins[cut[0]]), right, cut[1], overlap
            else:
                width, widened = width * 2, widened + 1
            continue
        left = encoder.stretch(text, left.start, min(n, left.end + max(chunk, left.end - left.start)))
        chunks, widened, width = chunks + 1, widened + 1, overlap
        since = left.at(place) if place else 0
        if since < 0:
            raise ValueError("a boundary moved: the tokenizer does not read from left to right")
    parts.append(left.ids[since:])
    return np.concatenate(parts), chunks, widened


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 10, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit, n_chunks, n_widened, and ids if asked for.

    The tokenizer is a .json file of the tokenizers library. A text of up to chunk_chars is one chunk, and short ones go
    to the library in batches, word by word where the file parts at spaces (see `Encoder.encode`); longer ones are
    encoded in overlapping chunks with offsets that are spliced where both encodings provably agree (see `splice`). A text without any boundary, such as one word of megabytes, ends up as one
    chunk. No shuffle: texts stay where they were read.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; a null id stays null; other
    columns are ignored; empty gives empty. Special strings in a text become the tokenizer's special tokens, as is its
    default; bytes that are no UTF-8 count as the replacement character.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens")), T.StructField("over_limit", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_chunks", "n_widened"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _WORKER:
            _WORKER[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _WORKER[tokenizer_path]
        for batch in batches:
            texts, rows = as_binary(batch.column(1)), []
            held: list[tuple[int, str]] = []
            size = 0

            def flush(rows=rows, held=held) -> None:
                for (n_bytes, _), ids in zip(held, encoder.encode([t for _, t in held]), strict=True):
                    rows.append((n_bytes, len(ids), 1, 0, ids if with_ids else None))
                held.clear()

            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                text = raw.decode("utf-8", "replace")
                if len(text) <= chunk_chars:
                    held.append((len(raw), text))
                    size += len(text)
                    if size < 200_000:
                        continue
                flush()
                size = 0
                if len(text) > chunk_chars:
                    ids, chunks, widened = splice(encoder, text, chunk_chars, overlap_chars)
                    rows.append((len(raw), len(ids), chunks, widened, ids if with_ids else None))
            flush()
            n_bytes, n_tokens, chunks, widened, ids = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(chunks, pa.int64()), pa.array(widened, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(encode, T.StructType(fields))
