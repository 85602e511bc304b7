"""Fill-in-middle training texts: each document's middle moved to its end, behind sentinels.

A pipeline of Arrow columns per slice of a batch: texts become lists of units that share the texts' bytes, flat units
get their row and their ordinal in it, a filter by role leaves the units of one piece, which are joined again row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import as_binary

UNITS = ("char", "word", "line")


def unit_starts(data: np.ndarray, unit: str, before: int | None) -> np.ndarray:
    """Which bytes begin a unit. before: the byte in front, None at a text's begin, where a unit always begins.

    A char is a code point; a word takes the ASCII white space behind it along, a line its newline."""
    prev = np.empty_like(data)
    prev[1:] = data[:-1]
    prev[:1] = 0 if before is None else before
    if unit == "char":
        out = (data & 0xC0) != 0x80
    elif unit == "line":
        out = prev == 10
    else:
        space = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
        out = space(prev) & ~space(data)
    if before is None:
        out[:1] = True
    return out


def unit_lists(texts: pa.Array, unit: str) -> pa.ListArray:
    """Each text's units as a list; the units lie in the texts' own buffer. Texts of one array: 2 GB at most."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[edges[0] : edges[-1]] if whole is not None else np.zeros(0, np.uint8)
    starts = unit_starts(data, unit, None)
    firsts = edges[:-1][edges[:-1] < edges[1:]] - edges[0]
    if unit != "char" and len(firsts):  # what stands in front of a text's first byte belongs to another text
        starts[firsts] = True
    starts[firsts] = True
    at = np.flatnonzero(starts)
    rows = np.searchsorted(at, edges - edges[0]).astype(np.int32)
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at + edges[0], edges[-1]).astype(np.int32)), whole or pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(rows), units)


def pieces(lists: pa.ListArray, base: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each row. A row's units have ordinals from `base` on; the prefix ends before ordinal
    `first`, the middle before `second`."""
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pa.array(np.asarray(lists.offsets)[:-1].astype(np.int64) - base)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), begin.take(parents))
    in_prefix, to_middle = pc.less(ordinal, pa.array(first).take(parents)), pc.less(ordinal, pa.array(second).take(parents))
    n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    a, b = np.clip(first - base, 0, n), np.clip(second - base, 0, n)
    out = []
    for role, counts in ((in_prefix, a), (pc.and_not(to_middle, in_prefix), b - a), (pc.invert(to_middle), n - b)):
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(role)), ""))
    return out


def _slices(text: memoryview, unit: str, size: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, number of units) of slices of a long text, cut where units begin: `size` bytes or one unit each."""
    data, begin = np.frombuffer(text, np.uint8), 0
    while begin < len(data):
        end = min(len(data), begin + size)
        n = int(unit_starts(data[begin:end], unit, int(data[begin - 1]) if begin else None).sum())
        at = end
        while at < len(data):  # to the next begin of a unit
            more = np.flatnonzero(unit_starts(data[at : at + size], unit, int(data[at - 1])))
            if len(more):
                at += int(more[0])
                break
            at = min(len(data), at + size)
        yield begin, at, n
        begin = at


def _rows_of(lens: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most `size` bytes together; a longer row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(lens.tolist()):
        if i > begin and total + n > size:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lens):
        yield begin, len(lens)


def _transformed(texts: pa.Array, h: list[np.ndarray], unit: str, marks: tuple[str, str, str], plain_percent: int, spm_percent: int, size: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of a few rows, or of one long one."""
    raw = texts.cast(pa.binary())
    lens = pc.binary_length(raw).to_numpy()
    if len(texts) == 1 and lens[0] > size:
        long = memoryview(raw[0].as_buffer())
        parts = list(_slices(long, unit, size))
        n = np.array([sum(p[2] for p in parts)])
    else:
        long, lists = None, unit_lists(texts, unit)
        n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    ends = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    plain = (lens == 0) | (h[2] % 100 >= 100 - plain_percent)
    for m in marks:
        plain |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
    spm = pa.array(h[3] % 100 < spm_percent)
    if plain.all():  # nothing to cut
        prefix = middle = suffix = pa.array([""] * len(texts), pa.string())
    elif long is None:
        prefix, middle, suffix = pieces(lists, np.zeros(len(n), np.int64), *ends)
    else:
        cut, base = [], 0
        for begin, end, count in parts:
            one = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, end - begin], np.int32)), pa.py_buffer(long[begin:end]))
            cut.append(pieces(unit_lists(one, unit), np.array([base]), *ends))
            base += count
        joined = lambda xs: pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(xs)], pa.int32()), pa.concat_arrays(xs)), "")
        prefix, middle, suffix = (joined(list(x)) for x in zip(*cut, strict=True))
    p, s, m = (pa.scalar(x) for x in marks)
    moved = pc.binary_join_element_wise(pc.if_else(spm, s, p), pc.if_else(spm, suffix, prefix), pc.if_else(spm, p, s), pc.if_else(spm, prefix, suffix), m, middle, "")
    plain = pa.array(plain)
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), *chars, pc.if_else(plain, texts, moved)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = "char", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), plain_percent: int = 10, spm_percent: int = 20, slice_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix_chars, middle_chars (code points) and output.

    The first four 8-digit groups of the hex SHA-256 of `seed:id` are h1 to h4. The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. Form is plain if the text is empty or holds a mark
    (so that every other output can be taken apart), or if h3 % 100 is among the last plain_percent; otherwise spm for
    spm_percent of h4 % 100, else psm. Outputs: the text; P prefix S suffix M middle; S suffix P prefix M middle.

    Memory of a task: an Arrow batch and the units of slice_bytes; longer texts are cut slice by slice, with ordinals that
    go on. No shuffle. A null text is empty, so plain, with n = 0; a null id draws as the empty string; repeated rows give
    repeated rows; ties (both cuts at one place) leave the middle empty; other columns are ignored; empty gives empty.
    """
    if unit not in UNITS:
        raise ValueError(f"unit has to be one of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"_h{k}") for k in range(4)]
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    names = [f.name for f in fields]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_binary(batch.column(1))
            for a, b in _rows_of(pc.binary_length(raw).to_numpy(), slice_bytes):
                h = [batch.column(2 + k).slice(a, b - a).to_numpy() for k in range(4)]
                own = batch.column(1).slice(a, b - a).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_transformed(own, h, unit, marks, plain_percent, spm_percent, slice_bytes)], names=names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), text.alias("_text"), *draws).mapInArrow(transform, T.StructType(fields))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of `fill_in_middle` was made from. No text that was cut holds a mark, and no mark overlaps
    itself or another, so each mark stands once and parts the pieces."""
    p, s, m = marks

    def part(opening: str, closing: str | None) -> Column:
        begin = F.locate(opening, output) + F.lit(len(opening))
        return F.substr(output, begin) if closing is None else F.substr(output, begin, F.locate(closing, output) - begin)

    middle = part(m, None)
    return F.when(form == "psm", F.concat(part(p, s), middle, part(s, m))).when(form == "spm", F.concat(part(p, m), middle, part(s, p))).otherwise(output)
