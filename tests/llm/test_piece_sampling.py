import time
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from loam.llm import piece_sampling
from loam.llm.piece_sampling import SPACE, Lattice, decode_pieces, row_seeds, sample_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  spaces ", "Hello, world!\nline\n\n x", "tab\tff\x0cnul\x00", "▁ literal ▁▁ A▁b", "naïve 東京 🙂 𝔘 Ａ ﬁ", "a" * 300, "日本" * 40, "x " * 3000, "longunit" * 20 + "\n" + "é" * 70, "¿ɸ" * 30]


def brute(lattice, unit):
    """All segmentations of a unit with their probabilities."""
    spelled = lattice.spelled(unit)
    out = {}

    def walk(at, ids, w):
        if at == len(unit):
            out[tuple(ids)] = out.get(tuple(ids), 0) + np.exp(w)
            return
        for end in range(at + 1, len(unit) + 1):
            if x := lattice.weight.get(unit[at:end]):
                walk(end, [*ids, x[0]], w + x[1])
        if spelled[at]:
            walk(at + 1, [*ids, int(lattice.byte_id[unit[at]])], w + lattice.rare)

    walk(0, [], 0.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_distribution_is_exact():
    lattice = Lattice(PATH, 1.0)
    for word in ("theon", "été", "a▁", "   in", "    "):
        want = brute(lattice, SPACE + word.encode().replace(b" ", SPACE))
        n = 40_000
        ids, sizes = lattice.sample([word.encode()] * n, row_seeds(list(range(n)), 5))
        at = np.r_[0, np.cumsum(sizes)]
        got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
        assert set(got) <= set(want)
        rng = np.random.default_rng(0)
        slow = Counter(tuple(lattice.long_unit(SPACE + word.encode().replace(b" ", SPACE), lambda k: rng.random(len(k))).tolist()) for _ in range(4000))
        for k, p in want.items():
            assert abs(got[k] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4
            assert abs(slow[k] / 4000 - p) < 5 * np.sqrt(p * (1 - p) / 4000) + 1e-3


def test_pieces_of_several_spaces_are_drawn():
    lattice = Lattice(PATH, 1.0)
    spaces = {i for i, raw in enumerate(lattice.bytes) if len(raw) > 1 and not raw.strip(SPACE)}
    assert len(spaces) == 14
    ids, _ = lattice.sample([b"    if x:\n        y" + b" " * 16 + b"z"] * 3000, row_seeds(list(range(3000)), 1))
    assert spaces & set(ids.tolist())


def test_long_units_agree_with_short_ones(monkeypatch):
    """The same lattice, worked on one by one: a unit's edges, and that a unit of 300 kB takes seconds."""
    lattice = Lattice(PATH, 1.0)
    for word in ("theon", "日本é🙂x", "  in", "¿ɸ"):
        unit = SPACE + word.encode().replace(b" ", SPACE)
        begin, end, piece, _ = lattice.edges(unit)
        spelled, want = lattice.spelled(unit), set()
        for a in range(len(unit)):
            for b in range(a + 1, len(unit) + 1):
                if x := lattice.weight.get(unit[a:b]):
                    want.add((a, b, x[0]))
            if spelled[a]:
                want.add((a, a + 1, int(lattice.byte_id[unit[a]])))
        assert set(zip(begin.tolist(), end.tolist(), piece.tolist())) == want
    text = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(60_000)).encode() + b"ab" * 60_000
    began = time.process_time()
    ids, n = lattice.sample([text], row_seeds([1], 1))
    assert lattice.decode(ids) == text and n[0] == len(ids)
    assert time.process_time() - began < 8


def test_lossless_and_reproducible(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, rows[4], (None, "null key", "x")], "doc_id long, text string, n_pieces string")
    got = sample_pieces(docs, PATH, keep=True)
    assert got.columns == ["doc_id", "text", "n_pieces", "lossless", "piece_ids"]
    first = got.collect()
    assert len(first) == len(rows) + 2 and all(r.lossless and r.n_pieces == len(r.piece_ids) for r in first)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in first:
        if "▁" not in (r.text or ""):
            assert model.decode(r.piece_ids) == (r.text or "")
    again = sample_pieces(docs.repartition(5), PATH, keep=True).collect()
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in again) == Counter((r.doc_id, tuple(r.piece_ids)) for r in first)
    other = sample_pieces(docs, PATH, seed=2).collect()
    assert any(a.piece_ids != b.piece_ids for a, b in zip(first, other))
    back = decode_pieces(got.drop("text"), PATH).collect()
    assert [r.text for r in back] == [r.text or "" for r in first]
    assert sample_pieces(docs.limit(0), PATH).collect() == []


def test_digests(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = sample_pieces(docs, PATH, digest=True).first()
    assert r.lossless and len(r.ids_sha256) == 64
    assert piece_sampling.SHORT < 100
