import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.bpe_tree import LEAF, NEXT_LEAF, Bpe, bpe_round_trip
from loam.llm.queries import op13_bpe_tree

PATH = public_tokenizers.path("byte_bpe_50k.json")
BPE = Bpe(PATH)
TEXTS = [None, "", " \n\t", "Hello, World! it's 12 o'clock", "A<|endoftext|>B <|endoftext|> <|ENDOFTEXT|>", "é京🙂 nb sp", "東京都" * 700, "x1y22z" * 900, "lorem ipsum dolor, " * 500, " " * 3000 + "a", "a" * 5000, "=" * 4000 + "<|endoftext|>" + "ab" * 3000]


def direct(text):
    return BPE.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("leaf", "spread"), [(1 << 15, 1 << 20), (300, 1 << 20), (40, 200), (1000, 1000)])
def test_ids_are_the_librarys(spark, leaf, spread):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] * 2 + [(None, "twice twice " * 60, "", "")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _key string")
    got = bpe_round_trip(docs, PATH, leaf_chars=leaf, spread_chars=spread).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        text = "twice twice " * 60 if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == direct(text) and r.n_tokens == len(r.ids) and r.decoded == text
        assert r.n_pieces >= len(text) / leaf


def test_query_gives_the_contracts_digests(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in op13_bpe_tree(spark, str(tmp_path)).collect():
        ids = direct(TEXTS[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(TEXTS[r.doc_id] or ""))


def test_empty_table_and_other_files(spark):
    assert bpe_round_trip(spark.createDataFrame([], "doc_id string, text string"), PATH).collect() == []
    with pytest.raises(ValueError, match="byte-level"):
        Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_every_code_point_is_the_librarys():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 1 << 16):
        texts = ["".join(f"a{c}b {c}1{c} " for c in points[k : k + 64]) for k in range(begin, min(begin + (1 << 16), len(points)), 64)]
        for text, e in zip(texts, BPE.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert BPE.text(text) == e.ids


def test_join_grows_to_where_both_agree():
    r, grown = random.Random(1), 0
    for alphabet in ("ab", "=-", "aeinrst", "é京x", "a"):
        text = "".join(r.choice(alphabet) for _ in range(4000))
        for at in r.sample(range(1, 4000), 40):
            ids, n = BPE.join(BPE.unsplit(text[:at].encode()), BPE.unsplit(text[at:].encode()), first=1)
            assert ids == BPE.unsplit(text.encode())
            grown += n
    assert grown > 20


def test_five_megabytes_without_a_boundary():
    r = random.Random(2)
    text = "".join(r.choice("abcdefghétaoin") for _ in range(3_000_000)) + "x1,;" * 500_000
    kinds = [k for *_, k in BPE.cut(text, 1 << 15)]
    assert kinds.count(LEAF) == 1 and kinds.count(NEXT_LEAF) > 80
    ids, n, _ = BPE.encode(text, 1 << 15)
    assert n == len(kinds) and ids == direct(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", " ", "re", "'s", "'", "\n", "\t", "é", "京", "🙂", "12", ".,", "==", "<|endoftext|>", "e t", "́", " ", "the quick", "İΣ"]), max_size=120).map("".join), st.integers(2, 60))
def test_any_text_any_leaf(text, leaf):
    ids, *_ = BPE.encode(text, leaf)
    assert ids == direct(text)
    spans = list(BPE.cut(text, leaf))
    assert "".join(text[a:b] for a, b, _ in spans) == text and all(b - a <= leaf or text[a:b] == "<|endoftext|>" for a, b, _ in spans)
