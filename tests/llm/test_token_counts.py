import json
import random
import sys
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loam.llm.token_counts import Encoder, parts_at_spaces, splice, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
TEXTS = [None, "", " \n\t", "Hello, World!", "it's 12 o'clock. A<|endoftext|>B <|startoftext|>", "<|ENDOFTEXT|> x", "Ünḯcödé   nb sp İSTANBUL ΟΔΟΣ 東京都", "word. word, end.,", "a" * 5000, ("lorem ipsum DOLOR, " * 4000), "x1y22z" * 900]
ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in FILES}


def direct(text, file="word_bpe_49k.json"):
    return ENCODERS[file].tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_counts_are_the_librarys(spark, file):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2 + [(None, "twice twice", "n")], "doc_id long, text string, n_tokens string")
    for chunk, overlap in ((1 << 15, 1 << 10), (300, 200)):
        rows = token_counts(docs, public_tokenizers.path(file), chunk_chars=chunk, overlap_chars=overlap, limit=100, with_ids=chunk == 300).collect()
        assert len(rows) == 2 * len(TEXTS) + 1
        for r in rows:
            text = "twice twice" if r.doc_id is None else TEXTS[r.doc_id]
            n = len(direct(text, file))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 100)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize(("chunk", "overlap"), [(50, 4), (300, 140), (5000, 200)])
def test_splice_widens_and_agrees(file, chunk, overlap):
    text = ("short words   here\n\n " * 30 + "averyverylongrunwithoutspace" * 400 + " 1 2 3 tail's <|endoftext|>" * 9) * 4
    ids, chunks, widened = splice(ENCODERS[file], text, chunk, overlap)
    assert ids.tolist() == direct(text, file)
    assert chunks > 1 and widened > 0


@pytest.mark.parametrize("file", FILES)
def test_five_megabytes_without_a_space(file):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh12,;é京") for _ in range(5_000_000))
    ids, chunks, widened = splice(ENCODERS[file], text, 1 << 15, 1 << 10)
    assert ids.tolist() == direct(text, file)
    assert chunks > 150 and not widened


def test_one_long_word_is_one_chunk():
    text = "ab" * 300_000 + " and more words" * 4000
    ids, _, widened = splice(ENCODERS["word_bpe_49k.json"], text, 1 << 12, 1 << 9)
    assert ids.tolist() == direct(text) and widened > 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 'stre\n\té́İΣ京🙂12.,<|endoftext|>", min_size=0, max_size=900), st.sampled_from(FILES), st.integers(20, 200), st.integers(1, 150))
def test_any_text_any_cut(text, file, chunk, overlap):
    assert splice(ENCODERS[file], text, chunk, overlap)[0].tolist() == direct(text, file)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_a_known_word_is_not_encoded_again(most):
    encoder, given_texts = Encoder(PATH), []
    encoder.most_words = most
    library = encoder.tokenizer

    class Seen:
        def encode_batch_fast(self, texts, **options):
            given_texts.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Seen()
    rounds = [["Once upon a time, it's 12<|endoftext|>\x0b once\x0c upon " * 50, "a time", "x" * 100 + " é e\u0301", ""]] * 3 + [[f"w{i} upon" for i in range(30)]] * 2
    for texts in rounds:
        assert [len(e) for e in encoder.encode(texts)] == [len(direct(t)) for t in texts]
    if most > 40:
        words = {w for texts in rounds for t in texts for w in t.split()}
        assert sorted(w for w in given_texts if len(w) <= 64) == sorted(w for w in words if len(w) <= 64)
    assert len(encoder.known) <= most and all(len(w) <= 64 for w in encoder.known)


def test_words_part_at_spaces_whatever_stands_there():
    marks = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x300 or unicodedata.combining(chr(c)) or unicodedata.category(chr(c))[0] in "ZC" and c < 0x20000)]
    texts = [f"A{s}".join(marks[i : i + 500]) + s + "".join(marks[i : i + 500]) for i in range(0, len(marks), 500) for s in " \t\n\x0b\x0c\r"]
    encoder = ENCODERS["word_bpe_49k.json"]
    assert encoder.by_word and not ENCODERS["byte_bpe_50k.json"].by_word
    assert [e.tolist() for e in encoder.encode(texts)] == [direct(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab 'sS\n\té\u0301İΣ\u0085\xa0\x1c\u2028<|endoftext|>"))), max_size=4), st.sampled_from(FILES))
def test_any_texts_in_a_batch(texts, file):
    assert [list(e) for e in ENCODERS[file].encode(texts)] == [direct(t, file) for t in texts]


def test_a_file_that_may_look_past_a_space_is_not_taken_by_words():
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    assert parts_at_spaces(file)
    strip = [{**file["added_tokens"][0], "lstrip": True}]
    spaced = [{**file["added_tokens"][0], "content": "two words"}]
    for other in ({"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Metaspace"}}, {"added_tokens": strip}, {"added_tokens": spaced}, {"model": {**file["model"], "dropout": 0.1}}):
        assert not parts_at_spaces(file | other)
