import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from loam.llm.fill_in_middle import fill_in_middle, restored, unit_lists
from loam.llm.queries import op11_fill_in_middle

SPLIT = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]+(?=[^ \t-\r])|[ \t-\r]+$|[^ \t-\r]+[ \t-\r]*"}
TEXTS = [None, "", "a", "é京🙂", " lead and\ttail \n", "one <P> two", "x<S", "<<M >>", "line\n\nline\r\nlast", "Ab c. " * 3000, "京都 🙂 no\n" * 900, "word" * 2000]


def plain(doc_id, text, unit="char", plain_percent=10, spm_percent=20):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(SPLIT[unit], text)
    assert "".join(u) == text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - plain_percent:
        return len(u), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("size", [1 << 20, 100, 7])
def test_every_unit_and_slice(spark, unit, size):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS * 6)] + [(None, "null id, twice", "", "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, _text string")
    made = fill_in_middle(docs, unit=unit, slice_bytes=size)
    got = made.withColumn("back", restored(made.output, made.form)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *plain(i, t, unit), t or "") for i, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_gives_the_contracts_digests(spark, tmp_path):
    rows = list(enumerate(TEXTS * 9))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_fill_in_middle(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in rows:
        n, form, a, b, out = plain(i, t)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(t or ""))


def test_empty_table_and_unknown_unit(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert fill_in_middle(docs).collect() == []
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(docs, unit="token")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té京🙂<PSM>", max_size=30), min_size=1, max_size=5), st.sampled_from(["char", "word", "line"]), st.integers(0, 3))
def test_units_share_the_texts(texts, unit, skip):
    lists = unit_lists(pa.array(["skipped"] * skip + texts, pa.string()).slice(skip), unit)
    assert lists.to_pylist() == [re.findall(SPLIT[unit], t) for t in texts]
