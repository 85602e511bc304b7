import random
import re
from collections import Counter

from loam.llm.quality_rules import document_rules, host_rates, quality_rules

SEP = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = SEP.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SEP.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts():
    r = random.Random(3)
    out = [None, "", " \n \x0b", "a a a a", "a b c", "a b c a b c", "x\ny\nx\n\n \n \nx ", "tab\tsep\x0bvt\x0cff\rcr nb sp", "é#ü|<b> 𝔘 &"]
    out += [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 90))) for _ in range(40)]
    out += [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(300)) + "\n" + "same line\n" * r.randint(0, 3) for _ in range(10)]
    return [*out, " ".join(f"v{i % 3000}" for i in range(20000)), " ".join(f"u{i}" for i in range(20000))]


def test_counts_are_brute_force(spark):
    rows = [(i, t, "h", 1.5, 2) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[3], (None, "a b", None, None, None)], "doc_id long, text string, source string, n_words double, host int")
    got = document_rules(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        n, chars, symbols, dup, rep = brute("a b" if r.id is None else rows[r.id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(good, "a")] * 60 + [(bad, "a")] * 3 + [(bad, "b")] * 40 + [(good, "b")] * 2 + [(good, None)] * 3 + [(bad, "c")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    got = quality_rules(docs).collect()
    kept = Counter((rows[r.doc_id][1], r.kept) for r in got)
    assert kept == {("a", True): 60, ("a", False): 3, ("b", False): 42, (None, True): 3, ("c", False): 1}
    rates = {r.host: r.host_rate for r in host_rates(document_rules(docs)).collect()}
    assert rates["a"] < 0.1 < 0.8 < rates["b"] < 40 / 42
    assert rates["c"] < 1  # one failure is shrunk


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
