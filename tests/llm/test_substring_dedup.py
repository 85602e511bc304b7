import hashlib
import pathlib
import random
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F

from loam.llm import substring_dedup as S
from loam.llm.substring_dedup import dedup_documents, dedup_report, graph, nonbranching_paths, repeated_spans

SEP = re.compile("[^\x20\x09-\x0d]+")
K = 20


def brute(rows):
    first, words = {}, [(i, SEP.findall(t or "")) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    for i, w in sorted(words, key=lambda x: key(x[0])):
        for s in range(len(w) - K + 1):
            g = tuple(w[s : s + K])
            first[g] = min(first.get(g, (key(i), s)), (key(i), s))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - K + 1):
            if first[tuple(w[s : s + K])] < (key(i), s):
                gone.update(range(s, s + K))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus():
    r = random.Random(9)
    word = lambda n=5000: f"w{r.randint(0, n)}é"
    passages = [" ".join(word() for _ in range(r.randint(15, 80))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(3)]
        if i % 2:
            parts.insert(r.randint(0, 3), r.choice(passages))
        rows.append((1000 - i, "\n".join(parts) + " \x0b "))
    rows += [(2000 + k, rows[k][1]) for k in range(20)]  # copies
    rows += [(1, "loop " * 500), (2, None), (3, ""), (4, "a b"), (None, rows[3][1]), (5, " ".join(["x", "y"] * 30)), (6, " ".join(f"u{k}" for k in range(5000)) + " " + passages[0])]
    return [*rows, rows[5], rows[171]]


def test_report_is_brute_force(spark):
    rows = corpus()
    rows += [(2003, rows[3][1] + " x"), (2003, "x " + rows[3][1])]  # one id, several texts
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, id string, n_chars int").repartition(5)
    got = sorted(map(tuple, dedup_report(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def said(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return graph(docs, F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce("text", F.lit(""))), "text")


def test_spans_hold_at_their_source(spark):
    rows = corpus()
    words = {i: SEP.findall(t or "") for i, t in rows}
    spans = repeated_spans(said(spark, rows)).collect()
    assert len(spans) > 30
    for s in spans:
        own, src = words[None if s.id == (1 << 63) - 1 else s.id], words[None if s.src_id == (1 << 63) - 1 else s.src_id]
        assert own[s.start : s.start + s.n + K - 1] == src[s.src_start : s.src_start + s.n + K - 1]
        assert len(own[s.start : s.start + s.n + K - 1]) == s.n + K - 1


def brute_paths(rows):
    """Edges of each nonbranching path of the graph of repeated windows that begins at a branch."""
    places = {}
    for i, t in set(rows):
        w = SEP.findall(t or "")
        for s in range(len(w) - K + 1):
            places.setdefault(tuple(w[s : s + K]), set()).add((i, s))
    edges = [g for g, x in places.items() if len(x) > 1]
    outs, ins = {}, {}
    for g in edges:
        outs.setdefault(g[:-1], []).append(g)
        ins.setdefault(g[1:], []).append(g)
    plain = lambda node: len(outs.get(node, ())) == 1 == len(ins.get(node, ()))
    found = set()
    for g in edges:
        if not plain(g[:-1]):
            path = [g]
            while plain(path[-1][1:]):
                path += outs[path[-1][1:]]
            found.add(tuple(path))
    return found


def test_paths_are_the_graphs(spark):
    """Branching passages: shared middles, shared heads, pieces of pieces, whose first places lie in different rows."""
    r = random.Random(4)
    long = [f"p{k}" for k in range(400)]
    rows = [(i, " ".join([f"x{i}a", *long[a : a + r.randint(25, 150)], f"x{i}b"])) for i, a in enumerate(r.randint(0, 380) for _ in range(40))]
    rows += [(100 + i, " ".join(long[50:90] + [f"m{i % 3}"] * 25 + long[90:140])) for i in range(9)]
    words = {i: SEP.findall(t) for i, t in rows}
    got = {}
    for f in nonbranching_paths(said(spark, rows)).collect():
        for e in range(f.n):
            got.setdefault(f.path, {})[f.path_at + e] = tuple(words[f.src_id][f.head + e : f.head + e + K])
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    assert {tuple(x[k] for k in sorted(x)) for x in got.values()} == brute_paths(rows)
    assert max(map(len, brute_paths(rows))) > 20


def test_hot_minimizers_are_dealt_by_node(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_SLICES", 1)
    monkeypatch.setattr(S, "SLICE", 400)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, dedup_report(docs).collect()), key=str) == sorted(brute(rows), key=str)


def test_other_ids(spark):
    rows = [(None if i is None else f"{i:05d}", t) for i, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    want = brute([(None if i is None else int(i), t) for i, t in rows])
    assert sorted(map(tuple, dedup_report(docs).collect()), key=str) == sorted(((None if i is None else f"{i:05d}", *x) for i, *x in want), key=str)
    text = " ".join(f"a{k}" for k in range(30))
    most = spark.createDataFrame([(None, text), ((1 << 63) - 1, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_report(most).collect()} == {None: 30, (1 << 63) - 1: 0}


def test_spans_that_do_not_hold_are_left(spark, monkeypatch):
    """Two words with one hash: the windows look equal, their words are not."""
    words = [f"a{k}" for k in range(60)]
    other = [*words[:30], "twin", *words[31:]]

    class Colliding(S.WordHash):
        def __missing__(self, word):
            return super().__missing__(b"a30" if word == b"twin" else word)

    monkeypatch.setattr(S, "WordHash", Colliding)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:25]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_report(docs).collect()} == {1: 0, 2: 59, 3: 25}


def test_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "doc_id long, text string, n_chars long, _id string")
    out = dedup_documents(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(" ".join(SEP.findall(r.text or "")).encode()).hexdigest()) for r in out.collect())
    assert got == sorted((i is None, i or 0, d) for i, _, _, d in brute(rows))
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def test_empty(spark):
    assert dedup_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_folders_are_removed(spark):
    """What leads to the rows is gone once they are written."""
    from loam.shared import shared_dir

    def there():
        return {p.name for p in pathlib.Path(urlparse(shared_dir(spark)).path).iterdir() if p.name.split("-")[0] in ("minimizers", "graph", "lines", "pieces", "spans", "cut")}

    text, before = " ".join(f"w{i}" for i in range(60)), there()
    out = dedup_report(spark.createDataFrame([(1, text), (2, text + " end"), (3, None)], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 60, 3: 0}
    assert [name.split("-")[0] for name in there() - before] == ["cut"]


def test_a_passage_of_many_documents_is_a_row_each(spark):
    r = random.Random(3)
    passage = " ".join(f"p{r.randint(0, 10**6)}" for _ in range(300))
    rows = [(k, " ".join(f"a{r.randint(0, 10**6)}" for _ in range(30)) + " " + passage + " " + " ".join(f"b{r.randint(0, 10**6)}" for _ in range(30))) for k in range(200)]
    found = said(spark, rows).persist()
    n = {x["kind"]: x["count"] for x in found.groupBy("kind").count().collect()}
    slices = found.where("kind = 4").select("src_id").distinct().count()
    assert n[3] <= 200 and n[4] <= 60 * slices  # not a row per piece of every document
    spans = {(s.id, s.start, s.n, s.src_id, s.src_start) for s in repeated_spans(found).collect()}
    assert spans == {(k, 30, 281, 0, 30) for k in range(1, 200)}


def test_a_text_that_goes_round_is_a_row(spark):
    """Words in turns, in many documents: rows per document, not per round; equal to the brute force."""
    r = random.Random(6)
    rows = []
    for k in range(60):
        turns = ["p q", "p q r s t", "z", " ".join(f"l{j}" for j in range(25))][k % 4]
        rows.append((k, " ".join([f"a{r.randint(0, 10**6)}", *[turns] * r.randint(60, 90), f"b{k}", *[turns] * (k % 3 * 20)])))
    rows += [(100, rows[4][1]), (101, rows[5][1] + " end"), (7, rows[7][1]), (8, "p q " * 50), (8, "p q " * 50), (None, "p q " * 80)]
    found = said(spark, rows).persist()
    assert found.where("kind in (3, 5)").count() <= 20 * len(rows)
    assert repeated_spans(found).count() <= 30 * len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, dedup_report(docs).collect()), key=str) == sorted(brute(rows), key=str)
