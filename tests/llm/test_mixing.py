import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm.mixing import hypergeometric, mix_sources, mixed_documents, plan_mix, source_targets, split_tree


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    left, free = share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        add = {s: left * w[s] / total for s in free}
        left = 0.0
        for s, x in add.items():
            out[s] += x
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                free.discard(s)
    return out


def corpus(spark, n=3000):
    rng = np.random.default_rng(5)
    source = [("a", "b", "B", "c", "é", None, "z")[i] for i in rng.choice(7, n, p=[0.45, 0.1, 0.1, 0.15, 0.1, 0.05, 0.05])]
    return [(i, None if i % 97 == 0 else " ".join(["w"] * int(k)), s, "clash") for i, (k, s) in enumerate(zip(rng.integers(0, 60, n), source))]


def test_targets(spark):
    for sizes in ({"a": 100, "b": 1000, "c": 5000, None: 40}, {"x": 7}, {"x": 0, "y": 3}, {"a": 10**9, "b": 1, "c": 1, "d": 5}):
        rows = [(s, v) for s, v in sizes.items()]
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long"), (5, 2, 1), 1.5, 2.0).collect()}
        assert got == pytest.approx(targets(sizes))


def test_mix(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix_sources(docs, docs_per_block=64).collect()
    again = mix_sources(docs.repartition(7), docs_per_block=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) or {r.doc_id: r for r in got} == {r.doc_id: r for r in again}
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    per = defaultdict(int)
    for i, _, s, _ in rows:
        per[s] += size[i]
    want, taken = targets(per), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = rows[r.doc_id][2]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in per:
        assert abs(taken[s] - want[s]) <= 60
    mixed = Counter(r.doc_id for r in mixed_documents(docs, docs_per_block=64).select("doc_id").collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixed_documents(docs).columns == docs.columns


def brute_draw(total, own, drawn, u):
    """The least count whose exact distribution function reaches u."""
    cum, lo, hi = 0, max(0, drawn + own - total), min(own, drawn)
    for x in range(lo, hi + 1):
        cum += Fraction(math.comb(own, x) * math.comb(total - own, drawn - x), math.comb(total, drawn))
        if cum >= u:
            return x
    return hi


def test_draws_are_hypergeometric(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(600):
        total = int(rng.choice([1, 2, 3, 9, 40, 300, 5000]))
        rows.append((total, int(rng.integers(0, total + 1)), int(rng.integers(0, total + 1)), float(rng.random())))
    table = spark.createDataFrame(rows, "n long, k long, m long, u double")
    got = [r.x for r in table.selectExpr(hypergeometric("n", "k", "m", "u") + " AS x").collect()]
    assert got == [brute_draw(*r) for r in rows]
    big = spark.range(4000).selectExpr("1000000000L AS n", "300000000L AS k", "500000000L AS m", "(id + 0.5D) / 4000 AS u").selectExpr(hypergeometric("n", "k", "m", "u") + " AS x").toPandas().x
    assert big.mean() == pytest.approx(150_000_000, abs=20) and big.std() == pytest.approx(math.sqrt(1e9 * 0.3 * 0.7 * 0.25), rel=0.01)


@pytest.mark.parametrize("depth", [0, 1, 4, 7])
def test_tree_is_brute_force(spark, depth):
    quotas = [(1, 0, 700), (2, 0, 3), (5, 0, 40), (6, 0, 1), (9, 0, 256)]
    root = spark.createDataFrame([(quotas,)], "quotas array<struct<source_no: long, start: long, quota: long>>")
    got = {(r.shard, r.source_no): (r.start, r.quota) for r in split_tree(root, depth, 77).collect()}
    nodes = {0: quotas}
    for level in range(depth):
        ask = [(level, n, s) for n, q in nodes.items() for s, _, _ in q]
        u = spark.createDataFrame(ask, "level int, node long, s long").select("node", "s", F.expr("shiftrightunsigned(xxhash64(77, level, node, s), 11) * 1.1102230246251565E-16D").alias("u"))
        u = {(r.node, r.s): r.u for r in u.collect()}
        below = {}
        for n, q in nodes.items():
            total = sum(x for _, _, x in q)
            take, left, right = (total + 1) // 2, [], []
            for s, start, own in q:
                x = brute_draw(total, own, take, u[n, s])
                total, take = total - own, take - x
                left.append((s, start, x))
                right.append((s, start + x, own - x))
            assert take == 0
            below[2 * n], below[2 * n + 1] = ([x for x in side if x[2]] for side in (left, right))
        nodes = below
    assert got == {(n, s): (start, x) for n, q in nodes.items() for s, start, x in q}
    sizes = [sum(x for _, _, x in q) for q in nodes.values()]
    assert max(sizes) - min(sizes) <= 1


def test_shards_draw_disjoint_blocks(spark):
    docs = spark.createDataFrame(corpus(spark), "doc_id long, text string, source string, size string")
    mix = plan_mix(docs, docs_per_block=16, words_per_shard=9000)
    units = mix.units.toPandas()
    assert mix.n_shards == 16 and not units.duplicated(["source_no", "block", "copy"]).any()
    quota = {r.source_no: r.quota for r in mix.sources.collect()}
    assert units.groupby("source_no").size().to_dict() == {s: q for s, q in quota.items() if q}
    per = units.groupby("shard").size()
    assert len(per) == 16 and per.max() - per.min() <= 1
    got = mix_sources(docs, docs_per_block=16, words_per_shard=9000)
    mixed = mixed_documents(docs, docs_per_block=16, words_per_shard=9000)
    parts = mixed.select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert Counter(r.doc_id for r in parts) == Counter({r.doc_id: r.copies for r in got.collect() if r.copies})
    first = {r.doc_id: r.shard for r in got.collect() if r.copies}
    where = defaultdict(set)
    for r in parts:
        where[r.doc_id].add(r.p)
    assert all(first[i] in p for i, p in where.items())


def test_long_texts_and_ties(spark):
    rows = [(1, "w " * 300_000, "a"), (1, "w " * 300_000, "a"), (2, "x", "a"), (3, "y", None), (4, "z", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1, 300_000, 300_000] and len({r.taken for r in got if r.doc_id == 1}) == 1
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b", None)] * 3 + [(1, "", "x")], "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert len(got) == 4 and {r.taken for r in got if r.doc_id is None} <= {0, 2, 4}
    assert mix_sources(docs.where(F.lit(False))).collect() == []
