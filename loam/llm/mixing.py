"""Mix sources to target weights: exact block quotas, split among output shards by a hypergeometric tree."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import saved, words_column


@dataclass(frozen=True)
class Mix:
    """What `plan_mix` works out. sizes: a row per document (row_key, id, source, size); sources: a row per source with
    source_no, source_size, target, n_blocks, copies that every document gets, quota (blocks to draw, the last one cut)
    and where the cut lies (cut_block, cut_key); leaves: each shard's range of each source's quota; units: each drawn
    (source_no, block, copy) and its shard."""

    sizes: DataFrame
    sources: DataFrame
    leaves: DataFrame
    units: DataFrame
    n_shards: int


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source_no, source, source_size, n_docs, target.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating. Targets share `share` times all
    sizes by weight, but stop at `most` times their source's size; what is above is shared anew among the others
    until none is above: the level at which min(cap, level x weight) adds up to the whole is found from sources
    sorted by cap / weight. One row per source; documents are summed up in each task first.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("source_no", F.row_number().over(order).cast("long")).withColumn("weight", weigh).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return per.select("source_no", "source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def block_of(row_key: Column, n_blocks: Column) -> Column:
    return F.pmod(row_key, n_blocks)


def _ln_factorial(x: str) -> str:
    """SQL for ln x!: a table below 10, Stirling's series from there on (error below 1e-11)."""
    table = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(10))
    return f"if({x} < 10, element_at(array({table}), cast({x} as int) + 1), ({x} + 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12D * {x}) - 1 / (360D * pow({x}, 3)) + 1 / (1260D * pow({x}, 5)))"


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"


def hypergeometric(total: str, own: str, drawn: str, u: str) -> str:
    """SQL for how many of `drawn` units, out of `total` of which `own` are of one kind, are of that kind: the inverse of
    the distribution function at u (0 to 1).

    The sum runs over counts within 12 deviations of the mean, by the ratio of neighbouring probabilities; what lies
    outside has less than 1e-30. The arguments have to be column or variable names, or constants."""
    n, k, m = (f"cast({x} as double)" for x in (total, own, drawn))
    mean = f"({m} * {k} / {n})"
    deviation = f"sqrt({m} * {k} / {n} * (1 - {k} / {n}) * ({n} - {m}) / greatest({n} - 1, 1D))"
    lo = f"greatest(0L, {drawn} + {own} - {total}, cast(floor({mean} - 12 * {deviation} - 12) as bigint))"
    hi = f"least({own}, {drawn}, cast(ceil({mean} + 12 * {deviation} + 12) as bigint))"
    first = f"exp({_ln_choose(k, 'cast(lo as double)')} + {_ln_choose(f'({n} - {k})', f'({m} - lo)')} - {_ln_choose(n, m)})"
    ratio = f"((({k}) - j) * (({m}) - j) / ((j + 1D) * (({n}) - ({k}) - ({m}) + j + 1D)))"
    step = f"named_struct('p', if(j < h, a.p * {ratio}, 0D), 'cum', a.cum + a.p, 'out', if(a.cum + a.p < {u}, least(j + 1, h), a.out))"
    summed = f"aggregate(sequence(lo, h), named_struct('p', {first}, 'cum', 0D, 'out', lo), (a, j) -> {step}, a -> a.out)"
    # lo and h as variables of lambdas, so that they are worked out once
    inner = f"element_at(transform(array({lo}), lo -> element_at(transform(array({hi}), h -> {summed}), 1)), 1)"
    return f"if({own} = 0 or {drawn} = 0, 0L, if({own} = {total}, {drawn}, if({drawn} = {total}, {own}, {inner})))"


def split_tree(root: DataFrame, depth: int, seed: int) -> DataFrame:
    """shard, source_no, start, quota: the root's quotas of every source, dealt to 2^depth shards, level by level.

    root: one row with `quotas`, an array of (source_no, start, quota). A node's left child takes half of its units,
    rounded up; how many of each source is a draw from the multivariate hypergeometric distribution, source by source
    from what is left (the uniform number is a hash of seed, level, node and source). The right child takes the rest. A
    child's units of a source are a range of the node's, so ranges are disjoint and quotas exact at every node. Only
    sources with units go on. A node is a row, and rows are spread over the cluster as they become many; the top one
    holds all sources in one array (their number squared is its work: thousands of sources, not millions).
    """
    nodes = root.select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(depth):
        uniform = f"(shiftrightunsigned(xxhash64({seed}, {level}, node, q.source_no), 11) * {2.0**-53!r}D)"
        draw = hypergeometric("acc.total", "q.quota", "acc.take", "uu")
        # left: how many units of each source go to the left child
        total = "aggregate(quotas, 0L, (s, q) -> s + q.quota)"
        step = f"(acc, q) -> element_at(transform(array({uniform}), uu -> element_at(transform(array({draw}), x -> named_struct('total', acc.total - q.quota, 'take', acc.take - x, 'out', concat(acc.out, array(x)))), 1)), 1)"
        left = f"aggregate(quotas, named_struct('total', {total}, 'take', ({total} + 1) div 2, 'out', cast(array() as array<bigint>)), {step}, acc -> acc.out)"
        nodes = nodes.withColumn("_left", F.expr(left))
        a = "transform(quotas, (q, i) -> named_struct('source_no', q.source_no, 'start', q.start, 'quota', _left[i]))"
        b = "transform(quotas, (q, i) -> named_struct('source_no', q.source_no, 'start', q.start + _left[i], 'quota', q.quota - _left[i]))"
        child = f"explode(array(named_struct('node', 2 * node, 'quotas', {a}), named_struct('node', 2 * node + 1, 'quotas', {b})))"
        nodes = nodes.select(F.expr(child).alias("c")).select("c.node", F.expr("filter(c.quotas, q -> q.quota > 0)").alias("quotas"))
        if level % 6 == 5:  # 64 times as many rows as before
            nodes = nodes.repartition("node")
    return nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.source_no", "q.start", "q.quota")


def running(rows: DataFrame, key: str, tie: Sequence[str], value: str, parts: int = 1024) -> DataFrame:
    """rows with, by source and in the order of a hashed key, pos (how many rows stand before) and before (the sum of
    their values). No source is brought to one task: sums of `parts` equal ranges of the hash lie below those of rows."""
    rows = rows.withColumn("_part", F.shiftrightunsigned(F.col(key), 64 - (parts - 1).bit_length()))
    sums = rows.groupBy("source_no", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    up_to = Window.partitionBy("source_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows at most
    offsets = sums.select("source_no", "_part", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(up_to), F.lit(0)).alias("_v0"))
    line = Window.partitionBy("source_no", "_part").orderBy(key, *tie)
    within = F.coalesce(F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_no", F.row_number().over(line) - 1).withColumn("_within", within).join(offsets, ["source_no", "_part"])
    return out.withColumn("pos", F.col("_n0") + F.col("_no")).withColumn("before", F.col("_v0") + F.col("_within")).drop("_part", "_no", "_within", "_n0", "_v0")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col), F.col(source_col)))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, docs_per_block: int = 1024, words_per_shard: int = 4_000_000, seed: int = 20240501) -> Mix:
    """Draw `share` times all words from the sources, as close to their targets as whole documents allow.

    Documents of a source are dealt into blocks by a hash (pseudo-random, disjoint, of about docs_per_block), blocks
    stand in a permuted line, and documents within a block in hash order. A source's target of t words is t div size
    full copies of the line and its first t mod size words; the document that holds the cut is taken if half of it lies
    before. So a source's quota is a whole number of blocks, the last one cut; unit u of it is copy u div n_blocks of
    the block at u mod n_blocks. `split_tree` deals all quotas to as many shards (a power of 2) as the mix has
    words_per_shard, and a shard's range of a source's units says which blocks it draws. All by hashes of seed, id,
    text and source: reruns agree.
    """
    base = _sized(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "id", "text", "source", seed)
    sizes = saved(base.select("row_key", "id", "source", F.size(words_column(F.col("text"))).cast("long").alias("size")))  # no texts
    sources = source_targets(sizes, weights, share, most)
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / docs_per_block)).cast("long"))
    sources = sources.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int"))
    sources = saved(sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))))
    placed = _placed(sizes, sources, seed)
    blocks = placed.groupBy("source_no", "block", "perm", "copies", "rest", "n_blocks", "source_size").agg(F.sum("size").alias("words"))
    blocks = saved(running(blocks, "perm", ["block"], "words"))
    # a rest that is (by rounding) the whole line is one copy more, all of it
    whole = (F.col("rest") > 0) & (F.col("rest") >= F.col("source_size"))
    holds_cut = ~whole & (F.col("rest") > 0) & (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    cut_block = blocks.where(holds_cut).select(F.col("source_no").alias("s"), F.col("block").alias("b"), F.col("before").alias("block_start"))
    inside = placed.join(cut_block, (F.col("source_no") == F.col("s")) & (F.col("block") == F.col("b")))
    walk = Window.partitionBy("source_no").orderBy("row_key", "size").rowsBetween(Window.unboundedPreceding, -1)  # one block
    inside = inside.withColumn("at", F.col("block_start") + F.coalesce(F.sum("size").over(walk), F.lit(0)) + F.col("size") / 2)
    cut = inside.groupBy(F.col("source_no").alias("s")).agg(F.first("block").alias("cut_block"), F.coalesce(F.max(F.when(F.col("at") <= F.col("rest"), F.col("row_key"))), F.lit(-(1 << 63))).alias("cut_key"))
    drawn = blocks.groupBy(F.col("source_no").alias("s2")).agg(F.sum(F.col("copies") + (whole | (F.col("before") < F.col("rest"))).cast("int")).alias("quota"), F.count(F.lit(1)).alias("filled"))
    own = sources.join(cut, F.col("source_no") == F.col("s"), "left").join(drawn, F.col("source_no") == F.col("s2"), "left").drop("s", "s2")
    own = saved(own.withColumn("quota", F.coalesce("quota", F.lit(0))))
    total = own.agg(F.sum("target")).first()[0] or 0.0
    depth = max(0, math.ceil(math.log2(total / words_per_shard))) if total > words_per_shard else 0
    root = own.where("quota > 0").agg(F.sort_array(F.collect_list(F.struct("source_no", F.lit(0).cast("long").alias("start"), "quota"))).alias("quotas"))  # a row per source
    leaves = saved(split_tree(root, depth, seed + 1))
    ranks = leaves.select("shard", "source_no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("u")).join(own.select("source_no", "filled"), "source_no")
    ranks = ranks.select("shard", "source_no", F.expr("cast(u div filled as int)").alias("copy"), (F.col("u") % F.col("filled")).alias("pos"))
    units = ranks.join(blocks.select("source_no", "pos", "block"), ["source_no", "pos"]).select("source_no", "block", "copy", "shard")
    return Mix(sizes, own, leaves, units, 1 << depth)


def _placed(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Documents with what their source knows; the table of sources is small, and Spark broadcasts it if it is."""
    own = sources.withColumnRenamed("source", "_source")
    placed = sizes.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return placed.withColumn("block", block_of(F.col("row_key"), F.col("n_blocks"))).withColumn("perm", F.xxhash64(F.lit(seed + 2), F.col("source_no"), F.col("block")))


def _drawn(placed: DataFrame, mix: Mix) -> DataFrame:
    """Placed documents with their draws: `copy` and `shard` of each unit of their block, but for those behind the cut."""
    units = mix.units.select(F.col("source_no").alias("_s"), F.col("block").alias("_b"), "copy", "shard")
    joined = placed.join(units, (F.col("source_no") == F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    last = (F.col("copy") == F.col("copies")) & (F.col("block") == F.col("cut_block"))
    return joined.where(~F.coalesce(last & (F.col("row_key") > F.col("cut_key")), F.lit(False)))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", seed: int = 20240501, **options) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies, shard (of the first copy, or null).

    What is taken, how often and where follows from the units that the tree's leaves drew. Null texts have size 0, a
    null source is a source of its own; repeated rows share one fate, as their hashes are equal; a source of size 0 has
    target 0 and nothing is taken; extra columns are ignored; empty gives empty.
    """
    mix = plan_mix(docs, id_col=id_col, seed=seed, **options)
    units = mix.units.groupBy(F.col("source_no").alias("_s"), F.col("block").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("_drawn"))  # a few copies of each block
    placed = _placed(mix.sizes, mix.sources, seed).join(units, (F.col("source_no") == F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    behind = F.coalesce((F.col("block") == F.col("cut_block")) & (F.col("row_key") > F.col("cut_key")), F.lit(False))
    mine = F.filter(F.coalesce("_drawn", F.expr("cast(array() as array<struct<copy: int, shard: bigint>>)")), lambda x: ~behind | (x["copy"] < F.col("copies")))
    out = placed.withColumn("_mine", mine).withColumn("_times", F.size("_mine"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double"), (F.col("size") * F.col("_times")).alias("taken"), F.col("_times").alias("copies"), F.get("_mine", F.lit(0))["shard"].alias("shard"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20240501, **options) -> DataFrame:
    """The mix itself: rows of docs as often as they are drawn, all columns kept; a partition per shard, shuffled within.

    One shuffle of the texts; which documents are drawn follows from their hash, their source's row and their block's
    units. Nulls, repeated rows and empty tables as in `mix_sources`; clashing column names do no harm."""
    mix = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = _sized(docs.select(row, F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "id", "text", "source", seed).drop("id", "text")
    dealt = _drawn(_placed(keyed, mix.sources, seed), mix).withColumn("_order", F.xxhash64(F.lit(seed + 3), "row_key", "copy"))
    return dealt.repartitionById(mix.n_shards, F.col("shard").cast("int")).sortWithinPartitions("_order").select("_row.*")
