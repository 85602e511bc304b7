"""Quality rules of single documents, and verdicts on their hosts from a shrunk failure rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import SPACES, saved, words_column

SYMBOLS = "#*$%&|<>"


def window_hashes(words: Column, span: int = 3) -> Column:
    """A hash of each window of `span` words, in order; empty if there are fewer words."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - span), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(span))))
    return F.when(n < span, F.array().cast("array<bigint>")).otherwise(hashes)


def repeated_words(hashes: Column, span: int = 3) -> Column:
    """How many words stand in a `span`-word window that occurs twice or more, first ones included.

    The windows' hashes are sorted with their positions; where neighbours are equal, both positions count, and sorted
    positions cover min(span, distance to the next) words each. n log n in the words of one text, nothing exploded.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(x: Column) -> Column:
        same = lambda a, b: F.get(x, a)["h"] == F.get(x, b)["h"]
        last = F.size(x) - 1
        twice = F.filter(x, lambda e, k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)))
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        first = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-span).alias("before"))
        step = lambda acc, p: F.struct((acc["total"] + F.least(F.lit(span), p - acc["before"])).alias("total"), p.alias("before"))
        return F.aggregate(at, first, step, lambda acc: acc["total"])

    # most texts repeat no window: a set of the hashes tells, and only the others are sorted
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, F.element_at(F.transform(F.array(placed), covered), 1)).otherwise(F.lit(0).cast("long"))


def document_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts and the base verdict of each row: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = kept.select(
        "id", "host",
        words_column(F.col("text")).alias("words"),
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    counted = counted.select("id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), window_hashes(F.col("words")).alias("hashes"))
    counted = counted.select("id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("hashes")).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(judged: DataFrame, *, threshold: float = 0.5, weakest_prior: float = 2.0, strongest_prior: float = 1000.0) -> DataFrame:
    """Per host: n_docs, n_failed, the shrunk failure rate and whether the host is rejected.

    An empirical beta prior is fitted to all hosts by moments: mean m of the failures over all documents, and a
    variance between hosts v beyond what sampling explains; its strength m(1-m)/v - 1 is held between weakest_prior
    and strongest_prior documents. A host's rate is (failed + strength m) / (docs + strength); above the threshold all
    its documents go. Sums only: hosts are pre-aggregated in each task, so a hot host costs nothing more.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs"), F.col("n_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("k"), F.sum(f * f / n).alias("q"), F.sum(n * n).alias("nn"))
    mean = F.col("f") / F.col("n")
    # DerSimonian and Laird: sum n (rate - mean)^2 = (k - 1) mean (1 - mean) + v (N - sum n^2 / N)
    within = mean * (1 - mean)
    between = (F.col("q") - F.col("f") * mean - (F.col("k") - 1) * within) / F.nullif(F.col("n") - F.col("nn") / F.col("n"), F.lit(0.0))
    strength = F.when(between > 0, F.greatest(F.lit(weakest_prior), F.least(F.lit(strongest_prior), within / between - 1))).otherwise(strongest_prior)
    prior = total.select(mean.alias("mean"), strength.alias("strength"))  # one row
    rate = (f + F.col("strength") * F.col("mean")) / (n + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("host_rate"), (rate > threshold).alias("host_failed"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs with its counts, base_failed, its host's rate and kept.

    kept is false if the base rules fail or the host is rejected. A null host is a host of its own. Null and empty
    texts fail (fewer than 50 words); null ids stay null; repeated rows give repeated rows; other columns, also ones
    named like a result, are ignored; an empty table gives an empty one.
    """
    judged = saved(document_rules(docs, id_col=id_col, text_col=text_col, host_col=host_col))  # numbers only, no texts
    hosts = host_rates(judged, threshold=threshold).select(F.col("host").alias("of_host"), "host_rate", "host_failed")
    return judged.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rate")
