import random
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioutnshrdl") for _ in range(r.randint(2, 9)))
    shared = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(r.randint(60, 200))]
        good = i % 6 > 0
        text = ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8))
        if not good:
            text = r.choice([" ".join(w + "$$$" for w in words), " ".join(words[:2] * 60), " ".join(words).upper() + "!!"])
        elif i % 4 == 1:
            text += "\n" + shared
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(good), 0))
    copies = [(400 + k, rows[k][1] if k % 2 else rows[k][1] + " end", "en", "s0", 0) for k in range(1, 60) if k % 6]
    rows += [(i, t, a, b, len(t)) for i, t, a, b, _ in copies]
    return [*rows, (None, "a null id and few words", None, None, None), (999, None, "en", "s1", 0), (998, "", "en", "s1", 0)], labels, shared


def test_stages(spark, tmp_path):
    rows, labels, shared = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources", "SentencePiece encoding"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS
    quality, near, cut, mixed, pieces = kept
    good = {i for i, q, _ in labels if q}
    stays = {r.doc_id for r in quality}
    assert len(good & stays) > 0.98 * len(good) and len(stays - good - set(range(400, 1000)) - {None}) < 10
    assert not {r.doc_id for r in near} & set(range(401, 460)) and {r.doc_id for r in near} >= {i for i in stays if i is not None and i < 400 and i in good}
    assert sum(shared in (r.text or "") for r in near) > 20 and sum(shared in (r.text or "") for r in cut) == 1
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut if r.doc_id != 999)
    words = lambda t: len((t or "").split())
    before, after = Counter(), Counter()
    for r in cut:
        before[r.source] += words(r.text)
    for r in mixed:
        after[r.source] += words(r.text)
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) < 0.05 * sum(before.values())
    assert all(after[s] <= 2 * before[s] for s in before)
    text = {r.doc_id: r.text for r in mixed}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(r.doc_id for r in pieces) == Counter(r.doc_id for r in mixed)
    assert all(r.lossless and model.decode(r.piece_ids) == (text[r.doc_id] or "") for r in pieces)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_empty_table_and_extra_columns(spark, tmp_path):
    rows, labels, _ = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows[:60]] + [(None, None, None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long, _id string, shard int")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = docs.columns
    for name, table in (("all", docs), ("none", docs.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            table = stage(spark, table, str(tmp_path))
            table.write.parquet(str(tmp_path / f"{name}{k}"))
            table = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert k == 4 or table.columns == columns
            assert (table.count() > 0) == (name == "all")
