"""The registered queries of the corpus operators and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.conversation_repair import damage, repair_conversations
from loam.llm.fill_in_middle import fill_in_middle, restored
from loam.llm.jaccard_join import near_duplicates
from loam.llm.mixing import mix_sources
from loam.llm.ngram_lm import held_out_scores
from loam.llm.piece_sampling import sample_pieces
from loam.llm.quality_model import score_quality
from loam.llm.quality_rules import quality_rules
from loam.llm.simhash import fingerprint_report
from loam.llm.substring_dedup import dedup_report
from loam.llm.url_filter import DEFAULT_PATTERNS, SHAPE_PATTERNS, WORD_PATTERNS, host_rule, judge_urls

SCALE_LIMIT_TOKENS = 2048


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loam.llm.token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=SCALE_LIMIT_TOKENS)


#: The rules of the contract: host and path, the longest wins.
URL_RULES = tuple(host_rule(*x) for x in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), [*URL_RULES, *DEFAULT_PATTERNS]).drop("n_candidates")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(_read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_read(spark, sf_dir, "documents"), similarity=0.8, exact=True)


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(_read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents"), threshold=0.8, recall=0.99)
    return found.select("doc_id", "class_id", "n_links", "class_size")


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sample_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20)
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return made.withColumns(digests).drop("output")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(_read(spark, sf_dir, "conversations")), copies="copies")


def op13_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loam.llm.bpe_tree import bpe_round_trip

    found = bpe_round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = {"ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256), "decoded_sha256": F.sha2("decoded", 256)}
    return found.withColumns(digests).drop("ids", "decoded")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filter, op3_ngram_lm, op4_jaccard_join, op5_substring_dedup, op6_mixing, op7_quality_model, op8_piece_sampling, op9_quality_rules, op10_fingerprints, op11_fill_in_middle, op12_conversation_repair, op13_bpe_tree)}


#: Words of a text, as in the operators: what ASCII white space parts.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"
_WORD_NAMES = ", ".join(f"'{r.name}'" for r in WORD_PATTERNS)
#: Every pattern on every url: a list of the names that match, by verdict.
_SHAPES = {v: "[" + ", ".join(f"CASE WHEN regexp_matches(url, '{r.pattern}') THEN '{r.name}' END" for r in SHAPE_PATTERNS if r.verdict == v) + "]" for v in ("block", "allow")}
_ORACLES = {
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, i) AS p, substr(text, i + 1, j - i) AS m, substr(text, j + 1) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op2_url_filter": r"""
WITH u AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) t(rule, rh, rp, v)),
best AS (SELECT p.*, r.rule, r.v, row_number() OVER (PARTITION BY page_id, url ORDER BY length(r.rule) DESC) AS rn, (SELECT min(w) FROM (SELECT unnest(regexp_extract_all(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w) WHERE w IN (PATTERNS)) AS word
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN coalesce(blocked, allowed) END AS pattern
FROM (SELECT *, list_min(list_filter(list_append(BLOCKED, word), lambda x: x IS NOT NULL)) AS blocked, list_min(list_filter(ALLOWED, lambda x: x IS NOT NULL)) AS allowed FROM best WHERE rn = 1)""".replace("PATTERNS", _WORD_NAMES).replace("BLOCKED", _SHAPES["block"]).replace("ALLOWED", _SHAPES["allow"]),
    "op12_conversation_repair": r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 20 AS fate FROM k),
g AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, count(*) OVER (PARTITION BY conv_id) AS n, regexp_extract(text, '([^ \t-\r])[ \t-\r]*$', 1) AS tail FROM g),
e AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, role[1:1] AS c FROM r),
m AS (SELECT *, lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS next_c, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t, fault IN ('blank', 'duplicate') AS gone FROM e),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i < n AND c || next_c NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations),
z AS (SELECT a.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal FROM a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id),
b AS (SELECT conv_id, n + 1 AS i, [0, 4, 2, 0]::BIGINT[] AS v FROM z
  UNION ALL SELECT conv_id, i, [least(m0, 2 + m2, 4 + m3), least(m1, 2 + m2, 4 + m3), least(m2, 2 + m3), least(m3, 2 + m2)] FROM (
    SELECT b.conv_id, m.i, least(3 + v[1], CASE WHEN NOT gone THEN least(t + 2 + v[3], CASE c WHEN 's' THEN t + v[2] WHEN 'u' THEN t + v[3] ELSE 999 END) ELSE 999999 END) AS m0,
      least(3 + v[2], CASE WHEN NOT gone THEN t + CASE WHEN c = 'u' THEN 0 ELSE 2 END + v[3] ELSE 999999 END) AS m1,
      least(3 + v[3], CASE WHEN NOT gone THEN t + CASE WHEN c = 'a' THEN 0 ELSE 2 END + v[4] ELSE 999999 END) AS m2,
      least(3 + v[4], CASE WHEN NOT gone THEN t + CASE WHEN c = 'u' THEN 0 ELSE 2 END + v[3] ELSE 999999 END) AS m3
    FROM b JOIN m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i - 1)),
f AS (SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS kept, false AS over FROM z
  UNION ALL SELECT conv_id, i + CASE WHEN step = 'I' THEN 0 ELSE 1 END, CASE step WHEN 'D' THEN q WHEN 'K' THEN CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE new_q END, audit || step, CASE step WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text) WHEN 'R' THEN list_append(kept, new_role || ':' || text) ELSE list_append(kept, new_role || ':') END, step = '' FROM (
    SELECT f.*, m.c, m.role, m.text, CASE WHEN q = 3 THEN 4 ELSE 3 END AS new_q, CASE WHEN q = 3 THEN 'assistant' ELSE 'user' END AS new_role,
      CASE WHEN m.i IS NULL AND now.v[q] = 0 THEN '' WHEN 3 + later.v[q] = now.v[q] THEN 'D' WHEN 2 + now.v[CASE WHEN q = 3 THEN 4 ELSE 3 END] = now.v[q] THEN 'I'
        WHEN (q = 1 AND c = 's' AND t + later.v[2] = now.v[q]) OR (q <> 3 AND c = 'u' AND t + later.v[3] = now.v[q]) OR (q = 3 AND c = 'a' AND t + later.v[4] = now.v[q]) THEN 'K' ELSE 'R' END AS step
    FROM f JOIN b now ON now.conv_id IS NOT DISTINCT FROM f.conv_id AND now.i = f.i LEFT JOIN b later ON later.conv_id IS NOT DISTINCT FROM f.conv_id AND later.i = f.i + 1 LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i WHERE NOT over) WHERE step <> '' OR NOT over)
SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, b.v[1] AS cost, audit, sha256(array_to_string(kept[1:len(replace(audit, 'D', ''))], chr(10))) AS repaired_sha256
FROM z JOIN b ON b.conv_id IS NOT DISTINCT FROM z.conv_id AND b.i = 1 JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.over""",
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, WORDS AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i >= 0.8 * (x.n + y.n - i) - 1e-9),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id) AS class_id, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links, greatest(1, (SELECT count(DISTINCT b) FROM reach WHERE a = doc_id)) AS class_size FROM documents""".replace("WORDS", _WORDS),
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, WORDS AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS g FROM w WHERE len(w) >= 20),
d AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) AS rn FROM g) WHERE rn > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
y AS (SELECT x.*, max(CASE WHEN d.start IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY x.doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN d ON d.doc_id = x.doc_id AND d.start = x.i),
k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)""".replace("WORDS", _WORDS),
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, WORDS AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 2),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY doc_id),
b AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM f GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS m, count(*) AS k, sum(f * f / n) AS q, sum(f) AS ff, sum(n) AS nn, sum(n * n) AS n2 FROM h),
v AS (SELECT *, (q - ff * m - (k - 1) * m * (1 - m)) / nullif(nn - n2 / nn, 0) AS v FROM m),
c AS (SELECT m, CASE WHEN v > 0 THEN greatest(2, least(1000, m * (1 - m) / v - 1)) ELSE 1000 END AS s FROM v),
r AS (SELECT source, (f + s * m) / (n + s) AS rate FROM h, c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source""".replace("WORDS", _WORDS),
}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force, exact round trips or held-out rows."""
    return dict(_ORACLES)
