"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op1_chat, op2_pii, op3_url_filter, op4_quality, op5_token_counts, op6_fingerprints, op7_substring_dedup, op8_decontamination,
    op9_jaccard_join, op10_mixing, op11_hard_negatives, op12_collocations, op13_secrets,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    record = f'{{"id": -1, "messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}'
    probe = spark.sql("SELECT -1L AS k, :record AS record", args={"record": record})
    turns = op1_chat.turns_of_rows(_table(spark, sf_dir, "conversations")).unionByName(op1_chat.turns_of_records(probe, "k"))
    return op1_chat.chat_digests(op1_chat.format_chats(turns))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii.pii_spans(_table(spark, sf_dir, "documents"))


def op3_url_filter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_url_filter.judged_urls(_table(spark, sf_dir, "pages"))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_substring_dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_decontamination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing.mix(_table(spark, sf_dir, "documents"))


def op11_hard_negatives_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return op11_hard_negatives.hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_secrets.secret_spans(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_pii_spans, op3_url_filter_verdicts, op4_quality_scores, op5_token_count, op6_fingerprint,
        op7_substring_dedup_spans, op8_decontamination_hits, op9_ngram_jaccard, op10_mixture, op11_hard_negatives_mined,
        op12_phrase_collocations, op13_secret_spans, pipeline,
    )
}



def _escaped(column: str, signs: str) -> str:
    """SQL: the length of a column after escaping, which doubles these signs."""
    return f"(length({column}) + length(regexp_replace({column}, '[^{signs}]', '', 'g')))"


_SETS = r"""
w AS (
  SELECT doc_id, list_transform(
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> ''),
    lambda x: x) AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)
"""

ORACLE: dict[str, str] = {
    "op1_chat_formatting": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + {_escaped('role', '~<[|')} + {_escaped('text', '~<[')} + 7)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op8_decontamination_hits": f"""
WITH {_SETS},
b AS (SELECT doc_id, unnest(sh) AS g FROM s),
q AS (SELECT item_id AS doc_id, text FROM benchmark),
qs AS (SELECT item_id, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws FROM benchmark)),
qb AS (SELECT item_id, unnest(sh) AS g FROM qs)
SELECT b.doc_id, qb.item_id, any_value(len(qs.sh))::BIGINT AS item_shingles, count(*)::BIGINT AS shared, count(*)::DOUBLE / any_value(len(qs.sh)) AS containment
FROM b JOIN qb USING (g) JOIN qs ON qs.item_id = qb.item_id
GROUP BY b.doc_id, qb.item_id HAVING 100 * count(*) >= 75 * any_value(len(qs.sh))""",
    "op9_ngram_jaccard": f"""
WITH RECURSIVE {_SETS},
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT s.doc_id, any_value(len(s.sh))::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id""",
    "op11_hard_negatives_mined": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS u
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.u, b.u)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 3""",
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece
  FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM ws, range(1, 5) t(m)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE f >= 30 AND len(g) > 1),
cuts AS (SELECT c.*, unnest(range(1, len(g))) AS k FROM c),
s AS (
  SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:k] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
subs AS (SELECT lang, a AS longer, len(g) AS size, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM c),
most AS (SELECT lang, g, max(longer) AS most FROM subs GROUP BY lang, g),
kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN most USING (lang, g) WHERE coalesce(100::HUGEINT * most.most < 80::HUGEINT * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
