"""The registered queries of this subpackage, each over its whole table, and the SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm.benchmark_overlap import benchmark_overlap
from tablecare.llm.context_tree import language_model_scores
from tablecare.llm.exact_dedup import exact_duplicates
from tablecare.llm.frames import crc_fold, durable, scratch_path
from tablecare.llm.hard_negatives import hard_negatives
from tablecare.llm.jaccard import jaccard_components
from tablecare.llm.near_vectors import near_vectors
from tablecare.llm.packing import pack
from tablecare.llm.pii import KINDS, chosen_spans, fit_pii, listed, with_candidates
from tablecare.llm.pieces import piece_summary
from tablecare.llm.prefix_trie import prefix_nodes
from tablecare.llm.quality import fit_quality, score_quality
from tablecare.llm.token_counts import token_counts
from tablecare.llm.toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_exact_dedup",
    """WITH d AS (
 SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def _decided(scored: DataFrame, held_out) -> DataFrame:
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, p=90, q=100)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    return _decided(score_quality(docs, model).select("doc_id", "score"), held_out)


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_summary(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 10) == 0
    scores = language_model_scores(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), *scores.columns[1:])


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), cache)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op8_near_vectors")
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return _decided(score_toxicity(docs, model).select("doc_id", "score"), held_out)


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    proposed = durable(with_candidates(docs, "text", "proposed").select("doc_id", "proposed"), "proposed")
    spans = proposed.withColumn("all", chosen_spans(F.col("proposed"), fit_pii(proposed, "proposed")))
    base = F.filter("all", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


@query(
    "op11_hard_negatives",
    """WITH e AS (
 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
  CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
 FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
 CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
 other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident, label = F.col("vec_id"), F.col("label")
    label = F.when(ident % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), ident % 50 == 0, label=label)


@query(
    "op12_benchmark_overlap",
    """WITH d AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
 SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
t AS (
 SELECT DISTINCT item_id, least(10, len(w)) AS n, list_aggregate(w[k : k + least(10, len(w)) - 1], 'string_agg', ' ') AS g
 FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM i WHERE len(w) > 0)),
x AS (
 SELECT doc_id, k, n, list_aggregate(w[k : k + n - 1], 'string_agg', ' ') AS g
 FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k
  FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item_id FROM x JOIN t USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
o AS (
 SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)""",
)
def op12_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = benchmark_overlap(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query(
    "op13_prefix_trie",
    """WITH t AS (
 SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (
 SELECT conv_id, l, xor(4294967295, list_reduce(
   list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
   lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
    lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))) % 9 AS h
 FROM t),
r AS (
 SELECT c.conv_id, list_concat(coalesce(d.l, [])[1 : c.h], c.l[c.h + 1 : len(c.l)]) AS l
 FROM c LEFT JOIN t d ON d.conv_id = c.conv_id - c.conv_id % 5),
x AS (SELECT conv_id, l, unnest(range(0, CAST(len(l) + 1 AS BIGINT))) AS depth FROM r),
n AS (
 SELECT depth, l[1 : depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
  string_agg(CASE WHEN len(l) = depth THEN conv_id END, ',' ORDER BY conv_id) AS ends
 FROM x GROUP BY depth, l[1 : depth]),
k AS (SELECT l[1 : depth - 1] AS p, count(DISTINCT l[1 : depth]) AS n_children FROM x WHERE depth > 0 GROUP BY 1),
b AS (
 SELECT n.*, coalesce(n_children, 0) AS n_children,
  CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.p[n.depth].t) END AS saved
 FROM n LEFT JOIN k ON n.p = k.p),
a AS (SELECT b.*, unnest(range(0, depth + 1)) AS up FROM b),
s AS (
 SELECT p[1 : up] AS p, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
 FROM a GROUP BY 1)
SELECT b.conv_id, b.depth, q.conv_id AS parent_conv_id, b.n_convs, b.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
 CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(b.ends, '')) AS ends_sha256
FROM b JOIN s ON b.p = s.p LEFT JOIN b q ON b.depth > 0 AND q.p = b.p[1 : b.depth - 1]""",
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.col("conv_id")
    turns = table(spark, sf_dir, "conversations")
    return prefix_nodes(turns, ident - ident % 5, F.crc32(ident.cast("string").cast("binary")) % 9, longest_head=8)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
