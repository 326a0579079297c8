"""The contracted queries of the corpus operators, one ``opN_<name>`` each, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fill_in_middle, hard_negatives, imatch, langid, line_dedup, mixing, packing, pii, secret_scan, simhash, suffix_dedup, toxicity
from .common import held_out, read_documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_documents(spark, sf_dir))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = langid.identify(docs, docs.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imatch.fingerprint_documents(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = toxicity.labelled_texts(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity.score(docs, toxicity.train(labelled))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(
        read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(read_documents(spark, sf_dir))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(read_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_id": op3_language_id,
        "op4_imatch": op4_imatch,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_simhash": op7_simhash,
        "op8_toxicity": op8_toxicity,
        "op9_secrets": op9_secrets,
        "op10_pack": op10_pack,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_pii": op12_pii,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": pipeline,
    }


#: Equivalent DuckDB SQL where there is one.
ORACLES: dict[str, str] = {
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i AS pos, xs[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents), UNNEST(range(1, len(xs) + 1)) AS u(i)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, pos, line, (o.key IS NOT NULL AND k.doc_id <> o.top) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op6_embedding_dedup": r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
), usable AS MATERIALIZED (
  SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), linked AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.9
), reach AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b
), root AS (SELECT a, min(b) AS low FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT v.vec_id, coalesce(links.n, 0) AS n_links, least(v.vec_id, coalesce(root.low, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(root.low, v.vec_id)) AS kept
FROM v LEFT JOIN links ON links.a = v.vec_id LEFT JOIN root ON root.a = v.vec_id
""",
    "op11_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         [CAST('0x' || substr(hex, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t
), c AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b FROM u
), f AS (
  SELECT doc_id, n, text, array_to_string(units[:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
""",
    "op13_hard_negatives": r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x, row_number() OVER () AS uid
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS MATERIALIZED (
  SELECT a.uid AS a, a.vec_id AS anchor_id, a.label AS own, b.uid AS b, b.vec_id AS id, b.label AS other,
         CAST(CASE WHEN len(a.x) = 0 THEN 0 ELSE list_dot_product(a.x, b.x) END AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.uid <> b.uid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE own = other QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND s.own <> s.other AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
