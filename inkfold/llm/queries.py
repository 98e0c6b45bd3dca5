"""The queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import chat, decision_list, decontaminate, lm, mixing, negatives, passages, quality, simhash, token_counts, token_files, toxicity, whitening
from inkfold.llm.tables import read, shared_dir


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(read(spark, sf_dir, "documents"))


def op2_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"), mixing.MIX)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.read(token_files.write(read(spark, sf_dir, "documents"), vocabulary, folder))


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))[0]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(rows.union(planted)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_compact_windows": op1_compact_windows,
    "op2_mixing_ipf": op2_mixing_ipf,
    "op3_simhash": op3_simhash,
    "op4_quality_trees": op4_quality_trees,
    "op5_gru_scores": op5_gru_scores,
    "op6_token_files": op6_token_files,
    "op7_toxicity_ftrl": op7_toxicity_ftrl,
    "op8_lsa_decontamination": op8_lsa_decontamination,
    "op9_decision_list": op9_decision_list,
    "op10_chat_format": op10_chat_format,
    "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

ORACLES = {
    "op10_chat_format": r"""
with rows as (
  select conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
parts as (
  select *, regexp_replace(role, '[<\[\] \\]', '\\\0', 'g') as r,
    case when regexp_matches(text, '<s>\[|</s>|\[/?[^\[\]<>]*\]') or contains(text, '\')
      then regexp_replace(replace(text, '\', '\\'), '<s>\[|</s>|\[/?[^\[\]<>]*\]', '\\\0', 'g') else text end as body from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(r) + 2 + length(body) + 3 + length(r) + 5)::bigint as formatted_chars
from parts group by conv_id
""",
    "op13_hard_negatives": """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, [floor(256 * c::double) for c in embedding] as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, b.label = a.label as same, list_inner_product(a.x, b.x)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5
""",
}
