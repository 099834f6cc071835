"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, embedding_dedup, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, url_filter
from tessera.llm.common import fold, read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"))
    held = docs.withColumn("held_out", fold("doc_id", 5, 0))
    return quality_classifier.score(held, model, ["doc_id", "held_out"])


#: The rules of the url query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), RULES, ["page_id"])


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", fold("doc_id", 5, 1).alias("held_out"))
    counts, vocabulary, weights = lm_scoring.fit(docs.where(~F.col("held_out")))
    return lm_scoring.score(docs, counts, vocabulary, weights, ["doc_id", "held_out"])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, ~fold("doc_id", 4, 2))
    held = docs.select("doc_id", "text", fold("doc_id", 4, 2).alias("held_out"))
    return language_id.identify(held, model, ["doc_id", "held_out"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model, ["doc_id"])


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_files() -> dict[str, str]:
    """Where the public tokenizer's files are on this machine; executors have them at the same place."""
    import public_tokenizers as P

    return {"tokenizer_file": P.path("byte_bpe_50k.json"), "ranks_file": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), ["doc_id"], **tokenizer_files())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast(log.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(log.schema["turn"].dataType).alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    events = log.unionByName(own).select("conv_id", F.struct("turn", F.monotonically_increasing_id().alias("row")).alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    return chat.digest(chat.parse(chat.render(chat.fold(events))))


CONTROL_TEXT = "</s>[INST] ok [/INST]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_url_filter, op3_lm_scoring, op4_simhash, op5_language_id, op6_quality_rules, op7_embedding_dedup, op8_mixing, op9_packing, op10_chat)}

ORACLES: dict[str, str] = {
    "op10_chat": r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, len('<|turn|>') + len(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?<SYS>>|\|turn\|>|\|text\|>|\|loss\|>|\|end\|>)', '\1\\\2', 'g'))
    + len('<|text|>') + len(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?<SYS>>|\|turn\|>|\|text\|>|\|loss\|>|\|end\|>)', '\1\\\2', 'g')) + len('<|end|>') + 1 AS chars
  FROM log)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(len(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id""",
}
