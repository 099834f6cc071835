"""A corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of documents. Models are fitted on the whole documents table and its labels, as a stage's own input
may hold too few rejected documents to learn from. Every stage calls spare(), which also holds while its rows are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality_classifier, quality_rules, simhash
from tessera.llm.common import read, settle, shared_folder
from tessera.llm.queries import tokenizer_files

#: Bytes of a row group that is written, rows of a batch that is read, and rows and bytes of a batch that goes to Python. A task holds a row
#: group of what it reads and one of what it writes, whole, a batch of texts, and up to three times a batch for Python, which is outside
#: the heap and has the heap's size in all; at the usual 128 MB, 4,096 rows, 10,000 rows and 64 MB eight tasks need over 1 GB of either.
SPARE = {"parquet.block.size": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def spare(spark: SparkSession) -> dict[str, str | None]:
    """Lowers the session's Parquet and Arrow settings to SPARE where they are larger, unlimited, unset or no plain number; returns what they were."""
    before = {k: spark.conf.get(k, None) for k in SPARE}
    for k, most in SPARE.items():
        if not (before[k] or "").isdigit() or not 0 < int(before[k]) <= most:
            spark.conf.set(k, str(most))
    return before


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the n-gram model rejects go."""
    spare(spark)
    model = quality_rules.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model, docs.columns, prefix="__rule_").where("__rule_kept").select(*(f"`{c}`" for c in docs.columns))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts to be of low quality go."""
    spare(spark)
    model = quality_classifier.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out=None)
    return quality_classifier.score(docs, model, docs.columns, prefix="__net_").where("__net_predicted = 1").select(*(f"`{c}`" for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays; rows with a null id stay.

    Rows that share an id are one document; the first of them in order of their columns stays.
    """
    spare(spark)
    found = simhash.similar_texts(docs)
    ids = settle(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__rows")))
    kept = docs.join(ids, "doc_id")
    once = kept.where("__rows = 1").select(*(f"`{c}`" for c in docs.columns))
    rest = [c for c in docs.columns if c != "doc_id"]
    first = kept.where("__rows > 1").groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("__row"))
    several = first.select("doc_id", "__row.*").select(*(f"`{c}`" for c in docs.columns))
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions 1, 2, 3, repeating; documents are repeated or cut as their source's quota asks."""
    spare(spark)
    out = mixing.apply_mix(mixing.mix(docs, docs.columns, prefix="__mix_"), prefix="__mix_")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    spare(spark)
    return packing.pack(docs, ["doc_id"], **tokenizer_files())


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages learn, iterate and tokenise, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written as Parquet to the shared folder and read again by the next.

    The session's own Parquet and Arrow settings are put back at the end.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = spare(spark)
    try:
        for i, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return docs
