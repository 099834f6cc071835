"""What the operators share: cutting lineage, labelled samples and Arrow plumbing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset (tests, a single machine) a temporary folder, kept for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and cut from its lineage, so later steps neither repeat it nor depend on one executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fold(doc_id: str, modulus: int, of: int):
    """Whether crc32 of the id's decimal text leaves the remainder `of`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == of, F.lit(False))


def map_text(df: DataFrame, keep: list[str], text: str, fields: list[tuple[str, str]], batch: Callable[[pa.Array], list[pa.Array]], prefix: str = "") -> DataFrame:
    """df's columns `keep` and the named fields that `batch` makes of the text column, batch by batch on the executors.

    A kept column whose name clashes with a new field gives way to the field. Empty frames give empty results.
    """
    names = [prefix + n for n, _ in fields]
    keep = [c for c in keep if c not in names]
    carried = [df.schema[c] for c in keep]
    schema = T.StructType([*carried, *(T.StructField(n, T._parse_datatype_string(kind)) for n, (_, kind) in zip(names, fields, strict=True))])
    inner = text in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = batch(b.column(keep.index(text) if inner else b.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], names=[*keep, *names])

    return df.select(*(F.col(f"`{c}`") for c in keep), *([] if inner else [F.col(text).cast("string").alias("__text")])).mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, learnable=None) -> DataFrame:
    """(doc_id, text, y) of at most about `bound` labelled documents, one row per id.

    Labels of one id are averaged first, so repeated label rows weigh nothing more; ids are drawn by
    their hash, so the draw is the same on every run. Only this bounded set of ids is broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learnable is not None:
        known = known.where(learnable)
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    total = known.count()
    share = min(1.0, bound / max(1, total))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    ids = drawn.toArrow()
    spark = docs.sparkSession
    small = spark.createDataFrame(ids) if ids.num_rows else spark.createDataFrame([], drawn.schema)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(small), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _wide(part: np.ndarray) -> np.ndarray:
    return part.astype(np.int64)


def sum_blocks(parts: DataFrame, kind: type = np.int64, widen: Callable[[np.ndarray], np.ndarray] = _wide) -> dict[int, np.ndarray]:
    """Sums, by block number, of the arrays of whole numbers of the given kind that tasks have emitted as (block int, sums binary), each widened to 64 bits first.

    Blocks are dealt over the executors and added up as they stream in; the driver gets their sums only,
    so what it holds is set by the number of blocks, not by the number of tasks. Whole numbers add up alike in any order.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = widen(np.frombuffer(raw.as_buffer(), kind))
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "sums"])

    rows = parts.repartition(F.col("block")).mapInArrow(add, "block int, sums binary").toArrow()
    out: dict[int, np.ndarray] = {}
    for k, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        part = np.frombuffer(raw, np.int64)
        out[k] = out[k] + part if k in out else part
    return out
