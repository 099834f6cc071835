"""Packing (operator 9): concatenate and cut.

First pass: every task tokenises its texts, ends each document with `end_id`, and records where in the task's
own stream each document starts; the result is written once, so order and totals are those of one committed
attempt. Second pass: prefix sums over the tasks' totals (one number per task, on the driver) turn these into
global offsets, and documents are cut where windows of `length` tokens end. A document that crosses a border
gives a boundary record on both sides; only the last window can be short.

Token ids are those of the `tokenizers` file, with no special tokens put in; a text that spells an added token gets its id. Texts made up of Latin letters and
common punctuation without an added token are encoded by the equal rank vocabulary, which is four times as fast; any other text goes
to `tokenizers` itself, as the two libraries may class rarer characters by different Unicode tables; so does a text on
whose long runs of white space the faster one gives up.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an empty
table gives an empty result. A carried column named like an output gives way to it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import settle

RARE = re.compile("[^\u0000-ɏ‐-‧€]")


@lru_cache(maxsize=4)
def encoder(tokenizer_file: str, ranks_file: str | None, pattern: str | None):
    """text -> uint32 ids."""

    @lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer_file)

    def slow(text: str) -> np.ndarray:
        return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)

    if not ranks_file:
        return slow
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [t.content for t in exact().get_added_tokens_decoder().values()]

    def either(text: str) -> np.ndarray:
        if RARE.search(text) or any(t in text for t in added):
            return slow(text)
        try:
            return quick.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        except ValueError:  # its pattern gives up on very long runs of white space
            return slow(text)

    return either


def tokenise(df: DataFrame, keep: list[str], tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None, end_id: int = 1, text: str = "text") -> DataFrame:
    """Columns `keep`, the task (__part), where in its stream the document starts (__at), doc_tokens, and the ids as bytes (16 bits each if all fit)."""
    carried = [df.schema[c] for c in keep]
    schema = T.StructType([*carried, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("__wide", T.BooleanType()), T.StructField("__ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = encoder(tokenizer_file, ranks_file, pattern), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                starts, sizes, wide, ids = [], [], [], []
                for value in some.column(len(keep)).to_pylist():
                    found = np.append(encode(value or ""), np.uint32(end_id)).astype("<u4")
                    starts.append(at)
                    sizes.append(len(found))
                    wide.append(bool(found.max() > 0xFFFF))
                    ids.append(found.tobytes() if wide[-1] else found.astype("<u2").tobytes())
                    at += len(found)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(keep))), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())], names=schema.names)

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def pack(df: DataFrame, keep: list[str], tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None, length: int = 2048, end_id: int = 1, text: str = "text") -> DataFrame:
    """One row per piece: columns `keep`, start, length, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit)."""
    made = ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    keep = [c for c in keep if c not in made]
    tokens = settle(tokenise(df, keep, tokenizer_file, ranks_file, pattern, end_id, text))
    totals = sorted(tuple(r) for r in tokens.groupBy("__part").agg(F.sum("doc_tokens")).collect())
    bases, base = [], 0
    for part, total in totals:
        bases.append((part, base))
        base += total
    offsets = df.sparkSession.createDataFrame(bases, "__part int, __base bigint")
    schema = T.StructType([*(tokens.schema[c] for c in keep), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in made)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                row, out = [], {n: [] for n in made}
                values = [some.column(len(keep) + k).to_pylist() for k in range(4)]
                for i, (begin, n, wide, raw) in enumerate(zip(*values, strict=True)):
                    ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                    a = 0
                    while a < n:
                        z = min(n, a + length - (begin + a) % length)
                        row.append(i)
                        for name, x in zip(made, (a, z - a, n, (begin + a) // length, (begin + a) % length, ids[a:z].tobytes()), strict=True):
                            out[name].append(x)
                        a = z
                kept = [some.column(i).take(pa.array(row, pa.int64())) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[n], pa.binary() if n == "ids" else pa.int64()) for n in made)], names=schema.names)

    placed = tokens.join(F.broadcast(offsets), "__part").select(*(F.col(f"`{c}`") for c in keep), (F.col("__base") + F.col("__at")).alias("__begin"), "doc_tokens", "__wide", "__ids")
    return placed.mapInArrow(cut, schema)
