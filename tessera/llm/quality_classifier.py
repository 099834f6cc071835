"""Quality classifier (operator 1): random-indexing word vectors, pooled per document, then a two-layer network.

Word vectors: every token hash bucket has a fixed sparse ternary index vector; a bucket's word vector is
the sum of the index vectors of its neighbours within `WINDOW` tokens over the whole corpus, damped and
normalised. Tokens are runs of letters or digits, or runs of other visible characters. Each task adds up
integer counts and emits fixed-size blocks; the sums are exact, so reruns agree.
A document is the mean of its word vectors, with the mean cosine of neighbouring ones and its log length. The network is fitted on at most about
`sample` labelled documents outside the held-out fold and calibrated by a temperature.

Defined results: a null or empty text pools to the zero vector and still gets a score; repeated rows score
alike; an empty table gives an empty result; with labels of one class only the score is constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.common import fold, labelled, map_text, sum_blocks
from tessera.llm.learn import Network

BUCKET_BITS, DIMS, NONZERO, WINDOW, BLOCK = 14, 32, 2, 2, 64
BUCKETS = 1 << BUCKET_BITS
INPUTS = DIMS + 2

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(17)
    return rng.integers(0, DIMS, (NONZERO, BUCKETS)), rng.choice([-1.0, 1.0], (NONZERO, BUCKETS))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token of a chunk, and where each row's begin (rows + 1)."""
    words = tx.Words(data, offs)
    if not len(words):
        return np.zeros(0, np.int32), words.first
    kind = _WORDLIKE[data]
    visible = ~tx._SEP[data]
    turn = np.zeros(len(data) + 1, bool)
    turn[1:-1] = (kind[1:] != kind[:-1]) & visible[1:] & visible[:-1]
    starts = turn.copy()
    starts[words.starts] = True
    ends = turn
    ends[words.ends] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    bucket = (tx.spans(data, s, e) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    return bucket, np.searchsorted(s, offs)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Normalised word vectors (BUCKETS x DIMS) over every text of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_vectors()
        total, seen = np.zeros(BUCKETS * DIMS), False
        for b in batches:
            for _, _, data, offs in tx.chunks(b.column(0)):
                bucket, first = tokens(data, offs)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                base = bucket.astype(np.int64) * DIMS
                for d in range(1, WINDOW + 1):
                    both = np.flatnonzero(row[d:] == row[:-d])
                    if len(both):
                        seen = True
                        left, right = both, both + d
                        near, far = np.concatenate([base[left], base[right]]), np.concatenate([bucket[right], bucket[left]])
                        for k in range(NONZERO):
                            total += np.bincount(near + at[k][far], sign[k][far], BUCKETS * DIMS)
        if seen:
            yield emit(total.astype(np.int64))

    def emit(total: np.ndarray) -> pa.RecordBatch:
        blocks = total.reshape(-1, BLOCK * DIMS)
        some = np.flatnonzero(blocks.any(1))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "sums"])

    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIMS))
    for k, sums in sum_blocks(docs.select(F.col(text).cast("string")).mapInArrow(count, "block int, sums binary")).items():
        out[k] = sums
    out = out.reshape(BUCKETS, DIMS)
    out = np.sign(out) * np.log1p(np.abs(out))
    return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> Iterator[np.ndarray]:
    """Mean word vector, mean cosine of neighbouring words and log length of each text, chunk by chunk."""
    for _, _, data, offs in tx.chunks(column):
        bucket, first = tokens(data, offs)
        n = np.diff(first)
        out = np.zeros((len(n), INPUTS))
        some = np.flatnonzero(n)
        if len(some):
            own = vectors[bucket]
            out[some, :DIMS] = np.add.reduceat(own, first[some], axis=0) / n[some, None]
            near = np.zeros(len(own))
            near[1:] = np.einsum("ij,ij->i", own[1:], own[:-1])
            near[first[some]] = 0
            out[:, DIMS] = tx.row_sums(near, first) / np.maximum(n - 1, 1)
        out[:, DIMS + 1] = np.log1p(n)
        yield out


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8000, hidden: int = 32, epochs: int = 25, held_out: tuple[int, int] | None = (5, 0)) -> QualityModel:
    """Word vectors from all texts; the network from at most about `sample` labelled ones outside the held-out fold (modulus, remainder)."""
    vectors = word_vectors(docs)

    def batch(column: pa.Array) -> list[pa.Array]:
        x = np.concatenate(list(pooled(column, vectors)))
        return [pa.array([v.tobytes() for v in x], pa.binary())]

    learnable = ~fold("doc_id", *held_out) if held_out else None
    rows = map_text(labelled(docs, labels, label, sample, learnable), ["doc_id", "y"], "text", [("x", "binary")], batch).toArrow().sort_by("doc_id")
    x = np.array([np.frombuffer(v, float) for v in rows.column("x").to_pylist()]).reshape(-1, INPUTS)
    return QualityModel(vectors, Network(x, rows.column("y").to_numpy().astype(float), hidden, epochs, seed=7))


def score(df: DataFrame, model: QualityModel, keep: list[str], text: str = "text", threshold: float = 0.3, prefix: str = "") -> DataFrame:
    """df's columns `keep`, the score (calibrated probability of good quality) and predicted (1 at or above the threshold)."""

    def batch(column: pa.Array) -> list[pa.Array]:
        p = np.concatenate([model.network.probability(x) for x in pooled(column, model.vectors)])
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return map_text(df, keep, text, [("score", "double"), ("predicted", "int")], batch, prefix)
