"""Quality rules (operator 6): exact text statistics with fixed limits, then a hashed n-gram logistic regression.

Learning: word 1- and 2-grams and character 1- to 3-grams (code points), hashed, as relative frequencies; L2
logistic regression on a bounded labelled sample (`sample` documents), its margin turned into a probability by
Platt scaling on rows set apart. The driver goes through the sample some documents at a time. Because features are relative frequencies, a text's margin is the mean
of gathered weights, so scoring is one gather and one running sum per n-gram order.

Defined results: a null or empty text has zero statistics, fails the base rule and is not kept;
repeated rows are judged alike; an empty table gives an empty result; without labels of both classes
the model keeps whatever the base rule keeps. A carried column named like an output gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import text as tx
from tessera.llm.common import labelled, map_text
from tessera.llm.learn import Sparse, logistic, platt, sigmoid

BITS = 14
ORDERS = ("word1", "word2", "char1", "char2", "char3")
FIELDS = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"), ("probability", "double")]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class RuleModel:
    """weights: per order and hashed feature, already scaled; a, b: calibration; reject_below: probability under which a text goes."""

    weights: np.ndarray
    bias: float
    a: float
    b: float
    reject_below: float

    def probability(self, data: np.ndarray, offs: np.ndarray, words: tx.Words) -> np.ndarray:
        z = np.full(len(offs) - 1, self.bias)
        for k, (feature, first) in enumerate(features(data, offs, words)):
            n = np.maximum(np.diff(first), 1)
            z += tx.row_sums(self.weights[k].take(feature), first) / n
        return sigmoid(self.a * z + self.b)


def features(data: np.ndarray, offs: np.ndarray, words: tx.Words):
    """For each order: hashed features in text order, and where each row's begin."""
    shift = np.uint64(64 - BITS)
    h = words.hashes()
    yield (h >> shift).astype(np.int32), words.first
    pair = tx.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    last = words.first[1:][words.counts > 0] - 1
    keep = np.ones(len(h), bool)
    keep[last] = False
    first = np.concatenate([[0], np.cumsum(np.maximum(words.counts - 1, 0))])
    yield (pair[keep[:-1]] >> shift).astype(np.int32) if len(h) else h.astype(np.int32), first
    yield from tx.char_grams(data, offs, 3, BITS)


def statistics(data: np.ndarray, offs: np.ndarray, words: tx.Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    rows = len(offs) - 1
    heads = np.concatenate([[0], np.cumsum(_HEAD[data])])
    chars = tx.row_sums(heads[words.ends] - heads[words.starts], words.first)
    symbols = tx.row_sums(_SYMBOL[data].astype(np.int64), offs)
    raw = data.tobytes()
    dup = np.zeros(rows, np.int64)
    for i in range(rows):
        lines = raw[offs[i] : offs[i + 1]].split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
    return [words.counts, chars, symbols, dup, repeated(words)]


def repeated(words: tx.Words, n: int = 3) -> np.ndarray:
    """Words of each row that lie in an n-word window found twice or more in the row."""
    h, row = words.hashes(), words.rows()
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(len(words.counts), np.int64)
    whole = row[:size] == row[n - 1 :]
    key = tx.mix(row[:size].astype(np.uint64))
    for k in range(n):
        key = tx.mix(key * np.uint64(5) + h[k : k + size])
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    covered = np.zeros(len(h), bool)
    for k in range(n):
        covered[twice + k] = True
    return tx.row_sums(covered.astype(np.int64), words.first)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, reject_below: float = 0.3, l2: float = 1e-3, steps: int = 150) -> RuleModel:
    """Fits the model to at most about `sample` labelled documents; the rest of the corpus is only scored."""
    dims = len(ORDERS) << BITS

    def batch(column: pa.Array) -> list[pa.Array]:
        codes, values = [], []
        for _, _, data, offs in tx.chunks(column):
            words = tx.Words(data, offs)
            found = list(features(data, offs, words))
            for i in range(len(offs) - 1):
                f, v = [], []
                for k, (feature, first) in enumerate(found):
                    own = feature[first[i] : first[i + 1]]
                    if len(own):
                        code, count = np.unique(own, return_counts=True)
                        f.append(code + (k << BITS))
                        v.append(count / len(own))
                codes.append(np.concatenate(f).astype(np.int32).tobytes() if f else b"")
                values.append(np.concatenate(v).astype(np.float32).tobytes() if v else b"")
        return [pa.array(codes, pa.binary()), pa.array(values, pa.binary())]

    rows = map_text(labelled(docs, labels, label, sample), ["doc_id", "y"], "text", [("codes", "binary"), ("values", "binary")], batch).toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(float)
    weights, bias, a, b = np.zeros((len(ORDERS), 1 << BITS), np.float32), 0.0, 1.0, 0.0
    if len(np.unique(y)) < 2:
        return RuleModel(weights, 50.0, a, b, reject_below)
    raw, offsets = tx.buffer(rows.column("codes"))
    feature, first = raw.view(np.int32).copy(), offsets // 4
    value = tx.buffer(rows.column("values"))[0].view(np.float32).copy()
    del rows, raw
    pa.default_memory_pool().release_unused()
    x, square = Sparse(feature, value, first, dims), np.zeros(dims)
    for _, f, v, _ in x.slices():
        square += np.bincount(f, v * v, dims)
    scale = 1 / (np.sqrt(square / len(y)) + 1e-3) / 30
    for _, f, v, _ in x.slices():
        v *= scale.astype(np.float32)[f]
    apart = np.arange(len(y)) % 5 == 4
    if min(y[apart].sum(), (1 - y[apart]).sum()) < 3:
        apart[:] = False
    w, bias = logistic(x, y, (~apart).astype(float), l2, steps)
    held = apart if apart.any() else ~apart
    a, b = platt((x.dot(w) + bias)[held], y[held])
    return RuleModel((w * scale).astype(np.float32).reshape(len(ORDERS), -1), bias, a, b, reject_below)


def apply_rules(df: DataFrame, model: RuleModel, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """df's columns `keep`, the exact statistics, base_failed, the calibrated probability and kept."""

    def batch(column: pa.Array) -> list[pa.Array]:
        parts = []
        for _, _, data, offs in tx.chunks(column):
            words = tx.Words(data, offs)
            stats = statistics(data, offs, words)
            failed = (stats[0] < 50) | (100 * stats[4] > 50 * stats[0])
            p = model.probability(data, offs, words)
            parts.append([*stats, failed, ~failed & (p >= model.reject_below), p])
        return [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]

    return map_text(df, keep, text, FIELDS, batch, prefix)
