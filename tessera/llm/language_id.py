"""Language ID (operator 5): string-kernel classification.

Kernel: blended-spectrum presence kernel over byte n-grams of lengths 1 to 4 of the lower-cased text, that
is the cosine of the sets of n-grams present, hashed to `GRAMS` columns. Nystroem landmarks are documents
drawn evenly from the languages; one-versus-rest kernel ridge regression runs in the landmark space. Scoring
builds a batch's presence matrix and multiplies it with the landmarks and then the class weights.

Every language of the training rows is learned. Bounds of the sample it is learned from: `per_lang` documents and
`landmarks_per_lang` landmarks of each language, drawn by hash of id and text; with many languages fewer of each, about
`documents` and `landmarks` in all, but at least 8 documents and one landmark.

Defined results: a null text or one without any letter is `und` with score 0; repeated rows get the same
answer; an empty table gives an empty result; with nothing to learn from every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.common import fold, map_text

BITS, ORDERS, TILE = 13, (1, 2, 3, 4), 128
GRAMS = 1 << BITS


def cells(n: int, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The presence column of each n-gram, and where each row's n-grams begin."""
    code = code.astype(np.uint32) * np.uint32(2654435761) + np.uint32((n * 0x61C88647) & 0xFFFFFFFF)
    return ((code ^ (code >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS), first


def presence(column: pa.Array):
    """(rows x GRAMS) 0/1 matrices of at most TILE texts each, every row scaled to length 1."""
    for _, _, data, offs in tx.chunks(column):
        data = tx.lower(data)
        found = [cells(n, *tx.grams(data, offs, n)) for n in ORDERS]
        for lo in range(0, len(offs) - 1, TILE):
            hi = min(lo + TILE, len(offs) - 1)
            seen = np.zeros((hi - lo, GRAMS), np.float32)
            for cell, first in found:
                row = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
                seen[row, cell[first[lo] : first[hi]]] = 1
            yield seen / np.sqrt(np.maximum(seen.sum(1, keepdims=True), 1))


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    landmarks: np.ndarray  # GRAMS x landmarks
    weights: np.ndarray  # landmarks x langs
    bias: np.ndarray
    temperature: float

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its probability for each text."""
        best, score = [np.zeros(0, int)], [np.zeros(0)]
        for x in presence(column):
            z = ((x @ self.landmarks) @ self.weights + self.bias) / self.temperature
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            best.append(z.argmax(1))
            score.append(z.max(1))
        return np.concatenate(best), np.concatenate(score)


def train(docs: DataFrame, learnable, lang: str = "lang", per_lang: int = 800, landmarks_per_lang: int = 32, documents: int = 32_000, landmarks: int = 1024, ridge: float = 1e-3) -> LanguageModel | None:
    known = docs.where(learnable & F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id", F.col("text").cast("string")).alias("draw"), F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = known.groupBy("lang").count()
    sizes = sorted(counted.collect(), key=lambda r: r["lang"])
    if not sizes:
        return None
    per_lang = max(8, min(per_lang, documents // len(sizes)))
    landmarks_per_lang = max(1, min(landmarks_per_lang, landmarks // len(sizes)))
    # Shares leave a margin above per_lang so that every language fills its quota; the surplus goes below.
    shares = counted.select(F.col("lang").alias("of"), F.least(F.lit(1.0), 1.25 * per_lang / F.col("count")).alias("share"))
    drawn = known.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("draw", "lang", "text")
    kernels = map_text(drawn, ["draw", "lang"], "text", [("x", "binary")], lambda c: [pa.array([np.packbits(r > 0).tobytes() for x in presence(c) for r in x], pa.binary())])
    rows = kernels.dropDuplicates(["draw"]).toArrow().sort_by([("lang", "ascending"), ("draw", "ascending")])
    tags, raw = np.array(rows.column("lang").to_pylist()), rows.column("x").to_pylist()
    langs = [r["lang"] for r in sizes]
    keep = np.concatenate([np.flatnonzero(tags == name)[:per_lang] for name in langs])
    marks = np.concatenate([np.flatnonzero(tags[keep] == name)[:landmarks_per_lang] for name in langs])

    def matrix(which: np.ndarray) -> np.ndarray:
        x = np.unpackbits(np.array([np.frombuffer(raw[i], np.uint8) for i in which]).reshape(-1, GRAMS // 8), axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    columns = matrix(keep[marks]).T.copy()
    values, vectors = np.linalg.eigh((columns.T @ columns).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = np.concatenate([matrix(keep[i : i + 512]) @ columns for i in range(0, len(keep), 512)]).astype(float) @ root
    y = np.where(tags[keep][:, None] == np.array(langs)[None], 1.0, -1.0)
    weight = 1 / np.array([(tags[keep] == t).sum() for t in tags[keep]])
    weight = weight / weight.sum()
    mean, target = weight @ phi, weight @ y
    centred = phi - mean
    beta = np.linalg.solve((centred * weight[:, None]).T @ centred + ridge / len(keep) ** 0.5 * np.eye(phi.shape[1]), (centred * weight[:, None]).T @ (y - target))
    z = centred @ beta + target
    grid = np.exp(np.linspace(np.log(0.02), np.log(2), 40))
    right = np.array([langs.index(t) for t in tags[keep]])

    def loss(t: float) -> float:
        q = z / t
        return float(np.mean(np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(q)), right]))

    return LanguageModel(langs, columns, (root @ beta).astype(np.float32), (target - mean @ beta).astype(np.float32), float(min(grid, key=loss)))


def identify(df: DataFrame, model: LanguageModel | None, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """df's columns `keep`, lang_pred and its score."""
    flag = prefix + "__letter"

    def batch(column: pa.Array) -> list[pa.Array]:
        if model is None:
            return [pa.array(["und"] * len(column), pa.string()), pa.array(np.zeros(len(column)))]
        best, score = model.decide(column)
        return [pa.array([model.langs[i] for i in best], pa.string()), pa.array(score)]

    marked = df.withColumn(flag, F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)))
    out = map_text(marked, [*keep, flag], text, [("lang_pred", "string"), ("score", "double")], batch, prefix)
    pred, score = F.col(prefix + "lang_pred"), F.col(prefix + "score")
    return out.withColumns({prefix + "lang_pred": F.when(F.col(flag), pred).otherwise("und"), prefix + "score": F.when(F.col(flag), score).otherwise(0.0)}).drop(flag)
