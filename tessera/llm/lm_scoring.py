"""LM scoring (operator 3): a hashed maximum-entropy language model with a class-factored softmax.

Tokens are lower-cased words and one end per text, identified by a 64-bit hash. Every token has a place among
`WIDTH`**3 leaves, which classes of `WIDTH` and classes inside them lead to: the most frequent tokens, in order, have a
leaf each, up to `OWN` of them; all others share the rest of the leaves by hash. A token's probability is that of its class, of the
class inside it and of its leaf, each a softmax over `WIDTH`, and, in a shared leaf, an absolutely discounted relative
frequency whose discount goes to unseen words.
The softmaxes see hashed features of the whole context words, whatever their frequency: the word before, the pair before, and
the words two and three places back (skips). Features and the path so far are hashed to `bits` bits, a row of weights each.

Training: counts over all training texts come from one partially aggregated shuffle. The weights are then
trained over all training texts in `rounds` disjoint slices: tasks update the shared weights on their own part
by Adagrad steps and emit their change in fixed point; a row's changes are averaged by how often tasks have met it and
applied before the next slice. Whole numbers add up alike in any order.

Scoring: the `FREQUENT` most frequent tokens' counts (a bounded table) travel to the executors; all rarer
words are joined with their exact counts by hash. Sums are then put together per text, so every word counts
exactly and nothing that is broadcast grows with the vocabulary.

Defined results: a null or empty text is one end token; repeated rows score alike; an empty table gives an
empty result; without training texts every probability is 1. Texts with a null id are training texts. Other
columns are ignored unless named in `keep`; one named like an output gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text as tx
from tessera.llm.common import settle, sum_blocks

WIDTH = 32
LEAVES = WIDTH**3
OWN = LEAVES * 3 // 4
SHARED = LEAVES - OWN
FREQUENT = 1 << 18
DISCOUNT = 0.4
BATCH, RATE, START, BLOCK = 1 << 15, 0.1, 1.0, 256
SCALE = 1 << 20
END, BOS = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x2545F4914F6CDD1D)
#: The features that each level sees: 0 the word before, 1 the pair before, 2 and 3 the words two and three places back.
LEVELS = ((0, 1, 2, 3), (0, 1, 2), (0, 2))


@dataclass
class Sequence:
    """Tokens of a chunk with the end tokens in place; first: where each row's begin (rows + 1)."""

    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offs: np.ndarray) -> Sequence:
        words = tx.Words(tx.lower(data), offs)
        rows = len(words.counts)
        hashes = np.full(len(words) + rows, END, np.uint64)
        hashes[np.arange(len(words)) + words.rows()] = words.hashes()
        return cls(hashes, words.first + np.arange(rows + 1))


def shared_leaf(hashes: np.ndarray) -> np.ndarray:
    """The leaf that a token without one of its own shares."""
    return OWN + (tx.mix(hashes) % np.uint64(SHARED)).astype(np.int32)


@dataclass
class Vocabulary:
    """What is known of the training tokens: the frequent ones one by one, sums of the rest."""

    total: int
    distinct: int
    hashes: np.ndarray  # frequent tokens, sorted
    counts: np.ndarray
    own: np.ndarray  # the leaf of those that have one, else -1
    priors: list[np.ndarray]  # log share of each class, of each class in its class, of each leaf in that
    mass: np.ndarray  # tokens of each shared leaf, with a place for unseen words
    unseen: np.ndarray  # what of that goes to unseen words

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among the frequent tokens, and whether it is one of them."""
        if not len(self.hashes):
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def empty_weights(bits: int) -> np.ndarray:
    return np.zeros((len(LEVELS) << bits, WIDTH), np.float32)


def count(docs: DataFrame) -> DataFrame:
    """(h, n): exact counts of all tokens of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            u, back = np.unique(h, return_inverse=True)
            return u, np.bincount(back, n, len(u)).astype(np.int64)

        def out(part) -> pa.RecordBatch:
            h, n = part
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for b in batches:
            for _, _, data, offs in tx.chunks(b.column(0)):
                u, n = np.unique(Sequence.of(data, offs).hashes, return_counts=True)
                kept.append((u, n))
                size += len(u)
                if size > 1 << 20:
                    kept = [merged()]
                    size = len(kept[0][0])
                    if size > 1 << 19:
                        yield out(kept.pop())
                        size = 0
        if kept:
            yield out(merged())

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded summary of the counts."""
    level = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("level")).collect()
    least, held = None, 0
    for r in steps:
        held += r["words"]
        if held > FREQUENT:
            break
        least = r["level"]
    rows = counts.where(level >= (least if least is not None else 1 << 20)).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    own = np.full(len(h), -1, np.int32)
    best = np.lexsort((h, -n))[:OWN]
    own[best] = np.arange(len(best))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        for b in batches:
            leaf = shared_leaf(b.column(0).to_numpy().view(np.uint64)) - OWN
            tokens += np.bincount(leaf, b.column(1).to_numpy(), SHARED).astype(np.int64)
            words += np.bincount(leaf, minlength=SHARED)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([tokens.tobytes(), words.tobytes()], pa.binary())], names=["block", "sums"])

    found = sum_blocks(counts.select("h", "n").mapInArrow(sums, "block int, sums binary"))
    mass, words = (found.get(k, np.zeros(SHARED, np.int64)).astype(float) for k in (0, 1))
    leaf = shared_leaf(h[best]) - OWN
    mass, words = mass - np.bincount(leaf, n[best], SHARED), words - np.bincount(leaf, minlength=SHARED)
    mass = np.maximum(mass, 0) + 1.0  # one more, for unseen words in a leaf without any
    leaves = np.zeros(LEAVES)
    leaves[: len(best)], leaves[OWN:] = n[best], mass
    tree, priors = leaves.reshape(WIDTH, WIDTH, WIDTH), []
    for part in (tree.sum((1, 2)).reshape(1, -1), tree.sum(2), tree.reshape(-1, WIDTH)):
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log(part / part.sum(1, keepdims=True))
        priors.append(np.maximum(np.nan_to_num(share, nan=-30, neginf=-30), -30).astype(np.float32))
    return Vocabulary(int(sum(r["tokens"] for r in steps)), int(sum(r["words"] for r in steps)), h, n, own, priors, mass, np.maximum(DISCOUNT * words, 0.5))


class Batch:
    """Leaves and hashed context features of a sequence."""

    def __init__(self, s: Sequence, v: Vocabulary, bits: int):
        self.at, self.known = v.find(s.hashes)
        own = np.where(self.known, v.own[self.at] if len(v.own) else -1, -1)
        self.shared = own < 0
        self.leaf = np.where(self.shared, shared_leaf(s.hashes), own)
        depth = np.arange(len(own)) - np.repeat(s.first[:-1], np.diff(s.first))
        back = []
        for k in (1, 2, 3):
            c = np.full(len(own), BOS, np.uint64)
            c[k:] = s.hashes[:-k]
            c[depth < k] = BOS
            back.append(c)
        odd = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
        self.features = [back[0] * odd[0], (back[0] * np.uint64(5) + back[1]) * odd[1], back[1] * odd[2], back[2] * odd[3]]
        self.bits = bits
        self.step = [self.leaf // (WIDTH * WIDTH), self.leaf // WIDTH % WIDTH, self.leaf % WIDTH]
        self.path = [np.zeros_like(self.leaf), self.step[0], self.leaf // WIDTH]

    def logs(self, v: Vocabulary, w: np.ndarray, level: int, lo: int, hi: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows of weights that tokens lo..hi use at a level, and the log softmax over the level's choices."""
        path = self.path[level][lo:hi]
        salt = (path.astype(np.uint64) + np.uint64(level << 20 | 1)) * np.uint64(0xFF51AFD7ED558CCD)
        rows = [(((self.features[f][lo:hi] ^ salt) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - self.bits)).astype(np.int32) + np.int32(level << self.bits) for f in LEVELS[level]]
        z = np.take(w, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(w, r, axis=0)
        z += v.priors[level][path]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return rows, z


def _step(weights: np.ndarray, squares: np.ndarray, hits: np.ndarray, rows: list[np.ndarray], low: int, error: np.ndarray) -> None:
    """An Adagrad step on the rows of one level, which begin at `low`, that occur; error: gradient of each token's logits."""
    rows = np.concatenate(rows) - low
    n = np.bincount(rows)
    own = np.flatnonzero(n)
    place = np.zeros(len(n), np.intp)
    place[own] = np.arange(len(own))
    place, times = place[rows], len(rows) // len(error)
    g = np.empty((WIDTH, len(own)), np.float32)
    for c, column in enumerate(np.ascontiguousarray(error.T, np.float64)):
        g[c] = np.bincount(place, np.tile(column, times), len(own))
    g, own = g.T, own + low
    hits[own] += n[own - low]
    now = squares[own] + g * g
    squares[own] = now
    weights[own] -= RATE * g / np.sqrt(now)


def _by_weight(part: np.ndarray) -> np.ndarray:
    """Changes times the weight that stands behind each row of them, and the weights."""
    part = part.astype(np.int64).reshape(-1, WIDTH + 1)
    part[:, :-1] *= part[:, -1:]
    return part.ravel()


def train(docs: DataFrame, v: Vocabulary, rounds: int = 3, bits: int = 14) -> np.ndarray:
    """docs (text, draw): all are used, each in the round that draw gives. Rows of weights, `1 << bits` a level."""
    shared = empty_weights(bits)
    for turn in range(rounds):
        now = shared.copy()

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            w, squares, hits = now.copy(), np.full_like(now, START), np.zeros(len(now), np.int64)
            for b in batches:
                for _, _, data, offs in tx.chunks(b.column(0)):
                    x = Batch(Sequence.of(data, offs), v, bits)
                    for lo in range(0, len(x.leaf), BATCH):
                        hi = min(lo + BATCH, len(x.leaf))
                        for level in range(len(LEVELS)):
                            rows, error = x.logs(v, w, level, lo, hi)
                            np.exp(error, out=error)
                            error[np.arange(hi - lo), x.step[level][lo:hi]] -= 1
                            _step(w, squares, hits, rows, level << bits, error)
            if hits.any():
                blocks = np.concatenate([np.rint((w - now) * SCALE).astype(np.int32), -(-hits[:, None] // 16).astype(np.int32)], axis=1).reshape(-1, BLOCK * (WIDTH + 1))
                some = np.flatnonzero(hits.reshape(-1, BLOCK).any(1))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "sums"])

        slice_ = docs.where(F.pmod("draw", F.lit(rounds)) == turn).select("text")
        for k, sums in sum_blocks(slice_.mapInArrow(run, "block int, sums binary"), np.int32, _by_weight).items():
            part = sums.reshape(BLOCK, WIDTH + 1)
            shared[k * BLOCK : (k + 1) * BLOCK] += part[:, :-1] / np.maximum(part[:, -1:], 1) / SCALE
    return shared


def score(df: DataFrame, counts: DataFrame, v: Vocabulary, w: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """df's columns `keep`, n_tokens, n_known, train_tokens, base_score and score."""
    outputs = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in keep if c not in outputs]
    rare_type = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("m", T.LongType()), T.StructField("unseen", T.DoubleType())]))
    made = [T.StructField(n, k) for n, k in (("uid", T.LongType()), ("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("rare", rare_type))]
    carried = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*carried, *made])
    below, bits = np.log10(v.total + 0.5 * (v.distinct + 1)), (len(w) // len(LEVELS)).bit_length() - 1

    def batch(column: pa.Array) -> list[pa.Array]:
        out: list[list[np.ndarray]] = [[], [], [], []]
        lists = []
        for _, _, data, offs in tx.chunks(column):
            s = Sequence.of(data, offs)
            x = Batch(s, v, bits)
            n = v.counts[x.at] if len(v.counts) else np.zeros(len(x.at))
            value = np.zeros(len(x.leaf))
            for lo in range(0, len(value), BATCH):
                hi = min(lo + BATCH, len(value))
                for level in range(len(LEVELS)):
                    value[lo:hi] += x.logs(v, w, level, lo, hi)[1][np.arange(hi - lo), x.step[level][lo:hi]]
            rest = np.flatnonzero(x.shared)
            value[rest] -= np.log(v.mass[x.leaf[rest] - OWN])
            some = rest[x.known[rest]]
            value[some] += np.log(n[some] - DISCOUNT)
            base = np.where(x.known, np.log10(n + 0.5) - below, 0.0)
            for whole, part in zip(out, (np.ones(len(value), np.int64), x.known.astype(np.int64), base, value / np.log(10)), strict=True):
                whole.append(tx.row_sums(part, s.first))
            at = np.flatnonzero(~x.known)
            row = np.searchsorted(s.first, at, "right") - 1
            _, first, m = np.unique(tx.mix(s.hashes[at] ^ tx.mix(row.astype(np.uint64))), return_index=True, return_counts=True)
            order = np.argsort(row[first], kind="stable")
            pick = at[first[order]]
            fields = pa.StructArray.from_arrays([pa.array(s.hashes[pick].view(np.int64)), pa.array(m[order], pa.int64()), pa.array(v.unseen[x.leaf[pick] - OWN])], names=["h", "m", "unseen"])
            lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first[order]], np.arange(len(offs))), pa.int32()), fields))
        return [*(pa.array(np.concatenate(m)) for m in out), pa.concat_arrays(lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(np.arange(uid, uid + b.num_rows)), *batch(b.column(len(keep)))], names=schema.names)
                uid += b.num_rows

    rows = settle(df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string")).mapInArrow(run, schema))
    n = F.coalesce("c.n", F.lit(0))
    rare = rows.select(F.col("uid"), F.inline("rare")).alias("r").join(counts.alias("c"), F.col("r.h") == F.col("c.h"), "left")
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("known"),
        F.sum(F.col("m") * (F.log10(n + 0.5) - float(below))).alias("base"),
        F.sum(F.col("m") * F.log10(F.when(n > 0, n - DISCOUNT).otherwise(F.col("unseen")))).alias("score"),
    )
    whole = rows.alias("a").join(rare.alias("b"), "uid", "left")
    plus = lambda c: F.col(f"a.{c}") + F.coalesce(F.col(f"b.{c}"), F.lit(0.0 if c != "known" else 0))
    return whole.select(*(F.col(f"a.k{i}").alias(c) for i, c in enumerate(keep)), F.col("a.n").alias("n_tokens"), plus("known").cast("bigint").alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"), plus("base").alias("base_score"), (F.lit(0.0) if v.total == 0 else plus("score")).alias("score"))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, bits: int = 14) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts, vocabulary summary and weights from all texts of docs."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(doc_id)).alias("draw"))
    counts = settle(count(texts))
    v = vocabulary(counts)
    return counts, v, train(texts, v, rounds, bits)
