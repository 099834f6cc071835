"""SimHash near-duplicates (operator 4) by the generalised pigeonhole principle.

Fingerprints: 64 bits; a bit is set if it is set in over half of the XXH64 (seed 42) hashes of the text's
word shingles, repeats included. Equal fingerprints are folded into one node first, the smallest doc_id.
Search: correlated bits are grouped into partitions; a dynamic programme allots a threshold to each
partition (-1: never probed) so that thresholds + 1 add up to radius + 1, minimising the candidates and
probes estimated from a bounded sample of fingerprints. Two fingerprints within the radius then agree
within the threshold in at least one partition. Probes meet the index by partition and key and are
verified over all 64 bits.
Buckets of over `bucket` fingerprints are not paired up: their fingerprints are sent to each key within
half the radius of them, and all that meet at a key are joined as a star, which links exactly what pairwise
comparison would (radius 2: two fingerprints are at 2 or fewer bits just when a common key lies within one
bit of both). At most 65 fingerprints can meet at a key, so no group grows with the input.

Defined results: null and wordless texts have fingerprint zero, linked like any other; fewer words than a
shingle count as one shingle; repeated rows share everything; a row with a null id takes the component of
its fingerprint (`similar_texts`: of its set) if another row has it, else null; an empty table gives an empty
result. For `similar_texts` rows that share an id are one document; shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.cells import extract, search, verified
from tessera.llm.common import map_text, settle, sum_blocks
from tessera.llm.components import components

BITS = 64
BROADCAST = 1 << 19


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", shingle: int = 3, prefix: str = "") -> DataFrame:
    """df's columns `keep` and the fingerprint as a signed 64-bit number `fp`."""
    from xxhash import xxh64_intdigest

    def batch(column: pa.Array) -> list[pa.Array]:
        out = []
        for _, _, data, offs in tx.chunks(column):
            data = tx.lower(data)
            words, raw = tx.Words(data, offs), data.tobytes()
            long = words.ends - words.starts
            hashes, first = [], [0]
            for i, n in enumerate(words.counts.tolist()):
                if n:
                    own = long[words.first[i] : words.first[i + 1]]
                    ends = np.cumsum(own + 1) - 1
                    k = min(shingle, n)
                    joined = b" ".join(raw[offs[i] : offs[i + 1]].split())
                    hashes += [xxh64_intdigest(joined[a:b], 42) for a, b in zip((ends - own)[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
                first.append(len(hashes))
            out.append(majority(np.array(hashes, np.uint64), np.array(first)))
        return [pa.array(np.concatenate(out).view(np.int64))]

    return map_text(df, keep, text, [("fp", "bigint")], batch, prefix)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes; zero for an empty run."""
    out = np.zeros(len(first) - 1, np.uint64)
    n = np.diff(first)
    some = np.flatnonzero(n)
    if len(some):
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            bits = np.unpackbits(np.ascontiguousarray(lanes[:, byte])[:, None], axis=1, bitorder="little")
            count = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
            out[some] |= np.packbits(2 * count > n[some, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def correlations(nodes: DataFrame) -> np.ndarray:
    """The 64 x 64 matrix of bit correlations over all fingerprints."""

    def outer(batches):
        total = np.zeros((BITS + 1, BITS), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 14):
                bits = np.unpackbits(fp[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[:BITS] += (bits.T @ bits).astype(np.int64)
                total[BITS, 0] += len(bits)
        if total[BITS, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["block", "sums"])

    sums = sum_blocks(nodes.select("fp").mapInArrow(outer, "block int, sums binary"))
    if not sums:
        return np.eye(BITS)
    both, n = np.array([sums[i] for i in range(BITS)]) / sums[BITS][0], np.diag(np.array([sums[i] for i in range(BITS)])) / sums[BITS][0]
    spread = np.sqrt(np.maximum(n * (1 - n), 1e-9))
    return (both - np.outer(n, n)) / np.outer(spread, spread)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, each grown by the bit most correlated with it."""
    strength, free, groups = np.abs(corr), set(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        own = [max(free, key=lambda b: (strength[b, list(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            own.append(best := max(free, key=lambda b: (strength[b, own].sum(), -b)))
            free.discard(best)
        groups.append(sorted(own))
    return groups


def allot(cost: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) of least total cost whose values plus 1 add up to radius + 1; cost[i][t + 1] is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, radius - used + 1):
                new = (total + row[t + 1], [*chosen, t])
                if new[0] < step.get(used + t + 1, (inf,))[0]:
                    step[used + t + 1] = new
        best = step
    return best[radius + 1]


def plan(nodes: DataFrame, radius: int, sample: int = 2048) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, from all bit correlations and the part distances within a bounded sample."""
    n = max(2, nodes.count())
    share = int(min(1.0, sample / n) * (1 << 20))
    some = np.sort(nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share).select("fp").limit(4 * sample).toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    corr, found = correlations(nodes), []
    for parts in range(2, radius + 3):
        groups = group_bits(corr, parts)
        cost = []
        for own in groups:
            w, code = len(own), extract(some, own)
            within = np.cumsum(sum((np.bincount(np.bitwise_count(code[lo : lo + 256, None] ^ code).ravel(), minlength=BITS + 1) for lo in range(0, len(code), 256)), np.zeros(BITS + 1, int)))
            pairs = max(1, len(code) * (len(code) - 1))
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(comb(w, i) for i in range(t + 1))
                seen = max(0, int(within[t]) - len(code)) / pairs
                row.append((probes / 2**w + seen) / 2 * n * n / 2 + n * (1 + probes))
            cost.append(row)
        total, thresholds = allot(cost, radius)
        found.append((total, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], t: int) -> list[int]:
    """Masks of at most t of the bits."""
    from itertools import combinations

    return [_mask(list(c)) for k in range(t + 1) for c in combinations(bits, k)]


def links(nodes: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Edges (u, v) between the nodes' ids whose closure joins just the fingerprints within the radius of each other. nodes: fp, node."""
    if radius > 2:
        raise ValueError("large buckets are linked exactly for a radius of at most 2")
    parts = plan(nodes, radius)
    index = None
    for i, (bits, _) in enumerate(parts):
        one = nodes.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key"), "fp", "node")
        index = one if index is None else index.unionByName(one)
    probes = F.array(*(F.array(*(F.lit(m) for m in _flips(bits, t))) for bits, t in parts))
    probe = index.select("part", F.explode(probes[F.col("part")]).alias("flip"), "key", "fp", "node").select("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    sized = settle(index.join(sizes, ["part", "key"]))
    cold = sized.where(F.col("n") <= bucket).join(probe, ["part", "key"]).where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius))
    near = F.array(*(F.lit(m) for m in _flips(list(range(BITS)), 1 if radius == 2 else radius)))
    crowded = sized.where(F.col("n") > bucket).select("part", "key")
    hot = sized.where(F.col("n") > bucket).select("fp", "node")
    if any(t > 0 for _, t in parts):  # those that reach a large bucket from another one
        hot = hot.unionByName(probe.join(crowded.distinct(), ["part", "key"], "left_semi").select(F.col("fp2").alias("fp"), F.col("node2").alias("node")))
    met = hot.distinct().select("fp", "node", F.explode(near).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("at"), "node").groupBy("at").agg(F.collect_list("node").alias("all")).where(F.size("all") > 1)
    star = met.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v")
    return cold.select(F.col("node").alias("u"), F.col("node2").alias("v")).unionByName(star.select("u", "v"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id reachable over links."""
    rows = settle(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), ["doc_id"], shingle=shingle))
    nodes = settle(rows.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, radius))
    rooted = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(rooted, "fp", "left").select("doc_id", "fp", "component_id")


def shingles(words: tx.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's shingles in text order, and where each row's begin (rows + 1); fewer words than a shingle are one."""
    h, n = words.hashes(), words.counts
    k = np.minimum(n, size)
    per_row = np.where(n > 0, n - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(n)), per_row)
    at = words.first[:-1][row] + np.arange(len(row)) - first[:-1][row]
    key = tx.mix(k[row].astype(np.uint64))
    for i in range(size):
        inside = i < k[row]
        key = np.where(inside, tx.mix(key * np.uint64(5) + h[np.where(inside, at + i, at)]), key)
    return key, first


def distinct(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes once, ascending."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.searchsorted(row[new], np.arange(len(first)))


def digests(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number of each row's set; that of an empty one is always the same."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(key ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    return tx.mix(total[first[1:]] - total[first[:-1]]).view(np.int64)


def profiles(df: DataFrame, shingle: int, feature: int) -> DataFrame:
    """(doc_id, key, n, fp): the number of each row's shingle set, its size, and a fingerprint over its runs of `feature` words."""

    def batch(column: pa.Array) -> list[pa.Array]:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for _, _, data, offs in tx.chunks(column):
            words = tx.Words(tx.lower(data), offs)
            key, first = distinct(*shingles(words, shingle))
            for kept, made in zip(out, (digests(key, first), np.diff(first), majority(*shingles(words, feature)).view(np.int64)), strict=True):
                kept.append(made)
        return [pa.array(np.concatenate(x)) for x in out]

    return map_text(df, ["doc_id"], "text", [("key", "bigint"), ("n", "bigint"), ("fp", "bigint")], batch)


def with_sets(df: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """members (key, node, ...) with their whole shingle sets, taken from the texts of df whose id is node."""

    def batch(column: pa.Array) -> list[pa.Array]:
        keys, out = [np.zeros(0, np.int64)], []
        for _, _, data, offs in tx.chunks(column):
            key, first = distinct(*shingles(tx.Words(tx.lower(data), offs), shingle))
            keys.append(digests(key, first))
            out += [key[a:z].tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return [pa.array(np.concatenate(keys)), pa.array(out, pa.binary())]

    few = F.broadcast if members.count() <= BROADCAST else lambda x: x
    some = df.join(few(members.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    return map_text(some, [], "text", [("key", "bigint"), ("set", "binary")], batch).join(few(members), "key")


def similar_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 10, feature: int = 2) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest id reachable over pairs of texts of at least the similarity (Jaccard, sets of shingles)."""
    ratio = Fraction(str(similarity))
    df = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = settle(profiles(df, shingle, feature))
    named = rows.where(F.col("doc_id").isNotNull())
    nodes = settle(named.groupBy("key").agg(F.min(F.struct("doc_id", "n", "fp")).alias("own")).select("key", F.col("own.doc_id").alias("node"), "own.n", "own.fp"))
    found = components(search(nodes, plan(nodes, radius), radius, ratio)).select(F.col("node").alias("key"), F.col("root").alias("cell"))
    similar = verified(nodes.join(found, "key").select("key", "node", "n", "cell"), lambda members: with_sets(df, members, shingle), ratio)
    ids = named.groupBy("doc_id").agg(F.min("key").alias("v"), F.max("key").alias("most")).where("v < most")
    same = named.select("doc_id", F.col("key").alias("u")).join(ids, "doc_id").where("u <> v").select("u", "v")
    joined = components(similar.unionByName(same))
    rooted = nodes.select("key", "node").join(joined.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "node", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("node").alias("component_id"))
    return rows.select("doc_id", "key").join(rooted.join(smallest, "root").select("key", "component_id"), "key", "left").select("doc_id", "component_id")
