"""Cells of a SimHash search at a wide radius, and the check of their texts over whole shingle sets.

Search: the fingerprints of one partition of bits are dealt into blocks by the partition's first bits, and sent
as probes to every block that its threshold reaches, so a task sees one block: it flips at most `threshold`
bits of each probe's key, looks the key up and keeps what lies within the radius over all 64 bits and has sets
of fitting sizes. It gives one row per fingerprint, the root of its group inside the block; the closure of these
over all tasks is the cells. A key with very many fingerprints is first compared with the one nearest to the
bitwise majority of them, which joins a group of near copies in time linear in its rows; what that does not
join is compared with all of them. Keys are enumerated in pieces, so a task holds its block's rows (24 bytes each) and one piece.

Check: texts of one cell meet with their whole sets. Starting from one text, a text that is joined is compared with
those that are not joined yet, so pairs inside a group that is found are never listed. Cells beyond a task's
size are dealt into chunks, each with the cell's first text; then only texts outside the largest group of a cell
meet the others, in tiles of two strips, so a large group of near copies is sent once for each strip of outsiders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as tx
from tessera.llm.common import settle
from tessera.llm.components import components
from tessera.llm.embedding_dedup import unite

DENSE, PIECE, BLOCK_ROWS, TABLE_BITS = 64, 1 << 20, 1 << 15, 22
CHUNK_ROWS, CHUNK_SHINGLES = 4096, 1 << 21

Parts = list[tuple[list[int], int]]


def masks(width: int, most: int) -> list[int]:
    """All numbers below 2**width with at most `most` bits set."""
    from itertools import combinations

    return [sum(1 << b for b in c) for k in range(min(most, width) + 1) for c in combinations(range(width), k)]


def extract(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def fits(a: np.ndarray, b: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(a, b) * ratio.denominator >= np.maximum(a, b) * ratio.numerator


class Block:
    """Rows of one block: those of its own, which are looked up, and probes. Joins whatever is within the radius."""

    def __init__(self, fp: np.ndarray, n: np.ndarray, own: np.ndarray, bits: list[int], radius: int, ratio: Fraction):
        self.fp, self.n, self.radius, self.ratio = fp, n, radius, ratio
        self.code = extract(fp, bits)
        index = np.flatnonzero(own)
        self.rows = index[np.argsort(self.code[index], kind="stable")]
        self.keys, self.start, self.count = np.unique(self.code[self.rows], return_index=True, return_counts=True)
        # Narrow keys are looked up in a table, wide ones by bisection.
        self.table = np.full(1 << len(bits), -1, np.int32) if len(bits) <= TABLE_BITS else None
        if self.table is not None:
            self.table[self.keys] = np.arange(len(self.keys))
        self.root, self.waiting = np.arange(len(fp)), []
        self.held = 0

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.radius) & fits(self.n[i], self.n[j], self.ratio)

    def join(self, i: np.ndarray, j: np.ndarray, last: bool = False) -> None:
        self.waiting.append((i, j))
        self.held += len(i)
        if last or self.held > PIECE // 4:
            a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.root, self.waiting, self.held = unite(self.root, a, b), [], 0

    def middles(self) -> np.ndarray:
        """For each crowded key the row nearest to the majority of its fingerprints, else -1."""
        out = np.full(len(self.keys), -1)
        for k in np.flatnonzero(self.count > DENSE):
            own = self.rows[self.start[k] : self.start[k] + self.count[k]]
            ones = sum(np.unpackbits(self.fp[own[lo : lo + 4096]].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for lo in range(0, len(own), 4096))
            centre = np.packbits(2 * ones > len(own)).view(np.uint64)[0]
            out[k] = own[np.argmin(np.bitwise_count(self.fp[own] ^ centre))]
        return out

    def run(self, flips: list[int]) -> np.ndarray:
        if not len(self.keys):
            return self.root
        middle = self.middles()
        for flip in flips:
            want = self.code ^ np.uint64(flip)
            if self.table is not None:
                at = self.table[want]
                probe = np.flatnonzero(at >= 0)
            else:
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                probe = np.flatnonzero(self.keys[at] == want)
            key = at[probe]
            crowd = middle[key] >= 0
            if crowd.any():
                p, m = probe[crowd], middle[key[crowd]]
                ok = self.near(p, m)
                self.join(p[ok], m[ok])
                crowd[np.flatnonzero(crowd)[~ok]] = False
                probe, key = probe[~crowd], key[~crowd]
            self.pieces(probe, key)
        self.join(np.zeros(0, int), np.zeros(0, int), last=True)
        return self.root

    def pieces(self, probe: np.ndarray, key: np.ndarray) -> None:
        """Compares every probe with all rows of its key, about PIECE pairs at a time."""
        ends = np.cumsum(self.count[key])
        lo = 0
        while lo < len(probe):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
            c = self.count[key[lo:hi]]
            i = np.repeat(probe[lo:hi], c)
            j = self.rows[np.repeat(self.start[key[lo:hi]], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)]
            ok = np.flatnonzero(np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.radius)
            i, j = i[ok], j[ok]
            ok = (i != j) & fits(self.n[i], self.n[j], self.ratio)
            self.join(i[ok], j[ok])
            lo = hi


def block_of(fp: str, bits: list[int]) -> Column:
    out = F.lit(0)
    for j, b in enumerate(bits):
        out = out + F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1)).cast("int"), j)
    return out


def search(nodes: DataFrame, parts: Parts, radius: int, ratio: Fraction) -> DataFrame:
    """(u, v) rows whose closure joins all nodes (key, fp, n) within the radius of each other and of fitting sizes."""
    rows = max(1, nodes.count())
    size = max(min(3, (rows // 2048).bit_length()), (rows // BLOCK_ROWS).bit_length())
    copies = []
    for i, (bits, most) in enumerate(parts):
        first = bits[: min(size, len(bits))]
        block = block_of("fp", first)
        copies += [F.struct(F.lit(i).alias("part"), block.bitwiseXOR(F.lit(m)).alias("block"), F.lit(m == 0).alias("own")) for m in masks(len(first), most)]
    flips = [masks(len(bits), most) for bits, most in parts]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part = table.column("part")[0].as_py()
        key, fp = (table.column(c).to_numpy() for c in ("key", "fp"))
        own = table.column("own").to_numpy(zero_copy_only=False)
        root = Block(fp.view(np.uint64), table.column("n").to_numpy(), own, parts[part][0], radius, ratio).run(flips[part])
        some = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": key[some], "v": key[root[some]]})

    return nodes.select("key", "fp", "n", F.inline(F.array(*copies))).groupBy("part", "block").applyInArrow(run, "u bigint, v bigint")


class Sets:
    """Whole sets of a task's texts, and groups of those that are similar enough."""

    def __init__(self, column: pa.ChunkedArray, ratio: Fraction):
        raw, first = tx.buffer(column)
        self.first, self.ratio = first // 8, ratio
        self.n = np.diff(self.first)
        self.ids = np.unique(raw.view(np.uint64), return_inverse=True)[1].astype(np.int32)
        self.flag = np.zeros(int(self.ids.max(initial=-1)) + 1, np.int32)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after the other, and where each row's begin."""
        n = self.n[rows]
        begin = np.cumsum(n) - n
        return self.ids[np.repeat(self.first[rows] - begin, n) + np.arange(int(n.sum()))], begin

    def groups(self, label: np.ndarray) -> np.ndarray:
        """Labels once all similar rows of different labels are joined; rows without shingles keep theirs."""
        label = label.copy()
        left = np.flatnonzero(self.n > 0)
        ids, begin = self.pick(left)
        while len(left):
            name = label[left[0]]
            queue = left[label[left] == name].tolist()
            keep = label[left] != name
            while True:
                if not keep.all():
                    left = left[keep]
                    ids, begin = self.pick(left)
                if not queue or not len(left):
                    break
                x = queue.pop()
                own = self.ids[self.first[x] : self.first[x + 1]]
                self.flag[own] = 1
                both = np.add.reduceat(self.flag[ids], begin)
                self.flag[own] = 0
                up = self.ratio.numerator
                found = both.astype(np.int64) * (up + self.ratio.denominator) >= up * (self.n[left] + self.n[x])
                keep = ~found
                if found.any():
                    joined = np.isin(label, label[left[found]])
                    keep = ~joined[left]
                    queue += left[~keep].tolist()
                    label[joined] = name
        return label


def _similar(ratio: Fraction) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, root = table.column("key").to_numpy(), table.column("root").to_numpy()
        names, label = np.unique(root, return_inverse=True)
        # Small groups lead, so that a large one is left as the rest that need not be gone through.
        size = np.bincount(label)
        order = np.lexsort((key, size[label]))
        found = Sets(table.column("set").take(pa.array(order)), ratio).groups(label[order])
        u, v = key[order], names[found]
        apart = u != v
        return pa.table({"u": u[apart], "v": v[apart]})

    return run


def _strips(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / CHUNK_ROWS), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")


def verified(members: DataFrame, whole: Callable[[DataFrame], DataFrame], ratio: Fraction) -> DataFrame:
    """(u, v) rows whose closure joins all texts of one cell that are similar enough. members: key, node, n, cell; whole: adds their sets, once or more often each."""
    sizes = members.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("key").alias("lead"))
    sizes = sizes.select("cell", "lead", F.greatest(_strips(F.col("rows"), F.col("shingles")), F.lit(1)).alias("chunks"))
    dealt = settle(members.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")))
    sets = settle(whole(dealt).select("key", "cell", "chunk", "chunks", "n", (F.col("key") == F.col("lead")).alias("first"), "set"))
    leads = sets.where("first and chunks > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = sets.where("not first or chunks = 1").unionByName(leads).withColumn("root", F.col("key"))
    near = settle(met.select("cell", "chunk", "key", "root", "set").groupBy("cell", "chunk").applyInArrow(_similar(ratio), "u bigint, v bigint"))
    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return near
    roots = components(near.join(large.select(F.col("key").alias("u")).distinct(), "u", "left_semi"))
    rest = sets.where("chunks > 1").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    by_root = rest.groupBy("cell", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    whole_cell = by_root.groupBy("cell").agg(F.max(F.struct("rows", "root", "shingles")).alias("most"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    inside = _strips(F.col("most.rows"), F.col("most.shingles")).alias("inside")
    outside = _strips(F.col("rows") - F.col("most.rows"), F.col("shingles") - F.col("most.shingles")).alias("outside")
    strips = settle(whole_cell.select("cell", F.col("most.root").alias("main"), F.greatest(inside, F.lit(1)).alias("inside"), outside).where("outside > 0"))
    rest = rest.join(strips, "cell").withColumn("out", F.col("root") != F.col("main"))
    rest = rest.withColumn("strip", F.pmod(F.xxhash64("key"), F.when(F.col("out"), F.col("outside")).otherwise(F.col("inside"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.transform(F.when(F.col("out"), upto("inside")).otherwise(upto("outside")), lambda k: F.struct(F.lit(0).alias("kind"), F.when(F.col("out"), F.col("strip")).otherwise(k).alias("a"), F.when(F.col("out"), k).otherwise(F.col("strip")).alias("b")))
    among = F.transform(upto("outside"), lambda k: F.struct(F.lit(1).alias("kind"), F.least(k, F.col("strip")).alias("a"), F.greatest(k, F.col("strip")).alias("b")))
    tiles = rest.withColumn("tile", F.explode(F.when(F.col("out"), F.concat(across, among)).otherwise(across)))
    return near.unionByName(tiles.select("cell", "tile", "key", "root", "set").groupBy("cell", "tile").applyInArrow(_similar(ratio), "u bigint, v bigint"))
