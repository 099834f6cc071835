"""Embedding near-duplicates (operator 7): int8 tile products with rigorous error bounds.

Equal vectors are folded into one first. Distinct ones are dealt into strips of about `strip_rows` by hash, and
every pair of strips is one tile, so a task holds two strips whatever the number of vectors. In a tile, vectors
are scaled to length 1 and quantised to int8 with a scale of their own; the length of what quantisation lost is
kept as e. Products of the codes are whole numbers below 2**24 for up to 1040 dimensions, so a float32 matrix
product gives them exactly (longer vectors are multiplied in float64). As |x.y - x^.y^| <= e_x + (1 + e_x) e_y,
a pair whose product falls short of the threshold by more than this cannot be a link; all others are computed
again in double precision. A tile emits one row per vector with a link: how many vectors it is linked to and the
smallest of its group inside the tile, which keeps connectivity without listing pairs.

The comparison is all against all, as the operator asks; work grows with the square of the number of distinct
vectors, spread evenly over tiles.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component have no links and are
components of their own, as is any row with a null id (whose component is null); vectors of different length are
never linked; rows equal in id and vector are one vector, and rows of one id with unlike vectors are vectors of their own
with links of their own that share a component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle
from tessera.llm.components import components

TILE_ROWS, CHECK_ROWS, SLACK = 512, 1 << 14, 1e-5
LEAST_STRIPS = 12  # so that smaller tables too make enough tiles to spread


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (each the smallest index of its group, every entry pointing at it) after joining a[i] with b[i]."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


class Strip:
    """Vectors of a strip, scaled by their largest component; codes, scales and quantisation errors of their unit vectors."""

    def __init__(self, rows: np.ndarray):
        self.raw = rows / np.abs(rows).max(1, keepdims=True)
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        unit = self.raw / self.norm[:, None]
        self.scale = np.abs(unit).max(1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.linalg.norm(unit - self.codes * self.scale[:, None], axis=1) + 1e-12


def tile_links(a: Strip, b: Strip, threshold: float, same: bool):
    """Index pairs of links between two strips (each pair once if they are the same), a few rows of the first at a time."""
    kind = np.float32 if a.codes.shape[1] <= 1040 else np.float64
    right = np.ascontiguousarray(b.codes.astype(kind).T)
    for lo in range(0, len(a.codes), TILE_ROWS):
        hi = min(lo + TILE_ROWS, len(a.codes))
        product = a.codes[lo:hi].astype(kind) @ right
        product *= a.scale[lo:hi, None].astype(kind)
        product *= b.scale[None].astype(kind)
        product += (1 + a.error[lo:hi, None]).astype(kind) * b.error[None].astype(kind)
        i, j = np.nonzero(product >= (threshold - SLACK - a.error[lo:hi, None]).astype(kind))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), CHECK_ROWS):
            p, q = i[k : k + CHECK_ROWS], j[k : k + CHECK_ROWS]
            link = np.einsum("ij,ij->i", a.raw[p], b.raw[q]) / (a.norm[p] * b.norm[q]) >= threshold
            if link.any():
                yield p[link], q[link]


def links(nodes: DataFrame, threshold: float, strip_rows: int) -> DataFrame:
    """(node, linked, root) rows of the tiles. nodes: node, copies, vec."""
    n = nodes.count()
    strips = max(1, -(-n // strip_rows), min(LEAST_STRIPS, -(-n // 1024)))
    dealt = nodes.withColumn("strip", F.pmod(F.xxhash64("node", "vec"), F.lit(strips)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    dealt = dealt.select(F.least("strip", "other").alias("lo"), F.greatest("strip", "other").alias("hi"), "strip", F.size("vec").alias("dim"), "node", "copies", "vec")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        lo, hi, dim = (table.column(c)[0].as_py() for c in ("lo", "hi", "dim"))
        strip, node, copies = (table.column(c).to_numpy() for c in ("strip", "node", "copies"))
        vec = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
        first, second = np.flatnonzero(strip == lo), np.flatnonzero(strip == hi)
        linked, root = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(first) and len(second):
            a = Strip(vec[first])
            for i, j in tile_links(a, a if lo == hi else Strip(vec[second]), threshold, lo == hi):
                i, j = first[i], second[j]
                linked += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
                root = unite(root, i, j)
        some = np.flatnonzero(linked)
        return pa.table({"node": pa.array(node[some], pa.int64()), "linked": linked[some], "root": pa.array(node[root[some]], pa.int64())})

    return dealt.groupBy("lo", "hi", "dim").applyInArrow(run, "node bigint, linked bigint, root bigint")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, strip_rows: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    vec = F.col(embedding)
    sound = F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(sound, vec).alias("vec"))
    rows = settle(rows.withColumn("key", F.when(F.col("vec").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("vec"))))
    nodes = rows.where("key is not null").groupBy("key", "vec").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    placed = rows.where("key is not null").alias("r").join(nodes.alias("n"), (F.col("r.key") == F.col("n.key")) & (F.col("r.vec") == F.col("n.vec")))
    placed = settle(placed.select("vec_id", "node"))
    found = settle(links(nodes.select("node", "copies", "vec"), threshold, strip_rows))
    ids = placed.groupBy("vec_id").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most")
    same = placed.join(ids, "vec_id").select(F.col("node").alias("u"), "v")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(same))
    counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    judged = nodes.select("node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = judged.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = judged.join(smallest, "root").select("node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    sound = placed.join(judged, "node").select("vec_id", "n_links", "component_id")
    of_id = sound.groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    rest = rows.where("key is null").select("vec_id").join(of_id, "vec_id", "left").select("vec_id", F.lit(0).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return sound.unionByName(rest).select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
