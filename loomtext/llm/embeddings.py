"""Embedding near-duplicates by randomised-rotation binary codes.

Every distinct vector is coded once: the signs of its coordinates under ROTATIONS random rotations, one bit each, and
a correction factor, the cosine of the vector with what its code decodes to (the sum of the signed axes). Code and
factor are stored. For a coded x and a vector y, the cosine of y with x's decoded code, divided by x's factor, is an
unbiased estimate of the cosine of x and y; and as angles obey the triangle inequality, it bounds that cosine: y can
reach the threshold only if its angle to the decoded code is not above the code's own angle plus the threshold's.
Pairs whose bound stays below the threshold are settled by the codes; the others, and only they, are recomputed from
the full vectors in double precision, and those results alone make links. The bound holds always, so no pair is lost,
whatever the dimension and the number of vectors.

The vectors of a label are dealt into blocks and each pair of blocks meets in one group, where the estimates are one
matrix product; the work grows with the square of a label's distinct vectors. Equal vectors form one class that is
compared once. What leaves a group is a count per vector and one edge per vector to its component in the group,
never the pairs.

Nulls: a null label, a null or zero vector, one with null or non-finite components, or of another length, links
with nothing. A row is compared as often as it stands in the table; rows with equal vec_id and label share a result
by class. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.graph import block_pairs, chunks, components
from loomtext.llm.storage import Scratch, map_batches, only, settle
from loomtext.llm.words import spread

ROTATIONS = 4
BLOCK = 1024
#: Labels of at most so many vectors are estimated pair by pair, larger ones as matrices.
FEW = 64
#: More than rounding can move an estimate in single precision.
SLACK = 1e-5


@functools.lru_cache(maxsize=8)
def rotations(dim: int, count: int = ROTATIONS) -> np.ndarray:
    """Random rotations side by side: a vector times it gives its coordinates under all of them."""
    rng = np.random.default_rng(20240 + dim)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)], axis=1)


def encoded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors of unit vectors."""
    code = np.packbits(unit @ rotations(unit.shape[1]) >= 0, axis=1)
    return code, np.einsum("ij,ij->i", decoded(code, unit.shape[1]), unit)


def decoded(code: np.ndarray, dim: int) -> np.ndarray:
    """The unit vectors that codes stand for: the sum of the rotations' axes, each with its sign."""
    axes = rotations(dim)
    signs = np.unpackbits(code, axis=1, count=axes.shape[1]).astype(np.float64) * 2 - 1
    sums = signs @ axes.T
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)


def least_cosine(factor: np.ndarray, threshold: float) -> np.ndarray:
    """The cosine with the decoded code below which no vector reaches the threshold with the coded one."""
    return np.cos(np.minimum(np.arccos(np.clip(factor, -1, 1)) + math.acos(threshold), math.pi)) - SLACK


def _coded(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, factor = encoded(_units(batch.column("embedding"), dim)) if batch.num_rows else (np.zeros((0, 1), np.uint8), np.zeros(0))
            cols = [batch.column(c) for c in ("label", "class_id", "n", "embedding")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor)], ["label", "class_id", "n", "embedding", "code", "factor"])

    return run


def _units(batch_vectors: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(batch_vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    scaled = flat / np.abs(flat).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _within(n: int, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least index linked to each of n, by repeated minima along the edges."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, edges[0], low[edges[1]])
        np.minimum.at(new, edges[1], low[edges[0]])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(dim: int, threshold: float):
    def run(batches):
        for chunk, cut in chunks(batches, ["label", "_i", "_j"]):
            side = chunk.column("_side").to_numpy()
            name, n = chunk.column("class_id").to_numpy(), chunk.column("n").to_numpy()
            unit = _units(chunk.column("embedding").combine_chunks(), dim)
            short = unit.astype(np.float32)
            code = np.frombuffer(b"".join(chunk.column("code").to_pylist()), np.uint8).reshape(len(name), -1)
            meant, least = decoded(code, dim).astype(np.float32), least_cosine(chunk.column("factor").to_numpy(), threshold).astype(np.float32)
            one, two = [], []

            def recomputed(x, y):
                cosine = np.einsum("ij,ij->i", unit[x], unit[y])
                one.append(x[cosine >= threshold])
                two.append(y[cosine >= threshold])

            size = np.diff(cut)
            whole = chunk.column("_i").to_numpy()[cut[:-1]] == chunk.column("_j").to_numpy()[cut[:-1]]
            few = whole & (size <= FEW)
            row = spread(cut[:-1][few], size[few])
            after = np.repeat(cut[1:][few], size[few]) - row - 1
            x, y = np.repeat(row, after), spread(row + 1, after)
            for at in range(0, len(x), 65536):
                u, v = x[at : at + 65536], y[at : at + 65536]
                open_ = np.einsum("ij,ij->i", meant[u], short[v]) >= least[u]
                recomputed(u[open_], v[open_])
            for k in np.flatnonzero(~few):
                rows = np.arange(cut[k], cut[k + 1])
                left = rows[side[rows] == 0]
                right = left if whole[k] else rows[side[rows] == 1]
                for at in range(0, len(left), 256):
                    a = left[at : at + 256]
                    i, j = np.nonzero(meant[a] @ short[right].T >= least[a][:, None])
                    p, q = a[i], right[j]
                    for low in range(0, len(p), 65536):
                        u, v = p[low : low + 65536], q[low : low + 65536]
                        recomputed(*((u[u < v], v[u < v]) if whole[k] else (u, v)))
            x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (one, two))
            if len(x):
                count = np.zeros(len(name), np.int64)
                np.add.at(count, x, n[y])
                np.add.at(count, y, n[x])
                root = _within(len(name), (x, y))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(count[some]), pa.array(name[root[some]])], ["class_id", "links", "root"])

    return run


def cluster(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = only(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite, F.lit(False)))
    usable = rows.filter("usable")
    name = F.xxhash64("label", "embedding")
    scratch = Scratch()
    classes = scratch.settle(usable.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id")).withColumn("class_id", name), "vector-classes")
    links = None
    for dim in sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect()):
        own = classes.filter(F.size("embedding") == dim).select("label", "class_id", "n", "embedding")
        kinds = dict(own.dtypes)
        own = scratch.settle(map_batches(own, _coded(dim), f"label {kinds['label']}, class_id long, n long, embedding {kinds['embedding']}, code binary, factor double"), "vector-codes")
        blocked = block_pairs(own.select("label", "class_id"), ["label"], "class_id", BLOCK).join(own.drop("label"), "class_id")
        order = ["label", "_i", "_j"]
        found = map_batches(blocked.repartition(*order).sortWithinPartitions(*order), _links(dim, threshold), "class_id long, links long, root long")
        links = found if links is None else links.unionByName(found)
    if links is None:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    links = scratch.settle(links, "vector-links")
    counts = links.groupBy("class_id").agg(F.sum("links").alias("links"))
    labels = components(links, "class_id", "root", scratch=scratch).select(F.col("node").alias("class_id"), "label").withColumnRenamed("label", "part")
    part = F.coalesce("part", "class_id").alias("part")
    named = classes.join(labels, "class_id", "left").join(counts, "class_id", "left").select("class_id", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), part)
    smallest = named.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    of_class = settle(named.join(smallest, "part").select("class_id", "n_links", "component_id"), "vector-components")
    scratch.drop()
    out = rows.select("vec_id", F.when(F.col("usable"), name).alias("class_id")).join(of_class, "class_id", "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
