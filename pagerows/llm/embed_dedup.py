"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Many trees split recursively along random directions, by a sample; a vector near a split goes to both sides.
Vectors are compared only within leaves; a pair that shares several leaves counts in the first. Equal vectors are one
class and never expanded. A leaf with many vectors is cut into blocks, and blocks are compared two by two, so no task
holds more than two blocks and nothing is left out. Links found are verified by their exact cosine and united.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, small_batches
from .components import connected_components

THRESHOLD = 0.93
TREES, LEAF, BLOCK = 8, 512, 1024
#: Half the width of the overlap, in units of a vector of length 1 along a random direction, times sqrt(dimensions).
SPILL = 0.1
#: Vectors that splits are fitted on, at most, and levels that are; every vector is indexed, at any depth.
SAMPLE, FITTED = 20_000, 8
#: What a level leaves of a node's vectors, for choosing how deep a label's trees go, and directions of a level at most.
SHRINK, DIRECTIONS = 0.54, 256


class Forest:
    """Trees of any depth. The splits of the first levels are the sample's medians. Deeper, a node splits where the
    centre of its ancestor on the last fitted level lies: later directions are all but orthogonal to those before."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, fitted: int = FITTED, seed: int = 7):
        self.dims, self.trees, self.fitted, self.seed = sample.shape[1], trees, fitted, seed
        self.margin = SPILL / math.sqrt(self.dims)
        self.medians = np.zeros((trees, (1 << fitted) - 1))
        self.centres = np.zeros((trees, 1 << fitted, self.dims))
        for t in range(trees):
            at = np.zeros(len(sample), "int64")
            for level in range(fitted):
                p = self.project(sample, t, level, at)
                for node in np.unique(at):
                    self.medians[t, (1 << level) - 1 + node] = np.median(p[at == node])
                at = 2 * at + (p > self.medians[t, (1 << level) - 1 + at])
            self.centres[t] = sample.mean(axis=0) if len(sample) else 0.0
            for node in np.unique(at):
                self.centres[t, node] = sample[at == node].mean(axis=0)

    def directions(self, tree: int, level: int) -> np.ndarray:
        """Of a level's nodes, in turn; drawn anew from the seed rather than sent."""
        d = np.random.default_rng((self.seed, tree, level)).standard_normal((min(1 << level, DIRECTIONS), self.dims))
        return d / np.linalg.norm(d, axis=1, keepdims=True)

    def project(self, x: np.ndarray, tree: int, level: int, node: np.ndarray) -> np.ndarray:
        d = self.directions(tree, level)
        return np.einsum("ij,ij->i", x, d[node % len(d)])

    def threshold(self, tree: int, level: int, node: np.ndarray) -> np.ndarray:
        if level < self.fitted:
            return self.medians[tree, (1 << level) - 1 + node]
        return self.project(self.centres[tree, node >> (level - self.fitted)], tree, level, node)

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf codes: for each row its leaves at its own depth, in all trees. At depth 0 there is one leaf."""
        rows, codes = [np.flatnonzero(depth == 0)], [np.zeros(int((depth == 0).sum()), "int64")]
        for t in range(self.trees):
            row, node = np.flatnonzero(depth > 0), np.zeros(int((depth > 0).sum()), "int64")
            for level in range(int(depth.max(initial=0))):
                p = self.project(x[row], t, level, node) - self.threshold(t, level, node)
                left, right = p <= self.margin, p > -self.margin
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
                done = depth[row] == level + 1
                rows.append(row[done])
                codes.append((node[done] + 1) * self.trees + t)
                row, node = row[~done], node[~done]
        return np.concatenate(rows), np.concatenate(codes)


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.reshape(-1, dims).astype("float64")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rep, weight, block = (table.column(c).to_numpy() for c in ("cls", "m", "block"))
        dims, code, i, j = (table.column(c)[0].as_py() for c in ("dims", "code", "i", "j"))
        x = _unit(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), dims)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= (block[:, None] == i) & (block[None, :] == j) | (block[:, None] == j) & (block[None, :] == i)
        # pairs that meet in an earlier leaf are counted there
        lists = table.column("codes").combine_chunks()
        owner = np.repeat(np.arange(len(rep)), np.diff(lists.offsets.to_numpy()))
        codes = lists.flatten().to_numpy()
        earlier = codes < code
        links = near
        if earlier.any() and near.any():
            names, at = np.unique(codes[earlier], return_inverse=True)
            member = np.zeros((len(rep), len(names)), "float32")
            member[owner[earlier], at] = 1
            links = near & (member @ member.T == 0)
        n = links @ weight
        # each vector's least linked one, until nothing changes: the root of its part of this group
        order = np.argsort(rep)
        place = np.empty(len(rep), "int64")
        place[order] = np.arange(len(rep))
        root = place.copy()
        touched = np.flatnonzero(near.any(axis=1))
        inner = near[np.ix_(touched, touched)] | np.eye(len(touched), dtype=bool)
        while len(touched):
            new = np.where(inner, root[touched][None, :], len(rep)).min(axis=1)
            new = np.minimum(new, root[order[new]])
            if (new == root[touched]).all():
                break
            root[touched] = new
        some = (n > 0) | (root != place)
        return pa.table({"cls": rep[some], "n": n[some].astype("int64"), "root": rep[order[root[some]]]})

    return run


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    leaf_size: int = LEAF, fitted: int = FITTED, block_size: int = BLOCK,
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, a row for each vector.

    Vectors link when their labels are equal and not null and their cosine reaches ``threshold``; of different lengths
    never. A vector that is null, empty, zero, holds a null or non-finite component, has no label or a null id links
    with nothing and is its own component. Repeated rows link with each other; so do rows of one id with different
    vectors, if these are near. Equal vectors are told by 128 bits of hash. The forest may miss a link (recall is
    measured in the tests); it never makes a false one."""
    spark = embeddings.sparkSession
    small_batches(spark)
    vec = F.col(f"`{vec_col}`")
    sound = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    able = F.coalesce(sound, F.lit(False)) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()
    # vectors travel once to their class, and then to their leaves; all other steps go by the class' number
    all_rows = embeddings.select(
        F.col(f"`{id_col}`").alias("id"), F.when(able, F.col(f"`{label_col}`")).alias("label"), F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(17), vec).alias("h2"), vec.alias("vec")
    )
    grouped = all_rows.where(F.col("label").isNotNull()).groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    classes = cut(grouped.withColumn("dims", F.size("vec")).withColumn("cls", F.monotonically_increasing_id()))
    groups = classes.groupBy("label", "dims").agg(F.count("*").alias("size"))
    sample = classes.orderBy(F.xxhash64("rep", "cls")).limit(SAMPLE).select("dims", F.col("vec").cast("array<double>").alias("vec")).toArrow()
    by_dims: dict[int, Forest] = {}
    dims_of = sample.column("dims").to_numpy()
    for d in np.unique(dims_of):
        part = sample.filter(pa.array(dims_of == d)).column("vec").combine_chunks()
        by_dims[int(d)] = Forest(_unit(part.flatten().to_numpy(), int(d)), fitted=fitted)
    shared = spark.sparkContext.broadcast(by_dims)

    def place(batches):
        forests = shared.value
        for batch in batches:
            dims, size = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            depth = np.ceil(np.log(np.maximum(size, leaf_size) / leaf_size) / -math.log(SHRINK)).astype("int64")
            codes: list = [[] for _ in range(batch.num_rows)]
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                if d not in forests:  # a length that the sample lacks: one leaf, in blocks
                    for r in own:
                        codes[r] = [0]
                    continue
                x = _unit(batch.column(1).take(pa.array(own)).flatten().to_numpy(), int(d))
                found, code = forests[d].leaves(x, depth[own])
                order = np.lexsort((code, found))
                ends = np.cumsum(np.bincount(found, minlength=len(own)))
                for r, c in zip(own.tolist(), np.split(code[order], ends[:-1])):
                    codes[r] = c
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(codes, pa.list_(pa.int64()))], names=["label", "vec", "cls", "dims", "m", "codes"])

    label_type, vec_type = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    sized = classes.join(groups, ["label", "dims"]).where("size > 1").select("label", "vec", "cls", "dims", "size", "m")
    placed = cut(sized.mapInArrow(place, f"label {label_type}, vec {vec_type}, cls bigint, dims int, m bigint, codes array<bigint>"))
    leaf = ["label", "dims", "code"]
    sizes = placed.select("label", "dims", F.explode("codes").alias("code")).groupBy(*leaf).agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select(*leaf, F.ceil(F.col("n") / block_size).cast("int").alias("blocks"))
    entries = placed.withColumn("code", F.explode("codes"))
    blocked = entries.join(blocks, leaf).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = cut(
        paired.select(*leaf, "i", "j", "block", "vec", "cls", "m", "codes")
        .groupBy(*leaf, "i", "j")
        .applyInArrow(_compare(threshold), "cls bigint, n bigint, root bigint")
    )
    roots = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    small = classes.select("label", "h1", "h2", "cls", "rep", "m")
    done = small.join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    names = done.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = done.join(names, "root").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    return (
        all_rows.drop("vec").join(named, ["label", "h1", "h2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(False)))
    )
