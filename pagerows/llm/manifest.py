"""A Merkle manifest of a dataset: digests of all rows, one tree for each source, one tree over the sources' roots.

Nested-interval labels: a node covers the ranks [lo, hi) of the leaves below it. Trees grow in bands of four levels: the
nodes at a band's foot are dealt by (tree, block of 81), and each block's nodes of the band are made at once. Proofs come
down again: within a band every foot node meets the nodes of its block whose intervals contain its own (an equality
join on tree and block, and containment), each of which carries its siblings, the rest of its parent's interval. A
block then takes the steps that its top node has above. No tree, however large, is ever one task's or one group's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, ranked

FAN, LEVELS = 3, 4
BLOCK = FAN**LEVELS

_NODES = "array<struct<lo:bigint,hi:bigint,level:int,left:string,right:string>>"
_STEPS = "array<struct<level:int,left:string,right:string>>"


def digest(parts: list[Column]) -> Column:
    """Of the parts laid end to end, in lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """A row's digest: each value as its length in UTF-8 bytes, a colon and itself; null as a hyphen."""
    return digest([F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns])


def _parents(name: str) -> Column:
    """Each three nodes in a row, the last ones maybe fewer, become one."""
    three = f"slice({name}, 3 * i + 1, 3)"
    joined = f"array_join(transform({three}, x -> x.digest), '')"
    return F.expr(
        f"transform(sequence(0, int((size({name}) - 1) div 3)), i -> named_struct('lo', {name}[3 * i].lo, "
        f"'hi', element_at({three}, -1).hi, 'digest', sha2({joined}, 256)))"
    )


def _steps_of(k: int, level: int) -> str:
    """For each node of a block's level k its interval and what its parent covers besides, left and right of it."""
    rest = "array_join(transform(filter(slice(l{0}, 3 * (i div 3) + 1, 3), y -> {1}), y -> y.digest), '')"
    left, right = rest.format(k, "y.hi <= x.lo"), rest.format(k, "y.lo >= x.hi")
    nodes = f"transform(l{k}, (x, i) -> named_struct('lo', x.lo, 'hi', x.hi, 'level', {level}, 'left', {left}, 'right', {right}))"
    return f"case when l{k + 1} is null then cast(array() as {_NODES}) else {nodes} end"


def grow(leaves: DataFrame) -> list[DataFrame]:
    """``leaves(tree, n, lo, hi, digest)``, n leaves in a tree of ranks 0 to n - 1 -> for each band ``(tree, n, block,
    l0 .. l4)``: a block's nodes of each of its levels, null where the tree has ended."""
    bands, width, foot = [], 1, leaves
    while True:
        block = foot.groupBy("tree", "n", F.expr(f"lo div {width * BLOCK}").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("l0")  # 81 at most
        )
        for k in range(1, LEVELS + 1):
            block = block.withColumn(f"l{k}", F.when(F.col("n") > width * FAN ** (k - 1), _parents(f"l{k - 1}")))
        block = cut(block)
        bands.append(block)
        width *= BLOCK
        foot = block.where(F.col("n") > width).select("tree", "n", F.inline("l4"))
        if foot.isEmpty():
            return bands


def roots(bands: list[DataFrame]) -> DataFrame:
    """``(tree, digest)`` of each tree."""
    top = F.coalesce(*(F.col(f"l{k}") for k in range(LEVELS, -1, -1)))
    out, width = None, 1
    for block in bands:
        width *= BLOCK
        ended = block.where(F.col("n") <= width).select("tree", top[0]["digest"].alias("digest"))
        out = ended if out is None else out.unionByName(ended)
    return out


def descend(bands: list[DataFrame], tops: DataFrame, leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, n, lo, hi and any more columns) with ``steps``, the siblings from the leaf up to its tree's root and
    on through the steps that ``tops(tree, steps, above)`` gives for that root, and with what ``above`` holds."""
    paths = None
    for b in range(len(bands) - 1, -1, -1):
        width = BLOCK**b
        blocks = bands[b]
        ends = blocks.where(F.col("n") <= width * BLOCK).select("tree", "block")
        upper = ends.join(tops, ends["tree"].eqNullSafe(tops["tree"])).select(ends["tree"], "block", F.col("steps").alias("higher"), "above")
        if paths is not None:  # the foot nodes of the band above are the tops of this band's blocks
            upper = upper.unionByName(paths.select("tree", F.expr(f"lo div {width * BLOCK}").alias("block"), F.col("steps").alias("higher"), "above"))
        carried = ", ".join(_steps_of(k, b * LEVELS + k) for k in range(LEVELS))
        nodes = blocks.select("tree", "block", F.expr(f"inline(concat({carried}))"))
        foot = (leaves if b == 0 else blocks.select("tree", "n", F.inline("l0"))).withColumn("block", F.expr(f"lo div {width * BLOCK}"))
        keep = [c for c in foot.columns if c not in ("tree", "block", "lo")]
        x, y = foot.alias("x"), nodes.alias("y")
        inside = F.expr("x.tree <=> y.tree and x.block = y.block and y.lo <= x.lo and x.hi <= y.hi")
        met = x.join(y, inside, "left").select("x.*", F.when(F.col("y.level").isNotNull(), F.struct("y.level", "y.left", "y.right")).alias("step"))
        own = met.groupBy("tree", "block", "lo").agg(F.sort_array(F.collect_list("step")).alias("lower"), *(F.first(c).alias(c) for c in keep))
        u = upper.alias("u")
        paths = own.alias("o").join(u, F.expr("o.tree <=> u.tree and o.block = u.block")).select(
            "o.tree", "o.lo", *(f"o.{c}" for c in keep), F.concat("o.lower", "u.higher").alias("steps"), "u.above"
        )
    return paths


def manifest(rows: DataFrame, columns: list[str], id_col: str = "doc_id", tree_col: str = "source", altered: dict[str, Column] | None = None) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row for each row.

    A leaf is the digest of ``columns``; leaves of a tree ascend by id (nulls first), rows with one id by digest, and
    equal rows are leaves of their own with whatever place among each other. Trees ascend by name, null first. ``proof_sha256``
    digests the siblings on the way to the root; ``folded_root`` is what they give with the leaf of the row in which
    the columns of ``altered`` have these values instead, and ``verified`` says that it is the root. No rows give no rows;
    other columns are ignored. Texts are read once; then digests travel, not texts."""
    row, changed = [F.col(f"`{c}`") for c in columns], altered or {}
    leaf, other = leaf_digest(row), leaf_digest([changed.get(c, F.col(f"`{c}`")) for c in columns])
    leaves = cut(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{tree_col}`").alias("tree"), leaf.alias("digest"), other.alias("other")))
    spots = ranked(leaves, "tree", ["id", "digest"]).withColumnRenamed("rank", "lo").withColumn("hi", F.col("lo") + 1)
    bands = grow(spots.select("tree", "n", "lo", "hi", "digest"))
    named = roots(bands).select(F.lit(0).alias("all"), F.col("tree").alias("name"), "digest")
    forest = cut(ranked(named, "all", ["name"]).select(F.col("all").alias("tree"), "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "name"))
    upper = grow(forest.select("tree", "n", "lo", "hi", "digest"))
    none = F.expr(f"cast(array() as {_STEPS})")
    crown = roots(upper).select("tree", none.alias("steps"), F.col("digest").alias("above"))
    over = descend(upper, crown, forest)
    tops = cut(over.select(F.col("name").alias("tree"), "steps", F.struct(F.col("digest").alias("subroot"), F.col("above").alias("root")).alias("above")))
    proof = F.expr("sha2(array_join(transform(steps, s -> concat(s.left, s.right)), ''), 256)")
    folded = F.expr("aggregate(steps, other, (a, s) -> sha2(concat(s.left, a, s.right), 256))")
    out = descend(bands, tops, spots).select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "above.subroot", "above.root", proof.alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
