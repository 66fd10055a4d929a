"""Parent-child links to full hierarchies: sizes upward, preorder ranges downward, nested-set ranges, cycles.

Trees may be thousands of levels deep, so both passes double the pointer distance each round instead of walking level
by level: about log2(depth) rounds, each a pair of equi-joins over the nodes. A parent with a third of all nodes is
harmless: sums per ancestor combine before the shuffle, sibling prefix sums spread over range blocks, and pointer
lookups have a unique right side, which lets adaptive execution split a skewed left partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxa.operators.prefix import prefix_sum
from parallaxa.plans.lineage import Cut, cut

ROWS_PER_BLOCK = 200_000


def _look_above(state: DataFrame, above: DataFrame) -> DataFrame:
    """Left join on ptr. Rows whose ptr is null would all hash to one task, so they spread over a salt column."""
    salted = state.withColumn("salt", F.when(F.col("ptr").isNull(), F.pmod(F.col("id"), F.lit(4096))).otherwise(F.lit(0)))
    return salted.join(above.withColumn("salt", F.lit(0).cast("bigint")), ["ptr", "salt"], "left").drop("salt")


def link_table(df: DataFrame, node: str, parent: str) -> DataFrame:
    """One row (id, parent) for every id that occurs in either column.

    Repeated rows count once; of several different parents the smallest counts; ids without a row of their own and
    rows with a null parent are roots; a null id takes part only through its parent.
    """
    own = df.select(F.col(node).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("parent"))
    named = own.select(F.col("parent").alias("id"), F.lit(None).cast("bigint").alias("parent"))
    return own.unionByName(named).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))


def subtree_sizes(links: DataFrame) -> tuple[Cut, int]:
    """Upward pass: (id, parent, ptr, size), and the number of nodes that never reach a root.

    After round k, `size` counts the descendants less than 2^k steps below (the node included) and `ptr` is the
    ancestor 2^k steps above. Rounds stop when no pointer is left, or when a round ends none: tree depths have no
    gaps, so whatever is left then leads into a cycle and stays unprocessed.
    """
    state = cut(links.select("id", "parent", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("size")), "up")
    open_now = state.df.where("ptr is not null").count()
    while open_now:
        s = state.df
        added = (
            s.where("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"))
        )
        grown = s.join(added, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        above = s.where("ptr is not null").select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        nxt = cut(
            _look_above(grown, above).select("id", "parent", F.col("next").alias("ptr"), "size"), "up"
        )
        state.drop()
        state, before = nxt, open_now
        open_now = state.df.where("ptr is not null").count()
        if open_now == before:
            break
    return state, open_now


def cycle_members(unprocessed: DataFrame) -> Cut:
    """(id, cycle_id) of every node on a cycle, from rows (id, parent, ptr) that all lead into cycles.

    The image of the pointer map shrinks until only cycles are left; it has got there once a doubling no longer
    shrinks it. The smallest id then spreads along the cycle by doubling.
    """
    walk = cut(unprocessed.select("id", "ptr"), "walk")
    image = walk.df.select("ptr").distinct().count()
    while True:
        far = walk.df.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        nxt = cut(walk.df.join(far, "ptr").select("id", F.col("next").alias("ptr")), "walk")
        walk.drop()
        walk, before = nxt, image
        image = walk.df.select("ptr").distinct().count()
        if image == before:
            break
    on_cycle = walk.df.select(F.col("ptr").alias("id")).distinct()
    ring = cut(
        unprocessed.join(on_cycle, "id", "left_semi").select("id", F.col("parent").alias("ptr"), F.col("id").alias("low")),
        "ring",
    )
    walk.drop()
    while True:
        far = ring.df.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("other"))
        nxt = cut(
            ring.df.join(far, "ptr").select(
                "id", F.col("next").alias("ptr"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("moved")
            ),
            "ring",
        )
        ring.drop()
        ring = nxt
        if not ring.df.where("moved").head(1):
            break
    result = cut(ring.df.select("id", F.col("low").alias("cycle_id")), "cycles")
    ring.drop()
    return result


def preorder(forest: DataFrame) -> Cut:
    """Downward pass over (id, parent, size) of a forest: adds start, depth and top (the root of the tree).

    Every node first gets the offset of its range inside its parent's, by a prefix sum over the sizes of its earlier
    siblings (roots are siblings below one virtual node); offsets then add up along the path by pointer doubling.
    """
    siblings, blocks = prefix_sum(forest, ["parent"], ["id"], "size", "earlier")
    state = cut(
        siblings.select(
            "id",
            "parent",
            "size",
            F.col("parent").alias("ptr"),
            (F.col("earlier") + F.col("parent").isNotNull().cast("bigint")).alias("start"),
            F.col("parent").isNotNull().cast("bigint").alias("depth"),
            F.coalesce("parent", "id").alias("top"),
        ),
        "down",
    )
    blocks.drop()
    while state.df.where("ptr is not null").head(1):
        s = state.df
        above = s.select(
            F.col("id").alias("ptr"),
            F.col("ptr").alias("next"),
            F.col("start").alias("start_above"),
            F.col("depth").alias("depth_above"),
            F.col("top").alias("top_above"),
        )
        nxt = cut(
            _look_above(s, above).select(
                "id",
                "parent",
                "size",
                F.col("next").alias("ptr"),
                (F.col("start") + F.coalesce("start_above", F.lit(0))).alias("start"),
                (F.col("depth") + F.coalesce("depth_above", F.lit(0))).alias("depth"),
                F.coalesce("top_above", "top").alias("top"),
            ),
            "down",
        )
        state.drop()
        state = nxt
    return state


@dataclass
class Hierarchy:
    """`nodes`: id, parent, state (tree, cycle, below_cycle), root, depth, start, last, descendants, top.

    [start, last] is the node's nested-set range in one preorder numbering of the whole forest: b is a descendant of a
    exactly if a.start < b.start <= a.last. Nodes on a cycle count as roots of what hangs below them (`top`), while
    `root` names the cycle by its smallest id.
    """

    nodes: DataFrame
    held: list[Cut]


def build_hierarchy(df: DataFrame, node: str, parent: str) -> Hierarchy:
    """Hierarchy of parent-child rows; see `link_table` for repeated rows, conflicts, nulls and missing rows.

    tree: the parents lead to a root; depth is the number of steps to it. cycle: the node is reached from itself;
    depth 0, root the smallest id on the cycle. below_cycle: the parents lead into a cycle; depth is the number of
    steps to the first node on it. A node that names itself as parent is a cycle of one. Empty input, empty result.
    Further columns of `df` are not read.
    """
    links = cut(link_table(df, node, parent), "links")
    up, left = subtree_sizes(links.df)
    links.drop()
    held = []
    forest = up.df.select("id", "parent", "size")
    cycles = None
    if left:
        loose = up.df.where("ptr is not null")
        cycles = cycle_members(loose.select("id", "parent", "ptr"))
        opened = loose.join(cycles.df, "id", "left").select(
            "id", F.when(F.col("cycle_id").isNull(), F.col("parent")).alias("parent")
        )
        up_loose, _ = subtree_sizes(opened)
        held.append(up_loose)
        forest = up.df.where("ptr is null").select("id", "parent", "size").unionByName(
            up_loose.df.select("id", "parent", "size")
        )
        held.append(cycles)
    down = preorder(forest)
    up.drop()
    nodes = down.df
    if cycles is not None:
        rings = cycles.df.select(F.col("id").alias("top"), "cycle_id")
        nodes = nodes.join(rings, "top", "left")
        held[0].drop()
    else:
        nodes = nodes.withColumn("cycle_id", F.lit(None).cast("bigint"))
    state = (
        F.when(F.col("cycle_id").isNull(), "tree").when(F.col("id") == F.col("top"), "cycle").otherwise("below_cycle")
    )
    nodes = nodes.select(
        "id",
        "parent",
        state.alias("state"),
        F.coalesce("cycle_id", "top").alias("root"),
        "depth",
        "start",
        (F.col("start") + F.col("size") - 1).alias("last"),
        (F.col("size") - 1).alias("descendants"),
        "top",
    )
    return Hierarchy(nodes, [down, *held])


def _stack_paths(batches):
    """Streams rows sorted by (block, start): the ancestors of a node stand on a stack indexed by depth."""
    stack = np.empty(1024, dtype=np.int64)
    for batch in batches:
        ids = batch.column("id").to_numpy()
        depths = batch.column("depth").to_numpy()
        seed = batch.column("seed").to_numpy(zero_copy_only=False)
        keep, paths, held = [], [], 0
        for i in range(len(ids)):
            d = int(depths[i])
            if d >= len(stack):
                stack = np.concatenate([stack, np.empty(max(len(stack), d + 1), dtype=np.int64)])
            stack[d] = ids[i]
            if not seed[i]:
                keep.append(ids[i])
                paths.append(stack[: d + 1].copy())
                held += d + 1
            if held > 1_000_000 or (i == len(ids) - 1 and keep):
                ends = np.cumsum([0, *map(len, paths)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keep, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(paths)))],
                    names=["id", "path"],
                )
                keep, paths, held = [], [], 0


def hierarchy_paths(tree: Hierarchy, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(id, path): the ids from the top of each node's tree down to the node itself.

    Rows are range-partitioned by preorder start. Each block begins with the ancestors of its first node: the nodes
    whose range goes on beyond the end of their own block, sent to every block up to the one that holds their last
    descendant. From there a stack yields every path in one pass.
    """
    total = tree.nodes.count()
    parts = max(1, math.ceil(total / rows_per_block))
    laid = cut(
        tree.nodes.select("id", "depth", "start", "last")
        .repartitionByRange(parts, "start")
        .withColumn("block", F.spark_partition_id()),
        "laid",
    )
    tree.held.append(laid)
    ends = laid.df.groupBy("block").agg(F.max("start").alias("end"))
    crossing = laid.df.join(ends, "block").where("last > end")
    ends_in = laid.df.select(F.col("start").alias("last"), F.col("block").alias("to"))
    seeds = crossing.join(ends_in, "last").select(
        "id", "depth", "start", F.explode(F.sequence(F.col("block") + 1, F.col("to"))).alias("block"), F.lit(True).alias("seed")
    )
    rows = laid.df.select("id", "depth", "start", "block", F.lit(False).alias("seed")).unionByName(seeds)
    return (
        rows.repartition(parts, "block")
        .sortWithinPartitions("block", "start")
        .select("id", "depth", "seed")
        .mapInArrow(_stack_paths, "id bigint, path array<bigint>")
    )


def descendants_of(tree: Hierarchy, ids: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, descendant_id) for the ids in column `id` of `ids`, all nodes if None, by their nested-set ranges.

    A range is cut into aligned power-of-two pieces (at most two of each size), and a node's start meets the pieces by
    equality, so that the range join becomes an equi-join without scanning other nodes.
    """
    top = tree.nodes.agg(F.max("last")).head()[0] or 0
    levels = max(1, int(top).bit_length() + 1)
    # pieces of (low, high]: walk sizes upward while the ends are unaligned, as a segment tree query does
    asked = tree.nodes.where("descendants > 0")
    if ids is not None:
        asked = asked.join(ids.select("id").distinct(), "id", "left_semi")
    lo, hi = F.col("start") + 1, F.col("last") + 1
    piece = F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda k: F.array(
            F.when(
                (F.ceil(lo / F.pow(F.lit(2.0), k)).cast("bigint") < F.floor(hi / F.pow(F.lit(2.0), k)).cast("bigint"))
                & (F.ceil(lo / F.pow(F.lit(2.0), k)).cast("bigint") % 2 == 1),
                F.struct(k.alias("level"), F.ceil(lo / F.pow(F.lit(2.0), k)).cast("bigint").alias("cell")),
            ),
            F.when(
                (F.ceil(lo / F.pow(F.lit(2.0), k)).cast("bigint") < F.floor(hi / F.pow(F.lit(2.0), k)).cast("bigint"))
                & (F.floor(hi / F.pow(F.lit(2.0), k)).cast("bigint") % 2 == 1),
                F.struct(k.alias("level"), (F.floor(hi / F.pow(F.lit(2.0), k)).cast("bigint") - 1).alias("cell")),
            ),
        ),
    )
    pieces = asked.select(F.col("id").alias("ancestor_id"), F.explode(F.array_distinct(F.flatten(piece))).alias("p")).where(
        "p is not null"
    )
    points = tree.nodes.select(
        F.col("id").alias("descendant_id"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(levels - 1)),
                lambda k: F.struct(k.alias("level"), F.floor(F.col("start") / F.pow(F.lit(2.0), k)).cast("bigint").alias("cell")),
            )
        ).alias("p"),
    )
    return pieces.join(points, "p").select("ancestor_id", "descendant_id")
