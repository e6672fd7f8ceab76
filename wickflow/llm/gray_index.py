"""A hierarchical index of 64-bit fingerprints in Gray-code order.

Fingerprints are sorted by Gray rank, so that neighbours share most of their bits, and cut into blocks of
bounded size. The bits that all of a block share are factored out as its (mask, bits) node; runs of nodes
share a parent that holds what they have in common, and so on, while a child keeps only the bits that its
parent lacks. A search adds up the differences met on the way down; once there are more than the bits seen so
far allow, the whole group below is dropped.

Only a bounded number of upper nodes is sent to tasks. Where there are more blocks than that, the levels between are
tables, and pairs of parents are joined with their children level by level. Blocks that survive against
each other meet in a task, which prunes by groups of both before it compares single fingerprints. No
task holds more than two blocks or the children of two nodes, however many fingerprints there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import checkpoint

#: Fingerprints in a block: enough for about this many blocks, within these bounds.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 512, 256, 65_536
#: Fingerprints in a group inside a block, and groups of the other block that are compared at once.
GROUP, WIDE = 64, 64
#: Nodes that tasks receive, at most and one for each partition, and children of a node in the tables below.
MAX_NODES, FAN_IN = 32_768, 128
FAN_OUT = 8
SIGN = -(1 << 63)
ALL = ~np.uint64(0)


def rotated(fp: Column, turn: int) -> Column:
    return fp if turn == 0 else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))


def gray_rank(fp: Column) -> Column:
    """Position of a fingerprint in Gray-code order, as a signed long that sorts like the unsigned rank."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(SIGN))


def exactly(bound: int) -> np.ndarray:
    """Differences that any number of shared bits allows: a group is dropped only if none of it is within the bound."""
    return np.full(65, bound)


def likely(rate: float, coverage: float) -> np.ndarray:
    """Differences that p shared bits allow, if each differs with this chance: a near one passes with the coverage at least."""
    allowed = []
    for p in range(65):
        total, a = (1 - rate) ** p, 0
        while total < coverage and a < p:
            a += 1
            total += math.comb(p, a) * rate**a * (1 - rate) ** (p - a)
        allowed.append(a)
    return np.array(allowed)


def shared(masks: np.ndarray, bits: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """The bit positions on which all members agree, and their values."""
    mask = np.bitwise_and.reduce(masks) & ~np.bitwise_or.reduce(bits ^ bits[0])
    return mask, bits[0] & mask


def group_nodes(masks: np.ndarray, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes over runs of so many members."""
    at = np.arange(0, len(bits), size)
    first = np.repeat(bits[at], np.diff(np.append(at, len(bits))))
    mask = np.bitwise_and.reduceat(masks, at) & ~np.bitwise_or.reduceat(bits ^ first, at)
    return mask, bits[at] & mask


def reachable(mask, bits, masks: np.ndarray, patterns: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which of some nodes this one can have a near fingerprint in."""
    both = masks & mask
    return np.flatnonzero(np.bitwise_count((patterns ^ bits) & both) <= allowed[np.bitwise_count(both)])


class GrayIndex:
    """Nodes below a few levels of shared patterns; each level keeps only its residual mask."""

    def __init__(self, ids: np.ndarray, masks: np.ndarray, bits: np.ndarray):
        self.ids = ids
        levels = [(masks, bits)]
        while len(levels[-1][0]) > FAN_OUT:
            levels.append(group_nodes(*levels[-1], FAN_OUT))
        levels.reverse()
        own = [levels[0][0]]
        for (upper, _), (mask, _) in zip(levels, levels[1:]):
            own.append(mask & ~np.repeat(upper, FAN_OUT)[: len(mask)])
        self.levels = [(o, b) for o, (_, b) in zip(own, levels)]

    def partners(self, mask: np.uint64, bits: np.uint64, allowed: np.ndarray) -> np.ndarray:
        """Nodes that may hold a fingerprint near one that has these bits under this mask."""
        at = np.arange(len(self.levels[0][0]))
        far = np.zeros(len(at), dtype=np.int64)
        seen = np.zeros(len(at), dtype=np.int64)
        for depth, (own, pattern) in enumerate(self.levels):
            if depth:
                at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                far, seen = np.repeat(far, FAN_OUT), np.repeat(seen, FAN_OUT)
                inside = at < len(own)
                at, far, seen = at[inside], far[inside], seen[inside]
            both = own[at] & mask
            far, seen = far + np.bitwise_count((pattern[at] ^ bits) & both), seen + np.bitwise_count(both)
            near = far <= allowed[seen]
            at, far, seen = at[near], far[near], seen[near]
        return self.ids[at]


def near_indices(a: np.ndarray, b: np.ndarray, bound: int, allowed: np.ndarray, same: bool = False):
    """Pairs (indices into a, indices into b) within the bound, in pieces of bounded size; of one block, each pair once."""
    ma, ba = group_nodes(np.broadcast_to(ALL, len(a)), a, GROUP)
    mb, bb = (ma, ba) if same else group_nodes(np.broadcast_to(ALL, len(b)), b, GROUP)
    for i in range(len(ma)):
        groups = reachable(ma[i], ba[i], mb, bb, allowed)
        if same:
            groups = groups[groups >= i]
        mine = a[i * GROUP : (i + 1) * GROUP, None]
        for at in range(0, len(groups), WIDE):
            cols = (groups[at : at + WIDE, None] * GROUP + np.arange(GROUP)).ravel()
            cols = cols[cols < len(b)]
            x, y = np.nonzero(np.bitwise_count(mine ^ b[cols]) <= bound)
            x, y = x + i * GROUP, cols[y]
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def hang(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each component so far) after these links."""
    while True:
        a, b = labels[x], labels[y]
        if (a == b).all():
            return labels
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def star_links(a: np.ndarray, b: np.ndarray, bound: int, allowed: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links between two blocks as (member, root) pairs: no more pairs than members."""
    both = a if same else np.concatenate([a, b])
    labels, shift = np.arange(len(both)), 0 if same else len(a)
    for x, y in near_indices(a, b, bound, allowed, same):
        labels = hang(labels, x, y + shift)
    moved = np.flatnonzero(labels != np.arange(len(both)))
    return both[moved].view(np.int64), both[labels[moved]].view(np.int64)


def _runs(columns: list[np.ndarray], size: int, held: list[np.ndarray], last: bool):
    """Runs of at most `size` rows of one order (the first column) out of what was held and what came, and what is left."""
    held = [np.concatenate([h, c]) for h, c in zip(held, columns)] if held else columns
    runs, starts = [], np.flatnonzero(np.diff(held[0])) + 1
    for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(held[0])]):
        end = b if last or b < len(held[0]) else a + (b - a) // size * size
        runs += [[h[i : min(i + size, end)] for h in held] for i in range(a, end, size)]
    return runs, [h[end:] for h in held]


def _node_rows(size: int, makes_node: Callable, names: list[str], kinds: list[pa.DataType]):
    """A mapInArrow function: rows of long columns into runs of `size`, each with its id, order, mask and bits."""
    schema = pa.schema([("block", pa.int64()), ("turn", pa.int64()), ("mask", pa.int64()), ("bits", pa.int64()), *zip(names, kinds)])

    def cut(batches):
        part, serial, held = TaskContext.get().partitionId(), 0, []

        def emit(runs):
            nonlocal serial
            rows = []
            for turn, *run in runs:
                mask, bits = makes_node(run)
                serial += 1
                rows.append(((part << 32) + serial, int(turn[0]), int(mask.view(np.int64)), int(bits.view(np.int64)), *run))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                runs, held = _runs([c.to_numpy(zero_copy_only=False) for c in batch.columns], size, held, False)
                if runs:
                    yield emit(runs)
        if held and len(held[0]):
            yield emit(_runs([h[:0] for h in held], size, held, True)[0])

    return cut


def block_pairs(blocks: DataFrame, allowed: np.ndarray, max_nodes: int, fan_in: int) -> DataFrame:
    """(a, b): pairs of blocks of one order, a <= b, that may hold near fingerprints; blocks have block, turn, mask and bits."""
    longs = pa.list_(pa.int64())
    kids = ["kids", "kid_masks", "kid_bits"]

    def above(run):
        return shared(run[1].view(np.uint64), run[2].view(np.uint64))

    columns = ["turn", "block", "mask", "bits"]
    nodes, levels = blocks.select(*columns), []
    count = nodes.count()
    while count > max_nodes:
        schema = "block long, turn long, mask long, bits long, kids array<long>, kid_masks array<long>, kid_bits array<long>"
        upper = checkpoint(nodes.mapInArrow(_node_rows(fan_in, above, kids, [longs] * 3), schema))
        fewer = upper.count()
        if fewer > count // 2:  # a few nodes in each of many partitions
            break
        levels.append(upper.select("block", *kids))
        nodes, count = upper.select(*columns), fewer
    top = nodes.orderBy("block").toPandas()  # at most max_nodes and one for each partition, level and order
    index = {
        turn: GrayIndex(*(part[c].to_numpy().view(t) for c, t in (("block", np.int64), ("mask", np.uint64), ("bits", np.uint64))))
        for turn, part in top.groupby("turn")
    }
    index = blocks.sparkSession.sparkContext.broadcast(index)

    def route(batches):
        for batch in batches:
            left, right = [], []
            for turn, node, mask, bits in zip(*(c.to_pylist() for c in batch.columns)):
                found = index.value[turn].partners(np.int64(mask).view(np.uint64), np.int64(bits).view(np.uint64), allowed)
                found = found[found >= node]
                left.append(np.full(len(found), node))
                right.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.empty(0, np.int64)])) for x in (left, right)], ["a", "b"])

    def descend(batches):
        for batch in batches:
            for a, b, *below in zip(*batch.columns):
                ids, masks, bits, other, others, patterns = (x.values.to_numpy() for x in below)
                u64 = np.uint64
                found = [reachable(m, p, others.view(u64), patterns.view(u64), allowed) for m, p in zip(masks.view(u64), bits.view(u64))]
                left, right = np.repeat(ids, [len(f) for f in found]), other[np.concatenate(found)]
                if a.as_py() == b.as_py():
                    left, right = left[left <= right], right[left <= right]
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    pairs = nodes.mapInArrow(route, "a long, b long")
    for level in reversed(levels):
        left, right = (level.select(F.col("block").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in kids)) for s in ("a", "b"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", *(f"{s}_{c}" for s in ("a", "b") for c in kids))
        pairs = joined.mapInArrow(descend, "a long, b long")
    return pairs


def links(
    prints: DataFrame,
    find: Callable,
    allowed: np.ndarray,
    turns: int = 1,
    carried: tuple[str, ...] = (),
    least: int = LEAST_BLOCK,
    most: int = MOST_BLOCK,
    max_nodes: int = MAX_NODES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(u, v) of what find(a, b, same) returns for all pairs of blocks that can be near, in one Gray order or in several.

    prints: distinct rows of longs, fp and the columns in `carried`; a and b are lists of arrays in that order. Each further
    order is that of the fingerprints rotated by so many bits, and so are they in its blocks, which changes no distance.
    With a wide bound most pairs of small blocks survive, and each is sent; fewer, larger blocks (`least`) move less.
    """
    columns, rows = ["fp", *carried], prints.count()
    size = min(most, max(least, -(-rows // BLOCKS)))
    longs = pa.list_(pa.int64())

    def own(run):
        return shared(np.full(1, ALL), run[0].view(np.uint64))

    orders = F.array(*(F.struct(F.lit(t).cast("long").alias("turn"), rotated(F.col("fp"), 64 * t // turns).alias("fp")) for t in range(turns)))
    schema = "block long, turn long, mask long, bits long, " + ", ".join(f"{c} array<long>" for c in columns)
    blocks = checkpoint(
        prints.select(F.explode(orders).alias("o"), *carried)
        .select("o.turn", "o.fp", *carried)
        .withColumn("rank", gray_rank(F.col("fp")))
        .repartitionByRange("turn", "rank")
        .coalesce(max(1, -(-rows * turns // size)))  # no more tasks than blocks, else each has a smaller one
        .sortWithinPartitions("turn", "rank")
        .select("turn", *columns)
        .mapInArrow(_node_rows(size, own, columns, [longs] * len(columns)), schema)
    )
    pairs = block_pairs(blocks, allowed, max_nodes, fan_in)
    left, right = (blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns)) for s in ("a", "b"))

    def compare(batches):
        for batch in batches:
            for a, b, *arrays in zip(*batch.columns):
                arrays = [x.values.to_numpy() for x in arrays]
                arrays[0], arrays[len(columns)] = arrays[0].view(np.uint64), arrays[len(columns)].view(np.uint64)
                u, v = find(arrays[: len(columns)], arrays[len(columns) :], a.as_py() == b.as_py())
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    tasks = 4 * prints.sparkSession.sparkContext.defaultParallelism  # small rows, much work: not to be put together
    return (
        pairs.join(left, "a")
        .repartition(tasks, "b")
        .join(right, "b")
        .select("a", "b", *(f"{s}_{c}" for s in ("a", "b") for c in columns))
        .mapInArrow(compare, "u long, v long")
    )
