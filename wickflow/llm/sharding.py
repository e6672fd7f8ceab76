"""Shards of near-equal bytes by Karmarkar-Karp differencing; equal texts stay together.

Differencing works on items. A group of equal texts that is large against a shard is an item of its own; the
others are bundled by hash, so that there are at most 2 * BUNDLES items however many documents there are.
All partial partitions start as one item in one shard; the two with the largest spread are combined
again and again, the fullest shards of one with the emptiest of the other, until one is left.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import checkpoint, named

#: Bundles of small groups, and as many large groups at most; this bounds what one task and a broadcast get.
BUNDLES = 32768
#: Rows that are numbered in one sort.
SLOT_ROWS = 50_000


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. Ties are settled by the items' order."""
    if not sizes:
        return []
    parts: list[tuple] = [()] * len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums = (size,) + (0,) * (shards - 1)
        heap.append((sums[-1] - size if shards > 1 else 0, i, sums))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heap[0]
        joined = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(shards), key=joined.__getitem__, reverse=True)
        parts.append((i, j, order))
        heapq.heapreplace(heap, (joined[order[-1]] - joined[order[0]], serial, tuple(joined[t] for t in order)))
        serial += 1
    found = [0] * len(sizes)
    stack = [(serial - 1, list(range(shards)))]
    while stack:
        k, at = stack.pop()
        if k < len(sizes):
            found[k] = at[0]
            continue
        i, j, order = parts[k]
        left, right = [0] * shards, [0] * shards
        for t, bin_ in enumerate(order):
            left[bin_] = right[shards - 1 - bin_] = at[t]
        stack += [(i, left), (j, right)]
    return found


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row: shards have near-equal bytes, rows of equal text one shard.

    A row's size is the UTF-8 bytes of its text and one more. A null text has no bytes, CRC 0 and a group
    of its own; a null id is kept. A group larger than a shard's share makes its shard the largest, and
    the others share the rest evenly. slot counts each shard's rows from 0 without gaps, by hash and id.
    Repeated rows get slots of their own; texts of any length are counted whole; an empty table gives none. Other columns are
    ignored, whatever their names.
    """
    doc_id, text = named(docs, id_col, text_col)
    text = text.cast("string")
    rows = checkpoint(
        docs.select(
            doc_id.cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("text_key"),
        )
    )
    bundle = F.pmod(F.xxhash64("text_key"), F.lit(BUNDLES))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    large = groups.where(F.col("bytes") > total / BUNDLES)  # fewer than BUNDLES groups are so large
    items = (
        rows.join(F.broadcast(large.select("text_key")), "text_key", "left_anti")
        .groupBy(bundle.alias("bundle"))
        .agg(F.sum("size").alias("bytes"))
        .select(F.col("bundle").cast("string").alias("item"), "bytes")
        .union(large.select(F.col("text_key").alias("item"), "bytes"))
    )

    def assign(batches):
        found = sorted(
            (-size, item) for b in batches for item, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        )
        put = differencing([-size for size, _ in found], shards)
        yield pa.RecordBatch.from_arrays([pa.array([x for _, x in found], pa.string()), pa.array(put, pa.int32())], ["item", "shard"])

    placed = items.repartition(1).mapInArrow(assign, "item string, shard int")  # at most 2 * BUNDLES rows
    in_large = large.select("text_key", F.col("text_key").alias("large"))
    rows = (
        rows.join(F.broadcast(in_large), "text_key", "left")
        .withColumn("item", F.coalesce("large", bundle.cast("string")))
        .join(F.broadcast(placed), "item")
        .withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, count // SLOT_ROWS))))
        .select("doc_id", "size", "text_crc32", "shard", "piece")
    )
    per_piece = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_piece.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
    )
