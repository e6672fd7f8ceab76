"""SimHash near-duplicates, linked through a hierarchical index in Gray-code order (gray_index).

near_duplicates links fingerprints within a few bits, exactly. keep_one reaches texts of a given Jaccard similarity: at
0.8 two fingerprints differ by about ten bits of 64, so it searches the same index with a wide bound. A group
of prints is then dropped as soon as it differs on more of the bits seen so far than such texts
would, and the search is repeated in rotated orders, in which other bits come first. What it finds has to agree on 64
more bits, and each link is verified on the shingles of both texts, so no link is false; recall is measured.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wickflow.llm import gray_index
from wickflow.llm.common import checkpoint, drop_tables, join_counted, named, write_table
from wickflow.llm.components import connected_components
from wickflow.llm.gray_index import SIGN

SEED = 42
#: Near-duplicate texts: words in a shingle, and least Jaccard similarity of the sets of shingles.
WIDTH, SIMILARITY = 5, 0.8
#: Orders that are searched, and the least chance of a similar text to pass a node of one of them.
TURNS, COVERAGE = 3, 0.85
#: Fingerprints in a block of such a search at least.
WIDE_BLOCK = 8192
#: Standard deviations above the expected difference that still count as near.
SLACK = 2.8
#: Bits of the fingerprint by which near classes find their nearest.
LONG_BITS = 1024
#: Numbers by which texts to be fetched are looked for.
BUCKETS = 1 << 20
#: A key holds the differing bits above the number of a node.
NODE_BITS = 54
#: Partners that a class is held against in the first round; each round takes WIDER times as many, up to the second number.
AT_ONCE, MOST_AT_ONCE, WIDER = 4, 64, 4
#: Keys that a comparison holds before it drops all but a round's.
HELD_KEYS = 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words in lower case, repeats included; of all words where there are fewer."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    n = len(tokens) - width + 1
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(width)))) if n > 0 else [b" ".join(tokens)]
    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=max(n, 1))


def fingerprint_bytes(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; zero without words."""
    return majority(shingle_hashes(text, width))


def _row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.isNull(), text).alias("row_hash")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = named(docs, id_col, text_col)
    return docs.select(doc_id.cast("long").alias("doc_id"), _row_hash(doc_id, text), text.cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, row_hash, fp): every document's fingerprint as a signed long. A null text counts as empty.

    row_hash tells apart rows that repeat an id with another text.
    """

    def scan(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            prints = np.fromiter(
                (fingerprint_bytes(t.as_py() or b"", width) for t in texts), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "row_hash", "fp"]
            )

    return _texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, row_hash long, fp long")


def fingerprint_links(prints: DataFrame, bound: int = 2, **index) -> DataFrame:
    """prints: distinct fingerprints, column fp. Returns links u, v whose components are those of all pairs within the bound."""
    allowed = gray_index.exactly(bound)

    def find(a, b, same):
        return gray_index.star_links(a[0], b[0], bound, allowed, same)

    return gray_index.links(prints, find, allowed, **index)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bound: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id): fingerprint of each row, and the smallest id of all that reach it over links of at most `bound` bits.

    Null or blank texts have fingerprint 0 and link like any other. A null id never names a component
    unless all of it is null. Equal rows are returned as often as they come; an empty table gives none.
    Texts are hashed whole, however long. Other columns are ignored, whatever their names.
    """
    prints = checkpoint(signatures(docs, id_col, text_col, width))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    reached = connected_components(fingerprint_links(distinct, bound))
    linked = distinct.join(reached, distinct["fp"] == reached["node"], "left").select(
        "fp", "first_id", "n", F.coalesce("component", "fp").alias("root")
    )
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = checkpoint(linked.join(smallest, "root").select("fp", "component_id", "n"))
    return join_counted(prints.select("doc_id", "fp"), found, ["fp"], prints.count()).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, width))


def other_hashes(hashes: np.ndarray, serial: int = 1) -> np.ndarray:
    """Other 64 bits of each hash, for a further fingerprint."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(serial)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def bit_rate(similarity: float) -> float:
    """Chance of a bit to differ: the angle between two sets of this Jaccard similarity and equal size, as a share of pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near_bound(bits: int, similarity: float) -> int:
    rate = bit_rate(similarity)
    return round(bits * rate + SLACK * math.sqrt(bits * rate * (1 - rate)))


def _classes(texts: DataFrame, width: int) -> DataFrame:
    """One row for each distinct set of shingles: node, the smallest row that has it, and its two fingerprints."""

    def scan(batches):
        for batch in batches:
            columns = [[] for _ in range(4)]
            for text in batch.column(2).cast(pa.binary()):
                found = shingle_set(text.as_py() or b"", width)
                raw = found.tobytes()
                values = xxh64_intdigest(raw, 1), xxh64_intdigest(raw, 2), majority(found), majority(other_hashes(found))
                for column, value in zip(columns, values):
                    column.append(value)
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs], ["doc_id", "row_hash", "c1", "c2", "fp", "other"])

    sets = texts.mapInArrow(scan, "doc_id long, row_hash long, c1 long, c2 long, fp long, other long")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "fp", "other")).alias("low")
    return checkpoint(sets.groupBy("c1", "c2").agg(low).select("low.*").withColumn("node", F.monotonically_increasing_id()))


def least_of_each(at: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` smallest keys of each place, repeats once."""
    order = np.lexsort((key, at))
    at, key = at[order], key[order]
    fresh = np.append(True, (at[1:] != at[:-1]) | (key[1:] != key[:-1]))[: len(at)]
    at, key = at[fresh], key[fresh]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return at[rank < most], key[rank < most]


def _nearest(prints: DataFrame, similarity: float, turns: int, extra: tuple[str, ...] = (), most: int = 1) -> DataFrame:
    """(u, keys): for each of the prints (node, fp, other, root, tried) that has any, its nearest of other roots after `tried`.

    Near is what both fingerprints are together, and with the extra ones, in any of the orders. A key is the differing
    bits and then the node; there are at most so many for each.
    """
    one, two, every = (near_bound(bits, similarity) for bits in (64, 128, 128 + 64 * len(extra)))
    allowed = gray_index.likely(bit_rate(similarity), COVERAGE)

    def find(a, b, same):
        none = np.empty(0, np.int64)
        held = [(none, none), (none, none)]
        new: list[list] = [[], []]

        def fold():
            for side in (0, 1):
                ats, keys = zip(held[side], *new[side])
                held[side] = least_of_each(np.concatenate(ats), np.concatenate(keys), most)
                new[side].clear()

        for x, y in gray_index.near_indices(a[0], b[0], one, allowed, same):
            far = np.bitwise_count(a[0][x] ^ b[0][y]) + np.bitwise_count((a[2][x] ^ b[2][y]).view(np.uint64)).astype(np.int64)
            near = (far <= two) & (a[3][x] != b[3][y])
            x, y, far = x[near], y[near], far[near]
            for p, q in zip(a[5:], b[5:]):
                far += np.bitwise_count((p[x] ^ q[y]).view(np.uint64))
            if extra:
                near = far <= every
                x, y, far = x[near], y[near], far[near]
            far <<= NODE_BITS
            for side, at, mine, other in ((0, x, a, b[1][y]), (1, y, b, a[1][x])):
                key = far | other
                fresh = key > mine[4][at]
                if fresh.any():
                    new[side].append((at[fresh], key[fresh]))
            if sum(len(k) for _, k in new[0]) + sum(len(k) for _, k in new[1]) > HELD_KEYS:
                fold()
        fold()
        return [np.concatenate(c) for c in zip(*((n[at], key) for n, (at, key) in zip((a[1], b[1]), held)))]

    found = gray_index.links(prints, find, allowed, turns, ("node", "other", "root", "tried", *extra), least=WIDE_BLOCK)
    return found.groupBy("u").agg(F.slice(F.sort_array(F.collect_set("v")), 1, most).alias("keys"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    turns: int = TURNS,
) -> DataFrame:
    """One row of each component of similar texts, in the columns of docs: that with the smallest id (null last).

    Texts are linked if their fingerprints are near and the Jaccard similarity of their shingle sets is `similarity` or
    more. Equal sets are one class however often they come; texts without words are equal, null counting as empty. Of
    rows that repeat the kept id and text, one stays. An empty table stays empty; texts are read whole. A null id counts as
    -2**63 (SIGN), which no document may have as its id; other columns are kept untouched, whatever their names.

    Classes that have a near one get a longer fingerprint, of 1,024 bits. Each of them is then held against the nearest of other
    groups that it was not held against, in rounds: four, then 16, then 64 at a time. A class leaves the rounds once it was held
    against all that are near to it, and they end when all have left, so no near pair of different groups stays
    untried, however many texts there are that are near but not similar.
    """
    texts = _texts(docs, id_col, text_col)
    classes = _classes(texts, width)
    prints = classes.select("node", "fp", "other", F.col("node").alias("root"), F.lit(-1).cast("long").alias("tried"))
    first = checkpoint(_nearest(prints, similarity, turns).select("u"))

    def bucket(key):
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS))

    keyed = texts.select(F.coalesce("doc_id", F.lit(SIGN)).alias("key"), "row_hash", "text")
    spots = classes.select("node", F.coalesce("doc_id", F.lit(SIGN)).alias("key"), "row_hash")
    spots = checkpoint(spots.join(first.select(F.col("u").alias("node")), "node", "left_semi"))
    there = spots.select(bucket("key").alias("bucket")).distinct()  # at most BUCKETS rows
    suspects = keyed.join(F.broadcast(there), bucket(keyed["key"]) == there["bucket"], "left_semi").join(spots, ["key", "row_hash"])
    suspects = suspects.groupBy("node").agg(F.first("text").alias("text"))
    extra = tuple(f"s{k}" for k in range(2, LONG_BITS // 64))

    def lengthen(batches):
        for batch in batches:
            sets = [shingle_set(t or b"", width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            more = [pa.array(np.array([majority(other_hashes(s, k)) for s in sets], np.uint64).view(np.int64)) for k in range(2, LONG_BITS // 64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["node", "text", *extra])

    suspects = checkpoint(suspects.mapInArrow(lengthen, "node long, text string, " + ", ".join(f"{c} long" for c in extra)))

    def verify(batches):
        for batch in batches:
            good = [
                similar(shingle_set(a or b"", width), shingle_set(b or b"", width), similarity)
                for a, b in zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], ["u", "v"])

    def verified(pairs):
        left, right = (suspects.select(F.col("node").alias(s), F.col("text").alias(t)) for s, t in (("u", "a"), ("v", "b")))
        found = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
        return write_table(found.mapInArrow(verify, "u long, v long"))

    near = prints.join(suspects.drop("text"), "node")
    reached = suspects.where("false").select("node", F.col("node").alias("component"))
    most, old = AT_ONCE, []
    while True:
        found = write_table(_nearest(near, similarity, turns, extra, most))
        pairs = found.select("u", F.explode("keys").alias("key")).select("u", F.col("key").bitwiseAND(F.lit((1 << NODE_BITS) - 1)).alias("v"))
        more = verified(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        if not more.isEmpty():
            stars = reached.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
            reached = write_table(connected_components(stars.union(more)).select("node", "component"))
        # who found fewer than were asked for has no more of them
        left = found.where(F.size("keys") == most).select(F.col("u").alias("node"), F.array_max("keys").alias("key"))
        near = near.drop("root", "tried").join(left, "node").withColumnRenamed("key", "tried").join(reached, "node", "left")
        near = write_table(near.withColumn("root", F.coalesce("component", "node")).drop("component"))
        drop_tables(*old)  # those of the round before, which nothing reads any more
        old, most = [found, more, near], min(WIDER * most, MOST_AT_ONCE)
        if near.isEmpty():
            break

    survivors = (
        classes.join(reached, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("root"))
        .agg(F.min(F.struct("none", "doc_id", "row_hash")).alias("low"))
        .select(F.coalesce("low.doc_id", F.lit(SIGN)).alias("key"), F.col("low.row_hash").alias("row_hash"))
    )
    doc_id, text = named(docs, id_col, text_col)
    rows = docs.select(F.coalesce(doc_id.cast("long"), F.lit(SIGN)).alias("key"), _row_hash(doc_id, text), F.struct("*").alias("row"))
    kept = rows.join(survivors, ["key", "row_hash"], "left_semi")
    return kept.groupBy("key", "row_hash").agg(F.first("row").alias("row")).select("row.*")


def fingerprint_text(fp: Column) -> Column:
    """The fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
