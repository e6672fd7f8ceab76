"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector, scaled to length 1, is hashed by the cells of a few Gaussian projections. A query visits buckets from its own
outward, in the order of their estimated chance to hold a near neighbour, until the chances add up to the
wanted share. The chance that a neighbour lies in a cell follows from the normal spread of its projection, given a
distance that some sampled vectors have to their neighbours. The tables' candidates are merged and ranked by exact cosine.

How many tables and projections there are is chosen by the expected cost of a query, rows to score and buckets to visit,
which the sample shows too. Near neighbours make that few of the rows; where they are almost as far as any
row, as among random vectors of many dimensions, most rows have to be scored, and one coarse table is best.
"""

from __future__ import annotations

import heapq
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import checkpoint, join_counted, named

#: Share of near neighbours that all tables together are to find.
TARGET = 0.95
CELL = 1.0
#: Numbers of tables that are considered, and most projections of one.
TABLES, MOST_FUNCTIONS = (1, 2, 3), 24
#: Rows that can be scored for the price of visiting one bucket.
PROBE_COST = 30
#: Most entries and queries (about) that one comparison takes, and queries that share a task's entries.
CHUNK = 1024
QUERY_BLOCK = 64
QUERY_SLOT = 4096
#: Queries whose best entries a task holds before it hands them on.
HELD_QUERIES = 50_000
#: Rows of the sample that the cost is fitted on, those of them whose neighbours are looked for among all rows, and cost queries.
SAMPLE, SAMPLE_QUERIES, COST_QUERIES = 4096, 64, 24


def projections(seed: int, dims: int, tables: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables, functions, dims)), rng.random((tables, functions)) * CELL


def cell_chances(value: float, spread: float) -> list[tuple[float, int]]:
    """Cells of one projection with the chance that a neighbour of this value falls there, best first."""
    normal = NormalDist(value, spread)
    here = math.floor(value / CELL)
    reach = max(1, math.ceil(4 * spread / CELL))
    edges = [normal.cdf(c * CELL) for c in range(here - reach, here + reach + 2)]
    found = [(b - a, here - reach + k) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return sorted((f for f in found if f[0] > 1e-9), key=lambda f: (-f[0], f[1]))


def probes(values: np.ndarray, spread: float, coverage: float):
    """Buckets (tuples of cells) in descending order of chance, until the chances add up to the coverage.

    Perturbation sets come from a heap: from a set, either its last projection takes the next cell, or the next
    projection leaves its best one, so that each set appears once and after all that are likelier.
    """
    lists = [cell_chances(float(v), spread) for v in values]
    logs = [[math.log(p) for p, _ in cells] for cells in lists]
    n = len(lists)
    start = tuple([0] * n)
    heap = [(-sum(x[0] for x in logs), start, 0)]
    total = 0.0
    while heap and total < coverage:
        cost, at, last = heapq.heappop(heap)
        total += math.exp(-cost)
        yield tuple(lists[k][at[k]][1] for k in range(n))
        for k in range(last, n):
            if at[k] + 1 < len(lists[k]):
                step = logs[k][at[k]] - logs[k][at[k] + 1]
                heapq.heappush(heap, (cost + step, at[:k] + (at[k] + 1,) + at[k + 1 :], k))


def bucket_key(table: int, cells) -> int:
    out = 0x243F6A8885A308D3 + table
    for c in cells:
        out = ((out ^ (int(c) & 0xFFFF)) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return out - (1 << 64) if out >> 63 else out


def _matrix(column) -> np.ndarray:
    """List column as rows of doubles."""
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _usable(vector):
    """Neither null, empty nor zero, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)


def expected_distance(classes: DataFrame, sample: np.ndarray, k: int) -> float:
    """Distance on the unit sphere within which most vectors have their k-th neighbour: of some of the sample, among all rows."""
    asked = sample[:SAMPLE_QUERIES]
    if len(sample) < 2:
        return 1.0

    def scan(batches):
        best = np.full((len(asked), k + 1), -2.0)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                found = np.concatenate([best, _cosines(asked, _matrix(batch.column(0).slice(at, CHUNK)))], axis=1)
                best = -np.partition(-found, k, axis=1)[:, : k + 1]
        rows, near = np.repeat(np.arange(len(asked)), k + 1), best.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(near)], ["asked", "near"])

    near = classes.select("v").mapInArrow(scan, "asked long, near double").groupBy("asked")
    kth = near.agg(F.element_at(F.sort_array(F.collect_list("near"), False), k + 1).alias("kth")).toPandas()["kth"]
    return float(np.sqrt(np.maximum(2 - 2 * np.quantile(np.maximum(kth, -1.0), 0.3), 1e-6)))


def share_of_each(target: float, tables: int) -> float:
    """Coverage of one table if so many find the target together."""
    return 1 - (1 - target) ** (1 / tables)


def expected_cost(sample: np.ndarray, spread: float, a: np.ndarray, b: np.ndarray, coverage: float, rows: int, most: float) -> float:
    """Rows scored and buckets visited (at PROBE_COST) for a query in one table; infinite once it is above `most`."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    values = unit @ a.T + b
    cells, counts = np.unique(np.floor(values / CELL).astype(np.int64), axis=0, return_counts=True)
    held = dict(zip(map(tuple, cells.tolist()), counts.tolist()))
    cost, queries = 0.0, values[:COST_QUERIES]
    for v in queries:
        for bucket in probes(v, spread, coverage):
            cost += PROBE_COST + rows * held.get(bucket, 0) / len(sample)
            if cost > most * len(queries):
                return math.inf
    return cost / len(queries)


def layout(sample: np.ndarray, spread: float, rows: int, target: float, seed: int) -> tuple[int, int]:
    """(tables, projections) of least expected cost; more projections are tried as long as they come near to the best."""
    best, most = (math.inf, 1, 1), 4.0 * (rows + PROBE_COST)
    for tables in TABLES:
        worse = 0
        for functions in range(1, MOST_FUNCTIONS + 1):
            a, b = projections(seed, sample.shape[1], tables, functions)
            limit = min(most, 2 * best[0]) / tables
            cost = tables * expected_cost(sample, spread, a[0], b[0], share_of_each(target, tables), rows, limit)
            worse = 0 if cost < best[0] else worse + 1
            best = min(best, (cost, tables, functions))
            if worse > 2:
                break
    return best[1], best[2]


def nearest(
    vectors: DataFrame,
    queries,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    target: float = TARGET,
    seed: int = 8,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine, ties to the smaller id.

    queries: SQL condition on vec_id that picks the query rows; candidates are all rows of another id. Rows with
    a null id, and vectors that are null, empty, zero, of another than the commonest length, or hold null or
    non-finite components take no part. Equal vectors are indexed once, with their k + 1 smallest ids, which is all
    that ranks can show, and are asked once; equal rows count once. An id with several vectors counts by its nearest. A
    query for which the buckets gave fewer than k is held against all rows in blocks. An empty table gives none, and other
    columns are ignored, whatever their names.
    """
    vec_id, vector = named(vectors, id_col, vector_col)
    usable = vectors.select(vec_id.cast("long").alias("vec_id"), vector.cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & _usable(F.col("v"))
    )
    sizes = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = sizes["n"] if sizes else 1
    hashes = ["h1", "h2"]
    usable = (
        usable.where(F.size("v") == dims)
        .withColumn("h1", F.xxhash64("v"))
        .withColumn("h2", F.xxhash64(F.lit(7), "v"))
        .groupBy(*hashes, "vec_id")
        .agg(F.first("v").alias("v"))
    )
    asked = checkpoint(usable.where(queries).select("h1", "h2", F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    distinct = asked.groupBy("h1", "h2").agg(F.first("q").alias("q"), F.count("*").alias("n"), F.min("query_id").alias("query_id"))
    distinct = checkpoint(distinct)
    smallest = F.row_number().over(Window.partitionBy(*hashes).orderBy("vec_id"))
    classes = checkpoint(
        usable.withColumn("at", smallest)
        .where(F.col("at") <= k + 1)
        .groupBy(*hashes)
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    )
    count = classes.count()
    sample = classes.orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()
    sample = np.array(sample.column(0).to_pylist(), dtype=np.float64).reshape(-1, dims)
    spread = expected_distance(classes, sample, k)
    tables, functions = layout(sample, spread, count, target, seed) if count else (1, 1)
    coverage = share_of_each(target, tables)
    a, b = projections(seed, dims, tables, functions)

    def hashed(column):
        v = _matrix(column)
        return np.einsum("nd,tfd->ntf", v / np.linalg.norm(v, axis=1)[:, None], a) + b

    def index(batches):
        for batch in batches:
            cells = np.floor(hashed(batch.column(1)) / CELL).astype(np.int64)
            keys = [[bucket_key(t, row[t]) for t in range(tables)] for row in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["ids", "v", "buckets"])

    def probe(batches):
        for batch in batches:
            values = hashed(batch.column(1))
            for i in range(batch.num_rows):
                keys = [bucket_key(t, cells) for t in range(tables) for cells in probes(values[i, t], spread, coverage)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array([i] * len(keys))) for c in batch.columns), pa.array(keys, pa.int64())],
                    ["query_id", "q", "bucket"],
                )

    entries = classes.select("ids", "v").mapInArrow(index, "ids array<long>, v array<double>, buckets array<long>")
    found = _compare(
        entries.select(F.explode("buckets").alias("bucket"), "ids", "v"),
        distinct.select("query_id", "q").mapInArrow(probe, "query_id long, q array<double>, bucket long"),
        k + 1,
    )
    found = checkpoint(_best(found, k + 1))
    enough = found.groupBy("query_id").count().where(F.col("count") > k)
    short = checkpoint(distinct.join(enough, "query_id", "left_anti"))
    if not short.isEmpty():
        parts = max(1, -(-count // 8192))
        everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("bucket")
        every = classes.select(F.pmod("h1", F.lit(parts)).alias("bucket"), "ids", "v")
        full = _best(_compare(every, short.select("query_id", "q", everywhere), k + 1), k + 1)
        found = found.join(short, "query_id", "left_anti").unionByName(full)
    near = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    answers = distinct.select("h1", "h2", "query_id", "n").join(near, "query_id").drop("query_id")
    own = join_counted(asked.select("h1", "h2", "query_id"), checkpoint(answers), ["h1", "h2"], asked.count())
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = own.select("query_id", F.posexplode(others).alias("at", "x"))
    rows = rows.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
    return rows if sizes is None or not _repeated(asked) else _best(rows.drop("rank"), k)


def _repeated(asked: DataFrame) -> bool:
    """Whether a query id comes with several vectors."""
    return not asked.groupBy("query_id").count().where("count > 1").isEmpty()


def _blocks(rows: DataFrame, size: int, ids: str, vector: str, key: str) -> DataFrame:
    """Rows of a bucket in blocks of about so many, however many the bucket has."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64(key), F.ceil(F.col("n") / size).cast("long"))
    return (
        rows.join(counts, "bucket")
        .groupBy("bucket", block.alias("block"))
        .agg(F.collect_list(F.struct(F.col(ids).alias("id"), F.col(vector).alias("v"))).alias("members"))
        .select("bucket", "block", F.col("members.id").alias(f"{ids}s"), F.flatten("members.v").alias(f"{vector}s"))
    )


def _compare(entries: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): blocks of queries beside blocks of entries of a bucket; from each task, the k best of each query.

    A bucket's entry blocks are dealt over tasks one by one, each with the query blocks of a slot, so a large bucket is not
    one task's.
    """

    def rank(batches):
        held: dict[int, dict[int, float]] = {}

        def flush():
            rows = [(q, x, score) for q, best in held.items() for x, score in best.items()]
            held.clear()
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000])
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for asked, q, groups, v in zip(*(c for c in batch.columns)):
                asked, groups = asked.as_py(), groups.as_py()
                near = _cosines(q.values.to_numpy().reshape(len(asked), -1), v.values.to_numpy().reshape(len(groups), -1))
                kth = np.partition(near, -min(k, len(groups)), axis=1)[:, -min(k, len(groups))]
                for i, query in enumerate(asked):
                    best = held.setdefault(query, {})
                    for c in np.flatnonzero(near[i] >= kth[i]):
                        for x in groups[c]:
                            best[x] = max(best.get(x, -2.0), float(near[i, c]))
                    if len(best) > k:
                        held[query] = dict(sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k])
            if len(held) > HELD_QUERIES:
                yield from flush()
        yield from flush()

    left = _blocks(wanted, QUERY_BLOCK, "query_id", "q", "query_id").withColumn("slot", F.floor(F.col("block") / (QUERY_SLOT // QUERY_BLOCK)))
    right = _blocks(entries, CHUNK, "ids", "v", "ids").withColumnRenamed("idss", "groups")
    entry_blocks = right.groupBy("bucket").agg(F.max("block").alias("last"))
    slots = left.groupBy("bucket").agg(F.max("slot").alias("last"))
    start = F.lit(0).cast("long")
    left = left.drop("block").join(entry_blocks, "bucket").withColumn("block", F.explode(F.sequence(start, F.col("last")))).drop("last")
    right = right.join(slots, "bucket").withColumn("slot", F.explode(F.sequence(start, F.col("last")))).drop("last")
    return left.join(right, ["bucket", "block", "slot"]).select("query_ids", "qs", "groups", "vs").mapInArrow(
        rank, "query_id long, vec_id long, score double"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
