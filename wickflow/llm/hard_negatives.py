"""Hard negatives of anchors by threshold joins over a pruned inverted index, after L2AP.

Vectors have whole-number components. A block of rows is indexed by dimension, those with most weight first. From the dimension on
where a row's suffix norm times any asking anchor's cannot reach the anchor's threshold, the row is left out of the lists: what it
shares there can't make it a result by itself. Partial scores accumulate over the lists; a pair goes once its partial score and the
product of the remaining norms stay below the threshold, and what is left is completed on the parts that were left out.

Thresholds start high and are lowered until an anchor's window is full: for positives, the nearest of its own label; for negatives,
a window below each positive's score. A window that never fills ends at its own lower edge, so results are exact.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import checkpoint, join_counted, named

#: Rows and anchors (about) that meet in one comparison; these bound a task's memory.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 512
#: Dimensions that are accumulated at a time.
STRIP = 8
#: Thresholds that are tried: shares of the product of norms for positives, of the least positive score for negatives.
POSITIVE_STEPS = (0.6, 0.45, 0.3, 0.2, 0.1)
NEGATIVE_STEPS = (1.0, 0.97, 0.92, 0.86)
#: Sums of doubles are exact below.
EXACT = 2.0**52
#: Pairs that are completed at a time.
PAIRS = 1 << 16


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists as rows of whole numbers; shorter lists end with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    flat = lists.values.to_numpy()[: ends[-1] if len(ends) else 0]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] :]
    return out


def suffix_norms(vectors: np.ndarray) -> np.ndarray:
    """Norm of each vector from each strip on, and a last column of zeros."""
    squares = vectors.astype(np.float64) ** 2
    strips = np.add.reduceat(squares, np.arange(0, squares.shape[1], STRIP), axis=1) if squares.shape[1] else squares
    tails = np.sqrt(np.cumsum(strips[:, ::-1], axis=1)[:, ::-1])
    return np.hstack([tails, np.zeros((len(vectors), 1))])


class PrunedIndex:
    """Rows of one block, by dimension."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.rows = rows[:, self.order]
        self.floats = self.rows.astype(np.float64)
        self.tails = suffix_norms(self.rows)

    def fit(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors with the dimensions of this index, in its order; more dimensions score nothing, missing ones are 0."""
        wide = np.zeros((len(anchors), len(self.order)), np.int64)
        width = min(anchors.shape[1], wide.shape[1])
        wide[:, :width] = anchors[:, :width]
        return wide[:, self.order]

    def depths(self, tails: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Strips of each row that are listed: from there on no anchor's tail can reach its threshold."""
        with np.errstate(divide="ignore", invalid="ignore"):
            limits = np.where(least[:, None] <= 0, 0.0, np.where(tails > 0, least[:, None] / tails, np.inf)).min(axis=0)
        out = self.tails < limits * (1 - 1e-9)
        return np.where(out.any(axis=1), out.argmax(axis=1), out.shape[1] - 1)

    def search(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that score at least the anchor's threshold. anchors: as fit() returns them."""
        tails = suffix_norms(anchors)
        if tails[:, 0].max(initial=0) * self.tails[:, 0].max(initial=0) >= EXACT:
            scores = anchors.astype(object) @ self.rows.T.astype(object)
            a, y = np.nonzero(scores >= least[:, None])
            return a, y, scores[a, y]
        depth, strips = self.depths(tails, least), self.tails.shape[1] - 1
        columns = np.argsort(-depth, kind="stable")
        columns = columns[depth[columns] > 0] if (least > 0).all() else columns
        asked, sums = anchors.astype(np.float64), np.zeros((len(anchors), len(columns)))

        def possible(done):
            """Pairs that can still reach the threshold when so many strips are summed."""
            at = np.minimum(depth[columns], done)
            return sums + tails[:, at] * self.tails[columns, at] * (1 + 1e-9) >= least[:, None]

        for k in range(strips):
            listed = int((depth[columns] > k).sum())
            if not listed:
                break
            part = slice(k * STRIP, (k + 1) * STRIP)
            sums[:, :listed] += asked[:, part] @ self.floats[columns[:listed], part].T
            if k % 2 and k + 1 < strips:
                useful = possible(k + 1).any(axis=0)
                if useful.mean() < 0.7:
                    columns, sums = columns[useful], sums[:, useful]
        a, c = np.nonzero(possible(strips))
        y, scores = columns[c], sums[a, c]
        short = np.flatnonzero(depth[y] < strips)
        inside = np.repeat(np.arange(strips), STRIP)[: self.floats.shape[1]]
        for at in range(0, len(short), PAIRS):
            s = short[at : at + PAIRS]
            left = inside >= depth[y[s]][:, None]
            scores[s] += (asked[a[s]] * self.floats[y[s]] * left).sum(axis=1)
        good = scores >= least[a]
        return a[good], y[good], scores[good].astype(np.int64)


def _groups(a: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of each of 0 .. n - 1 in a."""
    order = np.argsort(a, kind="stable")
    return np.split(order, np.searchsorted(a[order], np.arange(1, n)))


def _first(scores: np.ndarray, y: np.ndarray, ids: list[list[int]], most: int) -> list[tuple[int, int]]:
    """The first (score, id) by falling score and rising id; a row's ids are its smallest ones, in order."""
    best = sorted(zip((-scores).tolist(), (ids[k][0] for k in y.tolist()), y.tolist()))[:most]
    return [(-s, i) for s, i in sorted((s, i) for s, _, k in best for i in ids[k])[:most]]


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})


POSITIVE, NEGATIVE = ("query_id", "score", "id"), ("query_id", "positive_score", "score", "id")


def find_positives(most: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The first ids of each anchor in this block of rows of its label."""
    if not (anchors.num_rows and rows.num_rows):
        return _table([], POSITIVE)
    index, ids = PrunedIndex(matrix(rows.column("v"))), rows.column("ids").to_pylist()
    asked, query = index.fit(matrix(anchors.column("v"))), anchors.column("query_id").to_pylist()
    held = np.array([len(x) for x in ids])
    bound = suffix_norms(asked)[:, 0] * index.tails[:, 0].max()
    unfilled, out = np.arange(len(query)), []
    for step in (*POSITIVE_STEPS, None):
        least = np.full(len(unfilled), -np.inf) if step is None else step * bound[unfilled]
        a, y, scores = index.search(asked[unfilled], least)
        full = np.bincount(a, held[y], len(unfilled)) >= most
        for k, at in enumerate(_groups(a, len(unfilled))):
            if full[k] or step is None:
                out += [(query[unfilled[k]], s, i) for s, i in _first(scores[at], y[at], ids, most)]
        unfilled = unfilled[~full]
        if not len(unfilled):
            break
    return _table(out, POSITIVE)


def find_negatives(most: int, low: int, high: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """For each anchor and score of a positive, the first ids of other labels in the window below it, of this block."""
    if not (anchors.num_rows and rows.num_rows):
        return _table([], NEGATIVE)
    index, ids = PrunedIndex(matrix(rows.column("v"))), rows.column("ids").to_pylist()
    asked, query = index.fit(matrix(anchors.column("v"))), anchors.column("query_id").to_pylist()
    label, labels = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    # from high to low; the edges are whole: least * 100 >= low * score, most * 100 <= high * score
    windows = [[(p, -(-low * p // 100), high * p // 100) for p in sorted(set(x), reverse=True)] for x in anchors.column("scores").to_pylist()]
    windows = [[w for w in x if w[1] <= w[2]] for x in windows]
    unfilled, out = np.array([k for k, x in enumerate(windows) if x], np.int64), []
    for step in (*NEGATIVE_STEPS, None):
        if not len(unfilled):
            break
        edge = np.array([min(w[1] for w in windows[k]) for k in unfilled], np.float64)
        start = np.array([min(w[2] for w in windows[k]) for k in unfilled], np.float64)
        least = edge if step is None else np.maximum(step * start, edge)
        a, y, scores = index.search(asked[unfilled], least)
        other = labels[y] != label[unfilled[a]]
        a, y, scores = a[other], y[other], scores[other]
        left = []
        for k, at in enumerate(_groups(a, len(unfilled))):
            found, full = [], True
            for p, bottom, top in windows[unfilled[k]]:
                inside = at[(scores[at] >= bottom) & (scores[at] <= top)]
                best = _first(scores[inside], y[inside], ids, most)
                full &= len(best) == most or bottom >= least[k]
                found += [(query[unfilled[k]], p, s, i) for s, i in best]
            if full:
                out += found
            else:
                left.append(unfilled[k])
        unfilled = np.array(left, np.int64)
    return _table(out, NEGATIVE)


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], blocks: int, slabs: int, find, names) -> DataFrame:
    """Each slab of anchors beside each block of rows, with the same keys."""

    def everywhere(name, n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = anchors.select("*", F.pmod(F.xxhash64("query_id"), F.lit(slabs)).cast("int").alias("slab")).select("*", everywhere("block", blocks))
    right = rows.select("*", F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks)).cast("int").alias("block")).select("*", everywhere("slab", slabs))
    on = [*keys, "block", "slab"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(find, ", ".join(f"{n} long" for n in names))


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    anchors: str,
    positives: int = 5,
    negatives: int = 5,
    scale: int = 256,
    low: int = 80,
    high: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    anchors: SQL condition on vec_id that picks the anchor rows. Components become floor(scale * x); a score is the inner product
    of two rows, higher ones come first and ties go to the smaller id. An anchor's positives are its first `positives` rows of the
    same label and another id. For each of them, the first `negatives` rows of other labels are returned whose score is from low
    to high percent of the positive's. Positives below 0 have no such window and return nothing, nor do windows without rows.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. Rows that repeat id, label and
    vector count once; an id with several vectors or labels is several rows. A shorter vector ends with zeros, an empty one
    scores 0. Rows that share vector and label are compared once, with as many of their smallest ids as ranks can show.
    Scores have to fit a long. An empty table gives none; other columns are ignored, whatever their names.

    Blocks of rows by slabs of anchors are compared, in tasks of bounded memory; a row moves once for each slab, an anchor once for each block.
    """
    vec_id, vector, label = named(vectors, id_col, vector_col, label_col)
    usable = vectors.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    usable = usable.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    usable = usable.withColumn("h1", F.xxhash64("v", "label")).withColumn("h2", F.xxhash64(F.lit(13), "label", "v"))
    usable = usable.groupBy("h1", "h2", "vec_id").agg(F.first("label").alias("label"), F.first("v").alias("v"))

    asked = checkpoint(usable.where(anchors).withColumnRenamed("vec_id", "anchor_id"))
    distinct = asked.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # a number of their own, as several rows of one id may ask
    distinct = checkpoint(distinct.withColumn("query_id", F.monotonically_increasing_id()))
    smallest = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    most = max(positives + 1, negatives)
    classes = usable.withColumn("at", smallest).where(F.col("at") <= most).groupBy("h1", "h2")
    classes = checkpoint(classes.agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("label").alias("label"), F.first("v").alias("v")))
    blocks, slabs = max(1, -(-classes.count() // BLOCK_ROWS)), max(1, -(-distinct.count() // BLOCK_ANCHORS))

    near = _meet(distinct.select("query_id", "label", "v"), classes, ["label"], blocks, slabs, partial(find_positives, positives + 1), POSITIVE)
    near = checkpoint(_ranked(near, ["query_id"], positives + 1))
    scores = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("near"))
    wanted = distinct.select("query_id", "label", "v").join(scores, "query_id").select("query_id", "label", "v", F.col("near.score").alias("scores"))
    far = _meet(wanted, classes, [], blocks, slabs, partial(find_negatives, negatives, low, high), NEGATIVE)
    far = _ranked(far, ["query_id", "positive_score"], negatives).groupBy("query_id")
    far = far.agg(F.sort_array(F.collect_list(F.struct("positive_score", "rank", "score", "id"))).alias("far"))
    answers = checkpoint(distinct.select("h1", "h2", "n", "query_id").join(scores, "query_id").join(far, "query_id").drop("query_id"))

    own = join_counted(asked.select("h1", "h2", "anchor_id"), answers, ["h1", "h2"], asked.count())
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    rows = own.select("anchor_id", F.explode(others).alias("p"), "far")
    below = F.filter("far", lambda x: x["positive_score"] == F.col("p.score"))
    rows = rows.select("anchor_id", "p", F.explode(below).alias("x"))
    return rows.select(
        "anchor_id",
        F.col("p.id").alias("positive_id"),
        "x.rank",
        F.col("x.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("x.score").alias("negative_score"),
    )


#: The query's rows in SQL, labels moved as the query moves them.
ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
