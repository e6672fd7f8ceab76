"""Mixing sources to target weights with built-in expressions only.

Every document gets a hash-random key. Within a source, documents are sorted by key in ranges of the key
space; sums before each range and within it give the words before each document, so that no source
is ever in one task. The source's budget cuts that order; above the source's size it is repeated in epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-17"
#: Hexadecimal digits of the key that name a range: 4,096 ranges for each source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes: one row for each source, columns source, source_size. Adds the target of each.

    Sources by code point, null last, weigh `weights` in turn and share `share` times all sizes. A target stops at
    `most` times its source's size, and what is above is shared again by weight. That comes to one level
    a weight: sources sorted by bound over weight are at their bounds until the level is reached.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    table = sizes.withColumn("weight", weight.cast("long")).withColumn("bound", F.col("source_size") * most)
    level = Window.orderBy(F.col("bound").cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    twice = F.sum("source_size").over(whole) * int(round(2 * share))
    before = F.coalesce(F.sum("bound").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = table.select(
        "source",
        "source_size",
        "weight",
        "bound",
        F.row_number().over(level).alias("at"),
        (twice - 2 * before).alias("left"),
        (2 * F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))).alias("heft"),
    )
    reached = F.col("weight").cast("double") * F.col("left") <= F.col("bound").cast("double") * F.col("heft")
    first = F.min(F.when(reached, F.struct("at", "left", "heft"))).over(whole)
    table = table.withColumn("first", first)
    target = F.when(
        F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("bound").cast("double")
    ).otherwise((F.col("weight") * F.col("first.left")).cast("double") / F.col("first.heft").cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), with `carry` also the struct `row` of all columns.

    taken counts the words that the mix takes of a row: whole epochs of its source and then, in key order, the rows
    up to the rest of the budget; the row at the cut gives its first words, so that a source's taken words are its
    rounded target. Null texts have no words. Null sources are one source; a row without id takes its key from its text. Repeated rows
    count as often as they come. An empty table, or one without words, takes nothing. Texts of any length are counted
    whole. Other columns are ignored or carried in `row`, whatever their names.
    """
    doc_id, text, source = docs[f"`{id_col}`"], docs[f"`{text_col}`"], docs[f"`{source_col}`"]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))))
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"),
        source.isNull().alias("no_source"),
        F.coalesce(source.cast("string"), F.lit("")).alias("src"),
        word_count(text.cast("string")).alias("size"),
        key.alias("key"),
        F.substring(key, 1, RANGE_DIGITS).alias("range"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    part = ["no_source", "src", "range"]
    sums = rows.groupBy(*part).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("no_source", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*part, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    per_source = sums.groupBy("no_source", "src").agg(F.sum("words").alias("source_size"))
    targets = source_targets(
        per_source.select(F.when(~F.col("no_source"), F.col("src")).alias("source"), "source_size"), weights, share, most
    ).select(
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), "source_size", "target"
    )
    starts = starts.join(targets, ["no_source", "src"])
    ordered = Window.partitionBy(*part).orderBy("key", "doc_id", "size")
    upto = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("upto", upto).join(starts, part)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    first = F.col("start") + F.col("upto") - F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - first))
    return found.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else [])
    )


def mixture(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", **options) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each epoch that takes it; at the cut, its text up to the last word taken."""
    found = mix(docs, text_col=text_col, carry=True, **options)
    whole = F.when(F.col("size") > 0, F.expr("int(taken div size)")).otherwise(F.lit(0))
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    takes = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    pieces = found.select("row", F.explode(takes).alias("words"))
    text = F.col(f"row.`{text_col}`")
    spaced = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.when(F.col("words") == 0, text).otherwise(F.array_join(F.slice(spaced, 1, F.col("words").cast("int")), ""))
    changed = {text_col: cut} | ({count_col: F.length(cut).cast("long")} if count_col in docs.columns else {})
    return pieces.select(
        *(
            F.when(F.col("words") == 0, F.col(f"row.`{c}`")).otherwise(changed[c]).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        )
    )


def oracle_sql() -> str:
    """The query on documents in DuckDB's SQL: the same keys, with the words before each row in one window."""
    return r"""
WITH d AS (
  SELECT doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         md5(concat('mix-17:', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2 * source_size AS bound,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT + 1] AS weight
  FROM s),
l AS (
  SELECT *, row_number() OVER o AS pos,
         3 * (SELECT sum(source_size) FROM s)
           - 2 * coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         2 * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft
  FROM w WINDOW o AS (ORDER BY bound::DOUBLE / weight, source IS NULL, source)),
f AS (SELECT pos, lft, heft FROM l WHERE weight::DOUBLE * lft <= bound::DOUBLE * heft ORDER BY pos LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN bound::DOUBLE
              ELSE (weight * f.lft)::DOUBLE / f.heft::DOUBLE END AS target
  FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p"""
