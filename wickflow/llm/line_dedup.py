"""Line dedup within an edit bound of one character, by a deletion-neighbourhood join.

Two different lines are within one edit if they agree after deleting the character at one position in each (a
substitution), or if one becomes the other by a deletion. So each line emits its variants as hashed keys, a
substitution key with the position and a deletion key without, and lines that share a key are near. All who
share a substitution key are near each other, and a deletion key has one whole line, so the earliest
partner is a minimum for each key, and no pairs within a group are made.

Lines have hundreds of characters, and most have no neighbour at all. Two exact filters come first: lines
within one edit share their first or their last half, and among those that do, they share all but a small window
around the edit. Variants are emitted only where such a key is shared, inside the window that it leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import SPACES, checkpoint

#: Shorter lines have no near ones, as an edit there makes another line ("page 3", "page 4"); equal ones of them go.
MIN_CHARS = 20
NO_ID = (1 << 63) - 1
BUCKETS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Prefixes:
    """Polynomial hashes of a line's prefixes and suffixes modulo 2**64, with its characters mixed first."""

    def __init__(self, line: str):
        chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        chars = (chars + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        chars = (chars ^ (chars >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        chars ^= chars >> np.uint64(29)
        self.n = n = len(chars)
        power = np.empty(n + 1, dtype=np.uint64)
        power[0] = 1
        power[1:] = np.multiply.accumulate(np.full(n, BASE))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(chars * power[:n], dtype=np.uint64, out=self.sums[1:])
        self.power = power

    def suffix(self, at):
        """Hash of the line from these positions on, free of what comes before."""
        inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.n, INVERSE)]))
        return (self.sums[self.n] - self.sums[at]) * inverse[at]

    def deleted(self, at):
        """Hashes of the line without the character at each position."""
        return self.sums[at] + (self.sums[self.n] - self.sums[at + 1]) * INVERSE


def mixed(*parts) -> np.ndarray:
    out = np.full(1, 0x51A7, dtype=np.uint64)
    for p in parts:
        out = (out ^ np.atleast_1d(p).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        out = out ^ (out >> np.uint64(31))
    return out


def window_grid(n: int) -> int:
    """Distance of window starts in a line whose longer partner has n characters: an eighth of a power of two below n."""
    return max(4, (1 << (n.bit_length() - 1)) // 16)


def windows(line: Prefixes) -> dict[int, tuple[int, int]]:
    """Key to (start, end) of the part that an edit may touch, for the line as the longer and the shorter of a pair.

    Partners within one edit share one of these keys: with p equal characters in front and q at the end, p + q is
    at least the longer length less one, and the window from the grid point at or below p leaves no more than q behind.
    """
    found, n = {}, line.n
    for longer in (n, n + 1):
        grid = window_grid(longer)
        starts = np.arange(0, longer, grid)
        behind = np.maximum((longer - 1 - starts) // grid * grid - grid, 0)
        starts, behind = starts[starts + behind <= n], behind[starts + behind <= n]
        keys = mixed(grid, starts, behind, line.sums[starts], line.suffix(n - behind))
        for key, start, tail in zip(keys.view(np.int64).tolist(), starts.tolist(), behind.tolist()):
            found[key] = (start, n - tail)
    return found


def variants(line: Prefixes, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the substitutions and of the deletions inside these spans."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.unique(np.concatenate([np.arange(a, min(b, line.n)) for a, b in spans]))
    gone = line.deleted(at)
    return mixed(1, gone, at, line.n).view(np.int64), mixed(2, gone, line.n - 1).view(np.int64)


def whole_key(line: Prefixes) -> int:
    return int(mixed(2, line.sums[line.n], line.n).view(np.int64)[0])


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = 0
    while same < len(a) and a[same] == b[same]:
        same += 1
    return a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[f"`{text_col}`"].cast("string")
    return docs.select(
        F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(NO_ID)).alias("key"),
        F.xxhash64(text).alias("row_hash"),
        text.alias("text"),
        F.struct("*").alias("row"),
    )


def _has_word(line):
    return F.trim(F.translate(line, SPACES, " " * len(SPACES))) != ""


def kept_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short_too: bool = True
) -> DataFrame:
    """(key, row_hash, kept): for each document, the numbers of its lines of min_chars or more that no earlier line is near to,
    and, with short_too, of its shorter lines, blank ones excepted, that no earlier line equals.
    """
    texts = _keyed(docs, id_col, text_col).select("key", "row_hash", "text").where("text is not null")
    line, size = F.col("line"), F.length("line")

    def half(longer):
        """Half of the length but one, on a coarse grid, so that lines of almost equal length compare the same part."""
        step = F.greatest(F.lit(8), F.shiftright(longer, 3))
        step = F.pow(F.lit(2), F.floor(F.log2(step))).cast("int")
        return (F.floor(F.floor((longer - 1) / 2) / step) * step).cast("int")

    def anchors(longer):
        h = half(longer)
        return [F.xxhash64(F.lit(0), h, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit(1), h, F.substring(line, -h, h))]

    lines = (
        texts.select("key", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .where((size >= min_chars) | _has_word(line) if short_too else size >= min_chars)
        .select(
            F.xxhash64(line).alias("h1"),
            F.xxhash64(F.lit(7), line).alias("h2"),
            F.struct("key", "row_hash", "at").alias("spot"),
            F.when(size >= min_chars, F.array_distinct(F.array(*anchors(size), *anchors(size + 1))))
            .otherwise(F.array().cast("array<long>"))
            .alias("anchors"),
        )
    )
    first = checkpoint(
        lines.groupBy("h1", "h2").agg(F.min("spot").alias("spot"), F.min("anchors").alias("anchors"))
    )
    keyed = first.select("h1", F.explode("anchors").alias("anchor"))
    shared = keyed.groupBy("anchor").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low != high")
    suspects = keyed.join(shared.select("anchor"), "anchor", "left_semi").select("h1").distinct()
    spots = checkpoint(first.join(suspects, "h1", "left_semi").select("spot.*"))

    def bucket(key):
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS))

    buckets = spots.select(bucket("key").alias("bucket")).distinct()  # at most BUCKETS rows
    wanted = spots.groupBy("key", "row_hash").agg(F.sort_array(F.collect_set("at")).alias("at"))
    lines = (
        texts.join(F.broadcast(buckets), bucket(texts["key"]) == buckets["bucket"], "left_semi")
        .join(wanted, ["key", "row_hash"])
        .select("key", "row_hash", "at", F.split("text", "\n", -1).alias("lines"))
        .dropDuplicates(["key", "row_hash"])
        .select("key", "row_hash", F.explode("at").alias("at"), "lines")
        .select(F.struct("key", "row_hash", "at").alias("spot"), F.get("lines", F.col("at")).alias("line"))
    )
    lines = checkpoint(lines)

    def emit_windows(batches):
        for batch in batches:
            spots, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = list(windows(Prefixes(text)))
                spots += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(spots, pa.int32())), pa.array(keys, pa.int64())], ["spot", "window"]
            )

    spot_type = lines.schema["spot"].dataType.simpleString()
    opened = lines.mapInArrow(emit_windows, f"spot {spot_type}, window long")
    crowded = opened.groupBy("window").agg(F.min("spot").alias("low"), F.max("spot").alias("high")).where("low != high")
    open_at = opened.join(crowded.select("window"), "window", "left_semi").groupBy("spot").agg(F.collect_set("window").alias("windows"))
    near = lines.join(open_at, "spot")

    def emit_variants(batches):
        for batch in batches:
            rows, kinds, keys = [], [], []
            for i, (text, shared) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                line = Prefixes(text)
                spans = windows(line)
                for kind, found in zip((0, 1), variants(line, [spans[w] for w in shared])):
                    rows += [i] * len(found)
                    kinds += [kind] * len(found)
                    keys += found.tolist()
                rows.append(i)
                kinds.append(2)
                keys.append(whole_key(line))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(kinds, pa.int32()), pa.array(keys, pa.int64())],
                ["spot", "kind", "variant"],
            )

    emitted = checkpoint(near.select("spot", "line", "windows").mapInArrow(emit_variants, f"spot {spot_type}, kind int, variant long"))
    whole, cut, swapped = (F.when(F.col("kind") == k, F.col("spot")) for k in (2, 1, 0))
    earliest = emitted.groupBy("variant").agg(
        F.min(swapped).alias("swapped"), F.min(cut).alias("cut"), F.min(whole).alias("whole"), F.count("*").alias("n")
    ).where("n > 1")
    partner = F.when(F.col("kind") == 0, F.col("swapped")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("cut"))
    pairs = (
        emitted.join(earliest, "variant")
        .select("spot", partner.alias("partner"))
        .where("partner < spot")
        .distinct()
    )
    left, right = (lines.select(F.col("spot").alias(s), F.col("line").alias(t)) for s, t in (("spot", "line"), ("partner", "other")))

    def verify(batches):
        for batch in batches:
            good = [within_one_edit(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], ["spot"])

    gone = (
        pairs.join(left, "spot").join(right, "partner").select("spot", "line", "other").mapInArrow(verify, f"spot {spot_type}").distinct()
    )
    kept = first.join(gone.select("spot", F.lit(True).alias("near")), "spot", "left").where("near is null")
    return kept.select("spot.*").groupBy("key", "row_hash").agg(F.collect_set("at").alias("kept"))


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short_too: bool = True
) -> DataFrame:
    """(row, text, lines, kept_lines): each row as a struct, its text without the lines that an equal or near line precedes.

    Lines part at \\n and come in the order of id (null last), text hash and position. A line of min_chars or more
    characters goes if any earlier line equals it or is within one edit of it, whether that one stays or not.
    Shorter lines go if an earlier line equals them, or stay without short_too; blank lines of fewer characters stay.
    Of rows with equal id and text, one keeps its lines. Null texts stay null, an empty table empty.
    Texts without a line to remove are unchanged; lines of any length are compared whole. A null id counts as 2**63 - 1.
    Other columns are carried in `row` untouched, whatever their names.
    """
    kept = kept_lines(docs, min_chars, id_col, text_col, short_too).select(
        F.col("key").alias("k"), F.col("row_hash").alias("h"), "kept"
    )
    rows = _keyed(docs, id_col, text_col)
    joined = rows.join(kept, (rows["key"] == kept["k"]) & (rows["row_hash"] == kept["h"]), "left")
    again = F.row_number().over(Window.partitionBy("key", "row_hash").orderBy("key", "row_hash")) > 1
    none = F.array().cast("array<int>")
    stay = F.when(again, none).otherwise(F.coalesce("kept", none))
    lines = F.split("text", "\n", -1)
    found = joined.withColumn("lines", lines).withColumn("stay", stay)

    def always(line):
        return (F.length(line) < min_chars) & ~_has_word(line) if short_too else F.length(line) < min_chars

    short = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: always(F.get("lines", i)))
    at = F.sort_array(F.concat(short, F.col("stay")))
    found = found.withColumn("staying", F.transform(at, lambda i: F.get("lines", i)))
    return found.select(
        "row",
        F.array_join("staying", "\n").alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.size("staying"), F.lit(0)).alias("kept_lines"),
    )


def oracle_sql(min_chars: int = MIN_CHARS) -> str:
    """The query on documents in DuckDB's SQL: equal lines by grouping, near ones by hashed lines without a character."""
    return rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS line FROM d),
c AS (SELECT *, length(line) < {min_chars} AND trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')) = '' AS blank FROM l),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, pos) AS spot FROM c),
f AS (SELECT line, min(spot) AS spot FROM o WHERE NOT blank GROUP BY line),
v AS (
  SELECT spot, i, length(line) AS n, hash(left(line, i - 1) || chr(0) || substr(line, i + 1)) AS swap, hash(left(line, i - 1) || substr(line, i + 1)) AS cut
  FROM (SELECT spot, line, unnest(range(1, length(line) + 1)) AS i FROM f WHERE length(line) >= {min_chars})),
gone AS (
  SELECT spot FROM (SELECT spot, min(spot) OVER (PARTITION BY i, n, swap) AS first FROM v) WHERE spot > first
  UNION SELECT greatest(v.spot, w.spot) FROM v JOIN (SELECT spot, hash(line) AS whole FROM f WHERE length(line) >= {min_chars}) w ON v.cut = w.whole),
k AS (SELECT doc_id, pos, line FROM o WHERE blank OR spot IN (SELECT spot FROM f WHERE spot NOT IN (SELECT spot FROM gone)))
SELECT x.doc_id, coalesce(len(t.s), 0)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_kept, length(k.kept)::BIGINT AS kept_chars, md5(k.kept) AS kept_md5
FROM documents x LEFT JOIN d t ON t.doc_id = x.doc_id
LEFT JOIN (SELECT d.doc_id, count(k.pos) AS n, coalesce(string_agg(k.line, chr(10) ORDER BY k.pos), '') AS kept FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id) k ON k.doc_id = x.doc_id"""
