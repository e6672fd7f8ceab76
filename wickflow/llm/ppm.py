"""Language-model scores by prediction by partial matching over bytes, beside a smoothed word unigram.

A text is a string of bytes with an end mark. The model is a trie of byte contexts up to a fixed order with the
counts of what followed them in the training texts. A byte is coded in its longest known context; if it was not seen
there, the escape costs distinct / (total + distinct), and the next shorter context takes over, without the
symbols that the longer one has seen. Below the empty context all bytes left are equally likely.

Counts of every order come from all training texts by distributed aggregation, and none is dropped. A gram that training
holds was seen in its longest context, so its probability takes no escapes, in whichever text it stands. Texts are
stored compressed in blocks of bounded size; a block hands its distinct grams, as arrays by bucket of their contexts, to the tasks
that count these buckets, and gets their probabilities back, so what moves is in proportion to the texts. Only the grams
that held-out texts have and training lacks take a join for each order, from the longest down, until a known symbol or
one of the contexts that tasks have: those of the largest totals, at most max_nodes symbols in all, whole and with their
exact counts. A suffix of a context is at least as frequent, so with a context come all shorter ones that its escapes
need. The result doesn't depend on max_nodes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import checkpoint, drop_tables, named, write_table

#: Bytes that UTF-8 never holds: before the first byte and after the last.
START, END = 0xFE, 0xFF
ORDER = 5
#: Symbols in the contexts that tasks receive, beside those of the orders below ALWAYS, of which there are 66,049 at most.
MAX_NODES = 1_500_000
ALWAYS = 2
#: Totals below this are told apart when the contexts for tasks are chosen, larger ones in 16ths of powers of two.
EXACT_TOTALS = 4096
#: Words whose counts every task gets; the others are joined.
FREQUENT = 1 << 18
SMOOTHING = 0.1
#: A task hands on its counts once it holds so many distinct words.
HELD_WORDS = 500_000
#: Bytes of the texts in a block, but for its last text.
BLOCK = 1 << 24
#: Least number of buckets of contexts; there is one for each block's worth of bytes.
BUCKETS = 256
CHUNK = 1 << 21


def gram_codes(text: bytes, order: int) -> np.ndarray:
    """For each byte of the text and its end: the byte with the `order` bytes before it, oldest first, as one number."""
    symbols = np.frombuffer(bytes([START]) * order + text + bytes([END]), dtype=np.uint8)
    codes = np.zeros(len(symbols) - order, dtype=np.uint64)
    for k in range(order + 1):
        codes = (codes << np.uint64(8)) | symbols[k : k + len(codes)]
    return codes


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values[order], at)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def last_bytes(k: int) -> np.uint64:
    """Mask of the last k bytes of a code."""
    return np.uint64((1 << 8 * k) - 1)


class Trie:
    """Contexts and counts for each order, with what exclusion needs.

    levels: sorted gram codes and counts of each order from 0, of whole contexts; with a context come its suffixes.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order, self.levels = len(levels) - 1, []
        for k, (gram, count) in enumerate(levels):
            count = count.astype(np.float64)
            context, at, distinct = np.unique(gram >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(at, count, len(context))
            level = {"gram": gram, "count": count, "context": context, "total": total, "distinct": distinct.astype(np.float64)}
            level["direct"] = np.log10(count / (total + distinct)[at])  # of a gram whose context is the first one known
            if k:
                below = self.levels[k - 1]
                up, _ = _find(below["gram"], gram & last_bytes(k))
                parent, _ = _find(below["context"], context & last_bytes(k - 1))
                seen = np.bincount(at, below["count"][up], len(context))
                fresh = below["distinct"][parent] - level["distinct"]
                level["fresh"] = fresh  # symbols that only the shorter context has seen
                level["base"] = below["total"][parent] - seen + fresh
            self.levels.append(level)

    @classmethod
    def of_grams(cls, codes: np.ndarray, counts: np.ndarray, order: int) -> "Trie":
        """The whole trie from the counts of the longest grams."""
        grams = [_sums(codes, counts.astype(np.float64))]
        for k in range(order, 0, -1):
            grams.append(_sums(grams[-1][0] & last_bytes(k), grams[-1][1]))
        return cls(grams[::-1])

    def known_order(self, codes: np.ndarray) -> np.ndarray:
        """The longest context of each gram that is here."""
        found = np.zeros(len(codes), dtype=np.int64)
        for k in range(1, self.order + 1):
            found[_find(self.levels[k]["context"], codes >> np.uint64(8) & last_bytes(k))[1]] = k
        return found

    def log10(self, codes: np.ndarray, top: int | None = None, base_above=None, fresh_above=None) -> np.ndarray:
        """Log10 probability of the last byte of each gram after the others. Sorted codes are found fastest.

        From order `top` down; base_above and fresh_above are those of the longer context that each was escaped from, or NaN.
        """
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        top = self.order if top is None else top
        base_above = np.full(len(codes), np.nan) if base_above is None else base_above
        fresh_above = np.full(len(codes), np.nan) if fresh_above is None else fresh_above
        for k in range(top, -1, -1):
            level = self.levels[k]
            at, hit = _find(level["gram"], codes[open_] & last_bytes(k + 1))
            first = np.isnan(base_above)
            direct, later = hit & first, hit & ~first
            out[open_[direct]] = level["direct"][at[direct]]
            if later.any():
                out[open_[later]] += np.log10(level["count"][at[later]] / base_above[later])
            open_, base_above, fresh_above = open_[~hit], base_above[~hit], fresh_above[~hit]
            if not len(open_):
                return out
            context, known = _find(level["context"], codes[open_] >> np.uint64(8) & last_bytes(k))
            if known.any():
                first = np.isnan(base_above)
                base = np.where(first, (level["total"] + level["distinct"])[context], base_above)
                fresh = np.where(first, level["distinct"][context], fresh_above)
                pays = known & (fresh > 0)
                out[open_[pays]] += np.log10(fresh[pays] / base[pays])
                if k:
                    base_above = np.where(known, level["base"][context], base_above)
                    fresh_above = np.where(known, level["fresh"][context], fresh_above)
        lowest = self.levels[0]["distinct"][0] if len(self.levels[0]["distinct"]) else 0.0
        out[open_] -= math.log10(256 - lowest)
        return out

    def score(self, text: bytes) -> tuple[float, int]:
        """Log10 probability of a whole text with its end, in chunks of bounded size, and how many symbols that is."""
        total = 0.0
        for _, _, codes in coded([text], self.order):
            grams, counts = np.unique(codes, return_counts=True)
            total += float(self.log10(grams) @ counts)
        return total, len(text) + 1


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def coded(texts: list[bytes], order: int):
    """(which, lengths, codes) for about CHUNK grams at a time: numbers of the texts, how many grams of each follow, and these."""

    def joined(which):
        symbols = b"".join(bytes([START]) * order + texts[i] + bytes([END]) for i in which)
        symbols = np.frombuffer(symbols, dtype=np.uint8)
        lengths = np.array([len(texts[i]) + 1 for i in which])
        codes = np.zeros(len(symbols) - order, dtype=np.uint64)
        for k in range(order + 1):
            codes = (codes << np.uint64(8)) | symbols[k : k + len(codes)]
        within = np.ones(len(codes), bool)  # not across two texts
        begins = np.cumsum(lengths + order)[:-1]
        within[(begins[:, None] - 1 - np.arange(order)).ravel()] = False
        return np.array(which), lengths, codes[within]

    which, held = [], 0
    for i, text in enumerate(texts):
        if len(text) < CHUNK:
            which.append(i)
            held += len(text) + 1
            if held > CHUNK:
                yield joined(which)
                which, held = [], 0
            continue
        for start in range(0, len(text) + 1, CHUNK):
            codes = gram_codes(text[max(0, start - order) : start + CHUNK], order)[min(start, order) :]
            codes = codes if start + CHUNK > len(text) else codes[:-1]
            yield np.array([i]), np.array([len(codes)]), codes
    if which:
        yield joined(which)


def in_blocks(rows: DataFrame) -> DataFrame:
    """(block, size, ids, held_out, lengths, texts): rows of columns doc_id, held_out and text in pieces of about CHUNK, texts joined and compressed.

    A block is of some pieces of one task; size counts bytes and one more for each text.
    """
    kinds = {"block": pa.int64(), "size": pa.int64(), "ids": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "texts": pa.binary()}

    def scan(batches):
        task, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            length = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0)).astype(np.int64)
            ends = held + np.cumsum(length + 1)
            piece, held = (ends - length - 1) // CHUNK, int(ends[-1]) if len(ends) else held
            cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    ids, held_out, texts = (c.slice(low, high - low) for c in batch.columns)
                    packed = pa.Codec("zstd", 3).compress(b"".join(t for t in texts.cast(pa.binary()).to_pylist() if t), asbytes=True)
                    part = length[low:high]
                    row = (task + int(piece[low]) * CHUNK // BLOCK, int(part.sum()) + len(part), ids.to_pylist(), held_out.to_pylist(), part, packed)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds.values())], list(kinds))

    schema = "block long, size long, ids array<long>, held_out array<boolean>, lengths array<long>, texts binary"
    return rows.select("doc_id", "held_out", "text").mapInArrow(scan, schema)


def unpacked(lengths, packed: bytes) -> list[bytes]:
    """The texts of these lengths that a piece holds."""
    ends = np.cumsum(lengths).tolist()
    whole = pa.decompress(packed, decompressed_size=ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""
    return [whole[low:high] for low, high in zip([0, *ends], ends)]


def pressed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def opened(column, sizes) -> np.ndarray:
    """The numbers of all pressed arrays of a column, of these sizes, in turn; null has none."""
    found = (pa.decompress(x, decompressed_size=8 * n, codec="zstd", asbytes=True) for x, n in zip(column.to_pylist(), sizes) if x is not None)
    return np.frombuffer(b"".join(found), np.int64)


def from_steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The codes of arrays of steps that follow one another."""
    sums = np.cumsum(values)
    before = np.concatenate([[0], sums])[np.cumsum(sizes) - sizes]
    return sums - np.repeat(before, sizes)


def told(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """What blocks hold: counts of words (kind 0, item) and of texts (2) of training texts, and distinct grams (1) by block, held_out and bucket.

    Grams of one context share a bucket, in whose rows n of them stand as steps from the one before. times are their counts; held-out texts have none. Both are pressed.
    """
    fields = {"kind": pa.int32(), "item": pa.binary(), "n": pa.int64(), "block": pa.int64(), "held_out": pa.bool_(), "bucket": pa.int64()}
    fields |= {"codes": pa.binary(), "times": pa.binary()}

    def batch_of(size, **columns):
        columns = [pa.array(columns[c], t) if isinstance(columns.get(c), list) else columns.get(c, pa.nulls(size, t)) for c, t in fields.items()]
        return pa.RecordBatch.from_arrays(columns, list(fields))

    def grams(block, held_out, texts):
        found = [np.unique(codes, return_counts=True) for _, _, codes in coded(texts, order)]
        if not found:
            return
        codes, times = found[0] if len(found) == 1 else _sums(*(np.concatenate(x) for x in zip(*found)))
        bucket = ((codes >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        bucket, codes, times = bucket[by].astype(np.int64), codes[by].view(np.int64), times[by]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        step = max(1, len(ends) * HELD_WORDS // len(codes))
        for at in range(0, len(ends), step):
            offsets = np.append(ends[at - 1] if at else 0, ends[at : at + step])
            size, spans = len(offsets) - 1, list(zip(offsets, offsets[1:]))
            yield batch_of(
                size,
                kind=[1] * size,
                n=pa.array(np.diff(offsets)),
                block=[block] * size,
                held_out=[held_out] * size,
                bucket=pa.array(bucket[offsets[:-1]]),
                codes=[pressed(np.diff(codes[low:high], prepend=0)) for low, high in spans],
                times=[None if held_out else pressed(times[low:high]) for low, high in spans],
            )

    def scan(batches):
        words: Counter[bytes] = Counter()
        texts, at, trained = ([], []), None, 0

        def told_words():
            items, counts = list(words), list(words.values())
            for k in range(0, len(items), 50_000):
                part = counts[k : k + 50_000]
                yield batch_of(len(part), kind=[0] * len(part), item=items[k : k + 50_000], n=part)
            words.clear()

        def close():
            for held_out in (False, True):
                yield from grams(at, held_out, texts[held_out])
                texts[held_out].clear()

        for batch in batches:
            for block, held, lengths, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    yield from close()
                    at = block
                for held_out, text in zip(held, unpacked(lengths, packed)):
                    texts[held_out].append(text)
                    if not held_out:
                        trained += 1
                        words.update(tokens(text))
                if len(words) > HELD_WORDS:
                    yield from told_words()
        yield from close()
        yield from told_words()
        if trained:
            yield batch_of(1, kind=[2], n=[trained])

    schema = "kind int, item binary, n long, block long, held_out boolean, bucket long, codes binary, times binary"
    return blocks.select("block", "held_out", "lengths", "texts").mapInArrow(scan, schema)


def valued(told_: DataFrame) -> DataFrame:
    """(block, held_out, n, codes, times, of): for each block its grams as steps from the one before, their counts in training, and the totals of their contexts with the distinct symbols, all pressed.

    A gram that training lacks has 0 times. Rows without a block hold all grams of training, without of.
    """
    names = ["block", "held_out", "n", "codes", "times", "of"]

    def count(table: pa.Table) -> pa.Table:
        held, sizes = table.column("held_out").to_numpy(), table.column("n").to_numpy()
        codes = from_steps(opened(table.column("codes"), sizes), sizes)
        grams, times = _sums(codes[np.repeat(~held, sizes)], opened(table.column("times"), sizes))
        _, at, distinct = np.unique(grams >> 8, return_inverse=True, return_counts=True)
        of = (np.bincount(at, times, len(distinct)).astype(np.int64) + distinct)[at]
        found, known = _find(grams, codes)
        mine = [np.where(known, x[found], 0) if len(grams) else np.zeros(len(codes), np.int64) for x in (times, of)]
        spans = list(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)))
        columns = [
            [*table.column("block").to_pylist(), None],
            [*held.tolist(), False],
            [*sizes.tolist(), len(grams)],
            [*table.column("codes").to_pylist(), pressed(np.diff(grams, prepend=0))],
            [*(pressed(mine[0][low:high]) for low, high in spans), pressed(times)],
            [*(pressed(mine[1][low:high]) for low, high in spans), None],
        ]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    grams = told_.where("kind = 1").select("bucket", "block", "held_out", "n", "codes", "times")
    return grams.groupBy("bucket").applyInArrow(count, "block long, held_out boolean, n long, codes binary, times binary, of binary")


def counted_words(told_: DataFrame) -> DataFrame:
    """(kind, item, n): counts of words and of texts over all blocks."""
    return told_.where("kind != 1").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def counted_grams(values: DataFrame) -> DataFrame:
    """(code, n): counts of the grams of training."""

    def spread(batches):
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            codes = from_steps(opened(batch.column(1), sizes), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(opened(batch.column(2), sizes))], ["code", "n"])

    return values.where("block is null").select("n", "codes", "times").mapInArrow(spread, "code long, n long")


def lacking(values: DataFrame) -> DataFrame:
    """(block, code): grams of held-out texts that training lacks."""

    def scan(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            codes, away = from_steps(opened(batch.column(2), sizes), sizes), opened(batch.column(3), sizes) == 0
            blocks = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[away]), pa.array(codes[away])], ["block", "code"])

    return values.where("block is not null and held_out").select("block", "n", "codes", "times").mapInArrow(scan, "block long, code long")


def gather(docs: DataFrame, order: int) -> DataFrame:
    """(kind, item, code, n): counts of words (kind 0, item), of grams (1, code) and of texts (2), over all rows; column text."""
    found = told(in_blocks(docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")), order, BUCKETS)
    words = counted_words(found).select("kind", "item", F.lit(None).cast("long").alias("code"), "n")
    return words.unionByName(counted_grams(valued(found)).select(F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("item"), "code", "n"))


def contexts(grams: DataFrame, order: int) -> DataFrame:
    """(order, context, total, symbols): of each context of each order how often each byte follows; grams: code, n of the highest.

    symbols is an array of (s, n), 257 at most.
    """
    lower = F.explode(F.array(*(F.struct(F.lit(k).alias("order"), F.col("code").bitwiseAND(F.lit((1 << 8 * k + 8) - 1)).alias("code")) for k in range(order))))
    sums = grams.select(lower.alias("g"), "n").select("g.order", "g.code", "n").groupBy("order", "code").agg(F.sum("n").alias("n"))
    every = grams.select(F.lit(order).alias("order"), "code", "n").unionByName(sums)
    pair = F.struct(F.col("code").bitwiseAND(F.lit(255)).alias("s"), "n")
    return every.groupBy("order", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(pair).alias("symbols"))


def _step(total):
    """Totals in steps: each of its own below EXACT_TOTALS, then 16ths of powers of two."""
    return F.when(total < EXACT_TOTALS, total).otherwise(F.lit(EXACT_TOTALS) + F.floor(F.log2(total) * 16)).cast("long")


def frequent_contexts(table: DataFrame, max_nodes: int):
    """The condition on contexts that tasks receive: the largest totals that have at most max_nodes symbols, all below order ALWAYS.

    The histogram of totals has a few thousand rows at most.
    """
    steps = table.where(F.col("order") >= ALWAYS).groupBy(_step(F.col("total")).alias("step")).agg(F.sum(F.size("symbols")).alias("n"))
    room, cut = max_nodes, None
    for row in sorted(steps.collect(), reverse=True):
        room -= row["n"]
        if room < 0:
            break
        cut = row["step"]
    above = F.lit(False) if cut is None else _step(F.col("total")) >= cut
    return (F.col("order") < ALWAYS) | above


def looked_up(codes: DataFrame, rare: DataFrame, table: DataFrame, model, order: int) -> DataFrame:
    """(code, p): log10 probabilities of distinct grams, columns code and known (the longest context that the trie has).

    rare: the contexts that the trie lacks, table: all. Only the rare contexts that these grams have are prepared. A step
    for each order joins the grams that are still open with those of that order; what is left then ends in the trie.
    """
    mask = F.expr("shiftleft(1L, 8 * (order - 1)) - 1")
    upper = table.select(
        (F.col("order") + 1).alias("order"), F.col("context").alias("parent"), F.col("total").alias("ptotal"), F.col("symbols").alias("psymbols")
    )
    mine = F.transform("symbols", lambda e: e["s"])
    seen = F.aggregate(
        F.filter("psymbols", lambda e: F.array_contains(mine, e["s"])), F.lit(0).cast("long"), lambda a, e: a + e["n"]
    )
    fresh = F.size("psymbols") - F.size("symbols")
    tried = F.explode(
        F.array(*(F.struct(F.lit(k).alias("order"), F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("context")) for k in range(ALWAYS, order + 1)))
    )
    tried = codes.select("known", tried.alias("c")).where("known < c.order").select("c.order", "c.context").distinct()
    # keys that differ most come first, as joins sort by them
    rare = checkpoint(
        rare.join(tried, ["context", "order"], "left_semi")
        .withColumn("parent", F.col("context").bitwiseAND(mask))
        .join(upper, ["parent", "order"])
        .select("order", "context", "total", "symbols", fresh.cast("double").alias("fresh_here"), (F.col("ptotal") - seen + fresh).cast("double").alias("base_here"))
    )
    none = F.lit(None).cast("double")
    state = codes.select("code", "known", F.lit(0.0).alias("p"), F.lit(False).alias("done"), none.alias("base"), none.alias("fresh"))
    for k in range(order, ALWAYS - 1, -1):
        open_ = ~F.col("done") & (F.col("known") < k)
        context = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * k) - 1))
        state = state.withColumn("context", F.when(open_, context).otherwise(-1 - F.col("code")))  # of its own, to spread
        here = rare.where(F.col("order") == k).drop("order")
        count = F.get(F.filter("symbols", lambda e: e["s"] == F.col("code").bitwiseAND(F.lit(255))), F.lit(0))["n"]
        distinct = F.size("symbols")
        state = state.join(here, "context", "left").withColumn("count", count)
        base = F.coalesce("base", F.col("total") + distinct)
        left = F.coalesce("fresh", distinct.cast("double"))
        there, hit = F.col("total").isNotNull(), F.col("count").isNotNull()
        cost = F.when(hit, F.log10(F.col("count") / base)).when(there & (left > 0), F.log10(left / base)).otherwise(0.0)
        state = state.select(
            "code",
            "known",
            (F.col("p") + cost).alias("p"),
            (F.col("done") | hit).alias("done"),
            F.when(there, F.col("base_here")).otherwise(F.col("base")).alias("base"),
            F.when(there, F.col("fresh_here")).otherwise(F.col("fresh")).alias("fresh"),
        )

    def finish(batches):
        for batch in batches:
            codes, known, p, done, base, fresh = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            p = p.copy()
            for k in np.unique(known[~done]):
                at = np.flatnonzero(~done & (known == k))
                p[at] += model.value[0].log10(codes[at].astype(np.uint64), int(k), base[at].astype(np.float64), fresh[at].astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["code", "p"])

    return state.mapInArrow(finish, "code long, p double")


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The items of the highest counts, at most so many: all above a count that a histogram in 16ths of powers of two gives.

    The histogram has about a thousand rows at most, so no task sorts or gathers the items.
    """
    step = F.floor(F.log2("n") * 16)
    total, cut = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > limit:
            break
        cut = row["step"]
    return counts.where(step >= cut) if cut is not None else counts.where("false")


def score_documents(
    docs: DataFrame,
    order: int = ORDER,
    max_nodes: int = MAX_NODES,
    frequent: int = FREQUENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of each row.

    Rows whose crc32 of the id as text is divisible by 10 are held out, a null id counting as empty text; all others
    train. Tokens are the words in lower case and one end. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))), score is
    the model's log10 probability of the bytes and their end. A null text is empty. Repeated rows count each time.
    Without training rows every count is 0, an empty table gives none. Texts are read whole, in chunks. Other columns are
    ignored, whatever their names.
    """
    doc_id, text = named(docs, id_col, text_col)
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"),
        (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"),
        text.cast("string").alias("text"),
    )
    blocks = write_table(in_blocks(rows))
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = write_table(told(blocks, order, max(BUCKETS, size // BLOCK)))
    values = write_table(valued(found))
    counts = checkpoint(counted_words(found))
    drop_tables(found)
    known = counts.where("kind = 0")
    facts = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train_tokens, distinct = facts[0] + texts, facts[1] + (texts > 0)
    bottom = train_tokens + SMOOTHING * (distinct + 1)
    unseen, end = math.log10(SMOOTHING / bottom), math.log10((texts + SMOOTHING) / bottom)

    table = write_table(contexts(counted_grams(values), order))
    chosen = frequent_contexts(table, max_nodes)
    grams = table.where(chosen).select("order", "context", F.explode("symbols").alias("e"))
    grams = grams.select("order", F.shiftleft("context", 8).bitwiseOR(F.col("e.s")).alias("code"), "e.n").toArrow()  # about max_nodes rows
    level, codes, times = (grams.column(k).to_numpy() for k in range(3))
    at = [np.flatnonzero(level == k) for k in range(order + 1)]
    at = [x[np.argsort(codes[x])] for x in at]
    trie = Trie([(codes[x].astype(np.uint64), times[x]) for x in at])
    del grams, level, codes, times, at
    top = most_frequent(known, frequent).select("item", "n").toArrow()
    common = {w: math.log10((c + SMOOTHING) / bottom) for w, c in zip(top.column(0).to_pylist(), top.column(1).to_pylist())}
    model = docs.sparkSession.sparkContext.broadcast((trie, common))
    def contexts_known(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value[0].known_order(codes))], ["code", "known"])

    lack = lacking(values)
    wanted = lack.select("code").distinct().mapInArrow(contexts_known, "code long, known long")
    late = lack.join(looked_up(wanted, table.where(~chosen), table, model, order), "code").groupBy("block")
    late = late.agg(F.collect_list(F.struct("code", "p")).alias("g")).select("block", F.col("g.code").alias("late"), F.col("g.p").alias("p"))
    every = values.where("block is not null").drop("held_out").unionByName(late, allowMissingColumns=True)
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_seen": pa.int64(), "base": pa.float64()}
    kinds |= {"score": pa.float64(), "n_bytes": pa.int64(), "rest": pa.list_(pa.binary())}

    def score(part: pa.Table, grams: pa.Table) -> pa.Table:
        common = model.value[1]
        late, p = (pc.list_flatten(grams.column(c)).to_numpy() for c in ("late", "p"))
        sizes = pc.fill_null(grams.column("n"), 0).to_numpy()
        codes, times, of = (opened(grams.column(c), sizes) for c in ("codes", "times", "of"))
        code, seen = from_steps(codes, sizes), times > 0
        code, value = np.concatenate([code[seen], late]), np.concatenate([np.log10(times[seen] / of[seen]), p])
        by = np.argsort(code)
        code, value = code[by].view(np.uint64), value[by]
        raw = [text for row in zip(part.column("lengths").to_pylist(), part.column("texts").to_pylist()) for text in unpacked(*row)]
        scores = np.zeros(len(raw))
        for which, lengths, codes in coded(raw, order):
            by = np.argsort(codes)
            codes = codes[by]
            begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            p = np.empty(len(codes))
            p[by] = np.repeat(value[np.searchsorted(code, codes[begins])], np.diff(begins, append=len(codes)))
            scores[which] += np.add.reduceat(p, np.cumsum(lengths) - lengths)
        out = []
        for text in raw:
            words = tokens(text)
            logs = [common.get(word) for word in words]
            rest = [word for word, log in zip(words, logs) if log is None]
            out.append((len(words) + 1, int(texts > 0) + len(words) - len(rest), end + sum(log for log in logs if log is not None), len(text), rest))
        n_tokens, seen, base, n_bytes, rest = zip(*out)
        columns = [pc.list_flatten(part.column("ids")), pc.list_flatten(part.column("held_out")), n_tokens, seen, base, scores, n_bytes, rest]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    schema = "doc_id long, held_out boolean, n_tokens long, n_seen long, base double, score double, n_bytes long, rest array<binary>"
    scored = blocks.select("block", "ids", "held_out", "lengths", "texts").groupBy("block").cogroup(every.groupBy("block")).applyInArrow(score, schema)
    first = checkpoint(scored.withColumn("row", F.monotonically_increasing_id()))
    drop_tables(blocks, values, table)
    words = first.select("row", F.explode("rest").alias("item")).join(known.select("item", "n"), "item", "left")
    value = F.when(F.col("n").isNull(), F.lit(unseen)).otherwise(F.log10((F.col("n") + SMOOTHING) / bottom))
    added = words.groupBy("row").agg(F.sum(value).alias("more"), F.count("n").alias("more_seen"))
    return first.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_seen") + F.coalesce("more_seen", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
    )
