"""How the sources of a language diverge in their words: chi-square-like distances of all pairs, and each source's own terms.

A language keeps the terms that occur in enough of its documents. A group (a source of a language) gives each kept term
with count c the share p = 1 + floor(SCALE * (c + 1) / (N + V)), where N is the sum of its counts and V the number of kept terms;
p differs from q by floor((p - q)^2 / q). All of it is exact in whole numbers.

The pairs are a product of the group-term matrix with its transpose, row by row after Gustavson: the counts lie in a
term-major index, and each group scatters its terms through it into one dense accumulator over its peers, so no pair of
postings is ever a row. Terms that a group lacks have a share too, its zero share, which only depends on the group; what
the accumulators have for terms that both groups have is therefore corrected by baselines, which take each group's distinct
counts against the zero shares of all peers:

    sum f(p, q) = V f(z, y) + sum over own terms [f(p, y) - f(z, y)] + sum over the peer's terms [f(z, q) - f(z, y)]
                  + sum over common terms [f(p, q) - f(p, y) - f(z, q) + f(z, y)]
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import checkpoint, named

SCALE = 1_000_000_000
LEAST_DOCS = 3
TERM_RANKS = 200
#: Distinct terms, and counts of terms in sources, that a task holds before it hands them on; both are looked at after so many tokens.
HELD_TERMS, HELD_COUNTS = 300_000, 4_000_000
PENDING_TOKENS = 1 << 20
#: Postings that a task takes at a time, and cells of accumulators that it keeps from one time to the next.
BLOCK_POSTINGS, KEPT_CELLS = 1 << 20, 1 << 22
#: Bytes that are no letters (ASCII other than A-Z, a-z) part terms; A-Z become lower case.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def divergence(p, q):
    """floor((p - q)^2 / q) of whole numbers; differences of at most 3 * 10^9."""
    return (p - q) * (p - q) // q


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in decimals, which don't overflow."""
    up = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.expr("1L") + F.call_function("div", up, (total + kept).cast("decimal(20,0)"))


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(sorted_keys)])


class _Numbers(dict):
    """Numbers from 0 for what is asked, in the order in which it first comes."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class _Counted:
    """What a task has counted in a language: documents with a term, and occurrences by term and source, both as numbers."""

    def __init__(self):
        self.terms, self.sources = _Numbers(), _Numbers()
        self.docs = np.zeros(0, np.int64)
        self.texts: list[tuple[int, np.ndarray]] = []
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, source: str, terms: list[bytes]) -> None:
        self.texts.append((self.sources[source], np.fromiter(map(self.terms.__getitem__, terms), np.int64, len(terms))))

    def fold(self) -> None:
        """Count the texts that wait."""
        if not self.texts:
            return
        codes, lengths = np.concatenate([c for _, c in self.texts]), [len(c) for _, c in self.texts]
        once = np.sort(np.repeat(np.arange(len(lengths)), lengths) * len(self.terms) + codes)
        once = once[_firsts(once)]
        docs = np.bincount(once % max(1, len(self.terms)), minlength=len(self.terms))
        docs[: len(self.docs)] += self.docs
        self.docs = docs
        self.sums.append(np.unique(codes << 32 | np.repeat([s for s, _ in self.texts], lengths), return_counts=True))
        self.texts.clear()
        if len(self.sums) > 8:
            self.sums = [self.summed()]

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (term and source) with their counts."""
        keys, times = (np.concatenate([x[k] for x in self.sums]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = _firsts(keys)
        return keys[at], np.add.reduceat(times[order], at) if len(at) else times

    def rows(self, lang: str):
        self.fold()
        if not self.terms:
            return
        keys, times = self.summed()
        starts = np.searchsorted(keys >> 32, np.arange(len(self.terms) + 1))
        sources = pa.array(list(self.sources), pa.string()).take(pa.array(keys & 0xFFFFFFFF))
        postings = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([sources, pa.array(times)], ["source", "n"]))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        columns = [pa.repeat(lang, len(terms)), terms, pa.array(self.docs), pa.array(np.add.reduceat(times, starts[:-1])), postings]
        whole = pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "total", "postings"])
        for at in range(0, len(terms), 50_000):
            yield whole.slice(at, 50_000)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, term, docs, total, postings) of what each task reads: documents, occurrences and those by source (source, n).

    A term has a row for each task at most, more where tasks hold more than HELD_TERMS terms.
    """

    def count(batches):
        seen: dict[str, _Counted] = {}
        pending = 0

        def hand_on():
            for lang, counted in seen.items():
                yield from counted.rows(lang)
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                terms = (text.as_py() or b"").translate(LETTERS).split()
                if lang not in seen:
                    seen[lang] = _Counted()
                seen[lang].add(source, terms)
                pending += len(terms) + 1
                if pending > PENDING_TOKENS:
                    pending = 0
                    for counted in seen.values():
                        counted.fold()
                    if sum(len(x.terms) for x in seen.values()) > HELD_TERMS or sum(len(k) for x in seen.values() for k, _ in x.sums) > HELD_COUNTS:
                        yield from hand_on()
        yield from hand_on()

    lang, source, text = named(docs, lang_col, source_col, text_col)
    cells = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*cells).mapInArrow(count, "lang string, term string, docs long, total long, postings array<struct<source: string, n: long>>")


def _merged(table: pa.Table, least_docs: int = 0) -> pa.Table:
    """One row for each language and term with the sums of its rows, if it is in enough documents."""
    lang, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
    keys = term.indices.to_numpy().astype(np.int64) * max(1, len(lang.dictionary)) + lang.indices.to_numpy()
    order = np.argsort(keys, kind="stable")
    at = _firsts(keys[order])
    docs, total = (np.add.reduceat(table.column(c).to_numpy()[order], at) if len(at) else np.zeros(0, np.int64) for c in ("docs", "total"))
    enough = docs >= least_docs
    order = order[np.repeat(enough, np.diff(np.append(at, len(order))))]
    if not len(order):
        return table.slice(0, 0)
    at = _firsts(keys[order])
    lists = table.column("postings").combine_chunks().take(pa.array(order))
    flat = lists.flatten()
    row = np.repeat(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order)))), lists.value_lengths().to_numpy())
    source = flat.field("source").dictionary_encode()
    keys = row << 32 | source.indices.to_numpy()
    by_source = np.argsort(keys, kind="stable")
    keys = keys[by_source]
    first = _firsts(keys)
    n = np.add.reduceat(flat.field("n").to_numpy()[by_source], first)
    sources = source.dictionary.take(pa.array(keys[first] & 0xFFFFFFFF))
    starts = np.searchsorted(keys[first] >> 32, np.arange(len(at) + 1))
    postings = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([sources, pa.array(n)], ["source", "n"]))
    one = table.select(["key", "lang", "term"]).take(pa.array(order[at]))
    columns = [*(one.column(c) for c in ("key", "lang", "term")), pa.array(docs[enough]), pa.array(total[enough]), postings]
    return pa.table(columns, names=["key", "lang", "term", "docs", "total", "postings"])


def term_index(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Term-major index: lang, term, total and postings (source, n) of terms in enough documents; one exchange by term.

    A term's rows stand together by the hash that Spark sorts by, so what a task merges at a time is bounded, and only
    terms that stay have their postings opened.
    """

    def merge(batches):
        open_ = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if open_ is None else pa.concat_tables([open_, table.cast(open_.schema)])
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield from _merged(table.slice(0, cut), least_docs).drop_columns(["key", "docs"]).to_batches()
            open_ = _merged(table.slice(cut))
        if open_ is not None:
            yield from _merged(open_, least_docs).drop_columns(["key", "docs"]).to_batches()

    dealt = counts.repartition("lang", "term").select(F.xxhash64("lang", "term").alias("key"), "*").sortWithinPartitions("key")
    return dealt.mapInArrow(merge, "lang string, term string, total long, postings array<struct<source: string, n: long>>")


def groups_of(docs: DataFrame, index: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, n, lang_n, kept, peer): each group with its and its language's sums, kept terms, and a number within the language."""
    lang, source = named(docs, lang_col, source_col)
    pairs = docs.select(*(F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    sums = index.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    langs = index.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("kept"))
    found = pairs.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "lang_n", "kept"])
    return found.withColumn("peer", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def _scatter(batches):
    """Sums over common terms for pairs of peers: rows of the index in blocks, each group's terms into a dense row."""
    names, held, size = ["lang", "peer", "other", "value"], [], 0
    kept: dict[str, np.ndarray] = {}

    def rows(lang, peer, line):
        others = np.flatnonzero(line)
        if len(others):
            columns = [pa.array([lang] * len(others)), pa.array(np.full(len(others), peer)), pa.array(others), pa.array(line[others])]
            yield pa.RecordBatch.from_arrays(columns, names)

    def block():
        table = pa.Table.from_batches(held)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        codes = langs.indices.to_numpy()
        lists = table.column("postings").combine_chunks()
        starts = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        peer, p, z = (flat.field(f).to_numpy().astype(np.int64) for f in ("peer", "p", "z"))
        term = np.repeat(np.arange(len(codes)), np.diff(starts))
        peers = table.column("peers").to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(codes[term] == code)
            width = int(peers[codes == code][0])
            order = mine[np.argsort(peer[mine], kind="stable")]
            ends = np.flatnonzero(np.diff(np.append(peer[order], -1)))
            dense = width * width <= KEPT_CELLS
            if dense and lang not in kept:
                kept[lang] = np.zeros((width, width), np.int64)
            first = 0
            for end in ends + 1:
                own = order[first:end]
                first = end
                at, lengths = starts[term[own]], starts[term[own] + 1] - starts[term[own]]
                reach = np.repeat(at - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
                mine_p, zero = np.repeat(p[own], lengths), z[own[0]]
                theirs, their_zero = p[reach], z[reach]
                gain = divergence(mine_p, theirs) - divergence(mine_p, their_zero) - divergence(zero, theirs) + divergence(zero, their_zero)
                line = kept[lang][peer[own[0]]] if dense else np.zeros(width, np.int64)
                np.add.at(line, peer[reach], gain)
                if not dense:
                    yield from rows(lang, peer[own[0]], line)
        if sum(x.size for x in kept.values()) > 4 * KEPT_CELLS:
            yield from flush()

    def flush():
        for lang, matrix in kept.items():
            for peer, line in enumerate(matrix):
                yield from rows(lang, peer, line)
        kept.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            size += len(part.column("postings").flatten())
            if size >= BLOCK_POSTINGS:
                yield from block()
                held.clear()
                size = 0
    if held:
        yield from block()
    yield from flush()


def _baselines(batches):
    """For each group and all its peers: what its own counts give against the peers' zero shares, and back."""
    names = ["lang", "peer", "other", "value"]
    for batch in batches:
        for lang, peer, zero, kept, shares, times, zeros in zip(*(batch.column(n) for n in ("lang", "peer", "z", "kept", "shares", "times", "zeros"))):
            lang, peer, zero, kept = lang.as_py(), peer.as_py(), zero.as_py(), kept.as_py()
            shares, times = (np.array(x.as_py(), np.int64) for x in (shares, times))
            y = np.array(zeros.as_py(), np.int64)
            both = divergence(zero, y)
            away, back = kept * both, np.zeros(len(y), np.int64)
            for p, n in zip(shares, times):
                away += n * (divergence(p, y) - both)
                back += n * (divergence(y, p) - divergence(y, zero))
            others = np.arange(len(y))
            here = np.full(len(y), peer)
            for a, b, value in ((here, others, away), (others, here, back)):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(y)), pa.array(a), pa.array(b), pa.array(value)], names)


PAIR_SCHEMA = "lang string, peer long, other long, value long"


def pair_values(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, peer, other, value): the sum of divergences over all kept terms for each ordered pair of groups of a language."""
    shared = groups.select("lang", "source", "peer", "kept", F.col("n").alias("sum"), _share(F.lit(0), F.col("n"), F.col("kept")).alias("z"))
    shared = shared.withColumn("peers", F.count("*").over(Window.partitionBy("lang")))
    posted = index.select("lang", "term", F.explode("postings").alias("x")).select("lang", "term", "x.source", "x.n")
    posted = posted.join(shared, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("sum"), F.col("kept")))
    lists = posted.groupBy("lang", "term").agg(F.collect_list(F.struct("peer", "p", "z")).alias("postings"), F.first("peers").alias("peers"))
    common = lists.select("lang", "postings", "peers").mapInArrow(_scatter, PAIR_SCHEMA)

    spread = posted.groupBy("lang", "peer", "p").agg(F.count("*").alias("times"))
    spread = spread.groupBy("lang", "peer").agg(F.collect_list(F.struct("p", "times")).alias("x"))
    zeros = shared.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("peer", "z"))).alias("zeros"))
    own = shared.select("lang", "peer", "z", "kept").join(spread, ["lang", "peer"], "left").join(zeros, "lang")
    none = F.array().cast("array<long>")
    own = own.select(
        "lang", "peer", "z", F.col("kept").cast("long").alias("kept"), F.coalesce("x.p", none).alias("shares"), F.coalesce("x.times", none).alias("times"), F.col("zeros.z").alias("zeros")
    )
    base = own.mapInArrow(_baselines, PAIR_SCHEMA)
    # partial sums pass the range of longs on the way; the whole sum does not
    exact = F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value")
    return common.unionAll(base).where("peer != other").groupBy("lang", "peer", "other").agg(exact)


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    ranks: int = TERM_RANKS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group.

    Part `pair`: each other source of the language, value as above, all ranks. Part `term`: the group's terms whose share
    is above the language's, by their divergence from it, the first `ranks`. Ranks go by value, then by item.

    Null lang, source and text count as ''. Texts are read whole, however long; repeated rows count as often as they come;
    a group without terms takes part in pairs by its zero share (0 where its language keeps no term), an empty table gives
    none. Other columns are ignored, whatever their names. Sums of a language stay below 10^18 counts, and kept terms below 10^9.
    """
    index = checkpoint(term_index(term_counts(docs, lang_col, source_col, text_col), least_docs))
    groups = checkpoint(groups_of(docs, index, lang_col, source_col))
    numbered = groups.select("lang", "source", "peer")
    pairs = pair_values(index, groups.where("kept > 0"))
    # where no term is kept, pairs are worth 0
    bare = numbered.join(groups.where("kept = 0").select("lang").distinct(), "lang", "left_semi")
    twin = bare.select("lang", F.col("source").alias("item"))
    zero = bare.join(twin, "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.join(numbered, ["lang", "peer"]).join(
        numbered.select("lang", F.col("peer").alias("other"), F.col("source").alias("item")), ["lang", "other"]
    )
    pairs = pairs.select("lang", "source", "item", "value").unionAll(zero)

    posted = index.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    posted = posted.join(groups.select("lang", "source", F.col("n").alias("sum"), "lang_n", "kept"), ["lang", "source"])
    posted = posted.withColumn("p", _share(F.col("n"), F.col("sum"), F.col("kept"))).withColumn("q", _share(F.col("total"), F.col("lang_n"), F.col("kept")))
    over = posted.where("p > q").selectExpr("lang", "source", "term item", "(p - q) * (p - q) div q value")

    def ranked(rows, part):
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").unionAll(ranked(over, "term").where(F.col("rank") <= ranks))


def oracle_sql(least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> str:
    """The same in DuckDB, with all groups beside all kept terms."""
    return rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT lang, source, row_no, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT row_no) >= {least_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
m AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.total + 1) // (v.lang_n + v.v))::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value
  FROM m AS a JOIN m AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
own AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM m WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM all_pairs
UNION ALL
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM own) WHERE rank <= {ranks}"""
