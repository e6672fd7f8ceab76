"""Quality rules: a decision list learned by sequential covering and applied as Spark expressions.

Statistics of a text are built-in expressions over its words and lines. The learner sees a bounded sample of
labelled statistics. It grows a conjunction of thresholds for bad and one for good documents on two thirds of the rows, by
the gain in information, prunes both on the last third, takes the surer one with its verdict, and takes away the
rows that it covers, until no rule is precise enough. The list comes out as ordered conditions, some that keep and some
that reject, with "keep" as default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import WORD_BREAK, named

#: Most labelled rows that a fit reads, the first by hash of their id.
SAMPLE_ROWS = 8000
THRESHOLDS = 24
MIN_PRECISION, MIN_KEEP_PRECISION = 0.95, 0.99
MIN_COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 4
SYMBOLS = "#*$%&|<>"
#: Rates that the rules may test, each from the counts below.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "line_words", "short_line_rate")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words in windows of this width that come twice or more, given an array of words.

    Windows are 64-bit hashes. Most texts repeat none, which a distinct count shows; else (hash, position) pairs are
    sorted, a window repeats if a neighbour has its hash, and each covers the words up to the next or its width.
    """

    def grams(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - width)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))

    def repeated(pairs: Column, sorted_grams: Column) -> Column:
        def at(pair: Column, j: Column) -> Column:
            same = F.coalesce(F.get(sorted_grams, j - 1) == pair["g"], F.lit(False))
            return F.when(same | F.coalesce(F.get(sorted_grams, j + 1) == pair["g"], F.lit(False)), pair["i"])

        return F.sort_array(F.filter(F.transform(pairs, at), lambda i: i.isNotNull()))

    def spread(hits: Column) -> Column:
        steps = F.transform(hits, lambda i, j: F.least(F.lit(width), F.coalesce(F.get(hits, j + 1) - i, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return _bind(
            pairs, lambda p: _bind(F.transform(p, lambda x: x["g"]), lambda g: _bind(repeated(p, g), spread))
        )

    def counted(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered(grams)).otherwise(F.lit(0))

    return F.when(F.size(words) > width, _bind(words, lambda w: _bind(grams(w), counted))).otherwise(F.lit(0))


def _bind(value: Column, use) -> Column:
    """use(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, counts of each text and the rates in FEATURES; with `carry` also the struct `row`. Null texts have no words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier
    line) and n_repeat_words (words in 5-word windows found twice or more). No shuffle: each row on its own.
    """
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    found = docs.select(
        docs[f"`{id_col}`"].cast("long").alias("doc_id"),
        text.alias("text"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    rest = ["row"] if carry else []
    found = found.select("doc_id", *rest, "text", _words(F.col("text")).alias("w"), F.split("text", "\n", -1).alias("lines"))
    worded = F.filter("lines", lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    found = found.select(
        "doc_id",
        *rest,
        F.size("w").cast("long").alias("n_words"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))).cast("long").alias("word_chars"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        worded.alias("worded"),
        _without(F.col("text"), "!?.,;:").cast("long").alias("marks"),
        _without(F.col("text"), "0123456789").cast("long").alias("digits"),
        _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("upper"),
    )
    per_word, per_char = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    found = found.select(
        "*",
        F.size("worded").alias("n_lines"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("worded", lambda x: F.length(x) < 20)).alias("short_lines"),
    ).drop("worded")
    per_line = F.greatest("n_lines", F.lit(1))
    return found.select(
        "*",
        (F.col("word_chars") / per_word).alias("mean_word"),
        (F.col("n_symbols") / per_word).alias("symbol_rate"),
        (F.col("n_dup_lines") / per_line).alias("dup_line_rate"),
        (F.col("n_repeat_words") / per_word).alias("repeat_rate"),
        (F.col("upper") / per_char).alias("upper_rate"),
        (F.col("digits") / per_char).alias("digit_rate"),
        (F.col("marks") / per_word).alias("mark_rate"),
        (F.col("n_words") / per_line).alias("line_words"),
        (F.col("short_lines") / per_line).alias("short_line_rate"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _thresholds(values: list[float]) -> list[float]:
    """Cuts between neighbouring distinct values near the quantiles."""
    ordered = sorted(values)
    found = set()
    for k in range(1, THRESHOLDS):
        at = k * len(ordered) // THRESHOLDS
        here = ordered[min(at, len(ordered) - 1)]
        above = next((v for v in ordered[at:] if v > here), None)
        if above is not None:
            found.add((here + above) / 2)
    return sorted(found)


def learn(rows: list[tuple], bad: list[bool]) -> list[tuple[Rule, bool]]:
    """(rule, keep) in order, from rows of FEATURES. Rows are bit sets here, so a test of a rule is an AND.

    Each step grows and prunes one rule for bad documents and one for good ones on the rows that no rule covers yet, and
    takes the one that is surer; what it covers is closed to the next step.
    """
    if not rows:
        return []
    conditions = []
    for k, name in enumerate(FEATURES):
        values = [float(r[k]) for r in rows]
        for cut in _thresholds(values):
            above = int("".join("1" if v > cut else "0" for v in reversed(values)), 2)
            conditions += [(Condition(name, True, cut), above), (Condition(name, False, cut), ~above)]
    every = (1 << len(rows)) - 1
    is_bad = int("".join("1" if b else "0" for b in reversed(bad)), 2)
    pruning = int("".join("1" if i % 3 == 2 else "0" for i in reversed(range(len(rows)))), 2)

    def precision(cover: int, positive: int) -> float:
        """With one row of each kind added, so that few rows are not sure."""
        return ((cover & positive).bit_count() + 1) / (cover.bit_count() + 2)

    def grown(open_rows: int, positive: int) -> list[tuple[Condition, int]]:
        """Against the open rows of the other kind, or against all of that kind where none is open."""
        cover, against, rule = open_rows & positive & ~pruning, open_rows & ~positive & ~pruning, []
        against = against or every & ~positive & ~pruning
        while len(rule) < MAX_CONDITIONS:
            p, n = cover.bit_count(), against.bit_count()
            if not p or not n:
                break
            base, best = math.log2(p / (p + n)), (0.0, None, 0)
            for condition, mask in conditions:
                p1 = (cover & mask).bit_count()
                if p1 >= MIN_COVER:
                    gain = p1 * (math.log2(p1 / (p1 + (against & mask).bit_count())) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, condition, mask)
            if best[1] is None:
                break
            rule.append(best[1:])
            cover, against = cover & best[2], against & best[2]
        return rule

    def candidate(open_rows: int, positive: int, least: float):
        """(sureness, cover, rule) of the best prefix of a grown rule, or None if it is not precise enough."""

        def covered(part):
            out = open_rows
            for _, mask in part:
                out &= mask
            return out

        rule = grown(open_rows, positive)
        if not rule:
            return None
        pruned = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (precision(covered(part) & pruning, positive), -len(part)))
        cover = covered(pruned)
        hits = (cover & positive).bit_count()
        held = cover & pruning
        found = min(hits / cover.bit_count(), (held & positive).bit_count() / held.bit_count()) if held else 0.0
        if hits < MIN_COVER or found < least:
            return None
        return found, cover, tuple(c for c, _ in pruned)

    open_rows, rules = every, []
    while len(rules) < MAX_RULES:
        found = [(candidate(open_rows, is_bad, MIN_PRECISION), False), (candidate(open_rows, every & ~is_bad, MIN_KEEP_PRECISION), True)]
        found = [(c, keep) for c, keep in found if c is not None]
        if not found:
            break
        (_, cover, rule), keep = max(found, key=lambda x: (x[0][0], not x[1]))  # of equals, the one that rejects
        rules.append((rule, keep))
        open_rows &= ~cover
    while rules and rules[-1][1]:  # what follows the last rejection keeps anyway
        rules.pop()
    return rules


def verdict(rules: list[tuple[Rule, bool]]) -> Column:
    """True for documents to keep: the first rule that holds decides, none means keep."""
    found = None
    for rule, keep in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds &= condition.column()
        found = F.when(holds, F.lit(keep)) if found is None else found.when(holds, F.lit(keep))
    return F.lit(True) if found is None else found.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, bool]]:
    """Rules learned from at most sample_rows labelled documents: those of smallest id hash, a document's labels averaged.

    Null ids or qualities teach nothing; without labels no rule comes out. labels has doc_id and quality.
    """
    marked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("marked_id"))
        .agg(F.avg("quality").alias("marked_quality"))
        .orderBy(F.xxhash64("marked_id"), "marked_id")
        .limit(sample_rows)
    )
    doc_id, text = named(docs, id_col, text_col)
    texts = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    chosen = texts.join(F.broadcast(marked), F.col("doc_id") == F.col("marked_id"), "left_semi")
    found = statistics(chosen).join(F.broadcast(marked), F.col("doc_id") == F.col("marked_id"))
    rows = sorted(tuple(r) for r in found.select(F.xxhash64("doc_id"), "marked_quality", *FEATURES).collect())
    return learn([r[2:] for r in rows], [r[1] < 0.5 for r in rows])


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """statistics with base_failed and kept, for every row; rules come from the labels.

    Repeated rows are judged each, a null id as any other, an empty table gives none; texts are read whole, and other columns
    don't matter, whatever their names.
    """
    rules = fit(docs, labels, id_col, text_col)
    found = statistics(docs, id_col, text_col, carry).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & verdict(rules))
