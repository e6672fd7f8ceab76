"""Each operator gives the same rows when its table has further columns with the names that operators use themselves."""

import random

import pytest
from test_simhash import NAMES
from test_text_operators import TOKENIZER

from wickflow.llm import ann, bin_packing, chat_template, divergence, hard_negatives, license_scan, line_dedup, mixing, packing, ppm, quality_rules, sharding, simhash

#: Names of columns that operators make.
OWN = [
    "row", "text_key", "size", "key", "at", "n", "fp", "node", "root", "component_id", "marked_id", "marked_quality", "row_hash", "lines", "kept", "first",
    "source_size", "target", "taken", "ids", "start", "length", "offset", "docs", "term", "peer", "value", "postings", "h1", "h2", "v", "label_", "block", "slab",
    "query_id", "anchor_id", "rank", "score", "a.b", "doc_id ", "bucket", "band", "unit", "words", "position", "turn_", "span", "spans", "order",
]


def widened(df):
    """The table with these columns, some before and some behind its own, of types that none of the operators expects."""
    have = {c.lower() for c in df.columns}
    more = [f"array(struct('x' as x)) as `{c}`" for c in OWN if c.lower() not in have]
    return df.selectExpr(*more[::2], "*", *more[1::2])


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(NAMES) for _ in range(rng.choice([3, 30, 90]))), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(50)]
    rows += [(60 + i, rows[i][1] + " Released under the MIT License.", "en", "a") for i in range(8)] + [(70, None, None, None), (71, "", "en", "b"), (None, "x y", "en", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)], "doc_id long, quality int")


def rows_of(df, columns):
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


OPERATORS = {
    "simhash": (lambda d, _: simhash.near_duplicates(d), ["doc_id", "fp", "component_id"]),
    "keep_one": (lambda d, _: simhash.keep_one(d), ["doc_id", "text"]),
    "sharding": (lambda d, _: sharding.shard(d), ["doc_id", "size", "text_crc32", "shard", "slot"]),
    "line_dedup": (lambda d, _: line_dedup.dedup_lines(d), ["text", "lines", "kept_lines"]),
    "license_scan": (lambda d, _: license_scan.scan(d), ["doc_id", "license", "unit", "place", "dice"]),
    "mixing": (lambda d, _: mixing.mix(d), ["doc_id", "size", "source_size", "target", "taken"]),
    "quality_rules": (quality_rules.judge, ["doc_id", "n_words", "n_repeat_words", "base_failed", "kept"]),
    "ppm": (lambda d, _: ppm.score_documents(d), ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]),
    "packing": (lambda d, _: packing.pack_documents(d, TOKENIZER), ["doc_id", "start", "length", "offset"]),
    "bin_packing": (lambda d, _: bin_packing.pack_whole(d, TOKENIZER), ["doc_id", "piece", "start", "length", "offset"]),
    "divergence": (lambda d, _: divergence.audit(d), ["lang", "source", "part", "item", "value", "rank"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(documents, labels, name):
    run, columns = OPERATORS[name]
    want = rows_of(run(documents, labels), columns)
    assert rows_of(run(widened(documents), widened(labels)), columns) == want and want


def test_vectors(spark):
    rng = random.Random(32)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(200)], "vec_id long, embedding array<double>, label int")
    for run, columns in (
        (lambda v: ann.nearest(v, "vec_id % 50 = 0"), ["query_id", "rank", "vec_id", "score"]),
        (lambda v: hard_negatives.mine(v, "vec_id % 50 = 0"), ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]),
    ):
        want = rows_of(run(df), columns)
        assert rows_of(run(widened(df)), columns) == want and want


def test_conversations(spark):
    df = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"said {t}") for c in range(9) for t in range(4)], "conv_id long, turn int, role string, text string")
    want = rows_of(chat_template.digests(chat_template.format_turns(df)), ["conv_id", "n_turns", "turns_sha256", "loss_sha256"])
    assert rows_of(chat_template.digests(chat_template.format_turns(widened(df))), ["conv_id", "n_turns", "turns_sha256", "loss_sha256"]) == want
