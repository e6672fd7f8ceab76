"""Repeated rows, null ids and clashing columns in operators that the other tests hold against brute force."""

from collections import Counter

from test_text_operators import made

from wickflow.llm import ann, chat_template, mixing, quality_rules


def test_mixing_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c")] * 3 + [(None, "d e")] * 2 + [(None, None)]
    got = mixing.mix(made(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == {(1, 3): 3, (None, 2): 2, (None, 0): 1}
    assert {r["target"] for r in got} == {19.5} and sum(r["taken"] for r in got) == 20
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_quality_of_repeated_rows_and_null_ids(spark):
    text = "some words of an ordinary length that make a line of text here"
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "doc_id long, quality int")
    got = quality_rules.judge(made(spark, [(1, text), (1, text), (None, text)]), labels, carry=True).collect()
    assert len(got) == 3 and len({(r["n_words"], r["kept"]) for r in got}) == 1
    assert {r["row"]["component_id"] for r in got} == {"x"}


def test_chat_of_null_ids_repeats_and_nothing(spark):
    schema = "conv_id long, turn int, role string, text string, spans string"
    turns = [(None, 0, "user", "hi", "s"), (None, 1, "assistant", None, "s"), (1, 0, "user", "a", "s"), (1, 0, "user", "a", "s"), (1, None, None, "b", "s")]
    got = {r["conv_id"]: r for r in chat_template.digests(chat_template.format_turns(spark.createDataFrame(turns, schema))).collect()}
    assert {i: r["n_turns"] for i, r in got.items()} == {None: 2, 1: 3} and got[None]["loss_chars"] == 0
    assert chat_template.digests(chat_template.format_turns(spark.createDataFrame([], schema))).count() == 0


def test_neighbours_of_many_equal_queries(spark):
    """A third of all rows has one vector: each of them finds the smallest ids of the others."""
    vectors = [(i, [float(i % 7), 1.0, float(i % 5)], "x") for i in range(100)] + [(1000 + 50 * i, [9.0, 9.0, 9.5], "x") for i in range(50)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank string")
    found = ann.nearest(rows, "vec_id % 50 = 0").collect()
    same = sorted(i for i, _, _ in vectors if i >= 1000)
    for query in same:
        near = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert near == [i for i in same if i != query][:5]
