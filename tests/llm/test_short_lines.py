"""Line dedup of lines below the length of the one-edit join, as the query and the pipeline use it."""

import random

from wickflow.llm import catalog, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_equal_short_lines_go_once_seen(spark):
    line = "this line is long enough to count"
    rows = [
        (1, f"Read more\nRead more\n\n{line}"),
        (2, f"Log in\nRead more\nRead mores\n\t\n{line}s"),
        (3, "\n\nLog in"),
        (4, None),
        (4, "Log in\n"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], SCHEMA)
    got = sorted((r["row"]["doc_id"], r["text"] or "", r["kept_lines"]) for r in line_dedup.dedup_lines(docs, short_too=True).collect())
    assert got == [(1, f"Read more\n\n{line}", 3), (2, "Log in\nRead mores\n\t", 3), (3, "\n", 2), (4, "", 0), (4, "", 1)]


def test_the_query_takes_short_lines(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["ok", "Log in", "Read more", "x y z"]) for _ in range(5))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op3_line_dedup(spark, str(tmp_path)).collect()
    assert sum(r["n_kept"] for r in got) == len({line for _, t in rows for line in t.split("\n")})


def test_pipeline_loses_no_distinct_line(spark):
    import corpus_pipeline

    rng = random.Random(2)
    names = [f"{a}{b}" for a in "river stone light under walk quick field".split() for b in "s ly ing er ed ness".split()]
    lines = [" ".join(rng.choice(names) for _ in range(5)) for _ in range(40)] + ["Read more", "Log in"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(3))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], SCHEMA)
    kept = [line for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect() for line in r["text"].split("\n")]
    assert sorted(kept) == sorted({line for _, t in rows for line in t.split("\n")})
