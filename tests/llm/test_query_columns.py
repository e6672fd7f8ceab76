"""The registered queries on one small folder: their columns against DuckDB's SQL, or against plain Python where SQL can't say it."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_simhash import NAMES
from test_text_operators import TOKENIZER, brute_ppm, brute_statistics

from wickflow.llm import catalog

NOTICES = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(90):
        lines = [" ".join(rng.choice(NAMES) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 5))]
        if i % 5 == 0:
            lines.append(rng.choice(NOTICES))
        if i % 7 == 0:
            lines += [lines[0], "x ## | 9", "a b c d e f a b c d e"]
        rows.append((i, "\n".join(lines), "en", None if i % 13 == 0 else f"src{i % 4}", 0))
    rows += [(200, None, "en", "src0", None), (201, "", "en", "src1", 0), (202, " \t\n", "en", "src9", 0), (203, "É" * 4000, "en", "src1", 0), (204, rows[3][1], "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(400)] + [(500, None, 0), (550, [0.0] * 8, 0), (600, [math.nan] * 8, 1)]
    vectors += [(700 + i, vectors[50][1], 0) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    turns = [(c, t, ("system", "user", "assistant", "tool")[(c + t) % 4], rng.choice(["hi", "[INST] \\ </s>", "", None, "é\nü"])) for c in range(20) for t in range(1 + c % 5)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def asked(folder, sql):
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con.sql(sql)


def shown(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, folder, name):
    """The SQL as it is: the same names and kinds of columns, then the same rows."""
    rows, want = catalog.queries()[name](spark, folder), asked(folder, catalog.oracle_sql()[name])
    assert sorted(rows.columns) == sorted(want.columns)
    whole, kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}, dict(zip(want.columns, map(str, want.types)))
    assert {c: whole[t] for c, t in rows.dtypes} == kinds
    cells = [tuple(r[want.columns.index(c)] for c in rows.columns) for r in want.fetchall()]
    assert sorted(map(repr, map(shown, rows.collect()))) == sorted(map(repr, map(shown, cells)))


def texts_of(folder):
    return dict(asked(folder, "SELECT doc_id, text FROM documents").fetchall())


def test_quality_columns(spark, folder):
    got = {r["doc_id"]: r for r in catalog.op6_quality_rules(spark, folder).collect()}
    texts = texts_of(folder)
    assert set(got) == set(texts)
    for i, text in texts.items():
        r, want = got[i], brute_statistics(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_score_columns(spark, folder):
    got = {r["doc_id"]: r for r in catalog.op7_ppm(spark, folder).collect()}
    texts = texts_of(folder)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts, train = Counter(), [(t or "").encode() for i, t in texts.items() if not held[i]]
    for t in train:
        counts.update([*t.lower().split(), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, text in texts.items():
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(base)
    for i in [i for i in texts if held[i]][:3] + [5, 200, 201]:
        assert got[i]["score"] == pytest.approx(brute_ppm(train, (texts[i] or "").encode(), 5))


def test_neighbour_columns(spark, folder):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    found = defaultdict(list)
    for r in catalog.op8_ann(spark, folder).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    queries = {i for i, _ in rows if i % 50 == 0}
    assert set(found) == queries
    hits = 0
    for i, v in rows:
        if i in queries:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in rows if j != i)
            got = sorted(found[i])
            assert [k for k, _, _ in got] == [1, 2, 3, 4, 5] and got == sorted(got, key=lambda x: (-round(x[2], 12), x[1]))
            hits += len({j for _, j, _ in got} & {j for _, j in near[:5]})
    assert hits >= 0.9 * 5 * len(queries)


def test_packing_columns(spark, folder):
    from tokenizers import Tokenizer

    model, texts = Tokenizer.from_file(TOKENIZER), texts_of(folder)
    pieces = defaultdict(list)
    for r in catalog.op9_packing(spark, folder).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
