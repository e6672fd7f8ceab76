"""The pipeline as a whole against a plain version of it, on near copies, repeated lines, junk, nulls, ties and short texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_simhash import NAMES, brute_kept, with_words
from test_text_operators import TOKENIZER, brute_targets

from wickflow.llm import line_dedup, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(rows):
    """Lines that an earlier one equals go, and those of 20 characters or more that an earlier one is within an edit of."""
    seen, out = [], []
    for i, text in rows:
        kept, lost = [], False
        for line in (text or "").split("\n") if text is not None else []:
            long = len(line) >= 20
            gone = any(line == x or (long and len(x) >= 20 and line_dedup.within_one_edit(line, x)) for x in seen) and (long or line.split())
            if long or line.split():
                seen.append(line)
            lost |= bool(gone)
            if not gone:
                kept.append(line)
        if text is None or not lost or "\n".join(kept).split():
            out.append((i, None if text is None else "\n".join(kept)))
    return out


def brute_mix(rows, source):
    """(id, text) as often as the mix takes them, the last one cut."""
    sizes = defaultdict(int)
    for i, text in rows:
        sizes[source[i]] += len((text or "").split())
    found = []
    for s, target in brute_targets(sizes).items():
        mine = sorted((hashlib.md5(f"mix-17:{i}".encode()).hexdigest(), i, t or "") for i, t in rows if source[i] == s)
        left = int(target + 0.5)
        while left > 0 and sizes[s]:
            for _, i, t in mine:
                taken = min(len(t.split()), left)
                if taken:
                    found.append((i, t.split()[:taken]))
                    left -= taken
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    lines = [" ".join(rng.choice(NAMES) for _ in range(rng.randint(9, 16))) for _ in range(400)]
    texts = ["\n".join(rng.sample(lines[: 300 + i % 100], 4)) for i in range(60)]
    texts += [with_words(rng, " ".join(rng.choice(NAMES) for _ in range(90)), 1) for _ in range(20)]
    texts += [with_words(rng, texts[60 + i], 1) for i in range(12)] + [texts[3], texts[61], texts[62]]
    texts += ["Read more\n" + texts[5] + "\nRead more", None, "", "one two three", "\n\n"]
    junk = [" ".join(w + "%%%" for w in t.split()) for t in texts[:40]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(junk)]
    return rows, {i: None if i % 11 == 0 else f"src{i % 3}" for i, _ in rows}


def test_run_against_a_plain_version(spark, corpus, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, source = corpus
    table = [(i, t, "en", source[i], 0) for i, t in rows]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = {r["doc_id"] for r in quality_rules.judge(spark.createDataFrame(table, SCHEMA), labels).where("kept").collect()}
    assert set(range(60)) <= good and not good & set(range(200, 240))  # the learned part; all that follows is plain

    kept = brute_lines([(i, t) for i, t in rows if i in good])
    single = brute_kept(kept)
    assert len(rows) > len(good) > len(kept) > len(single)
    mixed = brute_mix([(i, t) for i, t in kept if i in single], source)
    model = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, len(model.encode(" ".join(ws), add_special_tokens=False).ids) + 1) for i, ws in mixed)

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0)
    assert got == want
    places = defaultdict(list)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_stages_of_nothing_and_of_clashing_columns(spark, tmp_path):
    """Each stage but the last returns the columns that it is given, whatever their names, and nothing of nothing."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = SCHEMA + ", size long, kept boolean, lines string, row string, `a.b` int"
    text = " ".join(NAMES[:40])
    rows = [(1, text, "en", None, 0, 1, True, "l", "r", 2), (1, text, "en", None, 0, 1, True, "l", "r", 2), (None, text + " more", "en", "s", 0, 1, True, "l", "r", 2)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, str(tmp_path))
            assert found.columns == docs.columns
            assert found.isEmpty() == (not data)
        assert stage_pieces(spark, docs, str(tmp_path)) == bool(data)


def stage_pieces(spark, docs, folder):
    import corpus_pipeline

    return corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
