"""Best-fit packing: the bitset against a plain search, and whole pieces out of the operator."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import TOKENIZER

from wickflow.llm import bin_packing, catalog
from wickflow.llm.bin_packing import OpenBins, pieces_of


def plain(sizes, capacity, limit):
    """(space before, space after, closed spaces) of each item, by looking at each open bin."""
    open_bins, out = [], []
    for n in sizes:
        closed = []
        fit = [s for s in open_bins if s >= n]
        if fit:
            space = min(fit)
            open_bins.remove(space)
        else:
            if len(open_bins) == limit:
                closed.append(min(open_bins))
                open_bins.remove(closed[0])
            space = capacity
        if space > n:
            open_bins.append(space - n)
        else:
            closed.append(0)
        out.append((space, space - n, closed))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 6))
def test_bitset_places_like_a_plain_search(sizes, limit):
    bins, left = OpenBins(40, limit), {}
    for n, (before, after, closed) in zip(sizes, plain(sizes, 40, limit)):
        number, offset, ended = bins.place(n)
        assert left.get(number, 40) == before and offset == 40 - before
        left[number] = after
        assert [left[c] for c in ended] == closed
        for c in ended:
            left.pop(c)
        assert len(left) == bins.open <= limit


def test_pieces():
    assert list(pieces_of(4096, 4096)) == [(0, 0, 4096)]
    assert list(pieces_of(10, 4)) == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]


def documents(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["alpha", "beta!", "gamma,", "Étude", "x"]) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(120)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, " \n"), (None, "without id"), (503, "word " * 9000), (7, texts[7]), (504, "é" * 5000)]
    return rows, spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, sequence_id string, `start` int, `a.b` int").repartition(3)


def held_against_texts(rows, found, capacity):
    """Each piece has the ids of its place; sequences are gapless and within the capacity. Returns the sequences' lengths."""
    from tokenizers import Tokenizer

    model, places, want, got = Tokenizer.from_file(TOKENIZER), defaultdict(list), [], []
    for i, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((str(i), piece, start, len(part), zlib.crc32(part.tobytes())))
    for r in found:
        got.append((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(got) == sorted(want)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in spots) for spots in places.values()]


@pytest.mark.parametrize(("capacity", "limit"), [(4096, 256), (512, 2), (16, 3)])
def test_whole_pieces(spark, capacity, limit):
    rows, docs = documents(spark)
    found = bin_packing.pack_whole(docs, TOKENIZER, capacity, limit)
    found = found.selectExpr("*", "crc32(ids) ids_crc32").collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in found)
    held_against_texts(rows, found, capacity)


def test_query_and_empty_table(spark, tmp_path):
    rows, docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lengths = held_against_texts(rows, catalog.op11_best_fit(spark, str(tmp_path)).collect(), 4096)
    # any two sequences that one task leaves open hold more than one sequence together
    assert len(lengths) <= 2 * sum(lengths) / 4096 + 4
    assert bin_packing.pack_whole(docs.limit(0), TOKENIZER).count() == 0
