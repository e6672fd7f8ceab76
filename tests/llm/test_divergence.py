"""Divergence of sources against plain Python over all terms and pairs, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from wickflow.llm import catalog, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, ranks=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = {}
        for s in [*sources, None]:
            c = {t: counts[lang, s][t] if s is not None else sum(counts[lang, x][t] for x in sources) for t in kept}
            share[s] = {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        def far(p, q):
            return (p - q) ** 2 // q

        for s in sources:
            pairs = [(x, sum(far(share[s][t], share[x][t]) for t in kept)) for x in sources if x != s]
            own = [(t, far(share[s][t], share[None][t])) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", own, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def rows_of(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["É", "é", "ÉTÉ", "日本", "ZoO", "zoo"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["a", "b", "é", "Z", None])
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 8, 40]), weights=range(1, len(vocabulary) + 1))
        rows.append((lang, source, rng.choice([" ", "-", "\x7f", "_9"]).join(words) if lang != "xx" else rng.choice([None, f"only{len(rows)}", ""])))
    return [*rows, ("en", "bare", None), ("en", "bare", "1234 _"), ("one", "alone", "word " * 5000), *[("en", "copies", "same WORDS same")] * 5]


def frame(spark, rows):
    cells = [(i, t, lang, source, 1, "x") for i, (lang, source, t) in enumerate(rows)]
    return spark.createDataFrame(cells, "doc_id long, text string, lang string, source string, value long, `peer` string").repartition(3)


def shown(found):
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("least", "ranks"), [(3, 200), (1, 4)])
def test_against_plain_python(spark, least, ranks):
    rows = rows_of(least)
    assert shown(divergence.audit(frame(spark, rows), least, ranks)) == brute(rows, least, ranks)


def test_query_against_sql(spark, tmp_path):
    frame(spark, rows_of(5)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.op12_source_divergence(spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()["op12_source_divergence"])
    assert [c[0] for c in want.description] == got.columns
    assert shown(got) == sorted(want.fetchall())


def test_empty_table(spark):
    assert shown(divergence.audit(frame(spark, rows_of(1)).limit(0))) == []


@pytest.mark.parametrize(("postings", "cells"), [(4, 1 << 22), (4, 0), (1 << 20, 0), (7, 9)])
def test_scatter_in_small_blocks(monkeypatch, postings, cells):
    """Blocks and accumulators of any size give the same sums over common terms."""
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(divergence, "KEPT_CELLS", cells)
    rng, rows, want = random.Random(3), [], Counter()
    zero = {"a": [3, 5, 2, 9], "b": [4, 4]}
    for _ in range(80):
        lang = rng.choice(["a", "b"])
        own = rng.sample(range(len(zero[lang])), rng.randint(1, len(zero[lang])))
        rows.append({"lang": lang, "postings": [{"peer": k, "p": rng.randint(1, 10**9), "z": zero[lang][k]} for k in own], "peers": len(zero[lang])})
        for x in rows[-1]["postings"]:
            for y in rows[-1]["postings"]:
                f = divergence.divergence
                want[lang, x["peer"], y["peer"]] += f(x["p"], y["p"]) - f(x["p"], y["z"]) - f(x["z"], y["p"]) + f(x["z"], y["z"])
    kind = pa.schema([("lang", pa.string()), ("postings", pa.list_(pa.struct([("peer", pa.int32()), ("p", pa.int64()), ("z", pa.int64())]))), ("peers", pa.int64())])
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 3], kind) for k in range(0, len(rows), 3)]
    got = Counter()
    for batch in divergence._scatter(batches):
        for r in batch.to_pylist():
            got[r["lang"], r["peer"], r["other"]] += r["value"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_tasks_hand_on_a_term_once(spark):
    """A row for a language's term, whatever the number of its sources; the postings have the counts."""
    rows = rows_of(2)
    found = divergence.term_counts(frame(spark, rows).coalesce(1)).collect()
    assert len(found) == len({(r["lang"], r["term"]) for r in found})
    want, once = Counter(), Counter()
    for lang, source, text in rows:
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        want.update((lang or "", source or "", t) for t in terms)
        once.update((lang or "", t) for t in set(terms))
    assert {(r["lang"], r["term"]): r["docs"] for r in found} == once
    assert {(r["lang"], x["source"], r["term"]): x["n"] for r in found for x in r["postings"]} == want
    assert all(r["total"] == sum(x["n"] for x in r["postings"]) for r in found)


def test_folding_at_any_time_gives_the_same_counts():
    texts = [("a", [b"x", b"y", b"x"]), ("b", []), ("b", [b"y", b"z"])] * 15
    whole, often = divergence._Counted(), divergence._Counted()
    for source, terms in texts:
        whole.add(source, terms)
        often.add(source, terms)
        often.fold()
    want = [r for b in whole.rows("en") for r in b.to_pylist()]
    assert want == [r for b in often.rows("en") for r in b.to_pylist()]
    assert {r["term"]: (r["docs"], r["total"]) for r in want} == {"x": (15, 30), "y": (30, 30), "z": (15, 15)}
    assert list(divergence._Counted().rows("en")) == []


def test_merging_rows_that_share_a_hash():
    kind = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("total", pa.int64()), ("postings", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
    cells = [("a", "x", 1, {"s": 2}), ("b", "x", 2, {"s": 1}), ("a", "y", 1, {"s": 4}), ("a", "x", 2, {"t": 5, "s": 1})]
    rows = [{"key": 7, "lang": lang, "term": t, "docs": d, "total": sum(p.values()), "postings": [{"source": s, "n": n} for s, n in p.items()]} for lang, t, d, p in cells]
    for least, want in ((0, {("a", "x"): {"s": 3, "t": 5}, ("b", "x"): {"s": 1}, ("a", "y"): {"s": 4}}), (3, {("a", "x"): {"s": 3, "t": 5}}), (4, {})):
        got = divergence._merged(pa.Table.from_pylist(rows, kind), least).to_pylist()
        assert {(r["lang"], r["term"]): {x["source"]: x["n"] for x in r["postings"]} for r in got} == want and len(got) == len(want)
        assert all(r["total"] == sum(x["n"] for x in r["postings"]) for r in got)
