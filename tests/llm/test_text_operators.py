"""SimHash, sharding, line dedup, licences, mixing, rules, PPM and packing on small made documents, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from wickflow.llm import license_scan, line_dedup, mixing, packing, ppm, quality_rules, sharding, simhash
from wickflow.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string, `a.b` int"


def made(spark, texts, sources=None):
    """Documents with extra columns whose names clash with results; None keys stay None."""
    rows = [
        (i, t, "en", (sources or {}).get(i, "src0"), None if t is None else len(t), 7, "x", 1)
        for i, t in (texts.items() if isinstance(texts, dict) else texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta the of and rivers stones Walking quickly under trees over hills".split()) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    found = {i: "\n".join(sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))) for i in range(60)}
    for i in range(60, 80):
        found[i] = found[i % 7] + (" tail" if i % 2 else "")
    found |= {80: "", 81: None, 82: "   \n ", 83: "one", 84: "one two", 85: "x" * 30000, 86: "É " * 50}
    return found


def words(text):
    return (text or "").encode().split()


# --- op1


def brute_fingerprint(text):
    ws = [w.lower() for w in words(text)]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, texts):
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(made(spark, texts)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    comps = brute_components(prints)
    assert got == {i: (prints[i], comps[i]) for i in texts}


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299), (299, 300), (-5, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {-5: -5, 299: -5, 300: -5}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_null_ids_and_repeats(spark):
    rows = [(None, "a b c d"), (None, "q r s t"), (4, "a b c d"), (4, "a b c d"), (9, None), (8, "")]
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(made(spark, rows)).collect())
    assert got == Counter({(None, 4): 1, (None, None): 1, (4, 4): 2, (9, 8): 1, (8, 8): 1})
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(made(spark, rows)).collect())
    assert kept == Counter({(4, "a b c d"): 1, (None, "q r s t"): 1, (8, ""): 1})


# --- op2


def test_differencing_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    put = sharding.differencing(sizes, 8)
    sums = [sum(s for s, p in zip(sizes, put) if p == k) for k in range(8)]
    assert max(sums) - min(sums) <= 1
    assert sharding.differencing([], 8) == [] and len(set(sharding.differencing([9, 9, 9], 3))) == 3
    big = sharding.differencing([1000] + [1] * 70, 8)
    rest = Counter(p for p in big[1:])
    assert big[0] not in rest and set(rest.values()) == {10}


def test_shards_of_nothing_repeats_and_the_query(spark, texts, tmp_path):
    """The query's columns against hashlib-like values of Python, and laws: bytes near equal, slots gapless, copies together."""
    from wickflow.llm import catalog

    assert sharding.shard(made(spark, []), 8).count() == 0
    rows = [*texts.items(), *[(300 + i, f"text {i} " * (i % 9)) for i in range(300)], (300, "text 0 "), (None, "same"), (None, "same"), (900, None)]
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op2_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    slots, sums, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for i, t in rows:
        groups[t or f"none {i}"] += len((t or "").encode()) + 1
    rest = sorted(sums.values())
    largest = max(groups.values())
    if largest > sum(groups.values()) / 8:  # a group above a share fills its shard, the others share the rest
        rest = rest[:-1]
    assert rest[-1] - rest[0] <= max(sorted(groups.values())[:-1])
    assert all(len(s) == 1 for (size, _), s in where.items() if size > 1)


def test_shards(spark, texts):
    rows = list(texts.items()) + [(0, texts[0]), (None, "no id")]
    got = sharding.shard(made(spark, rows), 8).collect()
    assert len(got) == len(rows)
    by, where = Counter(), defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for k, s in where.items() if k[0] > 1)
    sizes = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter((r["size"], r["text_crc32"]) for r in got) == sizes
    others = sorted(by.values())[:-1]  # the text of 30,000 letters makes one shard the largest
    assert max(others) - min(others) <= 200


# --- op3


def brute_lines(rows, least):
    """Order of rows: id (null last), then hash order is the operator's own; ids here are unique."""
    seen, out = [], {}
    for i, t in sorted(rows.items()):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            if len(line) < least:
                kept.append(line)
                continue
            if not any(line_dedup.within_one_edit(line, o) for o in seen):
                kept.append(line)
            seen.append(line)
        out[i] = "\n".join(kept)
    return out


def edited(rng, line):
    at = rng.randrange(len(line) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return line[:at] + rng.choice("xyz ") + line[at:]
    if kind == 1 and at < len(line):
        return line[:at] + line[at + 1 :]
    return line[: max(at - 1, 0)] + rng.choice("qwé") + line[max(at, 1) :]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    lines = [sentence(rng, n) for n in (4, 5, 6, 8, 12, 30, 60) for _ in range(4)]
    rows = {}
    for i in range(40):
        picked = [rng.choice(lines) for _ in range(3)]
        rows[i] = "\n".join([edited(rng, x) if rng.random() < 0.5 else x for x in picked] + ["short", sentence(rng, 9)])
    rows |= {40: None, 41: "", 42: "\n\n", 43: "é" * 3000, 44: "é" * 2999}
    got = {r["row"]["doc_id"]: r["text"] for r in line_dedup.dedup_lines(made(spark, rows), short_too=False).collect()}
    assert got == brute_lines(rows, line_dedup.MIN_CHARS)


def test_line_dedup_query_against_sql(spark, tmp_path):
    import duckdb

    from wickflow.llm import catalog

    rng = random.Random(12)
    lines = [sentence(rng, n) for n in (1, 2, 4, 5, 6, 8, 12) for _ in range(4)] + ["Read more", "\t", ""]
    rows = [(i, "\n".join(edited(rng, x) if rng.random() < 0.3 and len(x) > 2 else x for x in rng.choices(lines, k=5))) for i in range(50)]
    made(spark, rows + [(60, None), (61, ""), (62, "\n\n")]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["op3_line_dedup"]).fetchall()
    assert sorted(map(tuple, catalog.op3_line_dedup(spark, str(tmp_path)).collect())) == sorted(want)
    assert line_dedup.dedup_lines(made(spark, [])).count() == 0


@pytest.mark.parametrize("n", [20, 21, 31, 32, 33, 63, 64, 127, 128, 300])
def test_windows_and_variants_meet(n):
    rng = random.Random(n)
    for _ in range(30):
        a = "".join(rng.choice("abcdefgh ") for _ in range(n))
        b = edited(rng, a)
        if a == b:
            continue
        assert line_dedup.within_one_edit(a, b)
        pa, pb = line_dedup.Prefixes(a), line_dedup.Prefixes(b)
        wa, wb = line_dedup.windows(pa), line_dedup.windows(pb)
        shared = set(wa) & set(wb)
        assert shared
        (sa, da), (sb, db) = (line_dedup.variants(p, [w[k] for k in shared]) for p, w in ((pa, wa), (pb, wb)))
        if len(a) == len(b):
            assert set(sa) & set(sb)
        else:
            assert line_dedup.whole_key(pa) in set(db) or line_dedup.whole_key(pb) in set(da)


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    line = "this line is long enough to count"
    rows = [(None, line), (3, line), (3, line), (5, f"{line}\nand another line that is new"), (None, None)]
    got = Counter((r["row"]["doc_id"], r["text"]) for r in line_dedup.dedup_lines(made(spark, rows)).collect())
    assert got == Counter({(None, ""): 1, (3, line): 1, (3, ""): 1, (5, "and another line that is new"): 1, (None, None): 1})


# --- op4


def wrapped(text, width=60, mark=""):
    lines, at = [], ""
    for w in text.split():
        if len(at) + len(w) > width:
            lines.append(mark + at.strip())
            at = ""
        at += " " + w
    return "\n".join([*lines, mark + at.strip()])


@pytest.fixture(scope="module")
def licensed():
    rng, t = random.Random(2), license_scan.TEMPLATES
    filler = sentence(rng, 400)
    copyright = "MIT License\n\nCopyright (c) 2020 Some One\n\n"
    return [
        (1, "words before\nReleased under the MIT License.\nwords after"),
        (2, filler + "\n" + t["CC-BY-SA-4.0"].upper() + "\n" + t["CC-BY-NC-4.0"]),
        (3, None),
        (4, ""),
        (5, "license"),
        (6, copyright + wrapped(t["MIT-text"])),
        (7, filler + "\n" + wrapped(t["GPL-3.0-notice"], 50, "# ") + "\n" + filler),
        (8, filler + " and this is " + t["Apache-2.0"] + " " + filler),
        (9, wrapped(t["BSD-conditions"]) + "\n\n" + wrapped(t["BSD-disclaimer"], mark=" * ")),
        (10, "x released under the mit license y"),
        (11, filler + "\n" + "\n".join(["Released under the MIT License."] * 3000)),
        (12, filler),
        (None, "Licensed under CC BY-NC 4.0."),
    ]


def test_licences(spark, licensed):
    """Notices of a line, wrapped and embedded texts, whole licence files; nothing in other texts."""
    found = defaultdict(set)
    for r in license_scan.scan(made(spark, licensed + [(1, licensed[0][1])])).collect():
        found[r["doc_id"]].add((r["license"], r["unit"], r["place"]))
    assert found[1] == {("MIT", "line", 1)}
    assert found[2] == {("CC-BY-SA-4.0", "line", 1), ("CC-BY-4.0", "line", 1), ("CC-BY-NC-4.0", "line", 2)}
    assert found[None] == {("CC-BY-NC-4.0", "text", 0)} and found[11] == {("MIT", "line", 1)} and found[10] == {("MIT", "run", 1)}
    assert "MIT-text" in {x[0] for x in found[6]} and "GPL-3.0-notice" in {x[0] for x in found[7]}
    assert "Apache-2.0" in {x[0] for x in found[8]} and {"BSD-conditions", "BSD-disclaimer"} <= {x[0] for x in found[9]}
    assert not {3, 4, 5, 12} & set(found)
    assert license_scan.scan(made(spark, licensed), {}).count() == 0 and license_scan.scan(made(spark, [])).count() == 0


def test_licences_against_sql(spark, licensed):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r for r in licensed if r[0] is not None], columns=["doc_id", "text"]))
    want = sorted((r[0], r[1], r[2], r[3], round(r[4], 9)) for r in con.execute(license_scan.oracle_sql()).fetchall())
    got = license_scan.scan(made(spark, [r for r in licensed if r[0] is not None])).collect()
    assert sorted((r["doc_id"], r["license"], r["unit"], r["place"], round(r["dice"], 9)) for r in got) == want


def test_a_unit_exactly_at_the_threshold_matches(spark):
    """Three of four bigrams on both sides: 2 * 3 / (4 + 4)."""
    notice = {"four": "alpha beta gamma delta epsilon"}
    rows = [(1, "alpha beta gamma delta eta zeta"), (2, "alpha beta gamma delta x alpha beta"), (3, "x alpha beta gamma delta epsilon y")]
    got = {r["doc_id"]: (r["unit"], r["dice"]) for r in license_scan.scan(made(spark, rows), notice, threshold=0.75).collect()}
    assert got == {1: ("run", 0.75), 2: ("run", 0.75), 3: ("run", 1.0)}


def test_size_bounds_are_exact():
    from fractions import Fraction

    for threshold in (0.7, 0.8, 0.9):
        t = Fraction(str(threshold))
        for n in range(1, 201):
            low, high = license_scan.size_bounds(n, threshold)
            for m in range(1, 400):
                assert (Fraction(2 * min(n, m), n + m) >= t) == (low <= m <= high)
                assert (2.0 * min(n, m) / (n + m) >= threshold) == (low <= m <= high)


# --- op5


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, open_ = 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s]
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark, texts):
    sources = {i: None if i % 9 == 0 else f"src{i % 4}" for i in texts}
    df = made(spark, texts, sources)
    got = mixing.mix(df).collect()
    sizes = Counter()
    for i, t in texts.items():
        sizes[sources[i]] += len(words(t))
    target, taken = brute_targets(sizes), Counter()
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()))
    mixture = mixing.mixture(df)
    assert mixture.columns == df.columns
    assert sum(len(words(r["text"])) for r in mixture.collect()) == sum(taken.values())


def test_mixing_nothing(spark):
    assert mixing.mix(made(spark, [])).count() == 0
    got = mixing.mix(made(spark, [(1, None), (None, " ")])).collect()
    assert [r["taken"] for r in got] == [0, 0] and mixing.mixture(made(spark, [(1, None)])).count() == 0


# --- op6


def brute_statistics(text):
    text = text or ""
    ws = [w.decode() for w in words(text)]
    grams = defaultdict(list)
    for k in range(len(ws) - 4):
        grams[tuple(ws[k : k + 5])].append(k)
    covered = {p + j for at in grams.values() if len(at) > 1 for p in at for j in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark, texts):
    rows = dict(texts) | {90: "a b c d e a b c d e f", 91: "a a a a a a", 92: "x\nx\n \nx", 93: "#*$ %&|<> é", 94: "a b c d e", 95: "a b c d e\n" * 4000}
    found = quality_rules.statistics(made(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {i: brute_statistics(t) for i, t in rows.items()}


def test_rules_are_learned_and_keep_good_ones(spark):
    rng = random.Random(2)
    rows = {}
    for i in range(300):
        text = sentence(rng, rng.randint(20, 60))
        rows[i] = " ".join(w + "###" for w in text.split()) if i % 4 == 0 else text
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(made(spark, rows), labels)
    assert rules
    found = quality_rules.judge(made(spark, rows), labels).collect()
    held = [r for r in found if r["doc_id"] % 2 == 1 or not r["base_failed"]]
    wrong = [r["doc_id"] for r in held if not r["base_failed"] and r["kept"] != (r["doc_id"] % 4 != 0)]
    assert not wrong
    none = quality_rules.judge(made(spark, rows), labels.where("false"))
    assert none.where("kept = base_failed").count() == 0
    assert quality_rules.judge(made(spark, []), labels).count() == 0


# --- op7


def test_unigram_base_and_known_words(spark, texts):
    got = {r["doc_id"]: r for r in ppm.score_documents(made(spark, texts), order=3, frequent=5).collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter()
    for i, t in texts.items():
        if i not in held:
            counts.update(w.lower() for w in words(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = [w.lower() for w in words(t)] + [None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def brute_ppm(train, text, order):
    """Straight from the definition: escapes with exclusion of what longer contexts have seen."""
    counts = defaultdict(Counter)
    for t in train:
        s = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k, s[i - k : i]][s[i]] += 1
    total, s = 0.0, bytes([ppm.START]) * order + text + bytes([ppm.END])
    for i in range(order, len(s)):
        excluded: set = set()
        for k in range(order, -1, -1):
            seen = {b: c for b, c in counts.get((k, s[i - k : i]), {}).items() if b not in excluded}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if s[i] in seen:
                total += math.log10(seen[s[i]] / whole)
                break
            total += math.log10(len(seen) / whole)
            excluded |= set(seen)
        else:
            total += math.log10(1 / (256 - len(excluded)))
    return total


def trained(train, order):
    codes = np.concatenate([ppm.gram_codes(t, order) for t in train])
    return ppm.Trie.of_grams(*np.unique(codes, return_counts=True), order)


def test_ppm_against_the_definition():
    train = [b"the cat sat on the mat", b"the dog sat", "été".encode(), b""]
    trie = trained(train, 3)
    for text in (b"the cat", b"a dog on the mat", "été".encode(), b"zzz", b"", bytes(range(1, 120))):
        assert trie.score(text)[0] == pytest.approx(brute_ppm(train, text, 3))


def test_ppm_probabilities_sum_to_one():
    for trie in (trained([b"abracadabra", b"alakazam"], 2), trained([b"abracadabra", b"alakazam" * 20], 3)):
        for context in (b"ab", b"zz", b"ra", bytes([ppm.START] * 2)):
            base = int.from_bytes(context.rjust(trie.order, bytes([ppm.START])), "big") << 8
            codes = np.array([base + b for b in range(256)], dtype=np.uint64)
            assert (10 ** trie.log10(codes)).sum() == pytest.approx(1)


def test_ppm_chunks_do_not_change_scores(monkeypatch):
    trie = trained([b"the cat sat on the mat " * 20], 4)
    whole = trie.score(b"the mat sat on a cat " * 9)[0]
    monkeypatch.setattr(ppm, "CHUNK", 16)
    assert trie.score(b"the mat sat on a cat " * 9)[0] == pytest.approx(whole)


def train_texts(texts):
    return [(t or "").encode() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]


def test_ppm_counts_of_every_order(spark, texts):
    order, train = 3, train_texts(texts)
    counts = ppm.gather(made(spark, [(0, t.decode()) for t in train]), order)
    table = ppm.contexts(counts.where("kind = 1").select("code", "n"), order)
    got = {(r["order"], r["context"]): (r["total"], {s["s"]: s["n"] for s in r["symbols"]}) for r in table.collect()}
    want = defaultdict(Counter)
    for t in train:
        s = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for at in range(order, len(s)):
            for k in range(order + 1):
                want[k, int.from_bytes(s[at - k : at], "big")][s[at]] += 1
    assert got == {c: (sum(n.values()), dict(n)) for c, n in want.items()}


@pytest.mark.parametrize("max_nodes", [0, 40, 400])
def test_ppm_scores_do_not_depend_on_what_tasks_receive(spark, texts, max_nodes):
    """With most contexts looked up by joins, each score is that of the definition."""
    rows = {i: t for i, t in texts.items() if t is None or len(t) < 900} | {2001: "nothing like it: Ω", 2004: "the stones of alpha"}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    assert held
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(made(spark, rows), order=3, max_nodes=max_nodes, frequent=5).collect()}
    train = train_texts(rows)
    for i in held[:4] + [i for i in (0, 7, 80, 81, 84, 2001, 2004) if i in rows]:
        assert got[i] == pytest.approx(brute_ppm(train, (rows[i] or "").encode(), 3)), i


def test_ppm_looks_up_by_order_only_what_training_lacks(spark, texts, monkeypatch):
    """Grams of training texts take one join; the joins from order to order get those of held-out texts."""
    rows = {i: t for i, t in texts.items() if t is None or len(t) < 900} | {2001: "nothing like it: Ω", 2004: "the stones of alpha"}
    asked, whole = [], ppm.looked_up
    monkeypatch.setattr(ppm, "looked_up", lambda codes, *a: asked.append({r["code"] for r in codes.collect()}) or whole(codes, *a))
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(made(spark, rows), order=3, max_nodes=0, frequent=5).collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    assert asked[0] <= {int(c) for i in held for c in ppm.gram_codes((rows[i] or "").encode(), 3)}
    train = train_texts(rows)
    for i in [*sorted(held)[:2], *sorted(set(rows) - held)[:3]]:
        assert got[i] == pytest.approx(brute_ppm(train, (rows[i] or "").encode(), 3)), i


@pytest.mark.parametrize("max_nodes", [0, 1_500_000])
def test_ppm_looks_up_only_what_training_lacks_at_any_bound(spark, texts, monkeypatch, max_nodes):
    """What goes from order to order doesn't depend on how much of the model tasks have, so it can't jump where that bound bites."""
    rows = {i: t for i, t in texts.items() if t is None or len(t) < 900} | {2001: "nothing like it: Ω", 2004: "the stones of alpha"}
    asked, whole = [], ppm.looked_up
    monkeypatch.setattr(ppm, "looked_up", lambda codes, *a: asked.append({r["code"] for r in codes.collect()}) or whole(codes, *a))
    ppm.score_documents(made(spark, rows), order=3, max_nodes=max_nodes, frequent=5)
    codes = lambda texts: {int(c) for t in texts for c in ppm.gram_codes(t, 3)}
    held = [(t or "").encode() for i, t in rows.items() if zlib.crc32(str(i).encode()) % 10 == 0]
    assert asked == [codes(held) - codes(train_texts(rows))]


def test_ppm_blocks_and_long_texts(spark, monkeypatch):
    """Pieces, blocks of pieces and texts longer than a block give the scores of the definition."""
    rng = random.Random(5)
    rows = {i: sentence(rng, rng.randint(0, 12)) for i in range(60)} | {70: "", 71: None, 72: "Ω" * 90 + sentence(rng, 60), 73: sentence(rng, 80)}
    monkeypatch.setattr(ppm, "CHUNK", 64)
    monkeypatch.setattr(ppm, "BLOCK", 256)
    blocks = ppm.in_blocks(made(spark, rows).selectExpr("doc_id", "doc_id % 10 = 0 held_out", "text")).collect()
    found = [x for b in blocks for x in zip(b["ids"], b["held_out"], ppm.unpacked(b["lengths"], b["texts"]))]
    assert sorted(found) == sorted((i, i % 10 == 0, (t or "").encode()) for i, t in rows.items())
    assert len({b["block"] for b in blocks}) > 8 and sum(b["size"] for b in blocks) == sum(len(t) + 1 for _, _, t in found)
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(made(spark, rows), order=3).collect()}
    for i in [*range(0, 60, 7), 70, 71, 72, 73, *(i for i in rows if zlib.crc32(str(i).encode()) % 10 == 0)]:
        assert got[i] == pytest.approx(brute_ppm(train_texts(rows), (rows[i] or "").encode(), 3)), i


def test_ppm_repeated_rows_and_null_ids(spark):
    rows = [(1, "the cat sat")] * 3 + [(None, "the dog"), (None, None)]
    got = ppm.score_documents(made(spark, rows), order=2).collect()
    assert len(got) == 5 and len({(r["score"], r["base_score"]) for r in got if r["doc_id"] == 1}) == 1
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {zlib.crc32(b"") % 10 == 0}


def test_ppm_without_training_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = ppm.score_documents(made(spark, {i: "some text" for i in held})).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in got} == {(0, 0)} and all(r["score"] == pytest.approx(-10 * math.log10(256)) for r in got)
    assert ppm.score_documents(made(spark, [])).count() == 0


# --- op9

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER)
    rows = dict(texts) | {90: "it's o'clock 42 <b>x</b> Ünïcödé ſtraße ΑΒΣ x é !!?", 91: sentence(random.Random(1), 6000)}
    pieces = packing.pack_documents(made(spark, rows), TOKENIZER).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, t in rows.items():
        parts = sorted(by_doc[i], key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).tolist()
        assert ids == model.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(p["doc_tokens"] == len(ids) for p in parts)
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding == 0


def test_token_ids_of_every_letter_and_of_special_strings():
    """The shortcut for words of letters and marks gives the ids of the tokenizers library, at every code point below U+3000."""
    from tokenizers import Tokenizer

    model, fast = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    assert fast.direct
    wrong = []
    for point in range(0x21, 0x3000):
        for word in (chr(point), f"Ab{chr(point)}c,", f"{chr(point)}x!!"):
            if np.frombuffer(fast.encode(word.encode()), "<u4").tolist() != model.encode(word, add_special_tokens=False).ids:
                wrong.append(word)
    assert not wrong
    for text in ("a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|> İstanbul", "<|endoftext|>,", "<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>"):
        assert np.frombuffer(fast.encode(text.encode()), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_pack_balances_costs():
    """Short documents spread so that no sequence costs much more than another, whatever the order they come in."""
    rng = random.Random(3)
    lengths = [rng.randint(20, 400) for _ in range(400)]
    pieces = packing.pack(lengths, 2048)
    cost, filled = Counter(), Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += packing.cost(n)
        filled[s] += n
    assert sum(filled.values()) == sum(lengths)
    full = [cost[s] for s, n in filled.items() if n == 2048]
    assert max(full) <= 1.1 * min(full)
    in_order = Counter()  # first fit as they come, for comparison
    at = 0
    for n in lengths:
        in_order[at // 2048] += packing.cost(n)
        at += n
    whole = [c for s, c in in_order.items() if s < at // 2048]
    assert max(full) - min(full) < max(whole) - min(whole)
    assert packing.pack([], 2048) == [] and len(packing.pack([2048], 2048)) == 1


def test_packing_repeats_and_nulls(spark):
    got = packing.pack_documents(made(spark, [(1, "a"), (1, "a"), (None, None)]), TOKENIZER).collect()
    assert sum(p["length"] for p in got) == 5
    assert packing.pack_documents(made(spark, []), TOKENIZER).count() == 0
