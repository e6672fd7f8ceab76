"""Nearest neighbours, chat formatting and the pipeline's stages."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wickflow.llm import ann, chat_template

# --- op8


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, rank int")


def brute(rows, k=5):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            near = sorted((-(q @ v) / np.linalg.norm(q) / np.linalg.norm(v), j) for j, v in good if j != i)
            out[i] = near[:k]
    return out


def recall(got, want):
    hit = total = 0
    for q, near in want.items():
        hit += len({j for _, j in near} & {r["vec_id"] for r in got if r["query_id"] == q})
        total += len(near)
    return hit / total


def test_recall_on_random_and_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 32))
    rows = [(i, (centres[i % 12] * (i % 3) + rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(3000)]
    got = ann.nearest(vectors(spark, rows), "vec_id % 50 = 0").collect()
    want = brute(rows)
    assert recall(got, want) >= 0.9
    for q in want:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        exact = {j: -s for s, j in brute([x for x in rows if x[0] == q] + [x for x in rows if x[0] in {r["vec_id"] for r in mine}])[q]}
        assert all(r["score"] == pytest.approx(exact[r["vec_id"]], abs=1e-12) for r in mine)


def test_copies_bad_vectors_and_few_rows(spark):
    v, w = [1.0, 0.0, 2.0], [0.0, 1.0, 0.0]
    rows = [(i, v) for i in range(40)] + [(50, w), (51, None), (52, []), (53, [0.0] * 3), (54, [1.0, None, 1.0]), (55, [float("nan"), 1.0, 1.0]), (56, [float("inf"), 1.0, 1.0]), (None, v), (57, [1.0])]
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows + [(1, v)]), "vec_id % 50 = 0").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(got[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert set(got) == {0, 50}
    assert ann.nearest(vectors(spark, [(0, v), (1, w)]), "vec_id % 50 = 0").count() == 1
    assert ann.nearest(vectors(spark, []), "vec_id % 50 = 0").count() == 0


def test_probes_come_by_chance_and_reach_the_coverage():
    seen = list(ann.probes(np.array([0.3, 1.7, -0.2]), 0.8, 0.9))
    assert len(seen) == len(set(seen)) and seen[0] == (0, 1, -1)

    def chance(cells):
        return math.prod(dict((c, p) for p, c in ann.cell_chances(v, 0.8))[x] for v, x in zip((0.3, 1.7, -0.2), cells))

    chances = [chance(c) for c in seen]
    assert all(a >= b - 1e-12 for a, b in zip(chances, chances[1:])) and sum(chances) >= 0.9


# --- op10


def turns(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, last int")


def brute_digests(rows):
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    out = {}
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        out[c] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_are_read_back(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[SYS]", "[ROLE]", "ok", " ", "\n", "é", "\\\\", "[/ROLE]", "[/SYS]", "{{ x }}"]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "", "[INST]", "\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))))
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, None, "assistant", "last"), (51, 0, "user", "same"), (51, 0, "user", "same"), (52, 0, "assistant", "z" * 100000)]
    found = chat_template.digests(chat_template.format_turns(turns(spark, rows)))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in found.collect()}
    assert got == brute_digests(rows)
    assert chat_template.format_turns(turns(spark, [])).count() == 0


def test_segments_join_to_the_whole_text(spark):
    said = [("system", "be kind"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "\\yes")]
    template = chat_template.Template()
    text, spans = template.render(said)
    rows = chat_template.format_turns(turns(spark, [(1, i, *x) for i, x in enumerate(said)])).orderBy("at").collect()
    assert "".join(r["text"] for r in rows) == text
    assert chat_template.unescape("".join(text[a:b] for a, b in spans)) == "\\yes"
    assert text.count("<s>") == 1 and text.startswith("<s>[SYS] be kind [/SYS][INST] ")


def test_template_language():
    source = "{% set sep = '|' + '-' %}{% for message in messages %}{% if loop.index0 > 0 %}{% endif %}{% endfor %}"
    with pytest.raises(chat_template.TemplateError):
        chat_template.Template(source)
    source = (
        "{% set mark = 'a' ~ 1 + 1 %}{{ mark }}{% for message in messages %}{% if not loop.first and 'x' in message.content %}X"
        "{% elif message.role != 'user' or loop.last %}{% generation %}{{ message.content | trim | upper }}{% endgeneration %}"
        "{% else %}{{ loop.index }}{% endif %}{% if false %}never{% endif %}{% if true %};{% endif %}{% endfor %}end"
    )
    template = chat_template.Template(source)
    text, spans = template.render([("user", "x"), ("bot", " hi "), ("user", "xx"), ("user", "z")])
    assert text == "a111;HI;X;Z;end" and [text[a:b] for a, b in spans] == ["HI", "Z"]
    assert chat_template.Template("{% for message in messages %}a{{ 'b' }}{% if 1 == 1 %}c{% endif %}{% endfor %}").tree[0][1] == [("text", "abc")]


LOOP = "{%- for message in messages -%}\n  "


@pytest.mark.parametrize(
    ("source", "options", "want"),
    [
        ("a \n {%- for message in messages -%} \n b {{- message.content -}} c {%- endfor %} d", {}, "ab x cb\ty c d"),
        ("a\n{% for message in messages %}\n  <{{ message.role }}>\n{% endfor %}\nend\n", {}, "a\n\n  <u>\n\n  <v>\n\nend\n"),
        ("a\n{% for message in messages %}\n  <{{ message.role }}>\n{% endfor %}\nend\n", {"trim_blocks": True}, "a\n  <u>\n  <v>\nend\n"),
        ("  {% for message in messages %}\n  {% if true %}\n  {{ 1 }}\n  {% endif %}\n  {% endfor %}\n", {"trim_blocks": True, "lstrip_blocks": True}, "  1\n  1\n"),
        ("  {% for message in messages %}q  {% if true %}\n  {{ 1 }}  {% endif %}{% endfor %}", {"lstrip_blocks": True}, "q  \n  1  q  \n  1  "),
        (" {%+ for message in messages %}{% endfor +%}\nz", {"trim_blocks": True, "lstrip_blocks": True}, " \nz"),
        ("{# note {{ open }} #}\n{% for message in messages %}{#- x -#} {{ loop.index }}{% endfor %}", {"trim_blocks": True}, "12"),
        (LOOP + "{{ message['role'] ~ message[\"content\"] }}{% endfor %}", {}, "u x v\ty "),
        (LOOP + "{{ messages[0]['role'] + messages[0].content|trim }};{% endfor %}", {}, "ux;ux;"),
        (LOOP + "{% if loop.index0 % 2 == 0 %}E{% else %}O{% endif %}{{ loop.index - 1 + 3 % 2 }}{% endfor %}", {}, "E1O2"),
        ("{% for message in messages %}{{ ' a ' -}} {{- ' b ' }}{% endfor %}", {}, " a  b  a  b "),
    ],
)
def test_white_space_comments_and_subscripts(source, options, want):
    template = chat_template.Template(source, **options)
    assert template.render([("u", " x "), ("v", "\ty ")])[0] == want


def test_options_reach_the_tasks(spark):
    rows = turns(spark, [(1, 0, "user", " a"), (1, 1, "bot", "b"), (2, 0, "bot", "c")])
    source = "{% for message in messages %}\n  {% if message.role == 'bot' %}\n{{ messages[0].content }}>{{ message.content }}\n  {% endif %}\n{% endfor %}\n"
    found = chat_template.format_turns(rows, source, trim_blocks=True, lstrip_blocks=True).orderBy("conv_id", "at").collect()
    assert [r["text"] for r in found] == ["", " a>b\n", "c>c\n"]


@pytest.mark.parametrize(
    "bad",
    [
        "{{ messages.__class__ }}",
        "{% for message in messages %}{{ messages[1].content }}{% endfor %}",
        "{% for message in messages %}{{ messages[0] }}{% endfor %}",
        "{% for message in messages %}{{ messages[0].__class__ }}{% endfor %}",
        "{% for message in messages %}{{ message['__class__'] }}{% endfor %}",
        "{% for message in messages %}{{ 1 % 0 }}{% endfor %}",
        "{% for message in messages %}{{ 'a' - 1 }}{% endfor %}",
        "{% for message in messages %}{{ message.content() }}{% endfor %}",
        "{% for message in messages %}{{ open }}{% endfor %}",
        "{% import os %}",
        "{% for message in messages %}{% if true %}{% endfor %}",
        "no loop",
        "{% for message in messages %}{{ 'a' | safe }}{% endfor %}",
        "{% for message in messages %}{{ }}{% endfor %}",
    ],
)
def test_sandbox_refuses(bad):
    with pytest.raises(chat_template.TemplateError):
        chat_template.Template(bad)


def test_escape_is_reversible():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice(["<s>", "</s>", "[INST]", "\\", "<", "s>", "a", "[", "INST]", "\n"]) for _ in range(12))
        assert chat_template.unescape(chat_template.escape(text)) == text
        bare = [m[0] for m in chat_template._BARE.finditer(chat_template.escape(text)) if not m[0].startswith("\\")]
        assert not bare


# --- pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    names = "river stone light under walking quickly field morning answer garden window winter letter summer".split()
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(names) for _ in range(14)) for _ in range(4)]
        rows.append([i, "\n".join(lines), "en", f"src{i % 3}", 0])
    for i in range(120, 130):
        rows.append([i, rows[i - 120][1], "en", "src0", 0])  # copies
    for i in range(130, 140):
        rows.append([i, " ".join(w + "%%%" for w in rows[i - 100][1].split()), "en", "src1", 0])  # junk
    rows.append([140, None, "en", None, None])
    rows.append([141, "too short", "en", "src2", 0])
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 130 <= i < 140), 0) for i in range(140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs)
    good = {r["doc_id"] for r in kept[0].collect()}
    assert set(range(130)) <= good and not good & {140, 141}
    lines = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    assert set(range(120)) <= set(lines) and not set(range(120, 130)) & set(lines)
    originals = {r["doc_id"]: r["text"] for r in kept[0].collect()}
    assert all(lines[i] == originals[i] for i in range(120))
    single = {r["doc_id"] for r in kept[2].collect()}
    assert single <= set(lines)
    total = sum(len(r["text"].split()) for r in kept[2].collect())
    mixed = sum(len(r["text"].split()) for r in kept[3].collect())
    assert abs(mixed - 1.5 * total) <= 3
    assert Counter(r["doc_id"] for r in kept[3].collect()).most_common(1)[0][1] <= 2
    tokens = kept[4].agg({"length": "sum"}).first()[0]
    assert tokens > mixed
    assert corpus_pipeline.run(spark, corpus).agg({"length": "sum"}).first()[0] == tokens
