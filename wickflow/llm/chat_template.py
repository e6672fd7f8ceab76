"""Chat formatting: a small template language, compiled to Python closures that render one turn at a time.

The language has text, {{ expression }}, {% if %} / {% elif %} / {% else %} / {% endif %}, {% set name = expression %},
{% for message in messages %} ... {% endfor %} at the top level, {% generation %} ... {% endgeneration %} around what
a model learns to say, and {# comments #}. Expressions know strings, integers, names, message.role and message.content
(or message['role']), the same of messages[0], loop.index, loop.index0, loop.first, loop.last, ==, !=, and, or, not, in,
+, -, %, ~, and the filters trim, upper, lower, escape. There is no access to attributes, calls or imports, and nothing
runs but the closures made here, so a template can't leave its sandbox. Constant parts are folded before closures are made.

A minus inside a tag's bracket, as in {%- or -}}, takes the white space of the text on that side. With trim_blocks a
line end right after a {% %} or {# #} tag goes, with lstrip_blocks the blanks from the line's start to such a tag. White
space is taken from the template's own text only, never from what an expression shows. Of other messages than the present
and the first nothing is known, as a conversation is rendered turn by turn.

Output is a stream of segments, so that a conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import named

#: Default control strings; the escape mark goes before any of them, or itself, that a text holds.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
MARK = "\\"

DEFAULT = (
    "{% for message in messages %}"
    "{% if loop.first %}<s>{% endif %}"
    "{% if message.role == 'user' %}[INST] {{ message.content | escape }} [/INST]"
    "{% elif message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}</s>"
    "{% elif message.role == 'system' %}[SYS] {{ message.content | escape }} [/SYS]"
    "{% else %}[ROLE]{{ message.role | escape }}[/ROLE] {{ message.content | escape }}</s>"
    "{% endif %}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not in the language; the message says where."""


def escape(text: str, controls=CONTROLS) -> str:
    """A mark before each control string and each mark, so that no control string is left bare."""
    return re.sub("|".join(map(re.escape, (MARK, *sorted(controls, key=len, reverse=True)))), lambda m: MARK + m[0], text)


def unescape(text: str) -> str:
    return re.sub(re.escape(MARK) + "(.)", lambda m: m[1], text, flags=re.S)


# Expressions and statements. A node is ("const", value) or (kind, ...); compile_node makes its closure.

_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*(?:\[\d+\])?(?:\.[A-Za-z_]\w*|\[\s*(?:'\w+'|\"\w+\")\s*\])?)|(==|!=|[()+~|%-]))")
_SUBSCRIPT = re.compile(r"\[\s*['\"](\w+)['\"]\s*\]$")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_FILTERS = {"trim": str.strip, "upper": str.upper, "lower": str.lower}
_NAMES = {"message.role", "message.content", "messages[0].role", "messages[0].content", "loop.index", "loop.index0", "loop.first", "loop.last", "add_generation_prompt"}


class _Expression:
    def __init__(self, source: str, names: set[str]):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            number, string, name, sign = m.groups()
            if number is not None:
                self.items.append(("const", int(number)))
            elif string is not None:
                self.items.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), string[1:-1])))
            else:
                self.items.append(("sign", sign) if sign else ("name", _SUBSCRIPT.sub(r".\1", name)))
            at = m.end()
        self.at, self.names = 0, names

    def peek(self, *values) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "const" and self.items[self.at][1] in values

    def take(self, *values) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def parse(self):
        node = self.either()
        if self.at < len(self.items):
            raise TemplateError(f"did not expect {self.items[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        for sign in ("==", "!=", "in"):
            if self.take(sign):
                return (sign, node, self.joined())
        return node

    def joined(self):
        node = self.remainder()
        while self.peek("+", "-", "~"):
            sign = self.items[self.at][1]
            self.at += 1
            node = (sign, node, self.remainder())
        return node

    def remainder(self):
        node = self.filtered()
        while self.take("%"):
            node = ("%", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            if self.at >= len(self.items) or self.items[self.at][0] != "name" or self.items[self.at][1] not in {*_FILTERS, "escape"}:
                raise TemplateError("a filter must be trim, upper, lower or escape")
            node = ("filter", self.items[self.at][1], node)
            self.at += 1
        return node

    def atom(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
            return node
        if self.at >= len(self.items):
            raise TemplateError("an expression ends too early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and value in self.names:
            return ("name", value)
        raise TemplateError(f"unknown name {value!r}")


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


def tags_and_text(source: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> list[str]:
    """Texts and tags in turn, beginning with a text, with white space taken as the tags ask; comments are empty tags."""
    parts, new_line = _TAG.split(source), True
    for i in range(1, len(parts), 2):
        tag, block = parts[i], parts[i][1] in "%#"
        left, inner, right = re.fullmatch(r"([-+]?)(.*?)([-+]?)", tag[2:-2], re.S).groups()
        if left == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        elif block and lstrip_blocks and not left:
            before, end, line = parts[i - 1].rpartition("\n")
            if (end or new_line) and not line.strip():
                parts[i - 1] = before + end
        after = parts[i + 1]
        if right == "-":
            parts[i + 1] = after.lstrip()
        elif block and trim_blocks and not right:
            parts[i + 1] = after.removeprefix("\n")
        new_line = after[: len(after) - len(parts[i + 1])].endswith("\n")
        parts[i] = "" if tag[1] == "#" else tag[:2] + inner + tag[-2:]
    return parts


def parse(source: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> list:
    """The syntax tree: a list of ("text", s), ("out", e), ("if", [(e, body)], body), ("set", name, e), ("for", body), ("gen", body)."""
    parts = tags_and_text(source, trim_blocks, lstrip_blocks)
    names, at = set(_NAMES), 0

    def body(ends: tuple[str, ...], top: bool):
        nonlocal at
        found = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if at % 2 == 1:
                if part:
                    found.append(("text", part))
            elif part.startswith("{{"):
                found.append(("out", _Expression(part[2:-2], names).parse()))
            elif part.startswith("{%"):
                words = part[2:-2].strip()
                head = words.split(None, 1)[0] if words else ""
                if head in ends:
                    return found, words
                if head == "if":
                    arms, condition = [], words[2:]
                    while True:
                        inner, end = body(("elif", "else", "endif"), False)
                        arms.append((_Expression(condition, names).parse(), inner))
                        if not end.startswith("elif"):
                            break
                        condition = end[4:]
                    otherwise = body(("endif",), False)[0] if end.startswith("else") else []
                    found.append(("if", arms, otherwise))
                elif head == "set":
                    m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(.*)", words, flags=re.S)
                    if not m:
                        raise TemplateError(f"can't read {words!r}")
                    node = _Expression(m[2], names).parse()
                    names.add(m[1])
                    found.append(("set", m[1], node))
                elif head == "for" and top and re.fullmatch(r"for\s+message\s+in\s+messages", words):
                    found.append(("for", body(("endfor",), False)[0]))
                elif head == "generation":
                    found.append(("gen", body(("endgeneration",), False)[0]))
                else:
                    raise TemplateError(f"did not expect {{% {words} %}}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return found, ""

    return body((), True)[0]


def _apply(kind: str, a, b=None):
    if kind == "==":
        return a == b
    if kind == "!=":
        return a != b
    if kind == "in":
        return str(a) in str(b)
    if kind == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else str(a) + str(b)
    if kind in ("-", "%"):
        if not isinstance(a, int) or not isinstance(b, int) or kind == "%" and b == 0:
            raise TemplateError(f"can't work out {a!r} {kind} {b!r}")
        return a - b if kind == "-" else a % b
    return str(a) + str(b)


def fold(node, escaper):
    """An expression with its constant parts worked out."""
    if node[0] in ("const", "name"):
        return node
    if node[0] == "filter":
        inner = fold(node[2], escaper)
        use = escaper if node[1] == "escape" else _FILTERS[node[1]]
        return ("const", use(str(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if node[0] == "not":
        inner = fold(node[1], escaper)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    left, right = fold(node[1], escaper), fold(node[2], escaper)
    if node[0] in ("and", "or"):
        if left[0] == "const":
            return right if bool(left[1]) == (node[0] == "and") else left
        return (node[0], left, right)
    if left[0] == right[0] == "const":
        return ("const", _apply(node[0], left[1], right[1]))
    return (node[0], left, right)


def fold_body(nodes: list, escaper) -> list:
    """Statements with folded expressions; constant branches are chosen, and neighbouring texts joined."""
    found = []

    def add(node):
        if node[0] == "text" and found and found[-1][0] == "text":
            found[-1] = ("text", found[-1][1] + node[1])
        elif node != ("text", ""):
            found.append(node)

    for node in nodes:
        if node[0] == "out":
            inner = fold(node[1], escaper)
            add(("text", _shown(inner[1])) if inner[0] == "const" else ("out", inner))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2], escaper)))
        elif node[0] in ("for", "gen"):
            add((node[0], fold_body(node[1], escaper)))
        elif node[0] == "if":
            arms, otherwise = [], fold_body(node[2], escaper)
            for condition, body in node[1]:
                condition = fold(condition, escaper)
                if condition[0] == "const":
                    if condition[1]:
                        otherwise = fold_body(body, escaper)
                        break
                    continue
                arms.append((condition, fold_body(body, escaper)))
            if arms:
                add(("if", arms, otherwise))
            else:
                for inner in otherwise:
                    add(inner)
        else:
            add(node)
    return found


def _shown(value) -> str:
    return "" if value is None else str(value)


def compile_expression(node, escaper):
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "filter":
        inner, use = compile_expression(node[2], escaper), escaper if node[1] == "escape" else _FILTERS[node[1]]
        return lambda env: use(_shown(inner(env)))
    if kind == "not":
        inner = compile_expression(node[1], escaper)
        return lambda env: not inner(env)
    left, right = compile_expression(node[1], escaper), compile_expression(node[2], escaper)
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "or":
        return lambda env: left(env) or right(env)
    return lambda env: _apply(kind, left(env), right(env))


def compile_body(nodes: list, escaper):
    """A closure (env, emit, learned) that passes on each piece of text with whether the model learns it."""
    steps = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda env, emit, learned, text=node[1]: emit(text, learned))
        elif node[0] == "out":
            steps.append(lambda env, emit, learned, e=compile_expression(node[1], escaper): emit(_shown(e(env)), learned))
        elif node[0] == "set":
            steps.append(lambda env, emit, learned, name=node[1], e=compile_expression(node[2], escaper): env.__setitem__(name, e(env)))
        elif node[0] == "gen":
            steps.append(lambda env, emit, learned, inner=compile_body(node[1], escaper): inner(env, emit, True))
        elif node[0] == "if":
            arms = [(compile_expression(c, escaper), compile_body(b, escaper)) for c, b in node[1]]
            otherwise = compile_body(node[2], escaper)

            def branch(env, emit, learned, arms=arms, otherwise=otherwise):
                for condition, inner in arms:
                    if condition(env):
                        return inner(env, emit, learned)
                return otherwise(env, emit, learned)

            steps.append(branch)

    def run(env, emit, learned=False):
        for step in steps:
            step(env, emit, learned)

    return run


@dataclass
class Template:
    """A compiled template: what stands before the messages, for each and after."""

    source: str = DEFAULT
    controls: tuple[str, ...] = CONTROLS
    trim_blocks: bool = False
    lstrip_blocks: bool = False
    tree: list = field(init=False)

    def __post_init__(self):
        def escaper(text):
            return escape(text, self.controls)

        self.tree = fold_body(parse(self.source, self.trim_blocks, self.lstrip_blocks), escaper)
        loops = [i for i, n in enumerate(self.tree) if n[0] == "for"]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over the messages")
        at = loops[0]
        self.before, self.each, self.after = (
            compile_body(part, escaper) for part in (self.tree[:at], self.tree[at][1], self.tree[at + 1 :])
        )

    def turn(self, role: str, content: str, index: int, last: bool, env: dict | None = None) -> tuple[str, list[tuple[int, int]]]:
        """The text of one turn, and the spans (in code points) that the model learns."""
        env = {} if env is None else env
        pieces, spans, length = [], [], 0

        def emit(text, learned):
            nonlocal length
            pieces.append(text)
            if learned and text:
                if spans and spans[-1][1] == length:
                    spans[-1] = (spans[-1][0], length + len(text))
                else:
                    spans.append((length, length + len(text)))
            length += len(text)

        env |= {"message.role": role, "message.content": content, "loop.index": index + 1, "loop.index0": index}
        env |= {"loop.first": index == 0, "loop.last": last}
        if index == 0:
            env |= {"messages[0].role": role, "messages[0].content": content}
            self.before(env, emit)
        self.each(env, emit)
        if last:
            self.after(env, emit)
        return "".join(pieces), spans

    def render(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """A whole conversation that fits in memory."""
        env, text, spans = {}, "", []
        for i, (role, content) in enumerate(messages):
            part, learned = self.turn(role, content, i, i + 1 == len(messages), env)
            spans += [(a + len(text), b + len(text)) for a, b in learned]
            text += part
        return text, spans


SEGMENTS = "conv_id long, at long, last boolean, text string, spans array<struct<start:long,end:long>>"


def format_turns(
    turns: DataFrame,
    template: str = DEFAULT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trim_blocks: bool = False,
    lstrip_blocks: bool = False,
) -> DataFrame:
    """(conv_id, at, last, text, spans): the formatted text of each turn, in order within each partition.

    A conversation's texts, joined by `at`, are its formatted string; spans are the code points of text under the loss
    mask. Turns sort by turn (null last), role and text, so repeated turns all appear, in one order. Null texts and
    roles are empty; a null id is a conversation of its own. An empty table gives none, other columns are ignored.
    Rows are streamed in sorted order, one turn ahead, so no conversation is held as a whole.
    """
    conv, turn, role, text = named(turns, id_col, turn_col, role_col, text_col)
    rows = (
        turns.select(
            conv.cast("long").alias("conv_id"),
            turn.cast("long").alias("turn"),
            F.coalesce(role.cast("string"), F.lit("")).alias("role"),
            F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
        .select("conv_id", "role", "text")
    )

    def run(batches):
        compiled = Template(template, trim_blocks=trim_blocks, lstrip_blocks=lstrip_blocks)
        kinds = pa.schema(
            [
                ("conv_id", pa.int64()),
                ("at", pa.int64()),
                ("last", pa.bool_()),
                ("text", pa.string()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )
        held, index, env, out = None, 0, {}, []

        def done(last):
            part, spans = compiled.turn(held[1], held[2], index, last, env)
            out.append((held[0], index, last, part, [{"start": a, "end": b} for a, b in spans]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    last = held[0] != row[0]
                    done(last)
                    index = 0 if last else index + 1
                    if last:
                        env = {}
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)
                out.clear()
        if held is not None:
            done(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    return rows.mapInArrow(run, SEGMENTS)


_BARE = re.compile(re.escape(MARK) + ".|" + "|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))), re.S)


def read_turn(text: str) -> tuple[str, str]:
    """Role and text of a turn that the default template formatted."""
    signs = [m for m in _BARE.finditer(text) if not m[0].startswith(MARK)]
    if signs and signs[0][0] == "<s>" and signs[0].start() == 0:
        text, signs = text[3:], [m for m in _BARE.finditer(text[3:]) if not m[0].startswith(MARK)]
    first = signs[0] if signs else None
    if first and first.start() == 0 and first[0] in ("[INST]", "[SYS]"):
        return ("user" if first[0] == "[INST]" else "system"), unescape(text[first.end() + 1 : signs[-1].start() - 1])
    if first and first.start() == 0 and first[0] == "[ROLE]":
        return unescape(text[first.end() : signs[1].start()]), unescape(text[signs[1].end() + 1 : signs[-1].start()])
    return "assistant", unescape(text[: signs[-1].start()])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the segments of format_turns in the order that they come in."""

    def run(batches):
        kinds = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in DIGESTS.split(", ")])
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            out = []
            for conv, _, last, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                role, said = read_turn(text)
                turns.update(f"{role}\n{said}\n".encode())
                learned = unescape("".join(text[s["start"] : s["end"]] for s in spans))
                loss.update(learned.encode())
                counts = [counts[0] + 1, counts[1] + len(learned), counts[2] + len(text)]
                if last:
                    out.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    return formatted.select("conv_id", "at", "last", "text", "spans").mapInArrow(run, DIGESTS)
