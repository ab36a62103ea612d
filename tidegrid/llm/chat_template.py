"""Chat formatting: a small sandboxed template language compiled to Python closures.

The language has text, ``{{ expression }}``, ``{% for x in y %}``, ``{% if %} / {% elif %} /
{% else %}``, ``{% set x = expression %}`` and ``{% generation %} ... {% endgeneration %}``, which
marks what a model is trained to produce.  Expressions have literals, names, fields of rows
(``message.role``), comparisons, ``and or not``, ``~`` (join as text) and the filters in
``FILTERS``.  Nothing else is reachable: no calls, no Python attributes, no imports.

``compile_template`` parses a template into a tree, folds constants, and turns the tree into nested
closures.  Rendering is lazy: messages are pulled one by one and pieces of text come out with a
flag that tells whether they lie in a generation block, so a conversation of any length renders in
the memory of one message.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import table

TURN_TEMPLATE = (
    "{% for message in messages %}"
    "<turn {{ message.role | escape }}>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
PART_CHARS = 1_000_000

# ---------------------------------------------------------------- escaping

_TO_ESCAPE = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Put a backslash before each backslash and angle bracket: no control string survives."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# ---------------------------------------------------------------- parsing


class TemplateError(ValueError):
    """The template is not in the language, or uses a name or field that is not there."""


_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|.()]))")


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            out.append(("lit", _ESCAPED.sub(lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text[1:-1])))
        elif number is not None:
            out.append(("lit", int(number)))
        else:
            out.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted):
        token = self.peek()
        if token in wanted or not wanted:
            self.at += 1
            return token
        return None

    def whole(self):
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take(("name", "or")):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.inverse()
        while self.take(("name", "and")):
            node = ("and", node, self.inverse())
        return node

    def inverse(self):
        return ("not", self.inverse()) if self.take(("name", "not")) else self.compared()

    def compared(self):
        node = self.joined()
        while sign := self.take(("sign", "=="), ("sign", "!=")):
            node = (sign[1], node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.take(("sign", "~")):
            node = ("~", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while sign := self.take(("sign", "|"), ("sign", ".")):
            kind, name = self.take()
            if kind != "name":
                raise TemplateError("a name must follow | and .")
            if sign[1] == "|" and name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            node = ("filter" if sign[1] == "|" else "field", node, name)
        return node

    def atom(self):
        kind, value = self.take()
        if kind == "lit":
            return ("lit", value)
        if kind == "name" and value in ("true", "false", "none"):
            return ("lit", {"true": True, "false": False, "none": None}[value])
        if kind == "name":
            return ("name", value)
        if (kind, value) == ("sign", "("):
            node = self.either()
            if not self.take(("sign", ")")):
                raise TemplateError("missing )")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> list[tuple]:
    """Syntax tree: a list of ("text" | "out" | "set" | "for" | "if" | "generation", ...) nodes."""
    parts, at = [], 0
    for m in _PARTS.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    position = 0

    def block(ends: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal position
        nodes: list[tuple] = []
        while position < len(parts):
            kind, source = parts[position]
            position += 1
            if kind == "text":
                nodes.append(("text", source))
                continue
            if kind == "out":
                nodes.append(("out", _Expression(source).whole()))
                continue
            word = source.split(None, 1)[0] if source else ""
            if word in ends:
                return nodes, source
            if word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", source)
                if not m:
                    raise TemplateError(f"bad loop: {source}")
                nodes.append(("for", m[1], m[2], block(("endfor",))[0]))
            elif word == "if":
                branches, tag = [], source
                while True:
                    test = ("lit", True) if tag == "else" else _Expression(tag.split(None, 1)[1]).whole()
                    body, closing = block(("endif",) if tag == "else" else ("elif", "else", "endif"))
                    branches.append((test, body))
                    if closing == "endif":
                        break
                    tag = closing
                nodes.append(("if", branches))
            elif word == "set":
                m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(.*)", source, re.S)
                if not m:
                    raise TemplateError(f"bad set: {source}")
                nodes.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                nodes.append(("generation", block(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unknown tag {source!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return block(())[0]


# ---------------------------------------------------------------- folding

_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: _text(a) + _text(b),
}


def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("lit", "name"):
        return node
    if kind in ("filter", "field"):
        inner = fold_expression(node[1])
        if kind == "filter" and inner[0] == "lit":
            return ("lit", FILTERS[node[2]](inner[1]))
        return (kind, inner, node[2])
    parts = [fold_expression(n) for n in node[1:]]
    if kind == "not" and parts[0][0] == "lit":
        return ("lit", not parts[0][1])
    if kind in ("and", "or") and parts[0][0] == "lit":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind in _BINARY and all(p[0] == "lit" for p in parts):
        return ("lit", _BINARY[kind](parts[0][1], parts[1][1]))
    return (kind, *parts)


def fold(nodes: list[tuple]) -> list[tuple]:
    """Evaluate constant expressions, choose constant branches, and merge neighbouring text."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        made: list[tuple] = []
        if kind == "out":
            value = fold_expression(node[1])
            made = [("text", _text(value[1]))] if value[0] == "lit" else [("out", value)]
        elif kind == "set":
            made = [("set", node[1], fold_expression(node[2]))]
        elif kind == "for":
            made = [("for", node[1], node[2], fold(node[3]))]
        elif kind == "generation":
            made = [("generation", fold(node[1]))]
        elif kind == "if":
            branches = []
            for test, body in node[1]:
                test = fold_expression(test)
                if test[0] != "lit" or test[1]:
                    branches.append((test, fold(body)))
                if test[0] == "lit" and test[1]:
                    break
            if branches and branches[0][0][0] == "lit":
                made = branches[0][1]
            elif branches:
                made = [("if", branches)]
        else:
            made = [node]
        for new in made:
            if new[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + new[1])
            elif new != ("text", ""):
                out.append(new)
    return out


# ---------------------------------------------------------------- closures


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "lit":
        constant = node[1]
        return lambda env: constant
    if kind == "name":
        name = node[1]

        def read(env):
            if name not in env:
                raise TemplateError(f"unknown name {name}")
            return env[name]

        return read
    inner = _value(node[1])
    if kind == "filter":
        apply = FILTERS[node[2]]
        return lambda env: apply(inner(env))
    if kind == "field":
        field = node[2]

        def get(env):
            row = inner(env)
            if not isinstance(row, dict) or field not in row:
                raise TemplateError(f"unknown field {field}")
            return row[field]

        return get
    if kind == "not":
        return lambda env: not inner(env)
    other = _value(node[2])
    if kind == "and":
        return lambda env: inner(env) and other(env)
    if kind == "or":
        return lambda env: inner(env) or other(env)
    combine = _BINARY[kind]
    return lambda env: combine(inner(env), other(env))


Piece = tuple[str, bool]
Renderer = Callable[[dict, bool], Iterator[Piece]]


def _renderer(nodes: list[tuple]) -> Renderer:
    steps = [_step(n) for n in nodes]

    def run(env: dict, marked: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(env, marked)

    return run


def _step(node: tuple) -> Renderer:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, marked: iter(((text, marked),))
    if kind == "out":
        value = _value(node[1])
        return lambda env, marked: iter(((_text(value(env)), marked),))
    if kind == "set":
        name, value = node[1], _value(node[2])

        def put(env, marked):
            env[name] = value(env)
            return iter(())

        return put
    if kind == "generation":
        body = _renderer(node[1])
        return lambda env, marked: body(env, True)
    if kind == "for":
        name, source, body = node[1], _value(("name", node[2])), _renderer(node[3])

        def loop(env, marked):
            for item in source(env):
                env[name] = item
                yield from body(env, marked)

        return loop
    branches = [(_value(test), _renderer(body)) for test, body in node[1]]

    def choose(env, marked):
        for test, body in branches:
            if test(env):
                return body(env, marked)
        return iter(())

    return choose


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (dicts of role and text, pulled lazily) to (text, marked) pieces."""
    body = _renderer(fold(parse(template)))
    return lambda messages: body({"messages": messages}, False)


# ---------------------------------------------------------------- Spark operator


def _conversations(batches) -> Iterator[tuple[object, Iterator[dict]]]:
    rows = (
        row
        for pdf in batches
        for row in zip(pdf["conv_id"].astype(object).where(pdf["conv_id"].notna(), None), pdf["role"], pdf["text"])
    )
    for conv_id, turns in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv_id, ({"role": r or "", "text": t or ""} for _, r, t in turns)


def _frames(rows: Iterator[tuple], columns: list[str], longs: list[str], chars: Callable = lambda r: 200):
    """Yield the rows as frames of about 4 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += chars(row)
        if size > 4_000_000:
            yield pd.DataFrame(held, columns=columns).astype(dict.fromkeys(longs, "Int64"))
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype(dict.fromkeys(longs, "Int64"))


def format_conversations(turns: DataFrame, template: str = TURN_TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, formatted, marks: every conversation rendered by ``template``.

    ``turns`` has conv_id, turn, role, text.  Turns are taken in the order (turn, role, text), nulls
    first; null roles and texts are empty; rows without a conv_id form one conversation.  The
    formatted conversation is its parts joined in order; ``marks`` holds the [start, end) code
    point spans of the part that lie in generation blocks.  A conversation is cut into parts of
    about ``part_chars`` code points as it renders, so one that holds a third of all rows streams
    through a task in bounded memory.  Other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        render = compile_template(template)

        def rows():
            for conv_id, messages in _conversations(batches):
                part, texts, marks, size = 0, [], [], 0
                for text, marked in render(messages):
                    if marked and text:
                        if marks and marks[-1]["end"] == size:
                            marks[-1]["end"] = size + len(text)
                        else:
                            marks.append({"start": size, "end": size + len(text)})
                    texts.append(text)
                    size += len(text)
                    if size >= part_chars:
                        yield conv_id, part, "".join(texts), marks
                        part, texts, marks, size = part + 1, [], [], 0
                if texts or part == 0:
                    yield conv_id, part, "".join(texts), marks

        yield from _frames(rows(), ["conv_id", "part", "formatted", "marks"], ["conv_id"], lambda r: len(r[2]))

    ordered = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.col("text").cast("string").alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInPandas(
        run, "conv_id long, part int, formatted string, marks array<struct<start: int, end: int>>"
    )


class TurnReader:
    """Reads role, text and loss text back from formatted parts, holding one turn at a time.

    A part is scanned once: what an open turn has so far is kept in pieces, with the places of its signs.
    """

    _SIGNS = re.compile(r"\\(?:.|$)|[<>]", re.S)

    def __init__(self):
        self.held, self.length, self.signs, self.escaped = [], 0, [], False
        self.marks, self.turns = [], 0
        self.chars = self.loss_chars = 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()

    def _close(self, whole: str | None) -> tuple[str, int]:
        """Digest the turn that the four signs bound; the open text and where the next turn begins in it."""
        whole = "".join(self.held) if whole is None else whole
        opened, role_end, closed, end = self.signs
        role, content = unescape(whole[opened + 6 : role_end]), unescape(whole[role_end + 1 : closed])
        self.turns += 1
        self.digest.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
        self.signs = []
        return whole, end + 2

    def feed(self, text: str, marks) -> None:
        base, whole, at = self.length, None, 0
        self.chars += len(text)
        self.marks += [(base + m["start"], base + m["end"]) for m in marks]
        self.held.append(text)
        self.length += len(text)
        start = 1 if self.escaped and text else 0  # the part before ended in a backslash
        self.escaped = self.escaped and not text
        # a turn is <turn ROLE>TEXT</turn>\n with no bare angle bracket inside role or text
        for m in self._SIGNS.finditer(text, start):
            if m[0][0] == "\\":
                self.escaped = len(m[0]) == 1
                continue
            if len(self.signs) == 4:
                whole, at = self._close(whole)
            self.signs.append(base + m.start())
        if len(self.signs) == 4 and self.length > self.signs[3] + 1:
            whole, at = self._close(whole)
        if at:
            loss = "".join(unescape(whole[s:e]) for s, e in self.marks if e <= at)
            self.loss_chars += len(loss)
            self.loss.update(loss.encode("utf-8", "surrogatepass"))
            self.marks = [(s - at, e - at) for s, e in self.marks if e > at]
            self.held, self.length, self.signs = [whole[at:]], self.length - at, [x - at for x in self.signs]

    def row(self, conv_id) -> tuple:
        if self.length or self.marks:
            raise ValueError(f"conversation {conv_id} does not read back")
        return (conv_id, self.turns, self.digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read_back(batches):
    def rows():
        reader, current = None, None
        for pdf in batches:
            ids = pdf["conv_id"].astype(object).where(pdf["conv_id"].notna(), None)
            for conv_id, part, text, marks in zip(ids, pdf["part"], pdf["formatted"], pdf["marks"]):
                if part == 0:
                    if reader:
                        yield reader.row(current)
                    reader, current = TurnReader(), conv_id
                reader.feed(text, marks)
        if reader:
            yield reader.row(current)

    yield from _frames(rows(), _DIGESTS, ["conv_id"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation digests read from the output of ``format_conversations`` as it streams."""
    return formatted.mapInPandas(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op7_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(turns))
