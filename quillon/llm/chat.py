"""Chat formatting: a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and
each node becomes a Python closure that writes into a sink.  The language has

    text                         copied
    {{ expression }}             written
    {% for name in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      what a model is to learn (the loss mask)

with strings, integers, names, ``a.b`` (keys of dictionaries only), ``==``, ``!=``, ``and``,
``or``, ``not``, ``+``, parentheses and filters ``x | escape``, ``x | label``, ``x | title``, ``x | upper``.  There are no
calls and no attributes of Python objects, so a template can reach nothing but its input.

``escape`` breaks every control string of the format with a backslash behind its first
character and doubles backslashes: no text can close a turn or open one, and
``unescape`` gives the text back exactly.

Rows of a conversation are taken by turn, ties by role and text; repeated rows are turns of their
own.  Null roles and texts are empty; rows without conv_id form one conversation.
Conversations are streamed turn by turn, so a long one needs no more memory than a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that have a meaning in the format; none holds a backslash or ends in its own beginning.
CONTROL = ("### ", "<turn>", "</turn>")
TEMPLATE = (
    "{% for turn in turns %}<turn>### {{ turn.role | label }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


# Text


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def title(role: str) -> str:
    """Reversible: only a role in lower-case letters a-z changes."""
    return role[0].upper() + role[1:] if re.fullmatch("[a-z]+", role) else f"={role}"


def untitle(name: str) -> str:
    return name[1:] if name.startswith("=") else name.lower()


def label(role: str) -> str:
    """A role as the name before a colon."""
    return escape(title(role)).replace(":", "\\:")


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "label": label, "title": title, "upper": str.upper}


# Syntax tree


class TemplateError(ValueError):
    """The template breaks the language's rules."""


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple = ()


TOKEN = re.compile(r"\s*(?:(?P<string>'[^']*'|\"[^\"]*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|.()+]))")
BINARY = {"or": 1, "and": 2, "==": 3, "!=": 3, "+": 4}


class Expression:
    """Precedence climbing over the tokens of one tag."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token[1] != value:
            raise TemplateError(f"{value!r} expected, {token[1]!r} found")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.binary(1)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def binary(self, least: int) -> Node:
        node = self.unary()
        while (sign := self.peek()[1]) in BINARY and self.peek()[0] != "string" and BINARY[sign] >= least:
            self.take()
            node = Node("binary", (sign, node, self.binary(BINARY[sign] + 1)))
        return node

    def unary(self) -> Node:
        if self.peek() == ("name", "not"):
            self.take()
            return Node("not", (self.unary(),))
        node = self.atom()
        while self.peek()[1] in (".", "|") and self.peek()[0] == "sign":
            sign, (kind, name) = self.take()[1], self.take()
            if kind != "name" or sign == "|" and name not in FILTERS or name.startswith("_"):
                raise TemplateError(f"no such {'key' if sign == '.' else 'filter'}: {name!r}")
            node = Node("key" if sign == "." else "filter", (node, name))
        return node

    def atom(self) -> Node:
        kind, value = self.take()
        if kind == "string":
            return Node("constant", (value[1:-1],))
        if kind == "number":
            return Node("constant", (int(value),))
        if value == "(":
            node = self.binary(1)
            self.take(")")
            return node
        if kind == "name" and not value.startswith("_"):
            return Node("name", (value,))
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> Node:
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[Node, str]:
        nonlocal at
        items = []
        while at < len(parts):
            part, at = parts[at], at + 1
            if part.startswith("{{"):
                items.append(Node("write", (Expression(part[2:-2]).whole(),)))
            elif part.startswith("{%"):
                tag = part[2:-2].strip()
                word = tag.split()[0] if tag else ""
                if word in ends:
                    return Node("block", tuple(items)), tag
                items.append(statement(word, tag))
            elif part:
                items.append(Node("text", (part,)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("block", tuple(items)), ""

    def statement(word: str, tag: str) -> Node:
        if word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", tag, re.S)):
            return Node("for", (m[1], Expression(m[2]).whole(), block(("endfor",))[0]))
        if word == "generation":
            return Node("generation", (block(("endgeneration",))[0],))
        if word == "if":
            test = Expression(tag[2:]).whole()
            body, end = block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return Node("if", (test, body, Node("block", (statement("if", end[2:]),))))
            return Node("if", (test, body, block(("endif",))[0] if end == "else" else Node("block")))
        raise TemplateError(f"no such tag: {tag!r}")

    return block(())[0]


# Folding


def _operate(sign: str, a, b):
    return {"==": lambda: a == b, "!=": lambda: a != b, "+": lambda: a + b, "and": lambda: a and b, "or": lambda: a or b}[sign]()


def fold(node: Node) -> Node:
    """Constants are computed, dead branches go, and neighbouring texts become one."""
    args = tuple(fold(a) if isinstance(a, Node) else a for a in node.args)
    const = lambda a: isinstance(a, Node) and a.kind == "constant"
    match node.kind:
        case "binary" if const(args[1]) and const(args[2]):
            return Node("constant", (_operate(args[0], args[1].args[0], args[2].args[0]),))
        case "not" if const(args[0]):
            return Node("constant", (not args[0].args[0],))
        case "filter" if const(args[0]):
            return Node("constant", (FILTERS[args[1]](str(args[0].args[0])),))
        case "write" if const(args[0]):
            return Node("text", (str(args[0].args[0]),))
        case "if" if const(args[0]):
            return args[1] if args[0].args[0] else args[2]
        case "block":
            items: list[Node] = []
            for a in args:
                for item in a.args if a.kind == "block" else (a,):
                    if item.kind == "text" and items and items[-1].kind == "text":
                        items[-1] = Node("text", (items[-1].args[0] + item.args[0],))
                    elif item.kind != "text" or item.args[0]:
                        items.append(item)
            return Node("block", tuple(items))
    return Node(node.kind, args)


# Closures

#: A rendered template comes as (text, is it generated?) in pieces.
Pieces = Iterator[tuple[str, bool]]


def _value(node: Node) -> Callable[[dict], object]:
    match node.kind, node.args:
        case "constant", (value,):
            return lambda env: value
        case "name", (name,):
            return lambda env: env[name]
        case "key", (of, name):
            inner = _value(of)

            def key(env):
                found = inner(env)
                if not isinstance(found, dict):
                    raise TemplateError(f"{name!r} is sought in something that has no keys")
                return found[name]

            return key
        case "filter", (of, name):
            inner, function = _value(of), FILTERS[name]
            return lambda env: function(str(inner(env)))
        case "not", (of,):
            inner = _value(of)
            return lambda env: not inner(env)
        case "binary", ("and", a, b):
            left, right = _value(a), _value(b)
            return lambda env: left(env) and right(env)
        case "binary", ("or", a, b):
            left, right = _value(a), _value(b)
            return lambda env: left(env) or right(env)
        case "binary", (sign, a, b):
            left, right = _value(a), _value(b)
            return lambda env: _operate(sign, left(env), right(env))
    raise TemplateError(f"no value: {node.kind}")


def _render(node: Node, generated: bool) -> Callable[[dict], Pieces]:
    match node.kind, node.args:
        case "text", (text,):
            pieces = ((text, generated),)
            return lambda env: iter(pieces)
        case "write", (of,):
            value = _value(of)
            return lambda env: iter(((str(value(env)), generated),))
        case "generation", (body,):
            return _render(body, True)
        case "if", (test, body, other):
            test, yes, no = _value(test), _render(body, generated), _render(other, generated)
            return lambda env: yes(env) if test(env) else no(env)
        case "for", (name, of, body):
            values, inner = _value(of), _render(body, generated)

            def loop(env):
                for item in values(env):
                    yield from inner({**env, name: item})

            return loop
        case "block", items:
            parts = [_render(i, generated) for i in items]

            def block(env):
                for part in parts:
                    yield from part(env)

            return block
    raise TemplateError(f"not a statement: {node.kind}")


def compile_template(template: str) -> Callable[[Iterable[dict]], Pieces]:
    """turns (dictionaries with role and text) to pieces of the formatted conversation."""
    run = _render(fold(parse(template)), False)
    return lambda turns: run({"turns": turns})


# Reading back

TURN = re.compile(r"<turn>### ((?:[^:\\]|\\.)*): (.*)</turn>\n", re.S)


def read_back(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, int]]:
    """role, text and formatted length of each turn, from the formatted pieces alone."""
    held = ""
    for text, _ in pieces:
        held += text
        if held.endswith("</turn>\n"):
            if not (m := TURN.fullmatch(held)):
                raise ValueError("a formatted turn can't be read")
            yield untitle(unescape(m[1])), unescape(m[2]), len(held)
            held = ""
    if held:
        raise ValueError("a formatted turn has no end")


def format_text(turns: Iterable[dict], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss mask."""
    text, spans, at = [], [], 0
    for piece, generated in compile_template(template)(turns):
        if generated and piece:
            spans.append((at, at + len(piece)))
        text.append(piece)
        at += len(piece)
    return "".join(text), spans


def digest(render: Callable, turns: Iterable[dict]) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; a turn is held at a time."""
    all_turns, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0

    def masked() -> Pieces:
        nonlocal loss_chars
        for piece, generated in render(turns):
            if generated:
                learned = unescape(piece)
                loss_chars += len(learned)
                loss.update(learned.encode())
            yield piece, generated

    for role, text, length in read_back(masked()):
        n, chars = n + 1, chars + length
        all_turns.update(f"{role}\n{text}\n".encode())
    return n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars


# Spark


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, in order, by Spark's external sort."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Neighbouring rows of a conversation; each must be read to its end before the next."""
    rows = _rows(batches)
    ahead = next(rows, None)
    while ahead is not None:
        conv_id = ahead[0]

        def turns():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv_id:  # noqa: B023
                yield {"role": ahead[1], "text": ahead[2]}
                ahead = next(rows, None)

        yield conv_id, turns()


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss array<struct<start, stop>>: the texts themselves."""
    parse(template)

    def run(batches):
        for conv_id, turns in _conversations(batches):
            text, spans = format_text(turns, template)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv_id, "formatted": text, "loss": [{"start": a, "stop": b} for a, b in spans]}],
                schema=pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]),
            )

    return ordered_turns(conversations).mapInArrow(run, "conv_id long, formatted string, loss array<struct<start:long,stop:long>>")


def digest_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation, read back from its formatted form."""
    names = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(", ")]

    def run(batches):
        render, out = compile_template(template), []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for conv_id, turns in _conversations(batches):
            out.append((conv_id, *digest(render, turns)))
            if len(out) == 1000:
                yield send()
                out.clear()
        if out:
            yield send()

    return ordered_turns(conversations).mapInArrow(run, SCHEMA)
