"""Chat formatting: templates compiled to closures, streamed over conversations.

The template language is sandboxed: names, keys and list positions can be looked
up, a fixed list of filters applied and operators used; no attribute, method or
module of Python is in reach. A template is parsed into a syntax tree, constant
parts are folded, and each node becomes a closure that emits text. Text emitted
inside ``{% generation %}`` is under the loss mask.

A conversation is rendered turn by turn from its sorted rows, so that neither its
turns nor its formatted text is ever held whole. It becomes one or more pieces
(rows) whose texts follow each other; ``loss`` has the masked spans of a piece.

Edge cases: null role or text is empty, turns of the same number are ordered by
role and text (repeated rows are kept), null turns come first, rows with a null
conversation id form a conversation of their own, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from calltide.llm.common import batches_of

# The control strings of the default template, and the mark that escapes them.
CONTROL = ("###", "</turn>")
TEMPLATE = """\
{%- for message in messages -%}
### {{ message.role | name }}:
{% if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif %}</turn>
{% endfor -%}
"""

_ESCAPED = re.compile(r"\\|###|</turn>")
_NAME_ESCAPED = re.compile(r"\\|###|</turn>|:|\n")
_UNESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")


def escape(text: str) -> str:
    """``text`` with a backslash before every control string and backslash."""
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "name": lambda x: _NAME_ESCAPED.sub(r"\\\g<0>", x),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "title": lambda x: str(x).title(),
    "length": len,
    "tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "default": lambda x, other="": other if x is None else x,
    "join": lambda x, by="": by.join(map(_text, x)),
    "replace": lambda x, old, new: str(x).replace(old, new),
    "first": lambda x: x[0] if x else None,
    "last": lambda x: x[-1] if x else None,
}


class TemplateError(ValueError):
    pass


def _text(value) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


# --- Parsing ---------------------------------------------------------------

_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<text>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<number>\d+(?:\.\d+)?)"
    r"|(?P<word>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[-+~*%<>()\[\].,|]))"
)
_LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_SLASHED = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(source.rstrip()):
        found = _TOKEN.match(source, at)
        if not found:
            raise TemplateError(f"cannot read {source[at : at + 20]!r}")
        kind, value = found.lastgroup, found.group(found.lastgroup)
        if kind == "text":
            value = re.sub(r"\\(.)", lambda m: _SLASHED.get(m[1], m[1]), value[1:-1])
        elif kind == "number":
            value = float(value) if "." in value else int(value)
        out.append((kind, value))
        at = found.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~", "+", "-"), ("*", "%"))

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *values) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "mark") and (
            self.tokens[self.at][1] in values
        )

    def take(self, *values) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.level(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def level(self, depth: int):
        if depth == len(self.LEVELS):
            return self.unary()
        if depth == 2 and self.take("not"):
            return ("not", self.level(2))
        left = self.level(depth + 1)
        while True:
            if depth == 2 and self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                operator = "not in"
            elif self.peek(*self.LEVELS[depth]):
                operator = self.tokens[self.at][1]
                self.at += 1
            else:
                return left
            left = ("binary", operator, left, self.level(depth + 1))

    def unary(self):
        if self.take("-"):
            return ("negative", self.unary())
        node = self.atom()
        while True:
            if self.take("."):
                node = ("item", node, ("literal", self.word()))
            elif self.take("["):
                node = ("item", node, self.level(0))
                self.need("]")
            elif self.take("|"):
                name, arguments = self.word(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        arguments.append(self.level(0))
                        if not self.peek(")"):
                            self.need(",")
                node = ("filter", name, node, tuple(arguments))
            else:
                return node

    def atom(self):
        if self.take("("):
            node = self.level(0)
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("text", "number"):
            return ("literal", value)
        if kind == "word":
            return ("literal", _LITERALS[value]) if value in _LITERALS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """Syntax tree of a template: a ("block", nodes) tuple."""
    parts = _PARTS.split(source)
    for k in range(1, len(parts), 2):  # white space control
        if parts[k][2] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3] == "-" and len(parts[k]) > 5:
            parts[k + 1] = parts[k + 1].lstrip()
    stack: list[list] = [[]]
    opened: list[list] = []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            if part:
                stack[-1].append(("text", part))
            continue
        inner = part[2:-2].removeprefix("-").removesuffix("-").strip()
        if part[1] == "#":
            continue
        if part[1] == "{":
            stack[-1].append(("output", _Expression(inner).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "for":
            name, found, over = rest.partition(" in ")
            if not found or not name.strip().isidentifier():
                raise TemplateError(f"for {rest!r}")
            opened.append(["for", name.strip(), _Expression(over).whole()])
            stack.append([])
        elif word == "if":
            opened.append(["if", [], _Expression(rest).whole()])
            stack.append([])
        elif word in ("elif", "else") and opened and opened[-1][0] == "if":
            opened[-1][1].append((opened[-1][2], ("block", tuple(stack.pop()))))
            opened[-1][2] = _Expression(rest).whole() if word == "elif" else ("literal", True)
            stack.append([])
        elif word == "generation":
            opened.append(["generation"])
            stack.append([])
        elif word == "set":
            name, found, value = rest.partition("=")
            if not found or not name.strip().isidentifier():
                raise TemplateError(f"set {rest!r}")
            stack[-1].append(("set", name.strip(), _Expression(value).whole()))
        elif word.startswith("end") and opened and opened[-1][0] == word[3:]:
            body, start = ("block", tuple(stack.pop())), opened.pop()
            if start[0] == "for":
                stack[-1].append(("for", start[1], start[2], body))
            elif start[0] == "if":
                stack[-1].append(("if", (*start[1], (start[2], body))))
            else:
                stack[-1].append(("generation", body))
        else:
            raise TemplateError(f"unexpected {{% {inner} %}}")
    if opened:
        raise TemplateError(f"{opened[-1][0]} is not closed")
    return ("block", tuple(stack[0]))


# --- Folding ---------------------------------------------------------------


def fold(node: tuple) -> tuple:
    """``node`` with constant expressions computed, constant branches chosen and
    neighbouring texts joined."""
    kind = node[0]
    if kind in ("literal", "name", "text"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1]):
            for one in child[1] if child[0] == "block" else (child,):
                if one[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + one[1])
                elif one != ("text", ""):
                    out.append(one)
        return ("block", tuple(out))
    if kind == "output":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "literal" else ("output", inner)
    if kind == "if":
        branches = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "literal" and not test[1]:
                continue
            branches.append((test, fold(body)))
            if test[0] == "literal":
                break
        if not branches:
            return ("block", ())
        return branches[0][1] if branches[0][0][0] == "literal" else ("if", tuple(branches))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    parts = tuple(fold(x) if isinstance(x, tuple) and x and isinstance(x[0], str) else x for x in node[1:])
    if kind == "filter":
        parts = (node[1], parts[1], tuple(map(fold, node[3])))
        constant = all(x[0] == "literal" for x in (parts[1], *parts[2]))
    else:
        constant = all(x[0] == "literal" for x in parts if isinstance(x, tuple))
    node = (kind, *parts)
    return ("literal", _value(node)({})) if constant else node


# --- Closures --------------------------------------------------------------


def _item(whole, key):
    if isinstance(whole, dict):
        return whole.get(key)
    if isinstance(whole, (list, tuple, str)) and isinstance(key, int) and -len(whole) <= key < len(whole):
        return whole[key]
    return None


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if not isinstance(a, str) and not isinstance(b, str) else _no("* on text"),
    "%": lambda a, b: a % b if not isinstance(a, str) else _no("% on text"),
}


def _no(what: str):
    raise TemplateError(what)


def _value(node: tuple) -> Callable[[dict], object]:
    """Closure that computes an expression from the variables."""
    kind = node[0]
    if kind == "literal":
        constant = node[1]
        return lambda names: constant
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "item":
        whole, key = _value(node[1]), _value(node[2])
        return lambda names: _item(whole(names), key(names))
    if kind == "filter":
        apply, inner, more = FILTERS[node[1]], _value(node[2]), tuple(map(_value, node[3]))
        if not more:
            return lambda names: apply(inner(names))
        return lambda names: apply(inner(names), *(x(names) for x in more))
    if kind == "not":
        inner = _value(node[1])
        return lambda names: not inner(names)
    if kind == "negative":
        inner = _value(node[1])
        return lambda names: -inner(names)
    operator, left, right = node[1], _value(node[2]), _value(node[3])
    if operator == "and":
        return lambda names: left(names) and right(names)
    if operator == "or":
        return lambda names: left(names) or right(names)
    apply = _BINARY[operator]
    return lambda names: apply(left(names), right(names))


Emitted = Iterator[tuple[str, bool]]


def _render(node: tuple, masked: bool = False) -> Callable[[dict], Emitted]:
    """Closure that yields (text, under the loss mask) for a node."""
    kind = node[0]
    if kind == "text":
        constant = (node[1], masked)

        def run(names):
            yield constant
    elif kind == "output":
        value = _value(node[1])

        def run(names):
            yield _text(value(names)), masked
    elif kind == "block":
        children = tuple(_render(x, masked) for x in node[1])

        def run(names):
            for child in children:
                yield from child(names)
    elif kind == "generation":
        run = _render(node[1], True)
    elif kind == "set":
        name, value = node[1], _value(node[2])

        def run(names):
            names[name] = value(names)
            return
            yield
    elif kind == "if":
        branches = tuple((_value(test), _render(body, masked)) for test, body in node[1])

        def run(names):
            for test, body in branches:
                if test(names):
                    yield from body(names)
                    return
    else:
        name, over, body = node[1], _value(node[2]), _render(node[3], masked)

        def run(names):
            items, index, nothing = iter(over(names) or ()), 0, object()
            one = next(items, nothing)
            while one is not nothing:
                after = next(items, nothing)
                index += 1
                loop = {"index": index, "index0": index - 1, "first": index == 1, "last": after is nothing}
                yield from body({**names, name: one, "loop": loop})
                one = after

    return run


def compile_template(source: str) -> Callable[[dict], Emitted]:
    """Closure from variables to emitted (text, masked) parts."""
    return _render(fold(parse(source)))


# --- Conversations ---------------------------------------------------------

PIECE_CHARS = 1 << 16
_PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("piece", pa.int64()),
        ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def pieces(emitted: Emitted, limit: int = PIECE_CHARS) -> Iterator[tuple[str, list[dict]]]:
    """Emitted parts as (text, masked spans) of about ``limit`` characters; a piece
    never ends inside the loss mask."""
    held, size, spans, open_ = [], 0, [], False
    for text, masked in emitted:
        if size >= limit and not (masked and open_):
            yield "".join(held), spans
            held, size, spans, open_ = [], 0, [], False
        if masked and open_:
            spans[-1]["stop"] += len(text)
        elif masked:
            spans.append({"start": size, "stop": size + len(text)})
        open_ = masked
        held.append(text)
        size += len(text)
    yield "".join(held), spans


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in names))


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Pieces (conv_id, piece, text, loss) of every conversation, in order within
    the partitions; ``df`` has conv_id, turn, role and text."""
    names = ("conv_id", "turn", "role", "text")
    compile_template(template)  # faults show here, not in the tasks

    def rows(batches):
        render = compile_template(template)
        for key, turns in groupby(_rows(batches, names), key=lambda row: row[0]):
            messages = ({"role": role or "", "text": text or "", "turn": turn} for _, turn, role, text in turns)
            for number, (text, spans) in enumerate(pieces(render({"messages": messages}))):
                yield {"conv_id": key, "piece": number, "text": text, "loss": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), _PIECES, 256)

    ordered = df.select(*names).repartition("conv_id").sortWithinPartitions(*names)
    return ordered.mapInArrow(
        run, "conv_id long, piece long, text string, loss array<struct<start: long, stop: long>>"
    )


_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:|\n)|(?!###|</turn>)[^\\:])*):\n((?:\\(?:\\|###|</turn>)|(?!###|</turn>)[^\\])*+)</turn>\n")


def turns_of(texts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts read back from the pieces of one formatted conversation."""
    rest = ""
    for text in texts:
        rest += text
        at = 0
        while found := _TURN.match(rest, at):
            yield unescape(found[1]), unescape(found[2])
            at = found.end()
        rest = rest[at:]
    if rest:
        raise ValueError(f"not a turn: {rest[:40]!r}")


_READ = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what can be read back from the pieces, which must be
    in order within the partitions, as ``format_conversations`` leaves them."""

    def rows(batches):
        for key, parts in groupby(_rows(batches, ("conv_id", "text", "loss")), key=lambda row: row[0]):
            turns, loss, count, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def texts():
                nonlocal loss_chars, chars
                for _, text, spans in parts:
                    chars += len(text)
                    for span in spans:
                        plain = unescape(text[span["start"] : span["stop"]])
                        loss_chars += len(plain)
                        loss.update(plain.encode())
                    yield text

            for role, text in turns_of(texts()):
                turns.update(f"{role}\n{text}\n".encode())
                count += 1
            yield {
                "conv_id": key,
                "n_turns": count,
                "turns_sha256": turns.hexdigest(),
                "loss_chars": loss_chars,
                "loss_sha256": loss.hexdigest(),
                "formatted_chars": chars,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), _READ)

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
