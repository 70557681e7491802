"""A small sandboxed template language, compiled to Python closures.

Text stands for itself; ``{{ expression }}`` prints; ``{% for m in messages %}``,
``{% if … %} {% elif … %} {% else %} {% endif %}`` and ``{% generation %} …
{% endgeneration %}`` (text the model is trained on) structure it. Expressions
have strings, integers, names with fields, ``~``, ``==``, ``!=``, ``not``,
``and``, ``or``, parentheses and the filters given to the compiler. There are no
calls, no indexing and no attributes but the fields listed here, so a template
can neither reach Python nor loop without end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

FIELDS = {"message": ("role", "text"), "loop": ("first", "last", "index")}


class TemplateError(ValueError):
    """The template is not of this language."""


# Syntax tree. An expression is Const, Field, Filter or Operation; the others are statements.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    owner: str
    name: str


@dataclass(frozen=True)
class Filter:
    name: str
    value: object


@dataclass(frozen=True)
class Operation:
    name: str
    values: tuple


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# a comment, a value to print or a statement; a hyphen inside takes the white space outside away
_PARTS = re.compile(r"\{#.*?#\}|\{\{-?(?P<print>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[~.|()]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'"}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str, variable: str | None):
        self.variable, self.tokens, at, source = variable, [], 0, source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unknown sign at {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()

    def take(self, *values: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "string" and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def whole(self):
        value = self.disjunction()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return value

    def _chain(self, sign: str, lower: Callable):
        values = [lower()]
        while self.take(sign):
            values.append(lower())
        return values[0] if len(values) == 1 else Operation(sign, tuple(values))

    def disjunction(self):
        return self._chain("or", lambda: self._chain("and", self.negation))

    def negation(self):
        return Operation("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        left = self._chain("~", self.filtered)
        sign = self.take("==", "!=")
        return Operation(sign, (left, self._chain("~", self.filtered))) if sign else left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            value = Filter(self.name(), value)
        return value

    def name(self) -> str:
        if not self.tokens or self.tokens[0][0] != "name":
            raise TemplateError("a name is missing")
        return self.tokens.pop(0)[1]

    def atom(self):
        if self.take("("):
            value = self.disjunction()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return value
        if not self.tokens:
            raise TemplateError("a value is missing")
        kind, token = self.tokens.pop(0)
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), token[1:-1]))
        if kind == "int":
            return Const(int(token))
        if kind == "name" and token in ("true", "false"):
            return Const(token == "true")
        owner = "message" if token == self.variable else token if token == "loop" and self.variable else None
        if kind != "name" or owner is None or not self.take("."):
            raise TemplateError(f"unknown name {token!r}")
        field = self.name()
        if field not in FIELDS[owner]:
            raise TemplateError(f"unknown field {token}.{field}")
        return Field(owner, field)


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    parts, at, cut = [], 0, False

    def text(end: int, cut_end: bool) -> tuple[str, str]:
        own = source[at:end].lstrip() if cut else source[at:end]
        return "text", own.rstrip() if cut_end else own

    for found in _PARTS.finditer(source):
        parts.append(text(found.start(), found[0][2] == "-"))
        if found.lastgroup:
            parts.append((found.lastgroup, found[found.lastgroup].strip()))
        at, cut = found.end(), found[0][-3] == "-"
    parts.append(text(len(source), False))
    position = 0

    def block(variable: str | None, *ends: str) -> tuple[tuple, str]:
        nonlocal position
        body: list = []
        while position < len(parts):
            kind, value = parts[position]
            position += 1
            if kind == "text":
                body.append(Print(Const(value)))
            elif kind == "print":
                body.append(Print(_Expression(value, variable).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(body), value
                body.append(statement(word, rest.strip(), variable))
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return tuple(body), ""

    def condition(rest: str, variable: str | None) -> If:
        test = _Expression(rest, variable).whole()
        then, end = block(variable, "endif", "else", "elif")
        if end.startswith("elif"):
            return If(test, then, (condition(end[4:], variable),))
        return If(test, then, block(variable, "endif")[0] if end == "else" else ())

    def statement(word: str, rest: str, variable: str | None):
        if word == "if":
            return condition(rest, variable)
        if word == "generation" and not rest:
            return Generation(block(variable, "endgeneration")[0])
        loop = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest)
        if word == "for" and loop and variable is None and loop[1] != "loop":
            return Loop(block(loop[1], "endfor")[0])
        raise TemplateError(f"unknown statement {word} {rest}")

    return block(None)[0]


_OPERATIONS: dict[str, Callable] = {
    "~": lambda *v: "".join(map(_text, v)),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "not": lambda a: not a,
}


def _text(value: object) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def fold(node, filters: dict[str, Callable]):
    """The tree with everything constant worked out, and constant texts joined."""
    if isinstance(node, tuple):
        found: list = []
        for child in node:
            child = fold(child, filters)
            for part in child if isinstance(child, tuple) else (child,):
                if isinstance(part, Print) and isinstance(part.value, Const):
                    text = _text(part.value.value)
                    if found and isinstance(found[-1], Print) and isinstance(found[-1].value, Const):
                        text = found.pop().value.value + text
                    part = Print(Const(text))
                    if not text:
                        continue
                found.append(part)
        return tuple(found)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        value = fold(node.value, filters)
        return Const(filters[node.name](_text(value.value))) if isinstance(value, Const) else Filter(node.name, value)
    if isinstance(node, Operation):
        values = tuple(fold(v, filters) for v in node.values)
        if node.name in ("and", "or"):
            stop = node.name == "or"
            # constants that don't decide drop out unless they come last, one that decides ends the chain
            kept = []
            for place, value in enumerate(values):
                if isinstance(value, Const) and bool(value.value) != stop and place < len(values) - 1:
                    continue
                kept.append(value)
                if isinstance(value, Const):
                    break
            return kept[0] if len(kept) == 1 else Operation(node.name, tuple(kept))
        if all(isinstance(v, Const) for v in values):
            return Const(_OPERATIONS[node.name](*(v.value for v in values)))
        return Operation(node.name, values)
    if isinstance(node, Print):
        return Print(fold(node.value, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, (Loop, Generation)):
        return type(node)(fold(node.body, filters))
    return node


def _value(node, filters: dict[str, Callable]) -> Callable:
    """Closure from (message, loop) to the value of an expression."""
    if isinstance(node, Const):
        constant = node.value
        return lambda message, loop: constant
    if isinstance(node, Field):
        name = node.name
        return (lambda message, loop: message[name]) if node.owner == "message" else (lambda message, loop: loop[name])
    if isinstance(node, Filter):
        apply, inner = filters[node.name], _value(node.value, filters)
        return lambda message, loop: apply(_text(inner(message, loop)))
    values = [_value(v, filters) for v in node.values]
    if node.name in ("and", "or"):
        return _deciding(values, node.name == "or")
    operation = _OPERATIONS[node.name]
    return lambda message, loop: operation(*[v(message, loop) for v in values])


def _deciding(values: list[Callable], stop: bool) -> Callable:
    """The first value that decides an ``and`` or ``or``, else the last."""
    *early, last = values

    def decide(message, loop):
        for value in early:
            found = value(message, loop)
            if bool(found) == stop:
                return found
        return last(message, loop)

    return decide


class Output:
    """Text printed so far, and the ranges of it that lie in generation blocks."""

    def __init__(self):
        self.texts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)


def _writer(nodes: tuple, filters: dict[str, Callable]) -> Callable:
    """Closure from (output, message, loop) that prints statements."""
    steps: list[Callable] = []
    for node in nodes:
        if isinstance(node, Print):
            value = _value(node.value, filters)
            steps.append(lambda out, message, loop, value=value: out.add(_text(value(message, loop))))
        elif isinstance(node, If):
            test, then, other = _value(node.test, filters), _writer(node.then, filters), _writer(node.other, filters)
            steps.append(lambda out, m, l, test=test, then=then, other=other: (then if test(m, l) else other)(out, m, l))
        elif isinstance(node, Generation):
            inner = _writer(node.body, filters)

            def marked(out, message, loop, inner=inner):
                start = out.size
                inner(out, message, loop)
                out.spans.append((start, out.size))

            steps.append(marked)
        else:
            raise TemplateError("a loop may only stand at the outermost level")

    def write(out, message, loop):
        for step in steps:
            step(out, message, loop)

    return write


class Template:
    """A compiled template: closures for what precedes its loop, one turn, and what follows."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tree = fold(parse(source), filters)
        loops = [i for i, node in enumerate(self.tree) if isinstance(node, Loop)]
        if len(loops) != 1:
            raise TemplateError("one loop over messages is needed")
        at = loops[0]
        self.before, self.after = _writer(self.tree[:at], filters), _writer(self.tree[at + 1 :], filters)
        self.turn = _writer(self.tree[at].body, filters)

    def segment(self, role: str, text: str, index: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """What one turn adds to the output, and its generation ranges in that."""
        out, message, loop = Output(), {"role": role, "text": text}, {"first": index == 0, "last": last, "index": index + 1}
        if index == 0:
            self.before(out, message, loop)
        self.turn(out, message, loop)
        if last:
            self.after(out, message, loop)
        return "".join(out.texts), out.spans

    def render(self, messages: Iterable[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """The segments of a conversation, one turn behind its messages."""
        held, index = None, 0
        for message in messages:
            if held is not None:
                yield self.segment(*held, index, False)
                index += 1
            held = message
        if held is not None:
            yield self.segment(*held, index, True)
