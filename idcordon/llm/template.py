"""A small, sandboxed template language, compiled to Python closures.

``{{ expr }}`` prints; ``{% for x in expr %} .. {% endfor %}``, ``{% if %} .. {% elif %} ..
{% else %} .. {% endif %}``, ``{% set x = expr %}`` and ``{% generation %} ..
{% endgeneration %}`` (text the model is to learn) steer; ``{# .. #}`` is a comment; ``-``
beside a brace strips white space. Expressions know strings, integers, true, false, none,
names, ``a.b``, ``a['b']``, ``+ - * ~``, comparisons, ``in``, ``and or not``, ``loop.index``,
``loop.first``, ``loop.last`` and filters.

A template can reach only the values it is given: a dot reads a key of a mapping, there are no
calls, no attributes of Python objects and no imports. Source is parsed to a tree, constant
parts of the tree are computed once, and each node becomes a closure that yields its text, so
that a conversation of any length is rendered turn by turn.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The source is no template of this language, or a value has the wrong kind."""


#: What rendering yields besides strings: the model's part begins and ends.
BEGIN, END = object(), object()


# ---------------------------------------------------------------- tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Let:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} can't be printed")


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"{key!r} of a {type(of).__name__}")


_OPS: dict[str, Callable[..., Any]] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "~": lambda a, b: _text(a) + _text(b),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt,
    ">=": operator.ge, "in": lambda a, b: a in b, "not": operator.not_, "neg": operator.neg,
}

FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
    "default": lambda x, other: other if x is None else x,
    "replace": lambda x, old, new: _text(x).replace(old, new),
}


# ---------------------------------------------------------------- parser

_TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)"
    r"|(?P<op>==|!=|<=|>=|[-+*~<>|.,()\[\]=]))",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:].strip()[:20]!r}")
        at = m.end()
        if m["str"] is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m["str"][1:-1], flags=re.S)))
        elif m["int"] is not None:
            out.append(("const", int(m["int"])))
        else:
            out.append(("op", m["op"]) if m["op"] else ("name", m["name"]))
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*",))

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> Any:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" else None

    def take(self, *wanted: str) -> Any:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def end(self, node: Any) -> Any:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def parse(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.level(0)

    def level(self, k: int) -> Any:
        if k == len(self.LEVELS):
            return self.filtered()
        left = self.level(k + 1)
        while kind := self.take(*self.LEVELS[k]):
            left = Op(kind, (left, self.level(k + 1)))
        return left

    def filtered(self) -> Any:
        node = Op("neg", (self.filtered(),)) if self.take("-") else self.reached()
        while self.take("|"):
            name, args = self.name(), [node]
            if self.take("("):
                while not self.take(")"):
                    args.append(self.parse())
                    if not self.take(","):
                        self.need(")")
                        break
            node = Filter(name, tuple(args))
        return node

    def reached(self) -> Any:
        node = self.atom()
        while True:
            if self.take("."):
                node = Item(node, Const(self.name()))
            elif self.take("["):
                node = Item(node, self.parse())
                self.need("]")
            else:
                return node

    def atom(self) -> Any:
        if self.take("("):
            node = self.parse()
            self.need(")")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        name = self.name()
        fixed = {"true": True, "false": False, "none": None}
        return Const(fixed[name]) if name in fixed else Name(name)


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(text | print | tag, content) in order, white space control applied."""
    at, strip = 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if m and m[0].endswith("-") else text
        if not m:
            return
        close = {"{": "}}", "%": "%}", "#": "#}"}[m[0][1]]
        end = source.find(close, m.end())
        if end < 0:
            raise TemplateError(f"{m[0]!r} has no end")
        inner = source[m.end() : end]
        strip = inner.endswith("-")
        if close != "#}":
            yield "print" if close == "}}" else "tag", inner[:-1] if strip else inner
        at = end + 2


@dataclass
class _Parser:
    pieces: Iterator[tuple[str, str]]
    last: str = ""
    rest: str = ""
    depth: int = field(default=0)

    def until(self, *ends: str) -> tuple:
        out: list[Any] = []
        for kind, content in self.pieces:
            if kind == "text":
                if content:
                    out.append(Print(Const(content)))
                continue
            if kind == "print":
                e = _Expression(content)
                out.append(Print(e.end(e.parse())))
                continue
            word, _, rest = content.strip().partition(" ")
            if word in ends:
                self.last, self.rest = word, rest
                return tuple(out)
            out.append(self.statement(word, rest))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} expected")
        return tuple(out)

    def statement(self, word: str, rest: str) -> Any:
        e = _Expression(rest)
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.end(e.parse())
            return Loop(name, over, self.until("endfor"))
        if word == "if":
            return self.choice(e)
        if word == "set":
            name = e.name()
            e.need("=")
            return Let(name, e.end(e.parse()))
        if word == "generation":
            return Generation(self.until("endgeneration"))
        raise TemplateError(f"unknown tag {word!r}")

    def choice(self, e: _Expression) -> Choice:
        test = e.end(e.parse())
        then, other = self.until("elif", "else", "endif"), ()
        if self.last == "elif":
            other = (self.choice(_Expression(self.rest)),)
        elif self.last == "else":
            other = self.until("endif")
        return Choice(test, then, other)


def parse(source: str) -> tuple:
    return _Parser(_pieces(source)).until()


# ---------------------------------------------------------------- constants


def fold(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Any:
    """The same tree with all that doesn't depend on the input computed."""
    if isinstance(node, tuple):
        return _folded_body(node, filters)
    if isinstance(node, (Op, Filter)):
        args = tuple(fold(a, filters) for a in node.args)
        node = type(node)(getattr(node, "kind", None) or node.name, args)
        if all(isinstance(a, Const) for a in args):
            return Const(_expression(node, filters)({}))
        return node
    if isinstance(node, Item):
        node = Item(fold(node.of, filters), fold(node.key, filters))
        return Const(_item(node.of.value, node.key.value)) if isinstance(node.of, Const) and isinstance(node.key, Const) else node
    if isinstance(node, Print):
        value = fold(node.value, filters)
        return Print(Const(_text(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Choice):
        return Choice(fold(node.test, filters), fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, Let):
        return Let(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def _folded_body(body: tuple, filters: Mapping[str, Callable[..., Any]]) -> tuple:
    out: list[Any] = []
    for node in body:
        node = fold(node, filters)
        chosen = (node,)
        if isinstance(node, Choice) and isinstance(node.test, Const):
            chosen = node.then if node.test.value else node.other
        for x in chosen:
            fixed = isinstance(x, Print) and isinstance(x.value, Const)
            if fixed and out and isinstance(out[-1], Print) and isinstance(out[-1].value, Const):
                out[-1] = Print(Const(out[-1].value.value + x.value.value))
            else:
                out.append(x)
    return tuple(out)


# ---------------------------------------------------------------- closures

Scope = dict[str, Any]


def _expression(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _expression(node.of, filters), _expression(node.key, filters)
        return lambda scope: _item(of(scope), key(scope))
    args = [_expression(a, filters) for a in node.args]
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        call = filters[node.name]
        return lambda scope: call(*[a(scope) for a in args])
    if node.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    call = _OPS[node.kind]
    return lambda scope: call(*[a(scope) for a in args])


def _looked_ahead(items: Iterable[Any]) -> Iterator[tuple[Any, bool]]:
    """Each item, and whether it is the last."""
    held: list[Any] = []
    for x in items:
        if held:
            yield held.pop(), False
        held.append(x)
    if held:
        yield held.pop(), True


def _statement(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Callable[[Scope], Iterator[Any]]:
    if isinstance(node, tuple):
        parts = [_statement(x, filters) for x in node]

        def sequence(scope: Scope) -> Iterator[Any]:
            for part in parts:
                yield from part(scope)

        return sequence
    if isinstance(node, Print):
        value = _expression(node.value, filters)

        def show(scope: Scope) -> Iterator[Any]:
            yield _text(value(scope))

        return show
    if isinstance(node, Let):
        name, value = node.name, _expression(node.value, filters)

        def put(scope: Scope) -> Iterator[Any]:
            scope[name] = value(scope)
            return iter(())

        return put
    if isinstance(node, Generation):
        body = _statement(node.body, filters)

        def marked(scope: Scope) -> Iterator[Any]:
            yield BEGIN
            yield from body(scope)
            yield END

        return marked
    if isinstance(node, Choice):
        test, then, other = _expression(node.test, filters), _statement(node.then, filters), _statement(node.other, filters)
        return lambda scope: then(scope) if test(scope) else other(scope)
    name, over, body = node.name, _expression(node.over, filters), _statement(node.body, filters)

    def loop(scope: Scope) -> Iterator[Any]:
        items = over(scope)
        if isinstance(items, (str, Mapping)) or not isinstance(items, Iterable):
            raise TemplateError(f"can't go through a {type(items).__name__}")
        for k, (item, last) in enumerate(_looked_ahead(items)):
            yield from body(scope | {name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": last}})

    return loop


def compile_template(source: str, **more: Callable[..., Any]) -> Callable[..., Iterator[Any]]:
    """``render(name=value, ..)`` that yields strings, BEGIN and END. ``more``: further filters."""
    filters = FILTERS | more
    run = _statement(fold(parse(source), filters), filters)
    return lambda **values: run(dict(values))
