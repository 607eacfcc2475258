"""Chat formatting: a small template language, compiled to Python closures.

    {{ expression }}  {% for m in messages %} {% endfor %}  {% if e %} {% elif e %}
    {% else %} {% endif %}  {% generation %} {% endgeneration %}

Expressions have names, .fields of messages and of loop (index, index0, first, last),
text, number, true and false literals, + == != in not and or, brackets, and the filters
escape, trim, upper, lower. Nothing else can be reached: a template sees only the
values given to it. Constant parts are folded when it is compiled. A template is
rendered piece by piece, so that a conversation of any length needs little memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabscout.llm.common import text_of

#: Strings that mark turns; inside texts each gets a backslash after its first character.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = ("{% for m in messages %}<s>[INST] {{ m.role | escape }} [/INST]"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
            "{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
_LIKE = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")


def escape(text: str) -> str:
    """Put a backslash into every control string, and one more where there are some: unescape() undoes it."""
    return _LIKE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": lambda s: str(s).strip(), "upper": lambda s: str(s).upper(), "lower": lambda s: str(s).lower()}
_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|().+]))")
Value = Callable[[dict], object]


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass
class Const:
    """An expression whose value is known."""
    value: object

    def closure(self) -> Value:
        value = self.value
        return lambda env: value


@dataclass
class Call:
    """An operation on expressions; `run` takes their values."""
    run: Callable[..., object]
    args: list

    def closure(self) -> Value:
        run, args = self.run, [a.closure() for a in self.args]
        if len(args) == 1:
            (one,) = args
            return lambda env: run(one(env))
        first, second = args
        return lambda env: run(first(env), second(env))


@dataclass
class Either:
    """and, or: the second side is looked at only if needed."""
    first: object
    second: object
    stop: bool

    def closure(self) -> Value:
        first, second, stop = self.first.closure(), self.second.closure(), self.stop
        return lambda env: x if bool(x := first(env)) is stop else second(env)


@dataclass
class Name:
    name: str

    def closure(self) -> Value:
        name = self.name
        return lambda env: env[name]


def fold(node: object) -> object:
    """A constant where all parts are."""
    if isinstance(node, Call) and all(isinstance(a, Const) for a in node.args):
        return Const(node.run(*[a.value for a in node.args]))
    if isinstance(node, Either) and isinstance(node.first, Const):
        return node.first if bool(node.first.value) is node.stop else node.second
    return node


class Expression:
    """A recursive-descent parser; `names` are those that may be used."""

    def __init__(self, text: str, names: set[str]) -> None:
        self.tokens, self.names, at, text = [], names, 0, text.strip()
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise TemplateError(f"not understood: {text[at:]}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> object:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]}")
        return node

    def either(self) -> object:
        node = self.both()
        while self.take("or"):
            node = fold(Either(node, self.both(), True))
        return node

    def both(self) -> object:
        node = self.negated()
        while self.take("and"):
            node = fold(Either(node, self.negated(), False))
        return node

    def negated(self) -> object:
        return fold(Call(lambda x: not x, [self.negated()])) if self.take("not") else self.compared()

    def compared(self) -> object:
        node = self.sum()
        while op := self.take("==", "!=", "in"):
            run = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b}[op]
            node = fold(Call(run, [node, self.sum()]))
        return node

    def sum(self) -> object:
        node = self.filtered()
        while self.take("+"):
            node = fold(Call(lambda a, b: a + b, [node, self.filtered()]))
        return node

    def filtered(self) -> object:
        node = self.atom()
        while True:
            if self.take("|"):
                name = self.word()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                node = fold(Call(FILTERS[name], [node]))
            elif self.take("."):
                key = self.word()
                node = Call(lambda d, key=key: d[key], [node])
            else:
                return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> object:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(token))
        if token in ("true", "false"):
            return Const(token == "true")
        if kind != 3 or token not in self.names:
            raise TemplateError(f"unknown: {token}")
        return Name(token)


@dataclass
class Block:
    """What a tag holds; loops have name and source, choices have branches."""
    kind: str
    children: list = field(default_factory=list)
    name: str = ""
    source: object = None
    branches: list = field(default_factory=list)


Piece = tuple[str, bool]
Render = Callable[[dict, bool], Iterator[Piece]]


class Template:
    """A compiled template; render() gives pieces of text and whether each is under the loss mask."""

    def __init__(self, text: str, names: Iterable[str] = ("messages",)) -> None:
        self.tree = self.parse(text, set(names))
        self.run = self.children(self.tree.children)

    def parse(self, text: str, names: set[str]) -> Block:
        root = Block("root")
        stack, at = [root], 0

        def add(node: object) -> None:
            to = stack[-1].branches[-1][1] if stack[-1].kind == "if" else stack[-1].children
            if isinstance(node, Const) and to and isinstance(to[-1], Const):
                to[-1] = Const(str(to[-1].value) + str(node.value))
            elif not isinstance(node, Const) or node.value != "":
                to.append(node)

        for m in _PARTS.finditer(text):
            add(Const(text[at:m.start()]))
            at = m.end()
            if m[1] is not None:
                add(Expression(m[1], names).whole())
                continue
            word, _, rest = m[2].strip().partition(" ")
            top = stack[-1]
            if word == "for":
                name, found, source = rest.partition(" in ")
                name = name.strip()
                if not found or not name.isidentifier() or name in names:
                    raise TemplateError(f"not a loop: {rest}")
                stack.append(Block("for", name=name, source=Expression(source, names).whole()))
                names |= {name, "loop"}
            elif word == "if":
                stack.append(Block("if", branches=[(Expression(rest, names).whole(), [])]))
            elif word in ("elif", "else") and top.kind == "if":
                top.branches.append((Const(True) if word == "else" else Expression(rest, names).whole(), []))
            elif word == "generation":
                stack.append(Block("generation"))
            elif word.startswith("end") and top.kind == word[3:]:
                stack.pop()
                if top.kind == "for":
                    names.discard(top.name)
                    if not any(b.kind == "for" for b in stack):
                        names.discard("loop")
                add(top)
            else:
                raise TemplateError(f"unexpected tag: {word}")
        add(Const(text[at:]))
        if len(stack) > 1:
            raise TemplateError(f"{stack[-1].kind} is open")
        return root

    def children(self, nodes: list) -> Render:
        parts = [self.node(n) for n in nodes]

        def run(env: dict, masked: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(env, masked)
        return run

    def node(self, node: object) -> Render:
        if isinstance(node, Const):
            text = str(node.value)
            return lambda env, masked: iter(((text, masked),))
        if not isinstance(node, Block):
            value = node.closure()
            return lambda env, masked: iter(((str(value(env)), masked),))
        if node.kind == "generation":
            inner = self.children(node.children)
            return lambda env, masked: inner(env, True)
        if node.kind == "if":
            return self.choice(node.branches)
        return self.loop(node)

    def choice(self, branches: list) -> Render:
        kept = []
        for test, nodes in branches:  # branches that a constant decides are folded
            if isinstance(test, Const) and not test.value:
                continue
            kept.append((test.closure(), self.children(nodes)))
            if isinstance(test, Const):
                break

        def run(env: dict, masked: bool) -> Iterator[Piece]:
            for test, inner in kept:
                if test(env):
                    yield from inner(env, masked)
                    return
        return run

    def loop(self, node: Block) -> Render:
        source, inner, name, end = node.source.closure(), self.children(node.children), node.name, object()

        def run(env: dict, masked: bool) -> Iterator[Piece]:
            items = iter(source(env))
            item, n = next(items, end), 0
            while item is not end:  # one item ahead, to know the last
                after = next(items, end)
                loop = {"index": n + 1, "index0": n, "first": n == 0, "last": after is end}
                yield from inner(env | {name: item, "loop": loop}, masked)
                item, n = after, n + 1
        return run

    def render(self, **values: object) -> Iterator[Piece]:
        return self.run(values, False)


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn of a formatted conversation, unescaped.

    Takes pieces as they come and keeps no more than one turn. Text that is no turn fails."""
    text, masks = "", []
    for piece, masked in pieces:
        if masked and piece:
            masks.append((len(text), len(text) + len(piece)))
        text += piece
        if not piece.endswith(CONTROL[1]):
            continue
        at = 0
        while m := TURN.match(text, at):
            yield unescape(m[1]), unescape(m[2]), "".join(unescape(text[a:b]) for a, b in masks if at <= a and b <= m.end())
            at = m.end()
        masks = [(a - at, b - at) for a, b in masks if a >= at]
        text = text[at:]
    if text:
        raise ValueError("the end of a turn is missing")


COLUMNS = ("conv", "turn", "role", "text")


def sorted_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    names = (conv_col, turn_col, role_col, text_col)
    rows = conversations.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(names[:2], COLUMNS)],
        *[text_of(f"`{c}`").alias(k) for c, k in zip(names[2:], COLUMNS[2:])])
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Each conversation of sorted rows with its messages as they are read; use up one before the next."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                yield from zip(*[part.column(c).to_pylist() for c in COLUMNS])

    source = rows()
    waiting = [next(source, None)]

    def messages(conv: object) -> Iterator[dict]:
        while waiting[0] is not None and waiting[0][0] == conv:
            _, _, role, text = waiting[0]
            waiting[0] = next(source, None)
            yield {"role": role, "text": text}

    while waiting[0] is not None:
        conv = waiting[0][0]
        yield conv, messages(conv)


def format_turns(conversations: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted text, in order: (conv, piece, text, masked), a row per run of pieces under one mask.

    Rows go by turn, then role and text; null roles and texts are empty, a null turn is
    first, null conversation ids are one conversation. Repeated rows are turns of
    their own. Joined by `piece` the texts are the formatted conversation; a conversation
    is never held whole."""
    compiled = Template(template)
    rows = sorted_turns(conversations, conv_col, turn_col, role_col, text_col)
    conv_type = to_arrow_type(rows.schema["conv"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, messages in by_conversation(batches):
            out, n, size = [], 0, 0
            for text, masked in compiled.render(messages=messages):
                if out and out[-1][3] == masked and size < 1 << 16:
                    out[-1][2].append(text)
                else:
                    if size > 1 << 20:
                        yield pieces(out)
                        out, size = [], 0
                    out.append((conv, n, [text], masked))
                    n += 1
                size += len(text)
            yield pieces(out)

    def pieces(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], conv_type), pa.array(columns[1], pa.int64()),
             pa.array(["".join(t) for t in columns[2]], pa.string()), pa.array(columns[3], pa.bool_())],
            ["conv", "piece", "text", "masked"])

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, piece long, text string, masked boolean")


def digests(conversations: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, read back from its formatted text: conv, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Order, nulls and repeats as in format_turns; no rows give none."""
    compiled = Template(template)
    rows = sorted_turns(conversations, conv_col, turn_col, role_col, text_col)
    conv_type = to_arrow_type(rows.schema["conv"].dataType)
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 6
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        for conv, messages in by_conversation(batches):
            size = [0]

            def counted(pieces: Iterable[Piece]) -> Iterator[Piece]:
                for text, masked in pieces:
                    size[0] += len(text)
                    yield text, masked

            n, loss_chars, turns, loss = 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text, masked in read_back(counted(compiled.render(messages=messages))):
                n += 1
                loss_chars += len(masked)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size[0]))
            if len(out) >= 1000:
                yield batch()
                out = []
        yield batch()

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
