"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}``, ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}`` and
``{% generation %}``, which marks what the model has to learn. It is parsed into a syntax tree, constants are
folded, and the tree becomes Python closures that render a conversation piece by piece. The language is a
sandbox: it reads the given values and their entries, calls nothing, and has the filters listed here.

``escape`` makes control strings in a text harmless and can be undone: a backslash is doubled, and a control
string gets a backslash behind its first character.

A conversation's turns stream through its task in order, one at a time, and the result is cut into segments
between turns, so neither a long conversation nor a hot one is held as a whole.

Defined cases: a null text or role is empty; turns of equal number are ordered by role and text; rows without
conv_id form one conversation without id; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import tasks_of
from vitrine.shared import run_folder, write_out

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TURNS = ("{% for m in messages %}<s>[INST]{{ m.role | escape }}[/INST]"
         "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
         "{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
SEGMENT_CHARS = 1_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


# --- syntax tree -----------------------------------------------------------------
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Entry:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """A built-in function of some expressions."""
    function: Callable
    args: tuple
    lazy: str = ""


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class Choice:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    """The template is not well formed."""


FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt,
           "in": lambda a, b: a in b}
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z]\w*)|(==|!=|<=|>=|[-+~<>.|()\[\]%]))")
_TAG = re.compile(r"\{#.*?#\}|(\{\{|\{%)(-?)(.*?)(-?)(\}\}|%\})", re.S)
_WORDS = {"true": True, "false": False, "none": None}


def fold(node):
    """A function of constants is a constant."""
    if isinstance(node, Apply) and all(isinstance(a, Const) for a in node.args):
        values = [a.value for a in node.args]
        return Const(_lazy(node.lazy, *[lambda v=v: v for v in values]) if node.lazy else node.function(*values))
    return node


def _lazy(kind: str, a: Callable, b: Callable):
    return (a() and b()) if kind == "and" else (a() or b())


class _Expression:
    """Precedence climbing over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()

    def take(self, *signs: str) -> str | None:
        if self.tokens and (self.tokens[0][3] or self.tokens[0][2]) in signs:
            number, text, word, sign = self.tokens.pop(0)
            return sign or word
        return None

    def need(self, *signs: str) -> None:
        if not self.take(*signs):
            raise TemplateError(f"expected {' or '.join(signs)}")

    def whole(self):
        node = self.either()
        if self.tokens:
            raise TemplateError(f"left over: {self.tokens}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = fold(Apply(_lazy, (node, self.both()), "or"))
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = fold(Apply(_lazy, (node, self.negated()), "and"))
        return node

    def negated(self):
        return fold(Apply(operator.not_, (self.negated(),))) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while sign := self.take(*COMPARE):
            node = fold(Apply(COMPARE[sign], (node, self.joined())))
        return node

    def joined(self):
        node = self.filtered()
        while sign := self.take("+", "~", "-", "%"):
            other = self.filtered()
            node = fold(Apply({"+": operator.add, "-": operator.sub, "%": operator.mod,
                               "~": lambda a, b: f"{a}{b}"}[sign], (node, other)))
        return node

    def filtered(self):
        node = self.single()
        while self.take("|"):
            name = self.tokens.pop(0)[2] if self.tokens else None
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = fold(Apply(FILTERS[name], (node,)))
        return node

    def single(self):
        if not self.tokens:
            raise TemplateError("an expression ends too soon")
        number, text, word, sign = self.tokens.pop(0)
        if number:
            node = Const(int(number))
        elif text:
            node = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        elif word:
            node = Const(_WORDS[word]) if word in _WORDS else Name(word)
        elif sign == "(":
            node = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {sign}")
        while sign := self.take(".", "["):
            if sign == ".":
                if not self.tokens or not self.tokens[0][2]:
                    raise TemplateError("a name must follow the dot")
                node = Entry(node, Const(self.tokens.pop(0)[2]))
            else:
                node = Entry(node, self.either())
                self.need("]")
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template, constants folded."""
    parts, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at:m.start()]
        parts.append(("text", (text.lstrip() if trim else text).rstrip() if m[2] else text.lstrip() if trim else text))
        if m[1]:
            parts.append(("show" if m[1] == "{{" else "tag", m[3].strip()))
        at, trim = m.end(), bool(m[4])
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    parts.reverse()

    def body(*ends: str) -> tuple[tuple, str]:
        nodes = []
        while parts:
            kind, value = parts.pop()
            word, _, rest = value.partition(" ")
            if kind == "text":
                nodes += [Const(value)] if value else []
            elif kind == "show":
                nodes.append(_show(_Expression(value).whole()))
            elif word in ends:
                return _joined(nodes), value
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"not a loop: {value}")
                nodes.append(Loop(m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                nodes.extend(branch(rest))
            elif word == "generation":
                nodes.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {value}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return _joined(nodes), ""

    def branch(test: str) -> tuple:
        node = _Expression(test).whole()
        then, end = body("elif", "else", "endif")
        other = (branch(end.partition(" ")[2]) if end.startswith("elif")
                 else body("endif")[0] if end == "else" else ())
        if isinstance(node, Const):
            return then if node.value else other
        return (Choice(node, then, other),)

    return body()[0]


def _show(node):
    return Const(_text(node.value)) if isinstance(node, Const) else Show(node)


def _text(value) -> str:
    return "" if value is None else str(value)


def _joined(nodes: list) -> tuple:
    out: list = []
    for node in nodes:
        if out and isinstance(node, Const) and isinstance(out[-1], Const):
            out[-1] = Const(out[-1].value + node.value)
        else:
            out.append(node)
    return tuple(out)


# --- closures ----------------------------------------------------------------------
def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env: node.value
    if isinstance(node, Name):
        return lambda env: env.get(node.name)
    if isinstance(node, Entry):
        of, key = _value(node.of), _value(node.key)

        def entry(env):
            holder, k = of(env), key(env)
            if isinstance(holder, dict):
                return holder.get(k)
            if isinstance(holder, (list, tuple, str)) and isinstance(k, int) and -len(holder) <= k < len(holder):
                return holder[k]
            return None  # nothing but entries can be reached
        return entry
    args = [_value(a) for a in node.args]
    if node.lazy:
        return lambda env: _lazy(node.lazy, lambda: args[0](env), lambda: args[1](env))
    return lambda env: node.function(*[a(env) for a in args])


def _writer(nodes: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_step(n) for n in nodes]

    def write(env, learnt):
        for step in steps:
            yield from step(env, learnt)
    return write


def _step(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    if isinstance(node, Const):
        return lambda env, learnt: iter(((node.value, learnt),))
    if isinstance(node, Show):
        value = _value(node.value)
        return lambda env, learnt: iter(((_text(value(env)), learnt),))
    if isinstance(node, Generation):
        inner = _writer(node.body)
        return lambda env, learnt: inner(env, True)
    if isinstance(node, Choice):
        test, then, other = _value(node.test), _writer(node.then), _writer(node.other)
        return lambda env, learnt: (then if test(env) else other)(env, learnt)
    over, inner = _value(node.over), _writer(node.body)

    def loop(env, learnt):
        for i, item in enumerate(over(env) or ()):
            yield from inner({**env, node.name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0}}, learnt)
    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A renderer: values to pieces of text, each with whether the model has to learn it."""
    write = _writer(parse(source))
    return lambda env: write(env, False)


# --- conversations -------------------------------------------------------------------
def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def format_conversations(turns: DataFrame, template: str = TURNS, segment: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, segment, body, spans: the parts of a body under the loss mask as [from, to, from, to, ...].

    A conversation's segments, one after the other, are its formatted text; they are cut between turns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out, size = compile_template(template), [], 0
        for conv_id, rows in groupby(_streamed(batches), lambda r: r["conv_id"]):
            seen = [0]

            def messages():
                for r in rows:
                    seen[0] += 1
                    yield {"role": r["role"] or "", "text": r["text"] or "", "turn": r["turn"]}

            body, spans, at, number, turn, fresh = [], [], 0, 0, 0, True
            for text, learnt in render({"messages": messages()}):
                if seen[0] != turn and at >= segment:
                    out.append((conv_id, number, "".join(body), spans))
                    body, spans, at, number = [], [], 0, number + 1
                turn = seen[0]
                if learnt and text:
                    if spans and spans[-1] == at and not fresh:
                        spans[-1] += len(text)
                    else:
                        spans += [at, at + len(text)]
                fresh = not learnt
                body.append(text)
                at += len(text)
                size += len(text)
                if size > segment and len(out) > 0:
                    yield _segments(out)
                    out, size = [], 0
            out.append((conv_id, number, "".join(body), spans))
        yield _segments(out)

    rows = turns.select("conv_id", "turn", "role", "text").repartition(tasks_of(turns.sparkSession), "conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, segment long, body string, spans array<long>")


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["conv_id", "segment", "body", "spans"])


def read_back(segments: DataFrame) -> DataFrame:
    """Parse formatted conversations: turns and learnt text, unescaped, as counts and digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, rows in groupby(_streamed(batches), lambda r: r["conv_id"]):
            turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for row in rows:
                body, spans = row["body"], row["spans"]
                for m in _TURN.finditer(body):
                    n_turns += 1
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for a, b in zip(spans[::2], spans[1::2]):
                    text = unescape(body[a:b])
                    loss_chars += len(text)
                    loss.update(text.encode())
                chars += len(body)
            out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 10_000:
                yield digests(out)
                out = []
        yield digests(out)

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(columns)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return segments.repartition(tasks_of(segments.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "segment").mapInArrow(run, schema)


def round_trip(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """Format, write, read and parse."""
    spark = turns.sparkSession
    written = write_out(format_conversations(turns, template), run_folder(spark, "chat"), "segments")
    return read_back(written)


def with_control_case(turns: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts consist of control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
