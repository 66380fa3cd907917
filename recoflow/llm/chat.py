"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants
are folded, and the tree becomes Python closures that stream a conversation:
each closure yields (text, under_loss) parts, so a conversation of any number
of turns is rendered turn by turn.

Language: ``{{ expr }}``, ``{% for x in expr %}`` (with ``loop.index0``,
``loop.first``), ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% generation %} ... {% endgeneration %}`` (the loss mask).  Expressions:
strings, integers, names, ``a.b`` on mapping keys only, ``==``, ``!=``,
``and``, ``or``, ``not``, ``~`` (join), ``| filter`` from a fixed table.
There are no calls, no attributes of objects and no assignments.

Turns are rows; Spark groups a conversation by a sorted shuffle and Python
sees one row at a time.  Formatted text leaves in pieces of about ``PIECE``
characters with the loss spans of each piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
CHAT_TEMPLATE = (
    "{% for m in messages %}{{ '##' ~ '# ' }}{{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '</turn>' }}\n{% endfor %}")


def escape(text: str) -> str:
    """Backslash before every backslash and control string."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(text: str) -> str:
    return ROLE_CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_role": escape_role, "upper": str.upper, "lower": str.lower, "trim": str.strip}

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[.~|()]))")


class TemplateError(ValueError):
    pass


# ---- parsing: text -> tree of tuples ("kind", ...)

def _lex(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    code = code.strip()
    while at < len(code):
        m = _TOKENS.match(code, at)
        if not m:
            raise TemplateError(f"cannot read {code[at:]!r}")
        kind = ("str", "int", "name", "op")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent, weakest first: or, and, not, comparison, ~, filter."""

    def __init__(self, code: str):
        self.toks, self.at = _lex(code), 0

    def peek(self) -> str | None:
        return self.toks[self.at][1] if self.at < len(self.toks) else None

    def take(self, *want: str) -> bool:
        if self.at < len(self.toks) and self.toks[self.at][0] != "str" and self.peek() in want:
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        tree = self.either()
        if self.at != len(self.toks):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        for op in ("==", "!="):
            if self.take(op):
                return (op, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while self.take("~"):
            tree = ("~", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if self.at >= len(self.toks):
            raise TemplateError("expression ends early")
        kind, text = self.toks[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(text))
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        tree = ("name", text)
        while self.take("."):
            kind, key = self.toks[self.at] if self.at < len(self.toks) else ("", "")
            if kind != "name" or key.startswith("_"):
                raise TemplateError(f"bad key {key!r}")
            self.at += 1
            tree = ("key", tree, key)
        return tree


def parse(template: str) -> list[tuple]:
    parts = [p for p in _PARTS.split(template) if p]
    tree, at, end = _block(parts, 0, ())
    if end is not None or at != len(parts):
        raise TemplateError(f"unexpected {end!r}")
    return tree


def _block(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int, str | None]:
    """Nodes up to one of the closing tags ``ends``: (nodes, next part, the tag)."""
    out: list[tuple] = []
    while at < len(parts):
        part, at = parts[at], at + 1
        if part.startswith("{{"):
            out.append(("emit", _Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            code = part[2:-2].strip()
            word = code.split(None, 1)[0] if code else ""
            if word in ends:
                return out, at, code
            if word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", code, re.S)
                if not m:
                    raise TemplateError(f"bad loop {code!r}")
                body, at, end = _block(parts, at, ("endfor",))
                out.append(("for", m[1], _Expression(m[2]).whole(), body))
            elif word == "if":
                arms, rest, end = [], [], code
                while end and end.split(None, 1)[0] in ("if", "elif"):
                    test = _Expression(end.split(None, 1)[1]).whole()
                    body, at, end = _block(parts, at, ("elif", "else", "endif"))
                    arms.append((test, body))
                if end == "else":
                    rest, at, end = _block(parts, at, ("endif",))
                out.append(("if", arms, rest))
            elif word == "generation":
                body, at, end = _block(parts, at, ("endgeneration",))
                out.append(("generation", body))
            else:
                raise TemplateError(f"unexpected tag {code!r}")
            if end is None:
                raise TemplateError(f"{word!r} is not closed")
        else:
            out.append(("emit", ("const", part)))
    return out, at, None


# ---- constant folding

def fold_expression(tree: tuple) -> tuple:
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "key":
        return ("key", fold_expression(tree[1]), tree[2])
    if kind == "filter":
        inner = fold_expression(tree[2])
        return ("const", FILTERS[tree[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = tuple(fold_expression(x) for x in tree[1:])
    folded = (kind, *parts)
    return ("const", evaluator(folded)({})) if all(p[0] == "const" for p in parts) else folded


def _push(out: list[tuple], node: tuple) -> None:
    """Append a folded node; text after text joins it, empty text goes."""
    if node[0] == "emit" and node[1][0] == "const":
        text = _text(node[1][1])
        if out and out[-1][0] == "emit" and out[-1][1][0] == "const":
            text = out.pop()[1][1] + text
        node = ("emit", ("const", text))
        if not text:
            return
    out.append(node)


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constant expressions become text, decided branches disappear, and
    neighbouring texts join."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "emit":
            _push(out, ("emit", fold_expression(node[1])))
        elif node[0] == "for":
            out.append(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "generation":
            out.append(("generation", fold(node[1])))
        else:
            arms, rest = [], fold(node[2])
            for test, body in node[1]:
                test = fold_expression(test)
                if test[0] == "const":
                    if test[1]:
                        rest = fold(body)
                        break
                    continue
                arms.append((test, fold(body)))
            for kept in [("if", arms, rest)] if arms else rest:
                _push(out, kept)
    return out


# ---- closures

def _text(value) -> str:
    return "" if value is None else str(value)


def evaluator(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "key":
        of, key = evaluator(tree[1]), tree[2]

        def look(env):
            value = of(env)
            return value.get(key) if isinstance(value, dict) else None
        return look
    if kind == "filter":
        f, of = FILTERS[tree[1]], evaluator(tree[2])
        return lambda env: f(_text(of(env)))
    if kind == "not":
        of = evaluator(tree[1])
        return lambda env: not of(env)
    a, b = evaluator(tree[1]), evaluator(tree[2])
    return {"==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env),
            "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env),
            "~": lambda env: _text(a(env)) + _text(b(env))}[kind]


Renderer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def renderer(nodes: list[tuple]) -> Renderer:
    steps = [_step(n) for n in nodes]

    def run(env: dict, loss: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, loss)
    return run


def _step(node: tuple) -> Renderer:
    if node[0] == "emit":
        value = evaluator(node[1])
        return lambda env, loss: iter(((_text(value(env)), loss),))
    if node[0] == "generation":
        body = renderer(node[1])
        return lambda env, loss: body(env, True)
    if node[0] == "for":
        over, name, body = evaluator(node[2]), node[1], renderer(node[3])

        def loop(env, loss):
            for i, item in enumerate(over(env) or ()):
                yield from body({**env, name: item, "loop": {"index0": i, "first": i == 0}}, loss)
        return loop
    arms, rest = [(evaluator(t), renderer(b)) for t, b in node[1]], renderer(node[2])

    def choose(env, loss):
        for test, body in arms:
            if test(env):
                return body(env, loss)
        return rest(env, loss)
    return choose


@lru_cache(maxsize=64)
def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """Closure that renders an iterable of messages to (text, under_loss) parts."""
    run = renderer(fold(parse(template)))
    return lambda messages: run({"messages": messages}, False)


# ---- Spark jobs

def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        yield from pdf.itertuples(index=False, name=None)


def _none(v):
    return v if isinstance(v, str) else None


def format_conversations(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """(conv_id string, piece, formatted, spans): conversations of (conv_id,
    turn, role, text) rendered in turn order (ties by role, then text; null
    turns first).  Null roles and texts are empty; rows with a null id are one
    conversation; pieces of a conversation stay together and in order."""
    compile_template(template)      # a bad template fails here, not in a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        out: list[tuple] = []
        held = 0
        for conv, rows in groupby(_rows(batches), key=lambda r: _none(r[0])):
            messages = ({"role": _none(r[1]) or "", "text": _none(r[2]) or ""} for r in rows)
            piece, parts, spans, n = 0, [], [], 0
            for text, loss in render(messages):
                if not text and not loss:
                    continue
                if loss:
                    if spans and spans[-1]["stop"] == n and spans[-1]["start"] != n and text:
                        spans[-1]["stop"] = n + len(text)
                    else:
                        spans.append({"start": n, "stop": n + len(text)})
                parts.append(text)
                n += len(text)
                if n >= PIECE:
                    yield pd.DataFrame([(conv, piece, "".join(parts), spans)],
                                       columns=["conv_id", "piece", "formatted", "spans"])
                    piece, parts, spans, n = piece + 1, [], [], 0
            if parts or not piece:
                out.append((conv, piece, "".join(parts), spans))
                held += n
            if held >= PIECE:
                yield pd.DataFrame(out, columns=["conv_id", "piece", "formatted", "spans"])
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "piece", "formatted", "spans"])
    t = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("turn"),
                     F.col("role").alias("role"), F.col("text").alias("text"))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.select("conv_id", "role", "text").mapInPandas(
        run, "conv_id string, piece long, formatted string, spans array<struct<start:long,stop:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted output says, parsed from it alone: turns
    from their markers, loss text from the loss spans, both unescaped.  Takes
    ``format_conversations`` output as it is (pieces in order)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, pieces in groupby(_rows(batches), key=lambda r: _none(r[0])):
            n_turns = n_loss = n_chars = 0
            turns, loss, rest = hashlib.sha256(), hashlib.sha256(), ""
            for _, _, text, spans in pieces:
                n_chars += len(text)
                for s in spans:
                    said = unescape(text[s["start"]:s["stop"]])
                    n_loss += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
                rest += text
                at = 0
                while m := TURN.match(rest, at):
                    n_turns += 1
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    at = m.end()
                rest = rest[at:]
            if rest:
                raise ValueError(f"conversation {conv}: {rest[:80]!r} is no turn")
            out.append((conv, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        yield pd.DataFrame(out, columns=cols)
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = formatted.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
    return got.withColumn("conv_id", F.col("conv_id").cast("long"))


def control_conversation(turns: DataFrame, conv_id: int = -7) -> DataFrame:
    """``turns`` plus a conversation whose texts hold the template's control strings."""
    said = "\\### Assistant: </turn> ok"
    extra = turns.sparkSession.createDataFrame(
        [(conv_id, 0, "user", said), (conv_id, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)
