"""The arithmetic language: text -> AST -> Column.

    Compound := Simple Op Compound | "(" Compound ")" [Op Compound] | "-" Compound | Simple

It is right-associative and knows no precedence: ``a - b - c`` is
``a - (b - c)``, ``a * b + c`` is ``a * (b + c)``, ``-a + b`` is ``-(a + b)``.
Names may hold ``-`` and digits, so ``a-1`` is one name; write ``a - 1``.
Integers stay integers (division truncates), a double on either side makes a
double.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(?P<float>-?[0-9]+\.[0-9]*)|(?P<int>-?[0-9]+)|(?P<name>[A-Za-z][A-Za-z0-9_-]*)|(?P<op>[-+*/()]))")


@dataclass(frozen=True)
class Leaf:
    kind: str  # name, int, float
    text: str


@dataclass(frozen=True)
class Negate:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"bad character in arithmetic at {at}: {text[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str):
    tokens = tokenize(text)
    tree, at = _compound(tokens, 0)
    if at != len(tokens):
        raise SyntaxError(f"unexpected {tokens[at][1]!r} in arithmetic")
    return tree


def _compound(tokens, at: int):
    if at >= len(tokens):
        raise SyntaxError("arithmetic ends too early")
    kind, text = tokens[at]
    if (kind, text) == ("op", "-"):
        inner, at = _compound(tokens, at + 1)
        return Negate(inner), at
    if (kind, text) == ("op", "("):
        left, at = _compound(tokens, at + 1)
        if at >= len(tokens) or tokens[at][1] != ")":
            raise SyntaxError("missing )")
        at += 1
    elif kind != "op":
        left, at = Leaf(kind, text), at + 1
    else:
        raise SyntaxError(f"unexpected {text!r} in arithmetic")
    if at < len(tokens) and tokens[at] in (("op", o) for o in "+-*/"):
        right, end = _compound(tokens, at + 1)
        return Binary(tokens[at][1], left, right), end
    return left, at


def family(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    return "string" if isinstance(kind, T.StringType) else kind.simpleString()


def bind(tree, df: DataFrame) -> tuple[Column, str]:
    """The tree as a Column over ``df``, and its family (int or double)."""
    if isinstance(tree, Leaf):
        if tree.kind == "int":
            return F.lit(int(tree.text)).cast("long"), "int"
        if tree.kind == "float":
            return F.lit(float(tree.text)), "double"
        if tree.text not in df.columns:
            raise ValueError(f"no attribute {tree.text}")
        kind = family(df.schema[tree.text].dataType)
        if kind not in ("int", "double"):
            raise TypeError(f"{tree.text} is {kind}; arithmetic needs numbers")
        column = df[f"`{tree.text}`"]
        return column.cast("long" if kind == "int" else "double"), kind
    if isinstance(tree, Negate):
        column, kind = bind(tree.of, df)
        return -column, kind
    (a, left), (b, right) = bind(tree.left, df), bind(tree.right, df)
    if left == right == "int":
        if tree.op == "/":
            return F.call_function("div", a, b), "int"
        return {"+": a + b, "-": a - b, "*": a * b}[tree.op], "int"
    a, b = a.cast("double"), b.cast("double")
    if tree.op == "/":
        by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b)), "double"
    return {"+": a + b, "-": a - b, "*": a * b}[tree.op], "double"


def compile_text(text: str, df: DataFrame) -> tuple[Column, str]:
    return bind(parse(text), df)
