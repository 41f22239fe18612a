"""Expressions over numbered columns, compiled to Spark columns.

Grammar, from loose to tight: ``,`` (the last value counts), ``||``, ``&&``, ``== != < <= > >=``, ``+ -``, ``* / %``, unary
``+ - !``, ``^`` (to the left), then numbers, ``$n``, names, calls and brackets.  Truth is 1.0 or 0.0, as everything is a double.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|\$(\d+)|([A-Za-z_]\w*)|(\|\||&&|==|!=|<=|>=|[-+*/%^()<>!,]))")


def _npr(n: Column, r: Column) -> Column:
    return _factorial(n) / _factorial(n - r)


def _factorial(n: Column) -> Column:
    return F.factorial(n.cast("int")).cast("double")


CONSTANTS = {"pi": math.pi, "e": math.e}
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    **{name: (1, getattr(F, name)) for name in ("abs", "acos", "asin", "atan", "cos", "cosh", "exp", "floor", "sin", "sinh", "sqrt", "tan", "tanh", "log10")},
    "ceil": (1, F.ceil),
    "ln": (1, F.ln),
    "log": (1, F.log10),
    "atan2": (2, F.atan2),
    "pow": (2, F.pow),
    "fac": (1, _factorial),
    "npr": (2, _npr),
    "ncr": (2, lambda n, r: _npr(n, r) / _factorial(r)),
}
_LEVELS = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


def _truth(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "||": lambda a, b: _truth((a != 0) | (b != 0)),
    "&&": lambda a, b: _truth((a != 0) & (b != 0)),
    "==": lambda a, b: _truth(a == b),
    "!=": lambda a, b: _truth(a != b),
    "<": lambda a, b: _truth(a < b),
    "<=": lambda a, b: _truth(a <= b),
    ">": lambda a, b: _truth(a > b),
    ">=": lambda a, b: _truth(a >= b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "%": lambda a, b: a % b,
}


class _Compiler:
    def __init__(self, text: str, columns: Sequence[str]):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.columns, self.at = columns, 0

    def sign(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][4] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][4]
        return None

    def whole(self) -> Column:
        out = self.listed()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][0].strip()!r}")
        return out

    def listed(self) -> Column:
        out = self.level(0)
        while self.sign(","):
            out = self.level(0)
        return out

    def level(self, k: int) -> Column:
        if k == len(_LEVELS):
            return self.power()
        out = self.level(k + 1)
        while op := self.sign(*_LEVELS[k]):
            out = _BINARY[op](out, self.level(k + 1))
        return out

    def power(self) -> Column:
        out = self.unary()
        while self.sign("^"):
            out = F.pow(out, self.unary())
        return out

    def unary(self) -> Column:
        if op := self.sign("-", "+", "!"):
            value = self.unary()
            return {"-": -value, "+": value, "!": _truth(value == 0)}[op]
        return self.atom()

    def atom(self) -> Column:
        if self.sign("("):
            out = self.listed()
            if not self.sign(")"):
                raise ValueError("a bracket isn't closed")
            return out
        if self.at == len(self.tokens) or self.tokens[self.at][4]:
            raise ValueError("a value is missing")
        number, column, name, _ = self.tokens[self.at].groups()
        self.at += 1
        if number:
            return F.lit(float(number))
        if column:
            if not 1 <= int(column) <= len(self.columns):
                raise ValueError(f"there is no column ${column}")
            return F.col(self.columns[int(column) - 1]).cast("double")
        if name in CONSTANTS:
            if self.sign("("):
                self.sign(")")
            return F.lit(CONSTANTS[name])
        if name not in FUNCTIONS:
            raise ValueError(f"there is no function {name}")
        arity, function = FUNCTIONS[name]
        if arity == 1 and not (self.at < len(self.tokens) and self.tokens[self.at][4] == "("):
            return function(self.unary()).cast("double")
        self.sign("(")
        args = [self.level(0)]
        while self.sign(","):
            args.append(self.level(0))
        if not self.sign(")") or len(args) != arity:
            raise ValueError(f"{name} takes {arity} arguments")
        return function(*args).cast("double")


def compile_expression(text: str, columns: Sequence[str]) -> Column:
    """A double column for ``text``; ``$1`` is the first of ``columns``.  Raises ValueError for what it can't read."""
    return _Compiler(text, columns).whole()
