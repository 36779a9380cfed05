"""Built-ins as Spark columns, by the static types of their arguments.

``apply`` returns (column, type, error): ``error`` is a text column that is not null where
the function has no value; None where it always has one. Statically typed arguments stay in
generated JVM code; encoded ones go through the Python functions in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.functions import values as vals

COMPARISONS = {"<", "<=", ">", ">=", "==", "=", "!="}
#: Result types of built-ins on encoded arguments.
_ENCODED = {**{op: "bool" for op in COMPARISONS}, "in": "bool", "&": "bool", "|": "bool", "!": "bool", "split": ("list", "str"), "range": ("list", "long"), "int": "long", "float": "double", "log": "double", "exp": "double", "sqrt": "double", "/": "double"}


class TypeMismatch(Exception):
    """Arguments of types on which the built-in raises for every row."""


@dataclass
class Function:
    """A registered function over ground values (``pycall`` and rule bodies)."""

    run: Callable
    returns: object


def result_type(op: str, kinds: list, functions: dict[str, Function] | None = None):
    """The type of ``op`` over arguments of types ``kinds``; None while one of them is unknown."""
    if any(k is None for k in kinds):
        return None
    if op in COMPARISONS or op in ("in", "&", "|", "!"):
        return "bool"
    if functions and op in functions:
        return functions[op].returns
    if op == "uniform":
        return "double"
    if any(k == "null" or isinstance(k, tuple) and k[0] == "other" for k in kinds):
        return _ENCODED.get(op, "term")
    if op == "split":
        return ("list", "str")
    if op == "range":
        return ("list", "long")
    if op in ("log", "exp", "sqrt", "float", "/"):
        return "double"
    if op == "int":
        return "long"
    if "term" in kinds:
        return "term"
    if op == "+" and kinds == ["str", "str"] or op == "*" and sorted(map(str, kinds)) == ["long", "str"]:
        return "str"
    if all(k in ty.NUMERIC for k in kinds):
        if op == "**" and kinds == ["long", "long"]:
            return "long"
        return "double" if "double" in kinds else "long"
    return "term"


def _fails(when: Column, message: str) -> Column:
    return F.when(when, F.lit(message))


#: Characters of a repeated string, at most.
LONGEST = 1 << 28
OVERFLOW = "OverflowError: the result is no 64-bit integer"


def overflow(op: str, c: list[Column], kinds: list, out: Column) -> Column | None:
    """Where integer arithmetic left the 64 bits, whose result ``out`` is null then; None if it cannot."""
    if op in ("+", "-", "*", "abs") and all(k == "long" for k in kinds):
        return reduce(lambda x, y: x & y, (x.isNotNull() for x in c), out.isNull())
    return None


def _exact_power(a: Column, n: Column) -> Column:
    """By squaring, one step for each bit of ``n``; null where it leaves the 64 bits."""

    def step(held: Column, bit: Column) -> Column:
        odd = F.call_function("getbit", n, bit) == 1
        power = F.when(odd, F.try_multiply(held["power"], held["square"])).otherwise(held["power"])
        return F.struct(power.alias("power"), F.try_multiply(held["square"], held["square"]).alias("square"))

    start = F.struct(F.lit(1).cast("long").alias("power"), a.cast("long").alias("square"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step)["power"]


def _floor_mod(a: Column, b: Column, kind: str) -> Column:
    if kind == "long":
        rest = a % b
        return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    return a - b * F.floor(a / b)



def through_python(op: str, args: list[tuple[Column, object]], to, run: Callable | None = None):
    """(column, type, error) of a Python function; its errors become texts."""
    f = run or (lambda *values: vals.apply(op, values))

    def guarded(*values):
        try:
            out = f(*values)
            if to == "long" and isinstance(out, int) and not -(1 << 63) <= out < 1 << 63:
                return (OVERFLOW, None)
            return ("", ty.to_spark(out, to))
        except vals.EvaluationError as e:
            return (vals.error_text(e), None)
        except RecursionError:
            return ("RuntimeError: maximum recursion depth exceeded", None)
        except Exception as e:  # whatever a registered function raises is that row's error
            return (f"{type(e).__name__}: {e}", None)

    both = _python_pair(guarded, args, to)
    return both.getField("value"), to, F.nullif(both.getField("error"), F.lit(""))


def _python_pair(guarded, args, to) -> Column:
    plain = [t == "str" or ty._has(t, "double") for _, t in args]
    kinds = [t if p else "term" for p, (_, t) in zip(plain, args, strict=True)]
    sent = [c if p else ty.encoded(c, t) for p, (c, t) in zip(plain, args, strict=True)]
    packed = F.struct(*(c.alias(f"x{i}") for i, c in enumerate(sent or [F.lit(0)])))

    @F.pandas_udf(f"error string, value {ty.ddl(to)}")
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in zip(*(frame[c] for c in frame.columns), strict=True):
            if kinds and any(ty._missing(v) for v in row):
                out.append(("", None))  # an argument without a value: its error is reported already
            else:
                out.append(guarded(*(ty.to_python(v, t) for v, t in zip(row, kinds, strict=False))))
        return pd.DataFrame({"error": [e for e, _ in out], "value": pd.Series([v for _, v in out], dtype=object)})

    return run(packed)


def _equal(a: Column, ta, b: Column, tb) -> Column:
    if ta == tb or {ta, tb} <= set(ty.NUMERIC):
        return a == b
    if "term" in (ta, tb) or isinstance(ta, tuple) and isinstance(tb, tuple):
        return ty.encoded(a, ta) == ty.encoded(b, tb)
    return F.lit(False)  # values of different static types differ


def apply(op: str, args: list[tuple[Column, object]], functions: dict[str, Function] | None = None, seed: int = 0):
    kinds = [t for _, t in args]
    c = [x for x, _ in args]
    if functions and op in functions:
        return through_python(op, args, functions[op].returns, functions[op].run)
    if op == "uniform":
        low, high = (c[0], c[1]) if c else (F.lit(0.0), F.lit(1.0))
        return F.rand(seed) * (high - low) + low, "double", None
    if op in ("==", "="):
        return _equal(c[0], kinds[0], c[1], kinds[1]), "bool", None
    if op == "!=":
        return ~_equal(c[0], kinds[0], c[1], kinds[1]), "bool", None
    if op in COMPARISONS:
        if kinds[0] == kinds[1] and kinds[0] != "term" or set(kinds) <= set(ty.NUMERIC):
            return {"<": c[0] < c[1], "<=": c[0] <= c[1], ">": c[0] > c[1], ">=": c[0] >= c[1]}[op], "bool", None
        return through_python(op, args, "bool")
    if op in ("&", "|", "!"):
        if all(k == "bool" for k in kinds):
            return (~c[0] if op == "!" else c[0] & c[1] if op == "&" else c[0] | c[1]), "bool", None
        if "term" in kinds:
            return through_python(op, args, "bool")
        raise TypeMismatch(f"TypeError: {op} expected a boolean")
    if op == "in":
        if isinstance(kinds[1], tuple) and kinds[1][0] == "list":
            inner = kinds[1][1]
            if inner == kinds[0] or {inner, kinds[0]} <= set(ty.NUMERIC):
                to = ty.unify(inner, kinds[0])
                found = F.array_contains(ty.coerce(c[1], kinds[1], ("list", to)), ty.coerce(c[0], kinds[0], to))
                return F.coalesce(found, F.lit(False)), "bool", None
            return through_python(op, args, "bool")
        if kinds[1] == "term":
            return through_python(op, args, "bool")
        raise TypeMismatch("TypeError: the right side of `in` is not a list")
    if op == "split":
        if kinds[0] == "str":
            return F.split(c[0], c[1] if len(c) > 1 else F.lit(r"\s+")), ("list", "str"), None
        return through_python(op, args, ("list", "str"))
    if op == "range" and all(k == "long" for k in kinds):
        low, high = (F.lit(0).cast("long"), c[0]) if len(c) == 1 else (c[0], c[1])
        step = c[2] if len(c) > 2 else F.lit(1).cast("long")
        empty = F.array().cast("array<bigint>")
        up = F.when(low < high, F.sequence(low, high - 1, step)).otherwise(empty)
        if len(c) < 3:
            return up, ("list", "long"), None
        down = F.when(low > high, F.sequence(low, high + 1, step)).otherwise(empty)
        wrong = _fails(step == 0, "ValueError: range() arg 3 must not be zero")
        safe = F.when(step > 0, up).when(step < 0, down)
        return safe, ("list", "long"), wrong
    if op in ("int", "float"):
        return _cast(op, c[0], kinds[0], args)
    if "term" in kinds or any(k == "null" for k in kinds):
        return through_python(op, args, result_type(op, kinds))
    if op == "+" and kinds == ["str", "str"]:
        return F.concat(c[0], c[1]), "str", None
    if op == "*" and sorted(map(str, kinds)) == ["long", "str"]:
        text, n = (c[0], c[1]) if kinds[0] == "str" else (c[1], c[0])
        fits = (n <= 0) | (F.length(text) == 0) | (n <= F.lit(LONGEST) / F.length(text))
        times = F.greatest(F.least(n, F.lit(LONGEST)), F.lit(0)).cast("int")
        return F.when(fits, F.repeat(text, times)), "str", _fails(~fits, "OverflowError: a repeated string is too long")
    if not all(k in ty.NUMERIC for k in kinds):
        raise TypeMismatch(f"TypeError: unsupported operand type(s) for {op}: {' and '.join(map(str, kinds))}")
    return _numeric(op, c, kinds)


def _cast(op: str, c: Column, kind, args):
    to = "long" if op == "int" else "double"
    if kind in ty.NUMERIC:
        if op == "int" and kind == "double":
            inside = F.abs(c) < F.lit(9.2e18)
            return F.when(inside, c.cast("long")), to, _fails(~inside | F.isnan(c), "OverflowError: cannot convert float to integer")
        return c.cast(ty.ddl(to)), to, None
    if kind == "bool":
        return c.cast("int").cast(ty.ddl(to)), to, None
    if kind == "str":
        text = F.trim(c)
        fits = text.rlike(r"^[+-]?\d+$") if op == "int" else F.lit(True)
        out = F.when(fits, text.try_cast(ty.ddl(to)))
        name = "int() with base 10" if op == "int" else "float()"
        return out, to, F.when(c.isNotNull() & out.isNull(), F.concat(F.lit(f"ValueError: invalid literal for {name}: "), c))
    return through_python(op, args, to)


def _numeric(op: str, c: list[Column], kinds: list):
    kind = "double" if "double" in kinds else "long"
    if op in ("+", "*", "-") and len(c) == 2:
        if kind == "long":
            return {"+": F.try_add, "*": F.try_multiply, "-": F.try_subtract}[op](c[0], c[1]), kind, None
        return {"+": c[0] + c[1], "*": c[0] * c[1], "-": c[0] - c[1]}[op], kind, None
    if op == "-":
        return (F.try_subtract(F.lit(0).cast("long"), c[0]) if kind == "long" else -c[0]), kind, None
    if op == "abs":
        return (F.when(c[0] >= 0, c[0]).otherwise(F.try_subtract(F.lit(0).cast("long"), c[0])) if kind == "long" else F.abs(c[0])), kind, None
    if op == "/":
        zero = c[1] == 0
        return F.try_divide(c[0].cast("double"), c[1].cast("double")), "double", _fails(zero, "ZeroDivisionError: division by zero")
    if op == "mod":
        zero = _fails(c[1] == 0, "ZeroDivisionError: division by zero")
        safe = F.when(c[1] != 0, c[1])
        return _floor_mod(c[0], safe, kind), kind, zero
    if op == "**":
        if kind == "long":
            out = F.when(c[1] >= 0, _exact_power(c[0], F.greatest(c[1], F.lit(0))))
            wrong = F.when(c[1] < 0, F.lit("ValueError: negative exponent of an integer"))
            return out, "long", wrong.when(c[0].isNotNull() & c[1].isNotNull() & out.isNull(), F.lit(OVERFLOW))
        wrong = (c[0] < 0) & (c[1] != F.floor(c[1])) | (c[0] == 0) & (c[1] < 0)
        return F.when(~wrong, F.pow(c[0], c[1])), "double", _fails(wrong, "ValueError: math domain error")
    if op == "^":
        if kind == "double":
            raise TypeMismatch("TypeError: unsupported operand type(s) for ^: 'float'")
        return c[0].bitwiseXOR(c[1]), "long", None
    if op == "exp":
        big = c[0] > F.lit(709.782712893384)
        return F.when(~big, F.exp(c[0])), "double", _fails(big, "OverflowError: math range error")
    if op == "sqrt":
        return F.when(c[0] >= 0, F.sqrt(c[0])), "double", _fails(c[0] < 0, "ValueError: math domain error")
    if op == "log":
        wrong = c[0] <= 0
        out = F.ln(c[0])
        if len(c) == 2:
            wrong = wrong | (c[1] <= 0)
            out = F.try_divide(out, F.ln(c[1]))
            return F.when(~wrong, out), "double", F.when(wrong, F.lit("ValueError: math domain error")).when(c[1] == 1, F.lit("ZeroDivisionError: division by zero"))
        return F.when(~wrong, out), "double", _fails(wrong, "ValueError: math domain error")
    raise TypeMismatch(f"NameError: no function {op}")
