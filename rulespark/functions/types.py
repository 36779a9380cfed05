"""Static types of columns, and how a column of one type becomes one of another.

A type is "null", "bool", "long", "double", "str", ("list", T), ("struct", fn, (T, ...)),
("other", ddl) for Spark types that pass through, or "term": encoded text for whatever has
no static type.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.functions.values import decode, encode
from rulespark.lang.ast import Term

#: Nesting beyond which a type becomes "term"; keeps recursive types finite.
DEPTH = 3
NUMERIC = ("long", "double")


def depth(t) -> int:
    if isinstance(t, tuple) and t[0] == "list":
        return 1 + depth(t[1])
    if isinstance(t, tuple) and t[0] == "struct":
        return 1 + max(map(depth, t[2]), default=0)
    return 0


def settle(t):
    """A type of bounded depth; atoms, and parts that are null or pass through, are encoded."""
    if isinstance(t, tuple) and t[0] == "struct" and (not t[2] or depth(t) > DEPTH or any(x == "null" for x in t[2])):
        return "term"
    if isinstance(t, tuple) and t[0] == "list" and (depth(t) > DEPTH or settle(t[1]) == "null"):
        return "term"
    return t


def unify(a, b):
    """The least type that holds both; None is the type of nothing."""
    if a is None or a == b:
        return b
    if b is None or b == "null":
        return a
    if a == "null":
        return b
    if a in NUMERIC and b in NUMERIC:
        return "double"
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0]:
        if a[0] == "list":
            inner = unify(a[1], b[1])
            return settle(("list", inner))
        if a[0] == "struct" and a[1] == b[1] and len(a[2]) == len(b[2]):
            return settle(("struct", a[1], tuple(map(unify, a[2], b[2]))))
    return "term"


def of_value(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "str"
    if isinstance(v, (tuple, list)):
        inner = reduce(unify, map(of_value, v), None)
        return "term" if inner is None else settle(("list", inner))
    if isinstance(v, Term):
        return settle(("struct", v.fn, tuple(map(of_value, v.args))))
    raise TypeError(f"no type for {v!r}")


def ddl(t) -> str:
    if isinstance(t, tuple):
        if t[0] == "list":
            return f"array<{ddl(t[1])}>"
        if t[0] == "struct":
            return "struct<" + ",".join(f"p{i}:{ddl(x)}" for i, x in enumerate(t[2])) + ">"
        return t[1]
    return {"bool": "boolean", "long": "bigint", "double": "double", "str": "string", "term": "string", "null": "string", None: "string"}[t]


def of_spark(kind: T.DataType):
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "long"
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "double"
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.ArrayType):
        return ("list", of_spark(kind.elementType))
    return ("other", kind.simpleString())


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _encode_double(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else encode(float(v)))

    return run(c)


def encoded(c: Column, t) -> Column:
    """The column as "term"; null stays null."""
    if t == "term":
        return c
    if t in ("null", None):
        return F.lit("z")
    if t == "bool":
        return F.when(c, "b1").when(~c, "b0")
    if t == "long":
        return F.concat(F.lit("n"), c.cast("string"))
    if t == "double":
        return _encode_double(c)
    if t == "str":
        return F.concat(F.lit("s"), _quoted(c))
    if t[0] == "list":
        if _has(t, "double"):
            return from_python(lambda v: v, [(c, t)], "term")
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: encoded(x, t[1])), ","), F.lit("]"))
    if t[0] == "struct":
        parts = [encoded(c.getField(f"p{i}"), x) for i, x in enumerate(t[2])]
        between: list[Column] = [F.lit("t" + encode(t[1])[1:] + "(")]
        for i, p in enumerate(parts):
            between += [F.lit(",")] * bool(i) + [p]
        return F.concat(*between, F.lit(")"))
    return F.concat(F.lit("s"), _quoted(c.cast("string")))


def _has(t, what) -> bool:
    if t == what:
        return True
    if isinstance(t, tuple) and t[0] == "list":
        return _has(t[1], what)
    if isinstance(t, tuple) and t[0] == "struct":
        return any(_has(x, what) for x in t[2])
    return False


def coerce(c: Column, t, to) -> Column:
    if t == to:
        return c
    if t in ("null", None):
        return F.lit(None).cast(ddl(to)) if to != "term" else F.lit("z")
    if to == "term":
        return encoded(c, t)
    if t == "term":
        return decoded(c, to)
    if t == "long" and to == "double":
        return c.cast("double")
    if isinstance(t, tuple) and isinstance(to, tuple) and t[0] == to[0] == "list":
        return F.transform(c, lambda x: coerce(x, t[1], to[1]))
    if isinstance(t, tuple) and isinstance(to, tuple) and t[0] == to[0] == "struct":
        return F.struct(*(coerce(c.getField(f"p{i}"), a, b).alias(f"p{i}") for i, (a, b) in enumerate(zip(t[2], to[2], strict=True))))
    raise TypeError(f"{t} cannot become {to}")


def decoded(c: Column, to) -> Column:
    """An encoded column whose values are known to be of a static type."""
    if to == "bool":
        return c == "b1"
    if to in NUMERIC:
        return F.substring(c, 2, 400).cast(ddl(to))
    return from_python(lambda v: v, [(c, "term")], to)


def to_python(v, t):
    """A collected (or Arrow) value of a static type as a ground value."""
    if v is None or t in ("null", None):
        return None
    if t == "term":
        return decode(v)
    if t == "double":
        return float(v)
    if t == "long":
        return int(v)
    if t == "bool":
        return bool(v)
    if isinstance(t, tuple) and t[0] == "list":
        return tuple(to_python(x, t[1]) for x in v)
    if isinstance(t, tuple) and t[0] == "struct":
        parts = list(v.values()) if isinstance(v, dict) else list(v)
        return Term(t[1], tuple(map(to_python, parts, t[2])))
    return v


def to_spark(v, t):
    """A ground value as Spark takes it for a column of a static type."""
    if t == "term":
        return encode(v)
    if v is None:
        return None
    if t == "double":
        return float(v)
    if isinstance(t, tuple) and t[0] == "list":
        return [to_spark(x, t[1]) for x in v]
    if isinstance(t, tuple) and t[0] == "struct":
        return tuple(map(to_spark, v.args, t[2]))
    return v


def literal(v, t) -> Column:
    """A constant as a column of a type that holds it."""
    if t == "term":
        return F.lit(encode(v))
    if v is None:
        return F.lit(None).cast(ddl(t))
    if isinstance(t, tuple) and t[0] == "list":
        return F.array(*(literal(x, t[1]) for x in v)).cast(ddl(t))
    if isinstance(t, tuple) and t[0] == "struct":
        return F.struct(*(literal(x, p).alias(f"p{i}") for i, (x, p) in enumerate(zip(v.args, t[2], strict=True))))
    return F.lit(v).cast(ddl(t))


def from_python(f, args: list[tuple[Column, object]], to) -> Column:
    """A Python function over ground values, in Arrow batches; null if an argument is."""
    # Doubles and strings go as they are, the rest encoded: Arrow would turn nullable longs into doubles.
    plain = [t == "str" or _has(t, "double") for _, t in args]
    kinds = [t if p else "term" for p, (_, t) in zip(plain, args, strict=True)]
    sent = [c if p else encoded(c, t) for p, (c, t) in zip(plain, args, strict=True)]
    packed = F.struct(*(c.alias(f"x{i}") for i, c in enumerate(sent or [F.lit(0)])))
    none = not args

    @F.pandas_udf(ddl(to))
    def run(frame: pd.DataFrame) -> pd.Series:
        rows = ([()] * len(frame)) if none else zip(*(frame[c] for c in frame.columns), strict=True)
        out = []
        for row in rows:
            values = [None if _missing(v) else to_python(v, t) for v, t in zip(row, kinds, strict=True)]
            out.append(to_spark(f(*values), to) if all(v is not None or _is_null(r) for v, r in zip(values, row, strict=True)) else None)
        return pd.Series(out, dtype=object)

    return run(packed)


def _missing(v) -> bool:
    return v is None or isinstance(v, float) and v != v


def _is_null(v) -> bool:
    return isinstance(v, str) and v == "z"
