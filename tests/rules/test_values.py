import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulespark.functions import builtins
from rulespark.functions import types as ty
from rulespark.functions import values as vals
from rulespark.lang.ast import Term

scalars = st.one_of(st.none(), st.booleans(), st.integers(-(2**62), 2**62), st.floats(allow_nan=False, allow_infinity=False), st.text("ab\"\\,()[]é ", max_size=6))
ground = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3).map(tuple), st.builds(Term, st.sampled_from(["f", "g h"]), st.lists(x, max_size=2).map(tuple))), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(ground)
def test_encoding_round_trip(v):
    assert vals.same(vals.decode(vals.encode(v)), v)


@settings(max_examples=200, deadline=None)
@given(ground, ground)
def test_equal_values_have_equal_texts(a, b):
    assert (vals.encode(a) == vals.encode(b)) == vals.same(a, b)


def test_order_and_rendering():
    mixed = ["b", (2, 1), 2, True, 1, Term("f", (1,)), "a", 1.5]
    assert sorted(mixed, key=vals.order) == [True, 1, 1.5, 2, "a", "b", (2, 1), Term("f", (1,))]
    assert vals.render((1, "a\"b", Term("f", (True, None)), Term("->", (1, 2)), Term("odd name"))) == "[1, \"a\\\"b\", f(true,null), 1 -> 2, 'odd name']"


def test_columns_encode_as_values_do(spark):
    rows = [(1, True, 'q"\\', 2.5, 3.0, [1, 2], ["a", 'b"'], [0.5, 2.0]), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "l long, b boolean, s string, d double, w double, ll array<long>, ls array<string>, ld array<double>")
    kinds = {"l": "long", "b": "bool", "s": "str", "d": "double", "w": "double", "ll": ("list", "long"), "ls": ("list", "str"), "ld": ("list", "double")}
    got = df.select(*(ty.encoded(F.col(c), t).alias(c) for c, t in kinds.items())).collect()
    for c, v in zip(kinds, rows[0]):
        assert got[0][c] == vals.encode(tuple(v) if isinstance(v, list) else v), c
        assert got[1][c] is None


def test_types():
    assert ty.unify("long", "double") == "double" and ty.unify("long", "str") == "term" and ty.unify(None, "bool") == "bool"
    assert ty.of_value((1, 2.5)) == ("list", "double") and ty.of_value((1, "a")) == ("list", "term")
    assert ty.of_value(Term("p", (1, "a"))) == ("struct", "p", ("long", "str")) and ty.of_value(Term("a")) == "term"
    deep = Term("t", (Term("t", (Term("t", (Term("t", (1,)),)),)),))
    assert ty.of_value(deep) == "term"


# Each built-in: the arguments' columns and types, and rows of arguments.
CASES = [
    ("+", [("long", 3), ("long", -5)]), ("+", [("str", "a"), ("str", "b")]), ("-", [("double", 1.5), ("long", 2)]), ("-", [("long", 4)]),
    ("*", [("long", 3), ("double", 0.5)]), ("/", [("long", 1), ("long", 2)]), ("/", [("long", 1), ("long", 0)]), ("**", [("long", 3), ("long", 34)]),
    ("**", [("double", 2.0), ("double", 0.5)]), ("**", [("double", -2.0), ("double", 0.5)]), ("^", [("long", 6), ("long", 3)]), ("^", [("double", 6.0), ("long", 3)]),
    ("mod", [("long", -7), ("long", 3)]), ("mod", [("long", 7), ("long", -3)]), ("mod", [("long", -6), ("long", 3)]), ("mod", [("double", -7.5), ("double", 2.0)]),
    ("mod", [("long", 1), ("long", 0)]), ("abs", [("long", -3)]), ("log", [("double", math.e)]), ("log", [("long", 0)]), ("log", [("long", 8), ("long", 2)]),
    ("exp", [("long", 1)]), ("exp", [("long", 1000)]), ("sqrt", [("long", 9)]), ("sqrt", [("long", -1)]), ("int", [("str", "12")]), ("int", [("str", "x")]),
    ("int", [("double", -2.7)]), ("int", [("bool", True)]), ("float", [("str", "1.5")]), ("float", [("str", "x")]), ("float", [("long", 2)]),
    ("range", [("long", 3)]), ("range", [("long", 3), ("long", 1)]), ("range", [("long", 1), ("long", 6), ("long", 2)]), ("range", [("long", 6), ("long", 1), ("long", -2)]),
    ("split", [("str", " a b ")]), ("split", [("str", "a,b,,c"), ("str", ",")]), ("<", [("long", 1), ("double", 1.5)]), ("<", [("str", "a"), ("str", "b")]),
    (">=", [("long", 1), ("str", "a")]), ("==", [("long", 3), ("double", 3.0)]), ("==", [("bool", True), ("long", 1)]), ("!=", [("str", "a"), ("long", 1)]),
    ("&", [("bool", True), ("bool", False)]), ("&", [("str", "a"), ("bool", False)]), ("|", [("bool", True), ("bool", False)]), ("!", [("bool", True)]),
    ("in", [("long", 2), (("list", "long"), (1, 2))]), ("in", [("long", 4), (("list", "double"), (1.0, 4.0))]), ("in", [("bool", True), (("list", "long"), (1, 2))]),
    ("in", [("long", 1), ("long", 2)]), ("+", [("str", "a"), ("long", 1)]), ("+", [("term", 1), ("long", 2)]), ("<", [("term", "b"), ("long", 2)]),
]


@pytest.mark.parametrize(("op", "args"), CASES)
def test_columns_compute_as_values_do(spark, op, args):
    kinds = [k for k, _ in args]
    columns = [(ty.literal(v, k), k) for k, v in args]
    try:
        want, failed = vals.apply(op, tuple(v for _, v in args)), None
    except vals.EvaluationError as e:
        want, failed = None, e.kind
    try:
        column, t, error = builtins.apply(op, columns)
    except builtins.TypeMismatch as e:
        assert failed == str(e).split(":")[0]
        return
    r = spark.range(1).select(column.alias("v"), (F.lit(None).cast("string") if error is None else error).alias("e")).first()
    assert (r.e.split(":")[0] if r.e else None) == failed
    got = None if failed else ty.to_python(r.v, t)
    assert got == pytest.approx(want) if isinstance(want, float) else vals.same(got, want)
    assert t == builtins.result_type(op, kinds)


def test_uniform_is_drawn_within_its_bounds(spark):
    column, t, _ = builtins.apply("uniform", [(F.lit(2.0), "double"), (F.lit(3.0), "double")])
    got = [r[0] for r in spark.range(50).select(column).collect()]
    assert t == "double" and all(2 <= v < 3 for v in got) and len(set(got)) > 40
