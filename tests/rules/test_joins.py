"""As-of and band joins against the plain meaning of their rules."""

import random

import pytest
from pyspark.sql import functions as F

from rulespark.functions.evaluator import Interpreter
from rulespark.plans import asof
from rulespark.session.program import Program


def program(spark, seed, rules):
    rnd = random.Random(seed)
    facts = [f"l({i},{rnd.randrange(3)},{rnd.randrange(12)})." for i in range(14)]
    facts += [f"r({i},{rnd.randrange(3)},{rnd.choice([1, 3, 3, 5, 7.5, 9])})." for i in range(14)]
    return Program(spark, " ".join([*facts, rules]))


def same(p, name):
    want = {a: v for a, v in Interpreter(p.compiled.plans, {}).run().get(name, {}).values()}
    keys = p.keys(name)
    got = {a: (float(v), keys.get(a)) for a, v in p.items(name).items()}
    assert got == {a: (float(v), k) for a, (v, k) in want.items()}


@pytest.mark.parametrize("condition", ["T < S", "T <= S", "S > T", "S >= T"])
def test_latest_before(spark, condition):
    p = program(spark, 3, f"x(P) max= T with_key E for l(P,U,S), r(E,U,T), {condition}.  y(U) max= T for l(_,U,S), r(_,U,T), {condition}.")
    assert all(asof.match(q.rule) for n in ("x/1", "y/1") for q in p.compiled.plans[n])
    same(p, "x/1")
    same(p, "y/1")
    assert "Window" in p.relation("x")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("condition", ["T > S", "T >= S", "S < T"])
def test_first_after(spark, condition):
    p = program(spark, 4, f"x(P) min= T with_key E for l(P,U,S), r(E,U,T), {condition}.")
    assert asof.match(p.compiled.plans["x/1"][0].rule)
    same(p, "x/1")


@pytest.mark.parametrize(
    "rule",
    [
        "x(P) max= T for l(P,U,S), r(_,V,T), T < S.", "x(E) max= T for l(_,U,S), r(E,U,T), T < S.", "x(P) max= S for l(P,U,S), r(_,U,T), T < S.",
        "x(P) min= T for l(P,U,S), r(_,U,T), T < S.", "x(P) max= T for l(P,U,S), r(_,U,T), T < S, S > 3.",
    ],
)
def test_other_shapes_stay_joins(spark, rule):
    p = program(spark, 5, rule)
    assert asof.match(p.compiled.plans["x/1"][0].rule) is None
    same(p, "x/1")


@pytest.mark.parametrize("rule", ["S < T, T - S <= 2", "S <= T, T - S < 3", "T > S, T - S <= 2.5", "T < S, S - T <= 4"])
@pytest.mark.parametrize("keyed", ["U", "V"])
def test_bands(spark, rule, keyed):
    p = program(spark, 6, f"x(A,B) :- {rule}, l(A,U,S), r(B,{keyed},T).  n += 1 for {rule}, l(A,U,S), r(B,{keyed},T).")
    want = Interpreter(p.compiled.plans, {}).run()
    assert set(p.items("x")) == {a for a, _ in want["x/2"].values()} and p.value("n") == want["n/0"]["[]"][1][0]
    plan = p.relation("x")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_band_over_many_rows_of_one_key(spark):
    """One user with all rows: each meets its own band and the next, not all others."""
    df = spark.range(20_000).select("id", F.lit(1).cast("long").alias("u"), (F.col("id") * 100).alias("t"))
    p = Program(spark, "near += 1 for S < T, T - S <= 250, e(_,U,S), e(_,U,T).")
    p.bind("e", df, ["id", "u", "t"], unique=True)
    assert p.value("near") == 2 * 20_000 - 3
