"""As-of rules as one window instead of a join.

``best(P) max= T with_key E for left(P,U,S), right(E,U,T), T < S`` asks, for each row of the left,
for the latest earlier row of the right with the same U. A join would list all earlier rows of
each; here both sides are sorted together once per U and a running maximum is read off, so the
work is linear in the rows however many share a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.lang.ast import Var
from rulespark.lang.normal import Call, NormalRule, Scan, Test

_EARLIER = {"<": (False, True), "<=": (False, False), ">": (True, True), ">=": (True, False)}


@dataclass
class AsOf:
    left: Scan
    right: Scan
    shared: list[str]
    at: Var  # the left's time
    time: Var  # the right's time
    strict: bool


def _names(x: Scan) -> set[str]:
    return {o.name for o in (*x.args, x.out) if isinstance(o, Var)}


def match(rule: NormalRule) -> AsOf | None:
    """The parts of an as-of rule, or None."""
    scans = [x for x in rule.literals if isinstance(x, Scan)]
    calls = [x for x in rule.literals if isinstance(x, Call)]
    tests = [x for x in rule.literals if isinstance(x, Test)]
    if len(scans) != 2 or len(calls) != 1 or len(scans) + 1 + len(tests) != len(rule.literals) or any(x.key for x in scans):
        return None
    (call,) = calls
    if call.op not in _EARLIER or not all(isinstance(a, Var) for a in call.args) or rule.aggregator not in ("max=", "min="):
        return None
    tested = {x.what.name for x in tests if isinstance(x.what, Var)}
    outs = {x.out.name for x in scans if isinstance(x.out, Var)}
    if call.out.name not in tested or len(tests) != len(tested) or not tested <= outs | {call.out.name}:
        return None
    swapped, strict = _EARLIER[call.op]
    low, high = reversed(call.args) if swapped else call.args
    time, at = (low, high) if rule.aggregator == "max=" else (high, low)
    if rule.value != time:
        return None
    sides = [x for x in scans if time.name in _names(x) and at.name not in _names(x)]
    if len(sides) != 1:
        return None
    (right,) = sides
    (left,) = (x for x in scans if x is not right)
    if at.name not in _names(left) or time.name in _names(left) or {at.name, time.name} & tested:
        return None
    shared = sorted((_names(left) & _names(right)) - {o for o in outs})
    if not shared or _names(left) & _names(right) != set(shared):
        return None
    heads = {a.name for a in rule.args if isinstance(a, Var)}
    if not heads <= _names(left) or isinstance(rule.key, Var) and rule.key.name not in _names(right):
        return None
    return AsOf(left, right, shared, at, time, strict)


def contributions(rule: NormalRule, found: AsOf, builder, shape) -> DataFrame | None:
    """(a0, ..., value, key, rule): the best of the right for each row of the left. ``builder``
    makes a fresh Builder; None if the sides' types do not compare."""
    tests = [x for x in rule.literals if isinstance(x, Test)]
    sides = []
    for scan in (found.left, found.right):
        b = builder()
        b.scan(scan, None)
        for t in tests:
            if isinstance(scan.out, Var) and t.what == scan.out:
                column, kind = b.get(scan.out)
                if kind != "bool":
                    return None
                b.keep(column)
        sides.append(b)
    left, right = sides
    at, kind = left.get(found.at)
    time, own = right.get(found.time)
    if kind != own and not {kind, own} <= set(ty.NUMERIC) or kind == "term":
        return None
    to = ty.unify(kind, own)
    joint = []
    for i, name in enumerate(found.shared):
        (a, ta), (b, tb) = left.get(Var(name)), right.get(Var(name))
        t = ty.unify(ta, tb)
        joint.append((ty.coerce(a, ta, t).alias(f"k{i}"), ty.coerce(b, tb, t).alias(f"k{i}")))
    latest = rule.aggregator == "max="
    if rule.key is None:
        key = F.lit(None).cast(ty.ddl(shape.key)) if shape.key is not None else F.lit(None).cast("string")
    else:
        key = ty.coerce(*right.get(rule.key), shape.key)
    value = F.struct(ty.coerce(time, own, shape.value).alias("v"), key.alias("k"))
    heads = [ty.coerce(*left.get(a), t).alias(f"a{i}") for i, (a, t) in enumerate(zip(rule.args, shape.args, strict=True))]
    first, second = (0, 1) if found.strict else (1, 0)
    asked = left.frame.select(*(a for a, _ in joint), ty.coerce(at, kind, to).alias("at"), F.lit(first).alias("turn"), F.struct(F.lit(1).alias("one"), *heads).alias("head"))
    given = right.frame.select(*(b for _, b in joint), ty.coerce(time, own, to).alias("at"), F.lit(second).alias("turn"), value.alias("best"))
    both = asked.unionByName(given, allowMissingColumns=True)
    order = F.col("at").asc() if latest else F.col("at").desc()
    running = Window.partitionBy(*(f"k{i}" for i in range(len(joint)))).orderBy(order, "turn").rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max if latest else F.min
    out = both.withColumn("best", pick("best").over(running)).where("head is not null and best is not null")
    columns = [F.col(f"head.a{i}") for i in range(len(heads))] + [F.col("best.v").alias("value")]
    if shape.key is not None:
        columns.append(F.col("best.k").alias("key"))
    return out.select(*columns, F.lit(rule.rule.index).alias("rule"))


