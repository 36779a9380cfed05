"""Transitive closures of large relations, by classes of items that reach each other.

    r(A,B) :- e(A,B).   r(A,C) :- r(A,B), e(B,C).

Items on a common cycle reach the same ones, so the rounds need only go over such classes; the pairs
are a join of the closure of classes with their members, planned lazily and never held. Which classes
are found decides about cost only: whatever stays apart is closed by the usual rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.lang.ast import Const, Var
from rulespark.lang.normal import Scan, Test
from rulespark.operators import state

#: Rounds in which a pass has to find what the largest item is that reaches each; a long chain takes more.
ROUNDS = 30
#: A pass that merges a smaller part of the items than this is the last.
WORTH = 0.1


def match(name: str, rules: list, aggregators: dict[str, str]) -> str | None:
    """The relation whose transitive closure ``rules``, all of ``name``, define; else None."""
    if len(rules) != 2 or aggregators.get(name) != ":-":
        return None
    base, step = sorted(rules, key=lambda r: name in r.mentions())
    found = []
    for rule in (base, step):
        scans = [x for x in rule.literals if isinstance(x, Scan)]
        outs = [x.out for x in scans]
        if any(x.key or len(x.args) != 2 or not all(isinstance(a, Var) for a in (*x.args, x.out)) for x in scans) or rule.key is not None:
            return None
        if any(not isinstance(x, Scan) and not (isinstance(x, Test) and (x.what in outs or x.what == Const(True))) for x in rule.literals):
            return None
        if rule.value != Const(True) and rule.value not in outs or len(set(outs)) < len(outs) or set(outs) & {a for x in scans for a in x.args}:
            return None
        found.append(scans)
    if len(found[0]) != 1 or len(found[1]) != 2:
        return None
    edge = f"{found[0][0].fn}/2"
    if edge == name or aggregators.get(edge) != ":-" or found[0][0].args != tuple(base.args) or len(set(base.args)) < 2:
        return None
    for first, second in (found[1], found[1][::-1]):
        a, b, c = *first.args, second.args[1]
        names = {f"{x.fn}/2" for x in (first, second)}
        if second.args[0] == b and (a, c) == tuple(step.args) and len({a, b, c}) == 3 and name in names and names <= {name, edge}:
            return edge
    return None


def _classes(edges: DataFrame) -> DataFrame | None:
    """(item, class) of items that reach each other, a part of them at least; None if that takes long.

    An item's colour is the largest that reaches it. What reaches that one within the colour is on a cycle with it."""
    from rulespark.session.program import Program

    p = Program(edges.sparkSession, """
        colour(X) max= X for edge(X,_).
        colour(B) max= colour(A) for edge(A,B).
        cyclic(X) :- colour(X) == X.
        cyclic(A) :- cyclic(B), edge(A,B), colour(A) == colour(B).
        class(X) = colour(X) for cyclic(X).""", max_rounds=ROUNDS)  # fmt: skip
    p.bind("edge", edges, ["a0", "a1"], unique=True)
    try:
        return p.relation("class", "item", "class").where(F.col("item") != F.col("class"))
    except RuntimeError:
        return None


def pairs(edges: DataFrame) -> DataFrame | None:
    """(a0, a1) of the closure of ``edges``, lazily; None if there are few edges or few cycles."""
    from rulespark.session.program import Program

    spark = edges.sparkSession
    if edges.limit(state.SMALL + 1).count() <= state.SMALL or not edges.where("a0 is null or a1 is null").isEmpty():
        return None
    left = state.written(edges.distinct(), 2).frame
    members = left.select(F.col("a0").alias("item")).union(left.select("a1")).distinct().select("item", F.col("item").alias("class"))
    members, merged = state.written(members, 1).frame, False
    while (found := _classes(left)) is not None:
        found = state.written(found, 1).frame
        moved, items = found.count(), members.select("class").distinct().count()
        if moved == 0:
            break
        merged = True

        def renamed(frame: DataFrame, column: str, found=found) -> DataFrame:
            to = found.select(F.col("item").alias("_item"), F.col("class").alias("_class"))
            frame = frame.join(to, F.col(column) == F.col("_item"), "left")
            return frame.withColumn(column, F.coalesce("_class", column)).drop("_item", "_class")

        left = state.written(renamed(renamed(left, "a0"), "a1").distinct(), 2).frame
        members = state.written(renamed(members, "class"), 1).frame
        if moved < WORTH * items:
            break
    if not merged:
        return None
    p = Program(spark, "reach(A,B) :- first(A,B).  reach(A,C) :- reach(A,B), edge(B,C).")
    p.bind("first", left, ["a0", "a1"], unique=True)
    p.bind("edge", left, ["a0", "a1"], unique=True)
    between = p.relation("reach", "from", "to").select("from", "to")
    # One class may hold nearly all items: its members are dealt to many tasks by a number of their own.
    tasks = 8 * spark.sparkContext.defaultParallelism
    parts = 4 * tasks
    ends = members.select(F.col("item").alias("a1"), F.col("class").alias("to"), F.pmod(F.hash("item"), F.lit(parts)).alias("part"))
    starts = members.select(F.col("item").alias("a0"), F.col("class").alias("from")).join(between, "from")
    starts = starts.select("a0", "to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(tasks, "to", "part")
    return starts.join(ends, ["to", "part"]).select("a0", "a1")
