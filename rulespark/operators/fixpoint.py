"""Evaluates strongly connected groups of relations.

A group without recursion is one lazy frame per relation. A recursive group whose folds only
ever improve (min=, max=, :- with bodies that keep the order) runs semi-naive: each round joins
only what changed. Any other runs by rounds over the last snapshot, so no stale contribution
survives. Rounds cut the lineage; small relations stay on the driver, large ones are written.
A transitive closure of a large relation goes by classes of items that reach each other.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.functions import types as ty
from rulespark.lang.ast import Const, Var
from rulespark.lang.normal import Call, Scan, Test
from rulespark.operators import aggregate, closure, state
from rulespark.plans import asof
from rulespark.plans.frames import Builder, Failed
from rulespark.plans.planner import Plan, plan
from rulespark.plans.relation import Relation, Shape

#: Rounds in which sums of doubles may move by no more than rounding before they count as settled.
JITTER, JITTER_ROUNDS = 1e-15, 6


def components(edges: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected components, each after those that it depends on (Tarjan)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(start: str) -> None:
        work = [(start, iter(sorted(edges.get(start, ()))))]
        index[start] = low[start] = len(index)
        stack.append(start)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    work.append((other, iter(sorted(edges.get(other, ())))))
                    break
                if other in stack:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        group.append(stack.pop())
                        if group[-1] == node:
                            break
                    out.append(sorted(group))

    for name in sorted(edges):
        if name not in index:
            visit(name)
    return out


def monotone(p: Plan, group: set[str]) -> bool:
    """Whether improving a recursive item can only improve what the rule contributes."""
    rule = p.rule
    recursive = {x.out.name for x in rule.literals if isinstance(x, Scan) and f"{x.fn}/{len(x.args)}" in group and isinstance(x.out, Var)}
    if any(isinstance(x, Scan) and f"{x.fn}/{len(x.args)}" in group and (x.key or isinstance(x.out, Const)) for x in rule.literals):
        return False
    if rule.aggregator == ":-":
        uses = [x for x in rule.literals if not isinstance(x, (Scan, Test)) and recursive & {o.name for o in (*getattr(x, "args", ()), getattr(x, "out", None)) if isinstance(o, Var)}]
        return not uses
    grown = set(recursive)
    changed = True
    while changed:
        changed = False
        for x in rule.literals:
            if isinstance(x, Call) and x.op in ("+", "-") and len(x.args) == 2:
                inside = [a.name in grown if isinstance(a, Var) else False for a in x.args]
                if any(inside) and isinstance(x.out, Var) and x.out.name not in grown:
                    if x.op == "-" and inside[1]:
                        return False
                    grown.add(x.out.name)
                    changed = True
    value = rule.value.name if isinstance(rule.value, Var) else None
    if recursive and value not in grown:
        return not any(_reads(x, grown) for x in rule.literals if not isinstance(x, Scan))
    for x in rule.literals:
        if isinstance(x, Scan):
            if any(isinstance(a, Var) and a.name in grown for a in x.args):
                return False
        elif not (isinstance(x, Call) and x.op in ("+", "-")) and _reads(x, grown):
            return False
    heads = {a.name for a in rule.args if isinstance(a, Var)} | ({rule.key.name} if isinstance(rule.key, Var) else set())
    return not heads & grown


def _reads(x, names: set[str]) -> bool:
    operands = [*getattr(x, "args", ()), *(getattr(x, n, None) for n in ("out", "what", "left", "right"))]
    return any(isinstance(o, Var) and o.name in names for o in operands)


class Evaluation:
    """One evaluation of a program's relations. ``program`` gives plans, shapes and sources."""

    def __init__(self, program):
        self.program, self.spark = program, program.spark
        self.relations: dict[str, Relation] = {}
        self.converged = True
        self.rounds: dict[str, int] = {}

    # --- contributions

    def element_schema(self, name: str) -> str:
        elements: Shape = self.program.elements[name]
        parts = [f"a{i} {ty.ddl(t)}" for i, t in enumerate(elements.args)] + [f"value {ty.ddl(elements.value)}"]
        if elements.key is not None:
            parts.append(f"key {ty.ddl(elements.key)}")
        return ", ".join([*parts, "rule int"])

    def facts(self, name: str, plans: list[Plan]) -> list[DataFrame]:
        """Rules without a body: their rows."""
        elements = self.program.elements[name]
        rows = []
        for p in plans:
            r = p.rule
            values = [ty.to_spark(a.value, t) for a, t in zip((*r.args, r.value), (*elements.args, elements.value), strict=True)]
            if elements.key is not None:
                values.append(None if r.key is None else ty.to_spark(r.key.value, elements.key))
            rows.append((*values, r.rule.index))
        schema = T._parse_datatype_string(self.element_schema(name))
        return [state.local(self.spark, rows, schema)] if rows else []

    def rule(self, p: Plan, first: DataFrame | None = None, errors: list | None = None) -> DataFrame | None:
        """A rule's contributions; None if one of its relations has no row or all groundings fail."""
        for x in p.rule.literals:
            if isinstance(x, Scan) and f"{x.fn}/{len(x.args)}" not in self.relations:
                return None
        name = p.rule.name
        if name not in self.program.elements:
            return None
        if first is None and (found := asof.match(p.rule)):
            frame = asof.contributions(p.rule, found, self.builder, self.program.elements[name])
            if frame is not None:
                return frame
        builder = self.builder()
        try:
            frame, failed = builder.run(p, first).contributions(p, self.program.elements[name])
        except Failed as e:
            if errors is not None:
                started = builder.started().select(F.lit(p.rule.rule.index).alias("rule"), F.lit(str(e)).alias("message"))
                errors.append(started.limit(1))
            return None
        if failed is not None and errors is not None:
            errors.append(failed)
        return frame

    def builder(self) -> Builder:
        return Builder(self.spark, self.relations, self.program.inference, self.program.goals, self.program.functions)

    def fold(self, name: str, frames: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        elements = self.program.elements[name]
        columns = [f"a{i}" for i in range(len(elements.args))]
        frame = reduce(DataFrame.unionByName, frames)
        return aggregate.fold(frame, columns, elements.value, elements.key, self.program.aggregators[name], name in self.program.nullable)

    def gather(self, name: str, errors: list | None = None) -> list[DataFrame]:
        plans = self.program.plans.get(name, [])
        facts = [p for p in plans if _is_fact(p)]
        frames = self.facts(name, facts)
        frames += [f for p in plans if not _is_fact(p) and (f := self.rule(p, errors=errors)) is not None]
        source = self.program.sources.get(name)
        if source is not None:
            frames.append(source.contributions(self.program.elements[name]))
        return frames

    # --- groups

    def group(self, names: list[str], edges: dict[str, set[str]]) -> None:
        recursive = len(names) > 1 or names[0] in edges.get(names[0], ())
        names = [n for n in names if n in self.program.shapes and self.program.shapes[n].known()]
        if not names:
            return
        if not recursive:
            self.single(names[0])
            return
        members = set(names)
        plans = [p for n in names for p in self.program.plans.get(n, []) if p.rule.mentions() & members]
        self.settle_inputs({m for p in plans for m in p.rule.mentions()} - members)
        kinds = {self.program.aggregators[n] for n in names}
        plain = all(self.program.shapes[n].value != "term" and n not in self.program.nullable for n in names)
        if len(names) == 1 and self.closed(names[0]):
            return
        if kinds <= {"min=", "max=", ":-"} and len(kinds) == 1 and plain and all(monotone(p, members) for p in plans):
            self.semi_naive(names, plans)
        else:
            self.snapshots(names)

    def closed(self, name: str) -> bool:
        """Whether a relation is a transitive closure that is evaluated as one."""
        edge = closure.match(name, [p.rule for p in self.program.plans.get(name, [])], self.program.aggregators)
        if edge is None or edge not in self.relations or name in self.program.sources:
            return False
        shape = self.program.shapes[name]
        if shape != self.program.shapes[edge] or shape.args[0] != shape.args[1] or shape.args[0] not in ("long", "str"):
            return False
        frame = closure.pairs(self.relations[edge].frame.select("a0", "a1"))
        if frame is None:
            return False
        self.relations[name] = Relation(name, shape, self._typed(name, frame.withColumn("value", F.lit(True))))
        self.rounds[name] = 1
        return True

    def settle_inputs(self, names: set[str]) -> None:
        """Derived relations that every round reads are computed once, before the first."""
        for n in sorted(names & set(self.relations)):
            relation = self.relations[n]
            if not relation.settled and not (n in self.program.sources and self.program.sources[n].direct):
                relation.frame = state.settled(self._typed(n, relation.frame), len(relation.shape.args)).frame
                relation.settled = True

    def single(self, name: str) -> None:
        source = self.program.sources.get(name)
        relation = Relation(name, self.program.shapes[name])
        if source is not None and source.direct and not self.program.plans.get(name):
            relation.frame = source.items(relation.shape)
        else:
            frames = self.gather(name, relation.errors)
            if not frames:
                if relation.errors:
                    self.program.rule_errors[name] = relation.errors
                return
            relation.frame, relation.failed = self.fold(name, frames)
            if self.program.aggregators[name] == ":-" and all(_surely_true(p, self.program.aggregators) for p in self.program.plans.get(name, [])):
                relation.raw = reduce(DataFrame.unionByName, frames)
        self.relations[name] = relation

    def schema(self, name: str) -> T.StructType:
        shape = self.program.shapes[name]
        parts = [f"a{i} {ty.ddl(t)}" for i, t in enumerate(shape.args)] + [f"value {ty.ddl(shape.value)}"]
        if shape.key is not None:
            parts.append(f"key {ty.ddl(shape.key)}")
        return T._parse_datatype_string(", ".join(parts))

    def _typed(self, name: str, frame: DataFrame) -> DataFrame:
        wanted = self.schema(name)
        if [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in wanted]:
            return frame
        return frame.select(*(F.col(f.name).cast(f.dataType) for f in wanted))

    def put(self, name: str, held: state.Held, errors: list | None = None, failed: DataFrame | None = None) -> None:
        self.relations[name] = Relation(name, self.program.shapes[name], held.frame, failed, errors or [], settled=True)

    def snapshots(self, names: list[str]) -> None:
        width, members = {n: len(self.program.shapes[n].args) for n in names}, set(names)
        now = {n: state.empty(self.spark, self.schema(n), width[n]) for n in names}
        for n in names:
            self.put(n, now[n])
        # Steps at which a relation was last evaluated and last changed: what read no change since is as it was.
        steps, evaluated, changed = count(), dict.fromkeys(names, -1), dict.fromkeys(names, -1)
        jitter = 0
        for round_ in range(1, self.program.max_rounds + 1):
            moved, worst = False, 0.0
            for n in names:
                if all(changed[m] < evaluated[n] for m in self.program.edges.get(n, set()) & members):
                    continue
                evaluated[n] = next(steps)
                errors: list = []
                frames = self.gather(n, errors)
                failed = None
                if frames:
                    items, failed = self.fold(n, frames)
                    after = state.hold(self._typed(n, items), width[n], large=now[n].rows is None)
                else:
                    after = state.empty(self.spark, self.schema(n), width[n])
                differs, change = state.differences(now[n], after, [f"a{i}" for i in range(width[n])])
                moved, worst = moved or differs, max(worst, change)
                if differs:
                    changed[n] = evaluated[n]
                state.retire([now[n]], [after])
                now[n] = after
                self.put(n, after, errors, failed)
            jitter = jitter + 1 if moved and worst <= JITTER else 0
            if not moved or jitter >= JITTER_ROUNDS or moved and worst <= self.program.tolerance:
                break
        else:
            self.converged = False
        for n in names:
            self.rounds[n] = round_

    def semi_naive(self, names: list[str], plans: list[Plan]) -> None:
        width = {n: len(self.program.shapes[n].args) for n in names}
        members = set(names)
        full = {n: state.empty(self.spark, self.schema(n), width[n]) for n in names}
        for n in names:
            self.put(n, full[n])
        deltas = {}
        for n in names:
            base = [p for p in self.program.plans.get(n, []) if not p.rule.mentions() & members]
            frames = self.facts(n, [p for p in base if _is_fact(p)])
            errors: list = []
            frames += [f for p in base if not _is_fact(p) and (f := self.rule(p, errors=errors)) is not None]
            if n in self.program.sources:
                frames.append(self.program.sources[n].contributions(self.program.elements[n]))
            if frames:
                deltas[n] = state.hold(self._typed(n, self.fold(n, frames)[0]), width[n])
            else:
                deltas[n] = state.empty(self.spark, self.schema(n), width[n])
            full[n] = deltas[n]
            self.put(n, full[n], errors)
        # One plan for each recursive mention, which starts from the changed rows.
        starts = defaultdict(list)
        for p in plans:
            for i, x in enumerate(p.rule.literals):
                if isinstance(x, Scan) and f"{x.fn}/{len(x.args)}" in members:
                    starts[p.rule.name].append((f"{x.fn}/{len(x.args)}", plan(p.rule, first=i)))
        ends = all(self.program.aggregators[n] == ":-" for n in names) and all(_makes_no_values(p) for p in plans)
        for round_ in count(1):
            if all(d.size_known_empty() for d in deltas.values()):
                break
            if round_ > self.program.max_rounds and not ends:
                raise RuntimeError(f"{', '.join(names)} not settled after {self.program.max_rounds} rounds")
            found = {}
            for n in names:
                frames = []
                for mention, p in starts[n]:
                    if not deltas[mention].size_known_empty():
                        frame = self.rule(p, first=deltas[mention].frame)
                        if frame is not None:
                            frames.append(frame)
                found[n] = frames
            fresh = {}
            for n in names:
                fresh[n] = self._improved(n, found[n], full[n], width[n]) if found[n] else state.empty(self.spark, self.schema(n), width[n])
            old = [*full.values(), *deltas.values()]
            for n in names:
                if not fresh[n].size_known_empty():
                    full[n] = self._merged(n, full[n], fresh[n], width[n])
                    self.put(n, full[n], self.relations[n].errors)
            deltas = {n: d if d.rows is not None or not d.frame.isEmpty() else state.empty(self.spark, self.schema(n), width[n]) for n, d in fresh.items()}
            state.retire([*old, *fresh.values()], [*full.values(), *deltas.values()])
        for n in names:
            self.rounds[n] = round_

    def _better(self, aggregator: str, new: tuple, old: tuple) -> bool:
        if aggregator == ":-":
            return False
        none_first = lambda v: tuple((x is not None, x) for x in v)
        return none_first(new) < none_first(old) if aggregator == "min=" else none_first(new) > none_first(old)

    def _improved(self, name: str, frames: list[DataFrame], full: state.Held, width: int) -> state.Held:
        """Of this round's folded contributions, the rows that are new or better."""
        items = self._typed(name, self.fold(name, frames)[0])
        aggregator = self.program.aggregators[name]
        if full.rows is not None:
            got = state.hold(items, width)
            if got.rows is not None:
                rows = {k: v for k, v in got.rows.items() if k not in full.rows or self._better(aggregator, v, full.rows[k])}
                return state.from_rows(self.spark, rows, width, self.schema(name))
            items = got.frame
        columns = [f"a{i}" for i in range(width)]
        if aggregator == ":-" and columns:
            known = full.frame.select(*(F.col(c).alias(f"o_{c}") for c in columns))
            fresh = items.join(known, [items[c] == known[f"o_{c}"] for c in columns], "left_anti")
            return state.hold(fresh, width, large=full.rows is None)
        old = full.frame.select(*(F.col(c).alias(f"o_{c}") for c in full.frame.columns), F.lit(True).alias("o_there"))
        if columns:
            both = items.join(old, [items[c] == old[f"o_{c}"] for c in columns], "left")
        else:
            both = items.join(old, F.lit(True), "left")
        rest = [c for c in items.columns if c not in columns]
        better = F.lit(False)
        if aggregator != ":-":
            a, b = F.struct(*(F.col(c) for c in rest)), F.struct(*(F.col(f"o_{c}").alias(c) for c in rest))
            better = a < b if aggregator == "min=" else a > b
        return state.hold(both.where(F.col("o_there").isNull() | better).select(*items.columns), width, large=full.rows is None and width > 0)

    def _merged(self, name: str, full: state.Held, fresh: state.Held, width: int) -> state.Held:
        if full.rows is not None and fresh.rows is not None:
            rows = {**full.rows, **fresh.rows}
            if len(rows) <= state.SMALL:
                return state.from_rows(self.spark, rows, width, self.schema(name))
        columns = [f"a{i}" for i in range(width)]
        if self.program.aggregators[name] == ":-":
            return state.extended(full, fresh)
        marked = full.frame.withColumn("rule", F.lit(0)).unionByName(fresh.frame.withColumn("rule", F.lit(0)))
        shape = self.program.shapes[name]
        items, _ = aggregate.fold(marked, columns, shape.value, shape.key, self.program.aggregators[name], False)
        return state.written(self._typed(name, items), width)


def _surely_true(p: Plan, aggregators: dict[str, str]) -> bool:
    """Whether a rule contributes nothing but true: it says so, its value is tested, or it is
    that of a relation that holds nothing else."""
    value = p.rule.value
    if isinstance(value, Const):
        return value.value is True
    return any(
        isinstance(x, Test) and x.what == value
        or isinstance(x, Scan) and x.out == value and not x.key and aggregators.get(f"{x.fn}/{len(x.args)}") == ":-"
        for x in p.rule.literals
    )


def _makes_no_values(p: Plan) -> bool:
    """Whether a rule's head holds nothing but constants and what its body's relations hold, so
    that over finite data its recursion ends."""
    held = {a for x in p.rule.literals if isinstance(x, Scan) for a in (*x.args, x.out)}
    return all(isinstance(a, Const) or a in held for a in p.rule.args)


def _is_fact(p: Plan) -> bool:
    return not p.rule.literals and all(isinstance(x, Const) for x in (*p.rule.args, p.rule.value, *([p.rule.key] if p.rule.key is not None else [])))
