"""Runs a plan's steps as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions import builtins
from rulespark.functions import types as ty
from rulespark.functions import values as vals
from rulespark.functions.evaluator import Goals, peel
from rulespark.lang.ast import Const, Var
from rulespark.lang.normal import Build, Call, Test
from rulespark.plans.infer import Inference, Unknown
from rulespark.plans.planner import Plan


#: Operations in an expression that is repeated at its uses rather than kept as a column.
MAX_WEIGHT = 24


class Failed(Exception):
    """Every grounding of the rule raises: the types of its values do not fit a built-in."""


def bands(plan: Plan) -> dict[tuple[str, str], float]:
    """{(low, high): width} of the tested conditions low <= high (or <) and high - low <= width."""
    calls = [x for x in plan.rule.literals if isinstance(x, Call)]
    tested = {x.what.name for x in plan.rule.literals if isinstance(x, Test) and isinstance(x.what, Var)}
    held = [x for x in calls if isinstance(x.out, Var) and x.out.name in tested]
    before = {(x.args[0], x.args[1]) for x in held if x.op in ("<", "<=")} | {(x.args[1], x.args[0]) for x in held if x.op in (">", ">=")}
    out = {}
    for gap in calls:
        if gap.op == "-" and len(gap.args) == 2 and all(isinstance(a, Var) for a in gap.args) and (gap.args[1], gap.args[0]) in before:
            for low, width in before:
                if low == gap.out and isinstance(width, Const) and type(width.value) in (int, float) and width.value > 0:
                    out[gap.args[1].name, gap.args[0].name] = float(width.value)
    return out


class Builder:
    """One rule's body over ``relations`` (frames by name). Columns are v<n>; ``env``: their types."""

    def __init__(self, spark: SparkSession, relations: dict, inference: Inference, goals: Goals | None, functions: dict):
        self.spark, self.relations, self.inference = spark, relations, inference
        self.goals, self.functions = goals, functions
        self.frame: DataFrame | None = None
        self.env: dict[str, tuple[str, object]] = {}
        self.count = 0
        self.fallible = False
        #: Where integer arithmetic has overflowed, so that a value is null; taken out at the end.
        self.soft: list[Column] = []
        self.inlining: set[str] = set()
        self.weights: dict[str, int] = {}
        self.bands: dict[tuple[str, str], float] = {}

    # --- columns

    def name(self) -> str:
        self.count += 1
        return f"v{self.count}"

    def get(self, x) -> tuple[Column, object]:
        if isinstance(x, Const):
            t = ty.of_value(x.value)
            return ty.literal(x.value, t), t
        column, t = self.env[x.name]
        return (F.col(column) if isinstance(column, str) else column), t

    def set(self, var: Var, column: Column, t, lazy: bool = False) -> None:
        """Binds a variable: as a column of the frame or, if ``lazy``, as an expression that is
        put in where it is used. Expressions that have grown become columns."""
        if lazy:
            self.env[var.name] = (column, t)
            return
        name = self.name()
        self.frame = self.started().withColumn(name, column)
        self.env[var.name] = (name, t)

    def light(self, var: Var, operands: tuple) -> bool:
        """Whether an expression over the operands is small enough to be repeated."""
        weight = 1 + sum(self.weights.get(o.name, 1) for o in operands if isinstance(o, Var))
        self.weights[var.name] = weight if weight <= MAX_WEIGHT else 1
        return weight <= MAX_WEIGHT

    def started(self) -> DataFrame:
        if self.frame is None:
            self.frame = self.spark.range(1).select(F.lit(1).alias("one"))
        return self.frame

    def keep(self, condition: Column) -> None:
        """A filter. Rows that carry an error stay, to be reported."""
        if self.fallible:
            condition = condition | F.col("failure").isNotNull()
        self.frame = self.started().where(condition)

    def note(self, error: Column | None) -> None:
        if error is None:
            return
        old = F.col("failure") if self.fallible else F.lit(None).cast("string")
        self.frame = self.started().withColumn("failure", F.coalesce(old, error))
        self.fallible = True

    def apply(self, op: str, args: list[tuple[Column, object]]) -> tuple[Column, object, Column | None]:
        column, t, error = builtins.apply(op, args, self.functions, seed=self.count)
        left = None if op in self.functions else builtins.overflow(op, [c for c, _ in args], [k for _, k in args], column)
        if left is not None:
            self.soft.append(left)
        return column, t, error

    def sound(self) -> DataFrame:
        """The rows so far whose grounding has not failed."""
        frame = self.started().where("failure is null") if self.fallible else self.started()
        return frame.where(~reduce(lambda a, b: a | b, self.soft)) if self.soft else frame

    def failed(self) -> DataFrame | None:
        """``failure`` of the groundings that have; None if none can."""
        texts = [F.col("failure")] * self.fallible
        if self.soft:
            texts.append(F.when(reduce(lambda a, b: a | b, self.soft), F.lit(builtins.OVERFLOW)))
        return self.started().select(F.coalesce(*texts).alias("failure")).where("failure is not null") if texts else None

    # --- steps

    def run(self, plan: Plan, first: DataFrame | None = None) -> "Builder":
        """``first``: stands in for the relation of the first step (the changed rows)."""
        self.bands = bands(plan)
        for i, step in enumerate(plan.steps):
            instead = first if i == 0 and step.kind == "scan" else None
            if step.kind == "scan":
                self.scan(step.literal, instead)
            else:
                getattr(self, step.kind)(step)
        return self

    def scan(self, x, instead: DataFrame | None) -> None:
        relation = self.relations[f"{x.fn}/{len(x.args)}"]
        shape = relation.shape
        kind = shape.key if x.key else shape.value
        source = relation.frame if instead is None else instead
        if instead is None and self.existential(x, relation):
            source = relation.raw
        if x.key:
            source = source.where(F.col("key").isNotNull())
        picked: list[Column] = []
        seen: dict[str, tuple[str, object]] = {}
        matches: list[tuple[str, object, object]] = []
        for operand, column, t in zip((*x.args, x.out), (*relation.columns, "key" if x.key else "value"), (*shape.args, kind), strict=True):
            if isinstance(operand, Const):
                c, own = self.get(operand)
                source = source.where(builtins._equal(F.col(column), t, c, own))
                continue
            if operand.name.startswith("_") and operand.name not in self.env:
                continue  # nobody reads it: it is pruned
            name = self.name()
            picked.append(F.col(column).alias(name))
            if operand.name in self.env:
                matches.append((name, t, operand))
            elif operand.name in seen:
                first, own = seen[operand.name]
                matches.append((name, t, (first, own)))
            else:
                seen[operand.name] = (name, t)
        source = source.select(*picked) if picked else source.select(F.lit(1).alias(self.name()))
        inner = [builtins._equal(F.col(n), t, F.col(o[0]), o[1]) for n, t, o in matches if isinstance(o, tuple)]
        for condition in inner:
            source = source.where(condition)
        on = []
        for n, t, o in matches:
            if not isinstance(o, tuple):
                column, own = self.get(o)
                on.append(builtins._equal(column, own, F.col(n), t))
        if self.exists(x, relation, instead, seen, on):
            # Nothing is taken from the relation: a semi-join, which needs no distinct rows.
            self.frame = self.frame.join(source, reduce(lambda a, b: a & b, on), "left_semi")
            self.set(x.out, F.lit(True), "bool", lazy=True)
            return
        if self.frame is not None:
            source = self.banded(source, seen, on)
        if self.frame is None:
            # What is bound so far are constants.
            self.frame = reduce(DataFrame.where, on, source)
        elif on:
            self.frame = self.frame.join(source, reduce(lambda a, b: a & b, on))
        else:
            self.frame = self.frame.crossJoin(source)  # no shared variable: the rule asks for all pairs
        self.env.update(seen)

    def banded(self, source: DataFrame, seen: dict, on: list) -> DataFrame:
        """A condition 0 <= high - low <= width between the two sides gets an equality of its own:
        of the number of ``high``'s band, which is ``low``'s or the next."""
        for (low, high), width in self.bands.items():
            if high in seen and low in self.env:
                (given, kind), (name, own), step = self.get(Var(low)), seen[high], 1
            elif low in seen and high in self.env:
                (given, kind), (name, own), step = self.get(Var(high)), seen[low], -1
            else:
                continue
            if not {kind, own} <= set(ty.NUMERIC):
                continue
            here, there = self.name(), self.name()
            band = F.floor(given / F.lit(width)).cast("long")
            self.frame = self.frame.select("*", F.explode(F.array(band, band + step)).alias(here))
            on.append(F.col(here) == F.col(there))
            return source.withColumn(there, F.floor(F.col(name) / F.lit(width)).cast("long"))
        return source

    def existential(self, x, relation) -> bool:
        """Whether a scan only asks if an item is there: all its arguments are known."""
        known = all(isinstance(a, Const) or a.name in self.env for a in x.args)
        fresh = isinstance(x.out, Var) and x.out.name not in self.env
        return relation.raw is not None and not x.key and known and fresh and self.frame is not None and bool(x.args)

    def exists(self, x, relation, instead, seen: dict, on: list) -> bool:
        return instead is None and self.existential(x, relation) and set(seen) <= {x.out.name} and bool(on)

    def inlined(self, name: str, args: list[tuple[Column, object]], to):
        """A predicate without recursion and generators as one column expression, or None."""
        plans = self.goals.plans[name]
        aggregator = plans[0].rule.aggregator if plans else ""
        if to in ("term", "null") or aggregator not in (":=", "=", "+=", "min=", "max=") or name in self.inlining or (aggregator == "+=" and to not in ty.NUMERIC):
            return None
        for p in plans:
            if any(s.kind not in ("let", "check", "test", "same", "alias", "solve") for s in p.steps):
                return None
            if any(s.kind in ("let", "check") and f"{s.literal.op}/{len(s.literal.args)}" in self.goals.plans and s.literal.op == name for s in p.steps):
                return None
        alternatives, failures, soft = [], [], []
        for p in sorted(plans, key=lambda p: p.rule.rule.index):
            inner = _Inline(self, {*self.inlining, name})
            try:
                found = inner.alternative(p, args, to)
            except _NotInline:
                return None
            alternatives.append(found)
            failures += inner.failures
            soft += [inner.condition & x for x in inner.soft]
            self.frame, self.count = inner.frame, inner.count
        error = F.coalesce(*failures) if failures else None
        self.soft += soft
        values = [F.when(c, v) for c, v in alternatives]
        if not values:
            return None
        if aggregator == ":=":
            out = F.lit(None).cast(ty.ddl(to))
            for condition, value in alternatives:
                out = F.when(condition, value).otherwise(out)
            return out, error
        if len(values) == 1:
            return values[0], error
        if aggregator == "=":
            conflict = reduce(lambda a, b: a | b, [F.coalesce(a != b, F.lit(False)) for i, a in enumerate(values) for b in values[:i]])
            text = F.when(conflict, F.lit("AggregatorError: `=` got conflicting values"))
            return F.coalesce(*values), text if error is None else F.coalesce(error, text)
        if aggregator == "+=":
            total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0).cast(ty.ddl(to))) for v in values])
            return F.when(F.coalesce(*values).isNotNull(), total), error
        return (F.least if aggregator == "min=" else F.greatest)(*values), error

    def along_list(self, name: str, args: list[tuple[Column, object]], to) -> Column | None:
        """A predicate that passes down a list, ``f([], A) = ...  f([H|T], A) = f(T, ...)``, as Spark's
        aggregate over the list: a struct of the value v and the error e. None for any other form."""
        found = tail_recursion(name, self.goals.plans[name])
        kinds = [t for _, t in args]
        if found is None or to in ("term", "null") or not isinstance(kinds[0], tuple) or kinds[0][0] != "list":
            return None
        end, step, element, again = found
        if any(t in ("term", "null") for t in (kinds[0][1], *kinds[1:])):
            return None

        def held(acc: Column) -> list:
            return [(acc.getField(f"x{i}"), t) for i, t in enumerate(kinds[1:])]

        def packed(columns: list[Column], error: Column) -> Column:
            return F.struct(*(c.alias(f"x{i}") for i, c in enumerate(columns)), error.alias("e"))

        def merge(acc: Column, item: Column) -> Column:
            inner = _Loop(self, {*self.inlining, name})
            inner.bind((element, *step.rule.args[1:]), [(item, kinds[0][1]), *held(acc)])
            inner.steps([s for s in step.steps if s.literal is not again and not (s.kind == "peel" and s.literal.out == step.rule.args[0])])
            return packed(inner.values(again.args[1:], kinds[1:]), inner.error(acc.getField("e")))

        def finish(acc: Column) -> Column:
            inner = _Loop(self, {*self.inlining, name})
            inner.bind(end.rule.args[1:], held(acc))
            inner.steps(end.steps)
            return F.struct(inner.values((end.rule.value,), [to])[0].alias("v"), inner.error(acc.getField("e")).alias("e"))

        try:
            return F.aggregate(args[0][0], packed([c for c, _ in args[1:]], F.lit(None).cast("string")), merge, finish)
        except _NotInline:
            return None

    def call(self, x) -> tuple[Column, object]:
        args = [self.get(a) for a in x.args]
        name = f"{x.op}/{len(x.args)}"
        if self.goals is not None and name in self.goals.plans:
            to = self.inference.call(x.op, [t for _, t in args], x.args)
            if to is None:
                to = "term"
            found = self.inlined(name, args, to)
            if found is not None:
                own = self.name()
                self.frame = self.started().withColumn(own, found[0])
                self.note(found[1])
                self.keep(F.col(own).isNotNull())
                return F.col(own), to
            goals, op, t = self.goals, x.op, to
            both = self.along_list(name, args, to)
            if both is None:
                column, t, error = builtins.through_python(x.op, args, to, lambda *v: goals.call(op, v))
                both = F.struct(column.alias("v"), error.alias("e"))
                self.frame = self.started().withColumn(held := self.name(), both)
            else:  # a generator, so that Spark does not repeat the loop in each filter and projection
                self.frame = self.started().select("*", F.explode(F.array(both)).alias(held := self.name()))
            own = self.name()
            self.frame = self.frame.withColumn(own, F.col(held).getField("v"))
            self.note(F.col(held).getField("e"))
            self.keep(F.col(own).isNotNull() & (F.col(own) != "z" if t == "term" else F.lit(True)))
            return F.col(own), t
        op, functions = x.op, self.functions
        if op == "pycall":
            if not isinstance(x.args[0], Const) or x.args[0].value not in functions:
                raise Failed(f"NameError: no function {vals.render(x.args[0].value) if isinstance(x.args[0], Const) else '?'} is registered")
            op, args = x.args[0].value, args[1:]
        try:
            column, t, error = self.apply(op, args)
        except builtins.TypeMismatch as e:
            raise Failed(str(e)) from None
        self.note(error)
        return column, t

    def let(self, step) -> None:
        x = step.literal
        before = self.frame
        column, t = self.call(x)
        plain = self.frame is before and t != "term" and x.op not in ("uniform", "pycall") and x.op not in self.functions
        self.set(step.target, column, t, lazy=plain and self.light(step.target, x.args))

    def check(self, step) -> None:
        column, t = self.call(step.literal)
        other, own = self.get(step.literal.out)
        self.keep(builtins._equal(column, t, other, own))

    def solve(self, step) -> None:
        x = step.literal
        out, other = self.get(x.out), self.get(x.args[1 - step.place])
        try:
            if x.op == "+":
                column, t, _ = self.apply("-", [out, other])
            elif step.place == 0:
                column, t, _ = self.apply("+", [out, other])
            else:
                column, t, _ = self.apply("-", [other, out])
        except builtins.TypeMismatch as e:
            raise Failed(str(e)) from None
        self.set(step.target, column, t, lazy=t != "term" and self.light(step.target, (x.out, *x.args)))

    def each(self, step) -> None:
        source, t = self.get(step.source)
        if not (isinstance(t, tuple) and t[0] == "list"):
            if t != "term":
                raise Failed(f"TypeError: {t} is not a list")
            listed, t, error = builtins.through_python("each", [(source, t)], ("list", "term"), lambda v: tuple(vals.members(v)))
            self.note(error)
            source = listed
        name = self.name()
        explode = F.explode_outer if self.fallible else F.explode
        self.frame = self.started().select("*", explode(source).alias(name))
        if self.fallible:
            self.keep(F.col(name).isNotNull())
        self.env[step.target.name] = (name, t[1])

    def build(self, step) -> None:
        self.set(step.target, *self.built(step.literal))

    def built(self, x) -> tuple[Column, object]:
        args = [self.get(a) for a in x.args]
        t = self.inference.built(x, {v: k for v, (_, k) in self.env.items()})
        if t != "term":
            if x.fn is not None:
                return F.struct(*(ty.coerce(c, k, p).alias(f"p{i}") for i, ((c, k), p) in enumerate(zip(args, t[2], strict=True)))), t
            items = args[:-1] if x.tail else args
            own = F.array(*(ty.coerce(c, k, t[1]) for c, k in items))
            return (F.concat(own, ty.coerce(*args[-1], t)) if x.tail else own), t
        if x.fn is not None or not x.tail:
            parts = [ty.encoded(c, k) for c, k in args]
            opening, closing = ("t" + vals.encode(x.fn)[1:] + "(", ")") if x.fn is not None else ("[", "]")
            between: list[Column] = [F.lit(opening)]
            for i, p in enumerate(parts):
                between += [F.lit(",")] * bool(i) + [p]
            return F.concat(*between, F.lit(closing)), "term"

        def joined(*v):
            if not isinstance(v[-1], tuple):
                raise vals.EvaluationError("TypeError", "Malformed list")
            return v[:-1] + v[-1]

        column, t, error = builtins.through_python("list", args, "term", joined)
        self.note(error)
        return column, t

    def same(self, step) -> None:
        if step.source is None:
            left = self.built(step.literal)
        else:
            left = self.get(step.source)
        right = self.get(step.target)
        self.keep(builtins._equal(left[0], left[1], right[0], right[1]))

    def alias(self, step) -> None:
        if isinstance(step.source, Var):
            self.env[step.target.name] = self.env[step.source.name]
        else:
            self.set(step.target, *self.get(step.source), lazy=True)

    def test(self, step) -> None:
        if isinstance(step.literal.what, Const) and step.literal.what.value is True:
            return
        column, t = self.get(step.literal.what)
        if t == "bool":
            self.keep(column)
        else:
            self.keep(column == "b1" if t == "term" else F.lit(False))

    def peel(self, step) -> None:
        x = step.literal
        column, t = self.get(x.out)
        kinds = self.inference.parts(x, t)
        n = len(x.args)
        if isinstance(t, tuple) and t[0] == "struct" and x.fn == t[1] and n == len(t[2]):
            parts = [column.getField(f"p{i}") for i in range(n)]
        elif isinstance(t, tuple) and t[0] == "list" and x.fn is None:
            self.keep(F.size(column) >= n - 1 if x.tail else F.size(column) == n)
            parts = [F.get(column, F.lit(i)) for i in range(n - x.tail)]
            if x.tail:
                parts.append(F.slice(column, n, F.greatest(F.size(column) - (n - 1), F.lit(0))))
        elif t == "term":
            name = self.name()
            taken = ty.from_python(lambda v: peel(x, v), [(column, t)], ("list", "term"))
            self.frame = self.started().withColumn(name, taken)
            self.keep(F.col(name).isNotNull())
            parts = [F.get(F.col(name), F.lit(i)) for i in range(n)]
        else:
            self.keep(F.lit(False))
            parts = [F.lit(None).cast("string")] * n
        for operand, part, kind in zip(x.args, parts, kinds, strict=True):
            if isinstance(operand, Var) and operand.name not in self.env:
                self.set(operand, part, kind, lazy=True)
            else:
                other, own = self.get(operand)
                self.keep(builtins._equal(part, kind, other, own))

    # --- the end

    def contributions(self, plan: Plan, shape) -> tuple[DataFrame, DataFrame | None]:
        """(a0, ..., value, key, rule) of the rule's groundings; (rule, message) of those that fail."""
        rule = plan.rule
        out = []
        for name, operand, t in zip(
            (*(f"a{i}" for i in range(len(rule.args))), "value"), (*rule.args, rule.value), (*shape.args, shape.value), strict=True
        ):
            column, own = self.get(operand)
            out.append(ty.coerce(column, own, t).alias(name))
        if shape.key is not None:
            if rule.key is None:
                out.append(F.lit(None).cast(ty.ddl(shape.key)).alias("key"))
            else:
                out.append(ty.coerce(*self.get(rule.key), shape.key).alias("key"))
        out.append(F.lit(rule.rule.index).alias("rule"))
        failed = self.failed()
        if failed is not None:
            failed = failed.select(F.lit(rule.rule.index).alias("rule"), F.col("failure").alias("message"))
        return self.sound().select(*out), failed


def tail_recursion(name: str, plans: list[Plan]):
    """(plan of the empty list, plan of a step, the step's element, its call of itself) if the predicate
    does nothing but pass down its first argument, a list, with the others as what it carries."""
    if len(plans) != 2 or any(p.rule.aggregator not in ("=", ":=") or p.rule.key is not None for p in plans):
        return None
    end, step = sorted(plans, key=lambda p: p.rule.args[0] != Const(()))
    carried = [p.rule.args[1:] for p in (end, step)]
    if end.rule.args[0] != Const(()) or any(not all(isinstance(a, Var) for a in own) or len(set(own)) < len(own) for own in carried):
        return None
    lists = [x for x in step.rule.literals if isinstance(x, Build) and x.fn is None and x.tail and x.out == step.rule.args[0]]
    calls = [x for x in step.rule.literals if isinstance(x, Call) and f"{x.op}/{len(x.args)}" == name]
    if len(lists) != 1 or len(lists[0].args) != 2 or len(calls) != 1:
        return None
    (element, rest), again = lists[0].args, calls[0]
    if not isinstance(element, Var) or not isinstance(rest, Var) or element == rest or {element, rest, step.rule.args[0]} & set(carried[1]):
        return None
    if again.args[0] != rest or again.out != step.rule.value or not isinstance(again.out, Var):
        return None
    used = [o for x in step.rule.literals for o in (*getattr(x, "args", ()), *(getattr(x, n, None) for n in ("out", "what", "left", "right")))]
    if used.count(rest) != 2 or used.count(again.out) != 1 or used.count(step.rule.args[0]) != 1:
        return None
    return end, step, element, again


class _NotInline(Exception):
    pass


class _Inline(Builder):
    """Runs one rule of a predicate over the caller's rows: filters become a condition."""

    def __init__(self, outer: Builder, inlining: set[str]):
        super().__init__(outer.spark, outer.relations, outer.inference, outer.goals, outer.functions)
        self.frame, self.count, self.inlining = outer.started(), outer.count, inlining
        self.condition: Column = F.lit(True)
        self.failures: list[Column] = []

    def keep(self, condition: Column) -> None:
        self.condition = self.condition & F.coalesce(condition, F.lit(False))

    def note(self, error: Column | None) -> None:
        if error is not None:
            self.failures.append(F.when(self.condition, error))

    def alternative(self, p: Plan, args: list, to) -> tuple[Column, Column]:
        """(whether the rule has a value, the value)."""
        for operand, (column, t) in zip(p.rule.args, args, strict=True):
            if isinstance(operand, Var) and operand.name not in self.env:
                self.set(operand, column, t)
            else:
                other, own = self.get(operand)
                self.keep(builtins._equal(column, t, other, own))
        try:
            self.run(p)
        except Failed:
            raise _NotInline from None
        value, t = self.get(p.rule.value)
        if ty.unify(t, to) != to:
            raise _NotInline
        return self.condition, ty.coerce(value, t, to)


class _Loop(Builder):
    """One rule of a predicate within a lambda: nothing may become a column of the frame, run in
    Python or leave the rule without a value."""

    NATIVE = {"+", "-", "*", "/", "mod", "abs"}

    def __init__(self, outer: Builder, inlining: set[str]):
        super().__init__(outer.spark, outer.relations, outer.inference, outer.goals, outer.functions)
        self.inlining = inlining
        self.failures: list[Column] = []

    def bind(self, operands: tuple, columns: list) -> None:
        self.env |= {o.name: c for o, c in zip(operands, columns, strict=True)}

    def steps(self, steps: list) -> None:
        for s in steps:
            if s.kind == "test" and s.literal.what == Const(True):
                continue
            if s.kind not in ("let", "alias", "solve", "build", "peel"):
                raise _NotInline
            try:
                getattr(self, s.kind)(s)
            except Failed:
                raise _NotInline from None

    def values(self, operands: tuple, kinds: list) -> list[Column]:
        found = [self.get(o) for o in operands]
        if any(ty.unify(t, to) != to for (_, t), to in zip(found, kinds, strict=True)):
            raise _NotInline
        return [ty.coerce(c, t, to) for (c, t), to in zip(found, kinds, strict=True)]

    def error(self, before: Column) -> Column:
        """The first error: the one carried so far, or one of these steps."""
        return F.coalesce(before, *self.failures, *(F.when(s, F.lit(builtins.OVERFLOW)) for s in self.soft))

    def set(self, var: Var, column: Column, t, lazy: bool = False) -> None:
        if t in ("term", "null"):
            raise _NotInline
        self.env[var.name] = (column, t)

    def started(self) -> DataFrame:
        raise _NotInline

    def keep(self, condition: Column) -> None:
        raise _NotInline

    def note(self, error: Column | None) -> None:
        if error is not None:
            self.failures.append(error)

    def apply(self, op: str, args: list[tuple[Column, object]]) -> tuple[Column, object, Column | None]:
        if op not in self.NATIVE or op in self.functions or any(t not in ty.NUMERIC for _, t in args):
            raise _NotInline
        return super().apply(op, args)


__all__ = ["Builder", "Failed", "Unknown"]
